"""N-gram Jaccard self-join by vertical partitioning, and the components of its links.

The global order of the shingles is cut into fragments twice. First, fragments of about ``FRAGMENT`` bytes of text each
count for every document how many of its shingles there stand in no other document; the counts are summed per document. A
document with more of them than the similarity allows of all its shingles has no partner and is done, wherever in the order
they stand, so the first ``PART`` of the order is enough to drop documents without losing a link; common passages alone never
fill a document. This cut has two levels, so that rows do not grow as blocks times fragments: a block writes a row for each
coarse fragment; rows of a coarse fragment and as many blocks are cut again, a row for each fine fragment, in which equal
shingles meet; counts go back the same way. At both levels rows are as many as blocks times the root of the fragments.
Of the rest, equal sets are one class with its smallest doc_id as representative.

The pairs of representatives that may be linked share a shingle of their prefixes (their rarest shingles, of which
similar sets must share one). Their sets are cut at the same places of the order into ``CUTS`` fragments, the overlap of
each pair is counted in each fragment by itself, and the counts are summed per pair. Not all pairs of a group are
candidates: in a first round each document meets the hub of each prefix shingle, which is the document with fewest
shingles of its own, so a group of copies costs as many pairs as it has members. In a second round only documents meet
that share a prefix shingle, stand in different components after the first, and pass the length and position filters.
Such a shingle's rows are dealt over cells of at most ``BLOCK`` rows a side; rows of its largest component meet the
others only. Pairs within a component need no test, as their link would add nothing.

Defined cases: null or empty text has an empty set and is its own component; texts of fewer words than a shingle are one
shingle; texts of any length are read whole, a set's memory follows its distinct shingles; a null doc_id has its set size
and a null component; rows that repeat a doc_id are one node with each row's links; ties of hubs go to the smaller
doc_id; an empty table gives no rows; extra columns are dropped.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.llm.common import Bounded, byte_column, discard, join_hot, partitions, release, releasing, slices, written
from assaylake.llm.graph import components

_M = np.uint64(0x9E3779B97F4A7C15)
_LOW = 5  # bytes of a shingle's hash that a fragment gets; the fragment itself stands for the upper ones
#: Bytes of text whose shingles a block holds, and that a fragment of the first cut holds on average (two million shingles).
TEXT, FRAGMENT = 3 << 20, 12 << 20
#: The first cut counts in this part of the order, in tenths of what similar documents may differ in: documents of which over
#: two fifths stand nowhere else are dropped by it. Blocks' worth of shingles that a task of it gathers for the fine fragments.
PART, GATHER = 25, 4
_DOC_BITS = 20  # of a document's number in its block
_NO_DOC = (1 << _DOC_BITS) - 1
#: Fragments of the second cut, and rows on a side of a cell.
CUTS, BLOCK = 8, 1000


class Shingler:
    """Hashes of the shingles of texts."""

    def __init__(self, words: int):
        import xxhash

        self.n, self.word = words, Bounded(xxhash.xxh3_64_intdigest, 50_000)

    def block(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All shingles of the texts with repeats, and the index of each one's text."""
        get, n = self.word.__getitem__, self.n
        parts, sizes = [], []
        for text in texts:
            words = text.lower().split()
            w = np.fromiter(map(get, words), np.uint64, len(words))
            sizes.append(len(w))
            parts.append(w)
        sizes = np.array(sizes, np.int64)
        stream = np.concatenate([*parts, np.zeros(n, np.uint64)])
        h = np.full(len(stream) - n, 0, np.uint64)
        for k in range(n):
            h = (h ^ stream[k : k + len(h)]) * _M
            h ^= h >> np.uint64(32)
        ends = np.cumsum(sizes)
        count = np.maximum(sizes - n + 1, 0)
        doc = np.repeat(np.arange(len(texts)), count)
        at = np.arange(len(doc)) + np.repeat(ends - sizes - (np.cumsum(count) - count), count)
        h = h[at] if len(at) else h[:0]
        short = np.flatnonzero((sizes > 0) & (sizes < n))
        if len(short):
            own = []
            for i in short:
                x = np.array([sizes[i]], np.uint64)
                for w in parts[i]:
                    x = (x ^ w) * _M
                    x ^= x >> np.uint64(31)
                own.append(x[0])
            h, doc = np.append(h, np.array(own, np.uint64)), np.append(doc, short)
        return h, doc


def _prepare(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _packed(codes: np.ndarray, counts: np.ndarray) -> bytes:
    """Counts of documents, where a code is the block's number and the document's within it."""
    return zlib.compress(codes.astype("<i8").tobytes() + counts.astype("<i4").tobytes(), 1)


def _unpacked(x: bytes) -> tuple[np.ndarray, np.ndarray]:
    x = zlib.decompress(x)
    n = len(x) // 12
    return np.frombuffer(x, "<i8", n), np.frombuffer(x, "<i4", n, 8 * n).astype(np.int64)


def _lows(x: bytes) -> np.ndarray:
    wide = np.zeros((len(x) // _LOW, 8), np.uint8)
    wide[:, :_LOW] = np.frombuffer(x, np.uint8).reshape(-1, _LOW)
    return wide.view("<u8").ravel()


def _bytes(h: np.ndarray) -> np.ndarray:
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_LOW]


#: Rows of the first cut: ``own`` are counts by document, ``low`` their shingles in the same order. Rows of a negative fragment
#: are a block's documents; they pass all levels.
_CUT = "fragment int, gather long, block long, own binary, low binary"
_CUT_TYPES = pa.schema([("fragment", pa.int32()), ("gather", pa.int64()), ("block", pa.int64()), ("own", pa.binary()), ("low", pa.binary())])


def _coarse(docs: DataFrame, words: int, percent: int, side: int, gathers: int) -> DataFrame:
    """A row for each block and coarse fragment, one of ``side``. Shingles of several documents of a block are one, of no document."""
    part_of_order = min(1 << 30, (1 << 30) * PART * (100 - percent) // 1000)

    def run(batches):
        shingler, part, seq = Shingler(words), TaskContext.get().partitionId(), 0
        for whole in batches:
            for b in (x for i in range(0, whole.num_rows, _NO_DOC) for x in slices(whole.slice(i, _NO_DOC), "text", TEXT)):
                block = part << 16 | seq
                gather = zlib.crc32(block.to_bytes(8, "little")) % gathers
                seq += 1
                h, d = shingler.block(byte_column(b, "text"))
                order = np.argsort(h, kind="stable")
                h, d = h[order], d[order]
                if len(h):
                    fresh = np.append(True, (h[1:] != h[:-1]) | (d[1:] != d[:-1]))
                    h, d = h[fresh], d[fresh]
                n = np.bincount(d, minlength=b.num_rows)
                end = np.searchsorted(h, np.uint64(part_of_order << 34)) if part_of_order < 1 << 30 else len(h)
                h, d = h[:end], d[:end]
                lead = np.flatnonzero(np.append(True, h[1:] != h[:-1])) if len(h) else np.zeros(0, np.int64)
                size = np.diff(np.append(lead, len(h)))
                lone = np.bincount(d[np.repeat(size == 1, size)], minlength=b.num_rows)
                ids = b.column("doc_id")
                valid = np.array(ids.is_valid())
                ids = ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8")
                rows = [(-1 - block % (side * side), zlib.compress(np.stack([n, lone, valid]).astype("<i4").tobytes(), 1), ids.tobytes())]
                h, d = h[lead], np.where(size > 1, _NO_DOC, d[lead])
                cuts = np.searchsorted(h, np.array([-(-f * part_of_order // side) << 34 for f in range(1, side)], np.uint64))
                for f, (x, y) in enumerate(zip(np.append(0, cuts), np.append(cuts, len(h)))):
                    if x < y:
                        order = np.argsort(d[x:y], kind="stable")
                        own, counts = np.unique(d[x:y], return_counts=True)
                        rows.append((f, _packed(own + (block << _DOC_BITS), counts), _bytes(h[x:y][order]).tobytes()))
                for i in range(0, len(rows), 64):
                    f, own, low = zip(*rows[i : i + 64])
                    yield pa.RecordBatch.from_arrays([pa.array(f, pa.int32()), pa.array([gather] * len(f), pa.int64()), pa.array([block] * len(f), pa.int64()), pa.array(own, pa.binary()), pa.array(low, pa.binary())], schema=_CUT_TYPES)

    return docs.mapInArrow(releasing(run), _CUT)


def _finer(side: int):
    """Cuts the rows of a coarse fragment and a gathering of blocks into ``side`` fine fragments, a row each."""

    def cut(t: pa.Table) -> pa.Table:
        if t.num_rows == 0 or t.column("fragment")[0].as_py() < 0:
            return t
        coarse, gather = t.column("fragment")[0].as_py(), t.column("gather")[0].as_py()
        h = np.concatenate([_lows(x) for x in t.column("low").to_pylist()])
        codes = np.concatenate([np.repeat(*_unpacked(x)) for x in t.column("own").to_pylist()])
        fine = (h * np.uint64(side) >> np.uint64(8 * _LOW)).astype(np.int64)
        order = np.lexsort((codes, fine))
        h, codes, fine = _bytes(h[order]), codes[order], fine[order]
        cuts = np.searchsorted(fine, np.arange(side + 1))
        fragment, own, low = [], [], []
        for f, (x, y) in enumerate(zip(cuts, cuts[1:])):
            if x < y:
                fragment.append(coarse * side + f)
                own.append(_packed(*np.unique(codes[x:y], return_counts=True)))
                low.append(h[x:y].tobytes())
        k = len(own)
        return pa.table([pa.array(fragment, pa.int32()), pa.array([gather] * k, pa.int64()), pa.nulls(k, pa.int64()), pa.array(own, pa.binary()), pa.array(low, pa.binary())], schema=_CUT_TYPES)

    return cut


def _count_fragment(t: pa.Table) -> pa.Table:
    """How many shingles of each document stand in other blocks too; a row for each gathering that has such documents."""
    if t.num_rows == 0 or t.column("fragment")[0].as_py() < 0:
        return t
    rows = [_lows(x) for x in t.column("low").to_pylist()]
    h = np.concatenate(rows)
    h.sort()
    again = h[1:][h[1:] == h[:-1]]
    del h
    again = again[np.append(True, again[1:] != again[:-1])] if len(again) else again
    gather, out = [], []
    for g, own, row in zip(t.column("gather").to_pylist(), t.column("own").to_pylist(), rows):
        if not len(again):
            break
        codes, counts = _unpacked(own)
        at = np.minimum(np.searchsorted(again, row), len(again) - 1)
        shared = np.diff(np.append(0, np.cumsum(again[at] == row))[np.append(0, np.cumsum(counts))])
        some = (shared > 0) & (codes & _NO_DOC != _NO_DOC)
        if some.any():
            gather.append(g)
            out.append(_packed(codes[some], shared[some]))
    k, fragment = len(out), t.column("fragment")[0].as_py()
    del rows
    release()
    return pa.table([pa.array([fragment] * k, pa.int32()), pa.array(gather, pa.int64()), pa.nulls(k, pa.int64()), pa.array(out, pa.binary()), pa.nulls(k, pa.binary())], schema=_CUT_TYPES)


def _sum_gathering(t: pa.Table) -> pa.Table:
    """The counts of a coarse fragment's fine ones, summed; a row for each block."""
    t = t.select(["fragment", "block", "own", "low"])
    if t.num_rows == 0 or t.column("fragment")[0].as_py() < 0:
        return t.drop_columns("fragment")
    codes, counts = (np.concatenate(x) for x in zip(*map(_unpacked, t.column("own").to_pylist())))
    codes, at = np.unique(codes, return_inverse=True)
    counts = np.bincount(at, counts).astype(np.int64)
    blocks, first = np.unique(codes >> _DOC_BITS, return_index=True)
    out = [_packed(codes[x:y], counts[x:y]) for x, y in zip(first, np.append(first[1:], len(codes)))]
    return pa.table([pa.array(blocks, pa.int64()), pa.array(out, pa.binary()), pa.nulls(len(out), pa.binary())], names=["block", "own", "low"])


def _sum_block(t: pa.Table) -> pa.Table:
    """doc_id, n_shingles, lone of a block's documents."""
    shared = []
    for own, low in zip(t.column("own").to_pylist(), t.column("low").to_pylist()):
        if low is None:
            shared.append(_unpacked(own))
        else:
            ids = np.frombuffer(low, "<i8")
            n, lone, valid = np.frombuffer(zlib.decompress(own), "<i4").astype(np.int64).reshape(3, -1)
    for codes, counts in shared:
        lone[codes & _NO_DOC] -= counts
    return pa.table([pa.array(ids, pa.int64(), mask=valid == 0), pa.array(n, pa.int64()), pa.array(lone, pa.int64())], names=["doc_id", "n_shingles", "lone"])


def count_lone(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, lone of every document: its shingles in the first part of the order that stand in no other document."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    held = size * min(1000, PART * (100 - percent)) // 1000
    side = math.isqrt(max(partitions(docs.sparkSession), -(-held // FRAGMENT)) - 1) + 1
    gathers = -(-size // (TEXT * GATHER * side)) or 1
    fine = _coarse(docs, words, percent, side, gathers).groupBy("fragment", "gather").applyInArrow(_finer(side), _CUT)
    counted = fine.groupBy("fragment").applyInArrow(_count_fragment, _CUT)
    summed = counted.groupBy("gather", F.floor(F.col("fragment") / side)).applyInArrow(_sum_gathering, "block long, own binary, low binary")
    return summed.groupBy("block").applyInArrow(_sum_block, "doc_id long, n_shingles long, lone long")


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n, digest, shingles (sorted, packed) of each document."""

    def run(batches):
        import xxhash

        shingler = Shingler(words)
        for whole in batches:
            for b in slices(whole, "text", TEXT):
                h, d = shingler.block(byte_column(b, "text"))
                order = np.lexsort((h, d))
                h, d = h[order], d[order]
                if len(h):
                    fresh = np.append(True, (h[1:] != h[:-1]) | (d[1:] != d[:-1]))
                    h, d = h[fresh], d[fresh]
                ends = np.searchsorted(d, np.arange(b.num_rows + 1))
                packed = [h[x:y].astype("<u8").tobytes() for x, y in zip(ends, ends[1:])]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.diff(ends), pa.int64()), pa.array([xxhash.xxh3_128_digest(x) for x in packed], pa.binary()), pa.array(packed, pa.binary())], ["doc_id", "n", "digest", "shingles"])

    return docs.mapInArrow(releasing(run), "doc_id long, n long, digest binary, shingles binary")


def _exploded(sets: DataFrame) -> DataFrame:
    """node, doc_id, n, shingle of every set."""

    def run(batches):
        for whole in batches:
            for i in range(0, whole.num_rows, 200):
                b = whole.slice(i, 200)
                keys = [np.frombuffer(x, "<i8") for x in b.column("shingles").to_pylist()]
                size = [len(x) for x in keys]
                cols = [np.repeat(b.column(c).to_numpy(), size) for c in ("node", "doc_id", "n")]
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols), pa.array(np.concatenate(keys))], ["node", "doc_id", "n", "shingle"])

    return sets.mapInArrow(releasing(run), "node long, doc_id long, n long, shingle long")


def _prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """shingle, node, doc_id, n, held, pos: of n shingles, rarest first, the n - ceil(n * percent / 100) + 1 of which similar sets share one.

    Shingles of one set alone match nothing and are only counted: ``held`` are the others, and ``pos`` is a place among
    them. Sets that share too few have no partner.
    """
    rows = _exploded(sets)
    common = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").withColumn("often", F.col("k"))
    total = sets.agg(F.sum("n")).first()[0] or 0
    ranked = join_hot(rows, common, "shingle", "k", total).selectExpr("shingle", "node", "doc_id", "n", "count(*) over (partition by node) as held", "row_number() over (partition by node order by often, shingle) - 1 as pos")
    return ranked.filter(f"100 * held >= {percent} * n and pos <= held - ceil(n * {percent} / 100)")


def _hub_pairs(prefixes: DataFrame, percent: int, total: int) -> DataFrame:
    """Pairs of each document with the hub of each of its prefix shingles; as many as prefix rows at most."""
    hub = F.min(F.struct((F.col("n") - F.col("held")).alias("lone"), "doc_id", "node", "n"))
    hubs = prefixes.groupBy("shingle").agg(hub.alias("hub"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    met = join_hot(prefixes, hubs, "shingle", "k", total).selectExpr("node as a", "doc_id as da", "n as na", "hub.node as b", "hub.doc_id as db", "hub.n as nb")
    return met.filter(f"a <> b and 100 * least(na, nb) >= {percent} * greatest(na, nb)").distinct()


def _cross_pairs(placed: DataFrame, percent: int, total: int) -> DataFrame:
    """Pairs of documents of different components that share a prefix shingle and pass the filters.

    ``placed`` are the prefixes with their component. Where the two meet at their first common shingle, their overlap is
    at most one more than the shorter rest behind it; similar sets meet there, so no other place can lose them.
    """
    each = placed.groupBy("shingle", "component").agg(F.count(F.lit(1)).alias("k"))
    largest = F.max(F.struct("k", "component"))
    shingles = each.groupBy("shingle").agg(F.sum("k").alias("k"), largest.alias("top"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    shingles = shingles.selectExpr("shingle", "k", "top.component as top", f"cast(ceil(top.k / {BLOCK}) as int) as across", f"cast(ceil((k - top.k) / {BLOCK}) as int) as down")
    rows = join_hot(placed, shingles, "shingle", "k", total)
    block = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    upto = lambda a, b: F.explode(F.sequence(a, b))
    zero, names = F.lit(0), ["shingle", "node", "doc_id", "n", "held", "pos", "component"]
    top = rows.filter("component = top").select(*names, block("across").alias("i"), upto(zero, F.col("down") - 1).alias("j"))
    rest = rows.filter("component <> top").withColumn("own", block("down"))
    beside = rest.select(*names, F.col("own").alias("j"), upto(zero, F.col("across") - 1).alias("i"))
    left = rest.select(*names, F.col("own").alias("i"), upto(F.col("own"), F.col("down") - 1).alias("j"))
    right = rest.select(*names, F.col("own").alias("j"), upto(zero, F.col("own")).alias("i"))

    def meet(x: DataFrame, y: DataFrame, once: str) -> DataFrame:
        y = y.select("shingle", "i", "j", *[F.col(c).alias(f"{c}_") for c in names[1:]])
        near = f"{once} and component <> component_ and 100 * least(n, n_) >= {percent} * greatest(n, n_) and {100 + percent} * least(held - pos, held_ - pos_) >= {percent} * (n + n_)"
        return x.join(y.hint("merge"), ["shingle", "i", "j"]).filter(near).selectExpr("struct(node, doc_id, n) as x", "struct(node_ as node, doc_id_ as doc_id, n_ as n) as y")

    met = meet(top, beside, "true").unionByName(meet(left, right, "(i < j or node < node_)"))
    ordered = met.selectExpr("greatest(x, y) as x", "least(x, y) as y")
    return ordered.selectExpr("x.node as a", "x.doc_id as da", "x.n as na", "y.node as b", "y.doc_id as db", "y.n as nb").distinct()


def _segments(sets: DataFrame) -> DataFrame:
    """node, fragment, part: each set's shingles in each of the ``CUTS`` fragments of the order, packed."""

    def run(batches):
        bounds = np.array([(f << 64) // CUTS for f in range(CUTS)], np.uint64)
        for whole in batches:
            for i in range(0, whole.num_rows, 200):
                b = whole.slice(i, 200)
                out = {"node": [], "fragment": [], "part": []}
                for node, x in zip(b.column("node").to_pylist(), b.column("shingles").to_pylist()):
                    cuts = np.append(np.searchsorted(np.frombuffer(x, "<u8"), bounds), len(x) // 8).tolist()
                    for f, (p, q) in enumerate(zip(cuts, cuts[1:])):
                        if p < q:
                            out["node"].append(node)
                            out["fragment"].append(f)
                            out["part"].append(x[8 * p : 8 * q])
                yield pa.RecordBatch.from_arrays([pa.array(out["node"], pa.int64()), pa.array(out["fragment"], pa.int32()), pa.array(out["part"], pa.binary())], list(out))

    return sets.select("node", "shingles").mapInArrow(releasing(run), "node long, fragment int, part binary")


#: A pair: two sets, the doc_ids of their representatives and their sizes.
PAIR = ["a", "da", "na", "b", "db", "nb"]


def _partial(batches):
    """The overlap of each pair in a fragment."""
    for whole in batches:
        for b in slices(whole, "part", 4 << 20):
            got = []
            for x, y in zip(b.column("part").to_pylist(), b.column("other").to_pylist()):
                both = np.concatenate([np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")])
                both.sort(kind="stable")
                got.append(int((both[1:] == both[:-1]).sum()))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in PAIR], pa.array(got, pa.int64())], [*PAIR, "overlap"])


def _links(pairs: DataFrame, segments: DataFrame, percent: int) -> DataFrame:
    """The pairs that are linked: partial overlaps in each fragment, summed per pair."""
    total = pairs.count()
    by = lambda c: segments.withColumnRenamed("node", c).join(pairs.groupBy(c).agg(F.count(F.lit(1)).alias("k")).hint("merge"), c)
    ones = join_hot(pairs, by("b"), "b", "k", total).withColumnRenamed("part", "other").withColumn("_at", F.struct("a", "fragment"))
    met = join_hot(ones, by("a").select(F.struct("a", "fragment").alias("_at"), "part", "k"), "_at", "k", total * CUTS).select(*PAIR, "part", "other")
    summed = met.mapInArrow(releasing(_partial), ", ".join(f"{c} long" for c in [*PAIR, "overlap"])).groupBy(*PAIR).agg(F.sum("overlap").alias("overlap"))
    return summed.filter(f"100 * overlap >= {percent} * (na + nb - overlap)").select(*PAIR)


def join_links(sets: DataFrame, percent: int, folders: list[str]) -> DataFrame:
    """a, b: links among distinct sets (node, doc_id, n, shingles) by doc_id, enough to connect all that are linked."""
    prefixes = written(_prefixes(sets, percent), "prefixes", folders)
    total = prefixes.count()
    pairs = written(_hub_pairs(prefixes, percent, total), "hub-pairs", folders)
    segments = written(_segments(sets.join(prefixes.select("node").distinct().hint("merge"), "node", "left_semi")), "segments", folders)
    first = written(_links(pairs, segments, percent), "hub-links", folders)
    placed = prefixes.join(components(first.select("a", "b")).hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    more = written(_cross_pairs(written(placed, "placed", folders), percent, total), "cross-pairs", folders)
    return _links(more, segments, percent).unionByName(first).select(F.col("da").alias("a"), F.col("db").alias("b"))


def join_documents(docs: DataFrame, words: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id of every document; links are Jaccard similarities of at least ``percent`` / 100."""
    docs, folders = _prepare(docs), []
    counted = written(count_lone(docs, words, percent), "lone")
    alive = counted.filter(f"doc_id is not null and n_shingles > 0 and 100 * lone <= {100 - percent} * n_shingles").select("doc_id").distinct()
    sets = written(_sets(docs.join(alive.hint("merge"), "doc_id", "left_semi"), words), "sets", folders)
    known = sets.select("doc_id", "digest", "n").filter("n > 0")
    classes = written(known.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("k")), "classes", folders)
    reps = sets.join(classes.select(F.col("rep").alias("doc_id"), "digest").hint("merge"), ["doc_id", "digest"], "left_semi").dropDuplicates(["doc_id", "digest"]).select(F.monotonically_increasing_id().alias("node"), "doc_id", "n", "shingles")
    links = join_links(written(reps, "representatives", folders), percent, folders)
    members = join_hot(known, classes, "digest", "k", known.count()).filter("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    found = components(links.unionByName(members)).withColumnRenamed("node", "doc_id")
    discard(docs.sparkSession, folders)
    return counted.join(found, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def keep_first_of_each(docs: DataFrame, words: int = 4, percent: int = 85) -> DataFrame:
    """The documents of which ``doc_id`` is its component's smallest, with all their columns.

    Rows that repeat both doc_id and text are one; rows without a doc_id stay. Texts are moved once, and compared only where a doc_id repeats.
    """
    joined = join_documents(docs, words, percent).filter("doc_id is not null")
    marks = joined.groupBy("doc_id").agg(F.max(F.col("doc_id") != F.col("component_id")).alias("gone"), (F.count(F.lit(1)) > 1).alias("again")).filter("gone or again")
    marks = written(marks, "marks")
    single = docs.join(marks.select("doc_id").hint("merge"), "doc_id", "left_anti")
    again = marks.filter("again and not gone").select("doc_id")
    twice = docs.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return single.unionByName(twice)
