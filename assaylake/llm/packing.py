"""Packing of documents into sequences by minimum bin slack.

A document's full windows are sequences of their own. What remains of each document has one of at most ``capacity`` - 1
lengths, so the driver plans over a histogram: for the largest length left, a bitset subset-sum program over the other
lengths' counts finds the multiset that fills the window closest to capacity, with the counts found by backtracking, and
that pattern is used as often as the counts allow. Where the closest multiset leaves slack, the windows get their last ids from
a line: documents laid end to end, which are cut at the slacks' ends. What is left at last, less than a window and the rest of
the line, is cut into windows and powers of two, which need no padding.

Documents take their places by their rank within their length. Ranks are counted per salt and offset by the salts before,
so a length that a third of all documents have is not one group. The plan is broadcast: its rows are bounded by the
patterns, which the histogram bounds (each uses up a length; 64 lengths at most are in one). A document finds its row by
its length and a binary search for its rank.

Defined cases: null or empty text is the end id alone; rows that repeat a doc_id are packed each; a null doc_id passes
through; an empty table gives no rows; extra columns are dropped; each id lies in exactly one piece.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assaylake.llm.common import partitions, releasing, slices, text_column, written

END = 1
CAPACITY = 2048
#: Sequences of a document's own full windows are numbered from here.
OWN = 1 << 62


def closest(counts: dict[int, int], capacity: int) -> tuple[int, dict[int, int]]:
    """The largest sum up to ``capacity`` of lengths taken at most ``counts`` times, and how often each is taken."""
    mask, reach, steps = (1 << capacity + 1) - 1, 1, []
    for length in sorted((x for x in counts if x <= capacity), reverse=True):
        left, k = min(counts[length], capacity // length), 1
        while left:
            k = min(k, left)
            steps.append((k, length, reach))
            reach |= reach << k * length & mask
            left, k = left - k, 2 * k
        if reach >> capacity & 1:
            break
    best = total = reach.bit_length() - 1
    taken: dict[int, int] = {}
    for k, length, before in reversed(steps):
        if not before >> total & 1:
            taken[length] = taken.get(length, 0) + k
            total -= k * length
    return best, taken


@dataclass
class Line:
    """Documents end to end: their first ids fill the holes (place on the line, size, times, first sequence, offset), the others
    windows of their own after ``before`` sequences."""

    holes: list[tuple[int, int, int, int, int]]
    filled: int
    total: int
    before: int
    capacity: int

    def __post_init__(self) -> None:
        self.starts = [h[0] for h in self.holes]
        rest = self.total - self.filled
        self.full, self.ends = rest // self.capacity, line_cuts(rest, self.capacity)

    def pieces(self, start: int, length: int) -> list[tuple[int, int, int, int]]:
        """Pieces (from, length, sequence, offset) of the ids ``start`` to ``start + length`` of the line."""
        out, at = [], start
        while at < start + length:
            if at < self.filled:
                first, size, _, sequence, offset = self.holes[bisect_right(self.starts, at) - 1]
                k, inside = divmod(at - first, size)
                sequence, offset, stop = sequence + k, offset + inside, at + size - inside
            else:
                own = at - self.filled
                if own < self.full * self.capacity:
                    k, offset = divmod(own, self.capacity)
                    stop = at + self.capacity - offset
                else:
                    i = int(np.searchsorted(self.ends, own, "right"))
                    k, offset = self.full + i, own - (int(self.ends[i - 1]) if i else self.full * self.capacity)
                    stop = self.filled + int(self.ends[i])
                sequence = self.before + k
            stop = min(stop, start + length)
            out.append((at - start, stop - at, sequence, offset))
            at = stop
        return out


def plan_windows(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], list[tuple[int, int, int, int]], Line]:
    """Places (length, first rank, last rank, first sequence, offset), stretches (length, first rank, last rank, place on the line)
    of the documents on the line, and the line.

    A window takes ``capacity`` ids with what the line fills, so as many windows are made as the ids left allow, and there are
    always ids to fill them. The largest length left is next on the line.
    """
    left = {k: v for k, v in histogram.items() if 0 < k < capacity and v > 0}
    used = dict.fromkeys(left, 0)
    places, line, holes, at, filled, sequence = [], [], [], 0, 0, 0

    def lay(length: int, n: int) -> None:
        nonlocal at
        line.append((length, used[length], used[length] + n, at))
        used[length] += n
        left[length] -= n
        at += length * n

    while left:
        top = max(left)
        left[top] -= 1
        best, taken = closest({k: v for k, v in left.items() if v}, capacity - top)
        left[top] += 1
        taken[top] = taken.get(top, 0) + 1
        times, slack = min(left[k] // v for k, v in taken.items()), capacity - top - best
        if slack:
            times = min(times, (sum(k * v for k, v in left.items()) + at - filled) // capacity)
        if not times:  # less than a window is left
            for length in sorted(left, reverse=True):
                lay(length, left[length])
            break
        offset = 0
        for length, n in sorted(taken.items(), reverse=True):
            for _ in range(n):
                places.append((length, used[length], used[length] + times, sequence, offset))
                used[length] += times
                offset += length
            left[length] -= n * times
        if slack:
            holes.append((filled, slack, times, sequence, offset))
            filled += slack * times
            while at < filled:
                donor = max(k for k, v in left.items() if v)
                lay(donor, min(left[donor], -((at - filled) // donor)))
        sequence += times
        left = {k: v for k, v in left.items() if v}
    return places, line, Line(holes, filled, at, sequence, capacity)


def line_cuts(total: int, capacity: int) -> np.ndarray:
    """Where the sequences of a line of ``total`` ids end after its last full window: the powers of two of what is left."""
    rest, at, out = total % capacity, total - total % capacity, []
    for k in range(capacity.bit_length(), -1, -1):
        if rest >> k & 1:
            at += 1 << k
            out.append(at)
    return np.array(out, np.int64)


class Lookup:
    """Of a length and a rank within it the pieces (from, length, sequence, offset) by the plan."""

    def __init__(self, places: list, stretches: list, line: Line):
        rows = sorted([(n, low, first, offset, False) for n, low, _, first, offset in places] + [(n, low, at, 0, True) for n, low, _, at in stretches])
        lengths = np.array([r[0] for r in rows], np.int64)
        cuts = np.flatnonzero(np.append(True, lengths[1:] != lengths[:-1])).tolist() if rows else []
        self.of = {rows[a][0]: tuple(np.array([r[i] for r in rows[a:b]]) for i in (1, 2, 3, 4)) for a, b in zip(cuts, [*cuts[1:], len(rows)])}
        self.line = line

    def pieces(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        low, first, offset, on_line = self.of[length]
        i = int(np.searchsorted(low, rank, "right")) - 1
        if on_line[i]:
            return self.line.pieces(int(first[i]) + (rank - int(low[i])) * length, length)
        return [(0, length, int(first[i]) + rank - int(low[i]), int(offset[i]))]


_TOKENS = "row long, doc_id long, doc_tokens long, rest int, own_first long, own_crc array<long>, rest_ids binary, salt int"


def tokenize(docs: DataFrame, path: str | None, capacity: int, salts: int, block: int = 8 << 20, pieces: int = 350_000) -> DataFrame:
    """row (unique), doc_id, doc_tokens, rest (length of what remains), own_first and own_crc (full windows), rest_ids, salt."""

    def run(batches):
        from assaylake.llm.vocab import word_level

        table, part, seq, own = word_level(path, pieces), TaskContext.get().partitionId(), 0, 0
        small = table.encode.tokenizer.get_vocab_size() <= 1 << 16
        for whole in batches:
            for b in slices(whole, "text", block):
                flat, ends = table.block(text_column(b, "text"))
                flat = np.insert(flat, ends[1:], END).astype("<u4")
                stops = ends[1:] + np.arange(1, b.num_rows + 1)
                rows = {k: [] for k in ("row", "doc_tokens", "rest", "own_first", "own_crc", "rest_ids", "salt")}
                for i, (x, y) in enumerate(zip(np.append(0, stops), stops)):
                    n, full = int(y - x), int(y - x) // capacity
                    cut = x + full * capacity
                    rows["row"].append(part << 36 | seq)
                    rows["doc_tokens"].append(n)
                    rows["rest"].append(n - full * capacity)
                    rows["own_first"].append(OWN + (part << 36) + own)
                    rows["own_crc"].append([zlib.crc32(flat[x + k * capacity : x + (k + 1) * capacity].tobytes()) for k in range(full)])
                    rows["rest_ids"].append(flat[cut:y].astype("<u2" if small else "<u4").tobytes())
                    rows["salt"].append((part * 31 + seq) % salts)
                    seq += 1
                    own += full
                yield pa.RecordBatch.from_arrays([pa.array(rows["row"], pa.int64()), b.column("doc_id"), pa.array(rows["doc_tokens"], pa.int64()), pa.array(rows["rest"], pa.int32()), pa.array(rows["own_first"], pa.int64()), pa.array(rows["own_crc"], pa.list_(pa.int64())), pa.array(rows["rest_ids"], pa.binary()), pa.array(rows["salt"], pa.int32())], [x.split()[0] for x in _TOKENS.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(releasing(run), _TOKENS)


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, block: int = 8 << 20, pieces: int = 350_000) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece.

    ``block`` bytes of text and ``pieces`` known pieces of it bound a task's memory; fewer cost time, never results."""
    spark = docs.sparkSession
    salts = partitions(spark)
    tokens = written(tokenize(docs, path, capacity, salts, block, pieces), "tokens")
    rest = tokens.filter("rest > 0")
    histogram = {r["rest"]: r["n"] for r in rest.groupBy("rest").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most capacity - 1 rows
    lookup = spark.sparkContext.broadcast(Lookup(*plan_windows(histogram, capacity)))

    by_salt = rest.groupBy("rest", "salt").agg(F.count(F.lit(1)).alias("n"))
    by_salt = by_salt.select("rest", "salt", F.expr("sum(n) over (partition by rest order by salt) - n").alias("earlier"))
    ranked = rest.select("row", "doc_id", "doc_tokens", "rest", "rest_ids", "salt", F.expr("row_number() over (partition by rest, salt order by row) - 1").alias("at"))
    ranked = ranked.join(by_salt, ["rest", "salt"]).withColumn("rank", F.col("at") + F.col("earlier"))
    ranked = ranked.select("doc_id", "doc_tokens", "rest", "rest_ids", "rank")
    out = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

    def placed(batches):
        find = lookup.value.pieces
        for b in batches:
            got = []
            for r in b.to_pylist():
                wide = len(r["rest_ids"]) == 4 * r["rest"]
                ids = np.frombuffer(r["rest_ids"], "<u4" if wide else "<u2").astype("<u4")
                begin = r["doc_tokens"] - r["rest"]
                for x, size, sequence, o in find(r["rest"], r["rank"]):
                    got.append((r["doc_id"], begin + x, size, zlib.crc32(ids[x : x + size].tobytes()), r["doc_tokens"], sequence, o))
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*got)], [x.split()[0] for x in out.split(", ")])

    full = tokens.filter("size(own_crc) > 0").select("doc_id", "doc_tokens", "own_first", F.posexplode("own_crc").alias("k", "ids_crc32"))
    own = full.select("doc_id", (F.col("k") * F.lit(capacity).cast("long")).alias("start"), F.lit(capacity).cast("long").alias("length"), "ids_crc32", "doc_tokens", (F.col("own_first") + F.col("k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return own.unionByName(ranked.mapInArrow(releasing(placed), out))
