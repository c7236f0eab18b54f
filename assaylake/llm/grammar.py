"""Token-ID shards compressed by Re-Pair grammars.

Documents are range-partitioned by doc_id and each block of a partition becomes a shard. In a shard, frequent pairs of
neighbouring ids are replaced by new symbols again and again, a set of pairs in each round, until none is frequent; no pair spans two documents.
The file holds the rules (left, right), the number of ids that each symbol expands to, the symbols that are left, and
each document's place among them, so any range of ids is decoded from the symbols that it touches alone.

A shard is a row of a Parquet table in the shared folder, so writing is committed as Spark commits files and shards are read in
parallel. The start of a document is its place in its shard plus the ids of all shards before it: one number for each shard.

Defined cases: null or empty text is the end id alone; null doc_ids come first; equal doc_ids are ordered by a hash of
their text;
an empty table gives an empty file; extra columns are dropped; texts of any length are kept whole.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaylake.llm.common import partitions, releasing, shared_folder, slices, text_column, written

END = 0
RARE = 16
_SHARD = "shard long, n_ids long, doc_ids binary, known binary, counts binary, places binary, first int, rules binary, lengths binary, low binary, high binary"


def _frequent(code: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted pairs that stand at least ``least`` times in ``code``, and where they may stand: hashed counts first, then exact ones of what is left."""
    bucket = ((code.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int32)
    may = np.flatnonzero((np.bincount(bucket, minlength=1 << 20) >= least)[bucket])
    few = np.sort(code[may])
    if not len(few):
        return few, may
    lead = np.flatnonzero(np.append(True, few[1:] != few[:-1]))
    return few[lead[np.diff(np.append(lead, len(few))) >= least]], may


def compress(ids: np.ndarray, last: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rules (left, right), the symbols left, and a mark at the last symbol of each document. New symbols start at ``first``.

    Each round replaces all frequent pairs, from left to right. What stood at a frequent pair and was not replaced has
    lost one of its sides, so in the next round only pairs beside new symbols can be frequent, and only these are counted;
    rounds go on until there are none. A pair is frequent from ``RARE`` occurrences, in long shards from a 16384th part.
    """
    n = len(ids)
    seq, mark, rules, base = ids.astype(np.int64), last.copy(), [], first
    after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)  # the symbols beside each that is left
    gone = np.zeros(n, bool)
    at = np.flatnonzero(~mark[:-1]) if n > 1 else np.zeros(0, np.int64)  # where pairs may begin
    least = max(RARE, n >> 14)
    code = (seq[:-1] << 32 | seq[1:])[~mark[:-1]] if n > 1 else at
    while len(at):
        pairs, may = _frequent(code, least)
        if not len(pairs):
            break
        at, code = at[may], code[may]
        rule = np.minimum(np.searchsorted(pairs, code), len(pairs) - 1)
        right = pairs[rule] == code
        hit, rule = at[right], rule[right]
        run = np.append(True, after[hit[:-1]] != hit[1:])  # of hits that follow each other every second one is taken
        place = np.arange(len(hit))
        even = (place - np.maximum.accumulate(np.where(run, place, 0))) % 2 == 0
        hit, rule = hit[even], rule[even]
        rules.append(np.stack([pairs >> 32, pairs & 0xFFFFFFFF], axis=1))
        taken = after[hit]
        seq[hit] = base + rule
        base += len(pairs)
        mark[hit] = mark[taken]
        gone[taken] = True
        after[hit] = after[taken]
        inner = hit[after[hit] < n]
        before[after[inner]] = inner
        back = before[hit]
        at = np.concatenate([back[back >= 0], inner])
        at.sort()
        at = at[np.append(True, at[1:] != at[:-1])] if len(at) else at
        at = at[~mark[at]]
        code = seq[at] << 32 | seq[after[at]]
    kept = ~gone
    return np.concatenate(rules) if rules else np.zeros((0, 2), np.int64), seq[kept], mark[kept]


def expansion_lengths(rules: np.ndarray, first: int) -> np.ndarray:
    """Of each rule's symbol; rules refer to ids and to earlier rules."""
    out = np.ones(len(rules), np.int64)
    todo = np.arange(len(rules))
    done = np.zeros(len(rules), bool)
    while len(todo):
        side = rules[todo] - first
        ready = ((side < 0) | done[np.maximum(side, 0)]).all(1)
        now = todo[ready]
        side = rules[now] - first
        out[now] = np.where(side < 0, 1, out[np.maximum(side, 0)]).sum(1)
        done[now] = True
        todo = todo[~ready]
    return out


class Shard:
    """Decodes a shard's row."""

    def __init__(self, row: dict):
        self.first = row["first"]
        self.rules = np.frombuffer(row["rules"], "<u4").reshape(-1, 2).astype(np.int64)
        self.lengths = np.frombuffer(row["lengths"], "<u4").astype(np.int64)
        low, high = np.frombuffer(row["low"], "<u2"), np.frombuffer(row["high"], "u1")
        self.symbols = low.astype(np.int64) | high.astype(np.int64) << 16
        self.counts = np.frombuffer(row["counts"], "<i8")
        self.places = np.frombuffer(row["places"], "<i8")

    def size(self, symbols: np.ndarray) -> np.ndarray:
        return np.where(symbols < self.first, 1, self.lengths[np.maximum(symbols - self.first, 0)]) if len(self.rules) else np.ones(len(symbols), np.int64)

    def spelled(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of every symbol one after the other, each symbol's start there, and its number of ids."""
        size = np.append(np.ones(self.first, np.int64), self.lengths)
        start = np.cumsum(size) - size
        flat = np.arange(int(size.sum()))
        done = 0
        while done < len(self.rules):  # rules that refer to ids and to what is spelled already
            stop = done + int((self.rules[done:].max(1) >= self.first + done).argmax()) if (self.rules[done:] >= self.first + done).any() else len(self.rules)
            for side in (0, 1):
                part = self.rules[done:stop, side]
                n = size[part]
                to = start[self.first + done : self.first + stop] + (size[self.rules[done:stop, 0]] if side else 0)
                at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                flat[np.repeat(to, n) + at] = flat[np.repeat(start[part], n) + at]
            done = stop
        return flat.astype("<u4"), start, size

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        if not hasattr(self, "spelling"):
            self.spelling = self.spelled()
        flat, start, size = self.spelling
        n = size[symbols]
        ends = np.cumsum(n)
        return flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start[symbols] - (ends - n), n)]

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of the shard, from the symbols that overlap them."""
        if not hasattr(self, "ends"):
            self.ends = np.cumsum(self.size(self.symbols))
        i, j = np.searchsorted(self.ends, start, "right"), np.searchsorted(self.ends, stop, "left") + 1
        skip = start - (self.ends[i - 1] if i else 0)
        return self.expand(self.symbols[i:j])[skip : skip + stop - start]

    def document(self, i: int) -> np.ndarray:
        return self.expand(self.symbols[self.places[i] : self.places[i + 1]])


def write_shards(docs: DataFrame, folder: str, path: str | None = None, block: int = 12 << 20) -> None:
    """Encodes the documents and writes their shards, shard numbers ascending with doc_id."""

    def run(batches):
        from assaylake.llm.vocab import byte_level

        table, part, seq = byte_level(path), TaskContext.get().partitionId(), 0
        first = table.encode.tokenizer.get_vocab_size()
        for whole in batches:
            for b in slices(whole, "text", block):
                flat, ends = table.block(text_column(b, "text"))
                flat = np.insert(flat, ends[1:], END)
                counts = np.diff(ends) + 1
                last = np.zeros(len(flat), bool)
                last[np.cumsum(counts) - 1] = True
                rules, symbols, mark = compress(flat, last, first)
                row = {
                    "shard": part << 32 | seq,
                    "n_ids": len(flat),
                    "doc_ids": b.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes(),
                    "known": np.array(b.column("doc_id").is_valid(), np.uint8).tobytes(),
                    "counts": counts.astype("<i8").tobytes(),
                    "places": np.append(0, np.flatnonzero(mark) + 1).astype("<i8").tobytes(),
                    "first": first,
                    "rules": rules.astype("<u4").tobytes(),
                    "lengths": expansion_lengths(rules, first).astype("<u4").tobytes(),
                    "low": (symbols & 0xFFFF).astype("<u2").tobytes(),
                    "high": (symbols >> 16).astype("u1").tobytes(),
                }
                seq += 1
                yield pa.RecordBatch.from_pylist([row], schema=schema)

    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    schema = pa.schema([(n, kinds[t]) for n, t in (x.split() for x in _SHARD.split(", "))])
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # the hash splits rows of one doc_id, or of none, over partitions; it is part of the order
    keyed = rows.withColumn("tie", F.xxhash64("text"))
    ordered = keyed.repartitionByRange(partitions(spark), "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").drop("tie")
    ordered.mapInArrow(releasing(run), _SHARD).write.option("compression", "zstd").parquet(folder)


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """The shards with the number of ids of all shards before each: those of the partitions before, of which there are as
    many as shuffle partitions, and those before in its own."""
    shards = spark.read.schema(_SHARD).parquet(folder)
    sizes = shards.select("shard", "n_ids", F.shiftright("shard", 32).alias("part"))
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.expr("coalesce(sum(n) over (order by part rows between unbounded preceding and 1 preceding), 0)").alias("before"))
    within = F.expr("coalesce(sum(n_ids) over (partition by part order by shard rows between unbounded preceding and 1 preceding), 0)")
    bases = written(sizes.withColumn("within", within).join(parts, "part").select("shard", (F.col("within") + F.col("before")).alias("base")), "bases")
    return shards.join(bases, "shard")


def read_ids(spark: SparkSession, folder: str, keep_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document from the files; with ``keep_ids`` its ids too."""

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                shard = Shard(row)
                ends = np.cumsum(shard.counts)
                known = np.frombuffer(row["known"], "u1") == 0
                for i in range(0, len(ends), 4096):  # a bounded part of the shard at a time
                    part = slice(i, i + 4096)
                    ids = shard.expand(shard.symbols[shard.places[i] : shard.places[min(i + 4096, len(ends))]]).astype("<u4")
                    stop = ends[part] - (ends[i - 1] if i else 0)
                    each = [ids[x:y] for x, y in zip(np.append(0, stop), stop)]
                    out = [
                        pa.array(np.frombuffer(row["doc_ids"], "<i8")[part], pa.int64(), mask=known[part]),
                        pa.array(row["base"] + ends[part] - shard.counts[part], pa.int64()),
                        pa.array([len(x) for x in each], pa.int64()),
                        pa.array([zlib.crc32(x.tobytes()) for x in each], pa.int64()),
                    ]
                    if keep_ids:
                        out.append(pa.array([x.tolist() for x in each], pa.list_(pa.int64())))
                    yield pa.RecordBatch.from_arrays(out, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(out)])

    return read_shards(spark, folder).mapInArrow(releasing(run), "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * keep_ids)


def shard_round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Writes the documents' ids to the shared folder and returns what is read back from the files."""
    spark = docs.sparkSession
    folder = shared_folder(spark, "shards")
    write_shards(docs, folder, path)
    return read_ids(spark, folder)
