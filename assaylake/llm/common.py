"""What the operators of this subpackage share: reading, shared folders, Arrow blocks, bounded caches."""

from __future__ import annotations

import ctypes
import functools
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ship(spark: SparkSession) -> None:
    """Sends this package to the session's workers, once, so that they need no path to it."""
    import shutil
    import tempfile
    from pathlib import Path

    context = spark.sparkContext
    if getattr(context, "_assaylake_sent", False):
        return
    package = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp()
    shutil.copytree(package, f"{folder}/root/{package.name}", ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(f"{folder}/{package.name}", "zip", f"{folder}/root"))
    context._assaylake_sent = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, which driver and executors share.

    A session without that setting (local tests) gets one below the warehouse.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, folders: list[str] | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage and survives lost executors. ``folders`` gets its path."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    if folders is not None:
        folders.append(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, folders: list[str]) -> None:
    """Deletes intermediate tables that nothing reads any more."""
    for path in folders:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    folders.clear()


def free_name(names: list[str], wish: str) -> str:
    """The wished column name, with underscores before it until none of the names is like it, case aside."""
    taken = {x.lower() for x in names}
    while wish.lower() in taken:
        wish = "_" + wish
    return wish


def join_hot(rows: DataFrame, once: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """``rows`` joined with ``once``, which has a few rows for each key, each with the key's number of ``rows`` in ``count`` (dropped).

    The rows of keys of over a thousandth of the ``total`` rows are dealt over shares of about that size. Such keys are
    fewer than 1000, so their shares are broadcast; a total below the true one raises that bound as much.
    """
    shares = once.withColumn("_shares", F.ceil(F.col(count) * 1000 / F.lit(max(total, 1))).cast("int"))
    hot = shares.filter("_shares > 1").select(key, "_shares").distinct()
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn("_share", F.pmod(F.xxhash64(*rows.columns), F.coalesce("_shares", F.lit(1))).cast("int"))
    places = shares.withColumn("_share", F.explode(F.sequence(F.lit(0), F.col("_shares") - 1)))
    return dealt.drop("_shares").join(places.drop("_shares", count).hint("merge"), [key, "_share"]).drop("_share")


def partitions(spark: SparkSession) -> int:
    """The number of shuffle partitions, which the deployment sizes to its data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def release() -> None:
    """Hands memory that is free back to the system; Arrow's pool and the C library keep it otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library
    if trim:
        trim(0)


def releasing(run: Callable) -> Callable:
    """A function over batches that releases memory at its end, as a worker goes on to other stages."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def byte_column(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """UTF-8 bytes of a string column; null becomes empty."""
    return [b"" if x is None else x for x in batch.column(name).cast(pa.binary()).to_pylist()]


def text_column(batch: pa.RecordBatch, name: str) -> list[str]:
    return ["" if x is None else x for x in batch.column(name).to_pylist()]


def slices(batch: pa.RecordBatch, name: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts a batch where its texts pass ``most`` bytes, so a task's memory does not follow the row count."""
    import pyarrow.compute as pc

    n = batch.num_rows
    if not n:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for i in range(n):
        if total and total + sizes[i] > most:
            yield batch.slice(start, i - start)
            pa.default_memory_pool().release_unused()
            start, total = i, 0
        total += int(sizes[i])
    yield batch.slice(start, n - start)
    pa.default_memory_pool().release_unused()


def map_blocks(df: DataFrame, text: str, block: Callable[[pa.RecordBatch], dict], ddl: str, most: int = 8 << 20, make: Callable | None = None) -> DataFrame:
    """``mapInArrow`` over blocks of bounded size. ``block`` returns column name -> list or array.

    ``make`` builds per-task state once and ``block`` then takes (state, batch).
    """
    schema = _arrow_schema(df.sparkSession, ddl)

    def run(batches):
        state = make() if make else None
        for whole in batches:
            for b in slices(whole, text, most):
                out = block(state, b) if make else block(b)
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, type=f.type) for f, x in ((f, out[f.name]) for f in schema)], schema=schema)

    return df.mapInArrow(releasing(run), ddl)


def _arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


class Bounded(dict):
    """A cache of computed values that empties itself at ``most`` entries."""

    def __init__(self, make: Callable, most: int = 400_000):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value
