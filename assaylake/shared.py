"""Tables in the folder that driver and executors share, and joins whose keys may be hot."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``, which driver and executors share; below the warehouse where that is unset."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


class Scratch:
    """Intermediate tables, each written once and read again, so that lineage is short and a lost executor costs a task."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.folders = spark, name, []

    def written(self, df: DataFrame) -> DataFrame:
        path = shared_folder(self.spark, self.name)
        df.write.parquet(path)
        self.folders.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def result(self, df: DataFrame) -> DataFrame:
        """``df`` written for good; the tables before it are deleted."""
        path = shared_folder(self.spark, self.name)
        df.write.parquet(path)
        self.discard()
        return self.spark.read.schema(df.schema).parquet(path)

    def discard(self) -> None:
        for path in self.folders:
            place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)
        self.folders.clear()


@contextmanager
def conf(spark: SparkSession, **values: str) -> Iterator[None]:
    """Settings that hold within the block."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Bucketed:
    """A table that grows in buckets by ``key``, as many as shuffle partitions; joins and groups by the key shuffle none of its rows.

    Within the block it has a name in the catalog; its files are in the shared folder and stay.
    """

    def __init__(self, spark: SparkSession, name: str, key: str):
        self.spark, self.key, self.n = spark, key, int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.path, self.table = shared_folder(spark, name), f"{name}_{uuid.uuid4().hex}"

    def __enter__(self) -> Bucketed:
        return self

    def __exit__(self, *_) -> None:
        self.spark.sql(f"drop table if exists {self.table}")  # not its files, as their place is given

    def dealt(self, df: DataFrame) -> DataFrame:
        return df.repartition(self.n, self.key)

    def add(self, df: DataFrame) -> None:
        """Rows that were ``dealt``: so each bucket is a file an addition."""
        self.schema = df.schema
        df.write.bucketBy(self.n, self.key).option("path", self.path).mode("append").format("parquet").saveAsTable(self.table)

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def result(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over the shuffle partitions where it comes in fewer, as a table of one row group does; else as it is."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)


def join_dealt(rows: DataFrame, once: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """``rows`` joined with ``once`` by ``key``, where ``count`` of ``once`` (dropped) is the key's number of ``rows``.

    Rows of keys of over a thousandth of the ``total`` are dealt over shares of about that size, and ``once`` is copied to
    each. There are fewer than 1000 such keys, so their list is broadcast.
    """
    shares = once.withColumn("_shares", F.greatest(F.ceil(F.col(count) * 1000 / F.lit(max(total, 1))), F.lit(1)).cast("int"))
    hot = shares.filter("_shares > 1").select(key, "_shares").distinct()
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn("_share", F.pmod(F.xxhash64(*rows.columns), F.coalesce("_shares", F.lit(1))).cast("int"))
    places = shares.withColumn("_share", F.explode(F.sequence(F.lit(0), F.col("_shares") - 1)))
    return dealt.drop("_shares").join(places.drop("_shares", count), [key, "_share"]).drop("_share")
