"""Hash columns that have the same value in Spark and in the SQL twins."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _parts(values: tuple) -> list[Column]:
    return [v.cast("string") if isinstance(v, Column) else F.lit(str(v)) for v in values]


def hash32(*values: Column | str | int) -> Column:
    """The first 32 bits of SHA-1 over the values joined by ``|``, as a long."""
    return F.conv(F.substring(F.sha1(F.concat_ws("|", *_parts(values))), 1, 8), 16, 10).cast("long")


def uniform(*values: Column | str | int) -> Column:
    """A double in [0, 1) that depends on the values alone."""
    return hash32(*values) / F.lit(4294967296.0)


def seed31(*values: Column | str | int) -> Column:
    """The first 32 bits of SHA-256 modulo 2**31: a seed for a case and role."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *_parts(values)), 256), 1, 8), 16, 10).cast("long") % 2147483648


def split_of(case_id: Column, held_out_percent: int = 30) -> Column:
    """``test`` for the given share of cases by hash, else ``train``."""
    return F.when(hash32("split", case_id) % 100 < held_out_percent, "test").otherwise("train")


def content_id(prefix: str, *values: Column | str, size: int = 12) -> Column:
    """A short id from the content."""
    return F.concat(F.lit(prefix), F.substring(F.sha1(F.concat_ws("|", *_parts(values))), 1, size))
