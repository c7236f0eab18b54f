"""Test-case generation by construction: verdicts of packaged cases, field mutants with their expected verdict, encounter assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assaylake.functions.hashing import content_id, split_of


def package_cases(gold: DataFrame, codes: DataFrame) -> DataFrame:
    """Expected verdicts of each case by its gravest defect: tier 1 reject; tier 2 needs_review or reject; tier 3 approve or needs_review."""
    j = gold.join(codes.select("code", "tier"), "code").groupBy("case_id").agg(F.min("tier").alias("tier"), F.array_join(F.array_sort(F.collect_set("code")), ",").alias("codes"))
    expected = F.when(F.col("tier") == 1, "reject").when(F.col("tier") == 2, "needs_review,reject").otherwise("approve,needs_review")
    return j.select("case_id", content_id("case-", F.col("case_id"), F.col("codes")).alias("packaged_id"), "codes", expected.alias("expected"), split_of(F.col("case_id")).alias("split"))


def field_mutants(records: DataFrame, key: str, specs: DataFrame) -> DataFrame:
    """One mutant of each field of ``specs`` (field, kind, required), for a first look; ``mutation_battery`` has them all."""
    defect = F.when(F.col("kind") == "presence", F.when(F.col("required"), "BLOCK").otherwise("PASS")).otherwise("BLOCK")
    mutated = F.when(F.col("kind") == "presence", F.lit(None)).when(F.col("kind") == "enum", "__not_in_enum__").when(F.col("kind") == "datatype", "not-a-number").otherwise("[]")
    return records.select(key).crossJoin(F.broadcast(specs)).select(key, "field", "kind", mutated.cast("string").alias("mutated"), defect.alias("expected"))


# What a check of each datatype has to refuse and to accept.
DEFECTS = {
    "decimal": [("illegal_first_char", "abc"), ("legal_prefix_then_junk", "12!!34"), ("empty", "")],
    "date": [("illegal_first_char", "not-a-date"), ("legal_prefix_then_junk", "2026!!junk"), ("empty", "")],
    "datetime": [("illegal_first_char", "not-a-date"), ("legal_prefix_then_junk", "2026!!junk"), ("empty", "")],
    "": [("illegal_first_char", "!!bad"), ("empty", "")],
}
VALID = {"decimal": ["0.99", "1000000.00", "5"], "date": ["2025-01-01", "1999-12-31"], "datetime": ["2027-01-15T23:59:59Z", "2026-05-30T09:00:00+05:30"]}


def _op(name: str | Column, value: str | Column | None, expected: str | Column = "BLOCK") -> Column:
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(as_column(name).alias("op"), as_column(value).cast("string").alias("value"), as_column(expected).alias("expected"))


def _by_datatype(table: dict, make) -> Column:
    kinds = [k for k in table if k]
    out = F.when(F.lit(False), F.array(*map(make, table[kinds[0]])))
    for k in kinds:
        out = out.when(F.col("datatype") == k, F.array(*map(make, table[k])))
    return out.otherwise(F.array(*map(make, table[""])) if "" in table else F.slice(F.array(*map(make, table[kinds[0]])), 1, 0))


def mutation_battery(records: DataFrame, key: str, specs: DataFrame) -> DataFrame:
    """Each record against each field of ``specs`` (field, kind, required, datatype, allowed): mutants whose verdict is known by construction.

    Every field is stripped, which blocks where it is required and else passes, and required ones are set to null. Enum
    fields get a value outside the set, an empty one, a near miss, a number and the first value in other case, if that is
    not allowed; datatypes get malformed values, lists an empty list and a scalar.
    """
    first = F.element_at("allowed", 1)
    swapped = F.when(first == F.lower(first), F.upper(first)).otherwise(F.lower(first))
    none = F.slice(F.array(_op("strip", "<absent>")), 1, 0)
    enum = F.concat(
        F.array(_op("not_in_set", "__bogus__"), _op("empty", ""), _op("near_miss", F.concat(first, F.lit("X"))), _op("numeric", "123")),
        F.when(F.array_contains("allowed", swapped), none).otherwise(F.array(_op("case_variant", swapped))),
    )
    own = F.when(F.col("kind") == "enum", enum).when(F.col("kind") == "datatype", _by_datatype(DEFECTS, lambda x: _op(*x))).when(F.col("kind") == "cardinality", F.array(_op("empty_array", "[]"), _op("scalar_not_array", "scalar"))).otherwise(none)
    absent = F.when(F.col("required"), F.array(_op("strip", "<absent>"), _op("null", None))).otherwise(F.array(_op("strip", "<absent>", "PASS")))
    ops = specs.select("field", "kind", F.explode(F.concat(absent, own)).alias("x")).select("field", "kind", "x.*")
    return records.select(key).crossJoin(F.broadcast(ops)).select(key, "field", "kind", "op", "value", "expected")


def valid_variations(records: DataFrame, key: str, specs: DataFrame) -> DataFrame:
    """Other valid values of each field, all expected to pass: the other values of an enum, well-formed ones of a datatype, and absence where it is optional."""
    valid = lambda v: _op(F.concat(F.lit("valid:"), v), v, "PASS")
    none = F.slice(F.array(valid(F.lit("absent"))), 1, 0)
    own = F.when(F.col("kind") == "enum", F.transform(F.slice("allowed", 2, 1 << 30), valid)).when(F.col("kind") == "datatype", _by_datatype(VALID, lambda v: valid(F.lit(v)))).otherwise(none)
    absent = F.when(F.col("required"), none).otherwise(F.array(_op("valid:absent", "<absent>", "PASS")))
    ops = specs.select("field", "kind", F.explode(F.concat(own, absent)).alias("x")).select("field", "kind", "x.*")
    return records.select(key).crossJoin(F.broadcast(ops)).select(key, "field", "kind", "op", "value", "expected")


def mutant_cases(mutants: DataFrame, key: str, pack: str) -> DataFrame:
    """Mutants in the shape of a pack's cases."""
    label = F.concat(F.lit(f"{pack}_"), F.col(key).cast("string"), F.lit("_"), F.col("field"), F.lit(":"), F.col("op"))
    return mutants.select(label.alias("case_id"), F.lit(pack).alias("pack"), F.col("expected").alias("expected_structural_verdict"), F.concat(F.lit("mutation:"), F.col("op")).alias("defect_type"), F.col("field").alias("mutated_field"))


def mutation_score(mutants: DataFrame, verdicts: DataFrame, key: str) -> DataFrame:
    """Killed defects over defects, and clean variations that a validator wrongly blocks."""
    j = mutants.join(verdicts, [key, "field", "kind", "op"])
    defect = F.col("expected") == "BLOCK"
    n = j.groupBy("kind").agg(F.count_if(defect).alias("defects"), F.count_if(defect & (F.col("observed") == "BLOCK")).alias("killed"), F.count_if(~defect & (F.col("observed") == "BLOCK")).alias("false_blocks"))
    return n.withColumn("score", F.when(F.col("defects") > 0, F.round(F.col("killed") / F.col("defects"), 4)))


def encounters(customers: DataFrame, orders: DataFrame, items: DataFrame, parts: DataFrame) -> DataFrame:
    """Assembled record of each order: its customer and its distinct item types, sorted."""
    types = items.join(parts, items["l_partkey"] == parts["p_partkey"]).groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set("p_type")), "|").alias("items"), F.count(F.lit(1)).alias("n_items"))
    o = orders.join(customers, orders["o_custkey"] == customers["c_custkey"])
    return o.join(types, o["o_orderkey"] == types["l_orderkey"], "left").select("o_orderkey", "c_custkey", "c_mktsegment", F.coalesce("items", F.lit("")).alias("items"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"))


def first_with_item(orders: DataFrame, items: DataFrame, parts: DataFrame, item: str) -> DataFrame:
    """Of each customer the earliest order that holds an item of the type, ties to the smaller order."""
    wanted = items.join(parts.filter(F.col("p_type") == item), items["l_partkey"] == parts["p_partkey"], "left_semi")
    held = orders.join(wanted, orders["o_orderkey"] == wanted["l_orderkey"], "left_semi")
    return held.groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("o_orderkey"))


def positive_first(cases: DataFrame, width: int = 4096) -> DataFrame:
    """Every case with its position, from 0, when blocked cases come before the others, each in order of case_id.

    Ranks are taken within ranges of ``width`` ids; only the ranges' counts go through one window.
    """
    keyed = cases.withColumn("_first", F.coalesce("gold_block", F.lit(False))).withColumn("_range", F.floor(F.col("case_id") / width))
    before = Window.orderBy(F.desc("_first"), "_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = keyed.groupBy("_first", "_range").agg(F.count(F.lit(1)).alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    rank = F.row_number().over(Window.partitionBy("_first", "_range").orderBy("case_id")) - 1
    return keyed.withColumn("_rank", rank).join(starts, ["_first", "_range"]).withColumn("position", F.col("_start") + F.col("_rank")).drop("_first", "_range", "_rank", "_start")
