"""Injectors of defects: what they change, where they apply, and a recipe for each record from which the change can be made again.

An injector finds a span in a text and says what is to stand there. So a recipe is a span, what stood and what stands
there, and replaying it needs neither the injector nor its seed. Injectors are column expressions and are known by name.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assaylake.functions.hashing import hash32

RECIPE = "struct<defect_type:string,safety_flag:string,mutates:string,start:bigint,pre_value:string,post_value:string,expected:string>"


@dataclass(frozen=True)
class Injector:
    """``find`` gives (start, pre_value) of the span in a text by a seed, null where the injector does not apply; ``change`` gives what replaces it."""

    defect_type: str
    safety_flag: str
    find: Callable[[Column, Column], Column]
    change: Callable[[Column, Column], Column]
    expected: str = "BLOCK"


_KNOWN: dict[str, Injector] = {}


def register(injector: Injector) -> Injector:
    """Makes an injector known by its defect type; a second of the same type replaces the first."""
    _KNOWN[injector.defect_type] = injector
    return injector


def known() -> dict[str, Injector]:
    return dict(_KNOWN)


def _before(parts: Column, n: Column) -> Column:
    """Characters of the first ``n`` parts."""
    return F.aggregate(F.slice(parts, F.lit(1), n), F.lit(0).cast("bigint"), lambda a, x: a + F.length(x))


def _span(start: Column, pre: Column) -> Column:
    return F.struct(start.cast("bigint").alias("start"), pre.alias("pre_value"))


def _line(text: Column, seed: Column) -> Column:
    """One of the lines with its line end, in texts of more than three."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.concat(x, F.lit("\n")))
    k = (seed % F.greatest(F.size(lines) - 1, F.lit(1))).cast("int")  # the last one has no end
    return F.when(F.size(lines) > 3, _span(_before(lines, k), F.get(lines, k)))


def _number(text: Column, seed: Column) -> Column:
    """One of the runs of digits."""
    found, between = F.regexp_extract_all(text, F.lit("[0-9]+"), F.lit(0)), F.split(text, "[0-9]+", -1)
    k = (seed % F.greatest(F.size(found), F.lit(1))).cast("int")
    return F.when(F.size(found) > 0, _span(_before(between, k + 1) + _before(found, k), F.get(found, k)))


register(Injector("drop_line", "omission", _line, lambda pre, seed: F.lit("")))
register(Injector("change_value", "contradiction", _number, lambda pre, seed: F.translate(pre, "0123456789", "1234567890")))
register(Injector("add_mark", "format", lambda text, seed: F.when(text.isNotNull(), _span(F.length(text), F.lit(""))), lambda pre, seed: F.lit(" [sic]"), "WARN"))


def inject(records: DataFrame, key: str, column: str, types: list[str], seed: str = "inject") -> DataFrame:
    """Records with ``recipe`` and the changed column, each by one of the injectors that apply to it, chosen by a hash of its key; null recipes where none does."""
    picked = records.withColumn("_seed", hash32(seed, F.col(key)))
    spans = {name: known()[name].find(F.col(column), F.col("_seed")) for name in types}
    picked = picked.withColumns({f"_span_{i}": s for i, s in enumerate(spans.values())})
    options = F.array_compact(F.array(*[F.when(F.col(f"_span_{i}").isNotNull(), F.lit(i)) for i in range(len(types))]))
    picked = picked.withColumn("_options", options).withColumn("_pick", F.get("_options", (F.col("_seed") % F.greatest(F.size("_options"), F.lit(1))).cast("int")))
    recipe = F.lit(None).cast(RECIPE)
    for i, name in enumerate(types):
        one, span = known()[name], F.col(f"_span_{i}")
        fields = [F.lit(one.defect_type), F.lit(one.safety_flag), F.lit(column), span["start"], span["pre_value"], one.change(span["pre_value"], F.col("_seed")), F.lit(one.expected)]
        recipe = F.when(F.col("_pick") == i, F.struct(*fields).cast(RECIPE)).otherwise(recipe)
    out = picked.withColumn("recipe", recipe)
    return out.select(*[c for c in records.columns if c != column], F.when(F.col("recipe").isNull(), F.col(column)).otherwise(changed(F.col(column), F.col("recipe"))).alias(column), "recipe")


def changed(text: Column, recipe: Column) -> Column:
    """The text after a recipe; an error where what the recipe takes out does not stand there."""
    start, pre = recipe["start"].cast("int"), recipe["pre_value"]
    there = F.substring(text, start + 1, F.length(pre)) == pre
    new = F.concat(F.substring(text, F.lit(1), start), recipe["post_value"], F.substring(text, start + F.length(pre) + 1, F.length(text)))
    return F.when(there, new).otherwise(F.raise_error(F.lit("the recipe is of another text")).cast("string"))


def replayed(clean: DataFrame, recipes: DataFrame, key: str, column: str) -> DataFrame:
    """The clean records changed as their recipes (key, recipe) say; those without a recipe stay."""
    j = clean.join(recipes.select(key, "recipe"), key, "left")
    return j.withColumn(column, F.when(F.col("recipe").isNull(), F.col(column)).otherwise(changed(F.col(column), F.col("recipe")))).drop("recipe")
