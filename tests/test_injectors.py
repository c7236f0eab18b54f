"""Injectors apply where they can, by seed, and their recipes can be replayed."""

import pytest
from pyspark.sql import functions as F

from assaylake.operators import injectors

TEXTS = {1: "a\nb 12\nc\nd 7", 2: "one line, 42 and 43", 3: "nothing to see", 4: "", 5: None, 6: "\n\n\n\n"}


def table(spark, texts=TEXTS):
    return spark.createDataFrame(list(texts.items()), "k long, text string").withColumn("other", F.lit(1))


def test_one_defect_each_and_its_recipe(spark):
    df = table(spark)
    for seed in ("s", "t", "u", "v"):
        made = injectors.inject(df, "k", "text", ["drop_line", "change_value", "add_mark"], seed)
        assert set(made.columns) == {"k", "text", "other", "recipe"}
        got = {r["k"]: r for r in made.collect()}
        for k, text in TEXTS.items():
            x = got[k]["recipe"]
            if text is None:
                assert x is None and got[k]["text"] is None
                continue
            assert text[x["start"] : x["start"] + len(x["pre_value"])] == x["pre_value"]
            assert got[k]["text"] == text[: x["start"]] + x["post_value"] + text[x["start"] + len(x["pre_value"]) :] != text
            assert x["defect_type"] in {1: ("drop_line", "change_value", "add_mark"), 2: ("change_value", "add_mark"), 6: ("drop_line", "add_mark")}.get(k, ("add_mark",))
        again = {r["k"]: r["text"] for r in injectors.replayed(df, made, "k", "text").collect()}
        assert again == {k: r["text"] for k, r in got.items()}
        assert sorted(map(tuple, injectors.inject(df, "k", "text", ["drop_line", "change_value", "add_mark"], seed).collect()), key=str) == sorted(map(tuple, made.collect()), key=str)


def test_none_applies_and_recipes_of_other_texts(spark):
    made = injectors.inject(table(spark), "k", "text", ["drop_line"])
    got = {r["k"]: (r["text"], r["recipe"]) for r in made.collect()}
    assert got[2] == (TEXTS[2], None) and got[1][1]["defect_type"] == "drop_line"
    with pytest.raises(Exception, match="another text"):
        injectors.replayed(table(spark, {1: "zzz\nyyy\nxxx\nwww"}), made, "k", "text").collect()


def test_injectors_of_ones_own(spark):
    injectors.register(injectors.Injector("shout", "tone", lambda text, seed: F.when(text.rlike("[a-z]"), F.struct(F.lit(0).cast("long").alias("start"), text.alias("pre_value"))), lambda pre, seed: F.upper(pre)))
    got = {r["k"]: r["text"] for r in injectors.inject(table(spark), "k", "text", ["shout"]).collect()}
    assert got[3] == "NOTHING TO SEE" and got[4] == "" and "shout" in injectors.known()
