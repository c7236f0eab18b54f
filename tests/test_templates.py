"""Mapping templates: values, defaults, filters, lists, and what does not compile."""

import pytest

from assaylake.operators import templates
from assaylake.operators.templates import Row, TemplateError

SHAPE = "a struct<b:string,n:bigint>, ok boolean, xs array<struct<k:string,v:double>>"
ROWS = [Row("b", "$.a.b"), Row("n", "$.a.n", "int", "7"), Row("first", "$.xs[0].k"), Row("items", "$.xs", "list", filter="$.v >= 2"), Row("items[].k", "$.k", "string", "it's"), Row("items[].v", "$.v", "double")]


def test_bodies_are_mapped(spark):
    bodies = ['{"a": {"b": "x", "n": 3}, "xs": [{"k": "p", "v": 1}, {"k": "q", "v": 2}, {"v": 5.5}]}', '{"a": {"n": "word"}, "xs": []}', "{}", "no json", None]
    df = spark.createDataFrame(list(enumerate(bodies)), "id long, body string")
    got = {r["id"]: r for r in templates.apply(df, "body", ROWS, SHAPE, ("id",)).collect()}
    assert (got[0]["b"], got[0]["n"], got[0]["first"]) == ("x", 3, "p")
    assert [tuple(x) for x in got[0]["items"]] == [("q", 2.0), ("it's", 5.5)]
    assert (got[1]["b"], got[1]["n"], got[1]["items"]) == (None, 7, []) and (got[2]["n"], got[2]["items"]) == (7, [])
    assert [got[i]["parsed"] for i in range(5)] == [True, True, True, False, False]
    observed = {r["id"]: r["observed"] for r in templates.verdicts(templates.apply(df, "body", ROWS, SHAPE, ("id",)), ["b"]).collect()}
    assert observed == {0: "PASS", 1: "BLOCK", 2: "BLOCK", 3: None, 4: None}


@pytest.mark.parametrize(
    "rows, why",
    [
        ([Row("x", "$.a.c")], "not in the input"),
        ([Row("x", "a.b")], "no path"),
        ([Row("x", "$.a.b", "money")], "no type"),
        ([Row("x", "$.ok", "double")], "cannot be read"),
        ([Row("x", "$.a")], "cannot be read"),
        ([Row("x", "$.a", "list"), Row("x[].y", "$.b")], "is no list"),
        ([Row("x", "$.xs", "list")], "without fields"),
        ([Row("x", "$.xs", "list", filter="drop table"), Row("x[].y", "$.k")], "no filter"),
        ([Row("x", "$.xs", "list", filter="$.w = 1"), Row("x[].y", "$.k")], "not in the input"),
        ([Row("x[].y", "$.k")], "no list of that name"),
        ([Row("x", "$.a.b"), Row("x", "$.a.n")], "twice"),
        ([Row("x y", "$.a.b")], "no name"),
        ([Row("x", "$.a.b", filter="$.n = 1")], "only lists"),
    ],
)
def test_errors_are_found_when_compiled(rows, why):
    with pytest.raises(TemplateError, match=why):
        templates.compiled(rows, SHAPE)


def test_templates_from_a_table(spark):
    table = spark.createDataFrame([("t", 1, "b", "$.b", None, None, None), ("t", 0, "a", "$.a", "int", "1", None)], "template string, place int, target string, path string, cast string, default string, filter string")
    assert templates.from_table(table) == {"t": [Row("a", "$.a", "int", "1"), Row("b", "$.b")]}
