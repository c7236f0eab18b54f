"""Queries of mapping templates, and their SQL twins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from assaylake.operators import records, reports, templates
from assaylake.operators.templates import Row
from assaylake.sources import relations as r

#: What a user's day looks like.
SHAPE = "user struct<id:bigint>, day string, events array<struct<id:bigint,kind:string,value:double,place:struct<k:bigint>>>"
TEMPLATES = {
    "all": [Row("user", "$.user.id", "bigint"), Row("day", "$.day", "date"), Row("rows", "$.events", "list"), Row("rows[].id", "$.id", "bigint"), Row("rows[].value", "$.value", "double", "0")],
    "purchases": [Row("user", "$.user.id", "bigint"), Row("day", "$.day", "date"), Row("rows", "$.events", "list", filter="$.kind = 'purchase'"), Row("rows[].id", "$.id", "bigint"), Row("rows[].value", "$.value", "double")],
    "large": [Row("user", "$.user.id", "bigint"), Row("day", "$.day", "date"), Row("rows", "$.events", "list", filter="$.value >= 50"), Row("rows[].id", "$.id", "bigint"), Row("rows[].value", "$.place.k", "double")],
}


def _days(s, d):
    """A JSON body for each user and day; events without a value lack it, days that are the 13th lack their user, and the bodies of the 20th are cut off."""
    e = r.table(s, d, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    event = F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.when(F.col("event_id") % 11 > 0, F.col("value")).alias("value"), F.struct(F.get_json_object("props", "$.k").cast("bigint").alias("k")).alias("place"))
    g = e.groupBy("user_id", "day").agg(F.array_sort(F.collect_list(event)).alias("events"))
    user = F.when(~F.col("day").endswith("-13"), F.struct(F.col("user_id").alias("id")))
    body = F.to_json(F.struct(user.alias("user"), "day", "events"))
    return g.select("user_id", "day", F.when(F.col("day").endswith("-20"), F.substring(body, F.lit(1), F.length(body) - 2)).otherwise(body).alias("body"))


def mapped_rows(s, d):
    """The rows of the lists of all templates."""
    days = _days(s, d)
    each = [templates.apply(days, "body", rows, SHAPE, ("user_id", "day")).select(F.lit(name).alias("template"), "user_id", "user", F.inline("rows")) for name, rows in _renamed().items()]
    return reduce(lambda a, b: a.unionByName(b), each).select("template", "user_id", "user", "id", "value")


def _renamed():
    """The templates with the day read under another name than the kept column."""
    return {name: [Row("date", *[getattr(x, c) for c in ("path", "cast", "default", "filter")]) if x.target == "day" else x for x in rows] for name, rows in TEMPLATES.items()}


def extraction(s, d):
    """Each template's rows against the number that the events have for it; a row without a value is incomplete."""
    rows = mapped_rows(s, d)
    e = r.table(s, d, "events").filter("dayofmonth(ts) <> 20")
    n = e.agg(F.count(F.lit(1)).alias("all"), F.count_if(F.col("event_type") == "purchase").alias("purchases"), F.count_if((F.col("value") >= 50) & (F.col("event_id") % 11 > 0)).alias("large"))
    expected = n.select(F.explode(F.create_map(*[x for c in TEMPLATES for x in (F.lit(c), F.col(f"`{c}`"))])).alias("template", "expected_count"))
    return reports.extraction_score(rows, expected, F.col("value").isNotNull())


def structure(s, d):
    """Verdicts of each template over the days: those that lack their user are to be blocked, and those that are no JSON give none."""
    days = _days(s, d)
    scored = []
    for name, rows in _renamed().items():
        got = templates.verdicts(templates.apply(days, "body", rows, SHAPE, ("user_id", "day")), ["user", "date"])
        scored.append(got.select(F.lit(name).alias("template"), F.when(F.col("day").endswith("-13"), "BLOCK").otherwise("PASS").alias("expected"), "observed"))
    return records.template_score(reduce(lambda a, b: a.unionByName(b), scored))


_ROWS = """e as (select event_id as id, user_id, event_type, case when event_id % 11 > 0 then value end as value, cast(json_extract_string(props, '$.k') as double) as k, strftime(ts, '%Y-%m-%d') as day from events),
  m as (select 'all' as template, user_id, day, id, coalesce(value, 0) as value from e union all select 'purchases', user_id, day, id, value from e where event_type = 'purchase' union all select 'large', user_id, day, id, k from e where value >= 50),
  rows_ as (select template, user_id, case when day not like '%-13' then user_id end as "user", id, value from m where day not like '%-20')"""

QUERIES = {
    "x11_mapped_rows": (mapped_rows, f"with {_ROWS} select * from rows_"),
    "a25_template_extraction": (
        extraction,
        f"""with {_ROWS}, n as (select template, count(*) as count, count(*) filter (value is null) as nulls from rows_ group by template)
            select template, count as expected_count, count, nulls, nulls = 0 as accepted, case when nulls = 0 then 1.0 else round((count - nulls) / count, 3) end as graded from n""",
    ),
    "a24_template_verdicts": (
        structure,
        """with days as (select distinct user_id, strftime(ts, '%Y-%m-%d') as day from events), t as (select * from days, (values ('all'), ('purchases'), ('large')) t(template)),
            n as (select template, cast(0 as bigint) as false_positives, count(*) filter (day like '%-20') as errors, count(*) filter (day like '%-13') as caught, count(*) filter (day like '%-13') as defects from t group by template)
            select *, false_positives = 0 and errors = 0 and caught = defects as accepted from n""",
    ),
}
