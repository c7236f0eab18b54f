"""Queries of the streaming views. Some run a file stream over the whole event table in one batch, others in several triggers
with late or repeated rows; they write their results and are held against SQL over the batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from assaylake.sources import relations as r
from assaylake.sources import stores
from assaylake.sources.relations import sql
from assaylake.streaming import replay, views

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def _events(s, d):
    return views.event_stream(s, f"{d}/events.parquet*", EVENTS, None)


def _folder(s) -> str:
    return stores.shared_folder(s, "stream")


def _text(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def tumbling(s, d):
    out = views.settled(views.tumbling(_events(s, d)), _folder(s))
    return out.select(_text("start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def sliding(s, d):
    return views.settled(views.sliding(_events(s, d)), _folder(s)).select(_text("start").alias("start"), "event_type", "n")


def sessions(s, d):
    return views.settled(views.sessions(_events(s, d)), _folder(s)).select(_text("start").alias("start"), "user_id", "n")


def _verdicts(rows, *more):
    return rows.select(F.col("user_id").alias("case_key"), F.col("event_id").alias("seq"), F.when(F.col("value") > 60, "BLOCK").when(F.col("value") > 30, "WARN").otherwise("PASS").alias("verdict"), F.concat(F.lit("sig"), F.floor(F.dayofmonth("ts") / 7).cast("string")).alias("signature"), *more)


def signature_breaks(s, d):
    return views.breaks(_verdicts(_events(s, d)), _folder(s))


def drift(s, d):
    """Events whose verdict is not that of their user's first event."""
    baseline = r.run_log(s, d).filter("case_key % 5 > 0").groupBy("case_key").agg(F.min_by("verdict", "seq").alias("verdict"))
    return views.appended(views.drift_alerts(_verdicts(_events(s, d)).select("case_key", "seq", "verdict"), baseline, "case_key"), _folder(s))


def upserted(s, d):
    folder = _folder(s)
    views.upsert_latest(_verdicts(_events(s, d)), f"{folder}/table", f"{folder}/checkpoint", "case_key", "seq").awaitTermination()
    return views.read_upserted(s, f"{folder}/table").select("case_key", "seq", "verdict", "signature")


#: Arrivals of the events: by weeks of the month, some of them two or nine days late.
ARRIVALS = 6


def _arrivals(s, d):
    e = r.table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    late = F.when(F.col("event_id") % 20 == 0, 9).when(F.col("event_id") % 20 == 1, 2).otherwise(0)
    week = F.least(F.floor((F.dayofmonth("ts") - 1 + late) / 7), F.lit(ARRIVALS - 1))
    return e, [e.filter(week == k) for k in range(ARRIVALS)]


def append_tumbling(s, d):
    run = replay.triggered(_arrivals(s, d)[1], views.tumbling, _folder(s))
    return run.appended.select(_text("start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def append_sliding(s, d):
    run = replay.triggered(_arrivals(s, d)[1], views.sliding, _folder(s))
    return run.appended.select(_text("start").alias("start"), "event_type", "n")


def late_rows(s, d):
    e, arrivals = _arrivals(s, d)
    return replay.late_count(replay.triggered(arrivals, views.tumbling, _folder(s)), e.count(), "n", "value.count")


def _twice(s, d):
    """The log in five arrivals, each of which brings every row twice."""
    log = _verdicts(r.table(s, d, "events"), F.col("ts").cast("timestamp").alias("ts"))
    weeks = [log.filter(F.least(F.floor((F.dayofmonth("ts") - 1) / 7), F.lit(4)) == k) for k in range(5)]
    return [x.unionByName(x) for x in weeks]


def state_breaks(s, d):
    with replay.conf(s, spark__sql__streaming__stateStore__providerClass=replay.ROCKS):
        return replay.breaks_once(_twice(s, d), _folder(s))


def upserted_once(s, d):
    """The upsert of a log that comes twice, and the number of its rows that got through."""
    folder = _folder(s)
    passed = replay.triggered(_twice(s, d), lambda log: replay.once(log, "seq", "2 days").drop("ts"), f"{folder}/once").appended
    stream = s.readStream.schema(passed.schema).parquet(f"{folder}/once/result")
    views.upsert_latest(stream, f"{folder}/table", f"{folder}/checkpoint", "case_key", "seq").awaitTermination()
    n = passed.groupBy("case_key").agg(F.count(F.lit(1)).alias("n"))
    return views.read_upserted(s, f"{folder}/table").join(n, "case_key").select("case_key", "seq", "verdict", "signature", "n")


_LATE = f"""e as (select *, least((day(ts) - 1 + case event_id % 20 when 0 then 9 when 1 then 2 else 0 end) // 7, {ARRIVALS - 1}) as b from events),
  seen as (select b, max(epoch_ms(ts)) as last from e group by b), marks as (select b, (select max(last) from seen x where x.b < y.b) - 3600000 as mark from seen y), final as (select max(last) - 3600000 as mark from seen),
  k as (select e.*, start, coalesce(epoch_ms(start) + days * 86400000 <= m.mark, false) as late, epoch_ms(start) + days * 86400000 <= f.mark as closed from (select *, date_trunc('day', ts) - to_days(cast(i as integer)) as start, {{days}} as days from e, range(0, {{days}}) r(i)) e join marks m using (b), final f)"""


QUERIES = {
    "s_stream_append_tumbling": (append_tumbling, f"with {_LATE.format(days=1)} select strftime(start, '%Y-%m-%d %H:%M:%S') as start, event_type, count(*) as n, round(sum(value), 4) as total from k where closed and not late group by 1, 2"),
    "s_stream_append_sliding": (append_sliding, f"with {_LATE.format(days=2)} select strftime(start, '%Y-%m-%d %H:%M:%S') as start, event_type, count(*) as n from k where closed and not late group by 1, 2"),
    "s_stream_late": (late_rows, f"with {_LATE.format(days=1)} select count(*) as arrived, count(*) filter (closed and not late) as emitted, count(*) filter (not closed and not late) as open, count(*) filter (late) as late from k"),
    "s_stream_state_breaks": (
        state_breaks,
        sql("select case_key, seq, before, signature from (select case_key, seq, signature, lag(signature) over (partition by case_key order by seq) as before from run_log) where signature is distinct from before", "run_log"),
    ),
    "s_stream_upsert_once": (upserted_once, sql("select case_key, max(seq) as seq, arg_max(verdict, seq) as verdict, arg_max(signature, seq) as signature, count(*) as n from run_log group by case_key", "run_log")),
    "s_stream_breaks": (
        signature_breaks,
        sql("select case_key, seq, before, signature from (select case_key, seq, signature, lag(signature) over (partition by case_key order by seq) as before from run_log) where signature is distinct from before", "run_log"),
    ),
    "s_stream_drift": (
        drift,
        sql("with b as (select case_key, arg_min(verdict, seq) as v from run_log where case_key % 5 > 0 group by case_key) select r.case_key, seq, verdict, coalesce(v, 'ABSENT') as baseline from run_log r left join b on r.case_key = b.case_key where verdict <> coalesce(v, 'ABSENT')", "run_log"),
    ),
    "s_stream_upsert": (upserted, sql("select case_key, max(seq) as seq, arg_max(verdict, seq) as verdict, arg_max(signature, seq) as signature from run_log group by case_key", "run_log")),
    "s_stream_tumbling": (tumbling, "select strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2"),
    "s_stream_sliding": (
        sliding,
        """select strftime(date_trunc('day', ts) - to_days(cast(k as integer)), '%Y-%m-%d %H:%M:%S') as start, event_type, count(*) as n from events, range(0, 2) r(k) group by 1, 2""",
    ),
    "s_stream_session": (
        sessions,
        """with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) <= interval 10 minute then 0 else 1 end as fresh from events),
            n as (select *, sum(fresh) over (partition by user_id order by ts, fresh desc rows unbounded preceding) as k from g)
            select strftime(min(ts), '%Y-%m-%d %H:%M:%S') as start, user_id, count(*) as n from n group by user_id, k""",
    ),
}
