import datetime as dt

import pytest

from assaylake.streaming import replay, views

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def drain(df, name, mode="complete"):
    """Runs a stream over all that is there now into a table in memory."""
    df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return df.sparkSession.table(name)


def events(spark, path, times, start=0):
    rows = [(start + i, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m), 1, "a", 1.0, "") for i, m in enumerate(times)]
    spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(path)


def test_stream_equals_batch(spark, tmp_path):
    path = str(tmp_path / "e")
    events(spark, path, [0, 5, 30, 1500])
    stream = views.event_stream(spark, path, EVENTS)
    got = drain(views.sessions(stream), "sess")
    assert sorted(r["n"] for r in got.collect()) == [1, 1, 2]
    batch = views.tumbling(spark.read.parquet(path)).collect()
    assert sorted(map(tuple, drain(views.tumbling(stream), "tum").collect())) == sorted(map(tuple, batch))


LOG = "case_key long, seq long, ts timestamp, signature string"


def log(spark, rows):
    return spark.createDataFrame([(k, q, dt.datetime(2024, 1, 1) + dt.timedelta(hours=q % 1000), x) for k, q, x in rows], LOG)


@pytest.fixture
def rocks(spark):
    with replay.conf(spark, spark__sql__streaming__stateStore__providerClass=replay.ROCKS):
        yield


def test_state_is_kept_between_triggers_and_repeats_fall_out(spark, tmp_path, rocks):
    rows = [(1, q, x) for q, x in enumerate("aabba")] + [(2, 1000 + q, "c") for q in range(3)]
    arrivals = [log(spark, rows[:2] + rows[5:7]), log(spark, rows[:4] + rows[5:]), log(spark, rows[4:5] + rows[2:3])]
    run = replay.triggered(arrivals, lambda x: replay.signature_breaks(replay.once(x, "seq", "1 day")), f"{tmp_path}/a")
    got = sorted((r["case_key"], r["seq"], r["before"], r["signature"]) for r in run.appended.collect())
    assert got == [(1, 0, None, "a"), (1, 2, "a", "b"), (1, 4, "b", "a"), (2, 1000, None, "c")]
    with replay.conf(spark, spark__sql__shuffle__partitions="3"):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "3"
    assert spark.conf.get("spark.sql.shuffle.partitions") == "4"


def test_an_idle_key_starts_anew(spark, tmp_path, rocks):
    hour = 3_600_000
    arrivals = [log(spark, [(1, 0, "a"), (2, 0, "a")]), log(spark, [(2, 5, "a")]), log(spark, [(2, 50, "a")]), log(spark, [(1, 51, "a"), (2, 52, "a")])]
    view = lambda x: replay.signature_breaks(x.withWatermark("ts", "1 hour"), 10 * hour)
    got = sorted((r["case_key"], r["seq"], r["before"]) for r in replay.triggered(arrivals, view, f"{tmp_path}/a").appended.collect())
    assert got == [(1, 0, None), (1, 51, None), (2, 0, None)]


def test_sessions_close_as_the_watermark_passes(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = lambda *ms: spark.createDataFrame([(i, start + dt.timedelta(minutes=m), 1, "a", 1.0, "") for i, m in enumerate(ms)], EVENTS.replace("_ntz", ""))
    # 5 and 12 are one session, which 20 joins in the next arrival; 3 comes when all up to 240 is closed
    run = replay.triggered([rows(5, 12), rows(20, 100), rows(300), rows(3, 295)], lambda x: views.sessions(x), f"{tmp_path}/s")
    minute = lambda t: int((t - start).total_seconds() // 60)
    assert sorted((minute(r["start"]), minute(r["end"]), r["n"]) for r in run.appended.collect()) == [(5, 30, 3), (100, 110, 1)]
    assert run.state.count() == 1  # 295 and 300


def test_late_rows_are_counted(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = lambda *hs: spark.createDataFrame([(i, start + dt.timedelta(hours=h), 1, "a", 1.0, "") for i, h in enumerate(hs)], EVENTS.replace("_ntz", ""))
    run = replay.triggered([rows(1, 2), rows(30, 3), rows(4, 26), rows(80, 5)], views.tumbling, f"{tmp_path}/t")
    (one,) = replay.late_count(run, 8, "n", "value.count").collect()
    assert tuple(one) == (8, 5, 1, 2)  # 4 and 5 come when their day is closed


def test_upsert_and_drift(spark, tmp_path):
    source, target, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    schema = "k long, seq long, verdict string"
    spark.createDataFrame([(1, 1, "PASS"), (2, 1, "PASS")], schema).write.parquet(source)
    run = lambda: views.upsert_latest(spark.readStream.schema(schema).parquet(source), target, mark, "k", "seq").awaitTermination()
    assert views.read_upserted(spark, target) is None
    run()
    spark.createDataFrame([(1, 2, "BLOCK")], schema).write.mode("append").parquet(source)
    run()
    now = views.read_upserted(spark, target)
    assert sorted((r["k"], r["verdict"]) for r in now.collect()) == [(1, "BLOCK"), (2, "PASS")]
    base = spark.createDataFrame([(1, "PASS"), (2, "PASS")], "k long, verdict string")
    assert [r["k"] for r in views.drift_alerts(now, base, "k").collect()] == [1]


def test_many_files_lose_no_old_events_and_nothing_stays_in_memory(spark, tmp_path):
    from assaylake.plans import streams

    path = str(tmp_path / "events.parquet")
    for k in range(70):  # the newest first, each file of one event a day
        spark.createDataFrame([(k, dt.datetime(2024, 6, 1) - dt.timedelta(days=k), 1, "a", 1.0, "")], EVENTS).coalesce(1).write.mode("append").parquet(path)
    before = {t.name for t in spark.catalog.listTables()}
    assert streams.sessions(spark, str(tmp_path)).count() == 70
    assert sum(r["n"] for r in streams.tumbling(spark, str(tmp_path)).collect()) == 70
    assert {t.name for t in spark.catalog.listTables()} == before


def test_breaks_by_trigger_read_repeats_and_older_rows_once(spark, tmp_path, rocks):
    rows = [(1, q, x) for q, x in enumerate("aabba")] + [(2, 1000 + q, "c") for q in range(3)]
    arrivals = [log(spark, rows[:2] + rows[5:7]), log(spark, rows[:4] + rows[5:]), log(spark, rows[4:5] + rows[2:3])]
    got = sorted(tuple(r) for r in replay.breaks_once(arrivals, f"{tmp_path}/a", "1 day").collect())
    assert got == [(1, 0, None, "a"), (1, 2, "a", "b"), (1, 4, "b", "a"), (2, 1000, None, "c")]
    # 3 comes after 5 with another signature: it is no break, and 6 is compared with 5
    stale = [log(spark, [(1, 5, "a")]), log(spark, [(1, 3, "b"), (1, 6, "a"), (1, 7, "b")])]
    for x in stale:
        x.write.mode("append").parquet(f"{tmp_path}/s/in")
        out = views.breaks(spark.readStream.schema(x.schema).parquet(f"{tmp_path}/s/in"), f"{tmp_path}/s/out")
    assert sorted(tuple(r) for r in out.collect()) == [(1, 5, None, "a"), (1, 7, "a", "b")]


def test_the_breaks_query_starts_no_python_worker(spark, monkeypatch):
    from assaylake.plans import streams

    def used(*_):
        raise AssertionError("rows went through Python")

    monkeypatch.setattr(replay, "signature_breaks", used)
    assert streams.state_breaks(spark, "/root/testdata/sf0.001").count() > 0
