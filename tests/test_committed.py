"""Records and audit rows in one commit: failures, repeats, concurrent savers, point reads, compaction."""

import json

import pytest

from assaylake.sources.committed import CommittedStore, Conflict


@pytest.fixture
def store(spark, tmp_path):
    return CommittedStore(spark, f"file://{tmp_path}/store", "name string, n int", buckets=4)


def rows(spark, *values):
    return spark.createDataFrame(list(values), "id long, name string, n int")


def now(store):
    return sorted(tuple(r) for r in store.current().collect())


def audit(store):
    return sorted((r["number"], r["id"], r["action"], r["before"] and json.loads(r["before"])["n"], r["after"] and json.loads(r["after"])["n"]) for r in store.audit().collect())


def test_saves_count_versions_and_leave_audit_rows(spark, store):
    assert now(store) == [] and audit(store) == [] and store.get(1).count() == 0
    store.save(rows(spark, (1, "a", 1), (2, "b", 1)))
    store.save(rows(spark, (2, "b", 2), (3, None, None), (3, None, None), (None, "x", 1)))
    store.delete(rows(spark, (1, "", 0), (9, "", 0)).select("id"))
    assert now(store) == [(2, "b", 2, 2), (3, None, None, 1)]
    assert audit(store) == [(1, 1, "create", None, 1), (1, 2, "create", None, 1), (2, 2, "update", 1, 2), (2, 3, "create", None, None), (3, 1, "delete", 1, None)]
    store.save(rows(spark, (1, "again", 5)))
    assert [tuple(r) for r in store.get(1).collect()] == [(1, "again", 5, 3)]


def test_a_save_that_fails_or_repeats_changes_nothing(spark, store, monkeypatch):
    store.save(rows(spark, (1, "a", 1)), "first")
    before = now(store), audit(store)

    def fail():
        raise RuntimeError("lost")

    monkeypatch.setattr(store, "_before_commit", fail)
    with pytest.raises(RuntimeError):
        store.save(rows(spark, (1, "a", 2), (2, "b", 2)), "second")
    assert (now(store), audit(store)) == before
    monkeypatch.undo()
    store.save(rows(spark, (1, "a", 2), (2, "b", 2)), "second")
    done = now(store), audit(store)
    assert done[0] == [(1, "a", 2, 2), (2, "b", 2, 1)] and len(done[1]) == 3
    store.save(rows(spark, (1, "a", 2), (2, "b", 2)), "second")
    store.save(rows(spark, (1, "a", 1)), "first")
    assert (now(store), audit(store)) == done


def test_of_two_savers_the_second_begins_again(spark, store, monkeypatch):
    other = CommittedStore(spark, store.path, "name string, n int", buckets=4)
    between = [lambda: other.save(rows(spark, (1, "other", 7)))]
    monkeypatch.setattr(store, "_before_commit", lambda: between.pop()() if between else None)
    store.save(rows(spark, (1, "mine", 8)))
    assert now(store) == [(1, "mine", 8, 2)]
    assert audit(store) == [(1, 1, "create", None, 7), (2, 1, "update", 7, 8)]
    monkeypatch.setattr(store, "_before_commit", lambda: other.save(rows(spark, (1, "other", 9))))
    with pytest.raises(Conflict):
        store.save(rows(spark, (1, "mine", 10)), attempts=1)
    assert now(store)[0][1] == "other"


def test_a_point_read_opens_the_files_of_one_bucket(spark, store):
    for k in range(3):
        store.save(spark.range(k * 1000, k * 1000 + 1000).selectExpr("id", "concat('n', id) as name", "cast(id as int) as n"))
    every = store.state().records
    mine = store.files_of(1500)
    assert len(every) >= 12 and len(mine) == 1 and len(store.get(1500).inputFiles()) == 1
    assert [tuple(r) for r in store.get(1500).collect()] == [(1500, "n1500", 1500, 1)]
    assert store.get(99_999).count() == 0


def test_a_path_without_a_scheme(spark, tmp_path):
    plain = CommittedStore(spark, f"{tmp_path}/plain", "name string, n int", buckets=2)
    plain.save(rows(spark, (1, "a", 1)))
    plain.save(rows(spark, (1, "a", 2)))
    assert now(plain) == [(1, "a", 2, 2)]


def test_compaction_says_the_same_in_fewer_files(spark, store):
    store.compact()
    for k in range(4):
        store.save(rows(spark, *[(i, "x", k) for i in range(20)]), f"s{k}")
    store.delete(rows(spark, (3, "", 0)).select("id"))
    before, files = (now(store), audit(store)), len(store.state().records)
    store.compact()
    assert (now(store), audit(store)) == before and len(store.state().records) == 4 < files
    store.save(rows(spark, (0, "x", 3)), "s3")  # still known
    assert now(store) == before[0]
    store.save(rows(spark, (0, "x", 9)))
    assert now(store)[0] == (0, "x", 9, 5)
