"""Tables in versions, publications, budgets, and streams with a state for each key."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fennmark.operators import publication
from fennmark.sources.versions import Versions, digest
from fennmark.stored import work_folder
from fennmark.streaming import attempts


@pytest.fixture
def versions(spark):
    return Versions(spark, work_folder(spark, "versions-test"))


def table(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id int")


def ids(df):
    return sorted(r.id for r in df.collect())


def test_versions_are_seen_whole_or_not_at_all(spark, versions):
    assert versions.commits() == [] and ids(versions.read("a", "id int")) == [] and versions.commit() is None
    assert versions.publish({"a": table(spark, 1), "b": table(spark, 7)}, "x") == 1
    assert versions.publish({"a": table(spark, 1, 2)}, "x") == 1 and ids(versions.read("a", "id int")) == [1]  # made from the same
    assert versions.publish({"a": table(spark, 1, 2)}, "y") == 2
    assert ids(versions.read("a", "id int")) == [1, 2] and ids(versions.read("b", "id int")) == [7] and ids(versions.read("a", "id int", 1)) == [1]
    broken = table(spark, 3).select(F.when(F.col("id") == 3, F.raise_error(F.lit("lost"))).cast("int").alias("id"))
    with pytest.raises(Exception, match="lost"):
        versions.publish({"b": table(spark, 8), "a": broken}, "z")
    assert versions.commits() == [1, 2] and ids(versions.read("b", "id int")) == [7]


def test_of_two_runs_from_one_version_one_fails(spark, versions):
    versions.publish({"a": table(spark, 1)}, "x")
    with pytest.raises(Exception, match="exist"):
        versions._put({"version": 1, "made_from": "other", "tables": {}}, 1, "run")
    assert versions.commit()["made_from"] == "x"


def test_rows_that_are_appended(spark, versions):
    for k in (1, 2, 3):
        versions.publish({}, f"run {k}", {"log": table(spark, k)})
    versions.publish({}, "run 3", {"log": table(spark, 3)})
    assert ids(versions.read_appended("log", "id int")) == [1, 2, 3] and ids(versions.read_appended("log", "id int", 2)) == [1, 2] and ids(versions.read_appended("none", "id int")) == []


def test_digests_go_by_rows_not_by_order(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, None)], "i int, s string"), spark.createDataFrame([(2, None), (1, "x")], "i int, s string")
    assert digest(a) == digest(b) != digest(a.unionByName(a)) and digest(a) != digest(a.limit(0)) and digest(a, b) != digest(a)


QUEUE = "queue_id bigint, quote_key string, url string, title string"
DECISIONS = "queue_id bigint, place int, link_to string"


def test_publication(spark, versions):
    old = [("P-0007", None, "q7", "u", "seven"), ("P-0009", "g-x", "q9", "u", "nine")]
    versions.publish({"promises": spark.createDataFrame(old, publication.PUBLISHED)}, "start")
    queue = spark.createDataFrame([(k, f"n{k}", "u", f"t{k}") for k in range(1, 6)] + [(6, "q7", "u", "again"), (7, "q7", "other", "elsewhere"), (8, "n1", "u", "same")], QUEUE)
    asked = [(1, 10, None), (2, 11, "P-0007"), (3, 12, "P-0007"), (4, 13, "P-0009"), (5, 14, "P-0404"), (6, 15, None), (7, 16, None), (8, 17, None), (99, 18, None), (1, 19, None)]
    decisions = spark.createDataFrame(asked, DECISIONS)
    assert publication.publish(versions, queue, decisions, "P-") == 2
    got = {r.title: (r.id, r.group_id) for r in versions.read("promises", publication.PUBLISHED).collect()}
    assert got == {
        "seven": ("P-0007", "g-P-0007"), "nine": ("P-0009", "g-x"), "t1": ("P-0010", None), "t2": ("P-0011", "g-P-0007"), "t3": ("P-0012", "g-P-0007"), "t4": ("P-0013", "g-x"), "elsewhere": ("P-0014", None),
    }
    refused = sorted(map(tuple, versions.read("refused", publication.REFUSED).collect()))
    assert refused == [(1, "decided before"), (5, "linked to nothing"), (6, "published before"), (8, "published before"), (99, "not in the queue")]
    assert publication.publish(versions, queue, decisions, "P-") == 2 and versions.read("promises", publication.PUBLISHED).count() == 7
    assert publication.publish(versions, queue, spark.createDataFrame([(1, 1, None)], DECISIONS), "P-") == 3 and versions.read("promises", publication.PUBLISHED).count() == 7


def test_a_budget_and_what_it_leaves(spark, versions):
    schema = "key int, day int"
    run = lambda rows: [r.key for r in publication.take_within_budget(versions, spark.createDataFrame(rows, schema), "key", ["day"], 3, schema).orderBy("day", "key").collect()]
    assert run([(k, 10 - k) for k in range(6)] + [(5, 5)]) == [5, 4, 3]
    assert run([(7, 1), (5, 5), (8, 20)]) == [7, 2, 1]
    assert run([]) == [0, 8] and run([]) == [] and run([(0, 0), (9, 9)]) == [9]


# --- attempts

T0 = datetime(2024, 3, 1)


def at(day, hour=0):
    return T0 + timedelta(days=day, hours=hour)


def stream_runs(spark, *batches, **more):
    folder = work_folder(spark, "attempts-test")
    for rows in batches:
        spark.createDataFrame(rows, "key string, ts timestamp, outcome string").coalesce(1).write.mode("append").parquet(f"{folder}/source")
        attempts.run(spark.readStream.schema("key string, ts timestamp, outcome string").parquet(f"{folder}/source"), folder, **more)
    return attempts.rows_of(spark, folder)


def test_failed_keys_are_not_seen_and_runs_go_on(spark):
    first = [("a", at(0), "done"), ("a", at(1), "done"), ("b", at(0), "unanswered"), ("c", at(0), "no copy"), (None, at(0), "done"), ("d", at(2), "unanswered"), ("e", at(1), "unanswered")]
    second = [("a", at(3), "done"), ("b", at(4), "done"), ("c", at(4), "unanswered"), ("d", at(5), "unanswered"), ("b", at(5), "done")]
    rows = stream_runs(spark, first, second)
    kinds = {}
    for r in rows.orderBy("ts").collect():
        kinds.setdefault(r.key, []).append(r.kind)
    assert kinds == {"a": ["new", "repeat", "repeat"], "b": ["waiting", "new", "repeat"], "c": ["answered", "waiting"], "d": ["waiting", "waiting"], "e": ["waiting"]}
    waits = lambda now: {r.key: (r.attempts, r.blocked) for r in attempts.waiting(rows, now).collect()}
    assert waits(at(15, 23)) == {"c": (2, True), "d": (2, False), "e": (1, False)}  # 15, 13 and 14 whole days
    assert tuple(attempts.may_exceed(attempts.waiting(rows, at(14))).first())[:3] == (True, 3, 0) and tuple(attempts.may_exceed(attempts.waiting(rows, at(20))).first())[:3] == (False, 3, 3)
    assert tuple(attempts.may_exceed(attempts.waiting(rows.where("key = 'a'"), at(20))).first()) == (False, 0, 0, None)


def test_late_rows_go_to_review_and_change_nothing(spark):
    rows = stream_runs(spark, [("a", at(10), "unanswered"), ("b", at(1), "unanswered")], [("a", at(7), "done"), ("c", at(2), "done"), ("b", at(9), "done")], delay=timedelta(days=2))
    assert {(r.key, r.kind) for r in rows.collect()} == {("a", "waiting"), ("b", "waiting"), ("a", "late"), ("c", "late"), ("b", "new")}


def test_states_are_let_go(spark):
    rows = stream_runs(spark, [("a", at(1), "done")], [("a", at(2), "done")], keep=timedelta(milliseconds=1))
    assert [r.kind for r in rows.orderBy("ts").collect()] == ["new", "new"]
