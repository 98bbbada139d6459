import re
import uuid

import pytest

from weblake.operators import bodies


def stored(spark, tmp_path, rows, buckets=8):
    name = f"b_{uuid.uuid4().hex}"
    bodies.write_body_store(spark.createDataFrame(rows, "path string, body string"), name, str(tmp_path / "store"), buckets)
    return name


def test_bodies_are_not_shuffled_and_other_buckets_not_read(spark, tmp_path):
    name = stored(spark, tmp_path, [(f"p{i}", f"body {i}") for i in range(200)])
    report = spark.createDataFrame([(i, f"p{i}", "old") for i in range(0, 200, 2)], "id long, path string, body string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = bodies.attach_from_store(report, name, 8)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert {(r["id"], r["body"], r["body_error"]) for r in found.collect()} == {(i, f"body {i}", None) for i in range(0, 200, 2)}
        one = bodies.attach_from_store(report.where("id = 4"), name, 8)
        assert [r["body"] for r in one.collect()] == ["body 4"]
        pruned = one._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # The report alone is shuffled.
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan, plan
    assert re.search(r"its part#\d+ = \d+|its part#\d+ IN \(\d+\)", pruned)


@pytest.mark.parametrize("size", [0, 1000])
def test_missing_null_repeated_and_hot_paths(spark, tmp_path, monkeypatch, size):
    monkeypatch.setattr(bodies, "HOT_ROWS", 10)
    monkeypatch.setattr(bodies, "BROADCAST_BYTES", size)
    name = stored(spark, tmp_path, [("in/a", "A"), ("in/b", None), ("in/c", "C"), (None, "N")])
    rows = [(i, "a") for i in range(50)] + [(100, "b"), (101, "gone"), (102, None), (103, "c"), (103, "c")] + [(200 + i, "lost") for i in range(30)]
    got = bodies.attach_from_store(spark.createDataFrame(rows, "id long, path string"), name, 8, "in/").collect()
    want = {"a": ("A", None), "b": (None, None), "gone": (None, "file-not-found"), None: (None, None), "c": ("C", None), "lost": (None, "file-not-found")}
    assert sorted(((r["id"], r["body"], r["body_error"]) for r in got), key=str) == sorted(((i, *want[p]) for i, p in rows), key=str)
    empty = spark.createDataFrame([], "id long, path string")
    assert bodies.attach_from_store(empty, name, 8).collect() == []


def test_a_store_of_an_earlier_session(spark, tmp_path):
    stored(spark, tmp_path, [("a", "A")])
    name = f"b_{uuid.uuid4().hex}"
    bodies.open_body_store(spark, name, str(tmp_path / "store"), "path string, body string", 8)
    more = spark.createDataFrame([("b", "B")], "path string, body string")
    bodies.write_body_store(more, name, str(tmp_path / "store"), 8, mode="append")
    report = spark.createDataFrame([(1, "a"), (2, "b")], "id long, path string")
    assert {(r["id"], r["body"]) for r in bodies.attach_from_store(report, name, 8).collect()} == {(1, "A"), (2, "B")}
