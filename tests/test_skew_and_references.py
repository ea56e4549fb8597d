from datetime import datetime

import pytest

from skein.operators import references as R
from skein.operators import skew as S


def edges(spark, rows):
    return spark.createDataFrame(rows, "source_id string, target_id string")


def test_hot_ids_counts_every_stored_row(spark):
    rows = [("hot", f"t{i}") for i in range(10)] + [(f"s{i}", "hub") for i in range(10)] + [(None, "hub"), ("hot", None)] + [(f"u{i}", f"v{i}") for i in range(28)]
    got = {tuple(r) for r in S.hot_ids(edges(spark, rows), 0.22).collect()}
    assert got == {("source_id", "hot"), ("target_id", "hub")}  # 11 of 50 rows each, the tie counts
    assert S.hot_ids(edges(spark, []), 0.02).count() == 0


def test_eager_aggregation_equals_the_join(spark):
    left = spark.createDataFrame([("a", 1), ("a", 2), ("b", None), (None, 5), ("c", 3)], "k string, x int")
    right = spark.createDataFrame([("a", 10), ("a", 20), ("b", 7), (None, 1)], "k string, y int")
    got = {r["id"]: (r["rows"], r["left_sum_x"], r["right_sum_y"]) for r in S.eager_join_aggregate(left, right, "k", "k", ["x"], ["y"]).collect()}
    assert got == {"a": (4, 6, 60), "b": (1, None, 7)}


def test_fan_states_with_distinct_partners(spark):
    rows = [("a", "b"), ("a", "b"), ("a", "c"), ("b", "a"), ("a", None)]
    got = {r["id"]: (r["out_rows"], r["in_rows"], r["out_others"], r["in_others"]) for r in S.fan_states(edges(spark, rows), distinct=True).filter("id is not null").collect()}
    assert got == {"a": (4, 1, 2, 1), "b": (1, 2, 1, 1), "c": (0, 1, 0, 1)}


T = lambda d: datetime(2024, 1, d)


def test_edge_orphans_states(spark):
    nodes = spark.createDataFrame([("here", T(1), None), ("late", T(9), None), ("late", T(5), None), ("gone", T(1), T(3)), ("gone", T(2), None), (None, T(1), None)], "id string, seen_at timestamp, deleted_at timestamp")
    rows = [("s", "here", "calls", T(4)), ("s", "late", "calls", T(4)), ("s", "late", "calls", T(4)), ("s", "late", "imports", T(5)), ("s", "gone", "calls", T(3)), ("s", "gone", "imports", T(2)), ("s", "none", "calls", None), (None, "none", "calls", T(1)), ("s", None, "calls", T(1))]
    found = R.edge_orphans(spark.createDataFrame(rows, "source_id string, target_id string, kind string, seen_at timestamp"), nodes)
    assert {(r["target_id"], r["kind"], r["state"]) for r in found.collect()} == {("late", "calls", "late"), ("gone", "calls", "deleted"), ("none", "calls", "missing")}
    assert found.count() == 3
    report = {(r["kind"], r["month"], r["state"], r["n"]) for r in R.orphan_report(found, "edges").collect()}
    assert report == {("calls", "2024-01", "late", 1), ("calls", "2024-01", "deleted", 1), ("calls", None, "missing", 1)}


def test_composite_keys_under_each_match(spark):
    keys = spark.createDataFrame([("f1", 1), ("f1", 2), ("f2", None)], "path string, build int")
    refs = spark.createDataFrame([("f1", 1, "a"), ("f1", 3, "b"), ("f1", None, "c"), ("f2", None, "d"), ("f3", None, "e"), (None, 2, "f"), (None, 9, "g"), (None, None, "h")], "path string, build int, state0 string")
    run = lambda match: {(r["state0"], r["state"], r["null_mask"]) for r in R.orphans(refs, keys, ["path", "build"], ["path", "build"], match).collect()}
    assert run("simple") == {("b", "missing", "xx")}
    assert run("partial") == {("b", "missing", "xx"), ("e", "missing", "x-"), ("g", "missing", "-x")}
    assert run("full") == {("b", "missing", "xx"), *((x, "mixed", "x-") for x in "cde"), *((x, "mixed", "-x") for x in "fg")}
    with pytest.raises(ValueError):
        R.orphans(refs, keys, ["path"], ["path"], "other")
    assert R.orphans(refs.limit(0), keys, ["path"], ["path"]).count() == 0


def test_hot_composite_keys(spark):
    """A third of the references share one key of three columns; results are those without splitting."""
    keys = spark.createDataFrame([("hub", 1, "x"), ("a", 1, None), ("a", 2, "y")], "f string, b int, n string")
    rows = [("hub", 1, "x")] * 200 + [("gone", 1, "x")] * 200 + [("a", None, "y")] * 100 + [("a", None, "z")] * 50 + [("a", 2, "y"), ("a", 2, None), (None, None, None), ("o", 5, "x")]
    refs = spark.createDataFrame(rows, "f string, b int, n string")
    for match in R.MATCHES:
        count = lambda share: {(r["f"], r["b"], r["n"], r["state"], r["null_mask"]): r["count"] for r in R.orphans(refs, keys, ["f", "b", "n"], ["f", "b", "n"], match, hot_share=share).groupBy("f", "b", "n", "state", "null_mask").count().collect()}
        assert count(0.1) == count(2.0)
    assert count(0.1)["gone", 1, "x", "missing", "xxx"] == 200 and count(0.1)["a", None, "z", "missing", "x-x"] == 50
    clash = refs.withColumnRenamed("f", "__hot9")
    assert R.orphans(clash, keys, ["__hot9", "b"], ["f", "b"], "partial").filter("state = 'missing'").count() == 201
