"""Delta, interval and ranking shapes against brute force, including hot keys."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.operators import delta, events, ranking


@pytest.fixture(scope="module")
def marks(spark):
    """Counter rows where one entity holds a third of all rows."""
    rng = random.Random(7)
    rows = []
    for key, n in [("hot", 400)] + [(f"k{i}", 40) for i in range(20)]:
        for snap in sorted(rng.sample(range(2000), n)):
            rows.append((key, snap, rng.choice([None, rng.randrange(1000)])))
    return rows, spark.createDataFrame(rows, "k string, snapid long, c long")


@pytest.mark.parametrize("chunk", [1, 16, 333, 100000])
def test_chunked_lag_equals_plain_lag(marks, chunk):
    rows, df = marks
    want, by_key = {}, defaultdict(list)
    for k, s, c in rows:
        by_key[k].append((s, c))
    for k, series in by_key.items():
        before = None
        for s, c in sorted(series):
            want[(k, s)] = before
            before = c
    got = delta.with_previous(df, ["k"], ["c"], chunk=chunk).collect()
    assert {(r["k"], r["snapid"]): r["prev_c"] for r in got} == want
    assert len(got) == len(rows)


def test_chunked_lag_groups_stay_small(marks):
    _, df = marks
    plan = delta.with_previous(df, ["k"], ["c"], chunk=16)._jdf.queryExecution().optimizedPlan().toString()
    assert "_chunk" in plan


def test_endpoint_presence(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 9), ("b", 2, 3), ("c", 1, 7), ("z", 3, 1)], "k string, snapid long, c long")
    left = {r["k"]: (r["b_c"], r["e_c"]) for r in delta.endpoint_pair(df, ["k"], 1, 2, ["c"]).collect()}
    assert left == {"a": (5, 9), "b": (None, 3)}
    inner = delta.endpoint_pair(df, ["k"], 1, 2, ["c"], presence="both").collect()
    assert [r["k"] for r in inner] == ["a"]
    outer = {r["k"] for r in delta.endpoint_pair(df, ["k"], 1, 2, ["c"], presence="any").collect()}
    assert outer == {"a", "b", "c"}


def test_registry_uses_each_entitys_last_mark(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 3, 9), ("b", 2, 3)], "k string, snapid long, c long")
    got = {r["k"]: (r["last"], r["b_c"], r["e_c"]) for r in delta.registry(df, ["k"], 1, ["c"]).collect()}
    assert got == {"a": (3, 5, 9), "b": (2, None, 3)}


def test_since_reset_policies(spark):
    df = spark.createDataFrame([(10, 4, 1, 1), (10, 4, 2, 1), (10, 4, None, None)], "e long, b long, re long, rb long")
    args = [F.col(c) for c in ("e", "b", "re", "rb")]
    assert [r[0] for r in df.select(delta.since_reset(*args)).collect()] == [6, 10, 10]
    assert [r[0] for r in df.select(delta.since_reset(*args, null_reset="difference")).collect()] == [6, 10, 6]


def test_interval_join_counts_shared_boundaries_twice(spark):
    ev = spark.sql("SELECT 1L AS i, timestamp_seconds(t) AS t FROM VALUES (0), (3600), (5400), (9000) AS x(t)")
    iv = spark.sql(
        "SELECT 1L AS i, s, timestamp_seconds(a) AS a, timestamp_seconds(b) AS b FROM VALUES (1, 0, 3600), (2, 3600, 8000) AS x(s, a, b)"
    )
    got = events.interval_join(ev, iv, "t", "a", "b", ["i"]).groupBy("s").count().collect()
    assert {r["s"]: r["count"] for r in got} == {1: 2, 2: 2}


def test_top_shares_per_group_and_global(spark):
    rows = [("g", f"e{i:03d}", i + 1) for i in range(300)] + [("h", "x", 4), ("h", "y", 4), ("h", "z", 8)]
    df = spark.createDataFrame(rows, "g string, e string, n long")
    got = ranking.top_shares(df, ["g"], "n", ["e"], 2).orderBy("g", "row_number").collect()
    assert [(r["g"], r["e"], float(r["ratio"])) for r in got] == [
        ("g", "e299", 0.664), ("g", "e298", 0.662), ("h", "z", 50.0), ("h", "x", 25.0)
    ]
    whole = ranking.top_shares(df, [], "n", ["e"], 1).collect()
    assert [(r["e"], float(r["ratio"]), r["row_number"]) for r in whole] == [("e299", 0.664, 1)]


def test_group_limit_trims_before_the_shuffle(spark):
    df = spark.range(1000).selectExpr("id % 3 AS g", "id AS n", "id AS e")
    plan = ranking.top_shares(df, ["g"], "n", ["e"], 10)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
