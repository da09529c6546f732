"""Joins of keys that are heavy on both sides."""

import random

import pytest
from pyspark.sql import functions as F

from tracewright.functions.skew import grid_cells, grid_join
from tracewright.operators import events as K


def skewed(spark, n, m, seed):
    rnd = random.Random(seed)
    left = [(i, "hot" if rnd.random() < 0.5 else "lost" if rnd.random() < 0.4 else None if rnd.random() < 0.1 else f"k{rnd.randrange(40)}") for i in range(n)]
    right = [("hot" if rnd.random() < 0.4 else "alone" if rnd.random() < 0.3 else f"k{rnd.randrange(40)}", i) for i in range(m)]
    return left, right, spark.createDataFrame(left, "id long, k string").repartition(4), spark.createDataFrame(right, "k string, v long").repartition(3)


@pytest.mark.parametrize("n, m, shares", [(2000, 300, 100), (300, 2000, 1000), (1500, 4, 50), (10, 10, 1000)])
def test_grid_join_equals_a_plain_one(spark, n, m, shares):
    left, right, a, b = skewed(spark, n, m, n)
    want = sorted((k, i, v) for i, k in left for q, v in right if k is not None and q == k)
    out = grid_join(a, b, "k", shares, 16, 4)
    assert sorted(map(tuple, out.select("k", "id", "v").collect())) == want
    assert sorted(map(tuple, grid_join(a, b, "k").select("k", "id", "v").collect())) == want


def test_no_cell_holds_a_hundredth(spark):
    left, right, a, b = skewed(spark, 6000, 4000, 3)
    one, two = grid_cells(a, b, "k", 1000, 16, 4)
    cells = one.groupBy("k", "_i", "_j").agg(F.count("*").alias("a")).join(two.groupBy("k", "_i", "_j").agg(F.count("*").alias("b")), ["k", "_i", "_j"])
    rows = cells.collect()
    pairs = sum(r["a"] * r["b"] for r in rows)
    assert max(r["a"] * r["b"] for r in rows) <= pairs / 100
    assert max(r["a"] for r in rows) <= 6000 / 100 * 1.6 and max(r["b"] for r in rows) <= 4000 / 100 * 1.6  # dealt by hash
    assert {r["k"] for r in one.select("k").distinct().collect()}.isdisjoint({"lost", None})
    assert one.count() < 60 * 6000


def test_wildcards_and_exact_types(spark):
    events = spark.createDataFrame([(1, "click"), (2, "view"), (3, None), (4, "click")], "event_id long, event_type string")
    subs = spark.createDataFrame([("a", "click"), ("a", "click"), ("b", "*"), ("b", "click"), ("b", "*"), ("c", "view"), ("d", "refund"), ("e", None)], "subscriber string, event_type string")
    got = sorted((r["event_id"], r["subscriber"]) for r in K.fan_out_subscriptions(events, subs).collect())
    assert got == [(1, "a"), (1, "b"), (2, "b"), (2, "c"), (3, "b"), (4, "a"), (4, "b")]
    assert K.fan_out_subscriptions(events, subs).columns == ["event_id", "event_type", "subscriber"]
    assert K.fan_out_subscriptions(events, subs.limit(0)).count() == 0
