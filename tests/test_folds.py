"""Ordered folds of keys that never pause, against plain loops."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tracewright.functions.fold import calm_pieces, chain_entries, slice_length
from tracewright.operators import events as K
from tracewright.operators import policy as P

T0 = datetime(2024, 1, 1)


def events(n, seed, span, hot=0.9, step=1.0):
    """One key holds ``hot`` of the rows and never pauses; times repeat."""
    rnd = random.Random(seed)
    return [("hot" if rnd.random() < hot else f"k{rnd.randrange(5)}", i, T0 + timedelta(seconds=int(rnd.random() * span / step) * step)) for i in range(n)]


def hits(rows, ttl):
    out, anchor = {}, {}
    for k, i, t in sorted(rows, key=lambda r: (r[2], r[1])):
        out[i] = k in anchor and t <= anchor[k] + timedelta(seconds=ttl)
        if not out[i]:
            anchor[k] = t
    return out


def admitted(rows, n, seconds):
    out, recent = {}, {}
    for k, i, t in sorted(rows, key=lambda r: (r[2], r[1])):
        live = [x for x in recent.get(k, []) if x > t - timedelta(seconds=seconds)]
        out[i] = len(live) < n
        recent[k] = live + [t] if out[i] else live
    return out


@pytest.mark.parametrize("ttl, slices, step", [(30, 100, 1.0), (30, 20, 0.5), (7, 50, 0.001), (500, 1000, 1.0), (1, 3, 1.0), (5000, 700, 1.0)])
def test_dedupe_of_a_key_that_never_pauses(spark, ttl, slices, step):
    rows = events(3000, ttl, 6000, step=step)
    df = spark.createDataFrame(rows, "request_key string, request_id long, ts timestamp").repartition(5)
    assert {r["request_id"]: r["hit"] for r in P.dedupe_requests(df, ttl, slices).collect()} == hits(rows, ttl)


def test_slices_of_one_key_are_many_groups_with_small_tables(spark):
    rows = events(4000, 3, 8000)
    df = spark.createDataFrame(rows, "request_key string, request_id long, ts timestamp")
    table = chain_entries(df, ["request_key"], ["ts", "request_id"], 10, F.lit(250))
    assert table.where("request_key = 'hot'").count() >= 30  # one entering state for each slice but the first


def test_slices_follow_the_busiest_key(spark):
    df = spark.createDataFrame(events(2000, 5, 4000), "request_key string, request_id long, ts timestamp")
    def seconds(rows, least=1):
        return df.limit(1).select(slice_length(df, ["request_key"], "ts", least, rows=rows).alias("s")).first()["s"]
    assert 200 <= seconds(100) <= 260 and seconds(100, least=100) == 1601 and seconds(10_000) == 1_000_000_000


def test_dedupe_without_given_slices(spark, monkeypatch):
    from tracewright.functions import fold

    monkeypatch.setattr(fold.slice_length, "__defaults__", (None, 50))
    rows = events(3000, 8, 30_000)
    df = spark.createDataFrame(rows, "request_key string, request_id long, ts timestamp")
    assert {r["request_id"]: r["hit"] for r in P.dedupe_requests(df, 20).collect()} == hits(rows, 20)
    sent = df.toDF("recipient_id", "event_id", "ts")
    assert {r["event_id"]: r["admitted"] for r in K.rate_limit(sent, 9, 60).collect()} == admitted(rows, 9, 60)


@pytest.mark.parametrize("n, seconds, slices, span", [(5, 10, 100, 6000), (3, 4, 30, 9000), (1, 2, 10, 4000), (40, 60, 400, 6000), (2, 300, 200, 6000), (8, 10, 15, 6000)])
def test_limiter_of_a_key_that_never_pauses(spark, n, seconds, slices, span):
    rows = events(3000, n, span)
    df = spark.createDataFrame(rows, "recipient_id string, event_id long, ts timestamp").repartition(5)
    out = K.rate_limit(df, n, seconds, slice_seconds=slices)
    assert out.columns == [*df.columns, "admitted"]
    assert {r["event_id"]: r["admitted"] for r in out.collect()} == admitted(rows, n, seconds)


def test_pieces_of_one_key(spark):
    rows = events(3000, 11, 6000)
    df = spark.createDataFrame(rows, "recipient_id string, event_id long, ts timestamp")
    pieces = calm_pieces(df, ["recipient_id"], ["ts", "event_id"], 12, 8, 100).where("recipient_id = 'hot'")
    counts = [r["count"] for r in pieces.groupBy("_piece").count().collect()]
    assert len(counts) >= 40 and max(counts) < 300
    assert pieces.where("_warm").groupBy("_piece").count().agg(F.max("count")).first()[0] < 12
