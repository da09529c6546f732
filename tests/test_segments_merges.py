"""Seals over segments, merges that touch few folders, panes of sliding windows, roots with a scheme."""

import os
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tracewright.operators import integrity as H
from tracewright.operators import reports as G
from tracewright.sources import files as S
from tracewright.streaming import jobs as J

T0 = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def sealed(spark):
    rows = [(s, T0 + timedelta(hours=7 * i), i, f"{i:064x}") for s in ("a", "b#x") for i in range(40)]
    df = spark.createDataFrame(rows, "stream string, ts timestamp, seq long, data_hash string")
    ledger = H.build_chain(H.segment_streams(df, 86_400)).cache()
    return ledger, H.seal_segments(ledger, 86_400).cache()


def problems(ledger, seals, heads=None):
    return sorted((r["segment"], r["problem"]) for r in H.verify_segments(ledger, seals, heads).collect())


def test_whole_segments_verify(sealed):
    ledger, seals = sealed
    assert problems(ledger, seals, H.chain_tips(seals)) == []
    names = [r["segment"] for r in seals.where("stream = 'b#x'").orderBy("index").collect()]
    assert names == sorted(names) and len(names) == 12 and all(n.startswith("b#x#") for n in names)


def test_dropped_added_and_altered_segments(sealed):
    ledger, seals = sealed
    third = [r["segment"] for r in seals.where("stream = 'a'").orderBy("index").collect()][2]
    rest = ledger.where(F.col("stream") != third)
    assert problems(rest, seals) == [(third, "missing")]
    assert problems(ledger.where((F.col("stream") != third) | (F.col("index") < 2)), seals) == [(third, "altered")]
    # a seal taken out with its segment breaks the chain of seals behind it
    after = [r["segment"] for r in seals.where("stream = 'a'").orderBy("index").collect()][3]
    assert problems(rest, seals.where(F.col("segment") != third)) == [(after, "broken")]
    assert problems(ledger, seals.where(F.col("segment") != third)) == [(third, "unsealed"), (after, "broken")]
    # the last ones can only be missed against the kept heads
    last = [r["segment"] for r in seals.where("stream = 'a'").orderBy("index").collect()][-1]
    cut, short = ledger.where(F.col("stream") != last), seals.where(F.col("segment") != last)
    assert problems(cut, short) == [] and problems(cut, short, H.chain_tips(seals)) == [("a", "truncated")]


def files_of(path):
    return {os.path.join(d, f) for d, _, names in os.walk(path) for f in names if f.startswith("part-")}


def test_a_merge_leaves_other_folders_alone(spark, tmp_path):
    path, schema = str(tmp_path / "table"), "url string, analyzed_at long, size long"
    first = spark.createDataFrame([(f"u{i}", i, i) for i in range(200)], schema)
    G.merge_repositories(spark, path, first, ["size"], buckets=32, batch_id=0)
    before = files_of(path)
    batch = spark.createDataFrame([("u7", 500, 9), ("u7", 501, 10), ("new", 502, 1), (None, 1, 1)], schema)
    for _ in range(2):  # the second time is a replay
        G.merge_repositories(spark, path, batch, ["size"], buckets=32, batch_id=1)
    kept = before & files_of(path)
    assert len({os.path.dirname(f) for f in before}) >= 30 and len({os.path.dirname(f) for f in before - kept}) <= 2
    rows = {r["url"]: r for r in spark.read.parquet(path).collect()}
    assert len(rows) == 201 and (rows["u7"]["analysis_count"], rows["u7"]["size"], rows["u7"]["first_analyzed"], rows["u7"]["last_analyzed"]) == (3, 10, 7, 501)
    assert rows["new"]["analysis_count"] == 1 and rows["u8"]["analysis_count"] == 1
    assert [r.asDict() for r in G.upsert_repositories(
        first.select("url", F.lit(1).cast("long").alias("analysis_count"), F.col("analyzed_at").alias("first_analyzed"), F.col("analyzed_at").alias("last_analyzed"), "size"),
        batch.where("url IS NOT NULL"), ["size"]).where("url = 'u7'").collect()] == [{"url": "u7", "analysis_count": 3, "first_analyzed": 7, "last_analyzed": 501, "size": 10}]


@pytest.mark.parametrize("size, slide", [("6 hours", "2 hours"), ("5 hours", "2 hours"), ("1 day", "90 minutes")])
def test_panes_equal_windows_over_points(spark, size, slide):
    rows = [(f"n{i % 3}", float(i), T0 + timedelta(minutes=37 * i)) for i in range(300)]
    df = spark.createDataFrame(rows, "name string, value double, ts timestamp")
    plain = df.groupBy("name", F.window("ts", size, slide).alias("w")).agg(F.count("*").alias("points"), F.sum("value").alias("total"), F.max("value").alias("peak")).select(
        "name", "w.start", "w.end", "points", "total", "peak")
    panes = J.windowed_metrics(df, size, slide)
    assert sorted(map(tuple, panes.collect())) == sorted(map(tuple, plain.collect()))
    plan = panes._jdf.queryExecution().executedPlan().toString().splitlines()
    below = plan[max(i for i, line in enumerate(plan) if "Exchange" in line):]
    assert not any("Expand" in line for line in below)  # a point is one row before the first shuffle


def test_relative_paths_of_any_root(spark, tmp_path):
    root = tmp_path / "x y" / "repo"
    (root / "src").mkdir(parents=True)
    (root / "src" / "a.py").write_text("print()")
    for given in (str(root), str(root) + "/", f"file:{root}"):
        assert [r["path"] for r in S.scan_files(spark, given, False).collect()] == ["src/a.py"]
