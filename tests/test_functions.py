"""Ordered windows, folds and heavy-key joins against plain Python, with one key holding half the rows."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.functions import ordered as O
from tracewright.functions.fold import fold_sorted, islands
from tracewright.functions.lines import explode_lines, line_count, occurrences, trimmed
from tracewright.functions.skew import join_counted

START = datetime(2024, 1, 1)


def rows(n=600, seed=5):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        key = "hot" if rnd.random() < 0.5 else f"k{rnd.randrange(12)}"
        out.append((key, i, START + timedelta(seconds=rnd.randrange(40_000)), rnd.randrange(50)))
    return out


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(rows(), "k string, id long, ts timestamp, v long").repartition(5)


def by_key(data):
    out = {}
    for r in sorted(data, key=lambda r: (r[2], r[1])):
        out.setdefault(r[0], []).append(r)
    return out


def seg():
    return O.time_segment(F.col("ts"), 3600)


def test_previous_row(frame):
    got = {r["id"]: r["prev_v"] for r in O.previous_row(frame, ["k"], ["ts", "id"], ["v"], seg()).collect()}
    want = {}
    for items in by_key(rows()).values():
        before = None
        for r in items:
            want[r[1]] = before
            before = r[3]
    assert got == want


def test_auto_segment_cuts_busy_keys_only(frame):
    cut = frame.withColumn("s", O.auto_segment(frame, ["k"], "ts", 20)).groupBy("k", "s").count()
    assert cut.where("k = 'hot'").count() > 5
    whole = frame.withColumn("s", O.auto_segment(frame, ["k"], "ts")).select("s").distinct()
    assert whole.count() == 1
    got = {r["id"]: r["prev_v"] for r in O.previous_row(frame, ["k"], ["ts", "id"], ["v"], O.auto_segment(frame, ["k"], "ts", 20)).collect()}
    want = {r["id"]: r["prev_v"] for r in O.previous_row(frame, ["k"], ["ts", "id"], ["v"], seg()).collect()}
    assert got == want


def test_running_sum_and_index(frame):
    got = {r["id"]: r["s"] for r in O.running_sum(frame, ["k"], ["ts", "id"], F.col("v"), seg(), "s").collect()}
    index = {r["id"]: r["i"] for r in O.row_index(frame, ["k"], ["ts", "id"], seg(), "i").collect()}
    for items in by_key(rows()).values():
        total = 0
        for i, r in enumerate(items):
            total += r[3]
            assert got[r[1]] == total and index[r[1]] == i + 1


def test_last_known(frame):
    value = F.when(F.col("v") % 7 == 0, F.col("v"))
    got = {r["id"]: r["f"] for r in O.last_known(frame, ["k"], ["ts", "id"], value, seg(), "f").collect()}
    for items in by_key(rows()).values():
        last = None
        for r in items:
            last = r[3] if r[3] % 7 == 0 else last
            assert got[r[1]] == last


def test_run_ids_number_islands(frame):
    got = {r["id"]: r["_island"] for r in islands(frame, ["k"], ["ts", "id"], 300, 3600).collect()}
    for items in by_key(rows()).values():
        run, before = 0, None
        for r in items:
            if before is not None and (r[2] - before).total_seconds() > 300:
                run += 1
            before = r[2]
            assert got[r[1]] == run


@pytest.mark.parametrize("parts", [1, 4, 13])
def test_fold_does_not_depend_on_partitions(frame, parts):
    def step(state, second):
        return state + 1, state + 1

    out = fold_sorted(frame.repartition(parts), ["k"], ["ts", "id"], "n", T.LongType(), lambda: 0, step)
    got = {r["id"]: r["n"] for r in out.collect()}
    for items in by_key(rows()).values():
        assert [got[r[1]] for r in items] == list(range(1, len(items) + 1))


def test_join_counted_with_heavy_keys(frame):
    groups = frame.groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("top"))
    for shares in (2, 5, 1000):  # one heavy key, a few, all of them
        out = join_counted(frame, groups, "k", "n", shares, salt=["id"])
        assert out.columns == ["k", "id", "ts", "v", "n", "top"]
        plain = frame.join(groups, "k").select(out.columns)
        assert sorted(map(tuple, out.collect())) == sorted(map(tuple, plain.collect()))


def test_join_counted_drops_rows_without_a_group(frame):
    groups = frame.where("k <> 'k3'").groupBy("k").agg(F.count("*").alias("n"))
    assert join_counted(frame, groups, "k", "n", salt=["id"]).where("k = 'k3'").count() == 0


def test_lines(spark):
    texts = ["", "a", "a\n", "a\r\nb\r\n", "\n", "a\n\n", "\n\n x "]
    want = {"": [], "a": ["a"], "a\n": ["a"], "a\r\nb\r\n": ["a", "b"], "\n": [""], "a\n\n": ["a", ""], "\n\n x ": ["", "", " x "]}
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, content string")
    got = {}
    for r in explode_lines(df).collect():
        got.setdefault(r["i"], []).append((r["line_number"], r["line"]))
    for i, t in enumerate(texts):
        assert [x for _, x in sorted(got.get(i, []))] == want[t]
    counts = {r["i"]: r["n"] for r in df.select("i", line_count(F.col("content")).alias("n")).collect()}
    assert [counts[i] for i in range(len(texts))] == [len(want[t]) for t in texts]


def test_trim_and_occurrences(spark):
    r = spark.range(1).select(
        trimmed(F.lit("\t　 x y \r\n")).alias("t"), occurrences(F.lit("aaaa"), "aa").alias("n")).first()
    assert (r["t"], r["n"]) == ("x y", 2)


def test_salt_stays_a_key_of_the_shuffle(frame):
    groups = frame.groupBy("k").agg(F.count("*").alias("n"))
    frame.sparkSession.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = join_counted(frame, groups, "k", "n", salt=["id"])._jdf.queryExecution().executedPlan().toString()
    finally:
        frame.sparkSession.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    joins = [line for line in plan.splitlines() if "SortMergeJoin" in line]
    assert joins and all("_salt" in line for line in joins)
