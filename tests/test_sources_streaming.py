import json
import os
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tracewright.operators import evidence as I
from tracewright.operators import events as K
from tracewright.operators import metrics as M
from tracewright.plans import bindings as B
from tracewright.plans.registry import Tables
from tracewright.plans.streaming import StreamTables, latest_rows
from tracewright.sources import files as S
from tracewright.streaming import carry as C
from tracewright.streaming import jobs as J
from tracewright.streaming import topics as P

SF = "/root/testdata/sf0.001"
T0 = datetime(2024, 1, 1)


def test_scan_files(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / ".git").mkdir()
    (tmp_path / "src" / "a.PY").write_bytes(b"x = 1\n")
    (tmp_path / ".git" / "config").write_text("no")
    (tmp_path / "README").write_text("hi")
    got = {r["path"]: (r["size_bytes"], r["extension"], bytes(r["content"])) for r in S.scan_files(spark, str(tmp_path)).collect()}
    assert got == {"src/a.PY": (6, "py", b"x = 1\n"), "README": (2, None, b"hi")}


def test_parsers(spark):
    lines = ["h|a|e@x|1700000000|msg|body|more", "short|line", "h|a|e|12x|m", "h|a|e||m", "plain"]
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    assert [(r["hash"], r["message"]) for r in S.parse_commit_log(df).collect()] == [("h", "msg")]
    sl = spark.createDataFrame([("  12\tAnn B <ann@x>",), ("x\tNo <n@x>",), ("3\tNobody",), ("7 no tab",)], "line string")
    assert [tuple(r) for r in S.parse_shortlog(sl).collect()] == [("Ann B", "ann@x", 12), ("Nobody", "unknown", 3)]
    a, b = "a" * 40, "B" * 40
    log = [" delete mode 100644 early", a, " delete mode 100644 p/x", " create mode 100644 y", "", b, " delete mode 100755 z"]
    df = spark.createDataFrame([("l", i, x) for i, x in enumerate(log)], "log_id string, line_no long, line string")
    for width in (1, 2, 100):  # headers found across segment borders
        got = sorted((r["hash"], r["path"]) for r in S.parse_deletions(df, width).collect())
        assert got == [("", "early"), (b, "z"), (a, "p/x")]


def test_reports_and_archive(spark, tmp_path):
    df = spark.createDataFrame([("j1", 1.5, ["x"]), ("j2", 2.0, [])], "job_id string, risk double, issues array<string>")
    S.write_report(df, str(tmp_path / "reports"))
    folder = tmp_path / "reports" / "job=j1"
    docs = [json.loads(ln) for f in os.listdir(folder) if f.endswith(".json") for ln in open(folder / f)]
    assert docs == [{"job_id": "j1", "risk": 1.5, "issues": ["x"]}]
    ev = spark.createDataFrame([(i, T0 + timedelta(hours=10 * i)) for i in range(10)], "id int, ts timestamp")
    lo, hi = F.lit(T0 + timedelta(days=1)), F.lit(T0 + timedelta(days=3))
    S.archive_events(ev, str(tmp_path / "cold"), lo, hi)
    kept = spark.read.parquet(str(tmp_path / "cold"))
    assert sorted(r["id"] for r in kept.collect()) == [3, 4, 5, 6, 7] and "day" in kept.columns
    assert sorted(r["id"] for r in S.delete_range(ev, lo, hi).collect()) == [0, 1, 2, 8, 9]


def test_retention(spark):
    df = spark.createDataFrame([("old", 5, T0 - timedelta(days=31)), ("edge", 7, T0 - timedelta(days=30)), ("new", 9, T0)], "path string, size_bytes long, modified_at timestamp")
    assert sorted(r["path"] for r in S.retention_filter(df, F.lit(T0), 30).collect()) == ["edge", "new"]
    assert {r["expired"]: r["bytes"] for r in S.retention_report(df, F.lit(T0), 30).collect()} == {True: 5, False: 16}


def test_bad_payloads_become_error_rows(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.json").write_text('{"k": 1}\nnot json\n')
    (src / "2.json").write_text('{"k": 2}\n{"k": "x"}\n')
    stream = P.read_events(spark, str(src), "k long", files_per_trigger=1)
    P.write_table(stream, str(tmp_path / "out"), "t", str(tmp_path / "ck")).awaitTermination()
    good, bad = P.split_decoded(P.read_table(spark, str(tmp_path / "out"), "t"))
    assert sorted(r["event"]["k"] for r in good.collect()) == [1, 2] and bad.count() == 2


def test_notarize_stream_equals_batch_and_restarts(spark, tmp_path):
    batch = J.notarization_outcomes(B.pipeline_events(Tables(spark, SF)), min_priority="normal")
    for _ in range(2):  # the second run finds nothing new and must not add rows
        J.notarize_stream(B.pipeline_events(StreamTables(spark, SF)), str(tmp_path / "o"), str(tmp_path / "c"), min_priority="normal").awaitTermination()
    got = None
    for t in P.OUTCOME_TABLES:
        part = P.read_table(spark, str(tmp_path / "o"), t).drop("batch_id")
        got = part if got is None else got.unionByName(part)
    cols = sorted(batch.columns)
    assert sorted(map(str, got.select(cols).collect())) == sorted(map(str, batch.select(cols).collect()))


def split_events(spark, tmp_path, parts):
    """The small event table as several files in time order, read one file per micro-batch."""
    rows = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    n = rows.count()
    src = str(tmp_path / "events")
    for i in range(parts):
        piece = rows.where((F.col("event_id") >= n * i // parts) & (F.col("event_id") < n * (i + 1) // parts))
        piece.coalesce(1).write.mode("append").parquet(src)
    return rows, spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(src)


def test_streaming_limiter_over_many_batches(spark, tmp_path):
    rows, stream = split_events(spark, tmp_path, 4)
    pick = lambda d: d.select("event_id", (F.col("user_id") % 3).alias("recipient_id"), "ts")
    C.write_rate_limited(pick(stream), str(tmp_path / "o"), str(tmp_path / "c"), 5, 36_000).awaitTermination()
    got = {r["event_id"]: r["admitted"] for r in C.read_rate_limited(spark, str(tmp_path / "o"), pick(rows)).collect()}
    want = {r["event_id"]: r["admitted"] for r in K.rate_limit(pick(rows), 5, 36_000).collect()}
    assert got == want and not all(want.values())


def test_status_stream_holds_no_state(spark, tmp_path):
    rows, stream = split_events(spark, tmp_path, 3)
    shape = lambda d: d.select(F.col("user_id").alias("workflow_id"), F.col("event_id").alias("status_id"), F.col("event_type").alias("status"), F.col("value").alias("percentage"), "ts")
    J.write_status(shape(stream), str(tmp_path / "o"), str(tmp_path / "c")).awaitTermination()
    final = J.read_status(spark, str(tmp_path / "o")).select("workflow_id", "status")
    want = I.latest_status(shape(rows)).select("workflow_id", "status")
    assert sorted(map(tuple, final.collect())) == sorted(map(tuple, want.collect()))


def test_approval_expiry(spark, tmp_path):
    src = str(tmp_path / "in")
    schema = "id string, kind string, role string, required string, deadline timestamp, ts timestamp"
    first = [("r1", "request", None, "a,b", T0 + timedelta(hours=4), T0), ("r1", "approval", "a", None, None, T0 + timedelta(hours=1)),
             ("r2", "request", None, "a", T0 + timedelta(hours=4), T0), ("r2", "approval", "a", None, None, T0 + timedelta(hours=2))]
    second = [("r1", "approval", "b", None, None, T0 + timedelta(hours=5)), ("z", "approval", "x", None, None, T0 + timedelta(hours=30))]
    third = [("z", "approval", "x", None, None, T0 + timedelta(hours=40))]
    for part in (first, second, third):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    C.write_approvals(stream, str(tmp_path / "o"), str(tmp_path / "c")).awaitTermination()
    got = sorted(tuple(r) for r in C.read_approvals(spark, str(tmp_path / "o"), stream).select("id", "state", "missing").collect())
    assert got == [("r1", "expired", "b"), ("r2", "approved", "")]


def test_approvals_are_kept_until_their_request(spark, tmp_path):
    src = str(tmp_path / "in")
    schema = "id string, kind string, role string, required string, deadline timestamp, ts timestamp"
    day = timedelta(days=1)
    parts = [
        [("early", "approval", "a", None, None, T0), ("late", "approval", "a", None, None, T0 + timedelta(hours=30)), ("open", "request", None, "a", None, T0)],
        [("tick", "approval", "x", None, None, T0 + 20 * day)],
        [("early", "request", None, "a", T0 + 40 * day, T0 + 21 * day), ("late", "request", None, "a", T0 + timedelta(hours=20), T0 + 21 * day), ("open", "approval", "a", None, None, T0 + 30 * day)],
        [("tick", "approval", "x", None, None, T0 + 60 * day)],
    ]
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    C.write_approvals(stream, str(tmp_path / "o"), str(tmp_path / "c")).awaitTermination()
    got = sorted(tuple(r) for r in C.read_approvals(spark, str(tmp_path / "o"), stream).select("id", "state", "missing").collect())
    assert got == [("early", "approved", ""), ("late", "expired", "a"), ("open", "approved", "")]


def test_a_quiet_point_ends_a_streamed_run(spark, tmp_path):
    src = str(tmp_path / "in")
    minute = timedelta(minutes=1)
    swing = [("swing", i, 30.0 if i % 2 else 1.0, T0 + i * minute) for i in range(60)]
    steady = [("steady", 100 + i, 30.0 if i < 50 else 1.0, T0 + i * minute) for i in range(60)]
    rows = swing + steady + [("end", 999, 1.0, T0 + timedelta(hours=5))]
    schema = "name string, id long, value double, ts timestamp"
    for part in (rows[:30] + rows[60:90], rows[30:60] + rows[90:120], rows[120:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    C.write_alert_updates(stream, str(tmp_path / "o"), str(tmp_path / "c"), 15, 1800).awaitTermination()
    got = [(r["name"], r["started_at"], r["points"]) for r in C.read_alert_updates(spark, str(tmp_path / "o")).where("ended").collect()]
    assert [(n, p) for n, _, p in got] == [("steady", 50)]
    batch = M.sustained_alerts(spark.createDataFrame(rows, schema), 15, 1800).collect()
    assert [(r["name"], r["started_at"], r["points"]) for r in batch] == got


def test_a_run_that_lasts_is_alerted(spark, tmp_path):
    src, minute = str(tmp_path / "in"), timedelta(minutes=1)
    rows = [("lasts", i, 30.0, T0 + i * minute) for i in range(120)]
    rows += [("late end", 200 + i, 30.0 if i < 118 else 1.0, T0 + i * minute) for i in range(120)]
    rows += [("short", 400 + i, 30.0 if i > 95 else 1.0, T0 + i * minute) for i in range(120)]
    schema = "name string, id long, value double, ts timestamp"
    for part in ([r for r in rows if r[3] < T0 + 60 * minute], [r for r in rows if r[3] >= T0 + 60 * minute], [(None, 0, None, T0 + timedelta(days=1))]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    C.write_alert_updates(stream, str(tmp_path / "o"), str(tmp_path / "c"), 15, 1800).awaitTermination()
    told = C.read_alert_updates(spark, str(tmp_path / "o"))
    first = told.where("batch_id = 1 AND NOT ended").count() + told.where("batch_id = 2 AND NOT ended").count()
    assert first > 0  # before the input ended
    got = sorted((r["name"], r["ended_at"], r["points"], r["ended"]) for r in latest_rows(told, ["name", "started_at", "first_id"]).collect())
    assert got == [("lasts", T0 + 119 * minute, 120, False), ("late end", T0 + 117 * minute, 118, True)]
    batch = M.sustained_alerts(spark.createDataFrame(rows, schema), 15, 1800).collect()
    assert sorted((r["name"], r["ended_at"], r["points"]) for r in batch) == [r[:3] for r in got]


def test_windows_match_batch(spark, tmp_path):
    rows, stream = split_events(spark, tmp_path, 3)
    shape = lambda d: d.select(F.col("event_type").alias("name"), "value", "ts")
    P.write_table(J.windowed_metrics(shape(stream), "2 days"), str(tmp_path / "o"), "t", str(tmp_path / "c")).awaitTermination()
    got = {(r["name"], r["window_start"]): r["points"] for r in P.read_table(spark, str(tmp_path / "o"), "t").collect()}
    want = {(r["name"], r["window_start"]): r["points"] for r in J.windowed_metrics(shape(rows), "2 days").collect()}
    assert got and all(want[k] == n for k, n in got.items())
    open_windows = set(want) - set(got)
    assert {w for _, w in open_windows} <= {max(w for _, w in want)}


def test_carried_state_survives_restarts_and_disorder(spark, tmp_path):
    """Points that swap places between micro-batches, within the delay, change nothing; nor does a restart after each."""
    import random

    rnd = random.Random(6)
    minute = timedelta(minutes=1)
    rows = [(f"n{i % 3}", i, 30.0 if rnd.random() < 0.9 else 1.0, T0 + i * minute) for i in range(400)]
    order = sorted(rows, key=lambda r: (r[3] + rnd.randrange(8) * minute))
    schema = "name string, id long, value double, ts timestamp"
    src = str(tmp_path / "in")
    for k in range(5):
        part = order[80 * k:80 * (k + 1)] + ([(None, 0, None, T0 + timedelta(days=2))] if k == 4 else [])
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
        C.write_alert_updates(spark.readStream.schema(schema).parquet(src), str(tmp_path / "o"), str(tmp_path / "c"), 15, 900).awaitTermination()
    got = latest_rows(C.read_alert_updates(spark, str(tmp_path / "o")), ["name", "started_at", "first_id"])
    batch = M.sustained_alerts(spark.createDataFrame(rows, schema), 15, 900)
    cols = ["name", "started_at", "ended_at", "points", "peak"]
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, batch.select(*cols).collect()))
    open_rows = spark.read.parquet(str(tmp_path / "o") + "/steps").groupBy("batch_id", "part").count().where("part = 'open'").collect()
    assert open_rows and max(r["count"] for r in open_rows) <= 3


def test_a_decided_request_is_not_asked_again(spark, tmp_path):
    src, hour = str(tmp_path / "in"), timedelta(hours=1)
    schema = "id string, kind string, role string, required string, deadline timestamp, ts timestamp"
    parts = [
        [("r", "request", None, "a,a", T0 + 4 * hour, T0), ("r", "approval", "a", None, None, T0 + hour), ("forever", "request", None, "a", None, T0)],
        [("r", "request", None, "b", T0 + 4 * hour, T0 + 2 * hour), ("free", "request", None, None, T0 + 4 * hour, T0 + 3 * hour)],
        [("tick", "approval", "x", None, None, T0 + 20 * hour), ("forever", "approval", "a", None, None, T0 + 19 * hour)],
    ]
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    C.write_approvals(stream, str(tmp_path / "o"), str(tmp_path / "c")).awaitTermination()
    got = sorted(tuple(r) for r in C.read_approvals(spark, str(tmp_path / "o"), stream).collect())
    assert got == [("forever", "approved", "", 2), ("free", "approved", "", 1), ("r", "approved", "", 0)]


def test_limits_hold_across_batches_and_late_events(spark, tmp_path):
    src = str(tmp_path / "in")
    at = lambda s: T0 + timedelta(seconds=s)
    schema = "recipient_id string, event_id long, ts timestamp"
    parts = [[("a", 1, at(0)), ("a", 2, at(50)), ("a", 3, at(55)), ("b", 4, at(0))], [("a", 5, at(40)), ("a", 6, at(61)), ("a", 7, at(62))], [("a", 8, at(111)), ("b", 9, at(59)), ("b", 10, at(70))]]
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    C.write_rate_limited(stream, str(tmp_path / "o"), str(tmp_path / "c"), 2, 60).awaitTermination()
    got = {r["event_id"]: r["admitted"] for r in C.read_rate_limited(spark, str(tmp_path / "o"), stream).collect()}
    assert got == {1: True, 2: True, 3: False, 4: True, 5: False, 6: True, 7: False, 8: True, 9: True, 10: True}
