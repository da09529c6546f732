"""Registered queries: streaming jobs run to the end of the given tables, read back from their sinks."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.plans import bindings as B
from tracewright.plans.evidence import SQL_EVENT_ERROR, SQL_ROUTE, STATUS, TYPE, status_rows
from tracewright.plans.registry import Tables, query
from tracewright.streaming import carry as C
from tracewright.streaming import jobs as J
from tracewright.streaming import topics as S


class StreamTables(Tables):
    """The given tables as streams of their files; a table is a file or a folder of files."""

    def __getattr__(self, name: str) -> DataFrame:
        schema = self.spark.read.parquet(f"{self.folder}/{name}.parquet").schema
        return self.spark.readStream.schema(schema).parquet(f"{self.folder}/{name}.parque[t]")


def _streams(t):
    return StreamTables(t.spark, t.folder)


PARTS = 4


def run_parts(t, name, start, closing=None):
    """Feed the events to a stream in consecutive slices of time, a micro-batch each, and return the run folder.

    ``closing(events)`` gives rows that end the input, as part of the last slice.

    ``start(tables, folder, checkpoint)`` starts the query over the slices written so far; it is resumed from
    its checkpoint after each.
    """
    folder = S.new_run_folder(t.spark, name)
    bounds = t.events.agg(F.percentile_approx("ts", [k / PARTS for k in range(1, PARTS)]).alias("b")).first()["b"] or []
    edges = [None, *bounds, None]

    class Slices(Tables):
        def __getattr__(self, table):
            return self.spark.readStream.schema(t.events.schema).parquet(f"{folder}/in")

    for low, high in zip(edges[:-1], edges[1:]):
        inside = F.lit(True) if low is None else F.col("ts") >= F.lit(low)
        inside = inside if high is None else inside & (F.col("ts") < F.lit(high))
        rows = t.events.where(inside)
        rows = rows.union(closing(t.events)) if closing is not None and high is None else rows
        rows.write.mode("append").parquet(f"{folder}/in")
        start(Slices(t.spark, t.folder), folder, f"{folder}/checkpoint").awaitTermination()
    return folder


def latest_rows(rows, keys):
    """Of the rows that an update-mode stream wrote for a key, those of its last micro-batch."""
    values = [c for c in rows.columns if c not in (*keys, "batch_id")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch_id").alias("_v")).select(*keys, "_v.*")


PIPE = B.SQL_PIPELINE
KEPT = f"SELECT *, {TYPE} AS etype, {SQL_EVENT_ERROR} AS bad, {SQL_ROUTE} AS route FROM ({PIPE}) WHERE source IN ('src0', 'src1', 'src2', '') AND priority <> 'low'"


# The package of an event as JSON: fixed field order, null fields left out, metadata keys sorted.
PACKAGE = """base64(unhex(sha256('{"spec_version":"1.0.0","timestamp_utc":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z","event_type":"' || etype ||
  '","actor":{"type":"service","id":"' || actor_id || '"},"artifacts":[{"name":"' || name1 || '","uri":"s3://bucket/a","hash_sha256":"' || hash1 || '"}' ||
  CASE WHEN two THEN ',{"name":"report","hash_sha256":"' || hash2 || '"}' ELSE '' END || '],"metadata":{"kind":"' || event_type || '","props":"' || replace(props, '"', chr(92) || '"') || '"}}')))"""


@query("k16_notarize_stream", f"""
SELECT seq, event_id, coalesce(route, 'none') || '-signing-' || event_id AS workflow_id, CASE WHEN bad IS NULL AND route IS NOT NULL THEN {PACKAGE} END AS package_hash, CASE WHEN bad IS NOT NULL OR route IS NULL THEN 'error' WHEN route = 'simple' THEN 'result' ELSE 'status' END AS outcome, etype AS event_type, route,
  coalesce(bad, CASE WHEN route IS NULL THEN 'Custom workflow not supported: custom_flow' END) AS message,
  CASE WHEN bad IS NOT NULL OR route IS NULL THEN 'failed' WHEN route = 'simple' THEN 'completed' WHEN route = 'approval' THEN 'pending_approval' ELSE 'processing' END AS status FROM ({KEPT})""")
def k16(t):
    folder = S.new_run_folder(t.spark, "notarize")
    J.notarize_stream(B.pipeline_events(_streams(t)), folder, f"{folder}/checkpoint",
                      sources=["src0", "src1", "src2", ""], min_priority="normal").awaitTermination()
    out = None
    for table in S.OUTCOME_TABLES:
        part = S.read_table(t.spark, folder, table).select("seq", "event_id", "workflow_id", "package_hash", "outcome", "event_type", "route", "message", "status")
        out = part if out is None else out.unionByName(part)
    return out


def stream_points(t):
    return t.events.select(F.col("event_type").alias("name"), F.floor("value").alias("value"), F.col("ts").cast("timestamp").alias("ts"))


def _windows(size, slide):
    return f"""SELECT event_type AS name, CAST(floor(value) AS BIGINT) AS v, time_bucket(INTERVAL {slide}, ts) - i * INTERVAL {slide} AS w
  FROM events, range(CAST(epoch(INTERVAL {size}) / epoch(INTERVAL {slide}) AS BIGINT)) r(i)"""


def _windowed(t, name, size):
    """Update mode: a window's state ends behind the watermark, its last update is the result."""
    def start(tables, folder, checkpoint):
        return S.write_table(J.windowed_metrics(stream_points(tables), size, None, "1 hour"), folder, "out", checkpoint, "update")

    rows = S.read_table(t.spark, run_parts(t, name, start), "out")
    return latest_rows(rows, ["name", "window_start", "window_end"])


def closing_row(events):
    """One row of no name and no value a day behind all others, so that the watermark passes them."""
    last = events.agg((F.max(F.col("ts").cast("timestamp")) + F.expr("INTERVAL 1 DAY")).alias("ts")).where("ts IS NOT NULL")
    given = {"ts": F.col("ts"), "event_id": F.lit(0)}
    return last.select(*[given.get(c, F.lit(None)).cast(kind).alias(c) for c, kind in events.dtypes])


@query("k17_tumbling_metrics", f"""
SELECT name, strftime(w, '%Y-%m-%d %H') AS window_start, count(*) AS points, CAST(sum(v) AS BIGINT) AS total, max(v) AS peak FROM ({_windows('6 HOUR', '6 HOUR')}) GROUP BY name, w""")
def k17(t):
    return _windowed(t, "tumbling", "6 hours").select(
        "name", F.date_format("window_start", "yyyy-MM-dd HH").alias("window_start"), "points", "total", "peak")


@query("k17_sliding_metrics", f"""
SELECT name, strftime(w, '%Y-%m-%d %H') AS window_start, count(*) AS points, CAST(sum(v) AS BIGINT) AS total, max(v) AS peak FROM ({_windows('12 HOUR', '3 HOUR')}) GROUP BY name, w""")
def k17s(t):
    """Append mode: panes of 3 hours are added up to windows, each of which comes once."""
    def start(tables, folder, checkpoint):
        return S.write_table(J.windowed_metrics(stream_points(tables), "12 hours", "3 hours", "1 hour"), folder, "out", checkpoint)

    rows = S.read_table(t.spark, run_parts(t, "sliding", start, closing_row), "out").where("name IS NOT NULL")
    return rows.select(
        "name", F.date_format("window_start", "yyyy-MM-dd HH").alias("window_start"), "points", "total", "peak")


@query("k18_stream_sustained_alerts", """
WITH p AS (SELECT event_type AS name, event_id AS id, ts, CAST(floor(value) AS DOUBLE) AS value, floor(value) > 15 AS hot FROM events),
i AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY ts, id) - row_number() OVER (PARTITION BY name, hot ORDER BY ts, id) AS island,
  lead(hot) OVER (PARTITION BY name ORDER BY ts, id) AS next FROM p)
SELECT name, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started_at, count(*) AS points, max(value) AS peak
FROM i WHERE hot GROUP BY name, island HAVING bool_or(next IS NOT NULL AND NOT next) AND date_sub('second', min(ts), max(ts)) >= 1800""")
def k18s(t):
    """Runs that a quiet point has ended; k18_stream_alert_updates has all."""
    def start(tables, folder, checkpoint):
        points = tables.events.select(
            F.col("event_type").alias("name"), F.col("event_id").alias("id"), F.floor("value").alias("value"), F.col("ts").cast("timestamp").alias("ts"))
        return C.write_alert_updates(points, folder, checkpoint, 15, 1800)

    out = C.read_alert_updates(t.spark, run_parts(t, "alerts", start, closing_row)).where("ended")
    return out.select("name", F.date_format("started_at", "yyyy-MM-dd HH:mm:ss").alias("started_at"), "points", "peak")


@query("k20_stream_status", f"""
SELECT user_id AS workflow_id, max_by({B.sql_case(STATUS, 'event_type')}, (ts, event_id)) AS status, max_by(CAST(floor(value) AS BIGINT), (ts, event_id)) AS percentage, count(*) AS updates FROM events GROUP BY user_id""")
def k20(t):
    folder = run_parts(t, "status", lambda tables, folder, checkpoint: J.write_status(status_rows(tables), folder, checkpoint))
    return J.read_status(t.spark, folder).select("workflow_id", "status", "percentage", "updates")


@query("k8_stream_rate_limit", """
WITH RECURSIVE r AS MATERIALIZED (SELECT user_id % 20 AS k, event_id, ts, row_number() OVER (PARTITION BY user_id % 20 ORDER BY ts, event_id) AS rn FROM events),
c AS (SELECT k, rn, event_id, [ts] AS recent, true AS admitted FROM r WHERE rn = 1
  UNION ALL SELECT k, rn, event_id, CASE WHEN len(live) < 4 THEN list_append(live, ts) ELSE live END, len(live) < 4 FROM (
    SELECT r.k, r.rn, r.event_id, r.ts, list_filter(c.recent, lambda x: x > r.ts - INTERVAL 21600 SECOND) AS live FROM c JOIN r ON r.k = c.k AND r.rn = c.rn + 1))
SELECT event_id, k AS recipient_id, admitted FROM c""")
def k8s(t):
    def sent(tables):
        return tables.events.select("event_id", (F.col("user_id") % 20).alias("recipient_id"), F.col("ts").cast("timestamp").alias("ts"))

    folder = run_parts(t, "limiter", lambda tables, folder, checkpoint: C.write_rate_limited(sent(tables), folder, checkpoint, 4, 21_600))
    return C.read_rate_limited(t.spark, folder, sent(t)).select("event_id", "recipient_id", "admitted")


def approval_stream(t):
    """Requests from sign-ups; each later event of the user is an approval by the role named after its type."""
    e = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    ask = F.col("event_type") == "signup"
    return e.select(
        F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMdd")).alias("id"),
        F.when(ask, "request").otherwise("approval").alias("kind"), F.when(~ask, F.col("event_type")).alias("role"),
        F.when(ask, F.lit("click,view")).alias("required"),
        F.when(ask, F.date_trunc("DAY", "ts") + F.make_dt_interval(hours=F.lit(12))).alias("deadline"), "ts")


@query("k19_approval_timeouts", """
WITH r AS (SELECT user_id || '-' || strftime(ts, '%Y%m%d') AS id, event_type, ts FROM events),
a AS (SELECT id, bool_or(event_type = 'signup') AS asked, coalesce(bool_or(event_type = 'click' AND hour(ts) < 12), false) AS c, coalesce(bool_or(event_type = 'view' AND hour(ts) < 12), false) AS v FROM r GROUP BY id)
SELECT id, CASE WHEN c AND v THEN 'approved' ELSE 'expired' END AS state, array_to_string(list_filter([CASE WHEN NOT c THEN 'click' END, CASE WHEN NOT v THEN 'view' END], lambda x: x IS NOT NULL), ',') AS missing
FROM a WHERE asked AND (c AND v OR strptime(right(id, 8), '%Y%m%d') + INTERVAL 12 HOUR < (SELECT max(ts) - INTERVAL 1 HOUR FROM events))""")
def k19(t):
    folder = run_parts(t, "approvals", lambda tables, folder, checkpoint: C.write_approvals(approval_stream(tables), folder, checkpoint))
    return C.read_approvals(t.spark, folder, approval_stream(t)).select("id", "state", "missing")
