"""Streaming jobs whose state is a table.

Each micro-batch reads what the one before carried, merges it with its own rows by the batch operators, and
writes results and carried rows in one idempotent step: a replayed micro-batch reads the same carried rows and
overwrites its own folder. Nothing is held per key in Python, and a hot key is cut as in the batch operators.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tracewright.functions.ordered import run_ids, segment_of
from tracewright.operators.events import rate_limit


TEXT, LONG, DOUBLE, FLAG, TIME = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampType()


def _struct(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])


def carry_forward(
    stream: DataFrame, folder: str, checkpoint: str, schema: T.StructType, advance: Callable[[DataFrame, DataFrame], DataFrame]
) -> StreamingQuery:
    """Write ``advance(batch, step before)`` of every micro-batch; its column ``part`` tells results (out) from carried rows."""
    def save(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = spark.read.schema(schema).parquet(f"{folder}/steps/batch_id={batch_id - 1}") if batch_id else spark.createDataFrame([], schema)
        advance(batch, before).select(*schema.names).write.mode("overwrite").partitionBy("part").parquet(f"{folder}/steps/batch_id={batch_id}")

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(save).trigger(availableNow=True).start()


def read_steps(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """Results of all micro-batches, with ``batch_id``."""
    named = T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])
    return spark.read.schema(named).parquet(f"{folder}/steps").where("part = 'out'").drop("part")


def _newest(rows: DataFrame) -> int | None:
    """Microseconds of the latest ``ts``: one value on the driver."""
    return rows.agg(F.unix_micros(F.max("ts"))).first()[0]


def _clock(batch: DataFrame, before: DataFrame, delay_us: int) -> tuple[int | None, int | None, int | None]:
    """(latest time so far, watermark before, watermark now)."""
    known = _newest(before.where("part = 'clock'"))
    newest = max((x for x in (known, _newest(batch)) if x is not None), default=None)
    behind = lambda x: None if x is None else x - delay_us
    return newest, behind(known), behind(newest)


def _clock_row(spark: SparkSession, newest: int | None) -> DataFrame:
    return spark.range(1).select(F.lit("clock").alias("part"), F.timestamp_micros(F.lit(newest).cast("long")).alias("ts"))


def _one_of(parts: Column, rows: DataFrame) -> DataFrame:
    """Rows once for each part they belong to; nulls are none."""
    return rows.withColumn("part", F.explode(F.array_compact(parts)))


ALERT_STEP = _struct(
    name=TEXT, ts=TIME, id=LONG, value=DOUBLE, started_at=TIME, points=LONG, peak=DOUBLE, first_id=LONG, ended=FLAG, part=TEXT)


def write_alert_updates(
    points: DataFrame, folder: str, checkpoint: str, threshold: float, duration_seconds: int, delay_seconds: int = 600
) -> StreamingQuery:
    """Alerts of runs of consecutive breaching points(name, id, ts, value), from the duration on.

    Points wait (part held) until the latest time seen is ``delay_seconds`` past them, so runs are built in order; the last
    run of a name, if it still lasts, is one carried row (part open). A run gives a result once its points
    span the duration, one whenever a micro-batch adds to it, and a last one with ``ended`` when a quiet point follows.
    (name, started_at, first_id) names the run; the row of its latest micro-batch holds. Points later than the
    delay are left out, points without a name too. A bounded input needs a closing row, later than all others
    by more than the delay, or its last points stay held.
    """
    def advance(batch: DataFrame, before: DataFrame) -> DataFrame:
        newest, old_mark, mark = _clock(batch, before, delay_seconds * 1_000_000)
        t = F.unix_micros("ts")
        own = ["name", "ts", "id", "value"]
        rows = batch.select("name", "ts", F.col("id").cast("long").alias("id"), F.col("value").cast("double").alias("value")).where("name IS NOT NULL")
        rows = (rows if old_mark is None else rows.where(t >= old_mark)).unionByName(before.where("part = 'held'").select(*own))
        ready = F.lit(False) if mark is None else t < mark
        single = rows.where(ready).withColumns({
            "started_at": F.col("ts"), "points": F.lit(1).cast("long"), "peak": F.col("value"), "first_id": F.col("id"), "_new": F.lit(1)})
        lasting = before.where("part = 'open'").select(*own, "started_at", "points", "peak", "first_id", F.lit(0).alias("_new"))
        feed = single.unionByName(lasting).withColumn("_hot", F.col("value") > threshold)
        keys, order = ["name"], ["ts", "id"]
        runs = run_ids(feed, keys, order, ["_hot"], lambda a, b: a["_hot"] != b["_hot"], segment_of(feed, keys, "ts", None), "_run")
        place = F.struct("ts", "id")
        last = runs.groupBy("name").agg(F.max_by("_run", place).alias("_run")).withColumn("_open", F.lit(True))
        whole = runs.where("_hot").groupBy("name", "_run").agg(
            F.max(place).alias("_end"), F.max("value").alias("value"), F.min("started_at").alias("started_at"), F.sum("points").alias("points"),
            F.max("peak").alias("peak"), F.min_by("first_id", place).alias("first_id"), F.sum("_new").alias("_new")
        ).join(last, ["name", "_run"], "left").withColumns({"ts": F.col("_end.ts"), "id": F.col("_end.id"), "ended": F.col("_open").isNull()})
        long = F.timestamp_diff("SECOND", F.col("started_at"), F.col("ts")) >= duration_seconds
        told = _one_of(F.array(F.when(long & (F.col("ended") | (F.col("_new") > 0)), "out"), F.when(~F.col("ended"), "open")), whole)
        held = rows.where(~ready).withColumn("part", F.lit("held"))
        clock = _clock_row(batch.sparkSession, newest)
        return told.select(*ALERT_STEP.names).unionByName(held, allowMissingColumns=True).unionByName(clock, allowMissingColumns=True)

    return carry_forward(points, folder, checkpoint, ALERT_STEP, advance)


def read_alert_updates(spark: SparkSession, folder: str) -> DataFrame:
    return read_steps(spark, folder, ALERT_STEP).select("name", "started_at", F.col("ts").alias("ended_at"), "points", "peak", "first_id", "ended", "batch_id")


def _limit_step(routed: DataFrame) -> T.StructType:
    fields = [routed.schema[c] for c in ("recipient_id", "event_id")]
    return T.StructType([*fields, *_struct(ts=TIME, at=TIME, admitted=FLAG, part=TEXT).fields])


def write_rate_limited(
    routed: DataFrame, folder: str, checkpoint: str, n: int = 100, seconds: int = 3600, delay_seconds: int = 600
) -> StreamingQuery:
    """At most n admitted events(recipient_id, event_id, ts) of a recipient in any window, over all micro-batches.

    The latest n admissions of a recipient are carried and come first in the batch limiter, which admits them
    again. An event that comes after later ones were admitted counts at the time of the last of these. Recipients idle for a window and
    ``delay_seconds`` are forgotten.
    """
    schema = _limit_step(routed)

    def advance(batch: DataFrame, before: DataFrame) -> DataFrame:
        admitted = before.where("admitted")
        latest = Window.partitionBy("recipient_id").orderBy(F.col("at").desc(), F.col("event_id").desc())
        live = admitted.agg(F.max(F.unix_micros("at"))).scalar() - (seconds + delay_seconds) * 1_000_000
        recent = admitted.withColumn("_rn", F.row_number().over(latest)).where(F.col("_rn") <= n).where(F.unix_micros("at") > live)
        recent = recent.select("recipient_id", "event_id", "ts", "at", F.lit("recent").alias("part"))
        last = recent.groupBy("recipient_id").agg(F.max("at").alias("_last"))
        fresh = batch.select("recipient_id", "event_id", "ts").join(last, "recipient_id", "left").select(
            "recipient_id", "event_id", "ts", F.greatest("ts", "_last").alias("at"), F.lit("out").alias("part"))
        rows = recent.unionByName(fresh).withColumn("_seq", F.struct((F.col("part") == "out").alias("fresh"), "event_id"))
        limited = rate_limit(rows.withColumnsRenamed({"ts": "own_ts", "at": "ts"}), n, seconds, ident="_seq")
        return limited.withColumnsRenamed({"ts": "at", "own_ts": "ts"})

    return carry_forward(routed, folder, checkpoint, schema, advance)


def read_rate_limited(spark: SparkSession, folder: str, routed: DataFrame) -> DataFrame:
    return read_steps(spark, folder, _limit_step(routed)).drop("at")


NEVER_US = 1 << 62


def _approval_step(stream: DataFrame) -> T.StructType:
    own = _struct(kind=TEXT, role=TEXT, required=TEXT, deadline_us=LONG, ts_us=LONG, ts=TIME, state=TEXT, missing=TEXT, part=TEXT)
    return T.StructType([stream.schema["id"], *own.fields])


def write_approvals(stream: DataFrame, folder: str, checkpoint: str, delay_seconds: int = 3600, keep_seconds: int = 86_400) -> StreamingQuery:
    """approved / expired per request from one stream of requests and approvals.

    stream(id, kind, role, required, deadline, ts): ``kind`` is request or approval, ``required`` a comma list of
    roles. The first request of an id sets its terms; approvals count up to its deadline, and those that come before their
    request are kept until it does. A request without a deadline never expires, others do once the latest time seen is
    ``delay_seconds`` past the deadline. Decided ids are remembered for ``keep_seconds`` after their deadline. Carried is
    one row for each role of an undecided id.
    """
    schema = _approval_step(stream)

    def advance(batch: DataFrame, before: DataFrame) -> DataFrame:
        newest, _, mark = _clock(batch, before, delay_seconds * 1_000_000)
        now = F.lit(mark).cast("long")
        own = ["id", "kind", "role", "required", "deadline_us", "ts_us"]
        rows = batch.select(
            "id", "kind", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("required", F.lit("")).alias("required"),
            F.coalesce(F.unix_micros(F.col("deadline").cast("timestamp")), F.lit(NEVER_US)).alias("deadline_us"), F.unix_micros("ts").alias("ts_us"))
        rows = rows.unionByName(before.where("part = 'open'").select(*own))
        first = rows.groupBy("id", "kind", "role").agg(F.min(F.struct("ts_us", "required", "deadline_us")).alias("f"))
        only = lambda kind: F.when(F.col("kind") == kind, F.col("f"))
        by_id = first.groupBy("id").agg(
            F.min(only("request")).alias("r"), F.max(only("done")["ts_us"]).alias("done"),
            F.collect_list(F.when(F.col("kind") == "approval", F.struct("role", F.col("f.ts_us").alias("ts_us")))).alias("answers"))
        needed = F.array_distinct(F.filter(F.split("r.required", ","), lambda x: x != ""))
        missing = F.array_sort(F.filter(needed, lambda x: ~F.exists("answers", lambda a: (a["role"] == x) & (a["ts_us"] <= F.col("r.deadline_us")))))
        judged = by_id.withColumn("missing", missing).withColumn("state", F.when(F.col("done").isNull() & F.col("r").isNotNull(), F.when(
            F.size("missing") == 0, "approved").when(now > F.col("r.deadline_us"), "expired")))
        until = F.greatest("r.ts_us", F.when(F.col("r.deadline_us") < NEVER_US, F.col("r.deadline_us"))) + keep_seconds * 1_000_000
        ended = judged.withColumn("until", F.coalesce("done", F.when(F.col("state").isNotNull(), until)))
        fields = [f for f in schema.names if f not in ("id", "ts")]

        def row(part: str, **given: Column) -> Column:
            kinds = {f.name: f.dataType for f in schema.fields}
            return F.struct(*[(F.lit(part) if f == "part" else given.get(f, F.lit(None))).cast(kinds[f]).alias(f) for f in fields])

        def carried(kind: str, role: Column, ts: Column, required: Column, deadline: Column) -> Column:
            return row("open", kind=F.lit(kind), role=role, ts_us=ts, required=required, deadline_us=deadline)

        none, never = F.lit(""), F.lit(NEVER_US)
        undecided = F.concat(
            F.array(F.when(F.col("r").isNotNull(), carried("request", none, F.col("r.ts_us"), F.col("r.required"), F.col("r.deadline_us")))),
            F.transform("answers", lambda a: carried("approval", a["role"], a["ts_us"], none, never)))
        out = F.array(F.when(F.col("state").isNotNull(), row("out", state=F.col("state"), missing=F.array_join("missing", ","))),
                      F.when(F.col("until") > now, carried("done", none, F.col("until"), none, never)))
        parts = F.when(F.col("until").isNull(), undecided).otherwise(out)
        told = ended.select("id", F.explode(F.array_compact(parts)).alias("p")).select("id", "p.*")
        return told.unionByName(_clock_row(batch.sparkSession, newest), allowMissingColumns=True)

    return carry_forward(stream, folder, checkpoint, schema, advance)


def read_approvals(spark: SparkSession, folder: str, stream: DataFrame) -> DataFrame:
    return read_steps(spark, folder, _approval_step(stream)).select("id", "state", "missing", "batch_id")
