"""Structured Streaming jobs. Time is event time; each job also has a batch twin in ``operators``."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tracewright.operators.events import dead_letter
from tracewright.operators.evidence import (
    event_error, event_type_name, filter_events, package_hash, retry_delay, route_workflow, validate_event)
from tracewright.operators.reports import merge_repositories
from tracewright.streaming.topics import write_batch, write_outcomes, write_routed
def notarization_outcomes(
    events: DataFrame, types: Sequence[str] | None = None, sources: Sequence[str] | None = None,
    min_priority: str = "low",
) -> DataFrame:
    """Filter, validate and route pipeline events; every kept event becomes one outcome row.

    Row-local from end to end, so batch and stream give the same rows.
    """
    kept = route_workflow(validate_event(filter_events(events, types, sources, min_priority)))
    error = F.coalesce("error", "route_error")
    outcome = F.when(error.isNotNull(), "error").when(F.col("route") == "simple", "result").otherwise("status")
    rows = kept.withColumn("message", error).withColumn("outcome", outcome)
    evidence = rows.withColumn("spec_version", F.lit("1.0.0")).withColumn("timestamp_utc", F.col("ts")).withColumn(
        "event_type", event_type_name())
    return package_hash(evidence).select(
        "outcome", "seq", "event_id", "event_type", "ts", F.col("actor.id").alias("actor"), "route",
        F.concat(F.coalesce("route", F.lit("none")), F.lit("-signing-"), "event_id").alias("workflow_id"),
        F.when(F.col("outcome") == "error", "failed").when(F.col("outcome") == "result", "completed")
        .when(F.col("route") == "approval", "pending_approval").otherwise("processing").alias("status"),
        F.when(F.col("outcome") == "error", "validation").alias("error_type"), "message",
        F.when(F.col("outcome") != "error", F.col("package_hash")).alias("package_hash"))


def notarize_stream(
    events: DataFrame, folder: str, checkpoint: str, types: Sequence[str] | None = None,
    sources: Sequence[str] | None = None, min_priority: str = "low",
) -> StreamingQuery:
    """Source -> filter -> validate -> route -> result, status and error tables, checkpointed."""
    return write_outcomes(notarization_outcomes(events, types, sources, min_priority), folder, checkpoint)


def _seconds(spark: SparkSession, span: str) -> int:
    return spark.sql(f"SELECT unix_seconds(timestamp_seconds(0) + INTERVAL '{span}')").first()[0]


def windowed_metrics(points: DataFrame, size: str, slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Tumbling or sliding metric windows per name; rows later than ``delay`` are dropped on a stream.

    Sliding windows add up panes, the longest spans of which size and slide are whole numbers: a point is
    aggregated once, and only one row a pane and name is copied to the windows that cover it. On a stream that is two
    aggregations, which Spark runs in append mode: a window comes once, when the watermark has passed it.
    """
    rows = points.withWatermark("ts", delay) if points.isStreaming else points
    pane = size
    if slide:
        pane = f"{math.gcd(_seconds(points.sparkSession, size), _seconds(points.sparkSession, slide))} seconds"
    sums = rows.groupBy("name", F.window("ts", pane).alias("w")).agg(F.count("*").alias("points"), F.sum("value").alias("total"), F.max("value").alias("peak"))
    if slide:
        sums = sums.groupBy("name", F.window("w", size, slide).alias("w")).agg(F.sum("points").alias("points"), F.sum("total").alias("total"), F.max("peak").alias("peak"))
    return sums.select("name", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "points", "total", "peak")


def stream_status(status: DataFrame) -> DataFrame:
    """Latest state per workflow of a batch or a micro-batch, as mergeable rows."""
    last = F.max_by(F.struct("status", "percentage", "ts", "status_id"), F.struct("ts", "status_id"))
    return status.groupBy("workflow_id").agg(last.alias("_l"), F.count("*").alias("updates")).select(
        "workflow_id", "_l.status", "_l.percentage", "_l.ts", "_l.status_id", "updates")


def write_status(status: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch writes the latest state of the workflows it saw; no state is held between them."""
    def save(batch: DataFrame, batch_id: int) -> None:
        write_batch(stream_status(batch), folder, "status_updates", batch_id)

    return status.writeStream.option("checkpointLocation", checkpoint).foreachBatch(save).trigger(availableNow=True).start()


def read_status(spark: SparkSession, folder: str) -> DataFrame:
    """Latest state per workflow over all micro-batches."""
    rows = spark.read.parquet(f"{folder}/status_updates")
    last = F.max_by(F.struct("status", "percentage", "ts"), F.struct("ts", "status_id"))
    return rows.groupBy("workflow_id").agg(last.alias("_l"), F.sum("updates").alias("updates")).select(
        "workflow_id", "_l.status", "_l.percentage", "_l.ts", "updates")


def write_repositories(
    analyses: DataFrame, path: str, checkpoint: str, fields: list[str], as_of: str = "analyzed_at", buckets: int = 64
) -> StreamingQuery:
    """Each micro-batch of analyses(url, analyzed_at, fields...) is merged into the folders of the table that it touches."""
    def save(batch: DataFrame, batch_id: int) -> None:
        merge_repositories(batch.sparkSession, path, batch, fields, as_of, buckets, batch_id)

    return analyses.writeStream.option("checkpointLocation", checkpoint).foreachBatch(save).trigger(availableNow=True).start()


def route_failures(events: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Failed events of a stream: retryable ones go to the retry table, which feeds the input again, the rest to errors."""
    failed = dead_letter(events).withColumn("queue", F.when(F.col("retryable"), "retry").otherwise("errors"))
    return write_routed(failed, "queue", folder, checkpoint)


def write_with_retries(
    events: DataFrame, process: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str, attempts: int, as_of: str | None = None
) -> StreamingQuery:
    """Run ``process`` on new events and on the due rows of the retry table, which is the second source of the stream.

    ``process`` gets the events with ``attempt`` (0 at first) and adds ``error_name``, null on success. Every
    attempt is a row of the attempts table with its ``queue``: done, retry or errors. Retryable failures go to the retry table with
    the next attempt and the time they are due; after ``attempts`` of them, and for failures that
    no retry mends, the queue is errors. Rows not due at ``as_of`` (now, if not given) go back as they are. A replayed
    micro-batch overwrites its own folders. One run takes what is there when it starts: a stream that is
    run again, or triggered on and on, takes the retries of the run before.
    """
    spark = events.sparkSession
    schema = T.StructType([*events.schema.fields, T.StructField("attempt", T.IntegerType()), T.StructField("due", T.TimestampType())])
    spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{folder}/retry/start")
    again = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{folder}/retry")
    source = events.withColumns({"attempt": F.lit(0), "due": F.col("ts").cast("timestamp")}).unionByName(again)
    now = F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp")

    def save(batch: DataFrame, batch_id: int) -> None:
        waits = (F.col("attempt") > 0) & (F.col("due") > now)
        tried = process(batch.where(~waits))
        last = F.col("attempt") + 1 >= attempts
        failed = dead_letter(tried).withColumn("queue", F.when(F.col("retryable") & ~last, "retry").otherwise("errors"))
        done = tried.where(event_error(tried).isNull() & F.col("error_name").isNull()).withColumn("queue", F.lit("done"))
        write_batch(done.unionByName(failed, allowMissingColumns=True), folder, "attempts", batch_id)
        written = spark.read.schema(T.StructType([*schema.fields, T.StructField("queue", T.StringType())])).parquet(f"{folder}/attempts/batch_id={batch_id}")
        wait = F.make_dt_interval(secs=retry_delay(F.col("attempt")))
        next_try = written.where("queue = 'retry'").withColumns({"due": F.greatest("due", F.col("ts").cast("timestamp")) + wait, "attempt": F.col("attempt") + 1})
        next_try.drop("queue").unionByName(batch.where(waits)).write.mode("overwrite").parquet(f"{folder}/retry/{batch_id}")

    return source.writeStream.option("checkpointLocation", checkpoint).foreachBatch(save).trigger(availableNow=True).start()
