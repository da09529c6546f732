"""Event topics: decoding, the three outcome tables and run folders."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracewright.session import checkpoint_dir


def decode_events(raw: DataFrame, schema: str, value: str = "value") -> DataFrame:
    """Add ``event`` (parsed) and ``corrupt`` (the raw text when it does not parse); bad rows stay rows."""
    fields = schema + ", _corrupt string"
    parsed = F.from_json(value, fields, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    return raw.withColumn("event", parsed).withColumn("corrupt", F.col("event._corrupt"))


def split_decoded(decoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good events and error rows."""
    good = decoded.where(F.col("corrupt").isNull()).drop("corrupt")
    bad = decoded.where(F.col("corrupt").isNotNull()).select(
        F.lit("validation").alias("error_type"),
        F.concat(F.lit("Message deserialization failed: "), "corrupt").alias("message"))
    return good, bad


def read_events(
    spark: SparkSession, path: str, schema: str, *, kafka: dict[str, str] | None = None, files_per_trigger: int | None = None
) -> DataFrame:
    """A stream of decoded events from JSON-line files, or from a Kafka topic when options are given."""
    if kafka:
        raw = spark.readStream.format("kafka").options(**kafka).load().select(F.col("value").cast("string").alias("value"))
    else:
        reader = spark.readStream
        if files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", files_per_trigger)
        raw = reader.text(path)
    return decode_events(raw, schema)


def new_run_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared checkpoint location."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_batch(df: DataFrame, folder: str, table: str, batch_id: int) -> None:
    """Idempotent append: a replayed micro-batch overwrites its own folder."""
    df.write.mode("overwrite").parquet(f"{folder}/{table}/batch_id={batch_id}")


OUTCOME_TABLES = {"results": "result", "status": "status", "errors": "error"}


def write_routed(stream: DataFrame, by: str, folder: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """One table per value of ``by``, as partitions of a single idempotent write per micro-batch."""
    def split(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").partitionBy(by).parquet(f"{folder}/{by}/batch_id={batch_id}")

    return (
        stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(split)
        .trigger(availableNow=True).start()
    )


def read_routed(spark: SparkSession, folder: str, by: str, value: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{by}").where(F.col(by) == value)


def write_outcomes(outcomes: DataFrame, folder: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Three tables from one stream with ``outcome`` in (result, status, error) and its key columns."""
    return write_routed(outcomes, "outcome", folder, checkpoint, mode)


def write_table(stream: DataFrame, folder: str, table: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    def save(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, folder, table, batch_id)

    return (
        stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(save)
        .trigger(availableNow=True).start()
    )


def read_table(spark: SparkSession, folder: str, table: str) -> DataFrame:
    if table in OUTCOME_TABLES:
        return read_routed(spark, folder, "outcome", OUTCOME_TABLES[table])
    return spark.read.parquet(f"{folder}/{table}")
