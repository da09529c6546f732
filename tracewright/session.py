"""Session defaults and the shared checkpoint folder."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(app: str = "tracewright", cpus: int | str = "*", **conf: str) -> SparkSession:
    """Local session used by the tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("TRACEWRIGHT_DRIVER_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the settings results depend on: all timestamps are UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir.

    Where it is unset, a single-machine session (tests, bench) gets a folder of its own; on a cluster that
    folder would be lost to the executors, so it is an error there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tracewright-"))
    return spark.sparkContext.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder, so a lost executor does not replay an iteration."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(checkpoint_dir(spark))
    return df.checkpoint(eager=True)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared one, for frames that an iteration rereads; ``remove_folder`` ends it."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def reread(df: DataFrame, place: str) -> DataFrame:
    """``df`` written to ``place`` and read again, so that its size is that of its files.

    A checkpoint keeps the estimate of the plan behind it, and a join's estimate is the product of its sides. Where each round
    joins what the last one left, the digits of that number multiply by round until they fill the driver.
    """
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder of ``scratch_folder`` wherever the cluster keeps it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Rows of a few columns that fill a partition.
PARTITION_ROWS = 1 << 17


def few(df: DataFrame, rows: int) -> DataFrame:
    """``df`` in no more partitions than so many rows fill, or cores there are, if a shuffle has more.

    For frames of an iteration that are small beside the table: each task of a stage leaves files and records of its own,
    whatever it holds.
    """
    spark = df.sparkSession
    wanted = max(spark.sparkContext.defaultParallelism, -(-rows // PARTITION_ROWS))
    return df.coalesce(wanted) if wanted < int(spark.conf.get("spark.sql.shuffle.partitions")) else df


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffles and checkpoints of frames that are no longer held.

    It does so when the driver collects its garbage, which an iteration that writes much but allocates little may
    not reach before disks are full.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
