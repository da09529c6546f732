"""File, log, object-store and relational sources."""

from __future__ import annotations

from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions.lines import trimmed
from tracewright.functions.ordered import index_segment, last_known
from tracewright.operators.files import drop_skipped, inventory

RETENTION_DAYS = 2555


def scan_files(spark: SparkSession, root: str, with_content: bool = True) -> DataFrame:
    """Recursive inventory of a folder with size, time, name, extension and (pruned when unused) content."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    inside = urlsplit(root).path.strip("/")  # the source names files with or without scheme and host
    relative = F.regexp_replace("path", rf"^(?:[A-Za-z0-9+.-]+:)?/*(?:[^/]+/)??\Q{inside}\E/", "")
    cols = [relative.alias("path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at")]
    if with_content:
        cols.append(F.col("content"))
    return drop_skipped(inventory(raw.select(*cols)))


def parse_commit_log(lines: DataFrame) -> DataFrame:
    """``hash|author|email|epoch|subject|...`` lines; short lines and bad epochs are dropped."""
    parts = F.split("line", r"\|", -1)
    epoch = F.when(F.get(parts, F.lit(3)).rlike(r"\A[+-]?\d+\z"), F.get(parts, F.lit(3)).try_cast("long"))
    return lines.where((F.size(parts) >= 5) & epoch.isNotNull()).select(
        parts[0].alias("hash"), parts[1].alias("author"), parts[2].alias("email"),
        F.timestamp_seconds(epoch).alias("ts"), parts[4].alias("message"))


def parse_deletions(lines: DataFrame, segment_lines: int = 100_000) -> DataFrame:
    """Deleted paths of summary logs(log_id, line_no, line): a 40-hex line names the commit of those below it."""
    t = trimmed(F.col("line"))
    header = F.when(t.rlike(r"\A[0-9a-fA-F]{40}\z"), t)
    rows = last_known(lines, ["log_id"], ["line_no"], header, index_segment(F.col("line_no"), segment_lines), "hash")
    path = F.element_at(F.split(t, r"\s+"), -1)
    return rows.where(t.startswith("delete mode")).select(
        "log_id", "line_no", F.coalesce("hash", F.lit("")).alias("hash"), path.alias("path"))


def parse_shortlog(lines: DataFrame) -> DataFrame:
    """``count<TAB>Name <email>`` lines; without an address the e-mail is ``unknown``."""
    t = trimmed(F.col("line"))
    count = F.regexp_extract(t, r"\A\s*([+-]?\d+)\s*\t", 1)
    who = trimmed(F.regexp_extract(t, r"(?s)\A[^\t]*\t(.*)\z", 1))
    has_mail = who.contains("<") & who.contains(">")
    return lines.where(count != "").select(
        F.when(has_mail, trimmed(F.regexp_extract(who, r"(?s)\A([^<]*)<", 1))).otherwise(who).alias("name"),
        F.when(has_mail, F.replace(F.regexp_extract(who, r"(?s)\A[^<]*<(.*)\z", 1), F.lit(">"), F.lit("")))
        .otherwise("unknown").alias("email"),
        count.cast("long").alias("commits"))


def read_jdbc(spark: SparkSession, url: str, query: str, *, partition: dict[str, str] | None = None, **options: str) -> DataFrame:
    """Rows of a query on an external database; ``partition`` (column, bounds, count) reads in parallel."""
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    if partition:
        return reader.option("dbtable", f"({query}) q").options(**partition).load()
    return reader.option("query", query).load()


def read_relation(spark: SparkSession, query: str, views: dict[str, DataFrame]) -> DataFrame:
    """The same query text over DataFrames instead of a database."""
    return spark.sql(query, **views)


def storage_stats(objects: DataFrame, prefix: str = "") -> DataFrame:
    return objects.where(F.col("path").startswith(prefix)).agg(
        F.count("*").alias("file_count"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_bytes"))


def is_expired(as_of: Column, days: int = RETENTION_DAYS) -> Column:
    return F.col("modified_at") < as_of - F.make_dt_interval(days=F.lit(days))


def retention_filter(objects: DataFrame, as_of: Column, days: int = RETENTION_DAYS) -> DataFrame:
    """The objects that stay."""
    return objects.where(~is_expired(as_of, days))


def retention_report(objects: DataFrame, as_of: Column, days: int = RETENTION_DAYS) -> DataFrame:
    return objects.groupBy(is_expired(as_of, days).alias("expired")).agg(
        F.count("*").alias("objects"), F.sum("size_bytes").alias("bytes"))


def write_report(report: DataFrame, path: str, findings: DataFrame | None = None) -> None:
    """One JSON document per job, in a folder per job; its findings as JSON rows in a folder beside it."""
    report.withColumn("job", F.col("job_id")).write.mode("overwrite").partitionBy("job").json(path)
    if findings is not None:
        findings.withColumn("job", F.col("job_id")).write.mode("overwrite").partitionBy("job").json(f"{path.rstrip('/')}-findings")


def archive_events(events: DataFrame, path: str, start: Column, end: Column, ts: str = "ts") -> None:
    """Write a time range to cold storage, one folder per day.

    Days are rebalanced by size, so a large day is split over as many tasks as its bytes call for.
    """
    inside = (F.col(ts) >= start) & (F.col(ts) < end)
    events.where(inside).withColumn("day", F.to_date(ts)).hint("rebalance", F.col("day")).write.mode("overwrite").partitionBy("day").parquet(path)


def archive_summary(events: DataFrame, start: Column, end: Column, ts: str = "ts") -> DataFrame:
    """Rows per day that an archive of the range holds."""
    inside = (F.col(ts) >= start) & (F.col(ts) < end)
    return events.where(inside).groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("events"))


def delete_range(events: DataFrame, start: Column, end: Column, ts: str = "ts") -> DataFrame:
    """The rows that remain after deleting a time range."""
    return events.where((F.col(ts) < start) | (F.col(ts) >= end))
