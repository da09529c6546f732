"""Reports, roll-ups and table queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.model import severity_rank, severity_weight
from tracewright.session import cut_lineage

# Weight x confidence is capped at 10.
SCORE_CAP = 10.0
RESOLVE_FIRST = "Resolve the findings of high and critical severity first"


def finding_risk(findings: DataFrame) -> DataFrame:
    return findings.withColumn("risk", F.least(F.lit(SCORE_CAP), severity_weight() * F.col("confidence")))


def _score() -> Column:
    return F.least(F.lit(SCORE_CAP), F.avg(severity_weight() * F.col("confidence")))


def _classification() -> Column:
    top = F.max(severity_rank())
    return F.when(top >= 5, "restricted").when(top >= 4, "confidential").otherwise("internal")


def risk_score(findings: DataFrame, by: str = "job_id") -> DataFrame:
    return findings.groupBy(by).agg(_score().alias("risk_score"))


def classify_job(findings: DataFrame, by: str = "job_id") -> DataFrame:
    return findings.groupBy(by).agg(_classification().alias("classification"))


def job_risk(jobs: DataFrame, findings: DataFrame) -> DataFrame:
    """Score and class of every job; a job without findings scores 0 and is internal."""
    per_job = findings.groupBy("job_id").agg(
        F.count("*").alias("total_findings"), _score().alias("risk_score"), _classification().alias("classification"))
    return jobs.join(per_job, "job_id", "left").select(
        "job_id", F.coalesce("total_findings", F.lit(0)).alias("total_findings"),
        F.coalesce("risk_score", F.lit(0.0)).alias("risk_score"),
        F.coalesce("classification", F.lit("internal")).alias("classification"))


def publishable(findings: DataFrame) -> DataFrame:
    return findings.where(F.col("severity").isin("high", "critical"))


def summarize_findings(findings: DataFrame, by: str = "job_id", jobs: DataFrame | None = None) -> DataFrame:
    """Totals per severity and type; a first partial count per (job, type, severity) keeps the second small.

    With ``jobs`` every job has a row; one without findings counts and scores 0 and is internal.
    """
    cells = findings.groupBy(by, "finding_type", "severity").agg(
        F.count("*").alias("n"), F.sum(severity_weight() * F.col("confidence")).alias("score"))
    types = cells.groupBy(by, "finding_type").agg(F.sum("n").alias("n")).groupBy(by).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("finding_type", "n")))).alias("by_type"))

    def of(column: str, value: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col(column) == value, F.col("n"))), F.lit(0))

    totals = cells.groupBy(by).agg(
        F.sum("n").alias("total_findings"),
        *[of("severity", s).alias(f"{s}_findings") for s in ("critical", "high", "medium", "low")],
        of("finding_type", "secret_exposure").alias("secrets_found"),
        F.bool_or(F.col("finding_type") == "malware").alias("malware_detected"),
        F.least(F.lit(SCORE_CAP), F.sum("score") / F.sum("n")).alias("risk_score"),
        _classification().alias("classification"),
    )
    out = totals.join(types, by)
    if jobs is None:
        return out
    plain = {"malware_detected": F.lit(False), "risk_score": F.lit(0.0), "classification": F.lit("internal"),
             "by_type": F.create_map().cast("map<string,bigint>")}
    return jobs.select(by).join(out, by, "left").select(
        by, *[F.coalesce(c, plain.get(c, F.lit(0))).alias(c) for c in out.columns if c != by])


def _file_cells(files: DataFrame, *extra: Column) -> DataFrame:
    """Files per job, by type and by classification in one pass of grouping sets."""
    return files.groupingSets(
        [["job_id", "file_type"], ["job_id", "classification"], ["job_id"]], "job_id", "file_type", "classification"
    ).agg(F.count("*").alias("files"), F.grouping("file_type").alias("_t"), F.grouping("classification").alias("_c"), *extra).select(
        "job_id",
        F.when((F.col("_t") == 1) & (F.col("_c") == 1), "total").when(F.col("_t") == 0, "type")
        .otherwise("classification").alias("dimension"),
        F.coalesce("file_type", "classification").alias("value"), "files", *["skipped" for _ in extra])


def summarize_files(files: DataFrame) -> DataFrame:
    """Totals, by type and by classification per job."""
    return _file_cells(files)


def compliance_summary(findings: DataFrame, by: str = "job_id", jobs: DataFrame | None = None) -> DataFrame:
    """Status plus the distinct issue titles with counts; the list is bounded by the rule set, not the data.

    With ``jobs`` every job has a row; one without findings is compliant.
    """
    titles = findings.groupBy(by, "title").agg(
        F.count_if(F.col("severity").isin("high", "critical")).alias("n"),
        F.bool_or(F.col("severity") == "critical").alias("critical"))
    issue = F.when(F.col("n") > 0, F.struct(F.col("title").alias("title"), F.col("n").alias("count")))
    out = titles.groupBy(by).agg(
        F.when(F.bool_or("critical"), "non_compliant").otherwise("compliant").alias("status"),
        F.array_sort(F.collect_list(issue)).alias("issues"))
    if jobs is None:
        return out
    none = F.array().cast(out.schema["issues"].dataType)
    return jobs.select(by).join(out, by, "left").select(
        by, F.coalesce("status", F.lit("compliant")).alias("status"), F.coalesce("issues", none).alias("issues"))


def build_report(repositories: DataFrame, findings: DataFrame, files: DataFrame, as_of: Column) -> DataFrame:
    """One nested report row per job of ``repositories``, whose other columns become its ``repository`` part.

    A job without findings is compliant and scores 0. Files with a ``skip_reason`` count as skipped. The
    findings themselves stay rows: ``write_report`` puts them beside the report.
    """
    if "skip_reason" not in files.columns:
        files = files.withColumn("skip_reason", F.lit(None).cast("string"))
    jobs = repositories.select("job_id")
    summary = summarize_findings(findings, jobs=jobs)
    compliance = compliance_summary(findings, jobs=jobs)
    per_file = _file_cells(files, F.count_if(F.col("skip_reason").isNotNull()).alias("skipped"))

    def counts(dimension: str) -> Column:
        hit = F.when(F.col("dimension") == dimension, F.struct(F.coalesce("value", F.lit("unknown")), "files"))
        return F.map_from_entries(F.array_sort(F.collect_list(hit)))

    file_part = per_file.groupBy("job_id").agg(
        F.max(F.when(F.col("dimension") == "total", F.col("files"))).alias("total_files"),
        F.max(F.when(F.col("dimension") == "total", F.col("skipped"))).alias("skipped_files"),
        counts("type").alias("by_type"), counts("classification").alias("by_classification"))
    body = [c for c in summary.columns if c != "job_id"]
    profile = [c for c in repositories.columns if c != "job_id"]
    total, skipped = (F.coalesce(c, F.lit(0)) for c in ("total_files", "skipped_files"))
    no_counts = F.create_map().cast("map<string,bigint>")
    fine = F.struct(F.lit("compliant").alias("status"), F.array().cast("array<string>").alias("issues"), F.array().cast("array<string>").alias("recommendations"))
    advice = F.when(F.size("issues") > 0, F.array(F.lit(RESOLVE_FIRST))).otherwise(F.array().cast("array<string>"))
    joined = (
        repositories.select("job_id", *([F.struct(*profile).alias("repository")] if profile else []))
        .join(summary.select("job_id", F.struct(*body).alias("summary")), "job_id")
        .join(file_part, "job_id", "left")
        .withColumn("files", F.struct(
            total.alias("total_files"), (total - skipped).alias("analyzed_files"), skipped.alias("skipped_files"),
            F.coalesce("by_type", no_counts).alias("by_type"), F.coalesce("by_classification", no_counts).alias("by_classification")))
        .drop("total_files", "skipped_files", "by_type", "by_classification")
        .withColumn("privacy_compliance", fine).withColumn("license_compliance", fine)
        .join(compliance.select("job_id", F.struct("status", "issues", advice.alias("recommendations")).alias("security_compliance")), "job_id")
    )
    forensic = F.struct(
        F.concat(F.lit("COC-"), F.col("job_id")).alias("chain_of_custody_id"),
        F.sha2(F.to_json(F.struct("summary", "files", "security_compliance")), 256).alias("evidence_hash"),
        as_of.alias("collection_timestamp"))
    return joined.withColumn("forensic_metadata", forensic)


def filter_results(
    findings: DataFrame, classifications: list[str] | None = None, finding_types: list[str] | None = None,
    raw: bool = False,
) -> DataFrame:
    out = findings
    if finding_types:
        out = out.where(F.col("finding_type").isin(finding_types))
    if classifications:
        jobs = classify_job(findings).where(F.col("classification").isin(classifications))
        out = out.join(jobs.select("job_id"), "job_id", "left_semi")
    return out if raw or "evidence" not in out.columns else out.drop("evidence")


def list_jobs(
    jobs: DataFrame, *, status: str | None = None, priority: str | None = None, submitter_id: str | None = None,
    case_number: str | None = None, created_after: Column | None = None, created_before: Column | None = None,
    limit: int = 50, offset: int = 0,
) -> DataFrame:
    """A page of jobs, newest first, with the total under the same filters and whether more follow."""
    rows = jobs
    for column, value in (("status", status), ("priority", priority), ("submitter_id", submitter_id),
                          ("case_number", case_number)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    if created_after is not None:
        rows = rows.where(F.col("created_at") >= created_after)
    if created_before is not None:
        rows = rows.where(F.col("created_at") <= created_before)
    total = rows.agg(F.count("*")).scalar()
    page = rows.orderBy(F.col("created_at").desc(), "id").offset(offset).limit(limit)
    return page.withColumn("total", total).withColumn("has_more", F.lit(offset + limit) < F.col("total"))


def job_findings(findings: DataFrame, job: str) -> DataFrame:
    return findings.where(F.col("job_id") == job).orderBy(
        severity_rank().desc(), F.col("detected_at").desc(), "finding_id")


def job_files(files: DataFrame, job: str, time: str = "modified_at") -> DataFrame:
    return files.where(F.col("job_id") == job).orderBy(time, "path")


def upsert_repositories(target: DataFrame, batch: DataFrame, fields: list[str], as_of: str = "analyzed_at") -> DataFrame:
    """Merge a batch into repositories(url, analysis_count, first_analyzed, last_analyzed, fields...).

    Several batch rows per url count as that many analyses and the latest one wins.
    """
    latest = batch.groupBy("url").agg(
        F.count("*").alias("_n"), F.min(as_of).alias("_first"), F.max(as_of).alias("_last"),
        F.max_by(F.struct(*fields), F.struct(as_of, *fields)).alias("_new"))
    merged = target.join(latest, "url", "full_outer")

    def field(name: str) -> Column:
        return F.when(F.col("_new").isNotNull(), F.col("_new")[name]).otherwise(F.col(name)).alias(name)

    return merged.select(
        "url",
        (F.coalesce("analysis_count", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("analysis_count"),
        F.coalesce("first_analyzed", "_first").alias("first_analyzed"),
        F.coalesce("_last", "last_analyzed").alias("last_analyzed"), *[field(f) for f in fields])


def merge_repositories(
    spark: SparkSession, path: str, batch: DataFrame, fields: list[str], as_of: str = "analyzed_at", buckets: int = 64, batch_id: int | None = None
) -> None:
    """Upsert a batch into the table at ``path``, which lies in folders by hash of the url; only folders the batch touches are rewritten.

    Every row keeps the last ``batch_id`` that changed it, so a batch that is merged again after a failure
    changes nothing twice. At most ``buckets`` folder numbers go through the driver.
    """
    bucket = F.pmod(F.xxhash64("url"), F.lit(buckets)).cast("int")
    named = batch.where(F.col("url").isNotNull()).withColumn("_bucket", bucket)
    touched = [r[0] for r in named.select("_bucket").distinct().collect()]
    kinds = {f.name: f.dataType for f in batch.schema.fields}
    schema = T.StructType([
        T.StructField("url", T.StringType()), T.StructField("analysis_count", T.LongType()), T.StructField("first_analyzed", kinds[as_of]),
        T.StructField("last_analyzed", kinds[as_of]), *[T.StructField(f, kinds[f]) for f in fields], T.StructField("last_batch", T.LongType()),
        T.StructField("bucket", T.IntegerType())])
    spark.createDataFrame([], schema).write.mode("ignore").partitionBy("bucket").parquet(path)
    target = spark.read.schema(schema).parquet(path).where(F.col("bucket").isin(touched))
    number = F.lit(batch_id).cast("long")
    done = target.where(F.coalesce(F.col("last_batch") >= number, F.lit(False))).select("url")
    fresh = named.drop("_bucket").join(done, "url", "left_anti")
    merged = upsert_repositories(target, fresh, fields, as_of).join(
        fresh.select("url").distinct().withColumn("_hit", F.lit(True)), "url", "left").join(
        target.select("url", F.col("last_batch").alias("_old")), "url", "left").select(
        "url", "analysis_count", "first_analyzed", "last_analyzed", *fields,
        F.when(F.col("_hit"), F.coalesce(number, F.col("_old"))).otherwise(F.col("_old")).alias("last_batch"), bucket.alias("bucket"))
    cut_lineage(merged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def job_durations(jobs: DataFrame) -> DataFrame:
    ms = F.timestamp_diff("MILLISECOND", F.col("started_at"), F.col("completed_at"))
    return jobs.withColumn("duration_ms", ms).withColumn(
        "progress", F.when(F.col("status") == "completed", 100).when(F.col("status") == "queued", 0).otherwise(50))


def job_statistics(jobs: DataFrame) -> DataFrame:
    return job_durations(jobs).groupBy("status").agg(
        F.count("*").alias("jobs"), F.avg("duration_ms").alias("avg_duration_ms"),
        F.max("duration_ms").alias("max_duration_ms"), F.avg("progress").alias("avg_progress"))


def list_workflows(
    rows: DataFrame, *, status: str | None = None, start: Column | None = None, end: Column | None = None,
    token: tuple | None = None, page_size: int | None = None,
) -> DataFrame:
    """Keyset page ordered by (ts, id): the token is the last (ts, id) of the previous page."""
    if status is not None:
        rows = rows.where(F.col("status") == status)
    if start is not None:
        rows = rows.where(F.col("ts") >= start)
    if end is not None:
        rows = rows.where(F.col("ts") < end)
    if token is not None:
        ts, ident = F.lit(token[0]).cast("timestamp"), F.lit(token[1])
        rows = rows.where((F.col("ts") > ts) | ((F.col("ts") == ts) & (F.col("id") > ident)))
    rows = rows.orderBy("ts", "id")
    return rows if page_size is None else rows.limit(page_size)
