"""Registered queries: reports, roll-ups and table queries."""

from pyspark.sql import functions as F

from tracewright.operators import reports as G
from tracewright.plans import bindings as B
from tracewright.plans.files import SENSITIVITY, SKIPPED, TYPED, _typed
from tracewright.operators.files import classify_sensitivity, filter_analyzable
from tracewright.plans.registry import query
from tracewright.plans.scan import SQL_WEIGHT
from tracewright.streaming.jobs import write_repositories
from tracewright.streaming.topics import new_run_folder

FIND = B.SQL_FINDINGS
JOBS = B.SQL_JOBS
CLS = "CASE WHEN bool_or(severity = 'critical') THEN 'restricted' WHEN bool_or(severity = 'high') THEN 'confidential' ELSE 'internal' END"


@query("g1_risk_score", f"SELECT job_id, round(least(10, avg({SQL_WEIGHT} * confidence)), 9) AS risk_score FROM ({FIND}) GROUP BY job_id")
def g1(t):
    return G.risk_score(B.findings(t)).select("job_id", F.round("risk_score", 9).alias("risk_score"))


@query("g2_finding_risk", f"SELECT finding_id, round(least(10, {SQL_WEIGHT} * confidence), 6) AS risk FROM ({FIND})")
def g2(t):
    return G.finding_risk(B.findings(t)).select("finding_id", F.round("risk", 6).alias("risk"))


@query("g3_classify_job", f"SELECT job_id, {CLS} AS classification FROM ({FIND}) GROUP BY job_id")
def g3(t):
    return G.classify_job(B.findings(t))


@query("g4_summarize_findings", f"""
SELECT job_id, count(*) AS total_findings, count(*) FILTER (severity = 'critical') AS critical_findings, count(*) FILTER (severity = 'high') AS high_findings,
  count(*) FILTER (severity = 'medium') AS medium_findings, count(*) FILTER (severity = 'low') AS low_findings,
  count(*) FILTER (finding_type = 'secret_exposure') AS secrets_found, bool_or(finding_type = 'malware') AS malware_detected,
  round(least(10, avg({SQL_WEIGHT} * confidence)), 9) AS risk_score, {CLS} AS classification, max(by_type) AS by_type
FROM ({FIND}) JOIN (SELECT job_id AS j, string_agg(finding_type || '=' || n, ';' ORDER BY finding_type) AS by_type
  FROM (SELECT job_id, finding_type, count(*) AS n FROM ({FIND}) GROUP BY ALL) GROUP BY job_id) ON j = job_id GROUP BY job_id""")
def g4(t):
    s = G.summarize_findings(B.findings(t))
    types = F.array_join(F.transform(F.map_entries("by_type"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ";")
    return s.withColumn("by_type", types).withColumn("risk_score", F.round("risk_score", 9))


@query("g5_summarize_files", f"""
WITH f AS (SELECT job_id, file_type, {SENSITIVITY} AS classification FROM ({TYPED}))
SELECT job_id, 'total' AS dimension, CAST(NULL AS VARCHAR) AS value, count(*) AS files FROM f GROUP BY job_id
UNION ALL SELECT job_id, 'type', file_type, count(*) FROM f GROUP BY job_id, file_type
UNION ALL SELECT job_id, 'classification', classification, count(*) FROM f GROUP BY job_id, classification""")
def g5(t):
    return G.summarize_files(classify_sensitivity(_typed(t)))


@query("g6_compliance_summary", f"""
SELECT job_id, CASE WHEN bool_or(critical) THEN 'non_compliant' ELSE 'compliant' END AS status,
  coalesce(string_agg(title || '=' || n, ';' ORDER BY title) FILTER (n > 0), '') AS issues
FROM (SELECT job_id, title, count(*) FILTER (severity IN ('high', 'critical')) AS n, bool_or(severity = 'critical') AS critical FROM ({FIND}) GROUP BY ALL) GROUP BY job_id""")
def g6(t):
    return G.compliance_summary(B.findings(t)).select(
        "job_id", "status",
        F.array_join(F.transform("issues", lambda i: F.concat_ws("=", i["title"], i["count"].cast("string"))), ";").alias("issues"))


@query("g7_build_report", f"""
WITH f AS (SELECT *, 'src' || CAST(substr(job_id, 4) AS INT) % 20 AS src FROM ({FIND}))
SELECT source AS job_id, 'COC-' || source AS chain_of_custody_id, coalesce(n, 0) AS total_findings, coalesce(score, 0) AS risk_score, total_files, skipped_files,
  coalesce(status, 'compliant') AS status, 'compliant' AS privacy FROM (SELECT DISTINCT source FROM documents)
LEFT JOIN (SELECT src, count(*) AS n, round(least(10, avg({SQL_WEIGHT} * confidence)), 6) AS score, CASE WHEN bool_or(severity = 'critical') THEN 'non_compliant' ELSE 'compliant' END AS status FROM f GROUP BY src) ON src = source
LEFT JOIN (SELECT job_id AS s2, count(*) AS total_files, count(*) FILTER ({SKIPPED}) AS skipped_files FROM ({TYPED}) GROUP BY job_id) ON s2 = source""")
def g7(t):
    src = F.concat(F.lit("src"), (F.substring("job_id", 4, 20).cast("int") % 20).cast("string"))
    findings = B.findings(t).withColumn("job_id", src)
    repos = t.documents.select(F.col("source").alias("job_id")).distinct()
    r = G.build_report(repos, findings, filter_analyzable(classify_sensitivity(_typed(t))), F.lit("2024-06-01").cast("timestamp"))
    return r.select("job_id", "forensic_metadata.chain_of_custody_id", "summary.total_findings", F.round("summary.risk_score", 6).alias("risk_score"),
                    "files.total_files", "files.skipped_files", F.col("security_compliance.status").alias("status"), F.col("privacy_compliance.status").alias("privacy"))


@query("g8_filter_results", f"""
WITH f AS (SELECT * REPLACE (job_id || strftime(detected_at, '-%d') AS job_id) FROM ({FIND}))
SELECT finding_id, job_id, finding_type, severity FROM f WHERE finding_type IN ('malware', 'secret_exposure')
  AND job_id IN (SELECT job_id FROM f GROUP BY job_id HAVING bool_or(severity = 'high') AND NOT bool_or(severity = 'critical'))""")
def g8(t):
    f = B.findings(t).withColumn("job_id", F.concat("job_id", F.date_format("detected_at", "-dd")))
    return G.filter_results(f, ["confidential"], ["malware", "secret_exposure"]).select(
        "finding_id", "job_id", "finding_type", "severity")


@query("g9_list_jobs", f"""
WITH f AS (SELECT * FROM ({JOBS}) WHERE status = 'completed' AND priority = 'high' AND created_at >= TIMESTAMP '1997-01-01' AND created_at <= TIMESTAMP '1999-12-31')
SELECT id, submitter_id, strftime(created_at, '%Y-%m-%d') AS created, (SELECT count(*) FROM f) AS total, 65 < (SELECT count(*) FROM f) AS has_more
FROM f ORDER BY created_at DESC, id LIMIT 50 OFFSET 15""")
def g9(t):
    page = G.list_jobs(
        B.jobs(t), status="completed", priority="high", created_after=F.lit("1997-01-01").cast("timestamp"),
        created_before=F.lit("1999-12-31").cast("timestamp"), limit=50, offset=15)
    return page.select("id", "submitter_id", F.date_format("created_at", "yyyy-MM-dd").alias("created"), "total", "has_more")


@query("g10_job_findings", f"SELECT finding_id, severity, title FROM ({FIND}) WHERE job_id = 'job7'")
def g10(t):
    return G.job_findings(B.findings(t), "job7").select("finding_id", "severity", "title")


@query("g11_job_files", f"SELECT path, size_bytes FROM ({TYPED}) WHERE job_id = 'src3'")
def g11(t):
    return G.job_files(_typed(t), "src3").select("path", "size_bytes")


@query("g12_upsert_repositories", r"""
WITH p AS (SELECT regexp_extract(url, '^https?://(?:m\.|www\.)?([^/]+)', 1) AS host, starts_with(url, 'https') AS secure, page_id, octet_length(encode(html)) AS size FROM pages),
t AS (SELECT host AS url, count(*) AS analysis_count, min(page_id) AS first_analyzed, max(page_id) AS last_analyzed, max(size) AS size_bytes, 'web' AS kind FROM p WHERE NOT secure GROUP BY host),
b AS (SELECT host AS url, count(*) AS n, min(page_id) AS f, max(page_id) AS l, max_by(size, page_id) AS size_bytes FROM p WHERE secure GROUP BY host)
SELECT url, coalesce(analysis_count, 0) + coalesce(n, 0) AS analysis_count, coalesce(first_analyzed, f) AS first_analyzed, coalesce(l, last_analyzed) AS last_analyzed,
  coalesce(b.size_bytes, t.size_bytes) AS size_bytes, CASE WHEN b.url IS NOT NULL THEN 'tls' ELSE kind END AS kind FROM t FULL JOIN b USING (url)""")
def g12(t):
    p = t.pages.select(
        F.regexp_extract("url", r"^https?://(?:m\.|www\.)?([^/]+)", 1).alias("url"), F.col("url").startswith("https").alias("secure"),
        F.col("page_id").alias("analyzed_at"), F.octet_length("html").cast("long").alias("size_bytes"))
    target = p.where("not secure").groupBy("url").agg(
        F.count("*").alias("analysis_count"), F.min("analyzed_at").alias("first_analyzed"), F.max("analyzed_at").alias("last_analyzed"),
        F.max("size_bytes").alias("size_bytes"), F.lit("web").alias("kind"))
    batch = p.where("secure").withColumn("kind", F.lit("tls"))
    return G.upsert_repositories(target, batch, ["size_bytes", "kind"])


@query("g12_stream_upserts", r"""
SELECT regexp_extract(url, '^https?://(?:m\.|www\.)?([^/]+)', 1) AS url, count(*) AS analysis_count, min(page_id) AS first_analyzed, max(page_id) AS last_analyzed,
  max_by(octet_length(encode(html)), page_id) AS size_bytes FROM pages GROUP BY 1""")
def g12s(t):
    """Pages in three files, a micro-batch each, merged into the table of hosts."""
    p = t.pages.select(
        F.regexp_extract("url", r"^https?://(?:m\.|www\.)?([^/]+)", 1).alias("url"), F.col("page_id").alias("analyzed_at"), F.octet_length("html").cast("long").alias("size_bytes"))
    folder = new_run_folder(t.spark, "repositories")
    low, high = p.agg(F.percentile_approx("analyzed_at", [0.3, 0.6])).first()[0] or (0, 0)
    for inside in (F.col("analyzed_at") < low, (F.col("analyzed_at") >= low) & (F.col("analyzed_at") < high), F.col("analyzed_at") >= high):
        p.where(inside).write.mode("append").parquet(f"{folder}/in")
        stream = t.spark.readStream.schema(p.schema).parquet(f"{folder}/in")
        write_repositories(stream, f"{folder}/table", f"{folder}/checkpoint", ["size_bytes"], buckets=16).awaitTermination()
    return t.spark.read.parquet(f"{folder}/table").drop("bucket", "last_batch")


@query("g13_job_statistics", f"""
SELECT status, count(*) AS jobs, round(avg(d), 4) AS avg_duration_ms, max(d) AS max_duration_ms,
  round(avg(CASE status WHEN 'completed' THEN 100 WHEN 'queued' THEN 0 ELSE 50 END), 4) AS avg_progress
FROM (SELECT status, date_diff('millisecond', started_at, completed_at) AS d FROM ({JOBS})) GROUP BY status""")
def g13(t):
    return G.job_statistics(B.jobs(t)).select(
        "status", "jobs", F.round("avg_duration_ms", 4).alias("avg_duration_ms"), "max_duration_ms", F.round("avg_progress", 4).alias("avg_progress"))


@query("g14_list_workflows", f"""
SELECT id, status, strftime(created_at, '%Y-%m-%d') AS created FROM ({JOBS}) WHERE status = 'running' AND created_at >= TIMESTAMP '1996-01-01' AND created_at < TIMESTAMP '1999-01-01'
  AND (created_at, id) > (TIMESTAMP '1996-03-15', 5000) ORDER BY created_at, id LIMIT 100""")
def g14(t):
    rows = B.jobs(t).select("id", "status", F.col("created_at").alias("ts"))
    page = G.list_workflows(rows, status="running", start=F.lit("1996-01-01").cast("timestamp"),
                            end=F.lit("1999-01-01").cast("timestamp"), token=("1996-03-15", 5000), page_size=100)
    return page.select("id", "status", F.date_format("ts", "yyyy-MM-dd").alias("created"))
