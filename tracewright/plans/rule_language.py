"""Registered queries: the rule-language functions over request rows, and the sinks read back."""

from pyspark.sql import functions as F

from tracewright.functions import predicates as L
from tracewright.operators import reports as G
from tracewright.operators.files import classify_sensitivity
from tracewright.plans import bindings as B
from tracewright.plans.evidence import SQL_EVENT_ERROR, SQL_ROUTE
from tracewright.plans.files import _typed
from tracewright.plans.policy import REQ, requests
from tracewright.plans.registry import query
from tracewright.plans.streaming import StreamTables
from tracewright.sources import files as S
from tracewright.streaming import jobs as J
from tracewright.streaming import topics as P


@query("j_quantifiers", f"""
SELECT request_id, len(list_filter(risk_factors, lambda x: length(x) > 9)) = len(risk_factors) AS all_long, list_contains(risk_factors, 'new_model') AS has_new,
  CAST(len(list_filter(risk_factors, lambda x: contains(x, 'data') OR contains(x, 'access'))) AS INT) AS data_factors,
  round(list_avg([length(x) FOR x IN risk_factors IF contains(x, '_')]), 6) AS avg_length, CAST(coalesce(list_sum([length(x) FOR x IN risk_factors]), 0) AS DOUBLE) AS total_length
FROM ({REQ})""")
def quantifiers(t):
    f = F.col("risk_factors")
    return requests(t).select(
        "request_id", L.every(f, lambda x: F.length(x) > 9).alias("all_long"), L.some(f, lambda x: x == "new_model").alias("has_new"),
        L.count_where(f, lambda x: x.contains("data") | x.contains("access")).alias("data_factors"),
        F.round(L.average_where(f, lambda x: x.contains("_"), F.length), 6).alias("avg_length"),
        L.total(F.transform(f, F.length)).alias("total_length"))


@query("j_text_functions", f"""
SELECT request_id, 'ai-deployment-' || user_id || '-v' || len(roles) AS policy_name, upper(environment) AS environment, split_part(user_id || '@x.example', '@', 2) AS domain,
  user_id <> 'user7' AS valid_email, length(owner) BETWEEN 3 AND 50 AS valid_name, action = 'evaluate' AS sensitive, round(round(amount / 7 * 100) / 100, 2) AS rounded
FROM ({REQ})""")
def text_functions(t):
    mail = F.when(F.col("user_id") == "user7", "user7").otherwise(F.concat("user_id", F.lit("@x.example")))
    note = F.when(F.col("action") == "evaluate", "rotate the API_KEY").otherwise("none")
    return requests(t).select(
        "request_id", F.format_string("ai-deployment-%s-v%d", "user_id", F.size("roles")).alias("policy_name"), F.upper("environment").alias("environment"),
        F.split_part(F.concat("user_id", F.lit("@x.example")), F.lit("@"), F.lit(2)).alias("domain"), L.valid_email(mail).alias("valid_email"),
        L.valid_model_name(F.col("owner")).alias("valid_name"), L.mentions_sensitive(note).alias("sensitive"),
        F.round(L.rounded(F.col("amount") / 7), 2).alias("rounded"))


@query("j_clock_functions", """
SELECT event_id, round(date_sub('second', ts, TIMESTAMP '2024-03-01') / 3600, 6) AS age_hours, isodow(ts) <= 5 AND hour(ts) BETWEEN 9 AND 17 AS business_hours,
  hour(ts) < 6 OR hour(ts) > 22 AS emergency_hours FROM events""")
def clock_functions(t):
    ts = F.col("ts").cast("timestamp")
    return t.events.select(
        "event_id", F.round(L.age_hours(ts, F.lit("2024-03-01").cast("timestamp")), 6).alias("age_hours"),
        L.business_hours(ts).alias("business_hours"), L.emergency_hours(ts).alias("emergency_hours"))


@query("j_collection_functions", f"""
SELECT request_id, array_to_string(list_sort(list_distinct(list_concat(risk_factors, roles))), ',') AS unique_sorted,
  array_to_string(list_sort(list_filter(['lead', 'user', 'admin'], lambda x: NOT list_contains(roles, x))), ',') AS missing,
  array_to_string(list_filter(['user', 'service'], lambda x: list_contains(roles, x)), ',') AS common,
  CAST(len(list_distinct([length(x) FOR x IN risk_factors])) AS INT) AS groups FROM ({REQ})""")
def collection_functions(t):
    texts = lambda *v: F.array(*[F.lit(x) for x in v])
    sized = F.transform("risk_factors", lambda x: F.struct(F.length(x).alias("size"), x.alias("name")))
    return requests(t).select(
        "request_id", F.array_join(F.array_sort(F.array_distinct(F.concat("risk_factors", "roles"))), ",").alias("unique_sorted"),
        F.array_join(F.array_sort(F.array_except(texts("lead", "user", "admin"), F.col("roles"))), ",").alias("missing"),
        F.array_join(F.array_intersect(texts("user", "service"), F.col("roles")), ",").alias("common"),
        F.size(L.group_by_type(sized, "size")).alias("groups"))


@query("a8_write_outcomes", f"""
SELECT CASE WHEN bad IS NOT NULL OR route IS NULL THEN 'errors' WHEN route = 'simple' THEN 'results' ELSE 'status' END AS name, coalesce(route, 'none') AS route, seq, event_id,
  coalesce(route, 'none') || '-signing-' || event_id AS workflow_id FROM (SELECT seq, event_id, {SQL_EVENT_ERROR} AS bad, {SQL_ROUTE} AS route FROM ({B.SQL_PIPELINE}))""")
def write_outcomes(t):
    """Every message of the three outcome tables with its keys."""
    folder = P.new_run_folder(t.spark, "outcomes")
    outcomes = J.notarization_outcomes(B.pipeline_events(StreamTables(t.spark, t.folder)))
    P.write_outcomes(outcomes, folder, f"{folder}/checkpoint").awaitTermination()
    out = None
    for name in P.OUTCOME_TABLES:
        part = P.read_table(t.spark, folder, name).select(F.lit(name).alias("name"), F.coalesce("route", F.lit("none")).alias("route"), "seq", "event_id", "workflow_id")
        out = part if out is None else out.unionByName(part)
    return out


@query("a11_write_report", f"""
SELECT source AS job_id, count(*) AS total_files, CASE WHEN bool_or(crit) THEN 'non_compliant' ELSE 'compliant' END AS status FROM documents
LEFT JOIN (SELECT 'src' || CAST(substr(job_id, 4) AS INT) % 20 AS src, bool_or(severity = 'critical') AS crit FROM ({B.SQL_FINDINGS}) GROUP BY 1) ON src = source GROUP BY source""")
def write_report(t):
    src = F.concat(F.lit("src"), (F.substring("job_id", 4, 20).cast("int") % 20).cast("string"))
    jobs = t.documents.select(F.col("source").alias("job_id")).distinct()
    report = G.build_report(jobs, B.findings(t).withColumn("job_id", src), classify_sensitivity(_typed(t)), F.lit("2024-06-01").cast("timestamp"))
    folder = P.new_run_folder(t.spark, "reports")
    S.write_report(report, folder)
    fields = "job_id string, files struct<total_files: bigint>, security_compliance struct<status: string>"
    return t.spark.read.schema(fields).json(folder).select("job_id", "files.total_files", F.col("security_compliance.status").alias("status"))


@query("a12_archive_events", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12'")
def archive_events(t):
    folder = P.new_run_folder(t.spark, "archive")
    e = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    S.archive_events(e, folder, F.lit("2024-01-05").cast("timestamp"), F.lit("2024-01-12").cast("timestamp"))
    return t.spark.read.parquet(folder).select("event_id", F.col("day").cast("string").alias("day"))
