"""Registered queries: evidence packages and notarization outcomes."""

from pyspark.sql import functions as F

from tracewright.operators import evidence as I
from tracewright.plans import bindings as B
from tracewright.plans.registry import query

PIPE = B.SQL_PIPELINE
TYPE = "CASE event_kind WHEN 'model_deployment' THEN 'ai.model.deployment' WHEN 'data_pipeline' THEN 'ai.data.pipeline' WHEN 'inference' THEN 'ai.inference' WHEN 'compliance' THEN 'ai.compliance' ELSE 'ai.custom.' || custom_name END"


def evidence(t):
    """Packages with the flaws the validation rules look for, batched by source."""
    return B.pipeline_events(t).select(
        "seq", F.when(F.col("priority") == "low", "2.0.0").otherwise("1.0.0").alias("spec_version"), F.col("ts").alias("timestamp_utc"),
        F.when(F.col("event_id") == "", "").otherwise(I.event_type_name()).alias("event_type"), "actor", "artifacts", "metadata",
        F.col("source").alias("batch_id"))


SQL_EVID = f"""
SELECT seq, CASE WHEN priority = 'low' THEN '2.0.0' ELSE '1.0.0' END AS spec_version, CASE WHEN event_id = '' THEN '' ELSE {TYPE} END AS event_type, actor_id,
  name1, hash1, two, hash2, props, event_type AS kind, ts, source AS batch_id FROM ({PIPE})"""


@query("i1_package_hash", f"""
SELECT seq, base64(unhex(sha256('{{"spec_version":"' || spec_version || '","timestamp_utc":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z","event_type":"' || event_type ||
  '","actor":{{"type":"service","id":"' || actor_id || '"}},"artifacts":[{{"name":"' || name1 || '","uri":"s3://bucket/a","hash_sha256":"' || hash1 || '"}}' ||
  CASE WHEN two THEN ',{{"name":"report","hash_sha256":"' || hash2 || '"}}' ELSE '' END || '],"metadata":{{"kind":"' || kind || '","props":"' || replace(props, '"', chr(92) || '"') || '"}}}}'))) AS package_hash
FROM ({SQL_EVID})""")
def i1(t):
    return I.package_hash(evidence(t)).select("seq", "package_hash")


SQL_ERRS = """list_filter([CASE WHEN event_type = '' THEN 'Event type cannot be empty' END, CASE WHEN actor_id = '' THEN 'Actor ID cannot be empty' END,
  CASE WHEN name1 = '' THEN 'Artifact 0 has empty name' END, CASE WHEN hash1 = '' THEN 'Artifact 0 has empty hash' END,
  CASE WHEN two AND hash2 = '' THEN 'Artifact 1 has empty hash' END], lambda x: x IS NOT NULL)"""
SQL_WARN = """list_filter([CASE WHEN spec_version <> '1.0.0' THEN 'Using spec version ' || spec_version || ', recommended version is 1.0.0' END,
  CASE WHEN hash1 = 'not-a-hash' THEN 'Artifact 0 hash may not be valid hex: not-a-hash' END], lambda x: x IS NOT NULL)"""


@query("i2_validate_evidence", f"SELECT seq, array_to_string({SQL_ERRS}, '; ') AS errors, array_to_string({SQL_WARN}, '; ') AS warnings, len({SQL_ERRS}) = 0 AS is_valid FROM ({SQL_EVID})")
def i2(t):
    return I.validate_evidence(evidence(t)).select(
        "seq", F.array_join("errors", "; ").alias("errors"), F.array_join("warnings", "; ").alias("warnings"), "is_valid")


SQL_EVENT_ERROR = """CASE WHEN event_id = '' THEN 'Event ID is required' WHEN source = '' THEN 'Event source is required' WHEN actor_id = '' THEN 'Actor ID is required'
  WHEN workflow_type = 'approval_sign' AND no_approvers THEN 'Approval workflow requires at least one approver'
  WHEN name1 = '' THEN 'Artifact name is required' WHEN hash1 = '' THEN 'Artifact hash is required' WHEN two AND hash2 = '' THEN 'Artifact hash is required' END"""


@query("i3_validate_event", f"SELECT seq, {SQL_EVENT_ERROR} AS error FROM ({PIPE})")
def i3(t):
    return I.validate_event(B.pipeline_events(t)).select("seq", "error")


@query("i4_to_evidence", f"SELECT event_id, '1.0.0' AS spec_version, {TYPE} AS event_type, actor_id, CAST(1 + two::INT AS INT) AS artifacts FROM ({PIPE})")
def i4(t):
    return I.to_evidence(B.pipeline_events(t)).select(
        "event_id", "spec_version", "event_type", F.col("actor.id").alias("actor_id"), F.size("artifacts").alias("artifacts"))


def _kind_rows(t):
    """Rows that carry every column the eight builders read, from events."""
    u = F.col("user_id").cast("string")
    lit = {c: F.lit(c) for c in (
        "model_version", "training_job_id", "dataset_version", "compliance_checklist_id", "approved_environments", "validation_results",
        "scan_results", "compliance_framework", "access_purpose", "affected_systems", "change_type", "target_type")}
    who = {c: F.concat(F.lit("user"), u) for c in (
        "deployed_by", "trained_by", "approver", "validated_by", "scanned_by", "detected_by", "accessed_by", "changed_by")}
    ids = {c: F.concat(F.lit(c + "-"), u) for c in ("model_id", "dataset_id", "target_id", "component")}
    when = {c: F.date_format("ts", "yyyy-MM-dd") for c in ("detection_time", "access_granted_at", "changed_at")}
    return t.events.select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("string").alias("incident_id"), "event_type",
        F.when(F.col("value") > 50, "critical").otherwise("low").alias("severity"),
        F.when(F.col("value") > 20, "confidential").otherwise("public").alias("data_classification"),
        F.lit("production").alias("environment"), F.floor("value").alias("accuracy"), (F.col("value") > 5).alias("is_valid"),
        F.when(F.col("value") > 5, "compliant").otherwise("warning").alias("compliance_status"),
        F.create_map(F.lit("ticket"), F.col("event_id").cast("string")).alias("details"),
        *[v.alias(k) for m in (lit, who, ids, when) for k, v in m.items()])


@query("i5_evidence_from", """
SELECT event_type, actor_type, actor_id, flag, count(*) AS packages FROM (
  SELECT 'ai.model.deployment.completed' AS event_type, 'deployment_system' AS actor_type, 'user' || user_id AS actor_id, 'production' AS flag FROM events
  UNION ALL SELECT 'ai.model.training.completed', 'training_system', 'user' || user_id, CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) FROM events
  UNION ALL SELECT 'ai.model.approval.granted', 'human_user', 'user' || user_id, 'passed all compliance checks' FROM events
  UNION ALL SELECT 'ai.dataset.validation.completed', 'validation_system', 'user' || user_id, CASE WHEN value > 5 THEN 'true' ELSE 'false' END FROM events
  UNION ALL SELECT 'compliance.scan.completed', 'compliance_system', 'user' || user_id, CASE WHEN value > 5 THEN 'compliant' ELSE 'warning' END FROM events
  UNION ALL SELECT 'security.incident.detected', 'security_system', 'user' || user_id, CASE WHEN value > 50 THEN 'true' ELSE 'false' END FROM events
  UNION ALL SELECT 'data.access.granted', 'human_user', 'user' || user_id, CASE WHEN value > 20 THEN 'true' ELSE 'false' END FROM events
  UNION ALL SELECT 'system.configuration.changed', 'human_user', 'user' || user_id, CAST(event_id AS VARCHAR) FROM events) GROUP BY ALL""")
def i5(t):
    rows = _kind_rows(t)
    shown = {"model_deployment": "environment", "model_training": "accuracy", "model_approval": "approval_reason",
             "dataset_validation": "is_valid", "compliance_scan": "compliance_status", "security_incident": "requires_immediate_action",
             "data_access": "requires_audit", "configuration_change": "ticket"}
    out = None
    for kind, key in shown.items():
        part = I.evidence_from(rows, kind).select(
            "event_type", F.col("actor.type").alias("actor_type"), F.col("actor.id").alias("actor_id"), F.col("metadata")[key].alias("flag"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("event_type", "actor_type", "actor_id", "flag").agg(F.count("*").alias("packages"))


@query("i6_validate_dataset", """
SELECT count(*) AS rows, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS duplicate_records_count,
  round(100.0 * count(*) FILTER (l_returnflag = 'R') / (count(*) * 3), 6) AS missing_values_percentage, true AS schema_validation,
  round((1 - count(*) FILTER (l_returnflag = 'R') / (count(*) * 3)) * (1 - (count(*) - count(DISTINCT (l_orderkey, l_linenumber))) / count(*)), 6) AS data_quality_score, false AS is_valid
FROM lineitem""")
def i6(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") != "R", F.col("l_quantity")).alias("l_quantity"))
    out = I.validate_dataset(rows, ["l_orderkey", "l_linenumber"], {"l_orderkey": "bigint", "l_quantity": "double"})
    return out.withColumn("missing_values_percentage", F.round("missing_values_percentage", 6)).withColumn(
        "data_quality_score", F.round("data_quality_score", 6))


@query("i7_scan_result", """
SELECT target_id, CAST(sum(p) AS BIGINT) AS checks_passed, CAST(sum(f) AS BIGINT) AS checks_failed, CAST(sum(s) AS BIGINT) AS checks_skipped,
  CASE WHEN sum(f) > 0 THEN 'non_compliant' WHEN sum(s) > 0 THEN 'warning' ELSE 'compliant' END AS status,
  coalesce(string_agg(rule_id || '=' || f, ';' ORDER BY rule_id) FILTER (f > 0), '') AS violations FROM (
  SELECT user_id AS target_id, event_type AS rule_id, count(*) FILTER (value < 60) AS p, count(*) FILTER (value >= 85) AS f, count(*) FILTER (value >= 60 AND value < 85) AS s FROM events GROUP BY ALL) GROUP BY target_id""")
def i7(t):
    outcome = F.when(F.col("value") < 60, "passed").when(F.col("value") >= 85, "failed").otherwise("skipped")
    checks = t.events.select(F.col("user_id").alias("target_id"), F.col("event_type").alias("rule_id"), outcome.alias("outcome"))
    v = F.array_join(F.transform("violations", lambda x: F.concat_ws("=", x["rule_id"], x["count"].cast("string"))), ";")
    return I.scan_result(checks).withColumn("violations", v)


@query("i8_filter_events", f"""
SELECT seq FROM ({PIPE}) WHERE {TYPE} IN ('ai.inference', 'ai.compliance', 'ai.custom.step1') AND source IN ('src1', 'src2', 'src3') AND priority IN ('normal', 'high', 'critical')""")
def i8(t):
    return I.filter_events(B.pipeline_events(t), ["ai.inference", "ai.compliance", "ai.custom.step1"], ["src1", "src2", "src3"], "normal").select("seq")


SQL_ROUTE = "CASE workflow_type WHEN 'simple_sign' THEN 'simple' WHEN 'approval_sign' THEN 'approval' WHEN 'batch_sign' THEN 'batch' END"


@query("i9_route_workflow", f"SELECT seq, {SQL_ROUTE} AS route, CASE WHEN workflow_type = 'custom_flow' THEN 'Custom workflow not supported: custom_flow' END AS route_error FROM ({PIPE})")
def i9(t):
    return I.route_workflow(B.pipeline_events(t)).select("seq", "route", "route_error")


@query("i10_batch_outcome", f"""
SELECT batch_id, count(*) AS total_packages, count(*) FILTER (len({SQL_ERRS}) = 0) AS successful_count, count(*) FILTER (len({SQL_ERRS}) > 0) AS failed_count FROM ({SQL_EVID}) GROUP BY batch_id""")
def i10(t):
    return I.batch_outcome(evidence(t))


@query("i10_batch_failures", f"SELECT seq, array_to_string({SQL_ERRS}, '; ') AS error FROM ({SQL_EVID}) WHERE len({SQL_ERRS}) > 0")
def i10f(t):
    return I.split_batch(evidence(t))[1].select("seq", "error")


@query("i11_verify_receipts", """
SELECT event_id, coalesce(user_id + (value > 80)::INT = e.log_index, false) AS verified FROM events r
LEFT JOIN (SELECT o_orderkey AS log_id, o_custkey % 150 AS log_index FROM orders WHERE o_orderstatus <> 'P') e ON e.log_id = r.event_id""")
def i11(t):
    receipts = t.events.select("event_id", F.col("event_id").alias("log_id"), (F.col("user_id") + (F.col("value") > 80).cast("int")).alias("log_index"))
    log = t.orders.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("log_id"), (F.col("o_custkey") % 150).alias("log_index"))
    return I.verify_receipts(receipts, log).select("event_id", "verified")


@query("i12_approval_state", """
WITH a AS (SELECT l_orderkey AS id, 'role' || l_linenumber % 3 AS role, CASE WHEN l_returnflag = 'R' AND l_linestatus = 'O' AND l_quantity > 45 THEN 'rejected' WHEN l_returnflag = 'N' THEN 'pending' ELSE 'approved' END AS status, l_shipdate AS done FROM lineitem),
r AS (SELECT o_orderkey AS id, CASE WHEN o_orderpriority < '3' THEN ['role0', 'role1', 'role2'] ELSE ['role1'] END AS required, o_orderdate + INTERVAL 730 DAY AS expires_at FROM orders)
SELECT id, outstanding, CASE WHEN rej THEN 'rejected' WHEN outstanding = '' THEN 'approved' WHEN TIMESTAMP '2001-01-01' > expires_at THEN 'expired' ELSE 'pending' END AS state FROM (
  SELECT r.id, expires_at, coalesce(rej, false) AS rej, array_to_string(list_sort(list_filter(required, lambda x: NOT coalesce(list_contains(ok, x), false))), ',') AS outstanding FROM r
  LEFT JOIN (SELECT r.id, list(DISTINCT role) FILTER (status = 'approved' AND done <= expires_at) AS ok, bool_or(status = 'rejected' AND done <= expires_at) AS rej FROM r JOIN a ON a.id = r.id GROUP BY r.id) g ON g.id = r.id)""")
def i12(t):
    q = F.col("l_quantity")
    approvals = t.lineitem.select(
        F.col("l_orderkey").alias("id"), F.concat(F.lit("role"), (F.col("l_linenumber") % 3).cast("string")).alias("role"),
        F.when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "O") & (q > 45), "rejected")
        .when(F.col("l_returnflag") == "N", "pending").otherwise("approved").alias("status"),
        F.col("l_shipdate").cast("timestamp").alias("responded_at"))
    requests = t.orders.select(
        F.col("o_orderkey").alias("id"),
        F.when(F.col("o_orderpriority") < "3", F.array(F.lit("role0"), F.lit("role1"), F.lit("role2"))).otherwise(F.array(F.lit("role1"))).alias("required"),
        (F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(days=F.lit(730))).alias("expires_at"))
    out = I.approval_state(requests, approvals, F.lit("2001-01-01").cast("timestamp"))
    return out.select("id", F.array_join("outstanding", ",").alias("outstanding"), "state")


ERRORS = {"view": "ValidationError", "click": "TransportError", "error": "VaultError", "purchase": "SerializationError", "signup": "TemporalError"}
SQL_ERRORS = f"SELECT event_id, {B.sql_case(ERRORS, 'event_type')} AS error_name FROM events"


def _errors(t):
    return t.events.select("event_id", B._pick(ERRORS, "event_type").alias("error_name"))


@query("i13_classify_errors", f"""
SELECT event_id, CASE error_name WHEN 'ValidationError' THEN 'validation' WHEN 'TransportError' THEN 'network' WHEN 'VaultError' THEN 'signing' WHEN 'TemporalError' THEN 'workflow' ELSE 'internal' END AS error_type,
  error_name NOT IN ('ValidationError', 'SerializationError', 'AuthenticationError') AS retryable FROM ({SQL_ERRORS})""")
def i13(t):
    return I.classify_errors(_errors(t)).select("event_id", "error_type", "retryable")


@query("i14_retry_schedule", f"""
SELECT event_id, CAST(a AS INT) AS attempt, CAST(least(30 * pow(2, a), 300) AS BIGINT) AS delay_seconds FROM ({SQL_ERRORS}), range(5) r(a) WHERE error_name NOT IN ('ValidationError', 'SerializationError')""")
def i14(t):
    bad = I.classify_errors(_errors(t)).where("retryable")
    return I.retry_schedule(bad, 5).select("event_id", "attempt", "delay_seconds")


STATUS = {"view": "received", "click": "started", "error": "failed", "purchase": "processing", "signup": "completed"}


def status_rows(t):
    return t.events.select(
        F.col("user_id").alias("workflow_id"), F.col("event_id").alias("status_id"), B._pick(STATUS, "event_type").alias("status"),
        F.col("ts").cast("timestamp").alias("ts"), F.floor("value").alias("percentage"))


@query("i15_latest_status", f"""
SELECT user_id AS workflow_id, max_by({B.sql_case(STATUS, 'event_type')}, (ts, event_id)) AS status, max_by(CAST(floor(value) AS BIGINT), (ts, event_id)) AS percentage,
  count(*) AS updates, date_sub('millisecond', min(ts), max(ts)) AS duration_ms FROM events GROUP BY user_id""")
def i15(t):
    return I.latest_status(status_rows(t))


@query("i16_outcome_feed", """
SELECT 'result' AS feed, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, value > 10 AS success, CAST(NULL AS VARCHAR) AS message FROM events WHERE event_type = 'purchase'
UNION ALL SELECT 'status', event_id, strftime(ts, '%Y-%m-%d %H:%M:%S'), NULL, props FROM events WHERE event_type IN ('view', 'click', 'signup')
UNION ALL SELECT 'error', event_id, strftime(ts, '%Y-%m-%d %H:%M:%S'), NULL, 'failed' FROM events WHERE event_type = 'error'""")
def i16(t):
    e = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    feed = I.outcome_feed(
        e.where("event_type = 'purchase'").select("event_id", "ts", (F.col("value") > 10).alias("success")),
        e.where("event_type in ('view', 'click', 'signup')").select("event_id", "ts", F.col("props").alias("message")),
        e.where("event_type = 'error'").select("event_id", "ts", F.lit("failed").alias("message")))
    return feed.select("feed", "event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "success", "message")


@query("i17_audit_rows", """
SELECT event_id, CASE WHEN value > 10 THEN 'evidence.notarized' ELSE 'evidence.notarization_failed' END AS event_type, 'user' || user_id AS actor,
  CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS duration_ms FROM events""")
def i17(t):
    out = t.events.select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("value") > 10).alias("success"),
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("actor"), F.floor("value").alias("processing_duration_ms"),
        F.lit(None).cast("string").alias("error"))
    return I.audit_rows(out).select("event_id", "event_type", "actor", F.col("context")["duration_ms"].alias("duration_ms"))
