"""Evidence packages, pipeline events and notarization outcomes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.model import PRIORITIES, lookup, rank_of

# Versions, type names, error classes, retry policy.
SPEC_VERSION = "1.0.0"
EVENT_TYPE_NAMES = {
    "model_deployment": "ai.model.deployment", "data_pipeline": "ai.data.pipeline", "inference": "ai.inference",
    "compliance": "ai.compliance",
}
ROUTES = {"simple_sign": "simple", "approval_sign": "approval", "batch_sign": "batch"}
ERROR_CLASSES = {
    "ValidationError": "validation", "AuthenticationError": "authentication", "VaultError": "signing",
    "RekorError": "transparency", "TemporalError": "workflow", "TransportError": "network",
}
NOT_RETRYABLE = ["ValidationError", "SerializationError", "AuthenticationError"]
MAX_RETRIES, FIRST_DELAY, BACKOFF, MAX_DELAY = 3, 30, 2.0, 300


def canonical_json(evidence: DataFrame) -> Column:
    """The package as JSON with fixed field order and sorted metadata keys."""
    meta = F.map_from_entries(F.array_sort(F.map_entries("metadata")))
    stamp = F.date_format("timestamp_utc", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return F.to_json(F.struct(
        "spec_version", stamp.alias("timestamp_utc"), "event_type", "actor", "artifacts", meta.alias("metadata")))


def package_hash(evidence: DataFrame) -> DataFrame:
    return evidence.withColumn("package_hash", F.base64(F.unhex(F.sha2(canonical_json(evidence), 256))))


def validate_evidence(evidence: DataFrame) -> DataFrame:
    """Error and warning lists with artifact positions; valid when there are no errors."""
    def empty(c: Column) -> Column:
        return F.coalesce(c, F.lit("")) == ""

    def numbered(i: Column, text: str) -> Column:
        return F.concat(F.lit("Artifact "), i.cast("string"), F.lit(text))

    def artifact_errors(a: Column, i: Column) -> Column:
        return F.array(
            F.when(empty(a["name"]), numbered(i, " has empty name")),
            F.when(empty(a["hash_sha256"]), numbered(i, " has empty hash")))

    def hash_warning(a: Column, i: Column) -> Column:
        return F.when(
            a["hash_sha256"].rlike(r"[^0-9a-fA-F]"),
            F.concat(numbered(i, " hash may not be valid hex: "), a["hash_sha256"]))

    errors = F.concat(
        F.array(F.when(empty(F.col("event_type")), F.lit("Event type cannot be empty")),
                F.when(empty(F.col("actor.id")), F.lit("Actor ID cannot be empty"))),
        F.flatten(F.transform("artifacts", artifact_errors)))
    version = F.when(
        F.col("spec_version") != SPEC_VERSION,
        F.concat(F.lit("Using spec version "), F.col("spec_version"), F.lit(f", recommended version is {SPEC_VERSION}")))
    warnings = F.concat(F.array(version), F.transform("artifacts", hash_warning))
    return (
        evidence.withColumn("errors", F.array_compact(errors)).withColumn("warnings", F.array_compact(warnings))
        .withColumn("is_valid", F.size("errors") == 0)
    )


def event_error(df: DataFrame) -> Column:
    """The first failed check of a pipeline event, null when it is valid."""
    def empty(c: Column) -> Column:
        return F.coalesce(c, F.lit("")) == ""

    first_bad = F.get(F.array_compact(F.transform("artifacts", lambda a: F.when(
        empty(a["name"]), F.lit("Artifact name is required")).when(
        empty(a["hash_sha256"]), F.lit("Artifact hash is required")))), F.lit(0))
    no_approver = (F.col("workflow_type") == "approval_sign") & (F.size("approvers") == 0)
    return (
        F.when(empty(F.col("event_id")), "Event ID is required")
        .when(empty(F.col("source")), "Event source is required")
        .when(empty(F.col("actor.id")), "Actor ID is required")
        .when(no_approver, "Approval workflow requires at least one approver")
        .otherwise(first_bad)
    )


def validate_event(events: DataFrame) -> DataFrame:
    return events.withColumn("error", event_error(events))


def event_type_name() -> Column:
    return F.coalesce(
        lookup(EVENT_TYPE_NAMES, F.col("event_kind")), F.concat(F.lit("ai.custom."), F.col("custom_name")))


def to_evidence(events: DataFrame) -> DataFrame:
    keep = [c for c in ("event_id", "trace_id") if c in events.columns]
    return events.select(
        *keep, F.lit(SPEC_VERSION).alias("spec_version"), F.col("ts").alias("timestamp_utc"),
        event_type_name().alias("event_type"), "actor", "artifacts", "metadata")


# The eight evidence kinds: type name, actor kind, actor column, metadata columns.
EVIDENCE_KINDS = {
    "model_deployment": ("ai.model.deployment.completed", "deployment_system", "deployed_by",
                         ["model_id", "model_version", "environment"]),
    "model_training": ("ai.model.training.completed", "training_system", "trained_by",
                       ["model_id", "training_job_id", "dataset_version", "accuracy"]),
    "model_approval": ("ai.model.approval.granted", "human_user", "approver",
                       ["model_id", "model_version", "compliance_checklist_id", "approved_environments"]),
    "dataset_validation": ("ai.dataset.validation.completed", "validation_system", "validated_by",
                           ["dataset_id", "dataset_version", "validation_results", "is_valid"]),
    "compliance_scan": ("compliance.scan.completed", "compliance_system", "scanned_by",
                        ["target_id", "target_type", "compliance_framework", "scan_results", "compliance_status"]),
    "security_incident": ("security.incident.detected", "security_system", "detected_by",
                          ["incident_id", "severity", "affected_systems", "detection_time"]),
    "data_access": ("data.access.granted", "human_user", "accessed_by",
                    ["dataset_id", "access_purpose", "data_classification", "access_granted_at"]),
    "configuration_change": ("system.configuration.changed", "human_user", "changed_by",
                             ["component", "change_type", "changed_at"]),
}
# Constant metadata per kind.
EVIDENCE_CONSTANTS = {
    "model_deployment": {"deployment_type": "production"},
    "model_training": {"training_duration_seconds": "0"},
    "model_approval": {"approval_reason": "passed all compliance checks"},
}


def evidence_from(rows: DataFrame, kind: str, providers: dict[str, str] | None = None) -> DataFrame:
    """Domain rows as evidence packages; configuration changes also carry every entry of ``details``."""
    event_type, actor_kind, actor_id, fields = EVIDENCE_KINDS[kind]
    pairs: list[Column] = []
    for f in fields:
        pairs += [F.lit(f), F.col(f).cast("string")]
    for k, v in EVIDENCE_CONSTANTS.get(kind, {}).items():
        pairs += [F.lit(k), F.lit(v)]
    if kind == "security_incident":
        pairs += [F.lit("requires_immediate_action"), (F.col("severity") == "critical").cast("string")]
    if kind == "data_access":
        pairs += [F.lit("requires_audit"), (F.col("data_classification") == "confidential").cast("string")]
    metadata = F.create_map(*pairs)
    if kind == "configuration_change" and "details" in rows.columns:
        clash = F.map_filter("details", lambda k, _: ~k.isin(fields))
        metadata = F.map_concat(metadata, clash)
    provider = (providers or {}).get(actor_kind, "keycloak" if actor_kind == "human_user" else "internal")
    actor = F.struct(
        F.lit(actor_kind).alias("type"), F.col(actor_id).cast("string").alias("id"),
        F.lit(provider).alias("auth_provider"))
    no_artifacts = F.array().cast("array<struct<name:string,uri:string,hash_sha256:string>>")
    return rows.select(
        F.lit(SPEC_VERSION).alias("spec_version"), F.col("ts").alias("timestamp_utc"),
        F.lit(event_type).alias("event_type"), actor.alias("actor"),
        (F.col("artifacts") if "artifacts" in rows.columns else no_artifacts).alias("artifacts"),
        metadata.alias("metadata"))


def validate_dataset(df: DataFrame, keys: Sequence[str], required: dict[str, str] | None = None) -> DataFrame:
    """One row: schema match, missing share, duplicate rows by key, quality score and validity.

    Missing values and key counts are partially aggregated; duplicates come from per-key counts.
    """
    missing = sum((F.when(F.col(c).isNull(), 1).otherwise(0) for c in df.columns), F.lit(0))
    per_key = df.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(missing).alias("missing"))
    types = dict(df.dtypes)
    schema_ok = all(types.get(c) == t for c, t in (required or {}).items())
    totals = per_key.agg(
        F.sum("n").alias("rows"), (F.sum("n") - F.count("*")).alias("duplicate_records_count"),
        (100.0 * F.sum("missing") / (F.sum("n") * len(df.columns))).alias("missing_values_percentage"))
    share = F.col("duplicate_records_count") / F.col("rows")
    score = (1 - F.col("missing_values_percentage") / 100) * (1 - share)
    return totals.withColumn("schema_validation", F.lit(schema_ok)).withColumn("data_quality_score", score).withColumn(
        "is_valid", F.lit(schema_ok) & (F.col("duplicate_records_count") == 0) & (F.col("missing_values_percentage") == 0))


def scan_result(checks: DataFrame, by: str = "target_id") -> DataFrame:
    """Passed / failed / skipped counts and the violated rules with counts (bounded by the rule set)."""
    per_rule = checks.groupBy(by, "rule_id").agg(
        *[F.count_if(F.col("outcome") == o).alias(o) for o in ("passed", "failed", "skipped")])
    violated = F.when(F.col("failed") > 0, F.struct("rule_id", F.col("failed").alias("count")))
    out = per_rule.groupBy(by).agg(
        *[F.sum(o).alias(f"checks_{o}") for o in ("passed", "failed", "skipped")],
        F.array_sort(F.collect_list(violated)).alias("violations"))
    return out.withColumn("status", F.when(F.col("checks_failed") > 0, "non_compliant").when(
        F.col("checks_skipped") > 0, "warning").otherwise("compliant"))


def filter_events(
    events: DataFrame, types: Sequence[str] | None = None, sources: Sequence[str] | None = None,
    min_priority: str = "low",
) -> DataFrame:
    """Row predicates only, so the same call works on a stream."""
    out = events
    if types is not None:
        out = out.where(event_type_name().isin(list(types)))
    if sources is not None:
        out = out.where(F.col("source").isin(list(sources)))
    return out.where(rank_of(PRIORITIES, "priority") >= PRIORITIES.index(min_priority) + 1)


def route_workflow(events: DataFrame) -> DataFrame:
    route = lookup(ROUTES, F.col("workflow_type"))
    problem = F.when(route.isNull(), F.concat(F.lit("Custom workflow not supported: "), F.col("workflow_type")))
    return events.withColumn("route", route).withColumn("route_error", problem)


def batch_outcome(evidence: DataFrame, batch: str = "batch_id") -> DataFrame:
    checked = validate_evidence(evidence)
    return checked.groupBy(batch).agg(
        F.count("*").alias("total_packages"), F.count_if("is_valid").alias("successful_count"),
        F.count_if(~F.col("is_valid")).alias("failed_count"))


def split_batch(evidence: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Successes and failures of a batch, the failures with their joined error text."""
    checked = validate_evidence(evidence)
    return checked.where("is_valid"), checked.where("not is_valid").withColumn("error", F.array_join("errors", "; "))


def verify_receipts(receipts: DataFrame, log: DataFrame) -> DataFrame:
    entries = log.select("log_id", F.col("log_index").alias("_entry"))
    return receipts.join(entries, "log_id", "left").withColumn(
        "verified", F.coalesce(F.col("log_index") == F.col("_entry"), F.lit(False))).drop("_entry")


def approval_state(requests: DataFrame, approvals: DataFrame, as_of: Column) -> DataFrame:
    """State per request(id, required, expires_at) from approvals(id, role, status, responded_at).

    Answers after the deadline do not count. Roles per request are bounded by the role list.
    """
    answers = approvals.groupBy("id", "role").agg(
        F.min(F.when(F.col("status") == "approved", F.col("responded_at"))).alias("approved_at"),
        F.min(F.when(F.col("status") == "rejected", F.col("responded_at"))).alias("rejected_at"))
    due = requests.select("id", "expires_at")
    counted = answers.join(due, "id").groupBy("id").agg(
        F.collect_set(F.when(F.col("approved_at") <= F.col("expires_at"), F.col("role"))).alias("approved"),
        F.bool_or(F.coalesce(F.col("rejected_at") <= F.col("expires_at"), F.lit(False))).alias("rejected"))
    none = F.array().cast("array<string>")
    rows = requests.join(counted, "id", "left").withColumn("approved", F.coalesce("approved", none))
    open_roles = F.array_sort(F.array_except("required", "approved"))
    return rows.withColumn("outstanding", open_roles).withColumn(
        "state",
        F.when(F.coalesce("rejected", F.lit(False)), "rejected").when(F.size("outstanding") == 0, "approved")
        .when(as_of > F.col("expires_at"), "expired").otherwise("pending")
    ).drop("rejected", "approved")


def classify_errors(errors: DataFrame) -> DataFrame:
    return errors.withColumn("error_type", F.coalesce(lookup(ERROR_CLASSES, F.col("error_name")), F.lit("internal"))
                             ).withColumn("retryable", ~F.col("error_name").isin(NOT_RETRYABLE))


def retry_delay(attempt: Column) -> Column:
    """Seconds to wait after the attempt of that number, from 0 on."""
    return F.least(F.lit(FIRST_DELAY) * F.pow(F.lit(BACKOFF), attempt), F.lit(MAX_DELAY)).cast("long")


def retry_schedule(errors: DataFrame, retries: int = MAX_RETRIES) -> DataFrame:
    """One row per retry: its delay and the time it is due."""
    rows = errors.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(retries - 1))))
    return rows.withColumn("delay_seconds", retry_delay(F.col("attempt")))


def latest_status(status: DataFrame) -> DataFrame:
    """Latest status, progress and elapsed time per workflow; one partial aggregate, no window."""
    last = F.max_by(F.struct("status", "percentage", "ts"), F.struct("ts", "status_id"))
    return status.groupBy("workflow_id").agg(last.alias("_l"), F.min("ts").alias("_first"), F.count("*").alias("updates")).select(
        "workflow_id", F.col("_l.status").alias("status"), F.col("_l.percentage").alias("percentage"), "updates",
        F.timestamp_diff("MILLISECOND", F.col("_first"), F.col("_l.ts")).alias("duration_ms"))


def outcome_feed(results: DataFrame, status: DataFrame, errors: DataFrame) -> DataFrame:
    """One feed of results, status updates and errors; sort by ts where an ordered view is needed."""
    def tagged(df: DataFrame, kind: str) -> DataFrame:
        return df.withColumn("feed", F.lit(kind))

    return tagged(results, "result").unionByName(tagged(status, "status"), allowMissingColumns=True).unionByName(
        tagged(errors, "error"), allowMissingColumns=True)


def audit_rows(outcomes: DataFrame) -> DataFrame:
    ident = F.sha2(F.concat_ws("|", F.lit("audit"), "event_id", F.col("ts").cast("string")), 256)
    return outcomes.select(
        ident.alias("audit_id"),
        F.when(F.col("success"), "evidence.notarized").otherwise("evidence.notarization_failed").alias("event_type"),
        "actor", "ts", "event_id",
        F.create_map(F.lit("duration_ms"), F.col("processing_duration_ms").cast("string"), F.lit("error"),
                     F.coalesce(F.col("error"), F.lit(""))).alias("context"))
