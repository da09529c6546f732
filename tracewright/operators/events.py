"""Intelligence events: building, routing, limits, delivery and schema checks.

Everything here is row-local or a plain join, so it runs the same on a batch and on a stream,
except ``rate_limit`` (batch; the streaming form is in ``tracewright.streaming``).
"""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.functions.fold import calm_pieces, fold_sorted
from tracewright.functions.skew import grid_join, join_counted
from tracewright.model import lookup
from tracewright.operators.evidence import classify_errors, event_error
from tracewright.operators.reports import finding_risk, job_risk, publishable

__all__ = ["publishable"]

# Event kind by finding type (anything else is a threat).
KIND_BY_FINDING = {
    "malware": "malware", "backdoor": "malware", "data_leak": "data_leak", "secret_exposure": "data_leak",
    "vulnerability": "vulnerability", "anomaly": "anomaly",
}
DISTRIBUTION_PRIORITY = {"critical": "immediate", "high": "high"}


@dataclass(frozen=True)
class Network:
    name: str
    topics: tuple[str, ...]
    filter_rules: tuple[str, ...]
    priority: str


# The sample networks.
NETWORKS = [
    Network("security-team", ("security-alerts", "incident-response"), ("severity:high", "severity:critical"), "high"),
    Network("malware-team", ("malware-alerts", "security-alerts"), ("type:malware", "type:backdoor"), "high"),
    Network("legal-team", ("data-protection", "legal-alerts"), ("type:data_leak", "type:compliance"), "medium"),
    Network("analysis-results", ("analysis-results",), ("event:completed",), "normal"),
]


@dataclass(frozen=True)
class RoutingRule:
    name: str
    condition: str  # "severity", "type" or "any"
    values: tuple[str, ...]
    recipient_ids: tuple[str, ...]
    priority: str


# Default routing rules.
ROUTING_RULES = [
    RoutingRule("Critical Threats", "severity", ("critical",), ("security-lead", "incident-response"), "immediate"),
    RoutingRule("Malware Alerts", "type", ("malware",), ("malware-team", "security-ops"), "high"),
    RoutingRule("Data Protection", "type", ("data_leak",), ("data-protection-officer", "legal-team"), "high"),
]

# Alert handling per level: deadline minutes, contacts, escalation, network, priority.
ALERT_DEADLINE_MINUTES = {"emergency": 15, "critical": 60}
ALERT_CONTACTS = {
    "emergency": ["security-lead@example.com", "ciso@example.com", "incident-response@example.com"],
    "critical": ["security-team@example.com", "ops-team@example.com"],
}
ALERT_DEFAULT_CONTACTS = ["security-alerts@example.com"]
ALERT_ESCALATION = {
    "emergency": ["L1: Security Team", "L2: Security Lead", "L3: CISO", "L4: Executive Team"],
    "critical": ["L1: Security Team", "L2: Security Lead"],
}
ALERT_DEFAULT_ESCALATION = ["L1: Security Team"]
ALERT_NETWORK = {"emergency": "emergency-response", "critical": "incident-response"}


def _texts(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def findings_to_events(findings: DataFrame, jobs: DataFrame | None = None) -> DataFrame:
    """One event per finding; ``jobs`` (job_id, repository_url) is a static side on a stream."""
    kind = F.coalesce(lookup(KIND_BY_FINDING, F.col("finding_type")), F.lit("threat"))
    rows = findings if jobs is None else findings.join(jobs, "job_id", "left")
    url = F.col("repository_url") if jobs is not None else F.lit(None).cast("string")
    rows = finding_risk(rows).withColumn("event_kind", kind)

    def only(k: str, value: Column) -> Column:
        return F.when(F.col("event_kind") == k, value)

    return rows.select(
        F.sha2(F.concat_ws("|", F.lit("event"), "finding_id"), 256).alias("event_id"),
        "event_kind", F.col("detected_at").alias("ts"), "job_id", url.alias("repository_url"), "severity",
        "title", "path", "confidence",
        only("malware", F.col("finding_type")).alias("malware_type"),
        only("malware", F.lit("pending_quarantine")).alias("quarantine_status"),
        only("data_leak", F.lit("credentials")).alias("leak_type"),
        only("vulnerability", F.col("cve_id")).alias("cve_id"),
        only("vulnerability", F.col("confidence")).alias("exploitability_score"),
        only("threat", F.col("risk")).alias("risk_score"),
    )


def distribution(events: DataFrame) -> DataFrame:
    """Priority, networks, encryption and acknowledgement of an event."""
    s, k = F.col("severity"), F.col("event_kind")
    networks = (
        F.when(k == "malware", _texts(["malware-alerts", "security-team"]))
        .when(k == "data_leak", _texts(["data-protection", "legal-team"]))
        .when((k == "threat") & (s == "critical"), _texts(["emergency-response", "security-team"]))
        .otherwise(_texts(["security-alerts"])))
    return (
        events.withColumn("distribution_priority", F.coalesce(lookup(DISTRIBUTION_PRIORITY, s), F.lit("normal")))
        .withColumn("networks", networks)
        .withColumn("encryption_required", F.coalesce(s.isin("critical", "high"), F.lit(False)))
        .withColumn("acknowledgment_required", F.coalesce(s == "critical", F.lit(False)))
    )


def network_table(spark, networks: Sequence[Network] = tuple(NETWORKS)) -> DataFrame:
    rows = [(n.name, list(n.topics), list(n.filter_rules), n.priority) for n in networks]
    return spark.createDataFrame(rows, "network string, topics array<string>, filter_rules array<string>, network_priority string")


def fan_out(events: DataFrame, networks: DataFrame) -> DataFrame:
    """(event, network, topic) rows; networks that are not configured drop out (see ``unknown_networks``)."""
    wanted = events.withColumn("network", F.explode("networks"))
    return wanted.join(networks.select("network", "topics"), "network").withColumn(
        "topic", F.explode("topics")).drop("topics")


def unknown_networks(events: DataFrame, networks: DataFrame) -> DataFrame:
    """Networks that events ask for and nobody configured, with how many events; counted before the join."""
    wanted = events.select(F.explode("networks").alias("network")).groupBy("network").agg(F.count("*").alias("events"))
    return wanted.join(networks.select("network"), "network", "left_anti")


def network_filter(events: DataFrame, networks: Sequence[Network] = tuple(NETWORKS)) -> DataFrame:
    """(event, network) for each network with a matching ``attribute:value`` rule; one row-local pass."""
    tags = F.array_compact(F.array(
        F.concat(F.lit("severity:"), F.col("severity")), F.concat(F.lit("type:"), F.col("event_kind")),
        F.when(F.col("event_kind") == "analysis_completed", F.lit("event:completed"))))
    hits = F.array_compact(F.array(*[
        F.when(F.arrays_overlap(tags, _texts(n.filter_rules)), F.lit(n.name)) for n in networks]))
    return events.withColumn("network", F.explode(hits))


def _rule_matches(rule: RoutingRule) -> Column:
    if rule.condition == "any":
        return F.lit(True)
    column = {"severity": "severity", "type": "event_kind"}[rule.condition]
    return F.coalesce(F.col(column).isin(*rule.values), F.lit(False))


def route(events: DataFrame, recipients: DataFrame, rules: Sequence[RoutingRule] = tuple(ROUTING_RULES)) -> DataFrame:
    """(event, recipient) rows from the rules plus the event's own ``explicit_recipients``.

    Each event's ids are made distinct inside the row, so no shuffle is needed to deduplicate.
    recipients(recipient_id, preferences, contact_kind, contact); unregistered ids drop out.
    """
    none = F.array().cast("array<string>")
    ids = [F.when(_rule_matches(r), _texts(r.recipient_ids)).otherwise(none) for r in rules]
    if "explicit_recipients" in events.columns:
        ids.append(F.coalesce("explicit_recipients", none))
    wanted = events.withColumn("recipient_id", F.explode(F.array_distinct(F.concat(*ids))))
    if events.isStreaming:
        return wanted.join(recipients, "recipient_id")
    asked = wanted.groupBy("recipient_id").agg(F.count("*").alias("_n")).join(recipients, "recipient_id")
    return join_counted(wanted, asked, "recipient_id", "_n", salt=["event_id"]).drop("_n")


@dataclass(frozen=True)
class Filter:
    kind: str  # "severity" or "type"
    action: str  # "include" or "exclude"


def apply_filters(routed: DataFrame, filters: Sequence[Filter]) -> DataFrame:
    """Ordered include / exclude filters on recipient preferences; no severity never matches."""
    out = routed
    for f in filters:
        if f.kind == "severity":
            wanted = F.transform("preferences", F.lower)
            match = F.coalesce(F.array_contains(wanted, F.col("severity")), F.lit(False))
        elif f.kind == "type":
            match = F.array_contains("preferences", F.col("event_kind"))
        else:
            match = F.lit(True)
        if f.action == "include":
            out = out.where(match)
        elif f.action == "exclude":
            out = out.where(~match)
    return out


def rate_limit(
    routed: DataFrame, n: int = 100, seconds: int = 3600, key: str = "recipient_id", ident: str = "event_id",
    slice_seconds: int | None = None,
) -> DataFrame:
    """Add ``admitted``: at most n admitted events per key in any window; rejected ones do not count.

    Admission depends on earlier admissions, so rows are folded in order with the last n admitted
    times as state. Busy keys are cut where the state follows from the last rows alone: after a pause of a window, or where
    fewer than n events lie in two windows. A key under permanent overload has no such place and is one task's stream.
    """
    rows = calm_pieces(routed, [key], ["ts", ident], n, seconds, slice_seconds)

    def step(recent: deque, second: float):
        while recent and recent[0] <= second - seconds:
            recent.popleft()
        if len(recent) < n:
            recent.append(second)
            return recent, True
        return recent, False

    folded = fold_sorted(rows, [key, "_piece"], ["ts", ident], "admitted", T.BooleanType(), deque, step)
    return folded.where("NOT _warm").drop("_piece", "_warm")


def delivery_groups(routed: DataFrame) -> DataFrame:
    """Recipients per (event, method); a topic goes to the network named before its first dash."""
    contact = F.col("contact")
    method = (
        F.when(F.col("contact_kind") == "topic", F.concat(F.lit("network:"), F.split_part(contact, F.lit("-"), F.lit(1))))
        .when(F.col("contact_kind") == "email", F.concat(F.lit("email:"), contact))
        .when(F.col("contact_kind") == "sms", F.concat(F.lit("sms:"), contact)).otherwise(contact))
    return routed.withColumn("method", method).groupBy("event_id", "method").agg(
        F.array_sort(F.collect_set("recipient_id")).alias("recipients"))


def delivery_metrics(deliveries: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Total, successful and whole-millisecond mean time."""
    return deliveries.groupBy(*by).agg(
        F.count("*").alias("total"), F.count_if("success").alias("successful"),
        F.expr("sum(delivery_time_ms) div count(*)").alias("avg_time_ms"))


@dataclass(frozen=True)
class FieldRule:
    """One field of an event schema: a type name, or ``enum`` with values, or ``array`` of ``items``."""

    name: str
    type: str
    required: bool = True
    values: tuple[str, ...] = ()
    items: str = "any"


_COMMON = [FieldRule("event_id", "uuid"), FieldRule("timestamp", "datetime"), FieldRule("job_id", "uuid")]
# The registered event schemas.
EVENT_SCHEMAS = {
    "ThreatEvent": _COMMON + [
        FieldRule("repository_url", "string"), FieldRule("threat_type", "string"),
        FieldRule("severity", "enum", values=("Info", "Low", "Medium", "High", "Critical")),
        FieldRule("risk_score", "float"), FieldRule("confidence", "float")],
    "MalwareEvent": [
        FieldRule("malware_type", "string"), FieldRule("file_hash", "string"),
        FieldRule("signature_matches", "array", items="string"),
        FieldRule("quarantine_status", "enum", values=("Quarantined", "PendingQuarantine", "NotQuarantined", "Failed"))],
    "DataLeakEvent": [
        FieldRule("leak_type", "enum", values=(
            "Credentials", "PersonalData", "FinancialData", "HealthData", "IntellectualProperty", "Other")),
        FieldRule("exposed_data_types", "array", items="string"),
        FieldRule("exposure_scope", "enum", values=("Public", "Internal", "Limited", "Unknown")),
        FieldRule("remediation_required", "boolean")],
    "AlertEvent": [
        FieldRule("alert_level", "enum", values=("Emergency", "Critical", "Warning", "Info")),
        FieldRule("action_required", "string"), FieldRule("deadline", "datetime", required=False),
        FieldRule("escalation_path", "array", items="string")],
}
_UUID = r"\A(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12})\z"
_RFC3339 = r"\A\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:[Zz]|[+-]\d{2}:\d{2})\z"


def _type_label(f: FieldRule) -> str:
    if f.type == "enum":
        return f"enum({', '.join(f.values)})"
    return f"array<{f.items}>" if f.type == "array" else f.type


def _json_kind(kind: Column) -> Column:
    """JSON type name of a variant's SQL type."""
    return (
        F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array")
        .when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(kind == "VOID", "null")
        .otherwise("number"))


def _fits(f: FieldRule, value: Column, kind: Column) -> Column:
    text = F.try_variant_get(value, "$", "string")
    is_text = kind == "STRING"
    if f.type == "any":
        return F.lit(True)
    if f.type == "integer":
        return kind == "BIGINT"
    if f.type == "float":
        return (kind == "BIGINT") | kind.startswith("DECIMAL") | (kind == "DOUBLE")
    if f.type == "datetime":
        return is_text & text.rlike(_RFC3339) & F.try_to_timestamp(text).isNotNull()
    if f.type == "uuid":
        return is_text & text.rlike(_UUID)
    if f.type == "enum":
        return is_text & text.isin(*f.values)
    if f.type == "array":
        if f.items == "any":
            return kind.startswith("ARRAY")
        inner = {"string": ["ARRAY<STRING>"], "integer": ["ARRAY<BIGINT>"], "boolean": ["ARRAY<BOOLEAN>"]}[f.items]
        return kind.isin(*inner, "ARRAY<VOID>") & ~F.to_json(value).rlike(r"[\[,]null[,\]]")
    return {"string": is_text, "boolean": kind == "BOOLEAN", "object": kind.startswith("OBJECT")}[f.type]


def validate_schema(events: DataFrame, fields: Sequence[FieldRule], payload: str = "payload") -> DataFrame:
    """Add ``errors``: missing required fields and type mismatches of a JSON payload, in field order."""
    doc = F.try_parse_json(payload)
    present = F.coalesce(F.json_object_keys(payload), F.array().cast("array<string>"))
    errors = []
    for f in fields:
        value = F.try_variant_get(F.col("_doc"), f"$['{f.name}']", "variant")
        kind = F.schema_of_variant(value)
        wrong = F.concat(
            F.lit(f"Invalid type for field '{f.name}': expected {_type_label(f)}, got "), _json_kind(kind))
        missing = F.when(F.lit(f.required), F.lit(f"Missing required field: {f.name}"))
        errors.append(F.when(~F.array_contains(F.col("_keys"), f.name), missing).when(
            ~F.coalesce(_fits(f, value, kind), F.lit(False)), wrong))
    is_object = F.coalesce(F.schema_of_variant(F.col("_doc")).startswith("OBJECT"), F.lit(False))
    return (
        events.withColumn("_doc", doc).withColumn("_keys", present)
        .withColumn("errors", F.when(is_object, F.array_compact(F.array(*errors))).otherwise(
            _texts(["Event data must be an object"])))
        .withColumn("valid", F.size("errors") == 0).drop("_doc", "_keys")
    )


def critical_mass(findings: DataFrame, n: int = 3) -> DataFrame:
    """Jobs with at least n critical findings, as alerts."""
    return findings.where(F.col("severity") == "critical").groupBy("job_id").agg(
        F.count("*").alias("critical_findings"), F.max("detected_at").alias("ts")
    ).where(F.col("critical_findings") >= n).withColumn("alert_level", F.lit("critical")).withColumn(
        "title", F.lit("Multiple critical security issues detected"))


def enrich_alerts(alerts: DataFrame) -> DataFrame:
    level = F.col("alert_level")
    urgent = F.coalesce(level.isin("emergency", "critical"), F.lit(False))

    def table(mapping: dict, default: list[str]) -> Column:
        out = _texts(default)
        for k, v in mapping.items():
            out = F.when(level == k, _texts(v)).otherwise(out)
        return out

    minutes = lookup(ALERT_DEADLINE_MINUTES, level)
    return (
        alerts.withColumn("deadline", F.col("ts") + F.make_dt_interval(mins=minutes))
        .withColumn("contacts", table(ALERT_CONTACTS, ALERT_DEFAULT_CONTACTS))
        .withColumn("escalation_path", table(ALERT_ESCALATION, ALERT_DEFAULT_ESCALATION))
        .withColumn("network", F.coalesce(lookup(ALERT_NETWORK, level), F.lit("security-alerts")))
        .withColumn("priority", F.when(urgent, "immediate").otherwise("high"))
        .withColumn("encryption_required", F.lit(True)).withColumn("acknowledgment_required", urgent)
    )


def fan_out_subscriptions(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """(event, subscriber) for subscriptions(subscriber, event_type) to the exact type or ``*``.

    A wildcard makes a subscriber's other subscriptions redundant. Exact types are an equi-join, wildcards
    a join of their own in which all events have one key; both are cut into grids where types and their
    subscribers are many on both sides.
    """
    wild = subscriptions.where(F.col("event_type") == "*").select("subscriber").distinct()
    exact = subscriptions.where(F.col("event_type") != "*").select("subscriber", "event_type").distinct().join(wild, "subscriber", "left_anti")
    typed = grid_join(events.withColumn("_key", F.col("event_type")), exact.withColumnRenamed("event_type", "_key"), "_key")
    everything = grid_join(events.withColumn("_key", F.lit("*")), wild.withColumn("_key", F.lit("*")), "_key")
    return typed.unionByName(everything).drop("_key")


def subscription_counts(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Deliveries per subscriber and type: events are counted by type before they meet the subscriptions."""
    per_type = events.groupBy("event_type").agg(F.count("*").alias("deliveries"))
    return fan_out_subscriptions(per_type, subscriptions)


def completion_events(jobs: DataFrame, findings: DataFrame) -> DataFrame:
    """One event per finished job of jobs(job_id, repository_url, started_at, completed_at): duration, findings, score."""
    done = jobs.where(F.col("completed_at").isNotNull())
    risk = job_risk(done.select("job_id"), findings)
    return done.join(risk, "job_id").select(
        F.sha2(F.concat_ws("|", F.lit("completed"), "job_id"), 256).alias("event_id"), F.lit("analysis_completed").alias("event_kind"),
        F.col("completed_at").alias("ts"), "job_id", "repository_url", F.lit(None).cast("string").alias("severity"),
        F.timestamp_diff("MILLISECOND", F.col("started_at"), F.col("completed_at")).alias("duration_ms"), "total_findings", "risk_score")


def alert_events(alerts: DataFrame) -> DataFrame:
    """Alerts(event_id, ts, alert_level) with deadlines and contacts as events of their own kind."""
    return enrich_alerts(alerts).withColumn("event_kind", F.lit("security_alert")).withColumn(
        "severity", F.when(F.col("alert_level").isin("emergency", "critical"), "critical").when(F.col("alert_level") == "warning", "medium").otherwise("info"))


def dead_letter(events: DataFrame) -> DataFrame:
    """Failed events with their error class and whether they return to the input.

    A failed check is a validation error; ``error_name`` (when present) carries processing failures.
    """
    check = event_error(events)
    name = F.when(check.isNotNull(), F.lit("ValidationError"))
    if "error_name" in events.columns:
        name = F.coalesce(name, F.col("error_name"))
    rows = events.withColumn("message", F.coalesce(check, name)).withColumn("error_name", name)
    return classify_errors(rows.where(F.col("error_name").isNotNull()))
