"""Registered queries: intelligence events and their distribution."""

from pyspark.sql import functions as F

from tracewright.operators import events as K
from tracewright.operators import metrics as M
from tracewright.plans import bindings as B
from tracewright.plans.evidence import ERRORS, SQL_EVENT_ERROR
from tracewright.plans.policy import points
from tracewright.plans.registry import ORACLE, query
from tracewright.plans.scan import SQL_WEIGHT
from tracewright.plans.streaming import StreamTables, closing_row, latest_rows, run_parts
from tracewright.streaming.carry import read_alert_updates, write_alert_updates
from tracewright.streaming.jobs import route_failures, write_with_retries
from tracewright.streaming.topics import new_run_folder, read_routed, read_table

q = B.sql_str
FIND = B.SQL_FINDINGS


def _backdoor(findings):
    return findings.withColumn("finding_type", F.when(F.col("severity") == "info", "compliance_violation").otherwise(F.col("finding_type")))


def events(t):
    jobs = t.customer.select(F.concat(F.lit("job"), F.col("c_custkey").cast("string")).alias("job_id"), F.concat(F.lit("repo/"), "c_name").alias("repository_url"))
    return K.findings_to_events(_backdoor(B.findings(t)), jobs)


EV = f"""
SELECT sha256('event|' || finding_id) AS event_id, CASE finding_type WHEN 'malware' THEN 'malware' WHEN 'data_leak' THEN 'data_leak' WHEN 'secret_exposure' THEN 'data_leak'
  WHEN 'vulnerability' THEN 'vulnerability' WHEN 'anomaly' THEN 'anomaly' ELSE 'threat' END AS event_kind, detected_at AS ts, job_id, severity, finding_type, cve_id, confidence
FROM (SELECT * REPLACE (CASE WHEN severity = 'info' THEN 'compliance_violation' ELSE finding_type END AS finding_type) FROM ({FIND}))"""


@query("k1_findings_to_events", f"""
SELECT event_id, event_kind, severity, 'repo/' || c_name AS repository_url, CASE WHEN event_kind = 'malware' THEN finding_type END AS malware_type,
  CASE WHEN event_kind = 'data_leak' THEN 'credentials' END AS leak_type, CASE WHEN event_kind = 'vulnerability' THEN cve_id END AS cve_id,
  CASE WHEN event_kind = 'threat' THEN round(confidence, 9) END AS risk_score
FROM ({EV}) LEFT JOIN customer ON 'job' || c_custkey = job_id""")
def k1(t):
    return events(t).select("event_id", "event_kind", "severity", "repository_url", "malware_type", "leak_type", "cve_id",
                            F.round("risk_score", 9).alias("risk_score"))


@query("k2_publishable", f"SELECT finding_id, severity FROM ({FIND}) WHERE severity IN ('high', 'critical')")
def k2(t):
    return K.publishable(B.findings(t)).select("finding_id", "severity")


NETS = """CASE WHEN event_kind = 'malware' THEN ['malware-alerts', 'security-team'] WHEN event_kind = 'data_leak' THEN ['data-protection', 'legal-team']
  WHEN event_kind = 'threat' AND severity = 'critical' THEN ['emergency-response', 'security-team'] ELSE ['security-alerts'] END"""


@query("k3_distribution", f"""
SELECT event_id, CASE severity WHEN 'critical' THEN 'immediate' WHEN 'high' THEN 'high' ELSE 'normal' END AS distribution_priority, array_to_string({NETS}, ',') AS networks,
  severity IN ('critical', 'high') AS encryption_required, severity = 'critical' AS acknowledgment_required FROM ({EV})""")
def k3(t):
    return K.distribution(events(t)).select(
        "event_id", "distribution_priority", F.array_join("networks", ",").alias("networks"), "encryption_required", "acknowledgment_required")


SQL_TOPICS = " UNION ALL ".join(f"SELECT {q(n.name)} AS network, unnest({B.sql_list(n.topics)}) AS topic" for n in K.NETWORKS)


@query("k4_fan_out", f"SELECT event_id, network, topic FROM (SELECT event_id, unnest({NETS}) AS network FROM ({EV})) JOIN ({SQL_TOPICS}) USING (network)")
def k4(t):
    return K.fan_out(K.distribution(events(t)), K.network_table(t.spark)).select("event_id", "network", "topic")


@query("k4_unknown_networks", f"SELECT network, count(*) AS events FROM (SELECT unnest({NETS}) AS network FROM ({EV})) WHERE network NOT IN {B.sql_in([n.name for n in K.NETWORKS])} GROUP BY network")
def k4u(t):
    return K.unknown_networks(K.distribution(events(t)), K.network_table(t.spark))


@query("k5_network_filter", f"""
SELECT event_id, 'security-team' AS network FROM ({EV}) WHERE severity IN ('high', 'critical') UNION ALL SELECT event_id, 'malware-team' FROM ({EV}) WHERE event_kind = 'malware'
UNION ALL SELECT event_id, 'legal-team' FROM ({EV}) WHERE event_kind = 'data_leak'""")
def k5(t):
    return K.network_filter(events(t)).select("event_id", "network")


def recipients(t):
    """Registered recipients: the teams of the rules (but one) and one per supplier nation."""
    teams = [("security-lead", ["critical", "threat"], "email", "lead@example.com"), ("incident-response", ["Critical"], "topic", "incident-response"),
             ("malware-team", ["malware"], "topic", "malware-alerts"), ("security-ops", ["high", "malware"], "webhook", "https://ops.example.com/hook"),
             ("legal-team", ["data_leak", "critical"], "sms", "555")]
    fixed = t.spark.createDataFrame(teams, "recipient_id string, preferences array<string>, contact_kind string, contact string")
    more = t.supplier.select(
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("recipient_id"),
        F.array(F.lit("medium"), F.lit("anomaly")).alias("preferences"), F.lit("topic").alias("contact_kind"),
        F.concat(F.lit("nation"), F.col("s_nationkey").cast("string"), F.lit("-supply")).alias("contact"))
    return fixed.unionByName(more)


SQL_RECIPIENTS = """
SELECT * FROM (VALUES ('security-lead', ['critical', 'threat'], 'email', 'lead@example.com'), ('incident-response', ['Critical'], 'topic', 'incident-response'),
  ('malware-team', ['malware'], 'topic', 'malware-alerts'), ('security-ops', ['high', 'malware'], 'webhook', 'https://ops.example.com/hook'),
  ('legal-team', ['data_leak', 'critical'], 'sms', '555')) r(recipient_id, preferences, contact_kind, contact)
UNION ALL SELECT 's' || s_suppkey, ['medium', 'anomaly'], 'topic', 'nation' || s_nationkey || '-supply' FROM supplier"""


def routed(t):
    e = events(t).withColumn("explicit_recipients", F.when(
        F.col("event_kind") == "anomaly", F.array(F.concat(F.lit("s"), (F.substring("job_id", 4, 20).cast("int") % 40).cast("string")), F.lit("security-lead"))))
    return K.route(e, recipients(t))


SQL_ROUTED = f"""
SELECT DISTINCT e.event_id, e.ts, e.severity, e.event_kind, r.* FROM (
  SELECT event_id, ts, severity, event_kind, unnest(list_concat(list_concat(CASE WHEN severity = 'critical' THEN ['security-lead', 'incident-response'] ELSE CAST([] AS VARCHAR[]) END,
    CASE WHEN event_kind = 'malware' THEN ['malware-team', 'security-ops'] WHEN event_kind = 'data_leak' THEN ['data-protection-officer', 'legal-team'] ELSE CAST([] AS VARCHAR[]) END),
    CASE WHEN event_kind = 'anomaly' THEN ['s' || (CAST(substr(job_id, 4) AS INT) % 40), 'security-lead'] ELSE CAST([] AS VARCHAR[]) END)) AS rid FROM ({EV})) e
JOIN ({SQL_RECIPIENTS}) r ON r.recipient_id = e.rid"""


@query("k6_route", f"SELECT event_id, recipient_id, contact_kind FROM ({SQL_ROUTED})")
def k6(t):
    return routed(t).select("event_id", "recipient_id", "contact_kind")


@query("k7_apply_filters", f"""
SELECT event_id, recipient_id FROM ({SQL_ROUTED}) WHERE list_contains([lower(p) for p in preferences], severity) AND NOT list_contains(preferences, event_kind)""")
def k7(t):
    return K.apply_filters(routed(t), [K.Filter("severity", "include"), K.Filter("type", "exclude")]).select("event_id", "recipient_id")


@query("k8_rate_limit", """
WITH RECURSIVE r AS MATERIALIZED (SELECT user_id % 20 AS k, event_id, ts, row_number() OVER (PARTITION BY user_id % 20 ORDER BY ts, event_id) AS rn FROM events),
c AS (SELECT k, rn, event_id, [ts] AS recent, true AS admitted FROM r WHERE rn = 1
  UNION ALL SELECT k, rn, event_id, CASE WHEN len(live) < 5 THEN list_append(live, ts) ELSE live END, len(live) < 5 FROM (
    SELECT r.k, r.rn, r.event_id, r.ts, list_filter(c.recent, lambda x: x > r.ts - INTERVAL 21600 SECOND) AS live FROM c JOIN r ON r.k = c.k AND r.rn = c.rn + 1))
SELECT event_id, k AS recipient_id, admitted FROM c""")
def k8(t):
    rows = t.events.select("event_id", (F.col("user_id") % 20).alias("recipient_id"), F.col("ts").cast("timestamp").alias("ts"))
    return K.rate_limit(rows, 5, 21_600).select("event_id", "recipient_id", "admitted")


@query("k9_delivery_groups", f"""
SELECT event_id, method, string_agg(recipient_id, ',' ORDER BY recipient_id) AS recipients FROM (SELECT event_id, recipient_id,
  CASE contact_kind WHEN 'topic' THEN 'network:' || split_part(contact, '-', 1) WHEN 'email' THEN 'email:' || contact WHEN 'sms' THEN 'sms:' || contact ELSE contact END AS method FROM ({SQL_ROUTED})) GROUP BY event_id, method""")
def k9(t):
    return K.delivery_groups(routed(t)).withColumn("recipients", F.array_join("recipients", ","))


@query("k10_delivery_metrics", """
SELECT event_type, count(*) AS total, count(*) FILTER (value > 10) AS successful, CAST(sum(CAST(floor(value) AS BIGINT)) // count(*) AS BIGINT) AS avg_time_ms FROM events GROUP BY event_type""")
def k10(t):
    return K.delivery_metrics(t.events.select("event_type", (F.col("value") > 10).alias("success"), F.floor("value").alias("delivery_time_ms")), ["event_type"])


def payloads(t):
    """Threat payloads with gaps: bad enum, text score, missing job, no object at all."""
    v, e = F.floor("value"), F.col("event_id")
    uid = F.concat(F.lpad(F.hex(e), 8, "0"), F.lit("-0000-0000-0000-000000000000"))
    score = F.when(v % 7 == 0, F.lit('"high"')).otherwise(F.round("value", 2).cast("string"))
    job = F.when(v % 5 == 0, F.lit("")).otherwise(F.concat(F.lit('"job_id": "'), uid, F.lit('", ')))
    body = F.concat(
        F.lit('{"event_id": "'), F.when(v % 11 == 0, F.lit("nope")).otherwise(uid), F.lit('", "timestamp": "'),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit('", '), job, F.lit('"repository_url": "r", "threat_type": '),
        F.when(v % 13 == 0, F.lit("null")).otherwise(F.lit('"x"')), F.lit(', "severity": "'),
        F.when(v > 50, "High").when(v > 20, "Low").otherwise("Bogus"), F.lit('", "risk_score": '), score, F.lit(', "confidence": 1}'))
    return t.events.select("event_id", F.when(v == 2, F.lit("[1, 2]")).otherwise(body).alias("payload"))


@query("k11_validate_schema", """
SELECT event_id, CASE WHEN v = 2 THEN 'Event data must be an object' ELSE array_to_string(list_filter([
  CASE WHEN v % 11 = 0 THEN 'Invalid type for field ''event_id'': expected uuid, got string' END,
  CASE WHEN v % 5 = 0 THEN 'Missing required field: job_id' END,
  CASE WHEN v % 13 = 0 THEN 'Invalid type for field ''threat_type'': expected string, got null' END,
  CASE WHEN v <= 20 THEN 'Invalid type for field ''severity'': expected enum(Info, Low, Medium, High, Critical), got string' END,
  CASE WHEN v % 7 = 0 THEN 'Invalid type for field ''risk_score'': expected float, got string' END], lambda x: x IS NOT NULL), '; ') END AS errors
FROM (SELECT event_id, CAST(floor(value) AS BIGINT) AS v FROM events)""")
def k11(t):
    return K.validate_schema(payloads(t), K.EVENT_SCHEMAS["ThreatEvent"]).select("event_id", F.array_join("errors", "; ").alias("errors"))


@query("k12_critical_mass", f"SELECT job_id, count(*) AS critical_findings FROM ({FIND}) WHERE severity = 'critical' GROUP BY job_id HAVING count(*) >= 8")
def k12(t):
    return K.critical_mass(B.findings(t), 8).select("job_id", "critical_findings")


@query("k13_enrich_alerts", """
SELECT event_id, strftime(CASE lvl WHEN 'emergency' THEN ts + INTERVAL 15 MINUTE WHEN 'critical' THEN ts + INTERVAL 60 MINUTE END, '%Y-%m-%d %H:%M:%S') AS deadline,
  CASE lvl WHEN 'emergency' THEN 3 WHEN 'critical' THEN 2 ELSE 1 END AS contacts, CASE lvl WHEN 'emergency' THEN 'L4: Executive Team' WHEN 'critical' THEN 'L2: Security Lead' ELSE 'L1: Security Team' END AS last_step,
  CASE lvl WHEN 'emergency' THEN 'emergency-response' WHEN 'critical' THEN 'incident-response' ELSE 'security-alerts' END AS network, CASE WHEN lvl IN ('emergency', 'critical') THEN 'immediate' ELSE 'high' END AS priority
FROM (SELECT event_id, ts, CASE WHEN value >= 95 THEN 'emergency' WHEN value >= 60 THEN 'critical' WHEN value >= 20 THEN 'warning' ELSE 'info' END AS lvl FROM events)""")
def k13(t):
    v = F.col("value")
    alerts = t.events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.when(v >= 95, "emergency").when(v >= 60, "critical").when(v >= 20, "warning").otherwise("info").alias("alert_level"))
    return K.enrich_alerts(alerts).select(
        "event_id", F.date_format("deadline", "yyyy-MM-dd HH:mm:ss").alias("deadline"), F.size("contacts").alias("contacts"),
        F.element_at("escalation_path", -1).alias("last_step"), "network", "priority")


SUBS = "SELECT 's' || s_suppkey AS subscriber, CASE s_nationkey % 5 WHEN 0 THEN '*' WHEN 1 THEN 'click' WHEN 2 THEN 'view' WHEN 3 THEN 'error' ELSE 'refund' END AS event_type FROM supplier"


@query("k14_fan_out_subscriptions", f"SELECT subscriber, e.event_type, count(*) AS deliveries FROM events e JOIN ({SUBS}) s ON s.event_type = e.event_type OR s.event_type = '*' GROUP BY ALL")
def k14(t):
    k = F.col("s_nationkey") % 5
    subs = t.supplier.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("subscriber"),
                             F.when(k == 0, "*").when(k == 1, "click").when(k == 2, "view").when(k == 3, "error").otherwise("refund").alias("event_type"))
    return K.subscription_counts(t.events, subs).select("subscriber", "event_type", "deliveries")


@query("k1_completion_events", f"""
SELECT sha256('completed|job' || c_custkey) AS event_id, CAST(60000 * c_nationkey AS BIGINT) AS duration_ms, coalesce(n, 0) AS total_findings, round(coalesce(score, 0), 9) AS risk_score
FROM customer LEFT JOIN (SELECT job_id, count(*) AS n, least(10, avg({SQL_WEIGHT} * confidence)) AS score FROM ({FIND}) GROUP BY job_id) ON job_id = 'job' || c_custkey WHERE c_nationkey <> 3""")
def k1c(t):
    return K.completion_events(finished(t), B.findings(t)).select("event_id", "duration_ms", "total_findings", F.round("risk_score", 9).alias("risk_score"))


def finished(t):
    """A job per customer that took as many minutes as its nation's key; those of nation 3 still run."""
    start = F.lit("2024-01-01").cast("timestamp")
    end = F.when(F.col("c_nationkey") != 3, start + F.make_dt_interval(mins=F.col("c_nationkey").cast("int")))
    return t.customer.select(F.concat(F.lit("job"), F.col("c_custkey").cast("string")).alias("job_id"), F.concat(F.lit("repo/"), "c_name").alias("repository_url"),
                             start.alias("started_at"), end.alias("completed_at"))


@query("k5_completed_filter", "SELECT sha256('completed|job' || c_custkey) AS event_id, 'analysis-results' AS network FROM customer WHERE c_nationkey <> 3")
def k5c(t):
    """Finished jobs reach the networks that ask for them."""
    return K.network_filter(K.completion_events(finished(t), B.findings(t))).select("event_id", "network")


@query("k13_alert_events", """
SELECT event_id, 'security_alert' AS event_kind, CASE WHEN value >= 60 THEN 'critical' WHEN value >= 20 THEN 'medium' ELSE 'info' END AS severity FROM events""")
def k13e(t):
    v = F.col("value")
    alerts = t.events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.when(v >= 95, "emergency").when(v >= 60, "critical").when(v >= 20, "warning").otherwise("info").alias("alert_level"))
    return K.alert_events(alerts).select("event_id", "event_kind", "severity")


def _failing(t):
    p = B.pipeline_events(t)
    name = F.when(F.col("priority") == "critical", F.lit("TransportError")).when(F.col("priority") == "high", F.lit("VaultError"))
    return p.withColumn("error_name", name)


@query("k15_dead_letter", f"""
SELECT seq, CASE WHEN bad IS NULL THEN 'retry' ELSE 'errors' END AS queue, message, CASE WHEN bad IS NOT NULL THEN 'validation' WHEN priority = 'critical' THEN 'network' ELSE 'signing' END AS error_type, bad IS NULL AS retryable
FROM (SELECT seq, priority, {SQL_EVENT_ERROR} AS bad, coalesce({SQL_EVENT_ERROR}, CASE priority WHEN 'critical' THEN 'TransportError' WHEN 'high' THEN 'VaultError' END) AS message FROM ({B.SQL_PIPELINE})) WHERE message IS NOT NULL""")
def k15(t):
    """The retry and the error table of a stream."""
    folder = new_run_folder(t.spark, "failures")
    route_failures(_failing(StreamTables(t.spark, t.folder)), folder, f"{folder}/checkpoint").awaitTermination()
    tables = [read_routed(t.spark, folder, "queue", name) for name in ("retry", "errors")]
    return tables[0].unionByName(tables[1]).select("seq", "queue", "message", "error_type", "retryable")


NEEDED = "CASE priority WHEN 'critical' THEN 1 WHEN 'high' THEN seq % 4 ELSE 0 END"


@query("k15_retries", f"""
SELECT seq, CASE WHEN bad IS NOT NULL THEN 0 ELSE least({NEEDED}, 2) END AS attempt, CASE WHEN bad IS NULL AND {NEEDED} < 3 THEN 'done' ELSE 'errors' END AS queue,
  CASE WHEN bad IS NOT NULL THEN 'validation' WHEN {NEEDED} >= 3 THEN 'signing' END AS error_type
FROM (SELECT seq, priority, {SQL_EVENT_ERROR} AS bad FROM ({B.SQL_PIPELINE}))""")
def k15r(t):
    """Last attempt of every event: critical ones succeed on their second pass, high ones need up to four of the three allowed."""
    needed = F.when(F.col("priority") == "critical", 1).when(F.col("priority") == "high", F.col("seq") % 4).otherwise(0)
    name = F.when(F.col("priority") == "critical", F.lit("TransportError")).otherwise("VaultError")
    folder = new_run_folder(t.spark, "retries")
    for _ in range(3):
        write_with_retries(
            B.pipeline_events(StreamTables(t.spark, t.folder)), lambda rows: rows.withColumn("error_name", F.when(F.col("attempt") < needed, name)),
            folder, f"{folder}/checkpoint", 3, "2100-01-01").awaitTermination()
    last = read_table(t.spark, folder, "attempts").where("queue <> 'retry'")
    return last.select("seq", F.col("attempt").cast("long").alias("attempt"), "queue", "error_type")


@query("k18_sustained_alerts", """
SELECT name, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started_at, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS ended_at, count(*) AS points, max(value) AS peak FROM (
  SELECT *, row_number() OVER (PARTITION BY name ORDER BY ts, id) - row_number() OVER (PARTITION BY name, hot ORDER BY ts, id) AS island
  FROM (SELECT event_type AS name, event_id AS id, ts, value, value > 25 AS hot FROM events)) WHERE hot GROUP BY name, island HAVING date_sub('second', min(ts), max(ts)) >= 1800""")
def k18(t):
    return M.sustained_alerts(points(t).drop("tags"), 25, 1800).select(
        "name", F.date_format("started_at", "yyyy-MM-dd HH:mm:ss").alias("started_at"),
        F.date_format("ended_at", "yyyy-MM-dd HH:mm:ss").alias("ended_at"), "points", "peak")


@query("k18_stream_alert_updates", ORACLE["k18_sustained_alerts"])
def k18u(t):
    """The rows of k18_sustained_alerts from a stream: also runs that still last at the end of the input."""
    def start(tables, folder, checkpoint):
        return write_alert_updates(points(tables).drop("tags"), folder, checkpoint, 25, 1800)

    rows = read_alert_updates(t.spark, run_parts(t, "alert_updates", start, closing_row))
    return latest_rows(rows, ["name", "started_at", "first_id"]).select(
        "name", F.date_format("started_at", "yyyy-MM-dd HH:mm:ss").alias("started_at"),
        F.date_format("ended_at", "yyyy-MM-dd HH:mm:ss").alias("ended_at"), "points", "peak")
