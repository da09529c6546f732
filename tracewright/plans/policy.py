"""Registered queries: policy decisions, access control and metrics."""

from pyspark.sql import functions as F

from tracewright.operators import access as A
from tracewright.operators import metrics as M
from tracewright.operators import policy as P
from tracewright.plans import bindings as B
from tracewright.plans.registry import query

q = B.sql_str
ENV = {"O": "development", "F": "staging", "P": "production"}
CLASS = {"AUTOMOBILE": "public", "BUILDING": "internal", "FURNITURE": "sensitive", "HOUSEHOLD": "internal", "MACHINERY": "unlabelled"}
FACTORS = {
    "1-URGENT": ["external_dependencies", "financial_data", "phi_access", "new_model"], "2-HIGH": ["financial_data"],
    "3-MEDIUM": ["phi_access", "new_model"], "4-NOT SPECIFIED": [], "5-LOW": ["external_dependencies"],
}
ROLES = {"AUTOMOBILE": ["user"], "BUILDING": ["user", "operator"], "FURNITURE": ["admin"], "HOUSEHOLD": ["service"], "MACHINERY": []}
ACTIONS = {"1-URGENT": "create", "2-HIGH": "read", "3-MEDIUM": "evaluate", "4-NOT SPECIFIED": "delete", "5-LOW": "read"}
RESOURCES = {"O": "policy", "F": "plugin", "P": "user"}


def _arrays(mapping, col):
    out = F.array().cast("array<string>")
    for k, v in mapping.items():
        out = F.when(F.col(col) == k, F.array(*[F.lit(x) for x in v]).cast("array<string>")).otherwise(out)
    return out


def _sql_arrays(mapping, col):
    return "CASE " + " ".join(f"WHEN {col} = {q(k)} THEN CAST({B.sql_list(v)} AS VARCHAR[])" for k, v in mapping.items()) + " END"


def requests(t):
    """policy_requests: one per order of its customer."""
    seg = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_acctbal", "c_nationkey")
    return t.orders.join(seg, "o_custkey").select(
        F.col("o_orderkey").alias("request_id"), F.concat(F.lit("user"), F.col("o_custkey").cast("string")).alias("user_id"),
        F.when(F.col("o_totalprice") < 20000, "").otherwise("deploy").alias("policy_id"),
        F.when(F.col("c_acctbal") >= -500, F.col("o_totalprice")).alias("input"),
        F.when(F.col("c_nationkey") != 3, F.col("c_nationkey")).alias("context"),
        B._pick(ENV, "o_orderstatus").alias("environment"), B._pick(CLASS, "c_mktsegment").alias("data_classification"),
        _arrays(FACTORS, "o_orderpriority").alias("risk_factors"), _arrays(ROLES, "c_mktsegment").alias("roles"),
        F.when(F.col("o_totalprice") > 250000, F.array(F.lit("SOX"), F.lit("HIPAA"))).otherwise(F.array().cast("array<string>")).alias("compliance"),
        B._pick(ACTIONS, "o_orderpriority").alias("action"), B._pick(RESOURCES, "o_orderstatus").alias("resource"),
        F.concat(F.lit("user"), (F.col("o_orderkey") % 1500).cast("string")).alias("owner"),
        (F.col("c_acctbal") < 0).alias("disabled"), (F.col("o_totalprice") > 300000).alias("high_value"),
        F.col("o_orderdate").cast("timestamp").alias("ts"), F.col("o_totalprice").alias("amount"))


REQ = f"""
SELECT o_orderkey AS request_id, 'user' || o_custkey AS user_id, CASE WHEN o_totalprice < 20000 THEN '' ELSE 'deploy' END AS policy_id,
  CASE WHEN c_acctbal >= -500 THEN o_totalprice END AS input, CASE WHEN c_nationkey <> 3 THEN c_nationkey END AS context,
  {B.sql_case(ENV, 'o_orderstatus')} AS environment, {B.sql_case(CLASS, 'c_mktsegment')} AS data_classification,
  {_sql_arrays(FACTORS, 'o_orderpriority')} AS risk_factors, {_sql_arrays(ROLES, 'c_mktsegment')} AS roles,
  CASE WHEN o_totalprice > 250000 THEN ['SOX', 'HIPAA'] ELSE CAST([] AS VARCHAR[]) END AS compliance,
  {B.sql_case(ACTIONS, 'o_orderpriority')} AS action, {B.sql_case(RESOURCES, 'o_orderstatus')} AS resource, 'user' || (o_orderkey % 1500) AS owner,
  c_acctbal < 0 AS disabled, o_totalprice > 300000 AS high_value, o_orderdate AS ts, o_totalprice AS amount
FROM orders JOIN customer ON c_custkey = o_custkey"""
SQL_ERROR = "CASE WHEN policy_id = '' THEN 'policy ID is required' WHEN input IS NULL THEN 'input is required' WHEN context IS NULL THEN 'context is required' END"


@query("j1_validate_requests", f"SELECT request_id, {SQL_ERROR} AS error FROM ({REQ})")
def j1(t):
    return P.validate_requests(requests(t)).select("request_id", "error")


@query("j2_decide", f"SELECT request_id, CASE WHEN input > 100000 THEN 'allow' ELSE 'deny' END AS result FROM ({REQ})")
def j2(t):
    return P.decide(requests(t), F.col("input") > 100000).select("request_id", "result")


APPROVAL = "(environment = 'production' OR data_classification = 'sensitive' OR list_contains(risk_factors, 'external_dependencies'))"
SCORE = """CASE environment WHEN 'development' THEN 1 WHEN 'staging' THEN 3 WHEN 'production' THEN 5 END
  + CASE data_classification WHEN 'public' THEN 1 WHEN 'internal' THEN 3 WHEN 'sensitive' THEN 5 END + len(risk_factors)"""


@query("j3_deployment_allow", f"SELECT request_id, environment = 'development' AND data_classification IN ('public', 'internal') AS allow FROM ({REQ})")
def j3(t):
    return P.deployment_policy(requests(t)).select("request_id", "allow")


@query("j4_require_approval", f"SELECT request_id, {APPROVAL} AS require_approval FROM ({REQ})")
def j4(t):
    return P.deployment_policy(requests(t)).select("request_id", "require_approval")


@query("j5_required_approvers", f"""
SELECT request_id, array_to_string(list_filter([CASE WHEN environment = 'production' THEN 'security_officer' END, CASE WHEN data_classification = 'sensitive' THEN 'compliance_manager' END,
  CASE WHEN len(risk_factors) > 3 THEN 'cto' END], lambda x: x IS NOT NULL), ',') AS approvers FROM ({REQ})""")
def j5(t):
    return P.deployment_policy(requests(t)).select("request_id", F.array_join("required_approvers", ",").alias("approvers"))


@query("j6_risk_score", f"SELECT request_id, CAST({SCORE} AS INT) AS risk_score FROM ({REQ})")
def j6(t):
    return P.deployment_policy(requests(t)).select("request_id", "risk_score")


@query("j7_framework_predicates", f"""
SELECT request_id, list_contains(compliance, 'SOX') AND environment = 'production' AND list_contains(risk_factors, 'financial_data') AS sox_compliant,
  list_contains(compliance, 'HIPAA') AND data_classification = 'sensitive' AND list_contains(risk_factors, 'phi_access') AS hipaa_compliant,
  CASE WHEN {APPROVAL} THEN 'Approval required: ' || environment || ' environment with ' || data_classification || ' data classification'
    WHEN environment = 'development' AND data_classification IN ('public', 'internal') THEN 'Deployment allowed: Low risk development environment' END AS explanation FROM ({REQ})""")
def j7(t):
    return P.deployment_policy(requests(t)).select("request_id", "sox_compliant", "hipaa_compliant", "explanation")


@query("j8_basic_access", f"""
SELECT request_id, CASE WHEN list_contains(roles, 'admin') OR (action = 'read' AND owner = user_id) OR (action = 'create' AND list_contains(roles, 'user')) THEN 'allow' ELSE 'deny' END AS result FROM ({REQ})""")
def j8(t):
    return P.basic_access(requests(t)).select("request_id", "result")


RULES = [
    P.Condition("p1", "environment", "equals", ("production",)), P.Condition("p1", "risk_factors", "contains", ("financial_data",)),
    P.Condition("p2", "data_classification", "in", ("sensitive", "internal")), P.Condition("p2", "amount", "greater_than", ("200000",)),
    P.Condition("p3", "roles", "not_in", ("admin", "service")), P.Condition("p3", "action", "not_equals", ("read",)),
]


@query("j9_evaluate_rules", f"""
WITH r AS ({REQ}) SELECT request_id, 'p1' AS policy, environment = 'production' AND list_contains(risk_factors, 'financial_data') AS satisfied FROM r
UNION ALL SELECT request_id, 'p2', data_classification IN ('sensitive', 'internal') AND amount > 200000 FROM r
UNION ALL SELECT request_id, 'p3', NOT list_has_any(roles, ['admin', 'service']) AND action <> 'read' FROM r""")
def j9(t):
    return P.evaluate_rules(requests(t), RULES)


@query("j10_approver_rules", f"""
SELECT request_id, array_to_string(list_sort(list_filter(['lead', CASE WHEN high_value THEN 'cfo' END, CASE WHEN disabled THEN 'hr' END], lambda x: x IS NOT NULL)), ',') AS approvers FROM ({REQ})""")
def j10(t):
    out = P.required_approvers(requests(t), [("lead", True, None), ("cfo", False, "high_value"), ("hr", False, "disabled")])
    return out.select("request_id", F.array_join("required_approvers", ",").alias("approvers"))


@query("j11_evaluate_batch", f"SELECT request_id, error, CASE WHEN error IS NULL THEN CASE WHEN amount < 300000 THEN 'allow' ELSE 'deny' END END AS result FROM (SELECT *, {SQL_ERROR} AS error FROM ({REQ}))")
def j11(t):
    return P.evaluate_batch(requests(t), F.col("amount") < 300000).select("request_id", "error", "result")


@query("j11_batch_totals", f"""
SELECT count(*) AS total, count(*) FILTER (error IS NULL) AS successful, count(*) FILTER (error IS NOT NULL) AS failed, count(*) FILTER (error IS NULL AND amount < 300000) AS allowed
FROM (SELECT *, {SQL_ERROR} AS error FROM ({REQ}))""")
def j11t(t):
    return P.batch_totals(P.evaluate_batch(requests(t), F.col("amount") < 300000))


@query("j12_enrich", """
SELECT o_orderkey AS request_id, coalesce(c_mktsegment, 'none') AS segment, o_totalprice AS amount, n_name AS region_name FROM orders
LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey""")
def j12(t):
    req = t.orders.select(F.col("o_orderkey").alias("request_id"), F.col("o_custkey").alias("cust"), F.lit("none").alias("segment"), F.col("o_totalprice").alias("amount"))
    cust = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("cust"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nk"))
    nation = t.nation.select(F.col("n_nationkey").alias("nk"), F.col("n_name").alias("region_name"))
    return P.enrich(req, [(cust, "cust"), (None, "cust"), (nation, "nk")]).select("request_id", "segment", "amount", "region_name")


STEPS = [
    P.Step("screen", lambda: F.when(F.col("disabled"), "deny").otherwise("allow"), on_success="stop"),
    P.Step("limit", lambda: F.when(F.col("amount") > 400000, "deny").otherwise("allow"), fails=lambda: F.col("amount") < 30000, on_failure="continue"),
    P.Step("final", lambda: F.when((F.col("limit_result") == "allow") & (F.col("environment") != "production"), "allow").otherwise("require_approval"),
           fails=lambda: F.col("context").isNull()),
]


@query("j13_run_steps", f"""
SELECT request_id, status, decision FROM (SELECT *,
  CASE WHEN disabled THEN 'completed' WHEN context IS NULL THEN 'failed' ELSE 'completed' END AS status,
  CASE WHEN disabled THEN 'deny' WHEN context IS NULL THEN NULL WHEN amount >= 30000 AND amount <= 400000 AND environment <> 'production' THEN 'allow' ELSE 'require_approval' END AS decision FROM ({REQ}))""")
def j13(t):
    return P.run_steps(requests(t), STEPS).select("request_id", "status", "decision")


def _repeats(t):
    key = P.request_key(F.col("event_type").alias("policy"), F.lit("x").alias("input"), (F.col("user_id") % 10).alias("user"))
    return t.events.select(key.alias("request_key"), (F.col("user_id") % 10).alias("user"), "event_type",
                           F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("request_id"))


@query("j14_dedupe_requests", """
WITH RECURSIVE r AS MATERIALIZED (SELECT event_id, event_type || (user_id % 10) AS k, ts, row_number() OVER (PARTITION BY event_type, user_id % 10 ORDER BY ts, event_id) AS rn FROM events),
c AS (SELECT k, rn, event_id, ts, ts AS anchor, false AS hit FROM r WHERE rn = 1
  UNION ALL SELECT r.k, r.rn, r.event_id, r.ts, CASE WHEN r.ts <= c.anchor + INTERVAL 3600 SECOND THEN c.anchor ELSE r.ts END, r.ts <= c.anchor + INTERVAL 3600 SECOND
  FROM c JOIN r ON r.k = c.k AND r.rn = c.rn + 1)
SELECT event_id AS request_id, hit FROM c""")
def j14(t):
    return P.dedupe_requests(_repeats(t), 3600).select("request_id", "hit")


def decisions(t):
    return t.events.select(
        F.col("event_id").alias("decision_id"), F.col("event_type").alias("policy_id"), "user_id",
        F.when(F.col("value") < 20, "allow").when(F.col("value") < 60, "deny").otherwise("require_approval").alias("result"),
        F.col("ts").cast("timestamp").alias("evaluated_at"), F.col("value").alias("eval_ms"), (F.floor("value") % 4 == 0).alias("cache_hit"))


DEC = """
SELECT event_id AS decision_id, event_type AS policy_id, user_id, CASE WHEN value < 20 THEN 'allow' WHEN value < 60 THEN 'deny' ELSE 'require_approval' END AS result,
  ts AS evaluated_at, value AS eval_ms, CAST(floor(value) AS BIGINT) % 4 = 0 AS cache_hit FROM events"""


@query("j15_query_decisions", f"""
SELECT decision_id, user_id, result FROM ({DEC}) WHERE policy_id = 'click' AND result = 'deny' AND evaluated_at >= TIMESTAMP '2024-01-05' AND evaluated_at <= TIMESTAMP '2024-01-20'
ORDER BY evaluated_at DESC, decision_id LIMIT 200""")
def j15(t):
    return P.query_decisions(
        decisions(t), policy_id="click", result="deny", start=F.lit("2024-01-05").cast("timestamp"),
        end=F.lit("2024-01-20").cast("timestamp"), limit=200).select("decision_id", "user_id", "result")


@query("j16_decision_analytics", f"""
SELECT policy_id, user_id, count(*) AS decisions, round(avg((result = 'allow')::INT), 6) AS approval_rate, round(avg(eval_ms), 6) AS avg_eval_ms FROM ({DEC}) GROUP BY ALL""")
def j16(t):
    return P.decision_analytics(decisions(t), ["policy_id", "user_id"]).select(
        "policy_id", "user_id", "decisions", F.round("approval_rate", 6).alias("approval_rate"), F.round("avg_eval_ms", 6).alias("avg_eval_ms"))


@query("j17_decision_metrics", f"""
SELECT strftime(time_bucket(INTERVAL 1 MINUTE, evaluated_at), '%Y-%m-%d %H:%M') AS minute, count(*) AS decisions, round(avg(cache_hit::INT), 6) AS cache_hit_rate FROM ({DEC}) GROUP BY 1""")
def j17(t):
    return M.decisions_per_minute(decisions(t)).select(
        F.date_format("minute", "yyyy-MM-dd HH:mm").alias("minute"), "decisions", F.round("cache_hit_rate", 6).alias("cache_hit_rate"))


def _roles(t):
    """Nations inherit from their region; regions form a ring, so the graph has a cycle."""
    n = t.nation.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("role"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("inherits"))
    r = t.region.select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("role"),
                        F.when(F.col("r_regionkey") < 3, F.concat(F.lit("r"), ((F.col("r_regionkey") + 1) % 3).cast("string"))).otherwise("ghost").alias("inherits"))
    edges = n.unionByName(r)
    grants = t.supplier.select(F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("role"), F.concat(F.lit("supply."), (F.col("s_suppkey") % 7).cast("string")).alias("permission")).unionByName(
        t.region.select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("role"), F.lower("r_name").alias("permission"))).distinct()
    return edges.select("role").distinct(), edges, grants


SQL_EDGES = "SELECT 'n' || n_nationkey AS role, 'r' || n_regionkey AS inherits FROM nation UNION ALL SELECT 'r' || r_regionkey, CASE WHEN r_regionkey < 3 THEN 'r' || ((r_regionkey + 1) % 3) ELSE 'ghost' END FROM region"
SQL_GRANTS = "SELECT DISTINCT 'n' || s_nationkey AS role, 'supply.' || (s_suppkey % 7) AS permission FROM supplier UNION SELECT 'r' || r_regionkey, lower(r_name) FROM region"


@query("j18_effective_permissions", f"""
WITH RECURSIVE e AS ({SQL_EDGES}), c AS (SELECT DISTINCT role, role AS reachable FROM e UNION SELECT c.role, e.inherits FROM c JOIN e ON e.role = c.reachable)
SELECT DISTINCT c.role, permission FROM c JOIN ({SQL_GRANTS}) g ON g.role = c.reachable""")
def j18(t):
    return A.effective_permissions(*_roles(t))


def _perms(t):
    return t.part.groupBy(
        F.when(F.col("p_type") == "SMALL", "operator").when(F.col("p_type") == "ECONOMY", "admin").otherwise("user").alias("role"),
        F.when(F.col("p_type") == "ECONOMY", "*").when(F.col("p_size") > 45, "plugin").otherwise("policy").alias("resource"),
        F.when(F.col("p_size") > 40, "read").when(F.col("p_type") == "ECONOMY", "*").otherwise("evaluate").alias("action")).agg(F.count("*").alias("n"))


SQL_PERMS = """SELECT DISTINCT CASE p_type WHEN 'SMALL' THEN 'operator' WHEN 'ECONOMY' THEN 'admin' ELSE 'user' END AS role,
  CASE WHEN p_type = 'ECONOMY' THEN '*' WHEN p_size > 45 THEN 'plugin' ELSE 'policy' END AS resource,
  CASE WHEN p_size > 40 THEN 'read' WHEN p_type = 'ECONOMY' THEN '*' ELSE 'evaluate' END AS action FROM part"""


@query("j19_check_permission", f"""
SELECT request_id, EXISTS (SELECT 1 FROM ({SQL_PERMS}) p WHERE list_contains(r.roles, p.role) AND (p.resource = r.resource OR p.resource = '*') AND (p.action = r.action OR p.action = '*')) AS permitted FROM ({REQ}) r""")
def j19(t):
    return A.check_permission(requests(t).select("request_id", "roles", "resource", "action"), _perms(t)).select("request_id", "permitted")


POLICIES = A.DEFAULT_POLICIES + [
    A.AccessPolicy("operators-read", "allow", ("policy", "plugin"), ("read", "evaluate"), ("user", "operator")),
    A.AccessPolicy("no-delete-user", "deny", ("user",), ("delete",)), A.AccessPolicy("services", "allow", ("*",), ("evaluate",), ("service",)),
]


@query("j20_evaluate_access", f"""
SELECT request_id, CASE WHEN NOT (disabled OR (resource = 'user' AND action = 'delete')) AND (list_contains(roles, 'admin')
  OR (resource IN ('policy', 'plugin') AND action IN ('read', 'evaluate') AND list_has_all(roles, ['user', 'operator'])) OR (action = 'evaluate' AND list_contains(roles, 'service')))
  THEN 'allow' ELSE 'deny' END AS decision FROM ({REQ})""")
def j20(t):
    return A.evaluate_access(requests(t), POLICIES).select("request_id", "decision")


@query("j21_list_roles", f"SELECT role, string_agg(permission, ',' ORDER BY permission) AS permissions FROM ({SQL_GRANTS}) GROUP BY role")
def j21(t):
    return A.list_roles(_roles(t)[2]).select("role", F.array_join("permissions", ",").alias("permissions"))


def _controlled(t):
    """Requests with their control list, change record and approvals, all row-local."""
    allc = sorted({c for v in P.FRAMEWORK_CONTROLS.values() for c in v})
    v = F.col("o_totalprice")
    controls = F.array_compact(F.array(*[F.when(F.length(F.lit(c)) <= F.floor(v / 15000), F.lit(c)) for c in allc]))
    who = F.concat(F.lit("u"), F.col("o_custkey").cast("string"))
    approval = lambda user, role, status: F.struct(user.alias("user_id"), F.lit(role).alias("role"), status.alias("status"))
    ok = F.when(F.col("o_orderstatus") == "F", "rejected").otherwise("approved")
    return t.orders.select(
        F.col("o_orderkey").alias("request_id"), who.alias("requester"), controls.alias("controls"),
        F.when(F.col("o_orderpriority") < "4", "financial").otherwise("public").alias("data_classification"),
        F.array(approval(F.when(F.col("o_orderpriority") == "2-HIGH", who).otherwise(F.lit("boss")), "cfo", F.lit("approved")),
                approval(F.lit("aud"), "audit_manager", ok)).alias("approvals"),
        F.lit("approved").alias("change_status"), F.when(F.col("o_custkey") % 2 == 0, "yes").alias("justification"),
        (v > 480000).alias("emergency"))


def _sql_missing(framework):
    return f"list_filter({B.sql_list(P.FRAMEWORK_CONTROLS[framework])}, lambda c: length(c) > floor(o_totalprice / 15000))"


@query("j22_sox_check", f"""
SELECT o_orderkey AS request_id, array_to_string(m, ',') AS missing, len(m) = 0 AS compliant FROM (SELECT o_orderkey, list_concat({_sql_missing('SOX')}, list_filter([
  CASE WHEN o_orderpriority >= '4' THEN 'data_class' END, CASE WHEN o_orderpriority = '2-HIGH' THEN 'segregation_of_duties' END,
  CASE WHEN o_orderstatus = 'F' THEN 'qualified_approvers' END, CASE WHEN o_custkey % 2 <> 0 OR o_totalprice > 480000 THEN 'change_management' END], lambda x: x IS NOT NULL)) AS m FROM orders)""")
def j22(t):
    return P.compliance_check(_controlled(t), "SOX").select("request_id", F.array_join("missing", ",").alias("missing"), "compliant")


@query("j22_hipaa_fedramp_check", " UNION ALL ".join(f"""
SELECT o_orderkey AS request_id, '{f}' AS framework, array_to_string({_sql_missing(f)}, ',') AS missing, len({_sql_missing(f)}) = 0 AS compliant FROM orders""" for f in ("HIPAA", "FedRAMP")))
def j22h(t):
    parts = [P.compliance_check(_controlled(t), f).select(
        "request_id", F.lit(f).alias("framework"), F.array_join("missing", ",").alias("missing"), "compliant") for f in ("HIPAA", "FedRAMP")]
    return parts[0].unionByName(parts[1])


@query("j23_approval_requirements", f"""
SELECT request_id, array_to_string(list_filter(['technical_review', CASE WHEN data_classification = 'sensitive' THEN 'security_review' END, CASE WHEN len(compliance) > 0 THEN 'compliance_review' END,
  CASE WHEN {SCORE} > 8 THEN 'executive_approval' END], lambda x: x IS NOT NULL), ',') AS requirements FROM ({REQ})""")
def j23(t):
    return P.approval_requirements(P.deployment_policy(requests(t))).select("request_id", F.array_join("requirements", ",").alias("requirements"))


def audit(t):
    return t.events.select(
        F.col("event_id").alias("audit_id"), F.col("ts").cast("timestamp").alias("ts"), "user_id", F.col("event_type").alias("action"),
        F.lit("policy").alias("resource"), F.when(F.col("value") > 30, "denied").otherwise("ok").alias("result"))


AUD = "SELECT event_id AS audit_id, ts, user_id, event_type AS action, CASE WHEN value > 30 THEN 'denied' ELSE 'ok' END AS result FROM events"


@query("j24_query_audit", f"SELECT audit_id, user_id FROM ({AUD}) WHERE action = 'error' AND result = 'denied' AND ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-25' ORDER BY ts DESC, audit_id LIMIT 150")
def j24(t):
    return M.query_audit(audit(t), action="error", result="denied", start=F.lit("2024-01-03").cast("timestamp"),
                         end=F.lit("2024-01-25").cast("timestamp"), limit=150).select("audit_id", "user_id")


@query("j24_audit_report", f"SELECT action, result, count(*) AS events, count(DISTINCT user_id) AS users FROM ({AUD}) WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY ALL")
def j24r(t):
    return M.audit_report(audit(t), F.lit("2024-01-10").cast("timestamp"))


def points(t):
    return t.events.select(
        F.col("event_type").alias("name"), F.col("event_id").alias("id"), "value", F.col("ts").cast("timestamp").alias("ts"),
        F.create_map(F.lit("shard"), (F.col("user_id") % 4).cast("string")).alias("tags"))


@query("j25_query_metrics", " UNION ALL ".join(f"""
SELECT '{a}' AS agg, event_type AS name, strftime(time_bucket(INTERVAL 6 HOUR, ts), '%Y-%m-%d %H') AS bucket, round({a}(value), 6) AS value FROM events
WHERE event_type IN ('view', 'click') AND user_id % 4 = 2 AND ts >= TIMESTAMP '2024-01-02' GROUP BY 2, 3""" for a in ("avg", "sum", "min", "max")))
def j25(t):
    kinds = ["avg", "sum", "min", "max"]
    wide = M.query_metrics(points(t), "6 hours", kinds, names=["view", "click"], tags={"shard": "2"}, start=F.lit("2024-01-02").cast("timestamp"))
    return wide.unpivot(["name", "bucket"], kinds, "agg", "value").select(
        "agg", "name", F.date_format("bucket", "yyyy-MM-dd HH").alias("bucket"), F.round("value", 6).alias("value"))


@query("j26_latency_stats", """
SELECT event_type AS name, count(*) AS calls, round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max,
  list_sort(list(value))[CAST(floor(0.95 * count(*)) AS INT) + 1] AS p95, list_sort(list(value))[CAST(floor(0.99 * count(*)) AS INT) + 1] AS p99 FROM events GROUP BY event_type""")
def j26(t):
    return M.latency_stats(points(t), ["name"]).withColumn("mean", F.round("mean", 6))


@query("j26_latency_overall", """
SELECT count(*) AS calls, round(avg(value), 6) AS mean, min(value) AS min, max(value) AS max,
  list_sort(list(value))[CAST(floor(0.95 * count(*)) AS INT) + 1] AS p95, list_sort(list(value))[CAST(floor(0.99 * count(*)) AS INT) + 1] AS p99 FROM events""")
def j26o(t):
    return M.latency_stats(t.events).withColumn("mean", F.round("mean", 6))


@query("j27_label_counters", "SELECT policy_id, result, cache_hit, count(*) AS count FROM (" + DEC + ") GROUP BY ALL")
def j27(t):
    return M.label_counters(decisions(t), ["policy_id", "result", "cache_hit"])


@query("j27_histogram", """
SELECT name, le, count FROM (SELECT event_type AS name, unnest([CAST(5 AS DOUBLE), 10, 25, 50, 100, CAST('inf' AS DOUBLE)]) AS le,
  unnest([count(*) FILTER (value <= 5), count(*) FILTER (value <= 10), count(*) FILTER (value <= 25), count(*) FILTER (value <= 50), count(*) FILTER (value <= 100), count(*)]) AS count FROM events GROUP BY event_type)""")
def j27h(t):
    return M.histogram(points(t), [5, 10, 25, 50, 100], ["name"])
