"""Policy rules over request rows. Rules are Column expressions or small rule lists."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.functions.fold import chain_entries, fold_sorted, slice_length
from tracewright.model import lookup

# Deployment risk table and approvers.
ENVIRONMENT_RISK = {"development": 1, "staging": 3, "production": 5}
CLASSIFICATION_RISK = {"public": 1, "internal": 3, "sensitive": 5}
CACHE_TTL_SECONDS = 300


def validate_requests(req: DataFrame) -> DataFrame:
    return req.withColumn(
        "error",
        F.when(F.coalesce("policy_id", F.lit("")) == "", "policy ID is required")
        .when(F.col("input").isNull(), "input is required")
        .when(F.col("context").isNull(), "context is required"))


def decide(req: DataFrame, rule: Column) -> DataFrame:
    """Default deny: allow only when the rule is true."""
    return req.withColumn("result", F.when(F.coalesce(rule, F.lit(False)), "allow").otherwise("deny"))


def deployment_policy(req: DataFrame) -> DataFrame:
    """allow, require_approval, required_approvers, risk_score, framework predicates and explanation."""
    env, data, factors = F.col("environment"), F.col("data_classification"), F.col("risk_factors")
    allow = (env == "development") & data.isin("public", "internal")
    approval = (env == "production") | (data == "sensitive") | F.array_contains(factors, "external_dependencies")
    approvers = F.array_compact(F.array(
        F.when(env == "production", F.lit("security_officer")),
        F.when(data == "sensitive", F.lit("compliance_manager")),
        F.when(F.size(factors) > 3, F.lit("cto"))))
    score = lookup(ENVIRONMENT_RISK, env) + lookup(CLASSIFICATION_RISK, data) + F.size(factors)
    explanation = F.when(F.col("require_approval"), F.format_string(
        "Approval required: %s environment with %s data classification", env, data)).when(
        F.col("allow"), "Deployment allowed: Low risk development environment")
    return (
        req.withColumn("allow", F.coalesce(allow, F.lit(False)))
        .withColumn("require_approval", F.coalesce(approval, F.lit(False)))
        .withColumn("required_approvers", approvers).withColumn("risk_score", score)
        .withColumn("sox_compliant", F.array_contains("compliance", "SOX") & (env == "production")
                    & F.array_contains(factors, "financial_data"))
        .withColumn("hipaa_compliant", F.array_contains("compliance", "HIPAA") & (data == "sensitive")
                    & F.array_contains(factors, "phi_access"))
        .withColumn("explanation", explanation)
    )


def basic_access(req: DataFrame) -> DataFrame:
    """Admins may do anything, owners read, users create."""
    rule = (
        F.array_contains("roles", "admin")
        | ((F.col("action") == "read") & (F.col("owner") == F.col("user_id")))
        | ((F.col("action") == "create") & F.array_contains("roles", "user")))
    return decide(req, rule)


@dataclass(frozen=True)
class Condition:
    """One condition of a policy; all conditions of a policy must hold."""

    policy_id: str
    field: str
    operator: str
    values: tuple[str, ...]


def _holds(c: Condition, df: DataFrame) -> Column:
    value = F.col(c.field)
    if isinstance(df.schema[c.field].dataType, T.ArrayType):
        hit = F.arrays_overlap(value, F.array(*[F.lit(v) for v in c.values]))
        test = {"in": hit, "contains": hit, "not_in": ~hit}
    else:
        text = value.cast("string")
        test = {
            "equals": text == c.values[0], "not_equals": text != c.values[0], "in": text.isin(*c.values),
            "not_in": ~text.isin(*c.values), "contains": text.contains(c.values[0]),
        }
        if c.operator in ("greater_than", "less_than"):
            number, bound = value.cast("double"), float(c.values[0])
            test = {"greater_than": number > bound, "less_than": number < bound}
    if c.operator not in test:
        raise ValueError(f"operator {c.operator!r} does not apply to {c.field}")
    return F.coalesce(test[c.operator], F.lit(False))


def evaluate_rules(req: DataFrame, conditions: Sequence[Condition]) -> DataFrame:
    """(request, policy, satisfied): the rule list becomes one row-local expression per policy."""
    policies = list(dict.fromkeys(c.policy_id for c in conditions))
    verdicts = F.array(*[
        F.struct(F.lit(p).alias("policy"),
                 reduce(lambda a, b: a & b, [_holds(c, req) for c in conditions if c.policy_id == p]).alias("satisfied"))
        for p in policies])
    return req.select("request_id", F.explode(verdicts).alias("v")).select("request_id", "v.policy", "v.satisfied")


def required_approvers(req: DataFrame, rules: Sequence[tuple[str, bool, str | None]]) -> DataFrame:
    """rules (role, always required, flag column that requires it)."""
    needed = F.array_compact(F.array(*[
        F.when(F.lit(always) | (F.coalesce(F.col(flag), F.lit(False)) if flag else F.lit(False)), F.lit(role))
        for role, always, flag in rules]))
    return req.withColumn("required_approvers", F.array_sort(F.array_distinct(needed)))


def evaluate_batch(req: DataFrame, rule: Column) -> DataFrame:
    """Each row gets a result or an error; an invalid row never fails the batch."""
    checked = validate_requests(req)
    return decide(checked, rule).withColumn("result", F.when(F.col("error").isNull(), F.col("result")))


def batch_totals(evaluated: DataFrame) -> DataFrame:
    return evaluated.agg(
        F.count("*").alias("total"), F.count_if(F.col("error").isNull()).alias("successful"),
        F.count_if(F.col("error").isNotNull()).alias("failed"), F.count_if(F.col("result") == "allow").alias("allowed"))


def enrich(req: DataFrame, sources: Sequence[tuple[DataFrame | None, str]]) -> DataFrame:
    """Left-join each (source, key); its columns overwrite the request's, a missing source is skipped."""
    out = req
    for i, (source, key) in enumerate(sources):
        if source is None:
            continue
        fields = [c for c in source.columns if c != key]
        renamed = source.select(key, *[F.col(c).alias(f"_s{i}_{c}") for c in fields])
        out = out.join(renamed, key, "left")
        for c in fields:
            mine = F.col(c) if c in out.columns else F.lit(None)
            out = out.withColumn(c, F.coalesce(F.col(f"_s{i}_{c}"), mine))
        out = out.drop(*[f"_s{i}_{c}" for c in fields])
    return out


@dataclass(frozen=True)
class Step:
    """A decision step: ``result`` and ``fails`` build Columns and may read earlier ``<step>_result`` columns."""

    name: str
    result: Callable[[], Column]
    fails: Callable[[], Column] | None = None
    on_failure: str = "stop"
    on_success: str = "continue"


def run_steps(req: DataFrame, steps: Sequence[Step]) -> DataFrame:
    """Fold the ordered steps over every row at once; rows that stopped keep their outcome."""
    df = req.withColumn("_active", F.lit(True)).withColumn("status", F.lit("running")).withColumn(
        "decision", F.lit(None).cast("string"))
    for i, step in enumerate(steps):
        last = i == len(steps) - 1
        failed = F.coalesce(step.fails(), F.lit(False)) if step.fails else F.lit(False)
        df = df.withColumn("_failed", F.col("_active") & failed)
        out = f"{step.name}_result"
        df = df.withColumn(out, F.when(F.col("_active") & ~F.col("_failed"), step.result()))
        stop_fail = F.col("_failed") & F.lit(step.on_failure != "continue")
        stop_deny = F.col("_active") & ~F.col("_failed") & (F.col(out) == "deny") & F.lit(step.on_success == "stop")
        stop_deny = F.coalesce(stop_deny, F.lit(False))
        done = F.col("_active") & F.lit(last) & ~stop_fail
        df = (
            df.withColumn("status", F.when(stop_fail, "failed").when(stop_deny | done, "completed").otherwise(F.col("status")))
            .withColumn("decision", F.when(stop_deny | done, F.col(out)).otherwise(F.col("decision")))
            .withColumn("_active", F.col("_active") & ~stop_fail & ~stop_deny)
        )
    return df.drop("_active", "_failed")


def request_key(*parts: Column) -> Column:
    return F.sha2(F.to_json(F.struct(*parts)), 256)


def dedupe_requests(req: DataFrame, ttl: int = CACHE_TTL_SECONDS, slice_seconds: int | None = None) -> DataFrame:
    """Add ``hit``: an equal request was evaluated at most ``ttl`` seconds before and is still valid.

    Validity runs from the evaluation, not from the last hit, so each decision depends on earlier
    ones of the same key. Busy keys are cut into slices of time: a table of each slice says which evaluation
    it leaves valid for any it is entered with, these compose to the entering one of every slice, and slices
    are then folded side by side, whether the key ever pauses or not.
    req(request_key, ts, request_id, ...).
    """
    keys, order = ["request_key"], ["ts", "request_id"]
    length = slice_length(req, keys, "ts", ttl, slice_seconds)
    entries = chain_entries(req, keys, order, ttl, length)
    rows = req.withColumn("_second", F.col("ts").cast("double")).withColumn("_slice", F.floor(F.col("_second") / length)).join(
        entries, [*keys, "_slice"], "left")

    def step(anchor, second, enter):
        if anchor is None:
            anchor = enter if enter is not None and enter == enter else None
        if anchor is not None and second <= anchor + ttl:
            return anchor, True
        return second, False

    return fold_sorted(
        rows, [*keys, "_slice"], order, "hit", T.BooleanType(), lambda: None, step, ["_second", "_enter"]
    ).select(*req.columns, "hit")


def cache_statistics(deduped: DataFrame) -> DataFrame:
    return deduped.agg(
        F.count("*").alias("requests"), F.count_if("hit").alias("hits"),
        F.avg(F.col("hit").cast("int")).alias("hit_rate"))


def query_decisions(
    decisions: DataFrame, *, user_id=None, policy_id=None, result=None, start: Column | None = None,
    end: Column | None = None, limit: int | None = None,
) -> DataFrame:
    rows = decisions
    for column, value in (("user_id", user_id), ("policy_id", policy_id), ("result", result)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    if start is not None:
        rows = rows.where(F.col("evaluated_at") >= start)
    if end is not None:
        rows = rows.where(F.col("evaluated_at") <= end)
    rows = rows.orderBy(F.col("evaluated_at").desc(), "decision_id")
    return rows if limit is None else rows.limit(limit)


def decision_analytics(decisions: DataFrame, keys: Sequence[str]) -> DataFrame:
    return decisions.groupBy(*keys).agg(
        F.count("*").alias("decisions"), F.avg((F.col("result") == "allow").cast("int")).alias("approval_rate"),
        F.avg("eval_ms").alias("avg_eval_ms"))


# Framework templates: the control flags each framework demands, all at once.
FRAMEWORK_CONTROLS = {
    "SOX": ["encryption", "access_logging", "data_integrity", "audit_trail_complete", "audit_trail_immutable", "audit_system"],
    "HIPAA": ["unique_user_identification", "automatic_logoff", "encryption", "access_logging", "monitoring",
              "data_integrity", "tampering_detection", "encryption_in_transit", "end_to_end_encryption",
              "security_officer", "training_completed", "procedures_documented", "regular_reviews"],
    "FedRAMP": ["account_management", "rbac", "least_privilege", "mfa_required", "real_time_events",
                "vulnerability_scanning", "configuration_monitoring", "performance_monitoring"],
}
QUALIFIED_ROLES = ["financial_controller", "cfo", "audit_manager"]


def compliance_check(req: DataFrame, framework: str) -> DataFrame:
    """Template verdict with the list of missing controls.

    SOX also needs financial or sensitive data, an approved non-emergency change with a reason,
    every approver to differ from the requester and two qualified approvals.
    """
    controls = FRAMEWORK_CONTROLS[framework]
    missing = F.array_except(F.array(*[F.lit(c) for c in controls]), F.col("controls"))
    if framework != "SOX":
        return req.withColumn("missing", missing).withColumn("compliant", F.size("missing") == 0)
    others = F.forall("approvals", lambda a: a["user_id"] != F.col("requester"))
    qualified = F.size(F.filter(
        "approvals", lambda a: (a["status"] == "approved") & a["role"].isin(*QUALIFIED_ROLES))) >= 2
    change = (F.col("change_status") == "approved") & F.col("justification").isNotNull() & ~F.col("emergency")
    extra = F.array(
        F.when(~F.col("data_classification").isin("financial", "sensitive"), F.lit("data_class")),
        F.when(~others, F.lit("segregation_of_duties")), F.when(~qualified, F.lit("qualified_approvers")),
        F.when(~F.coalesce(change, F.lit(False)), F.lit("change_management")))
    return req.withColumn("missing", F.concat(missing, F.array_compact(extra))).withColumn(
        "compliant", F.size("missing") == 0)


def approval_requirements(req: DataFrame) -> DataFrame:
    """Base review plus the reviews the context asks for."""
    return req.withColumn("requirements", F.array_compact(F.array(
        F.lit("technical_review"),
        F.when(F.col("data_classification") == "sensitive", F.lit("security_review")),
        F.when(F.size("compliance") > 0, F.lit("compliance_review")),
        F.when(F.col("risk_score") > 8, F.lit("executive_approval")))))
