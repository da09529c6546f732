import random
from datetime import datetime, timedelta
from itertools import product

import pytest
from pyspark.sql import functions as F

from tracewright.operators import access as A
from tracewright.operators import events as K
from tracewright.operators import metrics as M
from tracewright.operators import policy as P

T0 = datetime(2024, 1, 1)


def test_deployment_grid(spark):
    envs, classes = ["development", "staging", "production", "lab"], ["public", "internal", "sensitive", "odd"]
    factors = [[], ["external_dependencies"], ["a", "b", "c", "phi_access"]]
    rows = [(e, c, f, ["HIPAA"]) for e, c, f in product(envs, classes, factors)]
    df = spark.createDataFrame(rows, "environment string, data_classification string, risk_factors array<string>, compliance array<string>")
    env_risk, class_risk = {"development": 1, "staging": 3, "production": 5}, {"public": 1, "internal": 3, "sensitive": 5}
    for r in P.deployment_policy(df).collect():
        e, c, f = r["environment"], r["data_classification"], r["risk_factors"]
        assert r["allow"] == (e == "development" and c in ("public", "internal"))
        assert r["require_approval"] == (e == "production" or c == "sensitive" or "external_dependencies" in f)
        want = env_risk[e] + class_risk[c] + len(f) if e in env_risk and c in class_risk else None
        assert r["risk_score"] == want
        assert ("cto" in r["required_approvers"]) == (len(f) > 3)
        assert r["hipaa_compliant"] == (c == "sensitive" and "phi_access" in f)


def test_rbac(spark):
    edges = spark.createDataFrame([("lead", "dev"), ("dev", "base"), ("base", "lead"), ("x", "missing")], "role string, inherits string")
    roles = spark.createDataFrame([("lead",), ("dev",), ("base",), ("x",)], "role string")
    grants = spark.createDataFrame([("base", "read"), ("lead", "approve")], "role string, permission string")
    got = {(r[0], r[1]) for r in A.effective_permissions(roles, edges, grants).collect()}
    assert got == {(a, p) for a in ("lead", "dev", "base") for p in ("read", "approve")}


def test_permission_wildcards(spark):
    perms = spark.createDataFrame([("admin", "*", "*"), ("dev", "repo", "read"), ("ops", "repo", "*")], "role string, resource string, action string")
    req = spark.createDataFrame([(1, ["admin"], "x", "y"), (2, ["dev"], "repo", "read"), (3, ["dev"], "repo", "write"), (4, ["ops", "dev"], "repo", "write"), (5, [], "repo", "read")], "request_id int, roles array<string>, resource string, action string")
    assert {r["request_id"]: r["permitted"] for r in A.check_permission(req, perms).collect()} == {1: True, 2: True, 3: False, 4: True, 5: False}


def test_deny_beats_allow(spark):
    req = spark.createDataFrame([(1, ["admin"], False), (2, ["admin"], True), (3, ["user"], False)], "id int, roles array<string>, disabled boolean").withColumn("resource", F.lit("r")).withColumn("action", F.lit("a"))
    assert {r["id"]: r["decision"] for r in A.evaluate_access(req).collect()} == {1: "allow", 2: "deny", 3: "deny"}


@pytest.mark.parametrize("parts", [1, 6])
def test_dedupe_equals_cache(spark, parts):
    rnd = random.Random(4)
    rows = [("hot" if rnd.random() < 0.5 else f"k{rnd.randrange(6)}", i, T0 + timedelta(seconds=rnd.randrange(30_000))) for i in range(500)]
    df = spark.createDataFrame(rows, "request_key string, request_id long, ts timestamp").repartition(parts)
    got = {r["request_id"]: r["hit"] for r in P.dedupe_requests(df, 300, 3600).collect()}
    valid = {}
    for k, i, t in sorted(rows, key=lambda r: (r[2], r[1])):
        hit = k in valid and t <= valid[k] + timedelta(seconds=300)
        if not hit:
            valid[k] = t
        assert got[i] == hit
    assert any(got.values())


def test_steps_stop_and_continue(spark):
    df = spark.createDataFrame([(1, "deny", False), (2, "allow", True), (3, "allow", False)], "id int, first string, boom boolean")
    stop = [P.Step("a", lambda: F.col("first"), on_success="stop"), P.Step("b", lambda: F.lit("allow"), fails=lambda: F.col("boom"))]
    go = [stop[0], P.Step("b", lambda: F.lit("allow"), fails=lambda: F.col("boom"), on_failure="continue")]
    assert {r["id"]: (r["status"], r["decision"]) for r in P.run_steps(df, stop).collect()} == {1: ("completed", "deny"), 2: ("failed", None), 3: ("completed", "allow")}
    assert {r["id"]: (r["status"], r["decision"]) for r in P.run_steps(df, go).collect()}[2] == ("completed", None)


def test_unknown_operator_is_refused(spark):
    with pytest.raises(ValueError):
        P.evaluate_rules(spark.range(1).select(F.col("id").alias("request_id"), F.lit("x").alias("f")), [P.Condition("p", "f", "like", ("x",))])


@pytest.mark.parametrize("seed", [1, 2])
def test_exact_percentiles(spark, seed):
    rnd = random.Random(seed)
    rows = [("a" if rnd.random() < 0.7 else "b", rnd.choice([1.0, 2.5, 100.0 * rnd.random()])) for _ in range(777)]
    df = spark.createDataFrame(rows, "name string, value double")
    for r in M.latency_stats(df, ["name"]).collect():
        vals = sorted(v for n, v in rows if n == r["name"])
        assert (r["p95"], r["p99"]) == (vals[int(0.95 * len(vals))], vals[int(0.99 * len(vals))])
    one = M.latency_stats(spark.createDataFrame([(5.0,)] * 10, "value double")).first()
    assert one["p95"] == 5.0


def test_limiter_admits_five(spark):
    rows = [(1, i, T0 + timedelta(seconds=i)) for i in range(6)] + [(1, 6, T0 + timedelta(seconds=60)), (1, 7, T0 + timedelta(seconds=60, milliseconds=500))]
    df = spark.createDataFrame(rows, "recipient_id int, event_id long, ts timestamp")
    got = {r["event_id"]: r["admitted"] for r in K.rate_limit(df, 5, 60).collect()}
    assert [got[i] for i in range(8)] == [True] * 5 + [False, True, False]


@pytest.mark.parametrize("parts", [1, 7])
def test_limiter_equals_reference_and_never_exceeds(spark, parts):
    rnd = random.Random(9)
    rows = [(0 if rnd.random() < 0.6 else rnd.randrange(1, 5), i, T0 + timedelta(seconds=rnd.randrange(20_000))) for i in range(800)]
    df = spark.createDataFrame(rows, "recipient_id int, event_id long, ts timestamp").repartition(parts)
    got = {r["event_id"]: r["admitted"] for r in K.rate_limit(df, 6, 600, slice_seconds=1800).collect()}
    recent = {}
    for k, i, t in sorted(rows, key=lambda r: (r[2], r[1])):
        live = [x for x in recent.get(k, []) if x > t - timedelta(seconds=600)]
        assert got[i] == (len(live) < 6)
        recent[k] = live + [t] if got[i] else live
        assert len(recent[k]) <= 6


def test_alert_without_severity_matches_nothing(spark):
    e = spark.createDataFrame([("1", "alert", None), ("2", "threat", "critical")], "event_id string, event_kind string, severity string")
    r = spark.createDataFrame([("security-lead", ["critical"], "email", "x"), ("incident-response", ["low"], "email", "y")], "recipient_id string, preferences array<string>, contact_kind string, contact string")
    routed = K.route(e, r)
    assert sorted((x["event_id"], x["recipient_id"]) for x in routed.collect()) == [("2", "incident-response"), ("2", "security-lead")]
    assert [x["recipient_id"] for x in K.apply_filters(routed, [K.Filter("severity", "include")]).collect()] == ["security-lead"]
    assert [x["recipient_id"] for x in K.apply_filters(routed, [K.Filter("severity", "exclude")]).collect()] == ["incident-response"]
    d = {x["event_id"]: x for x in K.distribution(e).collect()}
    assert d["1"]["networks"] == ["security-alerts"] and not d["1"]["encryption_required"]
    assert d["2"]["networks"] == ["emergency-response", "security-team"] and d["2"]["acknowledgment_required"]


def test_schema_errors(spark):
    uid = "550e8400-e29b-41d4-a716-446655440000"
    good = f'{{"malware_type": "T", "file_hash": "h", "signature_matches": ["a"], "quarantine_status": "Failed", "extra": 1}}'
    bad = '{"malware_type": 3, "signature_matches": ["a", 1], "quarantine_status": "X"}'
    df = spark.createDataFrame([(1, good), (2, bad), (3, "7"), (4, "{oops")], "id int, payload string")
    got = {r["id"]: r["errors"] for r in K.validate_schema(df, K.EVENT_SCHEMAS["MalwareEvent"]).collect()}
    assert got[1] == [] and got[3] == got[4] == ["Event data must be an object"]
    assert got[2] == [
        "Invalid type for field 'malware_type': expected string, got number", "Missing required field: file_hash",
        "Invalid type for field 'signature_matches': expected array<string>, got array",
        "Invalid type for field 'quarantine_status': expected enum(Quarantined, PendingQuarantine, NotQuarantined, Failed), got string"]
    alert = f'{{"alert_level": "Info", "action_required": "x", "escalation_path": [], "deadline": "2024-13-01T00:00:00Z", "id": "{uid}"}}'
    one = spark.createDataFrame([(alert,), (alert.replace("2024-13", "2024-12"),)], "payload string")
    assert [r["valid"] for r in K.validate_schema(one, K.EVENT_SCHEMAS["AlertEvent"]).collect()] == [False, True]


def test_alert_levels(spark):
    df = spark.createDataFrame([("emergency", T0), ("critical", T0), ("info", T0)], "alert_level string, ts timestamp")
    rows = {r["alert_level"]: r for r in K.enrich_alerts(df).collect()}
    assert rows["emergency"]["deadline"] == T0 + timedelta(minutes=15) and rows["critical"]["deadline"] == T0 + timedelta(hours=1)
    assert rows["info"]["deadline"] is None and len(rows["emergency"]["escalation_path"]) == 4 and rows["info"]["network"] == "security-alerts"


def test_sustained_alerts(spark):
    values = [1, 9, 9, 9, 1, 9, 1, 9, 9]
    rows = [("m", i, T0 + timedelta(minutes=40 * i), float(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "name string, id long, ts timestamp, value double")
    got = sorted((r["started_at"], r["points"]) for r in M.sustained_alerts(df, 5, 2400).collect())
    assert got == [(T0 + timedelta(minutes=40), 3), (T0 + timedelta(minutes=280), 2)]
