"""Roles, permissions and access policies."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.skew import join_counted
from tracewright.session import cut_lineage


def role_closure(roles: DataFrame, edges: DataFrame) -> DataFrame:
    """(role, reachable) pairs of roles(role) under edges(role, inherits); cycles end by themselves.

    Semi-naive: each round joins only the pairs found in the round before, and the result is
    checkpointed, so the plan does not grow with the depth.
    """
    step = edges.select(F.col("role").alias("reachable"), F.col("inherits").alias("next")).distinct()
    known = cut_lineage(roles.select("role", F.col("role").alias("reachable")).distinct())
    fresh = known
    while not fresh.isEmpty():
        found = fresh.join(step, "reachable").select("role", F.col("next").alias("reachable")).distinct()
        fresh = cut_lineage(found.join(known, ["role", "reachable"], "left_anti"))
        known = known.unionByName(fresh)
    return known


def effective_permissions(roles: DataFrame, edges: DataFrame, grants: DataFrame) -> DataFrame:
    """(role, permission) including inherited grants; unknown inherited roles grant nothing."""
    return role_closure(roles, edges).join(
        grants.select(F.col("role").alias("reachable"), "permission"), "reachable").select("role", "permission").distinct()


def check_permission(req: DataFrame, perms: DataFrame) -> DataFrame:
    """Add ``permitted`` to req(request_id, roles, resource, action) from perms(role, resource, action).

    Requests are first reduced to their distinct (roles, resource, action) signatures, so a hot
    role costs one row; wildcards are expanded to keep an equi-join.
    """
    sig = F.struct(F.array_sort("roles").alias("roles"), "resource", "action")
    rows = req.withColumn("_sig", sig)
    shapes = rows.groupBy("_sig").agg(
        F.count("*").alias("_n"), F.first("roles").alias("roles"), F.first("resource").alias("resource"),
        F.first("action").alias("action"))
    wanted = shapes.select("_sig", F.explode("roles").alias("role"), "resource", "action").select(
        "_sig", "role", F.explode(F.array("resource", F.lit("*"))).alias("resource"), "action").select(
        "_sig", "role", "resource", F.explode(F.array("action", F.lit("*"))).alias("action"))
    allowed = wanted.join(perms.select("role", "resource", "action").distinct(), ["role", "resource", "action"], "left_semi")
    verdict = shapes.select("_sig", "_n").join(
        allowed.select("_sig").distinct().withColumn("permitted", F.lit(True)), "_sig", "left").withColumn(
        "permitted", F.coalesce("permitted", F.lit(False)))
    return join_counted(rows, verdict, "_sig", "_n", salt=["request_id"]).drop("_sig", "_n")


@dataclass(frozen=True)
class AccessPolicy:
    name: str
    effect: str
    resources: tuple[str, ...]
    actions: tuple[str, ...]
    required_roles: tuple[str, ...] = ()
    disabled_only: bool = False


# The default fallback policies; the deny one applies to disabled users.
DEFAULT_POLICIES = [
    AccessPolicy("deny-disabled-users", "deny", ("*",), ("*",), (), True),
    AccessPolicy("allow-admin-all", "allow", ("*",), ("*",), ("admin",)),
]


def _one_of(column: str, values: Sequence[str]) -> Column:
    return F.lit(True) if "*" in values else F.col(column).isin(*values)


def evaluate_access(req: DataFrame, policies: Sequence[AccessPolicy] = tuple(DEFAULT_POLICIES)) -> DataFrame:
    """Explicit deny beats allow, default deny; the policy list becomes one row-local expression."""
    verdict = {"allow": F.lit(False), "deny": F.lit(False)}
    for p in policies:
        applies = _one_of("resource", p.resources) & _one_of("action", p.actions)
        if p.required_roles:
            needed = F.array(*[F.lit(r) for r in p.required_roles])
            applies = applies & (F.size(F.array_except(needed, F.col("roles"))) == 0)
        if p.disabled_only:
            applies = applies & F.coalesce(F.col("disabled"), F.lit(False))
        verdict[p.effect] = verdict[p.effect] | applies
    return req.withColumn("decision", F.when(~verdict["deny"] & verdict["allow"], "allow").otherwise("deny"))


def list_roles(grants: DataFrame) -> DataFrame:
    return grants.groupBy("role").agg(F.array_sort(F.collect_set("permission")).alias("permissions"))
