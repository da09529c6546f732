"""Audit, metric and latency queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions.ordered import run_ids, segment_of

FINE = 1024


def decisions_per_minute(decisions: DataFrame, ts: str = "evaluated_at") -> DataFrame:
    return decisions.groupBy(F.window(ts, "1 minute").alias("w")).agg(
        F.count("*").alias("decisions"), F.avg(F.col("cache_hit").cast("int")).alias("cache_hit_rate")
    ).select(F.col("w.start").alias("minute"), "decisions", "cache_hit_rate")


def _between(rows: DataFrame, start: Column | None, end: Column | None) -> DataFrame:
    if start is not None:
        rows = rows.where(F.col("ts") >= start)
    return rows if end is None else rows.where(F.col("ts") < end)


def query_audit(
    audit: DataFrame, *, user_id=None, action: str | None = None, resource: str | None = None,
    result: str | None = None, start: Column | None = None, end: Column | None = None, limit: int | None = None,
) -> DataFrame:
    rows = _between(audit, start, end)
    for column, value in (("user_id", user_id), ("action", action), ("resource", resource), ("result", result)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    rows = rows.orderBy(F.col("ts").desc(), "audit_id")
    return rows if limit is None else rows.limit(limit)


def audit_report(audit: DataFrame, start: Column | None = None, end: Column | None = None) -> DataFrame:
    return _between(audit, start, end).groupBy("action", "result").agg(
        F.count("*").alias("events"), F.count_distinct("user_id").alias("users"))


def query_metrics(
    points: DataFrame, resolution: str, aggregations: str | Sequence[str], *, names: Sequence[str] | None = None,
    tags: dict[str, str] | None = None, start: Column | None = None, end: Column | None = None,
) -> DataFrame:
    """points(name, value, tags, ts) per name and window with avg, sum, min or max.

    One aggregation gives ``value``; a list gives a column each, in one pass.
    """
    rows = _between(points, start, end)
    if names is not None:
        rows = rows.where(F.col("name").isin(list(names)))
    for k, v in (tags or {}).items():
        rows = rows.where(F.col("tags")[k] == v)
    known = {"avg": F.avg, "sum": F.sum, "min": F.min, "max": F.max}
    wanted = {"value": aggregations} if isinstance(aggregations, str) else {a: a for a in aggregations}
    return rows.groupBy("name", F.window("ts", resolution).alias("w")).agg(*[known[a]("value").alias(c) for c, a in wanted.items()]).select(
        "name", F.col("w.start").alias("bucket"), *wanted)


def _holding(hist: DataFrame, names: list[str]) -> DataFrame:
    """The bucket of each group in which the 0-based ``_rank`` falls, with the rank counted from its start."""
    order = [c for c in ("_slot", "_fine") if c in hist.columns][-1]
    upto = F.sum("_n").over(Window.partitionBy(*names).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    inside = (F.col("_rank") >= F.col("_upto") - F.col("_n")) & (F.col("_rank") < F.col("_upto"))
    return hist.withColumn("_upto", upto).where(inside).withColumn("_rank", F.col("_rank") - F.col("_upto") + F.col("_n")).drop("_upto")


def _ranked(calls: DataFrame, quantiles: Sequence[float], names: list[str], value: str) -> DataFrame:
    """The value at index int(q * n) of each group's sorted values, with the group's count, mean and bounds.

    Rows are counted in buckets of a fixed logarithmic scale (at most some 90,000), then those of the one
    bucket that holds a rank in FINE equal parts, and only the values of one part are put in order. Each
    step adds up before it shuffles; what it joins back is a row per group and quantile.
    """
    v = F.col(value).cast("double")
    scale = F.floor(F.signum(v) * F.log1p(F.abs(v)) * 64).cast("int")
    rows = calls.where(F.col(value).isNotNull()).withColumn("_slot", scale)
    hist = rows.groupBy(*names, "_slot").agg(F.count("*").alias("_n"), F.sum(value).alias("_sum"), F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    group = Window.partitionBy(*names)
    hist = hist.withColumns({
        "calls": F.sum("_n").over(group), "mean": F.sum("_sum").over(group) / F.sum("_n").over(group),
        "min": F.min("_lo").over(group), "max": F.max("_hi").over(group)})
    asked = hist.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in quantiles]))).withColumn(
        "_rank", F.least(F.floor(F.col("q") * F.col("calls")), F.col("calls") - 1))
    names_q = [*names, "q"]
    want = _holding(asked, names_q).drop("_n", "_sum")
    width = (F.col("_hi") - F.col("_lo")) / FINE
    fine = F.when(width > 0, F.least(F.floor((F.col(value) - F.col("_lo")) / width), F.lit(FINE - 1))).otherwise(0).cast("int")
    first = rows.select(*names, "_slot", value).join(want, [*names, "_slot"]).withColumn("_fine", fine)
    carried = ["calls", "mean", "min", "max"]
    kept = [F.first(c).alias(c) for c in carried]
    hist = first.groupBy(*names_q, "_slot", "_fine").agg(F.count("*").alias("_n"), F.first("_rank").alias("_rank"))
    part = _holding(hist, names_q).drop("_n")
    last = first.drop("_rank").join(part, [*names_q, "_slot", "_fine"]).groupBy(*names_q, value).agg(
        F.count("*").alias("_n"), F.first("_rank").alias("_rank"), *kept)
    upto = Window.partitionBy(*names_q).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return last.withColumn("_cum", F.sum("_n").over(upto)).where(F.col("_cum") > F.col("_rank")).groupBy(*names_q).agg(
        F.min(value).alias("value"), *kept)


def exact_ranks(calls: DataFrame, quantiles: Sequence[float], by: Sequence[str] = (), value: str = "value") -> DataFrame:
    """The value at index int(q * n) of the sorted list of each group, exactly, without sorting it all."""
    return _ranked(calls, quantiles, list(by), value).select(*by, "q", "value")


def latency_stats(calls: DataFrame, by: Sequence[str] = (), value: str = "value") -> DataFrame:
    """Mean, min, max and the p95 / p99 by index of each group."""
    return _ranked(calls, [0.95, 0.99], list(by), value).groupBy(*by).agg(
        *[F.first(c).alias(c) for c in ("calls", "mean", "min", "max")],
        F.max(F.when(F.col("q") == 0.95, F.col("value"))).alias("p95"),
        F.max(F.when(F.col("q") == 0.99, F.col("value"))).alias("p99"))


def label_counters(calls: DataFrame, labels: Sequence[str]) -> DataFrame:
    return calls.groupBy(*labels).agg(F.count("*").alias("count"))


def histogram(calls: DataFrame, buckets: Sequence[float], by: Sequence[str] = (), value: str = "value") -> DataFrame:
    """Cumulative counts per upper bound, the last bound being infinity."""
    cells = [F.count_if(F.col(value) <= b).alias(f"_b{i}") for i, b in enumerate(buckets)]
    wide = calls.groupBy(*by).agg(*cells, F.count("*").alias("_all"))
    rows = F.array(*[
        F.struct(F.lit(float(b)).alias("le"), F.col(f"_b{i}").alias("count")) for i, b in enumerate(buckets)
    ], F.struct(F.lit(float("inf")).alias("le"), F.col("_all").alias("count")))
    return wide.select(*by, F.explode(rows).alias("r")).select(*by, "r.le", "r.count")


def sustained_alerts(
    points: DataFrame, threshold: float, duration_seconds: int, slice_seconds: int | None = None
) -> DataFrame:
    """Runs of consecutive breaching points(name, id, ts, value) that last at least the duration."""
    keys, order = ["name"], ["ts", "id"]
    rows = points.withColumn("_hot", F.col("value") > threshold)
    runs = run_ids(
        rows, keys, order, ["_hot"], lambda before, now: before["_hot"] != now["_hot"],
        segment_of(points, keys, "ts", slice_seconds), "_run").where("_hot")
    return runs.groupBy("name", "_run").agg(
        F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"), F.count("*").alias("points"),
        F.max("value").alias("peak")
    ).where(F.timestamp_diff("SECOND", F.col("started_at"), F.col("ended_at")) >= duration_seconds).drop("_run")
