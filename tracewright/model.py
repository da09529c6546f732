"""Ranks, weights and the finding row shared by every scanner."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Ordered enums and severity weights.
SEVERITIES = ["info", "low", "medium", "high", "critical"]
SEVERITY_WEIGHT = {"critical": 10.0, "high": 7.0, "medium": 4.0, "low": 2.0, "info": 1.0}
PRIORITIES = ["low", "normal", "high", "critical"]
CLASSIFICATIONS = ["public", "internal", "confidential", "restricted"]

FINDING_COLUMNS = [
    "finding_id", "job_id", "path", "line_number", "finding_type", "severity", "title",
    "evidence", "recommendation", "confidence", "cve_id", "references", "detected_at", "description", "file_id",
]


def lookup(mapping: dict, key: Column) -> Column:
    """Constant map lookup; folds to one literal, null for unknown keys."""
    pairs: list[Column] = []
    for k, v in mapping.items():
        pairs += [F.lit(k), F.lit(v)]
    return F.try_element_at(F.create_map(*pairs), key)


def rank_of(values: Sequence[str], col: Column | str) -> Column:
    """1-based position in an ordered enum, null when unknown."""
    key = F.col(col) if isinstance(col, str) else col
    return lookup({v: i + 1 for i, v in enumerate(values)}, key)


def severity_rank(col: Column | str = "severity") -> Column:
    return rank_of(SEVERITIES, col)


def severity_weight(col: Column | str = "severity") -> Column:
    return lookup(SEVERITY_WEIGHT, F.col(col) if isinstance(col, str) else col)


def severity_of(confidence: Column) -> Column:
    """Severity bucket of a confidence (half-open buckets on double)."""
    return (
        F.when(confidence >= 0.9, "critical")
        .when(confidence >= 0.7, "high")
        .when(confidence >= 0.5, "medium")
        .otherwise("low")
    )


def stable_id(*parts: Column) -> Column:
    """Deterministic id from a natural key, nulls as empty text."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def as_findings(
    df: DataFrame,
    *,
    rule: Column,
    finding_type: Column | str,
    severity: Column | str,
    title: Column | str,
    confidence: Column | float,
    evidence: dict[str, Column],
    recommendation: Column | str | None = None,
    path: Column | None = None,
    line_number: Column | None = None,
    cve_id: Column | None = None,
    references: Column | None = None,
    job_id: Column | None = None,
    detected_at: Column | None = None,
) -> DataFrame:
    """Project any rows to the finding schema; ``file_id`` is the id of (job, path), null for findings of a whole job.

    ``detected_at`` defaults to the row's own column of that name, else null: the
    engine never reads the wall clock.
    """
    def col(v):
        return v if isinstance(v, Column) else F.lit(v)

    job = F.col("job_id") if job_id is None else job_id
    where = F.lit(None).cast("string") if path is None else path
    line = (F.lit(None) if line_number is None else line_number).cast("int")
    pairs: list[Column] = []
    for k, v in evidence.items():
        pairs += [F.lit(k), v.cast("string")]
    when = detected_at
    if when is None:
        when = F.col("detected_at") if "detected_at" in df.columns else F.lit(None)
    return df.select(
        stable_id(job, where, line, rule).alias("finding_id"),
        job.cast("string").alias("job_id"),
        where.alias("path"),
        line.alias("line_number"),
        col(finding_type).alias("finding_type"),
        col(severity).alias("severity"),
        col(title).alias("title"),
        F.create_map(*pairs).alias("evidence"),
        col(recommendation).cast("string").alias("recommendation"),
        col(confidence).cast("double").alias("confidence"),
        (F.lit(None) if cve_id is None else cve_id).cast("string").alias("cve_id"),
        (F.array().cast("array<string>") if references is None else references).alias("references"),
        when.cast("timestamp").alias("detected_at"),
        F.concat_ws(" ", col(title), F.concat(F.lit("in "), where), F.concat(F.lit("at line "), line.cast("string"))).alias("description"),
        F.when(where.isNotNull(), stable_id(job, where)).alias("file_id"),
    )
