"""Commit-history analytics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright import rules as R
from tracewright.functions.lines import any_contains
from tracewright.functions.ordered import previous_row, segment_of
from tracewright.functions.skew import join_counted
from tracewright.model import as_findings
from tracewright.operators.scan import matching_rules
from tracewright.rules import Rule


def _by_rule(df: DataFrame, text: str, rules: Sequence[Rule], evidence: dict[str, Column]) -> DataFrame:
    hits = df.withColumn("_ix", F.explode(matching_rules(F.col(text), rules)))

    def pick(values):
        return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("_ix") + 1)

    return as_findings(
        hits, rule=F.concat_ws("|", pick([r.name for r in rules]), *evidence.values()),
        finding_type=pick([r.finding_type for r in rules]), severity=pick([r.severity for r in rules]),
        title=pick([r.title for r in rules]), confidence=pick([r.confidence for r in rules]),
        evidence=evidence, recommendation=pick([r.recommendation for r in rules]), job_id=F.col("repo"),
    )


def suspicious_messages(commits: DataFrame, rules: Sequence[Rule] = R.MESSAGE_RULES) -> DataFrame:
    return _by_rule(commits, "message", rules, {"commit_hash": F.col("hash"), "commit_message": F.col("message")})


def suspicious_branches(branches: DataFrame, rules: Sequence[Rule] = R.BRANCH_RULES) -> DataFrame:
    return _by_rule(branches, "name", rules, {"branch_name": F.col("name"), "last_commit": F.col("last_commit")})


def commit_totals(commit_files: DataFrame) -> DataFrame:
    """Files, lines and deletions per commit; partially aggregated before the shuffle."""
    return commit_files.groupBy("hash").agg(
        F.count("*").alias("files_changed"), F.sum("added").alias("lines_added"),
        F.sum("removed").alias("lines_removed"), F.count_if(F.col("status") == "D").alias("files_deleted"))


def large_commits(commit_files: DataFrame, files: int = 100, lines: int = 10_000) -> DataFrame:
    return commit_totals(commit_files).where((F.col("files_changed") > files) | (F.col("lines_added") > lines))


def mass_deletions(commit_files: DataFrame, files: int = 50, ratio: int = 3) -> DataFrame:
    """Commits that delete something, touch many files and remove far more than they add; one row each."""
    return commit_totals(commit_files).where(
        (F.col("files_deleted") > 0) & (F.col("files_changed") > files)
        & (F.col("lines_removed") > F.col("lines_added") * ratio))


def is_off_hours(ts: Column) -> Column:
    return (F.hour(ts) < 6) | (F.hour(ts) > 22)


def off_hours(commits: DataFrame) -> DataFrame:
    return commits.where(is_off_hours(F.col("ts")))


def busy_days(commits: DataFrame, sigma: float = 2.0, floor: int = 20, minimum: int = 10) -> DataFrame:
    """Days with unusually many commits per repo: one partial count per day, then statistics over days."""
    daily = commits.groupBy("repo", F.to_date("ts").alias("day")).agg(F.count("*").alias("commits"))
    stats = daily.groupBy("repo").agg(
        F.avg("commits").alias("mean"), F.stddev_pop("commits").alias("sd"), F.sum("commits").alias("total"))
    return (
        daily.join(stats, "repo")
        .withColumn("threshold", F.col("mean") + sigma * F.col("sd"))
        .where((F.col("total") >= minimum) & (F.col("commits") > F.col("threshold")) & (F.col("commits") > floor))
        .select("repo", "day", "commits", "mean", "threshold")
    )


def latest_commits(commits: DataFrame, n: int = 1000) -> DataFrame:
    """The n newest per repo; the rank filter is pushed below the shuffle, so a hot repo sends n rows per task."""
    w = Window.partitionBy("repo").orderBy(F.col("ts").desc(), F.col("hash"))
    return commits.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def sensitive_deletions(commit_files: DataFrame) -> DataFrame:
    return commit_files.where(
        (F.col("status") == "D") & any_contains(F.lower("path"), R.SENSITIVE_PATH_WORDS))


def contributors(commits: DataFrame, commit_files: DataFrame) -> DataFrame:
    """Per e-mail: commits, lines and first/last commit."""
    totals = commit_totals(commit_files).select("hash", "lines_added", "lines_removed")
    return commits.join(totals, "hash", "left").groupBy("email").agg(
        F.max("author").alias("name"), F.count("*").alias("commits"),
        F.coalesce(F.sum("lines_added"), F.lit(0)).alias("lines_added"),
        F.coalesce(F.sum("lines_removed"), F.lit(0)).alias("lines_removed"),
        F.min("ts").alias("first_commit"), F.max("ts").alias("last_commit"))


def high_impact(people: DataFrame, commits: int = 5, lines: int = 5000) -> DataFrame:
    return people.where((F.col("commits") < commits) & (F.col("lines_added") > lines))


def is_suspicious_email(email: Column) -> Column:
    return any_contains(F.lower(email), R.THROWAWAY_DOMAINS + R.ROLE_ADDRESSES)


def suspicious_email(people: DataFrame) -> DataFrame:
    return people.where(is_suspicious_email(F.col("email")))


def file_churn(commit_files: DataFrame, often: int = 100, binary_often: int = 10) -> DataFrame:
    """Modification counts per path with the churn class (both may apply)."""
    p = F.lower("path")
    binary = p.endswith(R.HISTORY_BINARY_SUFFIXES[0])
    for suffix in R.HISTORY_BINARY_SUFFIXES[1:]:
        binary = binary | p.endswith(suffix)
    counts = commit_files.groupBy("path").agg(
        F.count("*").alias("modifications"), F.max("ts").alias("last_modified"))
    classes = F.array_compact(F.array(
        F.when(F.col("modifications") > often, F.lit("low")),
        F.when(binary & (F.col("modifications") > binary_often), F.lit("medium"))))
    return counts.withColumn("severity", F.explode(classes))


def repository_profile(commits: DataFrame, files: DataFrame, as_of: Column, refs: DataFrame | None = None) -> DataFrame:
    """Independent per-repo aggregates joined on repo.

    refs(repo, kind, name, ts, is_head): branches and tags; they add the current branch, the number of tags and the latest one.
    """
    c = commits.groupBy("repo").agg(
        F.count("*").alias("commit_count"), F.count_distinct("email").alias("contributors"),
        F.max("ts").alias("last_commit"), F.max_by("hash", F.struct("ts", "hash")).alias("head_commit"), F.datediff(as_of, F.min("ts")).alias("age_days"))
    f = files.groupBy(F.col("job_id").alias("repo")).agg(
        F.count("*").alias("file_count"), F.sum("size_bytes").alias("size_bytes"),
        F.array_sort(F.collect_set("language")).alias("languages"))
    out = c.join(f, "repo", "full_outer")
    if refs is None:
        return out
    tag, place = F.col("kind") == "tag", F.struct("ts", "name")
    named = refs.groupBy("repo").agg(
        F.max(F.when((F.col("kind") == "branch") & F.col("is_head"), F.col("name"))).alias("branch"), F.count_if(tag).alias("tags"),
        F.max_by(F.when(tag, F.col("name")), F.when(tag, place)).alias("latest_tag"))
    return out.join(named, "repo", "left").withColumn("tags", F.coalesce("tags", F.lit(0)))


def suspicious_commits(
    commits: DataFrame, commit_files: DataFrame, rules: Sequence[Rule] = R.MESSAGE_RULES, files: int = 100,
    lines: int = 10_000,
) -> DataFrame:
    """Commits with at least one risk indicator."""
    totals = commit_totals(commit_files)
    hit = F.lit(False)
    for r in rules:
        hit = hit | F.col("message").rlike(r.pattern)
    large = (F.col("files_changed") > files) | (F.col("lines_added") > lines)
    indicators = F.array_compact(F.array(
        F.when(is_off_hours(F.col("ts")), F.lit("unusual_time")),
        F.when(large, F.lit("large_changes")),
        F.when(hit, F.lit("suspicious_message")),
        F.when(is_suspicious_email(F.col("email")), F.lit("suspicious_email"))))
    return (
        commits.join(totals, "hash", "left").withColumn("risk_indicators", indicators)
        .where(F.size("risk_indicators") > 0)
        .select("repo", "hash", "author", "email", "ts", "message", "risk_indicators")
    )


def commit_timeline(commits: DataFrame, slice_seconds: int | None = None) -> DataFrame:
    """Author-to-committer delay and the gap since the author's previous commit, in seconds."""
    rows = previous_row(commits, ["author"], ["ts", "hash"], ["ts"], segment_of(commits, ["author"], "ts", slice_seconds))
    return rows.withColumn(
        "commit_delay", F.timestamp_diff("SECOND", F.col("ts"), F.col("committed_at"))
    ).withColumn("gap", F.timestamp_diff("SECOND", F.col("prev_ts"), F.col("ts"))).drop("prev_ts")


def commit_graph(commits: DataFrame) -> DataFrame:
    """Root / linear / merge by parent count and the number of parents that do not exist."""
    edges = commits.select("hash", F.explode("parents").alias("parent"))
    wanted = edges.groupBy("parent").agg(F.count("*").alias("children"))
    missing = wanted.join(commits.select(F.col("hash").alias("parent")), "parent", "left_anti")
    broken = join_counted(edges, missing, "parent", "children", salt=["hash"]).groupBy("hash").agg(
        F.count("*").alias("missing_parents"))
    n = F.size("parents")
    return commits.join(broken, "hash", "left").select(
        "hash", n.alias("parent_count"),
        F.when(n == 0, "root").when(n == 1, "linear").otherwise("merge").alias("kind"),
        F.coalesce("missing_parents", F.lit(0)).alias("missing_parents"))
