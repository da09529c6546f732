"""Line deduplication by a deletion-neighbourhood join, in DataFrame functions only.

A line is removed when an equal line, or one within a single edit (a code point replaced, inserted or
deleted), stands earlier: smaller doc_id, or earlier in the same document. Lines are judged on the input.

Lines are equal if their 128-bit hashes are. Of two lines within an edit both share the first or the last half,
so only lines with a half or a copy elsewhere go on; that loses nothing. Those with a shared half emit all their one-deletion variants, and
themselves, as hashed keys. Lines that lose the same position to the same variant differ by a replacement,
and a line equal to a variant differs by an insertion; the edit distance of each such pair is verified. A
variant is hashed as text before its block, block without the code point, text after, so a long line costs
its length times a block. Lines under one variant are bounded by a block's positions times the characters in
use, and copies of a line are one row before any of this.

Cases: null texts have no lines and stay null; blank lines (blanks and control blanks only) always stay;
lines under ``min_chars`` code points are compared for equality only; rows with equal doc_id and text are one
document; other columns travel in ``rest``; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.session import cut_lineage

MIN_CHARS = 16
BLOCK = 256
#: Keys, or line numbers, sent to all tasks at most; beyond, they are joined by a shuffle.
BROADCAST_KEYS = 4 << 20
_PLACE = ["doc_id", "key", "line_no"]


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """Place, hash and text of every nonblank line, once for each key it may share with an equal or near line.

    With q the shorter length of a pair, common prefix and suffix make up q - 1 code points at least, so one
    of them has (q - 1) / 2. A line of n meets lines of n or more under q = n and shorter ones under n - 1.
    """
    halves = ", ".join(
        f"struct(xxhash64('{side}', n - {less}, {side}(line, (n - {less} - 1) div 2)) AS k, xxhash64(line) AS member, true AS half)" for less in (0, 1) for side in ("left", "right"))
    whole = "struct(xxhash64('whole', line) AS k, xxhash64(key, line_no) AS member, false AS half)"
    return (
        docs.select("doc_id", "key", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
        .where(F.col("line").rlike(r"[^\x09-\x0D\x20]"))
        .withColumn("n", F.char_length("line"))
        .select(*_PLACE, "line", F.expr(f"inline(CASE WHEN n >= {min_chars} THEN array({whole}, {halves}) ELSE array({whole}) END)"))
    )


def _sized(df: DataFrame, rows: int) -> DataFrame:
    """Marked for broadcast if it has at most so many rows; otherwise joined by a shuffle."""
    return F.broadcast(df) if df.count() <= rows else df


def _variants(lines: DataFrame) -> DataFrame:
    """(n, block, variant, at, id): deletions of a line of n, and lines themselves at -1 as variants of n + 1."""
    cut = f"struct(b AS block, xxhash64(left(line, b * {BLOCK})) AS before, xxhash64(substring(line, (b + 1) * {BLOCK} + 1)) AS after, substring(line, b * {BLOCK} + 1, {BLOCK}) AS piece)"
    gone = (
        lines.selectExpr("id", "char_length(line) AS n", f"explode(transform(sequence(0, (char_length(line) - 1) div {BLOCK}), b -> {cut})) AS c")
        .selectExpr("id", "n", "c.block AS block", "posexplode(transform(sequence(0, char_length(c.piece) - 1), i -> xxhash64(c.before, concat(left(c.piece, i), substring(c.piece, i + 2)), c.after))) AS (at, variant)")
    )
    own = f"xxhash64(xxhash64(left(line, b * {BLOCK})), substring(line, b * {BLOCK} + 1, least({BLOCK}, char_length(line) + 1 - b * {BLOCK}) - 1), xxhash64(substring(line, (b + 1) * {BLOCK})))"
    whole = lines.selectExpr("id", "char_length(line) + 1 AS n", f"posexplode(transform(sequence(0, char_length(line) div {BLOCK}), b -> {own})) AS (block, variant)")
    return gone.select("n", "block", "variant", "at", "id").union(whole.select("n", "block", "variant", F.lit(-1).alias("at"), "id"))


def _near(lines: DataFrame) -> DataFrame:
    """Hashes of the lines (id, line) that have an earlier one within one edit."""
    rows = _variants(lines)
    same = ["n", "block", "variant"]
    met = rows.groupBy(*same).agg(F.min("id.h").alias("low"), F.max("id.h").alias("high")).where("low < high").select(*same)
    groups = rows.join(met, same).groupBy(*same).agg(F.array_sort(F.collect_list(F.struct("id", "at"))).alias("members"))
    earlier = "filter(members, e -> e.id.first < m.id.first AND (e.at = m.at OR e.at = -1 OR m.at = -1))"
    pairs = groups.select(F.expr(f"inline(transform(members, m -> struct(m.id AS late, get({earlier}.id, 0) AS early)))"))
    pairs = pairs.where("early IS NOT NULL").distinct()
    return (
        pairs.join(lines.toDF("early", "a"), "early").join(lines.toDF("late", "b"), "late")
        .where("levenshtein(a, b, 1) BETWEEN 0 AND 1").select("late.h", "late.g").distinct()
    )


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, text without removed lines, n_lines, n_removed, and the other columns as ``rest``."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rest = F.struct(*others) if others else F.struct(F.lit(None).cast("string").alias("none"))
    docs = docs.select("doc_id", "text", rest.alias("rest"), F.xxhash64("doc_id", "text").alias("key"))
    keyed = _lines(docs, min_chars)
    shared = cut_lineage(keyed.groupBy("k").agg(F.min("member").alias("low"), F.max("member").alias("high")).where("low < high").select("k"))
    active = cut_lineage(
        keyed.join(_sized(shared, BROADCAST_KEYS), "k")
        .groupBy(*_PLACE, F.xxhash64("line").alias("h"), F.xxhash64(F.lit(7), "line").alias("g"))
        .agg(F.max("half").alias("half"), F.first(F.when(F.col("half"), F.col("line")), ignorenulls=True).alias("line")))
    firsts = cut_lineage(active.groupBy("h", "g").agg(F.min(F.struct(*_PLACE)).alias("first"), F.max("half").alias("half"), F.max("line").alias("line")))
    near = _near(firsts.where("half").select(F.struct("first", "h", "g").alias("id"), "line")).withColumn("near", F.lit(True))
    verdicts = firsts.join(near, ["h", "g"], "left").select("h", "g", F.expr("CASE WHEN near THEN NULL ELSE first END").alias("spared"))
    removed = cut_lineage(
        active.select(*_PLACE, "h", "g").join(verdicts, ["h", "g"])
        .where(F.col("spared").isNull() | (F.struct(*_PLACE) != F.col("spared")))
        .groupBy("key").agg(F.collect_set("line_no").alias("removed")))
    small = removed.agg(F.coalesce(F.sum(F.size("removed") + 4), F.lit(0))).first()[0] <= BROADCAST_KEYS
    removed = F.broadcast(removed) if small else removed
    parts, kept = "split(text, '\n')", "array_except(sequence(0, size(parts) - 1), removed)"
    return (
        docs.join(removed, "key", "left").withColumn("parts", F.expr(parts))
        .select(
            "doc_id",
            F.expr(f"CASE WHEN removed IS NULL THEN text ELSE array_join(transform({kept}, i -> parts[i]), '\n') END").alias("text"),
            F.expr("coalesce(size(parts), 0)").cast("long").alias("n_lines"), F.expr("coalesce(size(removed), 0)").cast("long").alias("n_removed"), "rest",
        )
    )
