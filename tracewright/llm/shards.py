"""Sharding by sampled splitters, in DataFrame functions only.

Documents are ordered by doc_id. A sample that takes each row with a chance proportional to its size gives
quantile boundaries; rows are dealt to the ranges between them, and ranges that came out overfull are divided
again at their own quantiles. Running sizes inside the ranges and totals of the ranges before give each row
its place on the line of all bytes, which is cut into equal shards. Results do not depend on the sample; it
only balances the work. The sample and the ranges are bounded by ``ranges``.

Cases: a null text counts no bytes and has the checksum of none; null ids come first; equal rows are dealt
like any others, side by side; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.session import cut_lineage

ROW_BYTES = 8
RANGES_PER_SHARD = 16
ROWS_PER_RANGE = 500_000
MOST_RANGES = 8192
SAMPLE_PER_RANGE = 32


def _range_of(key: Column, bounds: list[int]) -> Column:
    """Number of bounds at or below the key, by binary search in a literal array."""
    if not bounds:
        return F.lit(0)
    steps, step = [], 1 << (len(bounds).bit_length() - 1)
    while step:
        steps.append(step)
        step //= 2
    table = F.array(*[F.lit(int(b)) for b in bounds])
    found = F.aggregate(
        F.array(*map(F.lit, steps)), F.lit(0),
        lambda at, s: F.when((at + s <= len(bounds)) & (F.get(table, at + s - 1) <= key), at + s).otherwise(at))
    return F.coalesce(found, F.lit(0))


def _splitters(rows: DataFrame, total: int, ranges: int) -> list[int]:
    """Quantile boundaries of a size-weighted sample of keys."""
    rate = ranges * SAMPLE_PER_RANGE / max(total, 1)
    luck = F.expr("(xxhash64(doc_id, text_crc32, 'sample') & 9007199254740991) / 9007199254740992D")
    sample = rows.where("doc_id IS NOT NULL").where(luck < F.col("size") * rate).select("doc_id", F.greatest(F.lit(1.0), F.col("size") * rate).alias("weight"))
    spot = F.sum("weight").over(Window.orderBy("doc_id", "weight")) / F.sum("weight").over(Window.partitionBy())
    parts = sample.withColumn("part", F.floor(spot * ranges)).groupBy("part").agg(F.min("doc_id").alias("bound"))
    return sorted({r["bound"] for r in parts.where(f"part BETWEEN 1 AND {ranges - 1}").collect()})


def shard(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard; shards hold near equal bytes."""
    text = F.coalesce("text", F.lit(""))
    rows = cut_lineage(docs.select(
        "doc_id", (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")))
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count(F.lit(1))).first()
    ranges = min(MOST_RANGES, max(shards * RANGES_PER_SHARD, count // ROWS_PER_RANGE))
    dealt = rows.withColumn("part", _range_of(F.col("doc_id"), _splitters(rows, total, ranges)))
    full = 2 * total / ranges
    overfull = (
        dealt.groupBy("part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).where((F.col("bytes") > full) & (F.col("n") > 1))
        .select("part", F.least(F.ceil(F.col("bytes") / (full / 2)), F.lit(1000)).alias("pieces")))
    cuts = dealt.join(F.broadcast(overfull), "part").groupBy("part", "pieces").agg(
        F.percentile_approx("doc_id", F.array(*[F.lit(i / 64) for i in range(1, 64)]), 1000).alias("cuts")).select("part", F.array_distinct("cuts").alias("cuts"))
    dealt = dealt.join(F.broadcast(cuts), "part", "left").withColumn("piece", F.expr("coalesce(size(filter(cuts, c -> c <= doc_id)), 0)")).drop("cuts")
    inside = Window.partitionBy("part", "piece").orderBy("doc_id", "text_crc32", "size")
    placed = dealt.withColumns({
        "bytes_in": F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"), "rows_in": F.row_number().over(inside) - 1})
    line = Window.orderBy("part", "piece").rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.groupBy("part", "piece").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).select(
        "part", "piece", F.coalesce(F.sum("bytes").over(line), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("n").over(line), F.lit(0)).alias("rows_before"))
    spot = F.col("bytes_before") + F.col("bytes_in")
    placed = placed.join(F.broadcast(before), ["part", "piece"]).select(
        "doc_id", "size", "text_crc32", (F.col("rows_before") + F.col("rows_in")).alias("row"),
        F.least(F.lit(shards - 1), F.floor((2 * spot + F.col("size")) * shards / F.lit(2 * max(total, 1)))).cast("int").alias("shard"))
    first = placed.groupBy("shard").agg(F.min("row").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("row") - F.col("first")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"))
