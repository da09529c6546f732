"""Ordered window functions that stay parallel when one key holds most of the rows.

A plain ``lag() over (partition by key)`` sends a hot key to one task. Here rows are
windowed inside (key, segment), where ``segment`` is a deterministic, order-preserving
slice of the ordering column (an hour, an index range), and only one small summary row
per (key, segment) is carried across segments.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def time_segment(ts: Column, seconds: int = 3600) -> Column:
    """Whole time slices since the epoch; monotone in ``ts``."""
    return F.floor(F.unix_timestamp(ts.cast("timestamp")) / seconds)


SEGMENT_ROWS = 1_000_000
ONE_SEGMENT = 1_000_000_000


def auto_segment(df: DataFrame, keys: Sequence[str], ts: str, rows: int = SEGMENT_ROWS) -> Column:
    """Time slices short enough that the busiest key has about ``rows`` rows in each.

    The slice length is a scalar subquery over partially aggregated per-key counts, so nothing is
    run or collected on the driver; without busy keys everything is one slice.
    """
    epoch = F.unix_timestamp(F.col(ts).cast("timestamp"))
    per_key = df.groupBy(*keys).agg(F.count("*").alias("_n"), (F.max(epoch) - F.min(epoch)).alias("_span"))
    length = F.greatest(F.lit(1), F.floor(F.col("_span") * rows / F.col("_n")))
    slice_length = per_key.agg(F.coalesce(F.min(F.when(F.col("_n") > rows, length)), F.lit(ONE_SEGMENT))).scalar()
    return F.floor(epoch / slice_length)


def segment_of(df: DataFrame, keys: Sequence[str], ts: str, seconds: int | None) -> Column:
    """Slices of a given length, or chosen from the data."""
    return auto_segment(df, keys, ts) if seconds is None else time_segment(F.col(ts), seconds)


def index_segment(index: Column, rows: int = 100_000) -> Column:
    return F.floor(index / rows)


def _carry(df: DataFrame, keys: Sequence[str], summary: list[Column], carried: list[Column]) -> DataFrame:
    """Per (key, segment) summary plus the values carried in from earlier segments."""
    return df.groupBy(*keys, "_seg").agg(*summary).select(*keys, "_seg", *carried)


def previous_row(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str], segment: Column, prefix: str = "prev_"
) -> DataFrame:
    """Add ``prev_<col>``: the values of the preceding row of the same key."""
    inside = Window.partitionBy(*keys, "_seg").orderBy(*order)
    across = Window.partitionBy(*keys).orderBy("_seg")
    seg = df.withColumn("_seg", segment)
    tails = _carry(
        seg, keys,
        [F.max_by(F.struct(*cols), F.struct(*order)).alias("_tail")],
        [F.lag("_tail").over(across).alias("_carry")],
    )
    rows = seg.withColumn("_rn", F.row_number().over(inside)).withColumn("_lag", F.lag(F.struct(*cols)).over(inside))
    before = F.when(F.col("_rn") == 1, F.col("_carry")).otherwise(F.col("_lag"))
    joined = rows.join(tails, [*keys, "_seg"], "left").withColumn("_before", before)
    for c in cols:
        joined = joined.withColumn(prefix + c, F.col("_before")[c])
    return joined.drop("_seg", "_rn", "_lag", "_carry", "_before")


def running_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, segment: Column, name: str
) -> DataFrame:
    """Add the running total of ``value`` per key, current row included."""
    inside = Window.partitionBy(*keys, "_seg").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    across = Window.partitionBy(*keys).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    seg = df.withColumn("_seg", segment).withColumn("_value", value.cast("long"))
    totals = _carry(
        seg, keys, [F.sum("_value").alias("_t")], [F.coalesce(F.sum("_t").over(across), F.lit(0)).alias("_base")]
    )
    return (
        seg.withColumn("_inside", F.sum("_value").over(inside))
        .join(totals, [*keys, "_seg"], "left")
        .withColumn(name, F.col("_inside") + F.col("_base"))
        .drop("_seg", "_value", "_inside", "_base")
    )


def row_index(df: DataFrame, keys: Sequence[str], order: Sequence[str], segment: Column, name: str) -> DataFrame:
    """Add the 1-based position of each row within its key."""
    return running_sum(df, keys, order, F.lit(1), segment, name)


def run_ids(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], cols: Sequence[str],
    starts: Callable[[Column, Column], Column], segment: Column, name: str,
) -> DataFrame:
    """Number the runs of each key: ``starts(before, now)`` says whether a row begins a new one.

    ``before`` and ``now`` are structs of ``cols``. Wide rows are shuffled once; the per-segment
    summary reads only the key, order and ``cols`` columns.
    """
    inside = Window.partitionBy(*keys, "_seg").orderBy(*order)
    across = Window.partitionBy(*keys).orderBy("_seg")

    def flagged(rows: DataFrame) -> DataFrame:
        now = F.struct(*cols)
        begins = F.coalesce(starts(F.lag(now).over(inside), now), F.lit(False))
        return rows.withColumn("_begins", begins.cast("long"))

    seg = df.withColumn("_seg", segment)
    slim = list(dict.fromkeys([*keys, *order, *cols]))
    summary = flagged(seg.select(*slim, "_seg")).groupBy(*keys, "_seg").agg(
        F.sum("_begins").alias("_n"), F.min_by(F.struct(*cols), F.struct(*order)).alias("_head"),
        F.max_by(F.struct(*cols), F.struct(*order)).alias("_tail"))
    edge = F.coalesce(starts(F.lag("_tail").over(across), F.col("_head")), F.lit(False)).cast("long")
    upto = across.rowsBetween(Window.unboundedPreceding, 0)
    base = summary.withColumn("_edge", edge).select(
        *keys, "_seg", (F.sum("_edge").over(upto) + F.sum("_n").over(upto) - F.col("_n")).alias("_base"))
    rows = flagged(seg).withColumn(
        "_inside", F.sum("_begins").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.join(base, [*keys, "_seg"], "left").withColumn(
        name, F.col("_inside") + F.col("_base")).drop("_seg", "_begins", "_inside", "_base")


def last_known(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: Column, segment: Column, name: str
) -> DataFrame:
    """Forward fill: the latest non-null ``value`` at or before each row."""
    inside = Window.partitionBy(*keys, "_seg").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    across = Window.partitionBy(*keys).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    seg = df.withColumn("_seg", segment).withColumn("_v", value)
    known = F.when(F.col("_v").isNotNull(), F.struct(*order))
    tails = _carry(
        seg, keys,
        [F.max_by("_v", known).alias("_tail")],
        [F.last("_tail", ignorenulls=True).over(across).alias("_carry")],
    )
    return (
        seg.withColumn("_in", F.last("_v", ignorenulls=True).over(inside))
        .join(tails, [*keys, "_seg"], "left")
        .withColumn(name, F.coalesce("_in", "_carry"))
        .drop("_seg", "_v", "_in", "_carry")
    )
