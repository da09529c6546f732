"""Joins back to a counted key that stay balanced under heavy keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAVY_SHARES = 1000


def join_counted(
    detail: DataFrame, groups: DataFrame, key: str, count: str, shares: int = HEAVY_SHARES, *, salt: Sequence[str]
) -> DataFrame:
    """Inner join of detail rows to one row per key, where ``groups[count]`` says how many rows a key has.

    A key holding at least 1/shares of the counted rows is heavy. There can be at most
    ``shares`` such keys, so that side is broadcast with a proven bound; the rest is a
    shuffle join in which no key exceeds 1/shares of the rows. The detail side is read once;
    its heavy rows are salted by ``salt``, narrow columns that tell rows apart, over the partitions
    of that shuffle.
    """
    total = groups.agg(F.sum(count)).scalar()
    cols = [c for c in groups.columns if c != key]
    packed = groups.select(key, F.struct(*cols).alias("_v"), (F.col(count) * shares >= total).alias("_is_heavy"))
    heavy = packed.where("_is_heavy").select(key, F.col("_v").alias("_heavy"))
    none = F.pmod(F.col(f"_v.{count}"), F.lit(1)).cast("int")  # 0, but no literal: that would leave the join's keys, and with it the salt
    light = packed.where("not _is_heavy").select(key, none.alias("_salt"), F.col("_v").alias("_light"))
    spread_heavy = 1 + F.pmod(F.xxhash64(*salt), F.lit(shares)).cast("int")
    return (
        detail.join(F.broadcast(heavy), key, "left")
        .withColumn("_salt", F.when(F.col("_heavy").isNotNull(), spread_heavy).otherwise(0))
        .join(light, [key, "_salt"], "left")
        .withColumn("_v", F.coalesce("_heavy", "_light")).where(F.col("_v").isNotNull())
        .select(*detail.columns, *[F.col("_v")[c].alias(c) for c in cols])
    )


#: A cell of a grid has so many pairs and rows at least; smaller keys are not cut.
CELL_PAIRS = 1 << 20
CELL_ROWS = 1 << 16
ROW_SHARES = 100


def grid_cells(
    left: DataFrame, right: DataFrame, key: str, shares: int = HEAVY_SHARES, cell_pairs: int = CELL_PAIRS, cell_rows: int = CELL_ROWS
) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``_i`` and ``_j``, so that rows of equal key meet in exactly one cell (key, _i, _j).

    A key of a rows on the left and b on the right makes a * b pairs. A key with 1/shares of all pairs, or
    1/ROW_SHARES of a side's rows, is heavy: there are at most shares + 2 * ROW_SHARES of these, a table that is
    broadcast. Its pairs are a grid: left rows are dealt to stripes and copied along the other axis, right rows the other way
    round, with stripes of the number that copies least. Rows are dealt by a hash of all their columns, so a task that
    runs again deals alike; rows equal in all columns share a stripe. Heavy keys that one side lacks leave
    before the shuffle; null keys too.
    """
    left, right = left.where(F.col(key).isNotNull()), right.where(F.col(key).isNotNull())
    counts = left.groupBy(key).agg(F.count("*").alias("_a")).join(right.groupBy(key).agg(F.count("*").alias("_b")), key, "full").select(
        key, F.coalesce("_a", F.lit(0)).cast("double").alias("_a"), F.coalesce("_b", F.lit(0)).cast("double").alias("_b"))

    def total(value):
        return counts.agg(F.coalesce(F.sum(value), F.lit(0.0))).scalar()

    a, b = F.col("_a"), F.col("_b")
    sized = counts.select(
        key, "_a", "_b", F.ceil(a * b / F.greatest(F.lit(float(cell_pairs)), total(a * b) / shares)).alias("_cells"),
        F.ceil(a / F.greatest(F.lit(float(cell_rows)), total(a) / ROW_SHARES)).alias("_tall"),
        F.ceil(b / F.greatest(F.lit(float(cell_rows)), total(b) / ROW_SHARES)).alias("_wide"))
    heavy = sized.where("_cells > 1 OR _tall > 1 OR _wide > 1").select(
        key, (a * b > 0).alias("_meets"),
        F.greatest("_tall", F.least(a, F.ceil(F.sqrt(F.col("_cells") * F.try_divide(a, b))))).cast("int").alias("_rows"),
        F.greatest("_wide", F.least(b, F.ceil(F.sqrt(F.col("_cells") * F.try_divide(b, a))))).cast("int").alias("_cols"))

    def cut(side: DataFrame, own: str, dealt: str, copied: str, along: str) -> DataFrame:
        part = F.coalesce(F.pmod(F.xxhash64(*side.columns), F.col(own)).cast("int"), F.lit(0))
        other = F.explode(F.sequence(F.lit(0), F.coalesce(F.col(along) - 1, F.lit(0))))
        return side.join(F.broadcast(heavy), key, "left").where(F.coalesce("_meets", F.lit(True))).select(
            *side.columns, part.alias(dealt), other.alias(copied))

    return cut(left, "_rows", "_i", "_j", "_cols"), cut(right, "_cols", "_j", "_i", "_rows")


def grid_join(
    left: DataFrame, right: DataFrame, key: str, shares: int = HEAVY_SHARES, cell_pairs: int = CELL_PAIRS, cell_rows: int = CELL_ROWS
) -> DataFrame:
    """Inner join on one key that may be heavy on both sides; see ``grid_cells``."""
    one, two = grid_cells(left, right, key, shares, cell_pairs, cell_rows)
    return one.join(two, [key, "_i", "_j"]).drop("_i", "_j")


#: Bits of the bitmap by which rare keys are told from repeated ones: 32 MB at most, whatever the data.
BITMAP_BITS = 1 << 28


def bits_for(keys: int) -> int:
    """Bits by which one other key in sixteen or less is taken for one of so many, up to the largest bitmap."""
    return min(BITMAP_BITS, 1 << max(20, (16 * keys - 1).bit_length()))


def maybe_in(rows: DataFrame, hashed: str, wanted: DataFrame, key: str, bits: int = BITMAP_BITS) -> DataFrame:
    """Rows whose 64-bit ``hashed`` value may be among ``wanted[key]``; all others leave without a shuffle.

    The wanted values set bits of a bitmap of fixed size, which is broadcast in pages of 32,768 bits. A row stays if
    its bit is set, so some others stay too and the caller joins or counts what is left.
    """
    spot = wanted.select(F.pmod(F.col(key), F.lit(bits)).alias("_spot"))
    pages = spot.groupBy(F.bitmap_bucket_number("_spot").alias("_page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_spot")).alias("_bits"))
    bit = F.bitmap_bit_position("_spot")
    byte = F.conv(F.hex(F.substring("_bits", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    kept = rows.withColumn("_spot", F.pmod(F.col(hashed), F.lit(bits))).withColumn("_page", F.bitmap_bucket_number("_spot")).join(F.broadcast(pages), "_page")
    return kept.where(F.getbit(byte, (bit % 8).cast("int")) == 1).select(*rows.columns)


def maybe_repeated(rows: DataFrame, hashed: str, more_than: int, bits: int = BITMAP_BITS) -> DataFrame:
    """Rows whose 64-bit ``hashed`` value may occur more than ``more_than`` times: counts of hashes are added up, the rest is ``maybe_in``."""
    repeated = rows.groupBy(hashed).agg(F.count("*").alias("_n")).where(F.col("_n") > more_than)
    return maybe_in(rows, hashed, repeated, hashed, bits)
