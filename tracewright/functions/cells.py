"""Vectors dealt to cells around pivots, for exact joins by distance.

All vectors are of unit length and compared in the chord metric, where cosine s is distance sqrt(2 - 2 s). A
vector lives in the cell of its nearest pivot. For a radius r around a vector q only those cells can hold a
match whose ring of pivot distances meets q's pivot distance within r, and whose side of the plane between
the two pivots q comes within r of. Neighbouring cells are packed until they hold a block of rows, and larger
packs are cut into blocks, so a vector is copied once a block, not once a cell, and a dense cell is many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: At most so many pivots; they and the ring of each cell are all that the driver holds.
MAX_PIVOTS = 1024
#: Rows of one Arrow batch of copies.
BATCH_ROWS = 16_384
#: Blocks grow up to so many rows (32 MB at 64 components) while a table still has so many of them.
MOST_ROWS, LEAST_BLOCKS = 65_536, 24
#: A search copies both of its sides, so its tables are cut into about so many blocks from small ones on: copies grow with the rows.
SEARCH_BLOCKS = 8
#: Distances are roots of rounded differences; bounds give way by more than that.
SLACK = 1e-7


def matrix(column: pa.Array) -> np.ndarray:
    """A column of vectors of one length as rows."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def chord(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * a @ b.T, 0))


def pivots_of(rows: DataFrame, count: int) -> np.ndarray:
    """About the square root of ``count`` vectors ``_u``, in hash order."""
    wanted = min(MAX_PIVOTS, max(1, math.isqrt(count)))
    return np.array([r["_u"] for r in rows.orderBy(F.xxhash64("id"), "id").select("_u").limit(wanted).collect()], dtype=np.float64)


def block_size(block_rows: int, count: int, blocks: int = LEAST_BLOCKS) -> int:
    """Rows of a block in a table of ``count`` rows: every row of the other table is copied to each block, so few large ones."""
    return max(block_rows, min(MOST_ROWS, count // blocks))


def blocks_of(count: int, block_rows: int) -> int:
    """Blocks of a pack: packs end with the cell that fills a block, so they hold a little more than one, which is no second block."""
    return max(1, count // block_rows)


def deal(rows: DataFrame, pivots: np.ndarray, choose: Callable[[np.ndarray, pa.RecordBatch], np.ndarray]) -> DataFrame:
    """Rows with ``_far`` from their nearest pivot and ``_place``, once for each place that ``choose(distances, batch)`` marks for them."""
    names = rows.columns
    at = names.index("_u")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            d = chord(matrix(batch.column(at)), pivots)
            row, place = np.nonzero(choose(d, batch))
            far = d.min(1)
            for low in range(0, len(row), BATCH_ROWS):
                r, c = row[low:low + BATCH_ROWS], place[low:low + BATCH_ROWS]
                yield pa.RecordBatch.from_arrays(
                    [*(column.take(pa.array(r)) for column in batch.columns), pa.array(far[r]), pa.array(c, pa.int32())], names=[*names, "_far", "_place"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("_far", T.DoubleType()), T.StructField("_place", T.IntegerType())]))


def at_home(d: np.ndarray, batch: pa.RecordBatch | None = None) -> np.ndarray:
    """The cell of the nearest pivot."""
    out = np.zeros(d.shape, bool)
    out[np.arange(len(d)), d.argmin(1)] = True
    return out


def chain(between: np.ndarray) -> list[int]:
    """All cells, from each to the nearest one that is left."""
    left, order = set(range(1, len(between))), [0]
    while left:
        rest = np.fromiter(left, np.int64)
        order.append(int(rest[between[order[-1]][rest].argmin()]))
        left.discard(order[-1])
    return order


class Rings:
    """Members and least and greatest pivot distance of every cell, and the packs of neighbouring cells; empty cells have none.

    ``members`` are dealt to their cells. Tasks get this object, so it holds arrays only.
    """

    def __init__(self, members: DataFrame, pivots: np.ndarray, block_rows: int = 1):
        m = len(pivots)
        self.count, self.low, self.high = np.zeros(m, np.int64), np.full(m, 9.0), np.full(m, -9.0)
        for r in members.groupBy("_place").agg(F.count("*").alias("n"), F.min("_far").alias("low"), F.max("_far").alias("high")).collect():
            self.count[r["_place"]], self.low[r["_place"]], self.high[r["_place"]] = r["n"], r["low"], r["high"]
        self.between = chord(pivots, pivots)
        self.pack = np.zeros(m, np.int64)
        self.order = chain(self.between)
        held, number = 0, 0
        for cell in self.order:
            self.pack[cell] = number
            held += self.count[cell]
            if held >= block_rows:
                held, number = 0, number + 1
        self.in_pack = self.pack[:, None] == np.arange(self.pack.max() + 1)[None, :]
        self.pack_count = self.count @ self.in_pack

    def packed(self, members: DataFrame) -> DataFrame:
        """Members with their pack as ``_place``."""
        return members.withColumn("_place", F.get(F.array(*[F.lit(int(p)) for p in self.pack]), F.col("_place")))

    def packs(self, marked: np.ndarray) -> np.ndarray:
        """Packs that have a marked cell with members."""
        return (marked & (self.count > 0)).astype(np.float32) @ self.in_pack.astype(np.float32) > 0

    def holding(self, d: np.ndarray, k: int) -> np.ndarray:
        """A distance within which every row, given by its pivot distances, has k members: whole cells, the closest first."""
        order = np.argsort(d + self.high, axis=1)
        enough = np.cumsum(self.count[order], axis=1) >= k
        reach = np.take_along_axis(d + self.high, order, axis=1)
        return np.where(enough.any(1), reach[np.arange(len(d)), enough.argmax(1)], 9.0)

    def within(self, d: np.ndarray, reach: np.ndarray) -> np.ndarray:
        """Cells that may hold a member within ``reach`` of each row."""
        reach = reach[:, None] + SLACK
        home = d.argmin(1)
        near = d[np.arange(len(d)), home][:, None]
        return (
            (self.count > 0) & (d - reach <= self.high) & (d + reach >= self.low)
            & (d * d - near * near <= 2 * reach * self.between[home] + SLACK))


class Line:
    """Cells in a line from neighbour to neighbour, and how many rows live in each. Tasks get this object, so it holds arrays only.

    What cells a row may reach is told by pivots alone: a row between two of them may have its home in either.
    """

    def __init__(self, homes: DataFrame, pivots: np.ndarray):
        self.pivots, self.between = pivots, chord(pivots, pivots)
        self.order, count = np.array(chain(self.between)), np.zeros(len(pivots), np.int64)
        for r in homes.groupBy("_place").count().collect():
            count[r["_place"]] = r["count"]
        self.place = np.argsort(self.order)
        before = np.cumsum(count[self.order]) - count[self.order]
        self.before, self.total = before[self.place], max(1, int(count.sum()))

    def share(self, packs: int) -> np.ndarray:
        """The pack of every cell where the line is cut into ``packs`` of about equal rows."""
        return np.minimum(self.before * int(packs) // self.total, packs - 1)

    def reached(self, d: np.ndarray, home: np.ndarray, near: np.ndarray, reach: float, some=slice(None)) -> np.ndarray:
        """Which of ``some`` cells, at distances ``d``, may hold a vector within ``reach`` of rows whose home is at ``near``.

        Such a vector is at most ``near`` and the reach from the row's home, and no farther from its own pivot, which is one reach
        more from the row at most; and the row is within the reach of the plane between the two pivots.
        """
        near, wide = near[:, None], reach + SLACK
        return (d <= near + 2 * wide) & (d * d - near * near <= 2 * wide * self.between[home][:, some] + SLACK)


def block_pairs(guests: DataFrame, members: DataFrame, rings: Rings, block_rows: int, kernel, schema: T.StructType) -> DataFrame:
    """kernel(guests, members) over every block of guests and block of members of a pack.

    Members move to as many tasks as their pack has blocks of guests; both block counts follow from counts by
    pack, tables bounded by the pivots.
    """
    spark = guests.sparkSession
    packs = spark.createDataFrame([(p, blocks_of(n, block_rows)) for p, n in enumerate(rings.pack_count.tolist())], "_place int, _inside int")
    asked = guests.groupBy("_place").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("_outside"))
    sizes = F.broadcast(packs.join(F.broadcast(asked), "_place"))

    def part(ident: Column, count: str) -> Column:
        return F.pmod(F.xxhash64(ident), F.col(count)).cast("int")

    left = guests.join(sizes, "_place").select(
        "_place", F.explode(F.sequence(F.lit(0), F.col("_inside") - 1)).alias("_block"), part(F.col("id"), "_outside").alias("_slot"), "id", "_u")
    right = rings.packed(members).join(sizes, "_place").select(
        "_place", part(F.col("id"), "_inside").alias("_block"), F.explode(F.sequence(F.lit(0), F.col("_outside") - 1)).alias("_slot"), "id", "_u")

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        found = [kernel(a, b)] if a.num_rows and b.num_rows else []
        return pa.concat_tables(found) if found else pa.table({f.name: pa.array([], f.type) for f in empty})

    empty = pa.schema([(f.name, _arrow(f.dataType)) for f in schema])
    place = ["_place", "_block", "_slot"]
    return left.groupBy(*place).cogroup(right.groupBy(*place)).applyInArrow(meet, schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)
