"""Ordered folds for rules whose state depends on earlier decisions of the same key.

A fold reads the rows of a key in order, so a key is one task unless its rows can be cut. Three ways of cutting
keep the results: at pauses the rule cannot see across (``islands``), where the state follows from the last rows
alone (``calm_pieces``), and anywhere if a slice's effect on the state is a small table (``chain_entries``).
Slices follow the busiest key; a table without busy keys is not cut.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.functions.ordered import ONE_SEGMENT, SEGMENT_ROWS, run_ids, segment_of

#: Slices are at least so many times as long as what a rule remembers, so tables between slices stay small.
LEAST_SLICE = 16


def islands(df: DataFrame, keys: Sequence[str], order: Sequence[str], gap_seconds: float,
    slice_seconds: int | None = None,
) -> DataFrame:
    """Add ``_island``: a new one starts after a pause longer than ``gap_seconds``.

    A window rule of that length cannot see across such a pause, so islands of one key are
    independent and a busy key is folded by many tasks.
    """
    ts = order[0]

    def pause(before, now):
        return now[ts].cast("double") - before[ts].cast("double") > gap_seconds

    return run_ids(df, keys, order, [ts], pause, segment_of(df, keys, ts, slice_seconds), "_island")


def slice_length(df: DataFrame, keys: Sequence[str], ts: str, least: float, given: int | None = None, rows: int = SEGMENT_ROWS) -> Column:
    """Seconds of a slice in which the busiest key has about ``rows`` rows, but no less than ``least``.

    A scalar subquery over counts by key; ONE_SEGMENT where no key is busy.
    """
    if given is not None:
        return F.lit(given)
    epoch = F.unix_timestamp(F.col(ts).cast("timestamp"))
    per_key = df.groupBy(*keys).agg(F.count("*").alias("_n"), (F.max(epoch) - F.min(epoch)).alias("_span"))
    length = F.greatest(F.lit(int(LEAST_SLICE * least) + 1), F.floor(F.col("_span") * rows / F.col("_n")))
    return per_key.agg(F.coalesce(F.min(F.when(F.col("_n") > rows, length)), F.lit(ONE_SEGMENT))).scalar()


def _sliced(df: DataFrame, ts: str, length: Column) -> DataFrame:
    """``_epoch`` seconds and the ``_slice`` they lie in."""
    return df.withColumn("_epoch", F.col(ts).cast("double")).withColumn("_slice", F.floor(F.col("_epoch") / length))


def calm_pieces(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int, seconds: float, slice_seconds: int | None = None
) -> DataFrame:
    """Rows with ``_piece``, and copies with ``_warm`` that lead into the pieces that need them.

    For rules that admit at most n rows of a key in a window: where fewer than n rows lie in the two windows
    before a row, all rows of the last window were admitted whatever came before, so a piece may begin
    there if it first reads that window again (fewer than n rows). A pause of a window is such a place too. Each slice begins a
    piece at its first such place; a slice without one continues the piece before.
    """
    ts, ident = order
    length = slice_length(df, keys, ts, seconds, slice_seconds)
    rows = _sliced(df, ts, length)
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order)
    t = F.col("_epoch")
    slim = rows.where(length < ONE_SEGMENT).select(*keys, *order, "_slice", "_epoch").withColumns({
        "_before": F.lag("_epoch").over(inside), "_nth": F.lag("_epoch", n).over(inside), "_first": F.first("_epoch").over(inside)})
    sparse = (t - F.col("_first") >= 2 * seconds) & F.coalesce(t - F.col("_nth") >= 2 * seconds, F.lit(True))
    begins = F.coalesce(t - F.col("_before") > seconds, F.lit(False)) | sparse
    along = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    cuts = slim.groupBy(*keys, "_slice").agg(F.min(F.when(begins, F.struct(*order, "_epoch"))).alias("_cut")).withColumn(
        "_from", F.last(F.when(F.col("_cut").isNotNull(), F.col("_slice")), ignorenulls=True).over(along))
    placed = rows.join(cuts, [*keys, "_slice"], "left")
    after = F.col("_cut").isNotNull() & (F.struct(*order) >= F.struct(F.col(f"_cut.{ts}"), F.col(f"_cut.{ident}")))
    own = F.struct(F.when(after, F.col("_slice")).otherwise(F.coalesce("_from", F.lit(-1))).alias("piece"), F.lit(False).alias("warm"))
    leads = F.struct(F.col("_slice").alias("piece"), F.lit(True).alias("warm"))
    warms = F.coalesce(~after & (t > F.col("_cut._epoch") - seconds), F.lit(False))
    return placed.withColumn("_p", F.explode(F.when(warms, F.array(own, leads)).otherwise(F.array(own)))).select(
        *df.columns, F.col("_p.piece").alias("_piece"), F.col("_p.warm").alias("_warm"))


def sorted_runs(batches: Iterator[pd.DataFrame], keys: Sequence[str]) -> Iterator[tuple[bool, tuple, pd.DataFrame]]:
    """(begins, key, rows) for every stretch of one key in a sorted stream of batches; a key may go on in the next batch."""
    current = None
    for batch in batches:
        if batch.empty:
            continue
        columns = [batch[k].to_numpy() for k in keys]
        change = np.zeros(len(batch), bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        edges = [0, *np.flatnonzero(change), len(batch)]
        for low, high in zip(edges[:-1], edges[1:]):
            key = tuple(c[low] for c in columns)
            yield key != current, key, batch.iloc[low:high]
            current = key


def chain_entries(df: DataFrame, keys: Sequence[str], order: Sequence[str], ttl: float, length: Column) -> DataFrame:
    """``_enter`` for every (key, slice): the anchor of a chain of misses as it stands before the slice.

    A row more than ``ttl`` after the anchor is a miss and the next anchor, all others change nothing. What a slice does to any
    entering anchor follows from the first miss in it, which is one of the rows of its first ``ttl`` seconds or the next one.
    All chains that begin with one of these run through the slice at once, and merge where they meet; the
    table from first misses to last anchors is all that crosses slices.
    """
    kinds = {f.name: f.dataType for f in df.schema.fields}
    slim = _sliced(df, order[0], length).where((length < ONE_SEGMENT) & F.col("_slice").isNotNull()).select(*keys, "_slice", "_epoch")
    place = [*keys, "_slice"]
    made = T.StructType([*(T.StructField(k, kinds[k]) for k in keys), T.StructField("_slice", T.LongType()), T.StructField("_miss", T.DoubleType()), T.StructField("_last", T.DoubleType())])

    def tables(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: _Chains | None = None
        for begins, key, rows in sorted_runs(batches, place):
            if begins:
                if now is not None:
                    yield now.table(made.fieldNames())
                now = _Chains(key, ttl)
            now.read(rows["_epoch"].to_numpy())
        if now is not None:
            yield now.table(made.fieldNames())

    table = slim.repartition(*place).sortWithinPartitions(*place, "_epoch").mapInPandas(tables, made)

    def step(state, slice_no, miss, last):
        anchor, at, done = state
        fresh = slice_no != at
        if fresh:
            done = False
        out = anchor if fresh else None
        if not done and (anchor is None or miss > anchor + ttl):
            anchor, done = last, True
        return (anchor, slice_no, done), out

    folded = fold_sorted(table, keys, ["_slice", "_miss"], "_enter", T.DoubleType(), lambda: (None, None, False), step, ["_slice", "_miss", "_last"])
    return folded.where("_enter IS NOT NULL").select(*place, "_enter")


class _Chains:
    """The chains of misses of one slice that begin at its first rows, merged where they meet."""

    def __init__(self, key: tuple, ttl: float):
        self.key, self.ttl = key, ttl
        self.starts: list[float] = []  # times a chain begins at
        self.leader: list[int] = []  # the chain that a chain has become
        self.open: deque = deque()  # (anchor, chain), the earliest anchor first
        self.closed = False  # whether all possible first misses are known

    def read(self, seconds: np.ndarray) -> None:
        for t in np.unique(seconds).tolist():
            if self.starts and t == self.starts[-1]:
                continue
            landed = None
            if not self.closed:
                landed = len(self.starts)
                self.closed = bool(self.starts) and t > self.starts[0] + self.ttl
                self.starts.append(t)
                self.leader.append(landed)
            while self.open and t > self.open[0][0] + self.ttl:
                _, chain = self.open.popleft()
                if landed is None:
                    landed = chain
                else:
                    self.leader[chain] = landed
            if landed is not None:
                self.open.append((t, landed))

    def table(self, names: list[str]) -> pd.DataFrame:
        anchor = {chain: a for a, chain in self.open}
        last = []
        for chain in range(len(self.starts)):
            while self.leader[chain] != chain:
                self.leader[chain] = self.leader[self.leader[chain]]
                chain = self.leader[chain]
            last.append(anchor[chain])
        kept = [i for i in range(len(last)) if i + 1 == len(last) or last[i] != last[i + 1]]  # the latest first miss of equal outcomes
        columns = [*([k] * len(kept) for k in self.key), [self.starts[i] for i in kept], [last[i] for i in kept]]
        return pd.DataFrame(dict(zip(names, columns)))


def fold_sorted(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, kind: T.DataType,
    start: Callable[[], object], step: Callable[..., tuple[object, object]], values: Sequence[str] | None = None,
) -> DataFrame:
    """Add ``name`` = the output of ``step(state, *values)`` over each key's rows in order.

    Values are the epoch seconds of the first order column unless columns are named. Spark partitions by
    key and sorts; each task reads its rows as a stream of Arrow batches and holds the state of one key only.
    """
    schema = T.StructType([*df.schema.fields, T.StructField(name, kind)])
    given = values if values is not None else ["_seconds"]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, None
        for batch in batches:
            out = []
            columns = [batch[k].to_numpy() for k in keys]
            inputs = [batch[v].tolist() for v in given]
            for i, row in enumerate(zip(*inputs)):
                key = tuple(c[i] for c in columns)
                if key != current:
                    current, state = key, start()
                state, made = step(state, *row)
                out.append(made)
            batch[name] = pd.Series(out, dtype=object, index=batch.index)
            yield batch if values is not None else batch.drop(columns="_seconds")

    rows = df if values is not None else df.withColumn("_seconds", F.col(order[0]).cast("double"))
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(fold, schema)
