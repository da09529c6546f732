"""Embedding near-duplicates by an exact metric range join.

Unit vectors are compared in the chord metric, where a cosine threshold is a radius r. Pivots deal them to
cells by the nearest pivot. A vector is copied into another cell only if it may lie within r of one of its
members: by the triangle inequality its distance to that cell's pivot is at most its own pivot distance plus
2 r and within r of the cell's radii, and it lies within r of the plane between the two pivots. Of two cells
only the one ahead in cyclic order takes the other's vectors, so each pair meets once. Cells join
independently, in units of bounded blocks of members and visitors.

Equal vectors are one node with a count. A unit reports how many vectors each node links to and a forest of
its links instead of all pairs, so dense groups cost their size in output.

Cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of
different lengths do not link; equal rows link with each other; null ids never name a component; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.graph import components
from tracewright.session import cut_lineage

THRESHOLD = 0.95
MEMBERS = 1024
VISITORS = 4096
MOST_PIVOTS = 1024
_SLACK = 1e-9


def unit_rows(column: pa.Array, width: int) -> np.ndarray:
    """Vectors of one length as rows of unit length, in double precision."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
    flat = flat / np.abs(flat).max(1, keepdims=True)  # neither squares nor sums overflow
    return flat / np.sqrt((flat * flat).sum(1, keepdims=True))


def forest(close: np.ndarray, one: np.ndarray, two: np.ndarray, n: int) -> np.ndarray:
    """For n things, of which row i is ``one[i]`` and column j ``two[j]``: the smallest that links reach.

    The links stay a matrix of truth values; listing them would take many times its memory.
    """
    label = np.arange(n, dtype=np.int32)
    most = np.int32(n)
    while True:
        new = label.copy()
        np.minimum.at(new, one, np.where(close, label[two][None, :], most).min(1, initial=most))
        np.minimum.at(new, two, np.where(close, label[one][:, None], most).min(0, initial=most))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _nodes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vec_id, node) of every row, node null if it cannot link; and the distinct vectors with their counts."""
    sound = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0)
    named = vectors.select("vec_id", "embedding").withColumn("node", F.when(F.coalesce(sound, F.lit(False)), F.xxhash64("embedding")))
    distinct = named.where("node IS NOT NULL").groupBy("node").agg(F.first("embedding").alias("embedding"), F.count(F.lit(1)).alias("copies"))
    return named.select("vec_id", "node"), distinct


def _deal(nodes: DataFrame, pivots: np.ndarray, width: int, radii: np.ndarray | None, reach: float) -> DataFrame:
    """(cell, member, node, copies, embedding, far): members with their pivot distance, then boundary copies."""
    shared = nodes.sparkSession.sparkContext.broadcast((pivots, radii))

    def run(batches):
        pivots, radii = shared.value
        m = len(pivots)
        between = np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 0))
        for batch in batches:
            if not batch.num_rows:
                continue
            d = np.sqrt(np.maximum(2 - 2 * unit_rows(batch.column(2), width) @ pivots.T, 0))
            home = d.argmin(1)
            rows = np.arange(len(d))
            near = d[rows, home][:, None]
            member = np.zeros(d.shape, bool)
            member[rows, home] = True
            take = member.copy()
            if radii is not None:
                ahead = (np.arange(m)[None, :] - home[:, None]) % m
                take |= (
                    (ahead > 0) & ((2 * ahead < m) | ((2 * ahead == m) & (home[:, None] < np.arange(m)[None, :])))
                    & (d <= near + 2 * reach + _SLACK) & (d <= radii[1] + reach + _SLACK) & (d >= radii[0] - reach - _SLACK)
                    & (d * d - near * near <= 2 * reach * between[home] + _SLACK))
            row, cell = np.nonzero(take)
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell, pa.int32()), pa.array(member[row, cell]), *(batch.column(k).take(pa.array(row)) for k in range(3)), pa.array(d[row, cell])],
                names=["cell", "member", "node", "copies", "embedding", "far"])

    kind = nodes.schema["embedding"].dataType.simpleString()
    return nodes.select("node", "copies", "embedding").mapInArrow(run, f"cell int, member boolean, node long, copies long, embedding {kind}, far double")


def _links(dealt: DataFrame, sizes: list[tuple[int, int, int]], width: int, threshold: float) -> DataFrame:
    """(node, links) sums and (node, other) forest edges of every unit."""
    counts = F.create_map(*[x for c, inside, outside in sizes for x in (F.lit(c), F.struct(
        F.lit(max(1, math.ceil(inside / MEMBERS))).alias("inside"), F.lit(max(1, math.ceil((inside + outside) / VISITORS))).alias("outside")))])
    cut = dealt.withColumn("s", counts[F.col("cell")]).withColumns({
        "own": F.expr("int(pmod(xxhash64(node, 1), s.inside))"), "slot": F.expr("int(pmod(xxhash64(node, 2), s.outside))")})
    # A member block meets every visitor block of its cell; members visit the blocks from their own on.
    homes = cut.where("member").selectExpr(
        "cell", "own AS block", "explode(sequence(0, s.outside - 1)) AS slot", "true AS home", "own AS at", "node", "copies", "embedding")
    guests = cut.selectExpr(
        "cell", "explode(sequence(CASE WHEN member THEN own ELSE 0 END, s.inside - 1)) AS block", "slot", "false AS home", "CASE WHEN member THEN own ELSE -1 END AS at", "node", "copies", "embedding")

    def meet(table: pa.Table) -> pa.Table:
        home = table.column("home").to_numpy()
        x = unit_rows(table.column("embedding").combine_chunks(), width)
        node, copies, at = (table.column(c).to_numpy() for c in ("node", "copies", "at"))
        h, g = np.flatnonzero(home), np.flatnonzero(~home)
        close = x[h] @ x[g].T >= threshold
        inside = at[h][:, None] == at[g][None, :]  # within a block each pair once
        close &= ~inside | (node[h][:, None] < node[g][None, :])
        nodes, place = np.unique(node, return_inverse=True)
        one, two = place[h], place[g]
        weight = close.astype(np.float32)
        links = np.bincount(one, weights=weight @ copies[g].astype(np.float64), minlength=len(nodes)) + np.bincount(two, weights=copies[h].astype(np.float64) @ weight, minlength=len(nodes))
        some = np.flatnonzero(links)
        root = forest(close, one, two, len(nodes))
        return pa.table({"node": pa.array(nodes[some]), "other": pa.array(nodes[root[some]]), "links": pa.array(np.rint(links[some]).astype(np.int64))})

    return homes.union(guests).groupBy("cell", "block", "slot").applyInArrow(meet, "node long, other long, links long")


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of (vec_id, embedding)."""
    named, distinct = _nodes(vectors)
    distinct = cut_lineage(distinct)
    reach = math.sqrt(max(2 - 2 * threshold, 0))
    found = None
    for width, count in sorted((r[0], r[1]) for r in distinct.groupBy(F.size("embedding")).count().collect()):
        nodes = distinct.where(F.size("embedding") == width)
        m = min(MOST_PIVOTS, max(1, math.isqrt(count) // 4))
        chosen = nodes.orderBy(F.xxhash64("node"), "node").limit(m).select("embedding").toArrow()
        pivots = unit_rows(chosen.column(0).combine_chunks(), width)
        radii = np.zeros((2, len(pivots)))
        radii[0], radii[1] = 9, -9
        for r in _deal(nodes, pivots, width, None, reach).groupBy("cell").agg(F.min("far"), F.max("far")).collect():
            radii[:, r[0]] = r[1], r[2]
        dealt = cut_lineage(_deal(nodes, pivots, width, radii, reach))
        sizes = [tuple(r) for r in dealt.groupBy("cell").agg(F.count_if("member"), F.count_if(~F.col("member"))).collect()]
        links = _links(dealt, sizes, width, threshold)
        found = links if found is None else found.union(links)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], "node long, other long, links long")
    found = cut_lineage(found)
    labels = components(found.where("node <> other").select(F.col("node").alias("a"), F.col("other").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    each = (
        named.join(distinct.select("node", "copies"), "node", "left").join(links, "node", "left").join(labels, "node", "left")
        .withColumn("comp", F.coalesce("comp", "node")))
    names = each.where("node IS NOT NULL").groupBy("comp").agg(F.min("vec_id").alias("least"))
    return each.join(names, "comp", "left").select(
        "vec_id", (F.coalesce("copies", F.lit(1)) - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"),
        F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("least")).alias("component_id"),
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
