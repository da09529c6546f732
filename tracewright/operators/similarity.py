"""Vector similarity, search and duplicates.

Pair search is exact. Equal vectors are collapsed first, so a group of copies yields one
representative and never its own pairs. The rest is dealt to cells around pivot directions, whose
number grows with the square root of the vectors; the triangle inequality says which other cells a
vector may reach. Cells are cut into blocks of fixed size, and each block pair is one matrix product.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.functions import cells
from tracewright.functions.lines import any_contains, occurrences
from tracewright.functions.plan import computed_once
from tracewright.functions.skew import join_counted
from tracewright.session import cut_lineage, release

BLOCK_ROWS = 4096
#: Rows of a block of a search at least.
SEARCH_ROWS = 512
KERNEL_ROWS = 2048
#: Scores of one product in a search or range join at most.
KERNEL_SCORES = KERNEL_ROWS * BLOCK_ROWS


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 when lengths differ or a norm is 0."""
    scale = norm(a) * norm(b)
    return F.when(F.size(a) != F.size(b), F.lit(0.0)).otherwise(F.coalesce(F.try_divide(dot(a, b), scale), F.lit(0.0)))


def collapse_equal(vectors: DataFrame, by: Sequence[str] = (), extra: Sequence[Column] = ()) -> DataFrame:
    """One row per distinct vector (within ``by``): the smallest id stands for its copies."""
    return vectors.groupBy(*by, "embedding").agg(F.min("id").alias("id"), F.count("*").alias("copies"), *extra)


def copies_of(vectors: DataFrame) -> DataFrame:
    """(representative, id) for every copy of a vector held more than once."""
    key = vectors.select("id", F.xxhash64("embedding").alias("_h"), "embedding")
    groups = collapse_equal(vectors).where("copies > 1").select(
        F.xxhash64("embedding").alias("_h"), F.col("embedding").alias("_rep_vec"),
        F.col("id").alias("representative"), "copies")
    per_hash = groups.groupBy("_h").agg(
        F.sum("copies").alias("copies"), F.collect_list(F.struct("_rep_vec", "representative")).alias("_reps"))
    joined = join_counted(key, per_hash, "_h", "copies", salt=["id"]).select("id", "embedding", F.explode("_reps").alias("_r"))
    return joined.where(F.col("embedding") == F.col("_r._rep_vec")).select("_r.representative", "id")


def _unit_rows(vectors: DataFrame) -> DataFrame:
    """Rows with a non-zero vector, scaled to length 1; the norm is computed once per row."""
    rows = computed_once(vectors, "_norm", norm(F.col("embedding"))).where(F.col("_norm") > 0)
    return rows.withColumn("_u", F.transform("embedding", lambda x: x.cast("double") / F.col("_norm"))).drop("_norm")


#: A pair search copies a vector to half of its blocks, so its tables are cut into about so many, until these are as large as a task may hold.
PAIR_BLOCKS = 12
#: Blocks of rows that meet a block of members in one task, so members are copied for every so many blocks only.
SLOT_BLOCKS = 4
#: Rows that are dealt to their cells at a time, and of one batch of pairs.
DEAL_ROWS, PAIR_ROWS = 2048, 1 << 17


def _unit(embedding: np.ndarray, norms: np.ndarray) -> np.ndarray:
    return embedding.astype(np.float64) / norms[:, None]


def _deal(rows: DataFrame, line: cells.Line, reach: float) -> DataFrame:
    """Rows by pack: each with its home, the cell of the nearest pivot, and a copy in every pack ahead whose members it may reach.

    ``_packs`` says over how many packs a row's group is dealt. Of two packs only the one ahead in cyclic order gets copies, so
    every pair meets in one pack, where at least one of the two is a member.
    """
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, DEAL_ROWS):
                batch = whole.slice(low, DEAL_ROWS)
                d = cells.chord(_unit(cells.matrix(batch.column(names.index("embedding"))), batch.column(names.index("_norm")).to_numpy()), line.pivots)
                home = d.argmin(1)
                near = d[np.arange(len(d)), home]
                reached = line.reached(d, home, near, reach).astype(np.float32)
                packs = batch.column(names.index("_packs")).to_numpy()
                for n in np.unique(packs):
                    row, pack_of = np.flatnonzero(packs == n), line.share(n)
                    own = pack_of[home[row]][:, None]
                    ahead = (np.arange(n)[None, :] - own) % n
                    take = (reached[row] @ (pack_of[:, None] == np.arange(n)[None, :]).astype(np.float32) > 0) & (
                        (2 * ahead < n) | ((2 * ahead == n) & (own < np.arange(n)[None, :])))
                    at, pack = np.nonzero(take | (ahead == 0))
                    for k in range(0, len(at), cells.BATCH_ROWS):
                        r, c = row[at[k:k + cells.BATCH_ROWS]], pack[k:k + cells.BATCH_ROWS]
                        yield pa.RecordBatch.from_arrays(
                            [*(column.take(pa.array(r)) for column in batch.columns), pa.array(home[r], pa.int32()), pa.array(near[r]), pa.array(c, pa.int32()),
                             pa.array(pack_of[home[r]] == c)], names=[*names, "_cell", "_near", "_pack", "_member"])

    return rows.mapInArrow(run, T.StructType([
        *rows.schema.fields, T.StructField("_cell", T.IntegerType()), T.StructField("_near", T.DoubleType()), T.StructField("_pack", T.IntegerType()),
        T.StructField("_member", T.BooleanType())]))


def _block_rows(block_rows: int, count: int, dims: int) -> int:
    """Rows of a block, which grow with the table while a block takes no more memory than MOST_ROWS of 64 components."""
    return max(block_rows, min(cells.block_size(block_rows, count, PAIR_BLOCKS), cells.MOST_ROWS * 64 // max(1, dims)))


def _vector_pairs(vectors: DataFrame, threshold: float, group: str | None, block_rows: int, carried: Sequence[str]) -> DataFrame:
    """(group, id_a, id_b, score) with score > threshold over distinct vectors, within ``group`` when given, and the ``carried`` columns of both.

    A group is dealt over as many packs of neighbouring cells as it fills blocks, and blocks grow with the table, so a vector is
    copied once a block, by about half their number at most. Packs of more than one and a half are cut into blocks, by counts that
    are broadcast: only groups of as much have any. Copies cross one shuffle, as they came in and with their norm; what pairs
    need of their vectors goes along, so pairs are not shuffled. Inside a block only cells within reach are compared.
    """
    spark = vectors.sparkSession
    by = group or "_group"
    if not isinstance(vectors.schema["embedding"].dataType.elementType, T.FloatType):
        vectors = vectors.withColumn("embedding", F.col("embedding").cast("array<double>"))
    given = vectors.where(F.col(group).isNotNull()) if group else vectors.withColumn(by, F.lit(0))
    normed = computed_once(given, "_norm", norm(F.col("embedding"))).where(F.col("_norm") > 0)
    rows = cut_lineage(normed.select(by, "id", *carried, "embedding", "_norm"))
    release(spark)
    types = {f.name: f.dataType for f in rows.schema}
    out = T.StructType([
        T.StructField(by, types[by]), T.StructField("id_a", types["id"]), T.StructField("id_b", types["id"]), T.StructField("score", T.DoubleType()),
        *[T.StructField(f"{c}_{s}", types[c]) for s in "ab" for c in carried]])
    count = rows.count()
    units = rows.select("id", F.transform("embedding", lambda x: x.cast("double") / F.col("_norm")).alias("_u"))
    pivots = cells.pivots_of(units, count)
    if not len(pivots):
        return spark.createDataFrame([], out)
    reach = math.sqrt(max(0.0, 2 - 2 * max(-1.0, min(1.0, threshold)))) + 1e-9
    block = _block_rows(block_rows, count, pivots.shape[1])
    line = cells.Line(cells.deal(units, pivots, cells.at_home), pivots)
    packs = F.least(F.lit(len(pivots)), F.round(F.col("count") / block)).cast("int").alias("_packs")
    large = rows.groupBy(by).count().where(F.col("count") > 1.5 * block).select(by, packs)
    sized = rows.join(F.broadcast(large), by, "left").withColumn("_packs", F.coalesce("_packs", F.lit(1)))
    sizes = _deal(sized.where("_packs > 1"), line, reach).groupBy(by, "_pack").agg(
        F.greatest(F.lit(1), F.ceil(F.count_if("_member") / (1.5 * block))).cast("int").alias("_inside"),
        F.greatest(F.lit(1), F.ceil(F.count("*") / (SLOT_BLOCKS * block))).cast("int").alias("_outside"))
    dealt = _deal(sized, line, reach).join(F.broadcast(sizes), [by, "_pack"], "left")
    inside, outside = (F.coalesce(c, F.lit(1)) for c in ("_inside", "_outside"))
    cut = dealt.withColumns({
        "_own": F.when(F.col("_member"), F.pmod(F.xxhash64("id", F.lit(1)), inside).cast("int")).otherwise(-1), "_slot": F.pmod(F.xxhash64("id", F.lit(2)), outside).cast("int")})

    def at(block, slot, home):
        return F.struct(block.alias("block"), slot.alias("slot"), F.lit(home).alias("home"))

    # A member is at home once a slot of its block, and a guest of its own block and those behind it; a visitor is a guest of all.
    homes = F.when(F.col("_member"), F.transform(F.sequence(F.lit(0), outside - 1), lambda s: at(F.col("_own"), s, True))).otherwise(F.array())
    guests = F.transform(F.sequence(F.greatest("_own", F.lit(0)), inside - 1), lambda b: at(b, F.col("_slot"), False))
    copies = cut.withColumn("_at", F.explode(F.concat(homes, guests))).select(
        by, "_pack", F.col("_at.block").alias("_block"), F.col("_at.slot").alias("_slot"), F.col("_at.home").alias("_home"), "_own", "_cell", "_near", "id", *carried, "embedding", "_norm")

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches).combine_chunks()
        vector = cells.matrix(table.column("embedding"))
        column = {c: table.column(c).to_numpy() for c in ("_home", "_own", "_cell", "_near", "_norm", "id")}
        left, right = np.flatnonzero(column["_home"]), np.flatnonzero(~column["_home"].astype(bool))
        left = left[np.argsort(line.place[column["_cell"][left]], kind="stable")]
        kept = table.select([by, "id", *carried])
        for s in range(0, len(left), KERNEL_ROWS):
            x = left[s:s + KERNEL_ROWS]
            some, u = np.unique(column["_cell"][x]), _unit(vector[x], column["_norm"][x])
            for t in range(0, len(right), BLOCK_ROWS):
                y = right[t:t + BLOCK_ROWS]
                v = _unit(vector[y], column["_norm"][y])
                met = line.reached(cells.chord(v, line.pivots[some]), column["_cell"][y], column["_near"][y], reach, some).any(1)
                y, v = y[met], v[met]
                scores = u @ v.T
                i, j = np.nonzero(scores > threshold)
                for k in range(0, len(i), PAIR_ROWS):
                    i_k, j_k = i[k:k + PAIR_ROWS], j[k:k + PAIR_ROWS]
                    a, b = x[i_k], y[j_k]
                    first = column["id"][a] < column["id"][b]
                    keep = (column["_own"][a] != column["_own"][b]) | first  # inside a block each pair once
                    a, b, first = a[keep], b[keep], first[keep]
                    lo, hi = (kept.take(pa.array(np.where(f, a, b))).combine_chunks() for f in (first, ~first))
                    yield from pa.table({
                        by: lo.column(by), "id_a": lo.column("id"), "id_b": hi.column("id"), "score": pa.array(scores[i_k, j_k][keep]),
                        **{f"{c}_{n}": side.column(c) for n, side in (("a", lo), ("b", hi)) for c in carried}}).to_batches()

    return copies.groupBy(by, "_pack", "_block", "_slot").applyInArrow(products, out)


def similar_pairs(vectors: DataFrame, threshold: float = 0.8, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Pairs of distinct vectors with cosine > threshold, and how many files carry each.

    vectors(id, embedding). Identical vectors are one side each (see ``copies_of``).
    """
    return _vector_pairs(collapse_equal(vectors), threshold, None, block_rows, ["copies"]).select("id_a", "id_b", "score", "copies_a", "copies_b")


def similar_chunks(chunks: DataFrame, threshold: float = 0.8, min_bytes: int = 0, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Similar code chunks of one language in different files, each pair once.

    chunks(id, file, language, bytes, embedding). Chunks with the same vector stand for each
    other; a pair is dropped only when all carriers of both sides are in one file.
    """
    usable = chunks.where((F.col("bytes") >= min_bytes) & F.col("language").isNotNull())
    reps = collapse_equal(usable, ["language"], [F.min("file").alias("lo"), F.max("file").alias("hi")])
    pairs = _vector_pairs(reps, threshold, "language", block_rows, ["copies", "lo", "hi"])
    one_file = (F.col("lo_a") == F.col("hi_a")) & (F.col("lo_b") == F.col("hi_b")) & (F.col("lo_a") == F.col("lo_b"))
    return pairs.where(~one_file).select("id_a", "id_b", "language", "score", "copies_a", "copies_b")


def search_similar(
    vectors: DataFrame, query_vec: Column, k: int | None = None, threshold: float = 0.0, filters: Sequence[Column] = ()
) -> DataFrame:
    """Matches with score >= threshold, best first, k of them if k is given; filters run before scoring."""
    rows = vectors
    for f in filters:
        rows = rows.where(f)
    # The query vector becomes a column first: it may be a scalar subquery, which lambdas cannot hold.
    probed = computed_once(rows, "_probe", query_vec)
    scored = computed_once(probed, "score", cosine(F.col("embedding"), F.col("_probe")))
    ranked = scored.where(F.col("score") >= threshold).orderBy(F.col("score").desc(), "id").drop("_probe")
    return ranked if k is None else ranked.limit(k)


def search_code(
    chunks: DataFrame, query_vec: Column, language: str, exclude_job: str | None = None, k: int | None = None,
    threshold: float = 0.0,
) -> DataFrame:
    filters = [F.col("language") == language]
    if exclude_job is not None:
        filters.append(F.col("job_id") != exclude_job)
    return search_similar(chunks, query_vec, k, threshold, filters)


def _scores_schema(queries: DataFrame, vectors: DataFrame) -> T.StructType:
    return T.StructType([
        T.StructField("query_id", queries.schema["id"].dataType), T.StructField("id", vectors.schema["id"].dataType), T.StructField("score", T.DoubleType())])


def _kernel(choose):
    """Products of two blocks, as many queries at a time as KERNEL_SCORES and KERNEL_ROWS allow; ``choose(scores)`` gives the (row, column) places that stay.

    Columns are in the order of the ids.
    """
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.take(pc.sort_indices(right.column("id")))
        a, b = cells.matrix(left.column("_u")), cells.matrix(right.column("_u"))
        found = []
        rows = max(1, min(KERNEL_ROWS, KERNEL_SCORES // len(b)))
        for s in range(0, len(a), rows):
            scores = a[s:s + rows] @ b.T
            x, y = choose(scores)
            found.append(pa.table({
                "query_id": left.column("id").take(pa.array(x + s)), "id": right.column("id").take(pa.array(y)), "score": pa.array(scores[x, y])}))
        return pa.concat_tables(found)

    return run


def _best(k: int):
    """The k best columns of every row, ties to the first; ties of the k-th are told apart in order."""
    def choose(scores: np.ndarray):
        rounded = np.round(scores, 12)
        take = min(k, scores.shape[1])
        least = np.partition(rounded, scores.shape[1] - take, axis=1)[:, scores.shape[1] - take]
        x, y = np.nonzero(rounded >= least[:, None])
        order = np.lexsort((y, -rounded[x, y], x))
        x, y = x[order], y[order]
        place = np.arange(len(x)) - np.searchsorted(x, x)
        return x[place < take], y[place < take]

    return choose


def _top(scores: DataFrame, k: int, by: str = "query_id") -> DataFrame:
    """The k best (score, id) of every query, with their rank."""
    w = Window.partitionBy(by).orderBy(F.round("score", 12).desc(), "id")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _nearest(asked: DataFrame, members: DataFrame, pivots: np.ndarray, k: int, block_rows: int) -> DataFrame:
    """The k nearest members (id, _u) of every asked (id, _u): first around home, then in all cells the k-th distance reaches."""
    members = cut_lineage(cells.deal(members, pivots, cells.at_home))
    block_rows = cells.block_size(block_rows, members.count(), cells.SEARCH_BLOCKS)
    rings = cells.Rings(members, pivots, block_rows)
    schema = _scores_schema(asked, members)
    home = cells.deal(asked, pivots, lambda d, batch: rings.packs(cells.at_home(d)))
    first = cut_lineage(_top(cells.block_pairs(home, members, rings, block_rows, _kernel(_best(k)), schema), k))
    if rings.in_pack.shape[1] == 1:
        return first
    kth = first.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("_kth"))

    def others(d: np.ndarray, batch: pa.RecordBatch) -> np.ndarray:
        kth = batch.column(batch.schema.get_field_index("_kth")).to_numpy(zero_copy_only=False)
        known = np.sqrt(np.maximum(2 - 2 * kth, 0) + 1e-10)  # scores that round to the same tie
        return rings.packs(rings.within(d, np.fmin(known, rings.holding(d, k)))) & ~rings.packs(cells.at_home(d))

    away = cells.deal(asked.join(kth, "id", "left"), pivots, others)
    more = cells.block_pairs(away, members, rings, block_rows, _kernel(_best(k)), schema)
    return _top(first.drop("rank").unionByName(more), k)


def knn_join(queries: DataFrame, vectors: DataFrame, k: int = 5, block_rows: int = SEARCH_ROWS) -> DataFrame:
    """query_id, id, score, rank: the k nearest vectors of every query, itself (the same id) excluded; ties to the smaller id.

    Exact, in two rounds: the cells around a query's home give the distance of its k-th best, and a copy of the
    query goes only to the other packs of cells of which a ring meets that distance; vectors stay in their cells. Equal
    queries are asked once, and of equal vectors only the k + 1 of the smallest ids can be among the nearest, so a
    group of copies costs as much as those. Where vectors have no clusters the rings prune nothing, and the
    comparisons are quadratic; copies are not, as blocks grow with the table up to ``cells.MOST_ROWS``.
    """
    few = _top(vectors.select("id", "embedding", F.lit(0.0).alias("score")), k + 1, "embedding")
    members = cut_lineage(_unit_rows(few.select("id", "embedding")).select("id", "_u"))
    asked = cut_lineage(queries.groupBy("embedding").agg(F.min("id").alias("id"), F.count("*").alias("copies")))
    units = cut_lineage(_unit_rows(asked).select("id", "_u"))
    pivots = cells.pivots_of(members, members.count())
    if not len(pivots):
        return queries.sparkSession.createDataFrame([], T.StructType([*_scores_schema(queries, vectors), T.StructField("rank", T.IntegerType())]))
    near = _nearest(units, members, pivots, k + 1, block_rows)
    lists = near.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("near"))  # k + 1 entries
    answers = asked.join(lists, asked["id"] == lists["query_id"]).select("embedding", "copies", "near")
    mine = join_counted(queries.select("id", "embedding"), answers, "embedding", "copies", salt=["id"])
    others = F.slice(F.filter("near", lambda x: x["id"] != F.col("id")), 1, k)
    return mine.select(F.col("id").alias("query_id"), F.posexplode(others).alias("rank", "_n")).select(
        "query_id", F.col("_n.id").alias("id"), F.col("_n.score").alias("score"), (F.col("rank") + 1).alias("rank"))


def _range_join(mine: DataFrame, known: DataFrame, threshold: float, block_rows: int) -> DataFrame:
    """(query_id, id, score >= threshold) of two tables (id, embedding); the smaller one is copied over cell bounds."""
    a, b = (cut_lineage(_unit_rows(side).select("id", "_u")) for side in (mine, known))
    swapped = a.count() > b.count()
    guests, members = (b, a) if swapped else (a, b)
    pivots = cells.pivots_of(members, members.count())
    schema = _scores_schema(guests, members)
    if not len(pivots):
        return mine.sparkSession.createDataFrame([], _scores_schema(mine, known))
    reach = math.sqrt(max(0.0, 2 - 2 * max(-1.0, min(1.0, threshold))))
    members = cut_lineage(cells.deal(members, pivots, cells.at_home))
    block_rows = cells.block_size(block_rows, members.count())
    rings = cells.Rings(members, pivots, block_rows)
    copies = cells.deal(guests, pivots, lambda d, batch: rings.packs(rings.within(d, np.full(len(d), reach))))
    hits = cells.block_pairs(copies, members, rings, block_rows, _kernel(lambda scores: np.nonzero(scores >= threshold)), schema)
    return hits.select(F.col("id").alias("query_id"), F.col("query_id").alias("id"), "score") if swapped else hits


def external_matches(
    vectors: DataFrame, corpus: DataFrame, threshold: float = 0.8, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """My vectors against a known corpus(id, embedding, risk_level): every match at or above the threshold.

    A metric range join: the larger side stays in its cells, the smaller one is copied to the cells its
    radius meets. Equal vectors on either side are matched once through their representative.
    """
    mine = collapse_equal(vectors)
    known = collapse_equal(corpus, extra=[F.max("risk_level").alias("risk_level")])
    hits = _range_join(mine.select("id", "embedding"), known.select("id", "embedding"), threshold, block_rows)
    return (
        hits.join(mine.select(F.col("id").alias("query_id"), "copies"), "query_id")
        .join(known.select("id", "risk_level"), "id")
        .select("query_id", F.col("id").alias("corpus_id"), "score", "copies", "risk_level")
    )


def external_links(
    vectors: DataFrame, corpus: DataFrame, threshold: float = 0.8, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """One row per representative of my vectors that has a match: how many corpus vectors (copies counted), the
    closest one's id and score, and the highest risk level. Grows with my vectors, not with the pairs."""
    mine = collapse_equal(vectors)
    known = collapse_equal(corpus, extra=[F.max("risk_level").alias("risk_level")])
    hits = _range_join(mine.select("id", "embedding"), known.select("id", "embedding"), threshold, block_rows)
    best = F.min(F.struct((-F.round("score", 12)).alias("s"), "id", "score"))  # ties to the smaller id
    links = hits.join(known.select("id", F.col("copies").alias("_c"), "risk_level"), "id").groupBy("query_id").agg(
        F.sum("_c").alias("matches"), best.alias("_b"), F.max("risk_level").alias("risk_level"))
    return links.join(mine.select(F.col("id").alias("query_id"), "copies"), "query_id").select(
        "query_id", "copies", "matches", F.col("_b.id").alias("best_id"), F.col("_b.score").alias("best_score"), "risk_level")


def exact_matches(files: DataFrame, corpus: DataFrame) -> DataFrame:
    """Files whose content hash is in the corpus(id, content): one row per (hash, corpus item)."""
    mine = exact_groups(files)
    known = corpus.select(F.col("id").alias("corpus_id"), F.sha2("content", 256).alias("hash_sha256"))
    return mine.join(known, "hash_sha256")


def exact_groups(files: DataFrame) -> DataFrame:
    """Count and smallest id per content hash; partially aggregated, so copies collapse before the shuffle."""
    return files.groupBy(F.sha2("content", 256).alias("hash_sha256")).agg(
        F.count("*").alias("copies"), F.min("id").alias("first_id"))


def exact_duplicates(files: DataFrame) -> DataFrame:
    return exact_groups(files).where(F.col("copies") > 1)


def duplicate_members(files: DataFrame) -> DataFrame:
    """Every member of every duplicate group beside its representative: one row per file, no lists."""
    rows = files.select("id", F.sha2("content", 256).alias("hash_sha256"))
    return join_counted(rows, exact_duplicates(files), "hash_sha256", "copies", salt=["id"]).select(
        "hash_sha256", "first_id", "id")


def search_facets(hits: DataFrame, by: Sequence[str] = ("file_type", "classification")) -> DataFrame:
    """Hit counts per value of each facet, one pass over the hits."""
    facets = F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in by])
    return hits.select(F.explode(facets).alias("f")).groupBy("f.facet", "f.value").agg(F.count("*").alias("hits"))


def search_text(
    files: DataFrame, terms: Sequence[str], filters: Sequence[Column] = (), limit: int | None = None, context: int = 40
) -> DataFrame:
    """Files holding any term, best first, with a marked snippet around the first hit."""
    rows = files
    for f in filters:
        rows = rows.where(f)
    low = F.lower("content")
    score = sum((occurrences(low, w.lower()) for w in terms), F.lit(0))
    alternatives = "|".join(f"\\Q{w}\\E" for w in terms)
    around = F.regexp_extract("content", rf"(?i)[^\n]{{0,{context}}}(?:{alternatives})[^\n]{{0,{context}}}", 0)
    top = rows.where(any_contains(low, [w.lower() for w in terms])).withColumn("score", score).orderBy(
        F.col("score").desc(), "id").limit(limit)
    return top.withColumn("snippet", F.regexp_replace(around, rf"(?i)({alternatives})", "<mark>$1</mark>"))


def drop_job(vectors: DataFrame, job: str) -> DataFrame:
    return vectors.where(F.col("job_id") != job)


def collection_stats(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy("job_id").agg(F.count("*").alias("vectors"))
