"""Exact joins over pivot cells against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.functions import cells
from tracewright.operators import similarity as S

SCHEMA = "id long, embedding array<double>"


def clustered(n, seed, dims=8, groups=12, spread=0.05):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dims))
    return [(int(i), (centres[i % groups] + rng.normal(scale=spread, size=dims)).tolist()) for i in range(n)]


def scores(a, b):
    x, y = (np.array([v for _, v in side]) for side in (a, b))
    return np.round((x / np.linalg.norm(x, axis=1, keepdims=True)) @ (y / np.linalg.norm(y, axis=1, keepdims=True)).T, 9)


def nearest(queries, vectors, k):
    out = {}
    s = scores(queries, vectors)
    for i, (q, _) in enumerate(queries):
        ranked = sorted((-s[i, j], v) for j, (v, _) in enumerate(vectors) if v != q)
        out[q] = [(v, -x) for x, v in ranked[:k]]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["id"], round(r["score"], 9)))
        assert r["rank"] == len(out[r["query_id"]])
    return out


@pytest.mark.parametrize("k, block_rows", [(1, 16), (5, 40), (400, 64)])
def test_neighbours_among_clusters_and_copies(spark, k, block_rows):
    vectors = clustered(300, 1) + [(1000 + i, [1.0] * 8) for i in range(60)] + [(2000 + i, [2.0] * 8) for i in range(3)]
    queries = vectors[::7] + [(5000 + i, [1.0] * 8) for i in range(30)] + [(6000, [-1.0, 3.0] * 4)]
    got = found(S.knn_join(spark.createDataFrame(queries, SCHEMA).repartition(3), spark.createDataFrame(vectors, SCHEMA).repartition(3), k, block_rows))
    want = nearest(queries, vectors, k)
    assert got.keys() == want.keys()
    for q in want:  # rows of equal score may swap where sums differ in the last bits
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]], abs=1e-8)
    equal = min(k, 63)  # copies of the queried direction, smallest ids first
    assert [v for v, _ in got[5003]][:equal] == [v for v, _ in want[5003]][:equal]


def test_zero_vectors_and_empty_tables(spark):
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [0.0, 1.0])], SCHEMA)
    assert found(S.knn_join(vectors, vectors, 3)) == {1: [(3, 0.0)], 3: [(1, 0.0)]}
    none = vectors.limit(0)
    assert S.knn_join(vectors, none).count() == S.knn_join(none, vectors).count() == 0
    assert S.external_matches(vectors, none.withColumn("risk_level", F.lit("x"))).count() == 0


@pytest.mark.parametrize("mine, known", [(240, 60), (60, 240)])
def test_range_join_copies_either_side(spark, mine, known):
    a, b = clustered(mine, 2), [(10_000 + i, v) for i, v in clustered(known, 3)] + [(20_000, a) for a in ([1.0] * 8,)]
    b += [(30_000 + i, clustered(mine, 2)[5][1]) for i in range(4)]  # copies of one of mine
    df = spark.createDataFrame([(i, v, f"r{i % 3}") for i, v in b], f"{SCHEMA}, risk_level string").repartition(3)
    s = scores(a, b)
    reps = {}
    for i, v in b:
        reps.setdefault(tuple(v), []).append(i)
    want = {(q, min(reps[tuple(v)])) for i, (q, _) in enumerate(a) for j, (_, v) in enumerate(b) if s[i, j] >= 0.9}
    left = spark.createDataFrame(a, SCHEMA).repartition(3)
    assert {(r["query_id"], r["corpus_id"]) for r in S.external_matches(left, df, 0.9, 32).collect()} == want
    for r in S.external_links(left, df, 0.9, 32).collect():
        row = s[r["query_id"]]
        assert r["matches"] == (row >= 0.9).sum() and r["best_score"] == pytest.approx(row.max(), abs=1e-8)
        assert r["risk_level"] == max(f"r{b[j][0] % 3}" for j in np.flatnonzero(row >= 0.9))


def test_rings_prune_clusters(spark):
    """Distant clusters are not visited, and what is left out holds no match."""
    rows = spark.createDataFrame(clustered(600, 4, spread=0.01), SCHEMA)
    units = S._unit_rows(rows).select("id", "_u")
    pivots = cells.pivots_of(units, 600)
    members = cells.deal(units, pivots, cells.at_home)
    rings = cells.Rings(members, pivots)
    x = np.array([r["_u"] for r in units.collect()])
    d = cells.chord(x, pivots)
    taken = rings.within(d, np.full(len(d), 0.2))
    assert taken.mean() < 0.25 and taken[np.arange(len(d)), d.argmin(1)].all()
    close = cells.chord(x, x) <= 0.2
    home = d.argmin(1)
    assert all(taken[i, home[j]] for i, j in zip(*np.nonzero(close)))
    packed = cells.Rings(members, pivots, 100)
    assert packed.pack_count.sum() == 600 and 4 <= len(packed.pack_count) <= 6
    homes = packed.packs(cells.at_home(d))
    assert (homes.sum(1) == 1).all() and (packed.packs(taken) >= homes).all() and packed.packs(taken).mean() < 0.6
    held = rings.holding(d, 5)
    assert ((cells.chord(x, x) <= held[:, None] + 1e-9).sum(1) >= 5).all()


def test_blocks_of_a_range_join_grow_with_the_table():
    """The other table is copied to each block, so their number is bounded until blocks are as large as a task may hold."""
    assert [cells.block_size(128, n) for n in (0, 1000, 24 * 128, 24 * 5000, 10 ** 9)] == [128, 128, 128, 5000, cells.MOST_ROWS]


def test_copies_of_a_search_grow_with_the_rows(spark, monkeypatch):
    """Without clusters a query goes to every block; there are about SEARCH_BLOCKS of these, and a pack that just fills one is not two."""
    copies, block_pairs = [], cells.block_pairs

    def counted(guests, members, rings, block_rows, kernel, schema):
        copies.append(sum(r["count"] * cells.blocks_of(int(rings.pack_count[r["_place"]]), block_rows) for r in guests.groupBy("_place").count().collect()))
        return block_pairs(guests, members, rings, block_rows, kernel, schema)

    monkeypatch.setattr(cells, "block_pairs", counted)
    rng = np.random.default_rng(5)
    vectors = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(800, 32)))]
    df = spark.createDataFrame(vectors, SCHEMA).repartition(3)
    got = found(S.knn_join(df, df, 3, 8))
    assert sum(copies) <= (cells.SEARCH_BLOCKS + 1) * 800  # packs of 8 rows, cut in two, took many times as many
    want = nearest(vectors, vectors, 3)
    assert all([s for _, s in got[q]] == pytest.approx([s for _, s in want[q]], abs=1e-8) for q in want)
    assert [cells.block_size(512, n, cells.SEARCH_BLOCKS) for n in (100, 80_000, 10 ** 9)] == [512, 10_000, cells.MOST_ROWS]
    assert [cells.blocks_of(n, 100) for n in (7, 100, 199, 250)] == [1, 1, 1, 2]


def pairs_of(rows, threshold, key=lambda row: 0):
    s = scores([(i, v) for i, v, *_ in rows], [(i, v) for i, v, *_ in rows])
    return {(min(a[0], b[0]), max(a[0], b[0])) for x, a in enumerate(rows) for y, b in enumerate(rows) if x < y and key(a) == key(b) and s[x, y] > threshold}


def test_copies_of_a_pair_search_grow_with_the_rows(spark, monkeypatch):
    """Without clusters a vector goes to half of all blocks, not of all cells, and pairs are not joined with what belongs to their vectors."""
    from pyspark.sql.group import GroupedData

    copies, plans = [], []
    for name in ("applyInArrow", "applyInPandas"):
        def counted(self, *how, apply=getattr(GroupedData, name)):
            copies.append(self._df.count())
            return apply(self, *how)

        monkeypatch.setattr(GroupedData, name, counted)
    rng = np.random.default_rng(7)
    vectors = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(900, 16)))]
    df = spark.createDataFrame(vectors, SCHEMA).repartition(3)
    found = S.similar_pairs(df, 0.3, 8)
    plans.append(found._jdf.queryExecution().optimizedPlan().toString())
    assert {(r["id_a"], r["id_b"]) for r in found.collect()} == pairs_of(vectors, 0.3)
    assert max(copies) <= S.PAIR_BLOCKS * 900
    assert [S._block_rows(512, n, d) for n, d in ((100, 64), (120_000, 64), (10 ** 9, 64), (10 ** 9, 1024))] == [512, 10_000, cells.MOST_ROWS, cells.MOST_ROWS // 16]
    before, after = plans[0].split("FlatMapGroups", 1)
    assert "Join" not in before


@pytest.mark.parametrize("slots, block_rows", [(1, 5), (4, 20), (4, 1000)])
def test_pairs_of_large_small_and_dense_groups(spark, monkeypatch, slots, block_rows):
    """Languages dealt over many packs, over one, and one whose vectors crowd in a few cells; copies scaled by a factor stay apart."""
    monkeypatch.setattr(S, "SLOT_BLOCKS", slots)
    monkeypatch.setattr(S, "KERNEL_ROWS", 16)
    monkeypatch.setattr(S, "PAIR_ROWS", 50)
    monkeypatch.setattr(S, "PAIR_BLOCKS", 10 ** 9)
    rng = np.random.default_rng(9)
    plain = [(i, v.tolist(), "a") for i, v in enumerate(rng.normal(size=(220, 6)))]
    dense = [(1000 + i, (np.ones(6) + rng.normal(scale=0.01, size=6)).tolist(), "b") for i in range(90)]
    scaled = [(2000 + i, (2.0 * np.array(v)).tolist(), "a") for i, v, _ in plain[:30]]
    few = [(3000 + i, v, "c" if i % 2 else "d") for i, v, _ in plain[:9]] + [(4000, [0.0] * 6, "a"), (4001, plain[0][1], None)]
    rows = plain + dense + scaled + few
    df = spark.createDataFrame([(i, f"f{i}", g, 60, v) for i, v, g in rows], "id long, file string, language string, bytes int, embedding array<double>").repartition(3)
    got = [(r["id_a"], r["id_b"]) for r in S.similar_chunks(df, 0.6, block_rows=block_rows).collect()]
    usable = [r for r in rows if r[2] and any(r[1])]
    assert len(got) == len(set(got)) and set(got) == pairs_of(usable, 0.6, lambda row: row[2])


def test_home_between_two_pivots_loses_no_pair(spark):
    """Cells are reached by what pivots tell: a row as close to two pivots is found from either."""
    rng = np.random.default_rng(11)
    pivots = rng.normal(size=(6, 3))
    pivots /= np.linalg.norm(pivots, axis=1, keepdims=True)
    pivots[3] = pivots[2]  # rows of one direction may live in either cell
    x = rng.normal(size=(400, 3))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[:40] = pivots[2]
    homes = spark.createDataFrame([(int(i),) for i in cells.chord(x, pivots).argmin(1)], "_place int")
    line = cells.Line(homes, pivots)
    d = cells.chord(x, pivots)
    near = d.min(1)
    for home in (d.argmin(1), np.array([np.flatnonzero(r <= r.min() + 1e-12)[-1] for r in d])):
        met = line.reached(d, home, near, 0.3)
        close = cells.chord(x, x) <= 0.3
        assert all(met[i, c] for i, j in zip(*np.nonzero(close)) for c in np.flatnonzero(d[j] <= near[j] + 1e-12))
    for packs in (1, 2, 6):
        share = line.share(packs)
        assert share.min() == 0 and share.max() < packs and (np.diff(share[line.order]) >= 0).all()


def test_a_language_is_dealt_by_its_own_size(spark, monkeypatch):
    """Blocks are those of the whole table, so a language that fills one or less is not copied to others."""
    from pyspark.sql.group import GroupedData

    copies = []
    for name in ("applyInArrow", "applyInPandas"):
        def counted(self, *how, apply=getattr(GroupedData, name)):
            copies.append(self._df.count())
            return apply(self, *how)

        monkeypatch.setattr(GroupedData, name, counted)
    rng = np.random.default_rng(8)
    rows = [(i, f"f{i}", f"lang{i % 10}", 60, v.tolist()) for i, v in enumerate(rng.normal(size=(900, 16)))]
    df = spark.createDataFrame(rows, "id long, file string, language string, bytes int, embedding array<double>").repartition(3)
    got = {(r["id_a"], r["id_b"]) for r in S.similar_chunks(df, 0.25, block_rows=8).collect()}
    assert got == pairs_of([(r[0], r[4], r[2]) for r in rows], 0.25, lambda row: row[2])
    assert max(copies) <= 4 * 900
