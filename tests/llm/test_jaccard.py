import random
import re

import pytest
from pyspark.sql import functions as F

from tracewright.llm.graph import components
from tracewright.llm.jaccard import similar_documents

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    return {tuple(w[i:i + 4]) for i in range(max(1, len(w) - 3))} if w else set()


def brute(texts):
    sets, group = [shingles(t) for t in texts], list(range(len(texts)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                group[b] = a
    return {i: (len(s), root(i)) for i, s in enumerate(sets)}


def near_copies(seed, groups, copies, words, edits):
    rng = random.Random(seed)
    out = [None, "", " \n", "One", "one", "one two\tthree", "ONE TWO THREE", "É b c", "é b c", "a b c d", "a b c d e"]
    passage = [f"p{i}" for i in range(60)]
    for g in range(groups):
        base = [f"w{rng.randint(0, 5000)}" for _ in range(rng.randint(*words))]
        for _ in range(copies):
            copy = list(base)
            for _ in range(rng.randint(*edits)):
                copy[rng.randrange(len(copy))] = f"e{rng.randint(0, 9999)}"
            out.append(" ".join(copy + (passage if g % 2 else [])))
    out += out[12:15]
    rng.shuffle(out)
    return out


def test_against_brute_force(spark, docs_of):
    texts = near_copies(1, 12, 14, (40, 160), (0, 5))
    docs = docs_of(texts).withColumn("node", F.lit("clash")).withColumn("component_id", F.lit(0))
    assert {r[0]: (r[1], r[2]) for r in similar_documents(docs).collect()} == brute(texts)


def test_chains_and_ids(spark, docs_of):
    base = [f"t{i}" for i in range(120)]
    texts = [" ".join(f"c{k}x{i}" if i < 4 * k else w for i, w in enumerate(base)) for k in range(6)]
    texts = [" ".join([*(f"new{i}" for i in range(3 * k)), *base[3 * k:]]) for k in range(9)] + texts
    assert {r[0]: (r[1], r[2]) for r in similar_documents(docs_of(texts)).collect()} == brute(texts)
    rows = [(None, "one two three four five"), (9, "one two three four five"), (4, "one two three four five"), (4, "one two three four five"), (None, "alone in the whole wide world")]
    got = sorted(((str(r[0]), str(r[2])) for r in similar_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == [("4", "4"), ("4", "4"), ("9", "4"), ("None", "4"), ("None", "None")]
    assert similar_documents(docs_of([])).count() == 0


@pytest.mark.parametrize("crowd", [1e9, 0])
def test_blocks_of_large_buckets(spark, docs_of, monkeypatch, crowd):
    """Buckets cut into blocks, after a single round of stars or as many as find links, find what the stars leave."""
    from tracewright.llm import jaccard

    monkeypatch.setattr(jaccard, "BLOCK", 4)
    monkeypatch.setattr(jaccard, "PAIRS", 50)
    monkeypatch.setattr(jaccard, "UNIT_ROWS", 100)
    monkeypatch.setattr(jaccard, "CROWD", crowd)
    texts = near_copies(5, 6, 25, (60, 140), (0, 9))
    assert {r[0]: (r[1], r[2]) for r in similar_documents(docs_of(texts)).collect()} == brute(texts)


def test_words_alike_under_polynomial_hashes(spark, docs_of):
    """Words that agree under any polynomial modulo 2**64 are different words."""
    one, two = "a", "b"
    for _ in range(12):
        one, two = one + two, two + one
    texts = [one[:1024], two[:1024], one, two, one[:1024]]
    assert {r[0]: (r[1], r[2]) for r in similar_documents(docs_of(texts)).collect()} == {0: (1, 0), 1: (1, 1), 2: (1, 2), 3: (1, 3), 4: (1, 0)}


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, 3), (3, 9), (50, 50)]
    got = {r["node"]: r["comp"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, 3: 3, 7: 3, 9: 3}


def test_class_counts_keep_every_similar_pair():
    """The bound by class counts lets similar pairs through, also where counts end at 255, and stops most unlike ones."""
    import numpy as np
    import pyarrow as pa

    from tracewright.llm.jaccard import CLASSES, _may_reach

    rng = np.random.default_rng(4)
    rows, similar = [], []
    for k in range(400):
        n = int(rng.choice([1, 5, 60, 500, 80_000])) if k % 40 == 0 else int(rng.choice([1, 5, 60, 500]))
        a = rng.integers(0, 1 << 62, n)
        changed = rng.random(n) < rng.choice([0, 0.02, 0.07, 0.09, 0.3, 0.9])
        b = np.where(changed, rng.integers(0, 1 << 62, n), a)
        both = len(np.intersect1d(a, b))
        similar.append(100 * both >= 85 * (2 * n - both))
        count = lambda x: np.minimum(np.bincount(x % CLASSES, minlength=CLASSES), 255).astype(np.uint8).tobytes()
        rows.append((k, k, n, n, count(a), count(b)))
    batch = pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in rows], pa.int64()) for i in range(4)), *(pa.array([r[i] for r in rows], pa.binary()) for i in (4, 5))], names=["a", "b", "na", "nb", "sa", "sb"])
    kept = {x for part in _may_reach([batch], 85) for x in part.column(0).to_pylist()}
    assert {k for k, s in enumerate(similar) if s} <= kept
    unlike = [k for k, s in enumerate(similar) if not s]
    assert sum(k in kept for k in unlike) < len(unlike) / 2


def test_small_frames_of_a_round_have_few_partitions(spark):
    """Frames that are small beside the table do not leave a file in every partition of a shuffle, and stay whole."""
    from tracewright.llm.graph import components
    from tracewright.session import PARTITION_ROWS, few

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        cores = spark.sparkContext.defaultParallelism
        wide = spark.range(1000).repartition(40, "id")
        assert few(wide, 1000).rdd.getNumPartitions() == cores and few(wide, 1000).count() == 1000
        assert few(wide, 17 * PARTITION_ROWS).rdd.getNumPartitions() == 17
        assert few(wide, 40 * PARTITION_ROWS).rdd.getNumPartitions() == 40
        edges = spark.createDataFrame([(i, i + 1) for i in range(60) if i % 20 != 19] + [(7, 7)], "a long, b long")
        found = components(edges)
        assert {tuple(r) for r in found.collect()} == {(i, i // 20 * 20) for i in range(60)}
        assert found.rdd.getNumPartitions() <= cores
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def estimate_digits(df, capsys):
    """Decimal digits of the largest size that Spark expects in the plan of a frame, 0 for what is written without an exponent."""
    capsys.readouterr()
    df.explain("cost")
    return max([0, *map(int, re.findall(r"sizeInBytes=[\d.]+E\+(\d+)", capsys.readouterr().out))])


def test_estimates_do_not_multiply_by_round(spark, capsys):
    """The expected size of labels is that of their rows however many rounds they took; it filled the driver."""
    import os

    from tracewright.session import checkpoint_dir

    rng = random.Random(2)
    ids = rng.sample(range(10_000), 400)
    found = components(spark.createDataFrame(list(zip(ids, ids[1:])), "a long, b long"))
    assert {r["comp"] for r in found.collect()} == {min(ids)} and found.count() == 400
    digits = estimate_digits(found, capsys)
    assert digits == 0
    assert not [x for x in os.listdir(checkpoint_dir(spark).removeprefix("file:")) if x.startswith("components-")]
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_estimates_of_linked_documents_stay_small(spark, docs_of, capsys):
    """Each round of stars adds to the expected size of the nodes, and does not multiply it."""
    texts = near_copies(7, 3, 12, (60, 90), (0, 6))
    got = similar_documents(docs_of(texts))
    assert {r[0]: (r[1], r[2]) for r in got.collect()} == brute(texts)
    digits = estimate_digits(got, capsys)
    assert digits < 1000


def test_copies_beside_longer_texts_find_their_hub(spark, docs_of, monkeypatch):
    """Copies of a text are each like it and less like each other, and longer texts that hold it share more: pairs stay few."""
    from tracewright.llm import jaccard

    short = [f"s{i}" for i in range(80)]
    long = short + [f"l{i}" for i in range(40)]
    texts = [" ".join(x) for x in (short, long)]
    for base, copies in ((long, 36), (short, 25)):
        for i in range(copies):
            place = 2 + i * (len(base) - 4) // copies
            texts.append(" ".join([*base[:place], f"c{len(texts)}", *base[place + 1:]]))
    met, pairs_of = [], jaccard._open_pairs

    def counted(left, percent):
        pairs = pairs_of(left, percent)
        met.append(pairs.count())
        return pairs

    monkeypatch.setattr(jaccard, "_open_pairs", counted)
    assert {r[0]: (r[1], r[2]) for r in similar_documents(docs_of(texts)).collect()} == brute(texts)
    assert met[0] < len(texts)
