import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.llm.codes import compress, dot_products, limbs, most_of

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, parts=4, entries=256, rounds=4, scale=1024):
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    width = parts * max(1, -(-max(len(v) for _, v, _ in kept) // parts))
    most, size = most_of(width), width // parts
    whole = [[max(-most, min(most, math.floor(scale * x))) for x in v] + [0] * (width - len(v)) for _, v, _ in kept]
    cut = [[v[p * size:(p + 1) * size] for p in range(parts)] for v in whole]
    order = sorted(range(len(kept)), key=lambda r: (kept[r][0] is None, kept[r][0] or 0, kept[r][1]))[:entries]
    books = [[cut[r][p] for r in order] for p in range(parts)]

    def nearest(x, book):
        d = [sum((a - b) ** 2 for a, b in zip(x, e)) for e in book]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        for p in range(parts):
            at = [nearest(c[p], books[p])[0] for c in cut]
            groups = {k: [c[p] for c, a in zip(cut, at) if a == k] for k in set(at)}
            books[p] = [[sum(col) // len(col) for col in zip(*groups[k])] if k in groups else e for k, e in enumerate(books[p])]
    found = [[nearest(c[p], books[p]) for p in range(parts)] for c in cut]
    errors = [sum(d for _, d in f) for f in found]
    by_label = {}
    for (_, _, label), e in zip(kept, errors):
        by_label[label] = by_label.get(label, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{k:02x}" for k, _ in f), e, min(by_label[label], 2**63 - 1), digest) for (i, _, label), f, e in zip(kept, found, errors)), key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()), key=str)


@pytest.mark.parametrize("most", [3, 1000, 2**20, 2**27, 2**30])
def test_products_of_limbs_are_exact(most):
    rng = np.random.default_rng(most)
    a, b = rng.integers(-most, most + 1, (40, 7)), rng.integers(-most, most + 1, (30, 7))
    a[0], b[0] = most, -most
    exact = [[sum(int(x) * int(y) for x, y in zip(r, s)) for s in b] for r in a]
    assert dot_products(limbs(a), limbs(b)).tolist() == exact
    assert all(np.abs(part).max() <= 1 << 10 for part in limbs(a))
    back = sum(part.astype(np.int64) << (10 * i) for i, part in enumerate(limbs(a)))
    assert (back == a).all()


def test_vectors_as_by_hand(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(12, 8))
    rows = [(int(i), (base[i % 12] + rng.normal(scale=0.05, size=8)).tolist(), int(i % 3) if i % 5 else None) for i in rng.permutation(140)]
    rows += [(500, None, 1), (501, [1.0, None] * 4, 1), (502, [float("nan")] * 8, 0), (503, [float("inf")] * 8, 0), (504, [0.0] * 8, 9), (None, [0.5] * 8, 9)]
    rows += [rows[3], rows[3], (rows[3][0], [9.0] * 8, 2)] + [(i, [0.25] * 8, 7) for i in range(600, 680)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumn("code", F.lit("clash")).withColumn("key", F.lit(1)).withColumn("n", F.lit(1))
    assert rows_of(compress(df, entries=16)) == brute(rows, entries=16)
    assert rows_of(compress(df, parts=2, entries=300, rounds=1, scale=7)) == [
        (i, c, *rest) for i, c, *rest in rows_of(compress(df.drop("n"), parts=2, entries=300, rounds=1, scale=7))]


def test_lengths_extremes_and_ties(spark):
    rows = [(1, [1.0, 2.0, 3.0], 1), (2, [], 1), (3, [1e300, -1e300, 0.0, 5.0, 6.0], None), (4, [-0.0005] * 5, None), (5, [1.0, 2.0, 3.0], 2), (6, [1e300] * 5, 3), (7, [-1e300] * 5, 3)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert rows_of(compress(df, entries=3)) == brute(rows, entries=3)
    assert rows_of(compress(df)) == brute(rows)
    nothing = spark.createDataFrame([], SCHEMA)
    assert rows_of(compress(nothing)) == [] and compress(nothing).columns == compress(df).columns
    assert rows_of(compress(spark.createDataFrame([(1, None, 1)], SCHEMA))) == []
    assert rows_of(compress(spark.createDataFrame([(1, [], 1), (2, [], None)], SCHEMA))) == brute([(1, [], 1), (2, [], None)])
