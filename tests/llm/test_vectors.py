import numpy as np
from pyspark.sql import functions as F

from tracewright.llm.vectors import near_vectors

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, threshold):
    sound = {i: np.array(v, np.float32).astype(float) for i, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    group, links = list(range(len(rows))), [0] * len(rows)

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in sound:
        for j in sound:
            if i != j and len(sound[i]) == len(sound[j]) and sound[i] @ sound[j] / np.linalg.norm(sound[i]) / np.linalg.norm(sound[j]) >= threshold:
                links[i] += 1
                a, b = sorted((root(i), root(j)))
                group[b] = a
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[root(i)] = min(key, least.get(root(i), key))
    out = []
    for i, (key, _) in enumerate(rows):
        name = least.get(root(i)) if i in sound else key
        out.append((key, links[i], name, key == name))
    return sorted(map(str, out))


def rows_of(seed, n, dim, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 6, dim))
    rows = [(i, (centres[rng.integers(len(centres))] + rng.normal(size=dim) * spread * rng.random()).astype(np.float32).tolist()) for i in range(n)]
    rows += [(n + k, rows[3][1]) for k in range(5)] + [(n + 10, [2 * x for x in rows[3][1]]), (n + 11, None), (n + 12, []), (n + 13, [0.0] * dim), (n + 14, [float("nan")] * dim),
             (n + 15, [1.0, None] + [0.0] * (dim - 2)), (n + 16, [float("inf")] + [1.0] * (dim - 1)), (n + 17, [1.0, 2.0]), (n + 18, [2.0, 4.0]), (None, rows[3][1]), (7, rows[7][1])]
    return rows


def test_against_brute_force(spark, monkeypatch):
    from tracewright.llm import vectors

    monkeypatch.setattr(vectors, "MEMBERS", 16)
    monkeypatch.setattr(vectors, "VISITORS", 40)
    monkeypatch.setattr(vectors, "math", type("M", (), {"sqrt": staticmethod(np.sqrt), "ceil": staticmethod(lambda x: int(np.ceil(x))), "isqrt": staticmethod(lambda n: 28)}))
    rows = rows_of(1, 260, 8, 0.5)
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA).withColumn("node", F.lit("clash")).repartition(3)
    assert sorted(str(tuple(r)) for r in near_vectors(df).collect()) == brute(rows, 0.95)


def test_few_and_none(spark):
    assert near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(3, [0.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 1e-3])]
    assert sorted(map(tuple, near_vectors(spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)).collect())) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]
