import hashlib
import math
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from tracewright.llm.resample import Features, bucket_counts, matrix_crc, resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def folded(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def runs(text, sizes):
    w = WORD.findall(folded(text))
    return [" ".join(w[i:i + n]) for n in range(sizes[0], sizes[1] + 1) for i in range(len(w) - n + 1)], len(w)


def brute(docs, target, sizes=(1, 1), buckets=10_000, seed=2024, least=20, percent=10):
    def counts(texts):
        out = [0] * buckets
        for t in texts:
            for f in runs(t, sizes)[0]:
                out[zlib.crc32(f.encode()) % buckets] += 1
        return out

    s, t = counts(x for _, x in docs), counts(target)
    gain = [math.floor(1000 * math.log((t[i] + 1) * (sum(s) + buckets) / ((s[i] + 1) * (sum(t) + buckets)))) for i in range(buckets)]
    rows = []
    for i, text in docs:
        found, words = runs(text, sizes)
        weight = sum(gain[zlib.crc32(f.encode()) % buckets] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words])
    rivals = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[2], r[1]))
    drawn = {id(r): k + 1 for k, r in enumerate(rivals[:percent * len(rivals) // 100])}
    return sorted(((*r[:4], drawn.get(id(r))) for r in rows), key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def texts(n):
    rng = np.random.default_rng(4)
    words = ["Alpha", "beta", "GAMMA", "ünï", "x", "a1", "Ærø", "straße", "long" * 30, "delta", "eps"]
    return [" ,\n-"[i % 4].join(rng.choice(words, rng.integers(0, 60))) + "." for i in range(n)]


def test_matrix_crc_equals_the_library():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 5000, dtype=np.uint8)
    start = rng.integers(0, 4000, 300)
    length = rng.integers(0, 60, 300)
    length[0] = 1000
    assert matrix_crc(data, start, length).tolist() == [zlib.crc32(data[s:s + n].tobytes()) for s, n in zip(start, length)]
    assert matrix_crc(data, start[:0], length[:0]).tolist() == []


def test_features_of_a_slice():
    rows = ["", "one", "One two one two", "...", "é é", "tail"]
    raw = [r.encode() for r in rows]
    f = Features(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), (1, 3), 1 << 20)
    for i, r in enumerate(rows):
        found, words = runs(r, (1, 3))
        assert sorted(f.bucket[f.row == i]) == sorted(zlib.crc32(x.encode()) % (1 << 20) for x in found)
        assert f.words[i] == words


def test_documents_are_drawn_as_by_hand(spark, docs_of):
    docs = list(enumerate([None, "", "...", "word " * 30, *texts(300), "a" * 3000 + " b" * 20000]))
    docs += [(7, docs[7][1]), (7, "another text of this id " * 9), (None, docs[9][1]), (None, docs[9][1])]
    target = ["alpha beta", None, "straße ünï eps", ""]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4).withColumn("score", F.lit("clash")).withColumn("before", F.lit(1))
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    assert rows_of(resample(df, goal)) == brute(docs, target)
    assert rows_of(resample(df, goal, sizes=(1, 2), buckets=97, seed=5, least_words=3, percent=55)) == brute(docs, target, (1, 2), 97, 5, 3, 55)


def test_ties_and_empty_tables(spark):
    docs = [(5, "same words in every row " * 5)] * 20 + [(5, "other words of the same id " * 5)] * 20
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert rows_of(resample(df, none, percent=60)) == brute(docs, [], percent=60)
    assert [r[4] for r in rows_of(resample(df, none, least_words=1000))] == [None] * 40
    assert rows_of(resample(none, df)) == []
    assert bucket_counts(none).sum() == 0
