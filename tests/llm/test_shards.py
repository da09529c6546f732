import zlib

import pytest
from pyspark.sql import functions as F

from tracewright.llm.shards import shard


def check(rows, texts, shards):
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows) == sorted((i is None, i or 0) for i, _ in texts)
    size = {i: len((t or "").encode()) + 8 for i, t in texts}
    crc = {i: zlib.crc32((t or "").encode()) for i, t in texts}
    total, sums, slots = sum(len((t or "").encode()) + 8 for _, t in texts), [0] * shards, [[] for _ in range(shards)]
    for r in rows:
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (size[r["doc_id"]], crc[r["doc_id"]], "bytes", None)
        sums[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(abs(s - total / shards) <= max(size.values()) for s in sums)
    assert all(sorted(s) == list(range(len(s))) for s in slots)


@pytest.mark.parametrize("shards", [1, 3, 24])
def test_shards_are_even_and_gapless(spark, docs_of, shards):
    texts = [None, "", "é" * 700, "z" * 4000] + ["same text"] * 50 + ["w" * (i * 37 % 400) for i in range(500)]
    docs = docs_of(texts).withColumn("size", F.lit("clash")).withColumn("part", F.lit(1))
    check(shard(docs, shards).collect(), list(enumerate(texts)), shards)


def test_overfull_ranges_and_ties(spark, monkeypatch):
    from tracewright.llm import shards as module

    monkeypatch.setattr(module, "_splitters", lambda rows, total, ranges: [5])
    texts = [(i, "t" * (i % 50)) for i in range(2000)] + [(None, "no id"), (None, "no id"), (3000, None)]
    texts += [texts[9], texts[9]]
    check(shard(spark.createDataFrame(texts, "doc_id long, text string").repartition(5), 4).collect(), texts, 4)
    assert shard(spark.createDataFrame([], "doc_id long, text string")).count() == 0
