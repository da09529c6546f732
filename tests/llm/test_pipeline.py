import hashlib
import random

import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from tests_llm_brute import contaminated, kept_lines, similar

from tracewright.llm import bpe, toxicity

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def corpus():
    rng = random.Random(6)
    line = lambda n: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "éta", "theta"]) + str(rng.randint(0, 400)) for _ in range(n))
    bench = [(0, line(30)), (1, line(14)), (2, None)]
    texts = ["\n".join(line(rng.randint(5, 30)) for _ in range(rng.randint(1, 6))) for _ in range(120)]
    texts += [t + " you idiot" for t in texts[:20]] + texts[30:36] + [t.replace("alpha1", "alpha2") + "\n" + line(3) for t in texts[40:50]]
    texts += [line(3) + " " + bench[0][1][20:200] + " " + line(9) for _ in range(8)] + [None, "", " \n "]
    long = line(150)
    texts += [long, long.replace("beta1", "beta9", 1), " ".join(long.split()[:148])]
    rows = [(i, t, "en", f"s{i % 3}", len(t) if t is not None else None) for i, t in enumerate(texts)]
    labels = [(i, 1, int(120 <= i < 140)) for i in range(0, 145)]
    return rows, labels, bench


def test_pipeline_against_brute_force(spark, tmp_path):
    rows, labels, bench = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    chain = toxicity.train(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"))
    rejected = {r["doc_id"] for r in toxicity.score_toxicity(docs, chain).where("rejected").collect()}
    assert rejected == set(range(120, 140))
    left = [(i, t) for i, t, *_ in rows if i not in rejected]
    left = [(i, k) for (i, t), (k, removed) in zip(left, kept_lines([t for _, t in left])) if not removed or k.strip("\t\n\x0b\x0c\r ")]
    left = [left[i] for i, root in similar([t for _, t in left]).items() if i == root]
    left = [(i, t) for i, t in left if not contaminated(t, bench)]
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    assert set(got) == {i for i, _ in left}
    for i, t in left:
        ids = np.array(encoding.encode_ordinary(t or ""), "<u4").tobytes()
        assert bytes(got[i]["ids"]) == ids and got[i]["ids_sha256"] == hashlib.sha256(ids).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def test_stages_on_empty_and_null_ids(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for rows, ids in (([], []), ([(None, "no id but a text", None, None, None), (None, "one two three four five six seven eight nine ten", "x", None, 3), (4, None, None, None, None)], [None, 4])):
        docs = spark.createDataFrame(rows, schema)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert sorted((r[0] for r in corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()), key=str) == sorted(ids, key=str)
    assert docs.where(F.col("n_chars") == 3).count() == 0


def kept_of(spark, tmp_path, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    return sorted(((str(r[0]), r[1]) for r in corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path)).select("doc_id", "text").collect()), key=str)


def test_copies_are_similar_from_eighty_percent_of_five_words(spark, tmp_path):
    base = " ".join(f"w{i}" for i in range(300))
    near = base + " " + " ".join(f"t{i}" for i in range(66))  # 0.818
    far = base + " " + " ".join(f"u{i}" for i in range(80))  # 0.789
    cut = " ".join(f"x{i}" if i in (30, 60) else f"v{i}" for i in range(90))  # 76 of 96 five-word shingles, 79 of 95 four-word
    rows = [(1, base, "en"), (2, near, "en"), (3, far, "en"), (4, " ".join(f"v{i}" for i in range(90)), "en"), (5, cut, "en")]
    assert [r[0] for r in kept_of(spark, tmp_path, rows)] == ["1", "3", "4", "5"]


def test_copies_are_told_apart_by_id_and_text(spark, tmp_path):
    text = lambda k, n=30: " ".join(f"{k}{i}" for i in range(n))
    rows = [(1, text("a"), "en"), (7, text("a"), "en"), (7, text("b"), "en"),  # only one text of id 7 is a copy
            (5, text("c"), "en"), (5, text("c"), "de"), (5, text("c"), "en"),  # one row stays
            (6, text("d"), "en"), (6, text("d") + " d30", "en"),  # copies under one id
            (8, None, "en"), (8, None, "en"), (9, "", "en"), (8, "", "en"), (None, text("e"), "en"), (None, text("e"), "en"), (10, text("e"), "en")]
    got = kept_of(spark, tmp_path, rows)
    sixth = [t for i, t in got if i == "6"]
    assert len(sixth) == 1 and sixth[0] in (text("d"), text("d") + " d30")
    want = [("1", text("a")), ("7", text("b")), ("5", text("c")), ("8", None), ("9", ""), ("8", ""), ("None", text("e")), ("None", text("e")), ("10", text("e"))]
    assert sorted((r for r in got if r[0] != "6"), key=str) == sorted(want, key=str)
