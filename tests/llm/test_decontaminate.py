import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tracewright.llm.decontaminate import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(FOLD))


def brute(text, items):
    w, hit, found = words(text), set(), set()
    for key, item in items:
        v = words(item)
        for j in range(max(1, len(v) - 9) if v else 0):
            span = v[j:j + 10]
            for i in range(len(w) - len(span) + 1):
                if w[i:i + len(span)] == span:
                    hit |= set(range(i, i + len(span)))
                    found.add(str(key))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_against_brute_force(spark, docs_of, limit):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(40)] + ["É", "Ö2", "ß"]
    make = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, make(rng.choice([1, 3, 9, 10, 11, 30]))) for i in range(12)] + [(100, None), (101, "..."), (5, make(25)), (None, make(12))]
    texts = [None, "", " . "]
    for _ in range(40):
        parts = [make(rng.randint(0, 15))]
        for _ in range(rng.randint(0, 3)):
            v = rng.choice(items)[1] or ""
            cut = v.split()
            a = rng.randint(0, max(0, len(cut) - 1))
            parts += [",".join(cut[a:a + rng.randint(5, 30)]).upper(), make(rng.randint(0, 5))]
        texts.append(" ".join(parts))
    texts += texts[5:8] + [make(3000) + " " + items[6][1]]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("n_words", F.lit("clash"))
    docs = docs_of(texts).withColumn("item_id", F.lit(1)).withColumn("contaminated", F.lit("x"))
    got = {r[0]: tuple(r[1:]) for r in decontaminate(docs, bench, broadcast_bytes=limit).collect()}
    wanted = [x for x in items if x[0] is not None]
    assert got == {i: brute(t, wanted) for i, t in enumerate(texts)}


def test_empty_tables(spark, docs_of):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [tuple(r[1:4]) for r in decontaminate(docs_of(["a b", None]), none).orderBy("doc_id").collect()] == [(2, 0, 0), (0, 0, 0)]
    assert decontaminate(docs_of([]), none).count() == 0


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_words_alike_under_polynomial_hashes(spark, docs_of, limit):
    one, two = "a", "b"
    for _ in range(12):
        one, two = one + two, two + one
    items = spark.createDataFrame([(1, f"{one} is an item of ten words that stand here"), (2, one[:1024])], "item_id long, text string")
    texts = [f"{two} is an item of ten words that stand here", two[:1024], f"x {one[:1024]} y", f"{one} is an item of ten words that stand here"]
    got = {r["doc_id"]: (r["n_hit"], r["n_items"]) for r in decontaminate(docs_of(texts), items, broadcast_bytes=limit).collect()}
    assert got == {0: (0, 0), 1: (0, 0), 2: (1, 1), 3: (10, 1)}


def test_a_template_of_many_items():
    """Twenty thousand items of one template: a text full of it meets one list, not a list a word."""
    import tracemalloc

    import numpy as np

    from tracewright.llm.batches import ALNUM, Words
    from tracewright.llm.decontaminate import ItemIndex

    template = "the following question has exactly one right answer please read all choices before you reply"
    index = ItemIndex(list(range(20_000)), [f"{template} item{i} own{i}" for i in range(20_000)], 5, 10)
    raw = (template + " and more ") * 2000
    data = np.frombuffer(raw.encode(), np.uint8)
    words = Words(data, np.array([0, len(data)]), ALNUM)
    tracemalloc.start()
    start, length, lists = index.spans(words)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 * len(raw) and len(np.unique(lists)) == 1
    assert index.named(tuple(np.unique(lists).tolist()))[0] == 20_000
    assert len(start) == 2000 * (len(template.split()) - 9)
