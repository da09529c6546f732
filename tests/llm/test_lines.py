import random

from pyspark.sql import functions as F

from tracewright.llm.lines import dedup_lines


def near(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(texts):
    places = [(i, k, line) for i, t in enumerate(texts) if t is not None for k, line in enumerate(t.split("\n"))]
    out = []
    for i, t in enumerate(texts):
        if t is None:
            out.append((None, 0, 0))
            continue
        lines = t.split("\n")
        kept = [
            x for k, x in enumerate(lines)
            if not x.strip("\t\n\x0b\x0c\r ") or not any((j, m) < (i, k) and (y == x or (min(len(x), len(y)) >= 16 and near(x, y))) for j, m, y in places)]
        out.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def test_against_brute_force(spark, docs_of):
    rng = random.Random(4)
    base = ["a line of about thirty characters", "é" * 20, "abcabcabcabcabcabc", "x" * 300 + "y" * 300, "tail words that end a text é", "0123456789012345", "short", "aaaaaaaaaaaaaaaaaaaaaaaa"]

    def edit(x):
        for _ in range(rng.choice([0, 1, 1, 2])):
            at = rng.randint(0, len(x))
            x = rng.choice([x[:at] + rng.choice("aé9") + x[at + 1:], x[:at] + x[at + 1:], x[:at] + rng.choice("aé9") + x[at:]])
        return x

    texts = [None, "", "\n", " \t\n\r"] + ["\n".join(edit(rng.choice(base)) if rng.random() < 0.9 else " " for _ in range(rng.randint(1, 8))) for _ in range(60)]
    docs = docs_of(texts).withColumn("n_lines", F.lit("clash")).withColumn("key", F.lit(1)).withColumn("removed", F.lit(2))
    got = {r["doc_id"]: r for r in dedup_lines(docs).collect()}
    want = brute(texts)
    for i, t in enumerate(texts):
        assert (got[i]["text"], got[i]["n_lines"], got[i]["n_removed"]) == want[i], t
        assert got[i]["rest"]["n_lines"] == "clash"


def test_equal_rows_and_hot_line(spark):
    rows = [(7, "one of the twins here\nand more"), (7, "one of the twins here\nand more"), (None, "a line without an id"), *((i, f"the same line again\nown line number {i:05d} of it") for i in range(10, 300))]
    got = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and all(r["n_removed"] == 0 for r in got if r["doc_id"] in (7, None))
    assert sum(r["n_removed"] for r in got) >= 289
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0
