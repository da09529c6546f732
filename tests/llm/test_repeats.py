import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.llm import repeats


def brute(texts, length):
    seen, out = set(), []
    for text in texts:
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            if raw[i:i + length] in seen:
                gone[i:i + length] = True
            seen.add(raw[i:i + length])
        spans = sum(gone[i] and (i == 0 or not gone[i - 1]) for i in range(len(raw)))
        out.append((len(raw), int(gone.sum()), int(spans), hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest()))
    return dict(enumerate(out))


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randint(2, 9)))
    passages = [" ".join(word() for _ in range(rng.randint(8, 80))) for _ in range(6)]
    texts = [None, "", "short", "a" * 99, "a" * 100, "a" * 100, "a" * 350, "ab" * 400, passages[0], passages[0], "x" + passages[0]]
    for _ in range(50):
        texts.append(" ".join([word(), rng.choice(passages)[rng.randint(0, 40):], word(), rng.choice(passages), " ".join(word() for _ in range(rng.randint(0, 60)))]))
    return texts + texts[12:16]


@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(spark, docs_of, monkeypatch, small):
    if small:  # several buckets and shards, hot minimizers dealt by window, no broadcast
        for name, value in (("BUCKET_BYTES", 4000), ("SHARD_BYTES", 700), ("HOT_BYTES", 1500), ("BROADCAST_KEYS", 0)):
            monkeypatch.setattr(repeats, name, value)
    texts = corpus(3)
    docs = docs_of(texts).withColumn("key", F.lit("clash")).withColumn("start", F.lit(1))
    got = {r[0]: tuple(r[1:]) for r in repeats.remove_repeats(docs).drop("kept").collect()}
    assert got == brute(texts, 100)


def test_equal_rows_ids_and_none(spark):
    long = "some text that is long enough to count as a repeat of itself when it stands in another document too, and more"
    rows = [(5, long), (5, long), (None, long[:100]), (9, long)]
    got = sorted((r[0] is not None, r[0] or 0, r["n_removed"]) for r in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(False, 0, 0), (True, 5, 100), (True, 5, 100), (True, 9, len(long))]
    assert repeats.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_merged_intervals_of_many_shards():
    rng = np.random.default_rng(1)
    for letters, length in ((1, 3), (2, 5), (3, 8)) * 15:
        pieces = [rng.integers(97, 97 + letters, rng.integers(length, 25)).astype(np.uint8) for _ in range(9)]
        document, start = rng.integers(0, 4, 9), np.arange(9) * 100
        seen, want = set(), set()
        for _, _, k, o in sorted((document[k], start[k] + o, k, o) for k, p in enumerate(pieces) for o in range(len(p) - length + 1)):
            raw = pieces[k][o:o + length].tobytes()
            want |= {(k, o)} if raw in seen else set()
            seen.add(raw)
        for shard_bytes in (1, 40, 10000):
            assert set(zip(*(x.tolist() for x in repeats.later_windows(pieces, document, start, length, shard_bytes)))) == want


def test_pieces_alike_under_polynomial_hashes(spark, docs_of):
    """Strings that agree under any polynomial modulo 2**64 are not copies of each other."""
    one, two = "a", "b"
    for _ in range(11):
        one, two = one + two, two + one
    texts = [one, two, "head " + one + " tail", "x" * 300 + two]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeats.remove_repeats(docs_of(texts)).collect()}
    assert got == brute(texts, 100)


def test_merge_keeps_only_suffixes_that_repeat():
    """Rows that the merge gives back are the suffixes whose first symbols another one has, in blocks of equal ones."""
    rnd = np.random.default_rng(3)
    for letters, depth in [(2, 5), (3, 8), (2, 12), (256, 1), (256, 2), (40, 3)]:
        pieces = [rnd.integers(0, letters, rnd.integers(1, 60)).astype(np.uint8) for _ in range(12)]
        pieces += [pieces[0], pieces[3][2:], np.arange(256, dtype=np.uint8)]
        shards = [pieces[:4], pieces[4:5], pieces[5:]]
        made = [repeats.transform(shard, depth) for shard in shards]
        texts = []
        for shard, (order, _, _) in zip(shards, made):
            strings = [p.tobytes() for p in shard]
            suffixes = [s[k:] for s in strings for k in range(len(s) + 1)]
            texts += [suffixes[k] for k in order]
        rows, block = repeats.merge_transforms([m[1] for m in made], [m[2] for m in made], depth)
        want = {}
        for row, text in enumerate(texts):
            if len(text) >= depth:
                want.setdefault(text[:depth], set()).add(row)
        got = {}
        for row, b in zip(rows.tolist(), block.tolist()):
            got.setdefault(b, set()).add(row)
        assert sorted(map(sorted, got.values())) == sorted(sorted(x) for x in want.values() if len(x) > 1), (letters, depth)


def test_settled_suffixes_are_not_sorted_again(monkeypatch):
    """Suffixes come in order of their first symbols; later rounds sort only those that still share theirs."""
    rng = np.random.default_rng(3)
    pieces = [rng.integers(0, 256, 150).astype(np.uint8) for _ in range(60)] + [np.full(40, 97, np.uint8)] * 3
    pieces += [np.concatenate([pieces[0][:100], pieces[1][:30]]), np.frombuffer(b"ab" * 30, np.uint8)]
    sorted_rows, argsort = [], np.argsort
    monkeypatch.setattr(np, "argsort", lambda a, **how: sorted_rows.append(len(a)) or argsort(a, **how))
    order, before, step = repeats.transform(pieces, 100)
    monkeypatch.undo()
    symbols = np.concatenate([np.append(p.astype(int) + 1, 0) for p in pieces])
    ends = np.flatnonzero(symbols == 0)

    def text(k):  # up to its terminator, which is unlike the others
        end = ends[np.searchsorted(ends, k)]
        return (*symbols[k:end], 0, k)

    depth = [text(k)[:100] for k in order]
    assert sorted(order) == list(range(len(symbols))) and depth == sorted(depth)
    assert (before == symbols[order - 1]).all() and (order[step] == (order - 1) % len(order)).all()
    assert sorted_rows[0] == len(symbols) and max(sorted_rows[1:]) < len(symbols) / 10


def test_many_minimizers_are_sent_as_a_bitmap(spark, docs_of, monkeypatch):
    """Beyond what the driver lists, tasks still leave out the pieces of minimizers that stand once, before any shuffle."""
    rng = random.Random(8)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(3000)) for _ in range(40)]
    texts += [texts[0][:400] + t[:300] for t in texts[1:4]]
    seen, pieces = [], repeats._pieces

    def counted(docs, shared, *how):
        out = pieces(docs, shared, *how)
        seen.append(out.count())
        return out

    monkeypatch.setattr(repeats, "BROADCAST_KEYS", 0)
    monkeypatch.setattr(repeats, "_pieces", counted)
    docs = docs_of(texts)
    got = {r[0]: tuple(r[1:]) for r in repeats.remove_repeats(docs).drop("kept").collect()}
    assert got == brute(texts, 100)
    every = pieces(docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key")), None, 100, repeats.GRAM).count()
    assert len(seen) == 3 and max(seen) < every / 8


@pytest.mark.parametrize("listed", [0, 5000])
def test_bitmap_holds_its_minimizers_and_few_others(spark, monkeypatch, listed):
    monkeypatch.setattr(repeats, "BROADCAST_KEYS", listed)
    rng = np.random.default_rng(2)
    held, other = rng.integers(-2 ** 63, 2 ** 63, 5000), rng.integers(-2 ** 63, 2 ** 63, 50000)
    held[:3] = 0, -1, 1 << 40
    bitmap = repeats.bitmap_of(spark.createDataFrame([(int(m),) for m in held], "mini long"), len(held))
    assert repeats.in_bitmap(held.view(np.uint64), bitmap).all() and repeats.in_bitmap(other.view(np.uint64), bitmap).mean() < 0.02
    assert not repeats.bitmap_of(spark.createDataFrame([], "mini long"), 0 if listed else 1).any()


def test_found_ranges_are_kept_as_runs(spark):
    ranges = [(1, 5, 9), (1, 9, 12), (1, 20, 30), (1, 22, 25), (1, 26, 31), (2, 0, 4), (2, 5, 6), (3, 7, 8), (3, 7, 8)]
    got = repeats._runs(spark.createDataFrame(ranges, "key long, low long, high long").repartition(3)).collect()
    assert sorted(map(tuple, got)) == [(1, 5, 12), (1, 20, 31), (2, 0, 4), (2, 5, 6), (3, 7, 8)]
    assert repeats._runs(spark.createDataFrame([], "key long, low long, high long")).count() == 0
