"""Quality classifier from weak labels.

Heuristic labellers look at a text's layout and vote good, bad or nothing. Votes are counted by pattern over
all documents, and expectation-maximisation on these counts estimates how often each labeller votes what on
good and on bad texts. The posterior of each pattern labels a bounded sample of distinct documents, on which
a linear scorer over hashed token shapes is fitted; it scores every document.

The sample holds at most ``max_sample`` distinct texts in hash order, whatever ids they have: the bound on what the
driver sees. Vote patterns number at most 3 ** labellers.

Cases: null and empty texts have no tokens and score by the bias, with the votes of an empty text; equal texts
get equal results, and repeated ids or rows count in the votes but once in the sample; very long texts are read whole, a
task holds some thirty times their bytes; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.batches import NONSPACE, Words, byte_slices, mix, text_column
from tracewright.llm.linear import apply_logistic, fit_logistic

MAX_SAMPLE = 4000
BUCKETS = 256
#: Labellers in vote order.
LABELLERS = ("symbols", "repeats", "variety", "word_size", "letters", "stops", "length", "marks")
_KIND = np.full(256, 4, np.uint8)  # 0 letter, 1 digit, 2 stop, 3 comma, 4 other mark
for _b in (*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)):
    _KIND[_b] = 0
_KIND[0x30:0x3A] = 1
_KIND[[0x2E, 0x21, 0x3F]] = 2
_KIND[[0x2C, 0x3B, 0x3A, 0x27, 0x2D]] = 3


def _per_row(values: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    return np.bincount(row, weights=values, minlength=rows)


def token_counts(data: np.ndarray, words: Words) -> np.ndarray:
    """Bytes of each kind in every token, by column."""
    sums = np.zeros((5, len(data) + 1), np.int64)
    kind = _KIND[data]
    for k in range(5):
        np.cumsum(kind == k, out=sums[k, 1:])
    return (sums[:, words.end] - sums[:, words.start]).T


def distinct_tokens(words: Words, rows: int) -> np.ndarray:
    order = np.lexsort((words.hash, words.row))
    h, r = words.hash[order], words.row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return np.bincount(r[new], minlength=rows)


def votes(data: np.ndarray, words: Words, rows: int) -> np.ndarray:
    """1 good, 0 bad, -1 no vote, by row and labeller."""
    kinds = token_counts(data, words)
    n = words.per_row(rows)
    some = np.maximum(n, 1)
    size = _per_row(words.end - words.start, words.row, rows)
    marks = _per_row(kinds[:, 4], words.row, rows) / np.maximum(size, 1)
    same = np.zeros(len(words.hash), bool)
    same[1:] = (words.hash[1:] == words.hash[:-1]) & (words.row[1:] == words.row[:-1])
    repeats = _per_row(same, words.row, rows) / some
    variety = distinct_tokens(words, rows) / np.sqrt(some)
    word_size = size / some
    letters = _per_row(kinds[:, 0], words.row, rows) / np.maximum(size, 1)
    stops = _per_row(kinds[:, 2] > 0, words.row, rows) / some
    alone = _per_row((kinds[:, 0] == 0) & (kinds[:, 1] == 0), words.row, rows) / some
    out = np.full((rows, len(LABELLERS)), -1, np.int8)
    for k, (bad, good) in enumerate((
        (marks > 0.10, marks < 0.01), (repeats > 0.10, repeats < 0.01), (variety < 2, variety > 4), ((word_size > 14) | (word_size < 2.5), (word_size > 3.5) & (word_size < 9)),
        (letters < 0.75, letters > 0.92), ((stops < 0.01) | (stops > 0.5), (stops > 0.02) & (stops < 0.3)), (n < 3, n > 40), (alone > 0.15, alone < 0.02),
    )):
        out[good, k], out[bad, k] = 1, 0
        out[n == 0, k] = 0 if k == 6 else -1
    return out


def shape_features(data: np.ndarray, words: Words, rows: int) -> np.ndarray:
    """Share of each hashed token shape and pair of shapes, and of tokens that repeat the one before."""
    kinds = token_counts(data, words)
    levels = np.minimum(kinds, [[3, 2, 1, 1, 3]]) + (kinds > 8) * np.array([[1, 0, 0, 0, 0]])
    shape = (levels * [[1, 8, 32, 64, 128]]).sum(1).astype(np.uint64)
    same = np.zeros(len(shape), np.uint64)
    pair = np.zeros(len(shape), np.uint64)
    if len(shape) > 1:
        joined = words.row[1:] == words.row[:-1]
        same[1:] = (words.hash[1:] == words.hash[:-1]) & joined
        pair[1:] = np.where(joined, shape[:-1] + np.uint64(1), 0)
    out = np.zeros((rows, BUCKETS))
    some = np.maximum(words.per_row(rows), 1)[:, None]
    for salt, value in ((1, shape), (2, shape * np.uint64(1 << 20) + pair), (3, same)):
        bucket = (mix(value, salt) % np.uint64(BUCKETS)).astype(np.int64)
        out += np.bincount(words.row * BUCKETS + bucket, minlength=rows * BUCKETS).reshape(rows, BUCKETS)
    return np.sqrt(out / some)


def _pattern(v: np.ndarray) -> np.ndarray:
    return ((v + 1) * 3 ** np.arange(v.shape[1])).sum(1)


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Posterior of good for each vote pattern, by expectation-maximisation over counted patterns.

    ``patterns`` holds votes by row. It starts from the share of good among a pattern's votes; the vote
    frequencies of each labeller on good and on bad texts are its estimated accuracies.
    """
    cast = patterns >= 0
    good = np.where(cast.any(1), (patterns == 1).sum(1) / np.maximum(cast.sum(1), 1), 0.5)
    posterior = np.clip(np.where(good >= 0.75, 0.95, np.where(good < 0.6, 0.05, 0.5)), 0.02, 0.98)
    one_hot = np.stack([(patterns == v) for v in (-1, 0, 1)], 2).astype(float)
    total = counts.sum()
    for _ in range(rounds):
        weight = np.stack([counts * (1 - posterior), counts * posterior])
        share = np.clip(weight.sum(1) / max(total, 1), 0.01, 0.99)
        accuracy = (np.einsum("cp,plv->clv", weight, one_hot) + 0.5) / (weight.sum(1)[:, None, None] + 1.5)
        score = np.einsum("plv,clv->cp", one_hot * cast[:, :, None], np.log(accuracy)) + np.log(share)[:, None]
        fresh = 1 / (1 + np.exp(np.clip(score[0] - score[1], -50, 50)))
        done = np.abs(fresh - posterior).max(initial=0) < 1e-6
        posterior = fresh
        if done:
            break
    return posterior


def _voted(docs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for first, end, data, offsets in byte_slices(text_column(batch)):
                v = votes(data, Words(data, offsets, NONSPACE), end - first)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(_pattern(v))], names=["doc_id", "pattern"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, pattern long")


class Scorer:
    """Posterior by vote pattern and the linear model over shapes."""

    def __init__(self, patterns: np.ndarray, posterior: np.ndarray, weights: np.ndarray):
        self.patterns, self.posterior, self.weights = patterns, posterior, weights


def train(docs: DataFrame, max_sample: int = MAX_SAMPLE) -> Scorer:
    """Estimate the labellers over all documents, then fit the scorer on a bounded sample."""
    counted = sorted((r["pattern"], r["count"]) for r in _voted(docs).groupBy("pattern").count().collect())
    patterns = np.array([p for p, _ in counted], np.int64)
    table = (patterns[:, None] // 3 ** np.arange(len(LABELLERS)) % 3 - 1).astype(np.int8).reshape(-1, len(LABELLERS))
    posterior = estimate(table, np.array([n for _, n in counted], float))
    hashed = docs.select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    chosen = hashed.select("h").distinct().orderBy(F.xxhash64("h"), "h").limit(max_sample)

    def features(batches):
        for batch in batches:
            for first, end, data, offsets in byte_slices(text_column(batch)):
                words = Words(data, offsets, NONSPACE)
                x = shape_features(data, words, end - first).astype("<f4")
                yield pa.RecordBatch.from_arrays([pa.array(_pattern(votes(data, words, end - first))), pa.array([r.tobytes() for r in x], pa.binary())], names=["pattern", "x"])

    rows = hashed.join(F.broadcast(chosen), "h").select("text").mapInArrow(features, "pattern long, x binary").distinct().collect()
    rows.sort()
    x = np.array([np.frombuffer(r["x"], "<f4") for r in rows], float).reshape(-1, BUCKETS)
    y = posterior[np.searchsorted(patterns, [r["pattern"] for r in rows])] if rows else np.zeros(0)
    return Scorer(patterns, posterior, fit_logistic(x, y))


def score_quality(docs: DataFrame, scorer: Scorer, keep_at: float = 0.5) -> DataFrame:
    """doc_id, posterior of its votes, score of the linear model, kept."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches):
        model = shared.value
        for batch in batches:
            for first, end, data, offsets in byte_slices(text_column(batch)):
                words, rows = Words(data, offsets, NONSPACE), end - first
                pattern = _pattern(votes(data, words, rows))
                place = np.minimum(np.searchsorted(model.patterns, pattern), max(len(model.patterns) - 1, 0))
                label = np.where(model.patterns[place] == pattern, model.posterior[place], 0.5) if len(model.patterns) else np.full(rows, 0.5)
                score = apply_logistic(shape_features(data, words, rows), model.weights)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, rows), pa.array(words.per_row(rows), pa.int64()), pa.array(label), pa.array(score), pa.array(score >= keep_at)],
                    names=["doc_id", "n_tokens", "posterior", "score", "kept"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, posterior double, score double, kept boolean")
