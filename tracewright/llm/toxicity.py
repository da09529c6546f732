"""Toxicity by a classifier chain.

Categories are predicted one after the other; each linear model sees the hashed words of a text and the
probabilities of the categories before it. For training these come from out-of-fold predictions, so a later
model learns from the errors that earlier ones make on unseen texts. Labels name toxic texts only; a labelled
toxic text belongs to a category if it holds one of its seed words, and the last category is toxicity itself.

The chain is fitted on at most ``max_labelled`` distinct labelled texts, taken in hash order: the bound on
what the driver sees, also where an id has many texts. Its features are the word buckets whose share among toxic texts stands out most.

Cases: null and empty texts get the models' base rates; without toxic labels nothing is rejected; labels that
are null, repeated or without a document are ignored or counted once; equal texts get equal results; very long texts
are read whole; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.batches import byte_slices, text_column
from tracewright.llm.linear import BITS, apply_logistic, fit_logistic, present, word_features
from tracewright.session import cut_lineage

MAX_LABELLED = 8000
FEATURES = 192
FOLDS = 5
LEAST_Z = 4.0
#: Probability of the last category from which a document is rejected; toxic texts are the rarer class.
REJECT_AT = 0.4
#: Seed words by category, in the order of the chain.
SEEDS = {
    "insult": ("idiot", "moron", "stupid", "dumb", "fool", "loser", "clown"),
    "degrading": ("worthless", "pathetic", "disgusting", "useless", "ugly"),
    "dehumanising": ("scum", "trash", "vermin", "filth", "garbage"),
}
CATEGORIES = (*SEEDS, "toxic")


def _sample(docs: DataFrame, labels: DataFrame, limit: int) -> DataFrame:
    """(words, toxic): buckets of distinct words of at most ``limit`` labelled texts, equal ones once."""
    chosen = (
        labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit))
    texts = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(chosen), "doc_id").select("text", (F.col("toxic") > 0).cast("long").alias("toxic"))

    def features(batches):
        for batch in batches:
            toxic = batch.column(1)
            for first, end, data, offsets in byte_slices(text_column(batch)):
                row, bucket = word_features(data, offsets)
                pairs = np.unique((row << BITS) | bucket)
                stop = np.searchsorted(pairs >> BITS, np.arange(end - first + 1)).astype(np.int32)
                words = pa.ListArray.from_arrays(pa.array(stop), pa.array((pairs & ((1 << BITS) - 1)).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([toxic.slice(first, end - first), words], names=["toxic", "words"])

    return cut_lineage(texts.mapInArrow(features, "toxic long, words array<int>").groupBy("words").agg(F.max("toxic").alias("toxic"))
                       .orderBy(F.xxhash64("words"), "words").limit(limit))


def seed_buckets(seeds) -> np.ndarray:
    """Buckets of whole seed words."""
    raw = " ".join(seeds).encode()
    return word_features(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[1][:len(seeds)]


class Chain:
    """Feature buckets and one linear model per category.

    ``rows`` are (toxic, buckets, fold, count) of the training texts; only the chosen ``buckets`` are features.
    """

    def __init__(self, buckets: list[int], rows: list[tuple], folds: int = FOLDS):
        self.width, self.models = len(buckets), []
        self.column = np.full(1 << BITS, -1, np.int32)
        self.column[buckets] = np.arange(len(buckets))
        x = np.zeros((len(rows), self.width))
        for r, (_, words, _, _) in enumerate(rows):
            f = self.column[np.array(words, np.int64)]
            x[r, f[f >= 0]] = 1
        toxic, fold, count = (np.array([row[k] for row in rows], float) for k in (0, 2, 3))
        for category in CATEGORIES:
            y = toxic
            if category in SEEDS:
                seeds = set(seed_buckets(SEEDS[category]).tolist())
                y = toxic * np.array([float(not seeds.isdisjoint(words)) for _, words, _, _ in rows])
            self.models.append(fit_logistic(x, y, count=count) if len(rows) else np.r_[np.zeros(x.shape[1]), -35.0])
            unseen = np.zeros(len(rows))
            for f in range(folds):
                here = fold == f
                if here.any():
                    unseen[here] = apply_logistic(x[here], fit_logistic(x[~here], y[~here], count=count[~here])) if not here.all() else y.mean()
            x = np.column_stack([x, unseen])

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of each category, by column."""
        out = []
        for model in self.models:
            out.append(apply_logistic(x, model))
            x = np.column_stack([x, out[-1]])
        return np.column_stack(out)


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, features: int = FEATURES) -> Chain:
    """Choose the features by counts over the sample, then fit on its texts reduced to them."""
    sample = _sample(docs, labels, max_labelled)
    total, bad = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    share = bad / max(total, 1)
    n, z = F.col("n"), (F.col("bad") - F.col("n") * share) / F.sqrt(F.col("n") * (share * (1 - share)) + 1e-9)
    counts = sample.select(F.explode("words").alias("bucket"), "toxic").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("bad"))
    best = [r["bucket"] for r in counts.where(n >= 3).withColumn("z", z).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "bucket").limit(features).collect()]
    used = sorted({*best, *(int(b) for seeds in SEEDS.values() for b in seed_buckets(seeds))})
    fold = F.pmod(F.xxhash64("words"), F.lit(FOLDS)).alias("fold")
    rows = sample.select("toxic", fold, F.array_sort(F.array_intersect("words", F.array(*map(F.lit, used)))).alias("words")).groupBy("toxic", "words", "fold").count().collect()
    return Chain(best, sorted((r["toxic"], tuple(r["words"]), r["fold"], r["count"]) for r in rows))


def score_toxicity(docs: DataFrame, chain: Chain, reject_at: float = REJECT_AT) -> DataFrame:
    """doc_id, a probability per category, and whether the document is rejected, plus the other columns as ``rest``."""
    others = [c for c in docs.columns if c != "doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    docs = docs.select("doc_id", "text", F.struct(*others).alias("rest"))

    def run(batches):
        model = shared.value
        for batch in batches:
            for first, end, data, offsets in byte_slices(text_column(batch)):
                p = model.predict(present(data, offsets, model.column, model.width))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, end - first), *(pa.array(p[:, k]) for k in range(len(CATEGORIES))), pa.array(p[:, -1] >= reject_at),
                     batch.column(2).slice(first, end - first)],
                    names=["doc_id", *(f"p_{c}" for c in CATEGORIES), "rejected", "rest"])

    kind = docs.schema["rest"].dataType.simpleString()
    id_kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {id_kind}, " + ", ".join(f"p_{c} double" for c in CATEGORIES) + f", rejected boolean, rest {kind}")
