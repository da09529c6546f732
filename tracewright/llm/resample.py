"""Importance resampling of documents towards a target distribution.

Features are runs of consecutive words. Their bucket is a checksum of their bytes, and the counts of all
buckets in the documents and in the target give each bucket a gain: 1000 times the logarithm of how much
likelier the target is to hold it. A document weighs the mean gain of its features; noise drawn from its id
(Gumbel) turns the highest weights into a sample without replacement, which is the same on every run.

Checksums work on the distinct features of a slice of texts: those of one byte length form a matrix of bytes,
the CRCs of all its rows advance column by column, and the buckets are scattered back to the places of the
features. What reaches the driver is bounded: two counts a bucket, and one count for each whole score, of which
there are less than 200,000 (weights and noise are thousandths of logarithms of 64-bit counts).

Cases: null and empty texts have no features, weigh 0 and are never drawn unless ``least_words`` is 0; a null id
draws its noise as the empty string and comes last among ties; rows that share an id are rows of their own, ties
among them go to the smaller weight, then to fewer features; a very long text is one slice, of which a task holds
some thirty times the bytes; a word of n bytes takes n steps of its own length's matrix; an empty target gives every bucket
the gain of an unseen one; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.batches import ALNUM, byte_slices, text_column
from tracewright.session import cut_lineage

BUCKETS = 10_000
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10


def _crc_table() -> np.ndarray:
    """The byte table of the reflected CRC-32 of polynomial 0xEDB88320."""
    crc = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        crc = (crc >> np.uint32(1)) ^ np.where(crc & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return crc


_TABLE = _crc_table()


def matrix_crc(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of every data[start:start + length], one matrix for each length."""
    out = np.zeros(len(start), np.uint32)
    order = np.argsort(length, kind="stable")
    sizes, first = np.unique(length[order], return_index=True)
    for size, members in zip(sizes, np.split(order, first[1:])):
        columns = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, size)[start[members]].T) if size else ()
        crc = np.full(len(members), 0xFFFFFFFF, np.uint32)
        for column in columns:
            crc = _TABLE[(crc ^ column) & np.uint32(255)] ^ (crc >> np.uint32(8))
        out[members] = crc ^ np.uint32(0xFFFFFFFF)
    return out


class Features:
    """Words and features of a slice: ``words`` a row; ``row`` and ``bucket`` of every feature."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, sizes: tuple[int, int], buckets: int):
        rows = len(offsets) - 1
        code = np.insert(ALNUM[data], offsets[1:], 0)  # a separator ends every row
        inside = code != 0
        edge = np.flatnonzero(np.diff(inside, prepend=False))
        start, end = edge[::2], edge[1::2]
        word_row = np.searchsorted(offsets + np.arange(rows + 1), start, side="right") - 1
        self.words = np.bincount(word_row, minlength=rows)
        # Words one after the other, a space after each: features are spans of this text.
        taken = inside.copy()
        taken[end] = True
        text = np.where(inside, code, np.uint8(32))[taken]
        place = np.concatenate([[0], np.cumsum(end - start + 1)]).astype(np.int64)
        count = len(start)
        single = pa.LargeBinaryArray.from_buffers(pa.large_binary(), count, [None, pa.py_buffer(place), pa.py_buffer(text)]).dictionary_encode()
        ids = one = single.indices.to_numpy().astype(np.int64)
        found_rows, found = [], []
        for n in range(1, sizes[1] + 1):
            if n > 1:  # a run is the run of one word less and its last word
                whole = len(one) - n + 1
                if whole < 1:
                    break
                _, ids = np.unique(ids[:whole] * len(single.dictionary) + one[n - 1:], return_inverse=True)
            if n < sizes[0] or not len(ids):
                continue
            first = np.empty(int(ids.max()) + 1, np.int64)
            first[ids[::-1]] = np.arange(len(ids))[::-1]
            bucket = matrix_crc(text, place[first], place[first + n] - 1 - place[first]) % np.uint32(buckets)
            together = word_row[:len(ids)] == word_row[n - 1:]
            found_rows.append(word_row[:len(ids)][together])
            found.append(bucket[ids][together])
        self.row = np.concatenate(found_rows) if found else np.zeros(0, np.int64)
        self.bucket = np.concatenate(found).astype(np.int64) if found else np.zeros(0, np.int64)


def _slices(batch: pa.RecordBatch, sizes: tuple[int, int], buckets: int) -> Iterator[tuple[int, int, Features]]:
    for first, end, data, offsets in byte_slices(text_column(batch)):
        yield first, end, Features(data, offsets, sizes, buckets)


def bucket_counts(texts: DataFrame, sizes: tuple[int, int] = (1, 1), buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts each bucket holds; a task sends one count a bucket."""
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, features in _slices(batch, sizes, buckets):
                total += np.bincount(features.bucket, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln(target share / source share)) of every bucket, one added to each count."""
    size, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.array([
        math.floor(1000 * math.log(float((t + 1) * (s_all + size)) / float((s + 1) * (t_all + size))))
        for s, t in zip(source.tolist(), target.tolist())], np.int64)


def weigh(docs: DataFrame, gains: np.ndarray, sizes: tuple[int, int] = (1, 1)) -> DataFrame:
    """doc_id, n_words, n_features, weight of every document."""
    buckets = len(gains)

    def run(batches):
        for batch in batches:
            for first, end, f in _slices(batch, sizes, buckets):
                n = np.bincount(f.row, minlength=end - first)
                total = np.zeros(end - first, np.int64)
                np.add.at(total, f.row, gains[f.bucket])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, end - first), *(pa.array(x.astype(np.int64)) for x in (f.words, n, np.floor_divide(total, np.maximum(n, 1))))],
                    names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_features long, weight long")


def resample(
    docs: DataFrame, target: DataFrame, sizes: tuple[int, int] = (1, 1), buckets: int = BUCKETS, seed: int = SEED,
    least_words: int = LEAST_WORDS, percent: int = PERCENT,
) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; the drawn ones have a rank.

    Of the documents with ``least_words`` or more words, ``percent`` in a hundred of the highest scores are
    drawn. ``sizes`` are the least and the most words of a feature.
    """
    spark = docs.sparkSession
    gains = bucket_gains(bucket_counts(docs, sizes, buckets), bucket_counts(target, sizes, buckets))
    luck = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((luck + 0.5) / 4294967296.0)))
    scored = cut_lineage(weigh(docs, gains, sizes).withColumn("score", F.col("weight") + noise))
    rivals = F.col("n_words") >= least_words
    counts = sorted(((r[0], r[1]) for r in scored.where(rivals).groupBy("score").count().collect()), reverse=True)
    wanted = percent * sum(n for _, n in counts) // 100
    before, starts = 0, []
    for score, n in counts:
        if before >= wanted:
            break
        starts.append((score, before))
        before += n
    out = [F.col(c) for c in ("doc_id", "n_features", "weight", "score")]
    if not starts:
        return scored.select(*out, F.lit(None).cast("long").alias("rank"))
    ahead = rivals & (F.col("score") >= starts[-1][0])
    among = Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "weight", "n_features")
    place = F.col("before") + F.row_number().over(among)
    first = scored.where(ahead).join(F.broadcast(spark.createDataFrame(starts, "score long, before long")), "score")
    return first.select(*out, F.when(place <= wanted, place).alias("rank")).unionByName(
        scored.where(~ahead).select(*out, F.lit(None).cast("long").alias("rank")))
