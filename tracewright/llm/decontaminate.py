"""Benchmark decontamination by winnowing.

Both sides keep the smallest hash of each window of ``window - gram + 1`` consecutive word k-grams (all
ties), so two texts that share ``window`` words in a row share a kept hash. Kept hashes are joined and each
hit is extended to the windows of the item that hold it; a document word inside such a window is hit.

Cases: null and empty texts have no words and give a row of zeros; an item with fewer than ``window`` words
is one window; items without words or without id match nothing; equal rows give equal results; items that
share an id count once; a text is never cut, and a task holds some thirty times the bytes of a very long one; other
columns are ignored; an empty benchmark contaminates nothing.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.batches import ALNUM, Words, among, byte_slices, mix, text_column, window_min

WINDOW = 10
GRAM = 5
#: A word before capitals are folded.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Benchmarks of at most so many text bytes are sent to every task; larger ones are joined by a shuffle.
BROADCAST_BYTES = 32 << 20


def kept(words: Words, gram: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """k-gram hashes and the mask of those that are the minimum of some window inside one row."""
    hashes, _ = words.grams(gram)
    mask = np.zeros(len(hashes), bool)
    if len(words.hash) >= window:
        least = window_min(hashes, window - gram + 1)
        whole = words.row[:len(least)] == words.row[window - 1:]
        for d in range(window - gram + 1):
            mask[d:d + len(least)] |= whole & (hashes[d:d + len(least)] == least)
    return hashes, mask


class ItemIndex:
    """Kept hashes and windows of a bounded benchmark; each distinct window knows the list of its items.

    Windows of one passage have one list however many items hold it, so a text that repeats a template of thousands of
    items meets their list once, not once a word.
    """

    def __init__(self, ids: list, texts: list[str], gram: int, window: int):
        self.ids, which = np.unique(np.array([str(i) for i in ids], object), return_inverse=True) if ids else (np.zeros(0, object), np.zeros(0, np.int64))
        self.gram, self.window = gram, window
        column = pa.array(texts, pa.large_string())
        known, found = [], {}
        for first, end, data, offsets in byte_slices(column):
            words = Words(data, offsets, ALNUM)
            counts = words.per_row(end - first)
            hashes, mask = kept(words, gram, window)
            known.append(hashes[mask])
            for n in [window, *np.unique(counts[(counts > 0) & (counts < window)])]:
                here, whole = words.grams(int(n))
                row = words.row[:len(here)]
                at = np.flatnonzero(whole & ((counts[row] == n) | (n == window)))
                found.setdefault(int(n), []).append((here[at], which[row[at] + first]))
        self.known = np.unique(np.concatenate(known)) if known else np.zeros(0, np.uint64)
        self.windows: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.lists: list[np.ndarray] = []
        for n, parts in found.items():
            hashes, items = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((items, hashes))
            hashes, items = hashes[order], items[order]
            new = np.ones(len(hashes), bool)
            new[1:] = (hashes[1:] != hashes[:-1]) | (items[1:] != items[:-1])
            hashes, items = hashes[new], items[new]
            if not len(hashes):
                continue
            each, begin = np.unique(hashes, return_index=True)
            stop = np.append(begin[1:], len(hashes))
            alike = mix(np.add.reduceat(mix(items.astype(np.uint64), 3), begin) + (stop - begin).astype(np.uint64))
            _, one, list_of = np.unique(alike, return_index=True, return_inverse=True)
            self.windows[n] = each, list_of + len(self.lists)
            self.lists += [items[begin[i]:stop[i]] for i in one]
        self._names: dict[tuple, tuple[int, str]] = {}

    def spans(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word, number of words and list of items of every window of an item that occurs in the words."""
        out = []
        for n, (each, list_of) in self.windows.items():
            here, whole = words.grams(n)
            at = np.flatnonzero(whole)
            if n == self.window:  # only windows around a kept hash that the items keep too
                hashes, mask = kept(words, self.gram, self.window)
                hit = np.flatnonzero(mask)
                hit = hit[among(hashes[hit], self.known)]
                near = np.zeros(len(here) + self.window, bool)
                for back in range(self.window - self.gram + 1):
                    near[np.maximum(hit - back, 0)] = True
                at = np.flatnonzero(whole & near[:len(here)])
            at = at[among(here[at], each)]
            out.append((at, np.full(len(at), n), list_of[np.searchsorted(each, here[at])]))
        if not out:
            none = np.zeros(0, np.int64)
            return none, none, none
        return tuple(np.concatenate(x) for x in zip(*out))

    def named(self, lists: tuple[int, ...]) -> tuple[int, str]:
        """Number and digest of the items of some lists."""
        if lists not in self._names:
            if len(self._names) >= 4096:
                self._names.clear()
            items = np.unique(np.concatenate([self.lists[k] for k in lists])) if lists else []
            self._names[lists] = len(items), digest(self.ids[items]) if lists else digest([])
        return self._names[lists]


def digest(ids) -> str:
    return hashlib.sha256(",".join(sorted(set(ids))).encode()).hexdigest()


SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()),
                    ("items_sha256", pa.string()), ("contaminated", pa.bool_())])


def _by_broadcast(docs: DataFrame, items: DataFrame, gram: int, window: int) -> DataFrame:
    rows = items.collect()  # at most BROADCAST_BYTES, as checked by the caller
    index = docs.sparkSession.sparkContext.broadcast(ItemIndex([r[0] for r in rows], [r[1] for r in rows], gram, window))

    def search(batches):
        found = index.value
        for batch in batches:
            for first, end, data, offsets in byte_slices(text_column(batch)):
                rows = end - first
                words = Words(data, offsets, ALNUM)
                start, length, lists = found.spans(words)
                change = np.zeros(len(words.hash) + 1, np.int64)
                np.add.at(change, start, 1)
                np.add.at(change, start + length, -1)
                hit = np.cumsum(change[:-1]) > 0
                n_hit = np.bincount(words.row[hit], minlength=rows)
                met = np.unique(np.stack([words.row[start], lists]), axis=1) if len(start) else np.zeros((2, 0), np.int64)
                edge = np.searchsorted(met[0], np.arange(rows + 1))
                names = [found.named(tuple(met[1, a:b].tolist())) for a, b in zip(edge[:-1], edge[1:])]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, rows), pa.array(words.per_row(rows), pa.int64()), pa.array(n_hit, pa.int64()),
                    pa.array([n for n, _ in names], pa.int64()), pa.array([d for _, d in names], pa.string()), pa.array(n_hit > 0),
                ], schema=_ARROW)

    return docs.mapInArrow(search, SCHEMA)


def _prints(df: DataFrame, key: str, gram: int, window: int, lengths: list[int], items: bool) -> DataFrame:
    """Kept hashes with the words around them, and whole grams of the short items' lengths."""
    reach = window - gram

    def cut(batches):
        for batch in batches:
            for first, end, data, offsets in byte_slices(text_column(batch)):
                words = Words(data, offsets, ALNUM)
                counts = words.per_row(end - first)
                begin = np.concatenate([[0], np.cumsum(counts)])[words.row]
                parts = []
                hashes, mask = kept(words, gram, window)
                at = np.flatnonzero(mask)
                around = at[:, None] + np.arange(-reach, window)[None, :]
                inside = (around >= begin[at][:, None]) & (around < (begin + counts[words.row])[at][:, None])
                near = np.where(inside, words.hash[np.clip(around, 0, max(len(words.hash) - 1, 0))], 0) if len(at) else np.zeros((0, window + reach), np.uint64)
                parts.append((at, np.zeros(len(at), np.int64), hashes[at], list(near.astype(np.int64))))
                for n in lengths:
                    hashes, whole = words.grams(n)
                    ok = whole & (counts[words.row[:len(hashes)]] == n) if items else whole
                    at = np.flatnonzero(ok)
                    parts.append((at, np.full(len(at), n), hashes[at], [np.zeros(0, np.int64)] * len(at)))
                for at, n, hashes, near in parts:
                    if len(at):
                        yield pa.RecordBatch.from_arrays([
                            batch.column(0).take(pa.array(words.row[at] + first)), pa.array(at - begin[at], pa.int64()), pa.array(n, pa.int64()),
                            pa.array(hashes.astype(np.int64)), pa.array(near, pa.list_(pa.int64())),
                        ], names=[key, "at", "n", "hash", "near"])

    kind = df.schema[0].dataType.simpleString()
    return df.mapInArrow(cut, f"{key} {kind}, at long, n long, hash long, near array<long>")


def _by_shuffle(docs: DataFrame, items: DataFrame, gram: int, window: int) -> DataFrame:
    reach = window - gram
    lengths = sorted(r[0] for r in items.select(F.regexp_count("text", F.lit(WORD)).alias("n")).where(f"n > 0 and n < {window}").distinct().collect())
    keyed = docs.select(F.struct("doc_id", F.xxhash64("text").alias("h")).alias("key"), "text")
    mine = _prints(keyed, "key", gram, window, lengths, False)
    theirs = _prints(items, "item", gram, window, lengths, True).select("item", "n", "hash", F.col("near").alias("theirs")).distinct()

    def extend(batches):
        for frame in batches:
            out = []
            for key, at, n, item, a, b in zip(frame["key"], frame["at"], frame["n"], frame["item"], frame["near"], frame["theirs"]):
                if n:
                    out.append((key, at, n, item))
                    continue
                same = (np.asarray(a) == np.asarray(b)) & (np.asarray(a) != 0)
                out += [(key, at - reach + s, window, item) for s in range(reach + 1) if same[s:s + window].all()]
            yield pd.DataFrame(out, columns=["key", "at", "n", "item"])

    spans = mine.join(theirs, ["n", "hash"]).select("key", "at", "n", "item", "near", "theirs").mapInPandas(
        extend, "key struct<doc_id: long, h: long>, at long, n long, item string")
    covered = "aggregate(array_sort(collect_set(struct(at, at + n as till))), named_struct('n', 0L, 'till', -1L), (s, x) -> named_struct('n', s.n + greatest(0L, x.till - greatest(x.at, s.till)), 'till', greatest(s.till, x.till)), s -> s.n)"
    found = spans.groupBy("key").agg(
        F.expr(covered).alias("n_hit"), F.array_sort(F.collect_set("item")).alias("items"))
    counted = keyed.mapInArrow(_count_words, "key struct<doc_id: long, h: long>, n_words long")
    return counted.join(found, counted["key"].eqNullSafe(found["key"]), "left").select(
        counted["key.doc_id"].alias("doc_id"), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(F.coalesce("items", F.array().cast("array<string>"))).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.concat_ws(",", "items"), F.lit("")).cast("binary"), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))


def _count_words(batches):
    for batch in batches:
        for first, end, data, offsets in byte_slices(text_column(batch)):
            counts = Words(data, offsets, ALNUM).per_row(end - first)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(counts, pa.int64())], names=["key", "n_words"])


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Words of each document inside windows of benchmark items: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    docs = docs.select("doc_id", "text")
    items = items.where("item_id is not null").select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    way = _by_broadcast if size <= broadcast_bytes else _by_shuffle
    return way(docs, items, gram, window)
