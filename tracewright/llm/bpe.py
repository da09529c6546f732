"""Byte-level BPE encoding and decoding with the ranks of a public vocabulary file.

A slice of texts is cut by the vocabulary's pattern and each distinct piece is encoded once. Pieces are put
into padded matrices by length. In each round every row merges its leftmost pair of least rank: pairs are
looked up in a hash table, the pair becomes one token and the row closes the gap. Rows without a mergeable
pair leave the matrix. Matrices are cut by cells, so memory stays bounded.

Cases: null texts are empty and have no tokens; the digests are those of no bytes then; equal rows give
equal results; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tracewright.llm.batches import among, byte_slices, spread, text_column, word_hashes

NO_RANK = np.int32(0x7FFFFFFF)
#: Matrix cells of one merge batch, and pieces a worker remembers between slices.
CELLS = 1 << 20
REMEMBERED = 1_000_000
#: The pattern that the vectorised cut follows; texts of vocabularies with another one are cut by it directly.
CLASS_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LETTER, _NUMBER, _SPACE, _OTHER = 1, 2, 3, 4
_PAIR = np.uint64(0x9E3779B97F4A7C15)
_FREE = np.uint64(0xFFFFFFFFFFFFFFFF)


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a file of base64 tokens and numbers."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class PairTable:
    """Hash table with linear probing from two token ids to the rank of the token they make."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        bits = max(4, int(len(left) * 4).bit_length())
        self.shift, self.wrap = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, _FREE)
        self.ranks = np.full(1 << bits, NO_RANK, np.int32)
        keys = self._key(left, right)
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            free = todo[self.keys[slot[todo]] == _FREE]
            self.keys[slot[free]] = keys[free]
            mine = self.keys[slot[todo]] == keys[todo]
            self.ranks[slot[todo[mine]]] = rank[todo[mine]]
            todo = todo[~mine]
            slot[todo] = (slot[todo] + 1) & self.wrap

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _PAIR) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NO_RANK where it makes no token or a side is padding."""
        out = np.full(left.size, NO_RANK, np.int32)
        todo = np.flatnonzero(((left >= 0) & (right >= 0)).ravel())
        key = self._key(left.ravel()[todo], right.ravel()[todo])
        slot = self._slot(key)
        while len(todo):
            there = self.keys[slot]
            hit = there == key
            out[todo[hit]] = self.ranks[slot[hit]]
            go = ~hit & (there != _FREE)
            todo, key, slot = todo[go], key[go], (slot[go] + 1) & self.wrap
        return out.reshape(left.shape)


def character_classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    table = np.full(0x110000, _OTHER, np.uint8)
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    skipped = 0x800
    for pattern, value in ((r"\p{L}+", _LETTER), (r"\p{N}+", _NUMBER), (r"\s+", _SPACE)):
        for m in regex.finditer(pattern, every):
            low, high = m.span()
            low, high = low + skipped * (low >= 0xD800), high + skipped * (high > 0xD800)
            table[low:high] = value
    return table


def class_cut(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """First byte of every match of CLASS_PATTERN in texts laid end to end."""
    if not len(data):
        return np.zeros(0, np.int64)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    n = len(lead)
    point = data[lead].astype(np.int64)
    size = np.diff(np.append(lead, len(data)))
    for width, keep in ((2, 0x1F), (3, 0x0F), (4, 0x07)):
        at = np.flatnonzero(size == width)
        value = point[at] & keep
        for k in range(1, width):
            value = (value << 6) | (data[lead[at] + k] & 0x3F)
        point[at] = value
    kind = classes[point]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    edge = edge[lead]
    begins = np.ones(n, bool)
    begins[1:] = (kind[1:] != kind[:-1]) | edge[1:]
    # The last white space before a word: a blank joins the word, another character stands alone.
    last = np.zeros(n, bool)
    last[:-1] = (kind[:-1] == _SPACE) & (kind[1:] != _SPACE) & ~edge[1:]
    begins |= last
    joins = np.flatnonzero(last & (point == 0x20))
    begins[joins + 1] = False
    # A lone apostrophe that begins a piece takes its ending from the letters behind it.
    quote = np.flatnonzero((point[:-1] == 0x27) & begins[:-1] & (kind[1:] == _LETTER) & ~edge[1:])
    if len(quote):
        padded = np.append(point, [0, 0])
        cut = np.append(edge, [True, True])
        one, two = padded[quote + 1], np.where(cut[quote + 2], 0, padded[quote + 2])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        short = (one == ord("s")) | (one == ord("t")) | (one == ord("m")) | (one == ord("d"))
        quote, width = quote[short | long], np.where(short, 1, 2)[short | long]
        begins[quote + 1] = False
        rest = quote + 1 + width
        ok = rest < n
        begins[rest[ok]] = True
    return lead[begins]


class Bpe:
    """Encoder and decoder for one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = regex.compile(pattern)
        self.classes = character_classes() if pattern == CLASS_PATTERN else None
        tokens = sorted(ranks, key=ranks.get)
        number = np.array([ranks[t] for t in tokens], np.int64)
        self.token_start = np.zeros(number.max() + 1, np.int64)
        self.token_size = np.zeros(number.max() + 1, np.int64)
        size = np.array([len(t) for t in tokens])
        end = np.cumsum(size)
        self.token_start[number], self.token_size[number] = end - size, size
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.byte_id = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        whole = word_hashes(self.token_bytes, end - size, end)
        order = np.argsort(whole)
        self.whole, self.whole_rank = whole[order], number[order].astype(np.int32)
        pairs = [(ranks[t[:k]], ranks[t[k:]], ranks[t]) for t in tokens for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        self.pairs = PairTable(*np.array(pairs, np.int64).reshape(-1, 3).T)
        self._forget()

    def _forget(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.at, self.count, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def cut(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """First byte of every piece of the texts laid end to end."""
        if self.classes is not None:
            return class_cut(data, offsets, self.classes)
        starts = []
        for a, b in zip(offsets[:-1], offsets[1:]):
            sizes = [len(m.encode()) for m in (x[0] for x in self.pattern.finditer(data[a:b].tobytes().decode()))]
            starts.append(a + np.cumsum([0, *sizes[:-1]]) if sizes else np.zeros(0, np.int64))
        return np.concatenate(starts).astype(np.int64)

    def merge_rows(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of every row, and all ids in row order; rows are padded with -1 on the right."""
        rows = np.arange(len(tokens))
        count = np.zeros(len(tokens), np.int64)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank = self.pairs.find(tokens[:, :-1], tokens[:, 1:])
        while len(rows):
            lines = np.arange(len(rows))
            at = rank.argmin(1) if rank.shape[1] else np.zeros(len(rows), np.int64)
            least = rank[lines, at] if rank.shape[1] else np.full(len(rows), NO_RANK)
            live = least != NO_RANK
            if not live.all():
                mask = tokens[~live] >= 0
                count[rows[~live]] = mask.sum(1)
                done.append((rows[~live], tokens[~live][mask]))
                rows, tokens, rank, at, least = rows[live], tokens[live], rank[live], at[live], least[live]
                if not len(rows):
                    break
                lines = lines[:len(rows)]
            tokens[lines, at] = least
            keep = np.ones(tokens.shape, bool)
            keep[lines, at + 1] = False
            tokens = tokens[keep].reshape(len(rows), -1)
            keep = np.ones(rank.shape, bool)
            keep[lines, at] = False
            rank = rank[keep].reshape(len(rows), -1)
            for side in (at - 1, at):
                ok = np.flatnonzero((side >= 0) & (side < rank.shape[1]))
                rank[ok, side[ok]] = self.pairs.find(tokens[ok, side[ok]], tokens[ok, side[ok] + 1])
        begin = np.cumsum(count) - count
        flat = np.zeros(int(count.sum()), np.int32)
        for which, ids in done:
            flat[spread(begin[which], count[which])] = ids
        return count, flat

    def _learn(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, hashes: np.ndarray) -> None:
        """Encode new pieces and remember them by hash."""
        place = np.searchsorted(self.whole, hashes)
        whole = self.whole[np.minimum(place, len(self.whole) - 1)] == hashes
        order = np.concatenate([np.flatnonzero(whole), (rest := np.flatnonzero(~whole))[np.argsort(size[rest], kind="stable")]])
        counts, flats = [np.ones(whole.sum(), np.int64)], [self.whole_rank[place[whole]]]
        first, n_whole = int(whole.sum()), len(order)
        sizes = size[order]
        while first < n_whole:
            most = int(np.searchsorted(sizes[first:], sizes[first] + sizes[first] // 4, side="right"))
            fit = int(np.searchsorted(sizes[first:first + most] * np.arange(1, most + 1), CELLS, side="right"))
            end = first + max(1, min(most, fit))
            mine, width = order[first:end], int(sizes[end - 1])
            column = np.arange(width)
            tokens = np.where(column < size[mine][:, None], self.byte_id[data[np.minimum(start[mine][:, None] + column, len(data) - 1)]], -1)
            count, flat = self.merge_rows(tokens.astype(np.int32))
            counts.append(count)
            flats.append(flat)
            first = end
        count = np.concatenate(counts)
        at = len(self.flat) + np.cumsum(count) - count
        self.flat = np.concatenate([self.flat, *flats])
        known = np.concatenate([self.known, hashes[order]])
        sort = np.argsort(known, kind="stable")
        self.known, self.at, self.count = known[sort], np.concatenate([self.at, at])[sort], np.concatenate([self.count, count])[sort]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts laid end to end, and the number of ids of each text."""
        start = self.cut(data, offsets)
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        end = np.append(start[1:], len(data))
        hashes, first, which = np.unique(word_hashes(data, start, end), return_index=True, return_inverse=True)
        if len(self.known) + len(hashes) > REMEMBERED:
            self._forget()
        new = ~among(hashes, self.known)
        if new.any():
            self._learn(data, start[first[new]], (end - start)[first[new]], hashes[new])
        place = np.searchsorted(self.known, hashes)[which]
        count = self.count[place]
        ids = self.flat[spread(self.at[place], count)].astype("<u4")
        row = np.searchsorted(offsets, start, side="right") - 1
        return ids, np.bincount(row, weights=count, minlength=len(offsets) - 1).astype(np.int64)

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes that the ids stand for."""
        return self.token_bytes[spread(self.token_start[ids], self.token_size[ids])].tobytes()


_made: dict[tuple, Bpe] = {}


def coder(ranks_path: str, pattern: str) -> Bpe:
    """The worker's encoder for a vocabulary file."""
    if (ranks_path, pattern) not in _made:
        _made[ranks_path, pattern] = Bpe(read_ranks(ranks_path), pattern)
    return _made[ranks_path, pattern]


def _encoded(batch: pa.RecordBatch, bpe: Bpe):
    """(first row, ids per text) of a batch."""
    for first, end, data, offsets in byte_slices(text_column(batch)):
        ids, count = bpe.encode(data, offsets)
        stop = np.cumsum(count)
        yield first, [ids[a:b] for a, b in zip(stop - count, stop)]


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id and its token ids as little-endian unsigned 32-bit integers."""
    def run(batches):
        for batch in batches:
            for first, ids in _encoded(batch, coder(ranks_path, pattern)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(ids)), pa.array([x.tobytes() for x in ids], pa.binary())], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id and the text its ids stand for."""
    def run(batches):
        bpe = coder(ranks_path, pattern)
        for batch in batches:
            texts = [bpe.decode(np.frombuffer(x.as_py() or b"", "<u4")).decode("utf-8", "replace") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def encode_digests(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """Count and digest of the ids of each text, digest of the bytes they decode to, and the ids themselves if asked."""
    def run(batches):
        bpe = coder(ranks_path, pattern)
        for batch in batches:
            for first, ids in _encoded(batch, bpe):
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, len(ids)), pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids]),
                    pa.array([hashlib.sha256(bpe.decode(x)).hexdigest() for x in ids]),
                    *([pa.array([x.tobytes() for x in ids], pa.binary())] if with_ids else []),
                ], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else [])])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids)
