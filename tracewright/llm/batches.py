"""Arrow batches of texts as numpy arrays: byte slices, words and rolling hashes.

Tasks work on slices of a few megabytes, so memory stays bounded whatever the batch size; one text is
never cut. Hashes of windows are polynomials modulo 2**64 over random byte values, mixed afterwards; unlike strings
of 1,024 bytes and more can be built that share one, so words and pieces of any length are mixed block by block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE_VALUE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TERM = np.random.default_rng(7).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, at least n + 1 of each."""
    if not _powers or len(_powers[0]) <= n:
        size = max(n + 1, SLICE_BYTES + 1)
        made = []
        for factor in (_BASE, _INVERSE):
            steps = np.full(size, factor, np.uint64)
            steps[0] = 1
            made.append(np.cumprod(steps))
        _powers[:] = made
    return _powers[0], _powers[1]


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """Spread every input bit over all 64 output bits; one-to-one for a given salt."""
    h = h + np.uint64((salt * 0x9E3779B97F4A7C15) % (1 << 64))
    shifted = h >> np.uint64(30)
    h ^= shifted
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= np.right_shift(h, np.uint64(27), out=shifted)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= np.right_shift(h, np.uint64(31), out=shifted)
    return h


def span_sums(code: np.ndarray) -> np.ndarray:
    """Sums of the polynomial before every place, of which the hashes of spans are differences."""
    sums = np.zeros(len(code) + 1, np.uint64)
    terms = _BYTE_VALUE[code]
    terms *= powers(len(code))[0][:len(code)]
    np.cumsum(terms, out=sums[1:])
    return sums


def span_hashes(code: np.ndarray, start: np.ndarray, end: np.ndarray, sums: np.ndarray | None = None) -> np.ndarray:
    """64-bit hashes of code[start:end], equal for equal bytes wherever they stand; ``sums`` of the code, if they are known."""
    sums = span_sums(code) if sums is None else sums
    return mix((sums[end] - sums[start]) * powers(len(code))[1][start])


def gram_spans(code: np.ndarray, size: int, sums: np.ndarray | None = None) -> np.ndarray:
    """``span_hashes`` of the ``size`` bytes from every place that has so many."""
    sums = span_sums(code) if sums is None else sums
    spans = sums[size:] - sums[:len(sums) - size]
    spans *= powers(len(code))[1][:len(spans)]
    return mix(spans)


#: Spans longer than this many bytes are hashed by a cryptographic function.
LONG_SPAN = 256
_HEAD = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)


def word_hashes(code: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of code[start:end], equal for equal bytes wherever they stand; lengths may differ by much.

    Spans take in eight bytes a round, each round over those that have more to give.
    """
    blocks = np.ndarray((len(code) + 1,), "<u8", np.concatenate([code, np.zeros(8, np.uint8)]).tobytes(), strides=(1,))
    size = end - start
    h = mix(size.astype(np.uint64), 5)
    todo = np.flatnonzero((size > 0) & (size <= LONG_SPAN))
    at, left = start[todo], size[todo]
    while len(todo):
        h[todo] = mix(h[todo] ^ (blocks[at] & _HEAD[np.minimum(left, 8)]))
        more = left > 8
        todo, at, left = todo[more], at[more] + 8, left[more] - 8
    for k in np.flatnonzero(size > LONG_SPAN):
        h[k] = int.from_bytes(hashlib.blake2b(code[start[k]:end[k]].tobytes(), digest_size=8).digest(), "little")
    return h


def text_column(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """The column with null texts as empty ones."""
    return pc.fill_null(batch.column(batch.schema.get_field_index(name)).cast(pa.large_string()), "")


def byte_slices(texts: pa.Array, limit: int = SLICE_BYTES, most_rows: int = 8192) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows of about ``limit`` bytes, at least a row each."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        end = max(first + 1, min(first + most_rows, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1))
        yield first, end, data[offsets[first]:offsets[end]], offsets[first:end + 1] - offsets[first]
        first = end


def word_table(keep: str | bytes) -> np.ndarray:
    """Byte table for words made of ``keep``: ASCII capitals folded, 0 for separators."""
    table = np.zeros(256, np.uint8)
    for b in keep.encode() if isinstance(keep, str) else keep:
        table[b] = b + 32 if 65 <= b <= 90 else b
    return table


#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z are folded.
ALNUM = word_table(bytes([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]))
#: ``[^\x20\x09-\x0D]+`` after A-Z are folded. NUL is a word byte, so it is told apart by another value.
NONSPACE = word_table(bytes(b for b in range(256) if b != 0x20 and not 0x09 <= b <= 0x0D))
NONSPACE[0] = 0x20


class Words:
    """Words of a slice: byte ``start`` and ``end``, ``row``, 64-bit ``hash``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray):
        code = table[data]
        inside = code != 0
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before = np.zeros(len(data), bool)
        before[1:] = inside[:-1]
        self.start = np.flatnonzero(inside & (~before | edge[:-1]))
        after = np.zeros(len(data), bool)
        after[:-1] = inside[1:]
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.row = np.searchsorted(offsets, self.start, side="right") - 1
        self.hash = word_hashes(code, self.start, self.end)

    def per_row(self, rows: int) -> np.ndarray:
        return np.bincount(self.row, minlength=rows)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of n consecutive words by first word, and whether all lie in one row."""
        if len(self.hash) < n:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        count = len(self.hash) - n + 1
        total = np.zeros(count, np.uint64)
        for j in range(n):
            total += self.hash[j:j + count] * _TERM[j % 64] + np.uint64(j // 64)
        return mix(total, n), self.row[:count] == self.row[n - 1:]


def window_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling."""
    have, out = 1, values
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < width:
        out = np.minimum(out[:len(out) - (width - have)], out[width - have:])
    return out


def among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Whether each value is in a sorted array, which may be much the larger one."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1, ... count times for each entry."""
    total = int(count.sum())
    return np.repeat(start - (np.cumsum(count) - count), count) + np.arange(total)
