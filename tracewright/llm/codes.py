"""Vector code compression: product quantisation in exact integers.

Components become integers floor(scale * x), vectors are cut into equal parts, and each part position has a
codebook that some rounds of assignment and floored means improve. All arithmetic is exact, so results do not
depend on how rows are dealt. Distances come from dot products by matrix multiplication: integers are broken
into limbs of ``LIMB_BITS`` bits, products of limbs are summed by float64 BLAS below 2**53 (for parts of up to
2**33 components), and the sums are shifted and recombined in int64; the first least distance gives the code.

The codebooks (parts x entries vectors) are all that goes through the driver. A round reads the table, sums the
parts of each entry within a task and adds up one row a task and entry; nothing is shuffled by vector.

Cases: vectors that are null or hold null or non-finite components are dropped; shorter vectors count as followed by zeros
up to the longest one's length, rounded up to whole parts; components are bounded at +-``most_of(width)``, far
beyond 100,000 for vectors of up to 512 components, so that distances stay in 64 bits; a null id is kept but
starts no codebook before all others; rows that share an id are vectors of their own, put in order by the vector; fewer
vectors than entries give smaller codebooks; an error summed over a label stops at the largest long; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.functions.skew import join_counted
from tracewright.session import cut_lineage

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
LIMB_BITS = 10
#: Rows of one matrix product.
KERNEL_ROWS = 4096


def most_of(width: int) -> int:
    """The largest component whose squared distances over ``width`` components stay below 2**62."""
    return math.isqrt((1 << 62) // max(width, 1)) // 2


def integers(column: pa.Array, width: int, scale: int = SCALE) -> np.ndarray:
    """Vectors as rows of ``width`` integers, zeros after shorter ones."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    most = most_of(width)
    out = np.zeros((len(sizes), width), np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out[np.arange(width) < sizes[:, None]] = np.clip(np.floor(flat * scale), -most, most).astype(np.int64)
    return out


def limbs(values: np.ndarray, bits: int = LIMB_BITS) -> list[np.ndarray]:
    """Float matrices l0, l1, ... with values = l0 + l1 * 2**bits + ...; the last one carries the sign."""
    out = []
    while True:
        if len(values) == 0 or (values.min() >= -(1 << bits) and values.max() < 1 << bits):
            return [*out, values.astype(np.float64)]
        out.append((values & ((1 << bits) - 1)).astype(np.float64))
        values = values >> bits


def dot_products(left: list[np.ndarray], right: list[np.ndarray], bits: int = LIMB_BITS) -> np.ndarray:
    """Exact products of all rows of two matrices given by their limbs, in int64."""
    total = np.zeros((len(left[0]), len(right[0])), np.int64)
    for i, a in enumerate(left):
        for j, b in enumerate(right):
            total += (a @ b.T).astype(np.int64) << (bits * (i + j))
    return total


class Codebooks:
    """One matrix of entries a part position, with its limbs and squared norms."""

    def __init__(self, entries: list[np.ndarray]):
        self.entries = entries
        self.limbs = [limbs(e) for e in entries]
        self.norms = [(e * e).sum(1) for e in entries]

    def assign(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows x parts) first nearest entries and their squared distances."""
        size = vectors.shape[1] // len(self.entries)
        codes = np.zeros((len(vectors), len(self.entries)), np.int64)
        errors = np.zeros_like(codes)
        for low in range(0, len(vectors), KERNEL_ROWS):
            rows = slice(low, low + KERNEL_ROWS)
            for p in range(len(self.entries)):
                x = vectors[rows, p * size:(p + 1) * size]
                away = self.norms[p] - 2 * dot_products(limbs(x), self.limbs[p])
                codes[rows, p] = away.argmin(1)
                errors[rows, p] = away.min(1) + (x * x).sum(1)
        return codes, errors


def _sums(rows: DataFrame, books: Codebooks, width: int, scale: int) -> DataFrame:
    """(part, entry, n, total) summed over all rows; a task sends one row for each entry it used."""
    parts, entries, size = len(books.entries), len(books.entries[0]), width // len(books.entries)

    def run(batches):
        total, n = np.zeros((parts * entries, size), np.int64), np.zeros(parts * entries, np.int64)
        for batch in batches:
            x = integers(batch.column(0), width, scale)
            at = (books.assign(x)[0] + np.arange(parts) * entries).ravel()
            order = np.argsort(at, kind="stable")
            used, first = np.unique(at[order], return_index=True)
            if len(used):
                total[used] += np.add.reduceat(x.reshape(-1, size)[order], first)
                n += np.bincount(at, minlength=len(n))
        some = np.flatnonzero(n)
        flat = pa.array(total[some].ravel())
        yield pa.RecordBatch.from_arrays(
            [pa.array(some // entries, pa.int32()), pa.array(some % entries, pa.int32()), pa.array(n[some]),
             pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * size, pa.int32()), flat)],
            names=["part", "entry", "n", "total"])

    made = rows.select("embedding").mapInArrow(run, "part int, entry int, n long, total array<long>")
    return made.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[i]) for i in range(size)]).alias("total"))


def sound(vectors: DataFrame) -> DataFrame:
    """Rows whose vector is there and all finite."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.where(F.col("embedding").isNotNull() & F.coalesce(finite, F.lit(False)))


def train(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> tuple[Codebooks | None, int]:
    """Codebooks of (vec_id, embedding) after some rounds, and the width vectors are brought to; none for an empty table."""
    rows = sound(vectors)
    longest = rows.agg(F.max(F.size("embedding"))).first()[0]
    if longest is None:
        return None, 0
    width = parts * max(1, -(-longest // parts))
    size = width // parts
    begun = rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").limit(entries).select("embedding").toArrow()
    first = integers(begun.column(0).combine_chunks(), width, scale)
    books = Codebooks([first[:, p * size:(p + 1) * size] for p in range(parts)])
    for _ in range(rounds):
        fresh = [e.copy() for e in books.entries]
        for r in _sums(rows, books, width, scale).collect():
            fresh[r["part"]][r["entry"]] = [t // r["n"] for t in r["total"]]
        books = Codebooks(fresh)
    return books, width


def encode(vectors: DataFrame, books: Codebooks, width: int, scale: int = SCALE) -> DataFrame:
    """vec_id, label, codes, error of every sound vector."""
    def run(batches):
        for batch in batches:
            codes, errors = books.assign(integers(batch.column(2), width, scale))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1) * codes.shape[1], pa.int32()), pa.array(codes.ravel().astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), flat, pa.array(errors.sum(1))], names=["vec_id", "label", "codes", "error"])

    rows = sound(vectors).select("vec_id", "label", "embedding")
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    return rows.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, codes array<int>, error long")


def compress(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every sound row of (vec_id, embedding, label).

    code has the entry of each part as hex digits, two for up to 256 entries. Labels may be of any kind; one
    that many rows share is summed before the shuffle, and its sum goes back to its rows without one.
    """
    books, width = train(vectors, parts, entries, rounds, scale)
    if books is None:
        return vectors.sparkSession.createDataFrame([], f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, code string, error long, label_error long, codebooks_sha256 string")
    listed = ",".join(str(x) for e in books.entries for x in e.ravel().tolist())
    digits = max(2, len(f"{entries - 1:x}"))
    coded = cut_lineage(encode(vectors, books, width, scale).withColumn("key", F.when(F.col("label").isNull(), "").otherwise(F.concat(F.lit("="), F.col("label").cast("string")))).drop("label"))
    most = F.lit((1 << 63) - 1).cast("decimal(38,0)")
    sums = coded.groupBy("key").agg(
        F.least(F.sum(F.col("error").cast("decimal(19,0)")).cast("decimal(38,0)"), most).cast("long").alias("label_error"), F.count(F.lit(1)).alias("n"))
    hexed = F.array_join(F.transform("codes", lambda c: F.lpad(F.lower(F.hex(c)), digits, "0")), "")
    return join_counted(coded, sums, "key", "n", salt=["vec_id", "error"]).select(
        "vec_id", hexed.alias("code"), "error", "label_error", F.lit(hashlib.sha256(listed.encode()).hexdigest()).alias("codebooks_sha256"))
