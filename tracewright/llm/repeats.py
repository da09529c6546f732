"""Repeated-substring removal by merged Burrows-Wheeler transforms.

Every byte covered by a string of ``length`` bytes that also starts earlier is removed; texts are judged as
they came in, and matches never cross documents.

Windows of ``length`` bytes are dealt by their minimizer, the smallest hash of ``gram`` bytes in them, so equal
windows meet. A run of windows with one minimizer is a piece of text. Minimizers that occur once are left
out: their windows are unique. Equal pieces are one, at its earliest place; later ones are removed whole. A
minimizer with one piece that holds it once has no other repeats; the pieces of all others are merged.
They are dealt to buckets of bounded size. A bucket sorts the suffixes of small shards, takes the shards'
transforms and merges them: an interleave of the shards is refined one symbol a round, by a stable sort of
the symbols before the suffixes, until suffixes are in order of their first ``length`` bytes. Blocks of the
interleave split as their common prefixes end, so the blocks of the last round are the repeated intervals.
In each, all windows but the earliest are covered. The windows of a minimizer with too many pieces for a
bucket are not merged: they are compared by a 128-bit hash of the whole window, which spreads them evenly.
Tasks know the minimizers they look for by a bitmap of bounded size, so pieces of no others are shuffled, but for a few that
only seem to be among them: these bring unique windows, which cost time and change nothing. What a step found is kept as
runs by document, and the shuffles behind it go before the next step begins.

Cases: null texts are empty; a very long text is read whole by one task, which holds some thirty times its bytes; texts under ``length`` bytes lose nothing; rows with equal doc_id and text are
one document; null ids come first; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.functions.skew import join_counted
from tracewright.llm.batches import among, byte_slices, gram_spans, span_hashes, span_sums, spread, text_column, window_min, word_hashes
from tracewright.session import cut_lineage, release

LENGTH = 100
#: Longer grams recur less by chance, but give more and shorter pieces, of which each holds LENGTH - 1 bytes of the next.
GRAM = 28
#: Bytes of a bucket, of one of its shards, and of a minimizer's pieces from which its windows are dealt singly.
BUCKET_BYTES = 1 << 20
SHARD_BYTES = 1 << 18
HOT_BYTES = 1 << 20
#: Bytes of texts that a task hashes at a time: few enough for a core's cache.
SLICE_BYTES = 1 << 17
#: Repeated minimizers that the driver lists at most to make the bitmap by which tasks know them; beyond, tasks make its pages.
BROADCAST_KEYS = 4 << 20
#: Bits of that bitmap at most (64 MB): two of them tell 24 million minimizers from all but one in a hundred of the others.
BITMAP_BITS = 1 << 29
#: Bits of one page of a bitmap, as Spark's functions make them, and of a minimizer between its two spots.
PAGE_BITS, SPOT_SHIFT = 1 << 15, 28


def gram_hashes(data: np.ndarray, gram: int, sums: np.ndarray | None = None) -> np.ndarray:
    """Hash of the ``gram`` bytes from every place."""
    if len(data) < gram:
        return np.zeros(0, np.uint64)
    return gram_spans(data, gram, sums)


def windows(data: np.ndarray, offsets: np.ndarray, length: int, gram: int, sums: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes by place, the minimizer of every window, and whether the window lies in one row."""
    hashes = gram_hashes(data, gram, sums)
    if len(data) < length:
        return hashes, np.zeros(0, np.uint64), np.zeros(0, bool)
    inside = np.ones(len(data) - length + 1, bool)
    for edge in offsets[1:-1]:
        inside[max(0, edge - length + 1):edge] = False
    return hashes, window_min(hashes, length - gram + 1), inside


def chosen_places(hashes: np.ndarray, least: np.ndarray, inside: np.ndarray, width: int) -> np.ndarray:
    """Places whose hash is the minimizer of some window: it equals the largest minimizer of the windows that hold it."""
    if not len(least):
        return np.zeros(0, np.int64)
    padded = np.concatenate([np.zeros(width - 1, np.uint64), np.where(inside, least, 0), np.zeros(width - 1, np.uint64)])
    return np.flatnonzero(hashes == ~window_min(~padded, width))


def _occurrences(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """Every place whose hash is the minimizer of some window, as its hash."""
    def run(batches):
        for batch in batches:
            for _, _, data, offsets in byte_slices(text_column(batch), SLICE_BYTES):
                hashes, least, inside = windows(data, offsets, length, gram)
                chosen = hashes[chosen_places(hashes, least, inside, length - gram + 1)]
                yield pa.RecordBatch.from_arrays([pa.array(chosen.astype(np.int64))], names=["mini"])

    return docs.select("text").mapInArrow(run, "mini long")


def listed(minis: DataFrame) -> np.ndarray:
    """Sorted for the driver."""
    return np.sort(minis.toArrow().column(0).to_numpy().astype(np.int64).view(np.uint64))


def bitmap_of(minis: DataFrame, count: int) -> np.ndarray:
    """Bytes of a bitmap in which two bits of every minimizer are set, at least 16 bits for each of ``count`` up to BITMAP_BITS."""
    bits = min(BITMAP_BITS, 1 << max(20, (16 * count - 1).bit_length()))
    if count <= BROADCAST_KEYS:
        keys, flags = listed(minis), np.zeros(bits, bool)
        for shift in (0, SPOT_SHIFT):
            flags[keys >> np.uint64(shift) & np.uint64(bits - 1)] = True
        return np.packbits(flags, bitorder="little")
    spots = F.explode(F.array(*[1 + F.pmod(v, F.lit(bits)) for v in (F.col("mini"), F.shiftrightunsigned("mini", SPOT_SHIFT))]))
    # Spots meet by page before pages are made, else every task makes every page.
    placed = minis.select(spots.alias("spot")).select(F.bitmap_bucket_number("spot").alias("page"), F.bitmap_bit_position("spot").alias("bit"))
    pages = placed.repartition("page").groupBy("page").agg(F.bitmap_construct_agg("bit").alias("bits")).toArrow()
    bitmap = np.zeros((bits // PAGE_BITS, PAGE_BITS // 8), np.uint8)
    for page, raw in zip(pages.column(0).to_pylist(), pages.column(1)):
        bitmap[page - 1] = np.frombuffer(raw.as_buffer(), np.uint8)
    return bitmap.ravel()


def in_bitmap(values: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    """Whether both bits of each value are set."""
    found = np.ones(len(values), bool)
    for shift in (0, SPOT_SHIFT):
        spot = values >> np.uint64(shift) & np.uint64(8 * len(bitmap) - 1)
        found &= bitmap[spot >> np.uint64(3)] >> (spot & np.uint64(7)).astype(np.uint8) & 1 > 0
    return found


def _pieces(docs: DataFrame, shared, length: int, gram: int, more: str = "") -> DataFrame:
    """(mini, h, g, doc_id, key, start, size) of the pieces under shared minimizers, all if ``shared`` is None, and ``more``:
    ``piece``, their bytes, or ``twice``, whether the minimizer stands in the piece more than once.

    ``shared`` holds a bitmap of the minimizers, and a sorted list of others that are not meant."""
    def run(batches):
        known, others = shared.value if shared is not None else (None, None)
        for batch in batches:
            for first, end, data, offsets in byte_slices(text_column(batch), SLICE_BYTES):
                sums = span_sums(data)
                hashes, least, inside = windows(data, offsets, length, gram, sums)
                if not inside.any():
                    continue
                change = np.ones(len(least) + 1, bool)
                change[1:-1] = (least[1:] != least[:-1]) | ~(inside[1:] & inside[:-1])
                start = np.flatnonzero(change[:-1] & inside)
                stop = np.flatnonzero(change[1:] & inside) + length
                mini = least[start]
                if known is not None:
                    ok = in_bitmap(mini, known)
                    ok[ok] = ~among(mini[ok], others)
                    start, stop, mini = start[ok], stop[ok], mini[ok]
                if not len(start):
                    continue
                h = word_hashes(data, start, stop)
                g = span_hashes(data, start, stop, sums)
                row = np.searchsorted(offsets, start, side="right") - 1
                which = pa.array(row + first)
                columns = [pa.array(mini.astype(np.int64)), pa.array(h.astype(np.int64)), pa.array(g.astype(np.int64)), batch.column(0).take(which), batch.column(2).take(which),
                           pa.array(start - offsets[row]), pa.array(stop - start)]
                names = ["mini", "h", "g", "doc_id", "key", "start", "size"]
                if more == "twice":
                    place = chosen_places(hashes, least, inside, length - gram + 1)
                    values, group = np.unique(hashes[place], return_inverse=True)
                    ordered = np.sort(group * (len(data) + 1) + place)
                    of_piece = np.searchsorted(values, mini) * (len(data) + 1)
                    twice = np.searchsorted(ordered, of_piece + stop - gram, "right") - np.searchsorted(ordered, of_piece + start, "left") > 1
                    columns.append(pa.array(twice))
                    names.append(more)
                elif more == "piece":
                    size = stop - start
                    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                    raw = data[spread(start, size)]
                    columns.append(pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(raw.tobytes())]))
                    names.append(more)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.select("doc_id", "text", "key").mapInArrow(
        run, "mini long, h long, g long, doc_id long, key long, start long, size long" + {"": "", "twice": ", twice boolean", "piece": ", piece binary"}[more])


#: Symbols of a suffix that its first key takes in, nine bits each.
PACKED = 7


def suffix_order(symbols: np.ndarray, ends: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of strings laid end to end, by their first ``depth`` symbols at least; ``ends`` are the terminators.

    A suffix alone with its first symbols is settled, so a round sorts only those that still share theirs, within their places.
    """
    n, have = len(symbols), PACKED
    key, alive = np.zeros(n, np.int64), np.ones(n, bool)
    padded = np.concatenate([symbols.astype(np.int64), np.zeros(PACKED, np.int64)])
    for k in range(PACKED):  # what follows a terminator does not count
        key = (key << 9) + np.where(alive, padded[k:k + n], 0)
        alive &= padded[k:k + n] > 0
    order = np.argsort(key)
    ended = np.flatnonzero(~alive[order])  # of equal ones, which all end, the earlier has the earlier terminator
    order[ended] = order[ended][np.lexsort((order[ended], key[order[ended]]))]
    sorted_key = key[order]
    fresh = np.ones(n + 1, bool)
    fresh[1:-1] = (sorted_key[1:] != sorted_key[:-1]) | ~alive[order[1:]]
    rank = np.empty(n, np.int64)  # of equal ones the place of the first
    rank[order] = np.maximum.accumulate(np.where(fresh[:-1], np.arange(n), 0))
    left = np.flatnonzero(~(fresh[:-1] & fresh[1:]))
    while have < depth and len(left):
        suffix = order[left]
        later = suffix + have
        key = rank[suffix] * (n + 2) + np.where(later < n, rank[np.minimum(later, n - 1)] + 1, 0)
        turn = np.argsort(key)
        key, suffix = key[turn], suffix[turn]
        order[left] = suffix
        fresh = np.ones(len(left) + 1, bool)
        fresh[1:-1] = key[1:] != key[:-1]
        rank[suffix] = np.maximum.accumulate(np.where(fresh[:-1], left, 0))
        left = left[~(fresh[:-1] & fresh[1:])]
        have *= 2
    return order


def transform(pieces: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix places of one shard, the symbols before them (0 before a string's first), and the rows of the suffixes these begin."""
    sizes = np.array([len(p) + 1 for p in pieces])
    ends = np.cumsum(sizes) - 1
    symbols = np.zeros(int(sizes.sum()), np.uint16)
    inner = np.ones(len(symbols), bool)
    inner[ends] = False
    symbols[inner] = np.concatenate(pieces).astype(np.uint16) + 1
    order = suffix_order(symbols, ends, depth)
    row = np.empty(len(order), np.int32)
    row[order] = np.arange(len(order), dtype=np.int32)
    return order, symbols[order - 1], row[order - 1]


#: Symbols that a round of the merge takes.
STRIDE = 16


def ranked(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of smaller distinct values, for each, and the order of the values."""
    order = np.argsort(values)
    ordered = values[order]
    fresh = np.zeros(len(values), np.uint32)
    fresh[1:] = ordered[1:] != ordered[:-1]
    rank = np.empty(len(values), np.uint32)
    rank[order] = np.cumsum(fresh, dtype=np.uint32)
    return rank, order


def merge_transforms(parts: list[np.ndarray], steps: list[np.ndarray], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the shards' transforms, numbered through, of the suffixes that share their first ``depth`` symbols with another,
    and the block of suffixes they share them with.

    A round sorts the rows by the STRIDE symbols before them, as one rank, and steps to the rows of the suffixes these begin,
    which refines the interleave of the shards by so many symbols; what is over of the depth is taken in shorter rounds last,
    when few rows are left. The first round finds the rows in the order that gave the ranks.
    A suffix alone in its block is settled, and so are all that end in it: they leave, so a round costs what still repeats.
    Terminators are unlike each other.
    """
    first = np.cumsum([0] + [len(p) for p in parts])
    before = np.concatenate(parts)
    onward = np.concatenate([s + np.int32(f) for s, f in zip(steps, first)])
    gone = before == 0
    used = np.bincount(before, minlength=1) > 0
    used[0] = False
    symbols = (np.cumsum(used) - 1).astype(np.uint8)[before].astype(np.uint32)  # 256 bytes at most
    rounds, short, taken, rest, order = [], [], 1, depth, None
    while rest:
        if taken == STRIDE:
            rounds, rest = [(symbols, onward, gone)] * (rest // taken), 0
        elif rest & taken:
            short.append((symbols, onward, gone))
            rest -= taken
        if rest:  # twice as many symbols
            pair = symbols[onward].astype(np.uint64) << np.uint64(8 * taken if taken < 4 else 32) | symbols
            symbols, order = (pair.astype(np.uint32), None) if taken < 4 else ranked(pair)
            gone = gone | gone[onward]
            onward, taken = onward[onward], 2 * taken
    rows, block = np.arange(len(before), dtype=np.int32), np.zeros(len(before), np.int64)
    for number, (symbols, onward, gone) in enumerate(rounds + short):
        if number == 0 and rounds and order is not None:
            rows = order[~gone[order]].astype(np.int32)
            key = symbols[rows]
        else:
            inner = ~gone[rows]
            rows = rows[inner]
            key = symbols[rows].astype(np.int64) << 31 | block[inner]
            turn = np.argsort(key)
            key, rows = key[turn], rows[turn]
        split = np.ones(len(key) + 1, bool)
        split[1:-1] = key[1:] != key[:-1]
        shared = ~(split[:-1] & split[1:])
        rows, block = onward[rows[shared]], np.cumsum(split[:-1])[shared]
    return rows, block


def later_windows(pieces: list[np.ndarray], document: np.ndarray, start: np.ndarray, length: int, shard_bytes: int = SHARD_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """(piece, offset) of every window of ``length`` bytes that an earlier one equals; documents are numbered in order."""
    shards, size = [[]], 0
    for k, piece in enumerate(pieces):
        if size + len(piece) > shard_bytes and shards[-1] and len(shards) < 255:
            shards.append([])
            size = 0
        shards[-1].append(k)
        size += len(piece)
    places, parts, steps, first = [], [], [], 0
    for members in shards:
        order, before, step = transform([pieces[k] for k in members], length)
        parts.append(before)
        steps.append(step)
        places.append(order + first)
        first += len(order)
    rows, block = merge_transforms(parts, steps, length)
    at = np.concatenate(places)[rows]
    ends = np.cumsum([len(piece) + 1 for piece in pieces])  # shards hold the pieces in order
    piece = np.searchsorted(ends, at, side="right")
    offset = at - ends[piece] + np.array([len(p) + 1 for p in pieces])[piece]
    order = np.lexsort((start[piece] + offset, document[piece], block))
    piece, offset, block = piece[order], offset[order], block[order]
    late = np.zeros(len(block), bool)
    late[1:] = block[1:] == block[:-1]
    return piece[late], offset[late]


def _covered(table: pa.Table, length: int) -> pa.Table:
    """Byte ranges of a bucket's documents that later windows cover."""
    ids = table.column("doc_id").to_pylist()
    keys, start = table.column("key").to_numpy(), table.column("start").to_numpy()
    numbered = {k: n for n, k in enumerate(sorted({(i is not None, i or 0, int(k)) for i, k in zip(ids, keys)}))}
    document = np.array([numbered[i is not None, i or 0, int(k)] for i, k in zip(ids, keys)], np.int64)
    pieces = [np.frombuffer(p, np.uint8) for p in table.column("piece").to_pylist()]
    piece, offset = later_windows(pieces, document, start, length) if pieces else (start[:0], start[:0])
    order = np.lexsort((offset, piece))
    piece, offset = piece[order], offset[order]
    fresh = np.ones(len(piece), bool)
    fresh[1:] = (piece[1:] != piece[:-1]) | (offset[1:] > offset[:-1] + 1)
    begin = np.flatnonzero(fresh)
    last = np.append(begin[1:], len(piece)) - 1 if len(piece) else begin
    return pa.table({"key": keys[piece[begin]], "low": start[piece[begin]] + offset[begin], "high": start[piece[begin]] + offset[last] + length})


def _single_windows(hot: DataFrame, length: int) -> DataFrame:
    """(h, g, doc_id, key, start): the hash of every window of the pieces (first, piece), and its place."""
    def run(batches):
        for batch in batches:
            starts = batch.column(2).to_numpy()
            for row in range(batch.num_rows):
                raw = np.frombuffer(batch.column(3)[row].as_py(), np.uint8)
                for low in range(0, len(raw) - length + 1, 1 << 16):
                    part = raw[low:low + (1 << 16) + length - 1]
                    at = np.arange(len(part) - length + 1)
                    which = pa.array(np.full(len(at), row))
                    yield pa.RecordBatch.from_arrays([
                        pa.array(span_hashes(part, at, at + length).astype(np.int64)), pa.array(span_hashes(part ^ 0x55, at, at + length).astype(np.int64)),
                        batch.column(0).take(which), batch.column(1).take(which), pa.array(at + low + starts[row])], names=["h", "g", "doc_id", "key", "start"])

    return hot.select("doc_id", "key", "start", "piece").mapInArrow(run, "h long, g long, doc_id long, key long, start long")


def _runs(ranges: DataFrame) -> DataFrame:
    """The ranges with those that overlap or touch in one, kept in the shared folder; the shuffles behind them are let go."""
    def run(batches):
        for batch in batches:
            spans = batch.column(1)
            row = np.repeat(np.arange(batch.num_rows), spans.value_lengths().to_numpy())
            low, high = (spans.flatten().field(k).to_numpy() for k in (0, 1))
            beyond = row * (int(high.max(initial=0)) + 2)  # the ranges of a row end before the next one's begin
            order = np.argsort(low + beyond)
            row, low, high = row[order], (low + beyond)[order], np.maximum.accumulate((high + beyond)[order])
            fresh = np.ones(len(low), bool)
            fresh[1:] = low[1:] > high[:-1]
            begin = np.flatnonzero(fresh)
            last = np.append(begin[1:], len(low)) - 1 if len(low) else begin
            shift = beyond[order][begin]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[begin])), pa.array(low[begin] - shift), pa.array(high[last] - shift)], names=["key", "low", "high"])

    kept = cut_lineage(ranges.groupBy("key").agg(F.collect_list(F.struct("low", "high"))).mapInArrow(run, "key long, low long, high long"))
    release(ranges.sparkSession)
    return kept


def repeated_ranges(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(key, low, high): byte ranges of documents (doc_id, text, key) covered by strings that also start earlier."""
    spark = docs.sparkSession

    def sent(minis: DataFrame, others: DataFrame | None = None):
        """A bitmap of them for every task, which may hold others too; ``others`` are not meant in any case."""
        return spark.sparkContext.broadcast((bitmap_of(minis, minis.count()), listed(others) if others is not None else np.zeros(0, np.uint64)))

    minis = cut_lineage(_occurrences(docs, length, gram).groupBy("mini").count().where("count > 1").select("mini"))
    release(spark)
    known = sent(minis)
    place = F.struct("doc_id", "key", "start")
    firsts = cut_lineage(_pieces(docs, known, length, gram, "twice").groupBy("mini", "h", "g").agg(
        F.min(place).alias("first"), F.count(F.lit(1)).alias("n"), F.max("twice").alias("twice"), F.max("size").alias("size")))
    release(spark)
    copied = firsts.where("n > 1").select("h", "g", "first")
    whole = _pieces(docs, known, length, gram).join(copied, ["h", "g"]).where(place != F.col("first")).select(
        "key", F.col("start").alias("low"), (F.col("start") + F.col("size")).alias("high"))
    # A single piece that holds its minimizer once repeats in its copies only.
    sizes = cut_lineage(firsts.groupBy("mini").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("pieces"), F.max("twice").alias("twice"))
                        .where("pieces > 1 OR twice").select("mini", "bytes"))

    def texts(known) -> DataFrame:
        """Every different piece of the minimizers once, at its earliest place."""
        found = _pieces(docs, known, length, gram, "piece").groupBy("mini", "h", "g").agg(F.min(place).alias("first"), F.first("piece").alias("piece"))
        return found.select(F.col("mini").alias("deal"), "first.doc_id", "first.key", "first.start", "piece")

    calm, hot = (cut_lineage(sizes.where(f"bytes {than} {HOT_BYTES}").select("mini")) for than in ("<=", ">"))  # of hot ones there are few: each has HOT_BYTES of pieces
    total = sizes.where(f"bytes <= {HOT_BYTES}").agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    buckets = max(1, -(-total // BUCKET_BYTES))
    release(spark)
    merged = (
        texts(sent(calm, hot)).withColumn("bucket", F.pmod(F.xxhash64("deal"), F.lit(buckets)))
        .groupBy("bucket").applyInArrow(lambda table: _covered(table, length), "key long, low long, high long"))
    ranges = _runs(whole.union(merged))
    if not hot.limit(1).count():
        return ranges
    single = _single_windows(cut_lineage(texts(sent(hot))), length).withColumn("window", F.struct("h", "g"))  # a pass of its own, which lets only these pieces out
    earliest = cut_lineage(single.groupBy("window").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    release(spark)
    late = join_counted(single, earliest, "window", "n", salt=["key", "start"]).where(place != F.col("first"))
    return ranges.union(_runs(late.select("key", F.col("start").alias("low"), (F.col("start") + length).alias("high"))))


def _cut(docs: DataFrame, ranges: DataFrame) -> DataFrame:
    """Digests of the documents without the ranges."""
    by_doc = ranges.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("low", "high"))).alias("ranges"))

    def run(batches):
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2)):
                raw = np.frombuffer((text or "").encode(), np.uint8)
                gone = np.zeros(len(raw) + 1, np.int64)
                if spans.is_valid and len(spans.values):
                    np.add.at(gone, spans.values.field(0).to_numpy(), 1)
                    np.add.at(gone, spans.values.field(1).to_numpy(), -1)
                gone = np.cumsum(gone[:-1]) > 0
                edges = np.count_nonzero(gone[1:] & ~gone[:-1]) + int(len(gone) > 0 and gone[0])
                rows.append((len(raw), int(gone.sum()), edges, raw[~gone].tobytes()))
            n, removed, spans, kept = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()),
                 pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return docs.join(by_doc, "key", "left").select("doc_id", "text", "ranges").mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the bytes kept."""
    docs = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))
    return _cut(docs, repeated_ranges(docs, length, gram))
