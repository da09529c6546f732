"""N-gram Jaccard join by prefix filters under several token orders.

A document's set holds its distinct 4-word shingles. Two sets that reach the similarity share a token among
the first ``n - ceil(t * n) + 1`` of each under any order of all tokens. Three orders are used; all put tokens
that recur last, by the logarithm of their count, and break ties by different hashes. Documents that share a
prefix token under the first order (a bucket) are candidates if their sizes and the token's places allow it and they also
share one under each of the others; what is left is verified on the whole sets. Before texts are read again for that, counts
of tokens in 256 classes bound what two sets can have in common.

Equal sets are one node. Inside a bucket, members of like sizes are first verified against one of them, the set with the fewest
rarer tokens: copies of a text are like that text, but less like each other, and longer texts that hold it too are not like it.
Members found connected need no more comparison, so a large group of near copies costs its size, not its
square; this is repeated with other nodes while it links a fair share of what it tries and buckets are crowded. Members of a
bucket that are then in different components are compared inside tasks, in blocks, by their sizes and the token's places;
only pairs that may be similar leave the task, and no pair of unconnected members is left out.

Counts of common tokens come from all documents: tasks report what recurs among a few million tokens. They
only steer the orders, so their bound (``MOST_COMMON`` entries) does not touch results.

Cases: fewer than 4 words make one shingle; null, empty and blank texts have no shingles and link with
nothing; equal rows are linked; null ids never name a component; a very long text is read whole by one task, which
holds some thirty times its bytes; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.functions.skew import bits_for, maybe_in, maybe_repeated
from tracewright.llm.batches import NONSPACE, Words, byte_slices, mix, spread, text_column
from tracewright.llm.graph import components
from tracewright.session import cut_lineage, few, release

SHINGLE = 4
PERCENT = 85
#: Hash salts of the order that finds candidates and of those that filter them.
FIRST = (11,)
OTHERS = (12, 13)
OTHER_COLUMNS = ("p0", "p1")
#: Tokens that a task counts together, and entries of the list of recurring tokens.
UNIT_TOKENS = 4 << 20
MOST_COMMON = 2 << 20
#: Classes of tokens whose counts bound how many two sets can share.
CLASSES = 256
#: Rows of a few columns that one with a sketch or a prefix counts for.
ROW_WEIGHT = 8
#: Stars go on while open buckets hold so many pairs a member or more, and links are found in this share of the pairs tried.
CROWD = 16
FAIR_SHARE = 1 / 16
#: Members of a bucket that a task compares with as many others at a time, and pairs that it holds at once.
BLOCK = 1024
PAIRS = 1 << 18


def shingle_sets(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Rows and hashes of distinct shingles, row by row."""
    words = Words(data, offsets, NONSPACE)
    grams, whole = words.grams(size)
    rows, tokens = [words.row[:len(grams)][whole]], [grams[whole]]
    count = words.per_row(len(offsets) - 1)
    for n in range(1, size):
        grams, whole = words.grams(n)
        short = whole & (count[words.row[:len(grams)]] == n)
        rows.append(words.row[:len(grams)][short])
        tokens.append(grams[short])
    row, token = np.concatenate(rows), np.concatenate(tokens)
    order = np.argsort((row.astype(np.uint64) << np.uint64(50)) | (token >> np.uint64(14)))
    row, token = row[order], token[order]
    new = np.ones(len(row), bool)
    new[1:] = (token[1:] != token[:-1]) | (row[1:] != row[:-1])
    return row[new], token[new]


def _common(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens that recur and the logarithm of their counts: all from a count that leaves MOST_COMMON of them."""
    def report(batches):
        held, n = [], 0

        def found():
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts > 1
            return pa.RecordBatch.from_arrays([pa.array(tokens[often].astype(np.int64)), pa.array(counts[often], pa.int64())], names=["token", "n"])

        for batch in batches:
            for _, _, data, offsets in byte_slices(text_column(batch)):
                held.append(shingle_sets(data, offsets, size)[1])
                n += len(held[-1])
                if n >= UNIT_TOKENS:
                    yield found()
                    held, n = [], 0
        if n:
            yield found()

    counted = cut_lineage(docs.select("text").mapInArrow(report, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")))
    least, room = 1 << 62, MOST_COMMON
    level = F.floor(F.log2("n")).cast("int")
    for row in sorted(counted.groupBy(level.alias("level")).count().collect(), reverse=True):  # at most 63 rows
        room -= row["count"]
        if room < 0:
            break
        least = 1 << row["level"]
    table = counted.where(F.col("n") >= least).select("token", level.alias("level")).toArrow()
    tokens = table.column(0).to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], table.column(1).to_numpy().astype(np.uint8)[order]


class Orders:
    """Prefixes of shingle sets under the token orders."""

    def __init__(self, common: tuple[np.ndarray, np.ndarray], percent: int, size: int):
        self.known, self.level = common
        self.percent, self.size = percent, size

    def prefixes(self, data: np.ndarray, offsets: np.ndarray, salts: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, pa.Array, list[pa.Array]]:
        """Set sizes, set digests, tokens counted by class, and the prefix of each row under the order of each salt."""
        rows = len(offsets) - 1
        row, token = shingle_sets(data, offsets, self.size)
        n = np.bincount(row, minlength=rows)
        begin = np.cumsum(n) - n
        held = np.bincount(row * CLASSES + (token >> np.uint64(56)).astype(np.int64) % CLASSES, minlength=rows * CLASSES)
        sketch = pa.array([r.tobytes() for r in np.minimum(held, 255).astype(np.uint8).reshape(rows, CLASSES)], pa.binary())
        digest = np.zeros(rows, np.uint64)
        np.add.at(digest, row, mix(token, 99))
        rank = np.zeros(len(token), np.uint64)
        if len(self.known):
            place = np.minimum(np.searchsorted(self.known, token), len(self.known) - 1)
            rank = np.where(self.known[place] == token, self.level[place], 0).astype(np.uint64)
        length = np.where(n > 0, n - (self.percent * n + 99) // 100 + 1, 0)
        stop = pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32))
        inside = np.arange(len(row)) - begin[row] < length[row]
        lists = []
        for salt in salts:
            key = (row.astype(np.uint64) << np.uint64(50)) | (rank << np.uint64(44)) | (mix(token, salt) >> np.uint64(20))
            lists.append(pa.ListArray.from_arrays(stop, pa.array(token[np.argsort(key)][inside].astype(np.int64))))
        return n, mix(digest + n.astype(np.uint64)), sketch, lists


def _sets(docs: DataFrame, wanted: DataFrame, orders, size: int) -> DataFrame:
    """(node, tokens, p0, p1): whole sets of the wanted (node, rep_id, rep_hash), and their prefixes under the other orders.

    Texts that are not wanted leave by a bitmap of their hashes, so only the others are shuffled.
    """
    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    near = maybe_in(hashed, "text_hash", wanted, "rep_hash", bits_for(wanted.count()))
    chosen = near.join(wanted, near["doc_id"].eqNullSafe(wanted["rep_id"]) & (near["text_hash"] == wanted["rep_hash"])).select("node", "text").dropDuplicates(["node"])

    def run(batches):
        for batch in batches:
            for first, end, data, offsets in byte_slices(text_column(batch)):
                row, token = shingle_sets(data, offsets, size)
                stop = np.searchsorted(row, np.arange(end - first + 1)).astype(np.int32)
                lists = orders.value.prefixes(data, offsets, OTHERS)[3]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, end - first), pa.ListArray.from_arrays(pa.array(stop), pa.array(token.astype(np.int64))), *lists], names=["node", "tokens", *OTHER_COLUMNS])

    return chosen.mapInArrow(run, "node long, tokens array<long>" + "".join(f", {c} array<long>" for c in OTHER_COLUMNS))


def _needed(one: str, other: str, percent: int) -> str:
    """SQL for the filters on sizes and places: enough tokens must be left from the shared one on, if it is the first common one."""
    return (f"100 * least({one}.n, {other}.n) >= {percent} * greatest({one}.n, {other}.n)"
            f" AND least({one}.n - {one}.pos, {other}.n - {other}.pos) >= ceil({percent} * ({one}.n + {other}.n) / {100 + percent})")


def _compare(table: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs of equal (token, unit) that the filters on sizes and places leave; rows lie in order of these."""
    token, unit = (table.column(c).to_numpy() for c in ("token", "unit"))
    n, comp, pos, side = (table.column(c).to_numpy() for c in ("n", "comp", "pos", "side"))
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (unit[1:] != unit[:-1])
    group_end = np.append(np.flatnonzero(new)[1:], len(token))[np.cumsum(new) - 1]
    ahead = group_end - np.arange(len(token)) - 1
    found, first = [], 0
    while first < len(token):
        last = max(first + 1, int(np.searchsorted(np.cumsum(ahead[first:]), PAIRS, side="right")) + first)
        a = np.repeat(np.arange(first, last), ahead[first:last])
        b = spread(np.arange(first, last) + 1, ahead[first:last])
        first = last
        small, large = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
        need = -(-percent * (n[a] + n[b]) // (100 + percent))  # common tokens of a similar pair
        ok = (comp[a] != comp[b]) & ((side[a] != side[b]) | (side[a] == BOTH)) & (100 * small >= percent * large)
        ok &= np.minimum(n[a] - pos[a], n[b] - pos[b]) >= need
        found.append((a[ok], b[ok]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _may_reach(batches, percent: int):
    """Pairs whose tokens, counted by class, can have enough in common: no more in a class than either set has there."""
    for batch in batches:
        if not batch.num_rows:
            continue
        na, nb = (batch.column(k).to_numpy() for k in (2, 3))
        sa, sb = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, CLASSES) for k in (4, 5))
        most = np.minimum(sa, sb).sum(1, dtype=np.int64)
        full = (sa.max(1) == 255) | (sb.max(1) == 255)  # counts end at 255
        keep = pa.array(full | (100 * most >= percent * (na + nb - most)))
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])


#: Sides of a unit: members of one block meet each other, those of two blocks meet across.
BOTH = 2
#: Rows that a task compares together, whole buckets at a time.
UNIT_ROWS = 16_384


def _open_pairs(left: DataFrame, percent: int) -> DataFrame:
    """(a, b) of members of one bucket in different components that pass the filters on sizes and places.

    Large buckets are cut into blocks, and every two blocks are a unit; units are dealt to tasks, which read them in
    order and list pairs of some units at a time.
    """
    counted = left.join(left.groupBy("token").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")), "token")
    block = F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks")).cast("int")
    cut = counted.withColumn("block", block)
    # Block k meets itself (unit k * blocks + k, side both) and every other block (unit of the lower and the higher).
    units = F.expr("transform(sequence(0, blocks - 1), o -> struct(least(o, block) * blocks + greatest(o, block) AS unit, CASE WHEN o = block THEN 2 WHEN o < block THEN 1 ELSE 0 END AS side))")
    dealt = cut.withColumn("u", F.explode(units)).select("token", "u.unit", "u.side", "node", "n", "comp", "pos")

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= UNIT_ROWS:
                table = pa.Table.from_batches(held).combine_chunks()
                token, unit = table.column("token").to_numpy(), table.column("unit").to_numpy()
                change = np.flatnonzero((token[1:] != token[:-1]) | (unit[1:] != unit[:-1])) + 1
                if len(change):
                    yield pairs_of(table.slice(0, int(change[-1])))
                    table = table.slice(int(change[-1]))
                held, rows = table.to_batches(), table.num_rows
        if rows:
            yield pairs_of(pa.Table.from_batches(held))

    def pairs_of(table: pa.Table) -> pa.RecordBatch:
        a, b = _compare(table.combine_chunks(), percent)
        node = table.column("node").to_numpy()
        pair = np.unique(np.stack([np.minimum(node[a], node[b]), np.maximum(node[a], node[b])]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], names=["a", "b"])

    return dealt.repartition("token", "unit").sortWithinPartitions("token", "unit").mapInArrow(run, "a long, b long").distinct()


def similar_documents(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id that links of at least ``percent`` Jaccard reach."""
    return linked_texts(docs, percent, size).select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("least.doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def linked_texts(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE) -> DataFrame:
    """doc_id, text_hash, n_shingles, least: the smallest (doc_id, text_hash) with an id that links reach, null if none has."""
    docs = docs.select("doc_id", "text")
    orders = docs.sparkSession.sparkContext.broadcast(Orders(_common(docs, size), percent, size))

    def first_prefix(batches):
        for batch in batches:
            for first, end, data, offsets in byte_slices(text_column(batch)):
                n, node, sketch, lists = orders.value.prefixes(data, offsets, FIRST)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, end - first), batch.column(2).slice(first, end - first), pa.array(node.astype(np.int64)), pa.array(n, pa.int64()), sketch, *lists],
                    names=["doc_id", "text_hash", "node", "n", "sketch", "first"])

    table = cut_lineage(docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(
        first_prefix, "doc_id long, text_hash long, node long, n long, sketch binary, first array<long>"))
    nodes = table.count()
    table = few(table, ROW_WEIGHT * nodes)
    members = table.select("doc_id", "text_hash", "node", "n")
    prefix = table.where("n > 0").select(F.posexplode("first").alias("pos", "token"), "node", "n")
    likely = cut_lineage(maybe_repeated(prefix, "token", 1, bits_for(4 * nodes)).distinct())
    shared = likely.groupBy("token").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("token")
    buckets = cut_lineage(likely.join(shared, "token"))
    entries = buckets.count()
    buckets = few(buckets, entries)
    del likely, shared, prefix  # their files may go
    state = buckets.groupBy("node").agg(F.count(F.lit(1)).alias("degree")).withColumn("comp", F.col("node"))
    reps = members.join(state.select("node"), "node").groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("rep"))
    state = cut_lineage(few(state.join(reps, "node"), nodes).select("node", "degree", "comp", F.col("rep.doc_id").alias("rep_id"), F.col("rep.text_hash").alias("rep_hash")))
    sketches = cut_lineage(few(table.select("node", "n", "sketch").join(state.select("node"), "node").groupBy("node").agg(F.max(F.struct("n", "sketch")).alias("s")), ROW_WEIGHT * nodes).select("node", "s.n", "s.sketch"))

    def sets_of(wanted: DataFrame) -> DataFrame:
        return _sets(docs, cut_lineage(few(state.join(wanted.select("node").distinct(), "node"), nodes).select("node", "rep_id", "rep_hash")), orders, size)

    def verified(pairs: DataFrame, many: int) -> DataFrame:
        """Pairs (a, b) that share a prefix token under every other order and reach the similarity."""
        one, other = sketches.toDF("a", "na", "sa"), sketches.toDF("b", "nb", "sb")
        pairs = few(pairs.join(one, "a"), ROW_WEIGHT * many).join(other, "b")
        pairs = cut_lineage(few(pairs, ROW_WEIGHT * many).select("a", "b", "na", "nb", "sa", "sb").mapInArrow(lambda x: _may_reach(x, percent), "a long, b long"))
        sets = sets_of(pairs.select(F.col("a").alias("node")).union(pairs.select("b")))
        both = pairs.join(sets.toDF("a", "ta", *(f"{c}a" for c in OTHER_COLUMNS)), "a").join(sets.toDF("b", "tb", *(f"{c}b" for c in OTHER_COLUMNS)), "b")
        for c in OTHER_COLUMNS:
            both = both.where(F.arrays_overlap(f"{c}a", f"{c}b"))
        common = F.size(F.array_intersect("ta", "tb"))
        return both.where(100 * common >= percent * (F.size("ta") + F.size("tb") - common)).select("a", "b")

    def joined(links: DataFrame) -> DataFrame:
        """The nodes with their components after the links: links are taken between the components known so far."""
        comps = state.select("node", "comp")
        between = links.join(comps.toDF("a", "ca"), "a").join(comps.toDF("b", "cb"), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        moved = components(between).toDF("comp", "_to")
        return cut_lineage(few(state.join(moved, "comp", "left"), nodes).withColumn("comp", F.coalesce("_to", "comp")).select(*state.columns))

    def still_open() -> DataFrame:
        left = few(buckets.join(state.select("node", "comp", "degree"), "node"), entries)
        tokens = left.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("token")
        return cut_lineage(few(left.join(tokens, "token"), entries))

    def crowded(left: DataFrame) -> bool:
        each = left.groupBy("token", "comp").agg(F.count(F.lit(1)).cast("double").alias("c")).groupBy("token").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("own"))
        members, pairs = each.agg(F.coalesce(F.sum("m"), F.lit(0.0)), F.coalesce(F.sum((F.col("m") * F.col("m") - F.col("own")) / 2), F.lit(0.0))).first()
        return pairs > CROWD * members

    step = math.log(100 / percent) or 1e-6  # of sizes that may be similar
    number, left = 0, few(buckets.join(state.select("node", "comp", "degree"), "node"), entries)
    while True:
        # Members of like sizes have a hub of their own: the set with the fewest rarer tokens, as copies of a text are each like
        # this text but less like each other. One member of each component goes against it, and in every other round the hub is
        # of a component drawn whatever its members, else a large one would be the hub of all that it does not reach.
        alike, purest = ["token", "class"], [F.col("pos"), -F.col("degree"), F.xxhash64("node")]
        spokes = left.withColumn("class", F.floor(F.log("n") / step + number / 2))
        if number:
            spokes = spokes.groupBy(*alike, "comp").agg(F.min_by(F.struct("node", "n", "pos", "degree"), F.struct(*purest)).alias("s")).select(*alike, "comp", "s.*")
        first = F.struct(F.xxhash64("comp", F.lit(number)), *purest) if number % 2 else F.struct(*purest)
        lead = spokes.groupBy(*alike).agg(F.min_by(F.struct("node", "n", "comp", "pos"), first).alias("hub"))
        stars = spokes.join(lead, alike).withColumn("own", F.struct("n", "pos")).where("comp <> hub.comp").where(_needed("own", "hub", percent)).select(
            F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b"))
        stars = cut_lineage(few(stars.distinct(), entries))
        tried = stars.count()
        links = cut_lineage(verified(stars, tried))
        good = links.count()
        links = few(links, good)
        if not good:
            break
        state = joined(links)
        left, number = still_open(), number + 1
        del spokes, lead, stars, links
        release(docs.sparkSession)
        if good < FAIR_SHARE * tried or not crowded(left):
            break
    pairs = cut_lineage(_open_pairs(still_open() if number == 0 else left, percent))
    many = pairs.count()
    links = cut_lineage(verified(few(pairs, many), many))
    links = few(links, links.count())
    del pairs
    del left, buckets, sketches
    release(docs.sparkSession)
    state = joined(links)
    orders.destroy()  # all that used it is written
    named = members.join(state.select("node", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    own = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_hash"))
    names = named.where("n > 0").groupBy("comp").agg(F.min(own).alias("least"))
    return named.join(names, "comp", "left").select("doc_id", "text_hash", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).alias("least"))
