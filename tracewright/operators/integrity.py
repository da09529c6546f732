"""Evidence integrity: hashes, hash chains, digests of sets, custody."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.functions.ordered import previous_row, row_index, segment_of, time_segment

# Fixed value: the digest before the first block.
ZERO_HASH = "0" * 64


def verify_hashes(files: DataFrame, expected: DataFrame, key: str = "id") -> DataFrame:
    """Recomputed digest against expected(key, hash_sha256); a missing side fails."""
    actual = files.select(key, F.sha2("content", 256).alias("actual"))
    return actual.join(expected.select(key, F.col("hash_sha256").alias("expected")), key, "full_outer").withColumn(
        "verified", F.coalesce(F.col("actual") == F.col("expected"), F.lit(False)))


def _u64(c: Column) -> Column:
    return F.unhex(F.lpad(F.hex(c.cast("long")), 16, "0"))


def block_hash(index: Column, ts: Column, data: Column, previous: Column, nonce: Column) -> Column:
    """SHA-256 over big-endian index, epoch seconds, the two hex digests as text, and the nonce."""
    return F.sha2(F.concat(
        _u64(index), _u64(F.unix_timestamp(ts)), F.encode(data, "utf-8"), F.encode(previous, "utf-8"), _u64(nonce)), 256)


def build_chain(rows: DataFrame, partitions: int | None = None) -> DataFrame:
    """ledger(stream, index, ts, data_hash, previous_hash, block_hash, nonce) from rows(stream, ts, seq, data_hash).

    A chain is sequential within its stream by definition. Streams are spread by hash, each
    partition is sorted by Spark and read as a stream of batches with only the previous digest
    carried over, so no stream is ever held in memory. Split a very long stream into sealed
    segments with ``segment_streams`` first; segments chain in parallel.
    """
    key = rows.schema["stream"].dataType
    schema = T.StructType([
        T.StructField("stream", key), T.StructField("index", T.LongType()), T.StructField("ts", T.TimestampType()),
        T.StructField("data_hash", T.StringType()), T.StructField("previous_hash", T.StringType()),
        T.StructField("block_hash", T.StringType()), T.StructField("nonce", T.LongType())])

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream, index, previous = None, -1, ZERO_HASH
        for batch in batches:
            out = []
            for s, epoch, data in zip(batch["stream"], batch["epoch"], batch["data_hash"], strict=True):
                if s != stream:
                    stream, index, previous = s, -1, ZERO_HASH
                index += 1
                raw = (index.to_bytes(8, "big") + int(epoch).to_bytes(8, "big", signed=True) + data.encode()
                       + previous.encode() + (0).to_bytes(8, "big"))
                digest = hashlib.sha256(raw).hexdigest()
                out.append((index, previous, digest))
                previous = digest
            made = pd.DataFrame(out, columns=["index", "previous_hash", "block_hash"])
            yield pd.DataFrame({
                "stream": batch["stream"].to_numpy(), "index": made["index"].to_numpy(), "ts": batch["ts"].to_numpy(),
                "data_hash": batch["data_hash"].to_numpy(), "previous_hash": made["previous_hash"].to_numpy(),
                "block_hash": made["block_hash"].to_numpy(), "nonce": 0})

    slim = rows.select("stream", "ts", "seq", "data_hash", F.unix_timestamp("ts").alias("epoch"))
    spread = slim.repartition(partitions, "stream") if partitions else slim.repartition("stream")
    return spread.sortWithinPartitions("stream", "ts", "seq").mapInPandas(fold, schema)


def segment_streams(rows: DataFrame, seconds: int) -> DataFrame:
    """Name streams by (stream, time slice), so that one hot stream becomes many independent chains."""
    return rows.withColumn(
        "stream", F.concat_ws("#", F.col("stream").cast("string"), time_segment(F.col("ts"), seconds).cast("string")))


def chain_tips(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("stream").agg(
        F.count("*").alias("blocks"), F.max_by("block_hash", "index").alias("tip"))


def _seal_data(segment: Column, blocks: Column, tip: Column) -> Column:
    return F.sha2(F.concat_ws("|", segment, blocks.cast("string"), tip), 256)


def seal_segments(ledger: DataFrame, seconds: int) -> DataFrame:
    """A chain over the tips of segments that were built in parallel: it proves their order and that none is missing.

    ledger: the chains of ``segment_streams``. One row per segment: stream, index, ts (the start of its slice),
    data_hash (of segment, blocks and tip), the chain columns, and segment, blocks, tip. ``chain_tips`` of the seals is the
    one digest of each stream to keep elsewhere.
    """
    number = F.regexp_extract("stream", r"#(-?\d+)\z", 1).cast("long")
    tips = chain_tips(ledger).select(
        F.regexp_replace("stream", r"#-?\d+\z", "").alias("stream"), F.timestamp_seconds(number * seconds).alias("ts"), number.alias("seq"),
        F.col("stream").alias("segment"), "blocks", "tip", _seal_data(F.col("stream"), F.col("blocks"), F.col("tip")).alias("data_hash"))
    chain = build_chain(tips.select("stream", "ts", "seq", "data_hash"))
    return chain.join(tips.select("stream", "ts", "segment", "blocks", "tip"), ["stream", "ts"])


def verify_segments(ledger: DataFrame, seals: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """(segment, problem) across segments: missing (sealed, but not in the ledger), unsealed (the other way round), altered (its
    tip or block count is not the sealed one), broken (the seal's own hash or its link to the seal before).

    heads(stream, blocks, tip): the kept digests of the streams; a stream whose seals end elsewhere is truncated. Inside a
    segment ``verify_chain`` tells which block is bad.
    """
    now = chain_tips(ledger).select(F.col("stream").alias("segment"), F.col("blocks").alias("_blocks"), F.col("tip").alias("_tip"))
    problem = (
        F.when(F.col("_tip").isNull(), "missing").when(F.col("tip").isNull(), "unsealed")
        .when(_seal_data(F.col("segment"), F.col("_blocks"), F.col("_tip")) != F.col("data_hash"), "altered"))
    found = seals.select("segment", "tip", "data_hash").join(now, "segment", "full_outer").select("segment", problem.alias("problem"))
    broken = verify_chain(seals).join(seals.select("stream", "index", "segment"), ["stream", "index"]).select("segment", F.lit("broken").alias("problem"))
    out = found.where(F.col("problem").isNotNull()).unionByName(broken)
    if heads is not None:
        ends = chain_tips(seals).select("stream", F.col("blocks").alias("_blocks"), F.col("tip").alias("_tip"))
        short = heads.join(ends, "stream", "left").where(~F.col("tip").eqNullSafe(F.col("_tip")) | ~F.col("blocks").eqNullSafe(F.col("_blocks")))
        out = out.unionByName(short.select(F.col("stream").cast("string").alias("segment"), F.lit("truncated").alias("problem")))
    return out


def verify_chain(ledger: DataFrame) -> DataFrame:
    """Bad blocks: own hash does not recompute, or the link to the block before is broken.

    The block before is found by an equi-join on (stream, index), which spreads even a single
    hot stream evenly; no ordered fold is needed to verify.
    """
    before = ledger.select("stream", (F.col("index") + 1).alias("index"), F.col("block_hash").alias("_before"))
    own = block_hash(F.col("index"), F.col("ts"), F.col("data_hash"), F.col("previous_hash"), F.col("nonce"))
    linked = F.when(F.col("index") == 0, F.lit(True)).otherwise(
        F.coalesce(F.col("previous_hash") == F.col("_before"), F.lit(False)))
    checked = ledger.join(before, ["stream", "index"], "left").withColumn(
        "hash_ok", own == F.col("block_hash")).withColumn("link_ok", linked)
    return checked.where(~F.col("hash_ok") | ~F.col("link_ok")).select("stream", "index", "hash_ok", "link_ok")


def repository_hash(files: DataFrame, by: str = "job_id", hash_col: str = "hash_sha256", levels: tuple[int, ...] = (6, 3, 0)) -> DataFrame:
    """One digest per group of files, independent of their order: a tree over hash prefixes.

    Copies are counted first, so a group of copies is one leaf entry. Leaves are then combined
    level by level by hash prefix, which bounds every collected list.
    """
    leaf = files.groupBy(by, F.col(hash_col).alias("h")).agg(F.count("*").alias("n"))
    nodes = leaf.select(by, F.col("h").alias("pos"), F.concat_ws(":", "h", F.col("n").cast("string")).alias("d"))
    for width in levels:
        nodes = nodes.groupBy(by, F.substring("pos", 1, width).alias("pos")).agg(
            F.array_sort(F.collect_list(F.struct("pos", "d"))).alias("parts"))
        nodes = nodes.select(
            by, "pos", F.sha2(F.array_join(F.transform("parts", lambda p: p["d"]), "\n"), 256).alias("d"))
    return nodes.select(by, F.col("d").alias("digest"))


def tamper_diff(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """added / deleted / modified / permissions_changed between two inventories(path, hash, permissions)."""
    a = baseline.select("path", F.col("hash").alias("old_hash"), F.col("permissions").alias("old_permissions"))
    b = current.select("path", F.col("hash").alias("new_hash"), F.col("permissions").alias("new_permissions"))
    change = (
        F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "deleted")
        .when(F.col("old_hash") != F.col("new_hash"), "modified")
        .when(~F.col("old_permissions").eqNullSafe(F.col("new_permissions")), "permissions_changed"))
    return a.join(b, "path", "full_outer").withColumn("change", change).where(F.col("change").isNotNull())


CUSTODY_ORDER = ["ts", "event_id"]


def custody_chain(custody: DataFrame, evidence_id=None, slice_seconds: int | None = None) -> DataFrame:
    """The ordered custody records of one item, or of every item with their position."""
    if evidence_id is not None:
        return custody.where(F.col("evidence_id") == evidence_id).orderBy(*CUSTODY_ORDER)
    seg = segment_of(custody, ["evidence_id"], "ts", slice_seconds)
    return row_index(custody, ["evidence_id"], CUSTODY_ORDER, seg, "position")


def current_holder(custody: DataFrame) -> DataFrame:
    return custody.groupBy("evidence_id").agg(
        F.max_by("actor", F.struct(*CUSTODY_ORDER)).alias("holder"), F.max("ts").alias("since"))


def invalid_transfers(custody: DataFrame, slice_seconds: int | None = None) -> DataFrame:
    """Records whose ``from_actor`` is not the holder before them."""
    rows = previous_row(
        custody, ["evidence_id"], CUSTODY_ORDER, ["actor"], segment_of(custody, ["evidence_id"], "ts", slice_seconds))
    return rows.where(F.col("prev_actor").isNotNull() & (F.col("from_actor") != F.col("prev_actor")))


def custody_breaks(custody: DataFrame, slice_seconds: int | None = None) -> DataFrame:
    """Records whose ``hash_before`` is not the previous ``hash_after``."""
    rows = previous_row(
        custody, ["evidence_id"], CUSTODY_ORDER, ["hash_after"], segment_of(custody, ["evidence_id"], "ts", slice_seconds))
    return rows.where(F.col("prev_hash_after").isNotNull() & (F.col("hash_before") != F.col("prev_hash_after")))


def export_manifest(files: DataFrame, custody: DataFrame, as_of: Column) -> DataFrame:
    """Manifest lines (one per file or custody record) with the per-job digest of the manifest."""
    entries = files.select("job_id", F.lit("file").alias("kind"), F.col("path").alias("item"), "hash_sha256").unionByName(
        custody.select("job_id", F.lit("custody").alias("kind"), F.col("custody_id").alias("item"),
                       F.sha2(F.col("custody_id"), 256).alias("hash_sha256")))
    return entries.withColumn("exported_at", as_of)


def manifest_summary(manifest: DataFrame) -> DataFrame:
    counts = manifest.groupBy("job_id").agg(
        F.count_if(F.col("kind") == "file").alias("files"), F.count_if(F.col("kind") == "custody").alias("custody_records"),
        F.max("exported_at").alias("exported_at"))
    return counts.join(repository_hash(manifest), "job_id")


def plan_erasure(
    data: DataFrame, subjects: DataFrame, holds: DataFrame, as_of: Column, retention_days: int
) -> DataFrame:
    """Outcome per row of the subjects: held and young rows are retained, the rest erased.

    subjects and holds are distinct ids; both joins keep each data row once.
    """
    asked = data.join(subjects.select("subject_id").distinct(), "subject_id", "left_semi")
    held = holds.select("subject_id").distinct().withColumn("_held", F.lit(True))
    young = F.col("recorded_at") >= as_of - F.make_dt_interval(days=F.lit(retention_days))
    return asked.join(held, "subject_id", "left").withColumn(
        "outcome", F.when(F.coalesce("_held", F.lit(False)), "retained_hold").when(young, "retained_retention")
        .otherwise("erased")).drop("_held")


def erasure_report(plan: DataFrame) -> DataFrame:
    return plan.groupBy("outcome").agg(F.count("*").alias("items"))


def record_checks(
    analyses: DataFrame, allowed: DataFrame, audit: DataFrame, actions: list[str], as_of: Column, retention_days: int
) -> DataFrame:
    """Four checks per analysis, each naming a violation; compliant when none applies.

    analyses(id, analyst, owner, created_at, deleted_at); allowed(analyst); audit(id, action).
    """
    seen = audit.where(F.col("action").isin(actions)).groupBy("id").agg(F.collect_set("action").alias("_seen"))
    ok = allowed.select(F.col("analyst")).distinct().withColumn("_ok", F.lit(True))
    joined = analyses.join(ok, "analyst", "left").join(seen, "id", "left")
    early = F.col("deleted_at") < F.col("created_at") + F.make_dt_interval(days=F.lit(retention_days))
    complete = F.size(F.coalesce("_seen", F.array().cast("array<string>"))) == len(actions)
    violations = F.array_compact(F.array(
        F.when(F.coalesce(early, F.lit(False)), F.lit("retention")),
        F.when(F.col("_ok").isNull(), F.lit("access_control")),
        F.when(~complete, F.lit("audit_trail")),
        F.when(F.col("analyst") == F.col("owner"), F.lit("conflict_of_interest"))))
    return joined.withColumn("violations", violations).withColumn(
        "status", F.when(F.size("violations") == 0, "compliant").otherwise("non_compliant")
    ).withColumn("next_review", as_of + F.make_dt_interval(days=F.lit(90))).drop("_ok", "_seen")
