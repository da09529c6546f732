"""Registered queries: evidence integrity and custody."""

from pyspark.sql import functions as F

from tracewright.operators import integrity as H
from tracewright.plans import bindings as B
from tracewright.plans.registry import query

DOC = B.SQL_DOC_FILES


@query("h1_verify_hashes", """
SELECT doc_id AS id, sha256(text) = CASE WHEN l.toxic = 1 THEN md5(text) ELSE sha256(text) END AS verified
FROM documents LEFT JOIN labels l USING (doc_id)""")
def h1(t):
    docs = t.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("content"))
    tampered = t.labels.select(F.col("doc_id").alias("id"), "toxic")
    expected = docs.join(tampered, "id", "left").select(
        "id", F.when(F.col("toxic") == 1, F.md5("content")).otherwise(F.sha2("content", 256)).alias("hash_sha256"))
    return H.verify_hashes(docs, expected).select("id", "verified")


def chain_rows(t):
    return t.events.select(
        F.col("user_id").alias("stream"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"),
        F.sha2("props", 256).alias("data_hash"))


# One block: big-endian index, epoch, data and previous digests as text, nonce 0.
SQL_BLOCK = "sha256(unhex(printf('%016x', {i})) || unhex(printf('%016x', {e})) || encode({d}) || encode({p}) || unhex('0000000000000000'))"


@query("h2_chain_tips", f"""
WITH RECURSIVE r AS (SELECT user_id AS stream, CAST(floor(epoch(ts)) AS BIGINT) AS e, sha256(props) AS d, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events),
c AS (SELECT stream, i, {SQL_BLOCK.format(i='i', e='e', d='d', p="repeat('0', 64)")} AS h FROM r WHERE i = 0
  UNION ALL SELECT r.stream, r.i, {SQL_BLOCK.format(i='r.i', e='r.e', d='r.d', p='c.h')} FROM r JOIN c ON c.stream = r.stream AND r.i = c.i + 1)
SELECT stream, count(*) AS blocks, max_by(h, i) AS tip FROM c GROUP BY stream""")
def h2(t):
    return H.chain_tips(H.build_chain(chain_rows(t)))


@query("h2_segment_tips", f"""
WITH RECURSIVE r AS (SELECT user_id || '#' || CAST(floor(epoch(ts) / 86400) AS BIGINT) AS stream, CAST(floor(epoch(ts)) AS BIGINT) AS e, sha256(props) AS d,
  row_number() OVER (PARTITION BY user_id, floor(epoch(ts) / 86400) ORDER BY ts, event_id) - 1 AS i FROM events),
c AS (SELECT stream, i, {SQL_BLOCK.format(i='i', e='e', d='d', p="repeat('0', 64)")} AS h FROM r WHERE i = 0
  UNION ALL SELECT r.stream, r.i, {SQL_BLOCK.format(i='r.i', e='r.e', d='r.d', p='c.h')} FROM r JOIN c ON c.stream = r.stream AND r.i = c.i + 1)
SELECT stream, count(*) AS blocks, max_by(h, i) AS tip FROM c GROUP BY stream""")
def h2s(t):
    return H.chain_tips(H.build_chain(H.segment_streams(chain_rows(t), 86_400)))


@query("h2_dropped_segments", """
WITH s AS (SELECT user_id, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS d, count(*) AS n FROM events GROUP BY ALL),
k AS (SELECT *, user_id || '#' || d AS segment, (user_id * 31 + d) % 11 = 0 AS dropped, (user_id + d) % 13 = 0 AS cut FROM s)
SELECT segment, CASE WHEN dropped OR n = 1 THEN 'missing' ELSE 'altered' END AS problem FROM k WHERE dropped OR cut""")
def h2d(t):
    """Some segments are dropped from the sealed ledger and some lose their first block: the seals tell which."""
    day = 86_400
    ledger = H.build_chain(H.segment_streams(chain_rows(t), day))
    user, at = F.split_part("stream", F.lit("#"), F.lit(1)).cast("long"), F.split_part("stream", F.lit("#"), F.lit(2)).cast("long")
    left = ledger.where(((user * 31 + at) % 11 != 0) & (((user + at) % 13 != 0) | (F.col("index") > 0)))
    seals = H.seal_segments(ledger, day)
    return H.verify_segments(left, seals, H.chain_tips(seals))


@query("h3_verify_chain", """
SELECT stream, CAST(i AS BIGINT) AS index, NOT bad AS hash_ok, NOT coalesce(prev_cut, false) AS link_ok FROM (
  SELECT stream, i, bad, lag(cut) OVER (PARTITION BY stream ORDER BY i) AS prev_cut FROM (
    SELECT user_id AS stream, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, value > 90 AS bad, false AS cut FROM events))
WHERE bad""")
def h3(t):
    """Blocks whose data was altered after sealing (large values) are exactly the bad ones."""
    rows = chain_rows(t)
    ledger = H.build_chain(rows)
    altered = t.events.where("value > 90").select(
        F.col("user_id").alias("stream"), F.col("ts").cast("timestamp").alias("ts"), F.lit(True).alias("altered")).distinct()
    forged = ledger.join(altered, ["stream", "ts"], "left").withColumn(
        "data_hash", F.when(F.col("altered"), F.sha2(F.lit("forged"), 256)).otherwise(F.col("data_hash"))).drop("altered")
    return H.verify_chain(forged)


@query("h4_repository_hash", """
WITH l AS (SELECT source AS job_id, sha256(text) AS h, count(*) AS n FROM documents GROUP BY ALL),
a AS (SELECT job_id, substr(h, 1, 6) AS pos, sha256(string_agg(h || ':' || n, chr(10) ORDER BY h)) AS d FROM l GROUP BY ALL),
b AS (SELECT job_id, substr(pos, 1, 3) AS pos2, sha256(string_agg(d, chr(10) ORDER BY pos)) AS d FROM a GROUP BY ALL)
SELECT job_id, sha256(string_agg(d, chr(10) ORDER BY pos2)) AS digest FROM b GROUP BY job_id""")
def h4(t):
    return H.repository_hash(t.documents.select(F.col("source").alias("job_id"), F.sha2("text", 256).alias("hash_sha256")))


@query("h5_tamper_diff", f"""
WITH f AS (SELECT d.path, d.content, d.mode, l.quality, l.toxic, d.lang FROM ({DOC}) d LEFT JOIN labels l USING (doc_id))
SELECT path, CASE WHEN lang = 'es' THEN 'added' WHEN toxic = 1 THEN 'deleted' WHEN quality = 0 THEN 'modified' ELSE 'permissions_changed' END AS change
FROM f WHERE NOT (lang = 'es' AND coalesce(toxic, 0) = 1) AND (lang = 'es' OR toxic = 1 OR quality = 0 OR mode = 33261)""")
def h5(t):
    labels = t.labels.select("doc_id", "quality", "toxic")
    f = B.doc_files(t).join(labels, "doc_id", "left")
    baseline = f.where("lang <> 'es'").select("path", F.sha2("content", 256).alias("hash"), F.col("mode").alias("permissions"))
    now = F.when(F.col("quality") == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content"))
    current = f.where("coalesce(toxic, 0) <> 1").select("path", F.sha2(now, 256).alias("hash"), F.lit(0o100644).alias("permissions"))
    return H.tamper_diff(baseline, current).select("path", "change")


def custody(t):
    """custody: events of a user are its records; the actor is named after the event type."""
    return t.events.select(
        F.col("user_id").alias("evidence_id"), "event_id", F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("action"), F.concat(F.lit("agent_"), F.col("event_type")).alias("actor"),
        F.when(F.col("value") > 40, "agent_view").otherwise("agent_click").alias("from_actor"),
        F.md5(F.floor(F.col("value") / 30).cast("string")).alias("hash_before"),
        F.md5(F.floor(F.col("value") / 25).cast("string")).alias("hash_after"))


SQL_CUSTODY = """
SELECT user_id AS evidence_id, event_id, ts, event_type AS action, 'agent_' || event_type AS actor,
  CASE WHEN value > 40 THEN 'agent_view' ELSE 'agent_click' END AS from_actor,
  md5(CAST(CAST(floor(value / 30) AS BIGINT) AS VARCHAR)) AS hash_before, md5(CAST(CAST(floor(value / 25) AS BIGINT) AS VARCHAR)) AS hash_after FROM events"""
W = "OVER (PARTITION BY evidence_id ORDER BY ts, event_id)"


@query("h6_custody_chain", f"SELECT evidence_id, event_id, action, actor, row_number() {W} AS position FROM ({SQL_CUSTODY})")
def h6(t):
    return H.custody_chain(custody(t)).select("evidence_id", "event_id", "action", "actor", "position")


@query("h6_custody_of_item", f"SELECT event_id, action, actor FROM ({SQL_CUSTODY}) WHERE evidence_id = 7")
def h6i(t):
    return H.custody_chain(custody(t), 7).select("event_id", "action", "actor")


@query("h7_current_holder", f"SELECT evidence_id, max_by(actor, ts) AS holder, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS since FROM ({SQL_CUSTODY}) GROUP BY evidence_id")
def h7(t):
    return H.current_holder(custody(t)).select("evidence_id", "holder", F.date_format("since", "yyyy-MM-dd HH:mm:ss").alias("since"))


@query("h8_invalid_transfers", f"SELECT evidence_id, event_id, from_actor, p AS prev_actor FROM (SELECT *, lag(actor) {W} AS p FROM ({SQL_CUSTODY})) WHERE p IS NOT NULL AND from_actor <> p")
def h8(t):
    return H.invalid_transfers(custody(t)).select("evidence_id", "event_id", "from_actor", "prev_actor")


@query("h9_custody_breaks", f"SELECT evidence_id, event_id FROM (SELECT *, lag(hash_after) {W} AS p FROM ({SQL_CUSTODY})) WHERE p IS NOT NULL AND hash_before <> p")
def h9(t):
    return H.custody_breaks(custody(t)).select("evidence_id", "event_id")


@query("h10_export_manifest", f"""
WITH m AS (SELECT job_id, 'file' AS kind, sha256(content) AS h FROM ({DOC}) UNION ALL SELECT 'src' || (user_id % 20), 'custody', sha256('COC-' || event_id) FROM events),
l AS (SELECT job_id, h, count(*) AS n FROM m GROUP BY ALL),
a AS (SELECT job_id, substr(h, 1, 6) AS pos, sha256(string_agg(h || ':' || n, chr(10) ORDER BY h)) AS d FROM l GROUP BY ALL),
b AS (SELECT job_id, substr(pos, 1, 3) AS pos2, sha256(string_agg(d, chr(10) ORDER BY pos)) AS d FROM a GROUP BY ALL),
r AS (SELECT job_id, sha256(string_agg(d, chr(10) ORDER BY pos2)) AS digest FROM b GROUP BY job_id)
SELECT job_id, count(*) FILTER (kind = 'file') AS files, count(*) FILTER (kind = 'custody') AS custody_records, '2024-06-01' AS exported_at, any_value(digest) AS digest
FROM m JOIN r USING (job_id) GROUP BY job_id""")
def h10(t):
    files = B.doc_files(t).select("job_id", "path", F.sha2("content", 256).alias("hash_sha256"))
    cust = t.events.select(F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("job_id"),
                           F.concat(F.lit("COC-"), F.col("event_id").cast("string")).alias("custody_id"))
    m = H.export_manifest(files, cust, F.lit("2024-06-01").cast("timestamp"))
    return H.manifest_summary(m).select("job_id", "files", "custody_records", F.date_format("exported_at", "yyyy-MM-dd").alias("exported_at"), "digest")


PLAN = """
SELECT o_orderkey, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') THEN 'retained_hold'
  WHEN o_orderdate >= TIMESTAMP '2002-01-01' - INTERVAL 1095 DAY THEN 'retained_retention' ELSE 'erased' END AS outcome
FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 5000)"""


def _plan(t):
    data = t.orders.select("o_orderkey", F.col("o_custkey").alias("subject_id"), F.col("o_orderdate").cast("timestamp").alias("recorded_at"))
    subjects = t.customer.where("c_acctbal < 5000").select(F.col("c_custkey").alias("subject_id"))
    holds = t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("subject_id"))
    return H.plan_erasure(data, subjects, holds, F.lit("2002-01-01").cast("timestamp"), 1095)


@query("h11_plan_erasure", PLAN)
def h11(t):
    return _plan(t).select("o_orderkey", "outcome")


@query("h11_erasure_report", f"SELECT outcome, count(*) AS items FROM ({PLAN}) GROUP BY outcome")
def h11r(t):
    return H.erasure_report(_plan(t))


@query("h12_record_checks", """
SELECT id, array_to_string(v, ',') AS violations, CASE WHEN len(v) = 0 THEN 'compliant' ELSE 'non_compliant' END AS status FROM (
  SELECT o_orderkey AS id, list_filter([
    CASE WHEN first_ship < o_orderdate + INTERVAL 60 DAY THEN 'retention' END,
    CASE WHEN c.c_custkey IS NULL THEN 'access_control' END,
    CASE WHEN coalesce(kinds, 0) < 3 THEN 'audit_trail' END,
    CASE WHEN o_custkey = o_orderkey % 1500 THEN 'conflict_of_interest' END], lambda x: x IS NOT NULL) AS v
  FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) c ON c_custkey = o_custkey
  LEFT JOIN (SELECT l_orderkey, count(DISTINCT l_returnflag) AS kinds, min(l_shipdate) AS first_ship FROM lineitem GROUP BY l_orderkey) a ON l_orderkey = o_orderkey)""")
def h12(t):
    shipped = t.lineitem.groupBy(F.col("l_orderkey").alias("id")).agg(F.min("l_shipdate").cast("timestamp").alias("deleted_at"))
    analyses = t.orders.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("analyst"), (F.col("o_orderkey") % 1500).alias("owner"),
        F.col("o_orderdate").cast("timestamp").alias("created_at")).join(shipped, "id", "left")
    allowed = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("analyst"))
    audit = t.lineitem.select(F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("action"))
    out = H.record_checks(analyses, allowed, audit, ["A", "N", "R"], F.lit("2002-01-01").cast("timestamp"), 60)
    return out.select("id", F.array_join("violations", ",").alias("violations"), "status")
