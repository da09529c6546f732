"""Registered queries: sources and sinks."""

from pyspark.sql import functions as F

from tracewright.plans import bindings as B
from tracewright.plans.files import INV
from tracewright.operators.files import inventory
from tracewright.plans.registry import query
from tracewright.sources import files as S
from tracewright.streaming.topics import decode_events, new_run_folder, read_events, read_table, split_decoded, write_table

q = B.sql_str


@query("a1_file_inventory", f"SELECT job_id, path, size_bytes, name, extension, strftime(modified_at, '%Y-%m-%d %H:%M:%S') AS modified_at FROM ({INV})")
def a1(t):
    return inventory(B.doc_files(t)).select(
        "job_id", "path", "size_bytes", "name", "extension", F.date_format("modified_at", "yyyy-MM-dd HH:mm:ss").alias("modified_at"))


@query("a1_scan_files", """
SELECT 'lang=' || lang || '/group=' || (doc_id // 100) AS folder, 'txt' AS extension, CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS size_bytes,
  sha256(string_agg(text || chr(10), '' ORDER BY doc_id)) AS hash_sha256 FROM documents GROUP BY lang, doc_id // 100""")
def a1s(t):
    """A tree of text files of up to 100 documents each, written to the shared folder and read back as files."""
    root = f"{new_run_folder(t.spark, 'tree')}/files"
    docs = t.documents.select("lang", F.floor(F.col("doc_id") / 100).alias("group"), "doc_id", "text")
    docs.repartition("lang", "group").sortWithinPartitions("lang", "group", "doc_id").select("lang", "group", "text").write.partitionBy("lang", "group").text(root)
    found = S.scan_files(t.spark, root).where(F.col("extension") == "txt")
    return found.select(F.regexp_replace("path", "/[^/]*$", "").alias("folder"), "extension", "size_bytes", F.sha2("content", 256).alias("hash_sha256"))


def log_lines(t):
    """Log lines rendered from events: sign-ups are cut short and view times are not numbers."""
    epoch = F.when(F.col("event_type") == "view", F.lit("soon")).otherwise(F.unix_timestamp("ts").cast("string"))
    return t.events.select(F.when(
        F.col("event_type") == "signup", F.concat_ws("|", F.sha1(F.col("event_id").cast("string")), F.lit("someone"))
    ).otherwise(F.concat_ws(
        "|", F.sha1(F.col("event_id").cast("string")), F.concat(F.lit("user"), F.col("user_id").cast("string")),
        F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit("@example.com")), epoch, F.col("event_type"), F.col("props"))).alias("line"))


@query("a2_parse_commit_log", """
SELECT sha1(CAST(event_id AS VARCHAR)) AS hash, 'user' || user_id AS author, 'user' || user_id || '@example.com' AS email,
  strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, event_type AS message FROM events WHERE event_type NOT IN ('signup', 'view')""")
def a2(t):
    return S.parse_commit_log(log_lines(t)).withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


def deletion_lines(t):
    """Three logs: a commit line per order, then one line per line item."""
    log = lambda k: F.concat(F.lit("log"), (F.col(k) % 3).cast("string")).alias("log_id")
    heads = t.orders.select(log("o_orderkey"), (F.col("o_orderkey") * 100).alias("line_no"), F.sha1(F.col("o_orderkey").cast("string")).alias("line"))
    rows = t.lineitem.select(
        log("l_orderkey"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("line_no"),
        F.concat(F.when(F.col("l_returnflag") == "R", " delete mode 100644 ").otherwise(" create mode 100644 "),
                 F.lit("part/"), F.col("l_partkey").cast("string")).alias("line"))
    return heads.unionByName(rows)


@query("a3_parse_deletions", """
SELECT 'log' || (l_orderkey % 3) AS log_id, l_orderkey * 100 + l_linenumber AS line_no, sha1(CAST(l_orderkey AS VARCHAR)) AS hash, 'part/' || l_partkey AS path
FROM lineitem WHERE l_returnflag = 'R'""")
def a3(t):
    return S.parse_deletions(deletion_lines(t))


@query("a4_parse_shortlog", """
SELECT c_name AS name, CASE WHEN c_acctbal < 1000 THEN 'unknown' ELSE lower(c_mktsegment) || c_custkey || '@example.com' END AS email, c_custkey % 97 AS commits
FROM customer WHERE c_mktsegment <> 'BUILDING'""")
def a4(t):
    count = F.when(F.col("c_mktsegment") == "BUILDING", "many").otherwise((F.col("c_custkey") % 97).cast("string"))
    mail = F.when(F.col("c_acctbal") < 1000, "").otherwise(F.concat(F.lit(" <"), F.lower("c_mktsegment"), F.col("c_custkey").cast("string"), F.lit("@example.com>")))
    return S.parse_shortlog(t.customer.select(F.concat(F.lit("   "), count, F.lit("\t"), "c_name", mail).alias("line")))


RELATION = "SELECT c_mktsegment AS segment, count(*) AS orders, max(o_totalprice) AS top FROM {orders} JOIN {customer} ON c_custkey = o_custkey GROUP BY c_mktsegment"


@query("a5_read_relation", RELATION.format(orders="orders", customer="customer"))
def a5(t):
    return S.read_relation(t.spark, RELATION, {"orders": t.orders, "customer": t.customer})


@query("a7_decode_events", """
SELECT event_id, event_type = 'error' AS is_bad, CASE WHEN event_type <> 'error' THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events""")
def a7(t):
    payload = F.when(F.col("event_type") == "error", F.concat(F.lit("{broken "), "props")).otherwise(F.col("props"))
    raw = t.events.select("event_id", payload.alias("value"))
    return decode_events(raw, "k long").select("event_id", F.col("corrupt").isNotNull().alias("is_bad"), F.col("event.k").alias("k"))


@query("a7_read_events", """
SELECT CASE WHEN event_type <> 'error' THEN event_id END AS event_id, event_type = 'error' AS is_bad, CASE WHEN event_type <> 'error' THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events""")
def a7r(t):
    """Event files of JSON lines, some of them broken, through the stream reader: good events and error rows."""
    folder = new_run_folder(t.spark, "event-files")
    line = F.to_json(F.struct("event_id", F.get_json_object("props", "$.k").cast("long").alias("k")))
    t.events.select(F.when(F.col("event_type") == "error", F.concat(F.lit("{broken "), "props")).otherwise(line).alias("value")).write.text(f"{folder}/in")
    write_table(read_events(t.spark, f"{folder}/in", "event_id long, k long"), folder, "events", f"{folder}/checkpoint").awaitTermination()
    good, bad = split_decoded(read_table(t.spark, folder, "events"))
    return good.select("event.event_id", F.lit(False).alias("is_bad"), "event.k").unionByName(
        bad.select(F.lit(None).cast("long").alias("event_id"), F.lit(True).alias("is_bad"), F.lit(None).cast("long").alias("k")))


@query("a9_storage_stats", f"SELECT count(*) AS file_count, CAST(sum(size_bytes) AS BIGINT) AS total_bytes FROM ({B.SQL_DOC_FILES}) WHERE starts_with(path, 'src/')")
def a9(t):
    return S.storage_stats(B.doc_files(t), "src/")


RET = "SELECT o_orderkey, o_orderdate < TIMESTAMP '2003-01-01' - INTERVAL 2555 DAY AS expired, CAST(floor(o_totalprice) AS BIGINT) AS size_bytes FROM orders"


def _objects(t):
    return t.orders.select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("modified_at"), F.floor("o_totalprice").alias("size_bytes"))


@query("a10_retention_filter", f"SELECT o_orderkey FROM ({RET}) WHERE NOT expired")
def a10(t):
    return S.retention_filter(_objects(t), F.lit("2003-01-01").cast("timestamp")).select("o_orderkey")


@query("a10_retention_report", f"SELECT expired, count(*) AS objects, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM ({RET}) GROUP BY expired")
def a10r(t):
    return S.retention_report(_objects(t), F.lit("2003-01-01").cast("timestamp"))


@query("a12_archive_summary", "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS events FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12' GROUP BY 1")
def a12(t):
    e = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    return S.archive_summary(e, F.lit("2024-01-05").cast("timestamp"), F.lit("2024-01-12").cast("timestamp")).withColumn("day", F.col("day").cast("string"))


@query("a12_delete_range", "SELECT event_id FROM events WHERE ts < TIMESTAMP '2024-01-05' OR ts >= TIMESTAMP '2024-01-12'")
def a12d(t):
    e = t.events.withColumn("ts", F.col("ts").cast("timestamp"))
    return S.delete_range(e, F.lit("2024-01-05").cast("timestamp"), F.lit("2024-01-12").cast("timestamp")).select("event_id")
