"""The given tables as the engine's tables, in Spark and (for the independent check) in SQL.

Every derivation is row-local, so the derived tables grow with the given ones and cost no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.functions.lines import WHITESPACE
from tracewright.plans.registry import Tables

# Where a document lives and what it is called: folder by language, name by position in this list.
FOLDERS = {"en": "src/app", "de": "build/out", "fr": "srv/.cache", "es": "config/private"}
NAMES = [
    "mod_%.py", "mod_%.js", "lib_%.rs", "cmd_%.go", "Unit%.java", "unit_%.c", "unit_%.cpp", "Unit%.cs",
    "view_%.ts", "notes_%.md", "notes_%.txt", "%/config.yaml", "%/credentials.json", "conf_%.toml",
    "page_%.html", "tool_%.exe", "image_%.png", "pack_%.zip", "%/.env", "%/Makefile",
]


def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_list(values) -> str:
    return "[" + ", ".join(sql_str(v) for v in values) + "]"


def sql_in(values) -> str:
    return "(" + ", ".join(sql_str(v) for v in values) + ")"


def sql_case(mapping: dict, col: str, default: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {col} = {sql_str(k)} THEN {sql_str(v)}" for k, v in mapping.items()) + f" ELSE {default} END"


def sql_any_contains(col: str, words) -> str:
    return "(" + " OR ".join(f"contains({col}, {sql_str(w)})" for w in words) + ")"


# chr() calls keep the SQL printable.
SQL_WS = "(" + " || ".join(f"chr({ord(c)})" for c in WHITESPACE) + ")"


def sql_trim(col: str) -> str:
    return f"trim({col}, {SQL_WS})"


def sql_lines(col: str) -> str:
    return f"CASE WHEN {col} = '' THEN CAST([] AS VARCHAR[]) ELSE string_split(regexp_replace({col}, '\\n$', ''), chr(10)) END"


# ----- files ---------------------------------------------------------------

def doc_files(t: Tables) -> DataFrame:
    """files(job_id, path, size_bytes, modified_at, mode, content, doc_id, lang): one per document."""
    names = F.array(*[F.lit(n) for n in NAMES])
    name = F.element_at(names, (F.col("doc_id") % len(NAMES) + 1).cast("int"))
    folder = F.create_map(*[F.lit(x) for kv in FOLDERS.items() for x in kv])[F.col("lang")]
    return t.documents.select(
        F.col("source").alias("job_id"),
        F.concat_ws("/", folder, F.replace(name, F.lit("%"), F.col("doc_id").cast("string"))).alias("path"),
        F.octet_length("text").cast("long").alias("size_bytes"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins=F.col("doc_id").cast("int"))).alias("modified_at"),
        F.when(F.col("lang") == "en", 0o100644).otherwise(0o100755).alias("mode"),
        F.col("text").alias("content"),
        "doc_id", "lang",
    )


SQL_DOC_FILES = f"""
SELECT source AS job_id,
       {sql_case(FOLDERS, 'lang')} || '/' || replace(({sql_list(NAMES)})[CAST(doc_id % {len(NAMES)} AS INT) + 1], '%', CAST(doc_id AS VARCHAR)) AS path,
       CAST(octet_length(encode(text)) AS BIGINT) AS size_bytes,
       TIMESTAMP '2024-01-01' + to_minutes(CAST(doc_id AS INT)) AS modified_at,
       CASE WHEN lang = 'en' THEN 33188 ELSE 33261 END AS mode,
       text AS content, doc_id, lang
FROM documents"""

SQL_EXT = r"CASE WHEN regexp_matches(name, '(?s)^.+\.[^.]*$') THEN lower(regexp_extract(name, '\.([^.]*)$', 1)) END"
SQL_INVENTORY = f"""
SELECT *, {SQL_EXT} AS extension FROM (SELECT *, string_split(path, '/')[-1] AS name FROM ({SQL_DOC_FILES}))"""


def page_files(t: Tables) -> DataFrame:
    """files from raw web pages; the job is the host."""
    return t.pages.select(
        F.regexp_extract("url", r"^https?://([^/]+)", 1).alias("job_id"),
        F.regexp_replace("url", r"^https?://", "").alias("path"),
        F.octet_length("html").cast("long").alias("size_bytes"),
        F.lit("html").alias("language"),
        F.col("html").alias("content"),
        "page_id", "url",
    )


SQL_PAGE_FILES = r"""
SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS job_id, regexp_replace(url, '^https?://', '') AS path,
       CAST(octet_length(encode(html)) AS BIGINT) AS size_bytes, 'html' AS language, html AS content, page_id, url
FROM pages"""


# ----- code files: one small source file per order, its lines a rendering of the row ----

CODE_LANGUAGES = ["rust", "python", "javascript", "typescript", "go", "java", "c", "cpp", "csharp"]
CODE_EXT = ["rs", "py", "js", "ts", "go", "java", "c", "cpp", "cs"]
BY_PRIORITY = {
    "1-URGENT": "result = eval(input);",
    "2-HIGH": 'cursor.execute("SELECT a FROM t WHERE id = %s" % id)',
    "3-MEDIUM": "unsafe { std::mem::transmute(x) }",
    "4-NOT SPECIFIED": "// TODO: fix this hack",
    "5-LOW": "strcpy(buf, name); exec(cmd)",
}
BY_STATUS = {
    "P": 'exec.Command("sh " + arg); Statement.executeQuery("q" + id)',
    "F": 'password = "hunter2-longer"',
    "O": 'x = "SELECT " + name; new SqlCommand("q" + id); open("../../etc/x")',
}


def _pick(mapping: dict, col: str):
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])[F.col(col)]


def code_files(t: Tables) -> DataFrame:
    """files(job_id, path, file_type, language, content, file_key): language by customer, lines by order attributes."""
    at = (F.col("o_custkey") % len(CODE_LANGUAGES) + 1).cast("int")
    key = F.col("o_orderkey").cast("string")
    big = F.col("o_totalprice") > 250000
    content = F.concat_ws(
        "\n",
        F.concat(F.lit("// order "), key, F.lit(" of customer "), F.col("o_custkey").cast("string")),
        _pick(BY_PRIORITY, "o_orderpriority"),
        _pick(BY_STATUS, "o_orderstatus"),
        F.when(big, F.lit("if err != nil && ok { return x ? 1 : 0; }")).otherwise(F.lit("el.innerHTML = value; goto done")),
        F.concat(F.lit("lib_"), (F.col("o_custkey") % 50).cast("string"), F.lit(' = "1.'),
                 (F.col("o_orderkey") % 5).cast("string"), F.lit('"')),
        F.concat(F.lit("aws = "), F.when(big, F.concat(F.lit("AKIA"), F.upper(F.substring(F.md5(key), 1, 16))))
                 .otherwise(F.concat(F.lit("ghp_"), F.substring(F.sha2(key, 256), 1, 36)))),
        F.concat(F.lit("fn run_"), key, F.lit("(x) {")),
        F.concat(F.repeat(F.lit("  step(x); \\\n"), F.floor(F.col("o_totalprice") / 6000).cast("int")), F.lit("}")),
        F.lit("  try { go() } catch (e) { }"),
    )
    return t.orders.select(
        F.col("o_orderstatus").alias("job_id"),
        F.concat(F.lit("src/"), F.col("o_custkey").cast("string"), F.lit("/unit_"), key, F.lit("."),
                 F.element_at(F.array(*[F.lit(e) for e in CODE_EXT]), at)).alias("path"),
        F.lit("code").alias("file_type"),
        F.element_at(F.array(*[F.lit(e) for e in CODE_LANGUAGES]), at).alias("language"),
        content.alias("content"),
        F.col("o_orderkey").alias("file_key"),
    )


SQL_CODE_FILES = f"""
SELECT o_orderstatus AS job_id,
       'src/' || o_custkey || '/unit_' || o_orderkey || '.' || ({sql_list(CODE_EXT)})[CAST(o_custkey % 9 AS INT) + 1] AS path,
       'code' AS file_type,
       ({sql_list(CODE_LANGUAGES)})[CAST(o_custkey % 9 AS INT) + 1] AS language,
       array_to_string([
         '// order ' || o_orderkey || ' of customer ' || o_custkey,
         {sql_case(BY_PRIORITY, 'o_orderpriority')},
         {sql_case(BY_STATUS, 'o_orderstatus')},
         CASE WHEN o_totalprice > 250000 THEN 'if err != nil && ok {{ return x ? 1 : 0; }}' ELSE 'el.innerHTML = value; goto done' END,
         'lib_' || (o_custkey % 50) || ' = "1.' || (o_orderkey % 5) || '"',
         'aws = ' || CASE WHEN o_totalprice > 250000 THEN 'AKIA' || upper(substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 16))
                     ELSE 'ghp_' || substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 36) END,
         'fn run_' || o_orderkey || '(x) {{',
         repeat('  step(x); ' || chr(92) || chr(10), CAST(floor(o_totalprice / 6000) AS INT)) || '}}',
         '  try {{ go() }} catch (e) {{ }}'], chr(10)) AS content,
       o_orderkey AS file_key
FROM orders"""


def sql_explode(source: str, keep: str) -> str:
    """SQL rows (keep..., line_number, line) of a files subquery."""
    return (
        f"SELECT {keep}, unnest(ls) AS line, CAST(generate_subscripts(ls, 1) AS INT) AS line_number "
        f"FROM (SELECT *, {sql_lines('content')} AS ls FROM ({source}))"
    )


# ----- history --------------------------------------------------------------

def commits(t: Tables) -> DataFrame:
    """commits(repo, hash, author, email, ts, committed_at, message): one per event."""
    domain = F.create_map(*[F.lit(x) for kv in COMMIT_DOMAINS.items() for x in kv])[F.col("event_type")]
    return t.events.select(
        F.col("event_type").alias("repo"),
        F.sha1(F.col("event_id").cast("string")).alias("hash"),
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("author"),
        F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit("@"), domain).alias("email"),
        F.col("ts").cast("timestamp").alias("ts"),
        (F.col("ts").cast("timestamp") + F.make_dt_interval(secs=F.floor("value"))).alias("committed_at"),
        F.concat_ws(" ", _pick(COMMIT_MESSAGES, "event_type"), F.col("props")).alias("message"),
        "event_id", "user_id", "value",
    )


COMMIT_DOMAINS = {
    "view": "example.com", "click": "mailinator.com", "error": "tempmail.org", "purchase": "example.org",
    "signup": "corp.example",
}
COMMIT_MESSAGES = {
    "view": "update docs", "click": "Delete old API key", "error": "backdoor in login fixed", "purchase": "add billing",
    "signup": "clean temp files",
}
SQL_COMMITS = f"""
SELECT event_type AS repo, sha1(CAST(event_id AS VARCHAR)) AS hash, 'user' || user_id AS author,
       'user' || user_id || '@' || {sql_case(COMMIT_DOMAINS, 'event_type')} AS email, ts,
       ts + to_seconds(CAST(floor(value) AS BIGINT)) AS committed_at, {sql_case(COMMIT_MESSAGES, 'event_type')} || ' ' || props AS message, event_id, user_id, value
FROM events"""


def commit_files(t: Tables) -> DataFrame:
    """commit_files(hash, path, status, added, removed): one per line item."""
    ext = F.when(F.col("l_returnflag") == "A", ".bin").when(F.col("l_returnflag") == "N", ".rs").otherwise(".key")
    return t.lineitem.select(
        F.sha1(F.col("l_orderkey").cast("string")).alias("hash"),
        F.col("l_orderkey").alias("order_key"),
        F.concat(F.lit("part/"), F.col("l_partkey").cast("string"), ext).alias("path"),
        F.when(F.col("l_returnflag") == "R", "D").when(F.col("l_returnflag") == "A", "M").otherwise("A").alias("status"),
        F.col("l_quantity").cast("long").alias("added"),
        F.floor(F.col("l_extendedprice") / 1000).cast("long").alias("removed"),
        F.col("l_shipdate").cast("timestamp").alias("ts"),
    )


SQL_COMMIT_FILES = """
SELECT sha1(CAST(l_orderkey AS VARCHAR)) AS hash, l_orderkey AS order_key,
       'part/' || l_partkey || CASE l_returnflag WHEN 'A' THEN '.bin' WHEN 'N' THEN '.rs' ELSE '.key' END AS path,
       CASE l_returnflag WHEN 'R' THEN 'D' WHEN 'A' THEN 'M' ELSE 'A' END AS status,
       CAST(l_quantity AS BIGINT) AS added, CAST(floor(l_extendedprice / 1000) AS BIGINT) AS removed, l_shipdate AS ts
FROM lineitem"""


# ----- findings, jobs -------------------------------------------------------

FINDING_TYPES = {
    "error": "malware", "view": "anomaly", "click": "secret_exposure", "purchase": "vulnerability", "signup": "data_leak",
}


def findings(t: Tables) -> DataFrame:
    """findings: one per event, severity and confidence from its value, job from its user."""
    v = F.col("value")
    return t.events.select(
        F.sha2(F.col("event_id").cast("string"), 256).alias("finding_id"),
        F.concat(F.lit("job"), F.col("user_id").cast("string")).alias("job_id"),
        F.concat(F.lit("f/"), F.col("event_id").cast("string")).alias("path"),
        _pick(FINDING_TYPES, "event_type").alias("finding_type"),
        F.when(v >= 90, "critical").when(v >= 60, "high").when(v >= 30, "medium").when(v >= 10, "low")
        .otherwise("info").alias("severity"),
        F.concat(F.lit("Finding "), F.col("event_type")).alias("title"),
        F.least(F.lit(1.0), F.floor(v) / 100).alias("confidence"),
        F.concat(F.lit("CVE-"), F.col("user_id").cast("string")).alias("cve_id"),
        F.col("ts").cast("timestamp").alias("detected_at"),
        "event_id",
    )


SQL_FINDINGS = f"""
SELECT sha256(CAST(event_id AS VARCHAR)) AS finding_id, 'job' || user_id AS job_id, 'f/' || event_id AS path,
  {sql_case(FINDING_TYPES, 'event_type')} AS finding_type,
  CASE WHEN value >= 90 THEN 'critical' WHEN value >= 60 THEN 'high' WHEN value >= 30 THEN 'medium' WHEN value >= 10 THEN 'low' ELSE 'info' END AS severity,
  'Finding ' || event_type AS title, least(CAST(1.0 AS DOUBLE), floor(value) / 100) AS confidence, 'CVE-' || user_id AS cve_id, ts AS detected_at, event_id
FROM events"""

JOB_STATUS = {"O": "running", "F": "completed", "P": "queued"}
JOB_PRIORITY = {"1-URGENT": "critical", "2-HIGH": "high", "3-MEDIUM": "normal", "4-NOT SPECIFIED": "normal", "5-LOW": "low"}


def jobs(t: Tables) -> DataFrame:
    """jobs: one per order; only completed ones have an end."""
    start = F.col("o_orderdate").cast("timestamp")
    return t.orders.select(
        F.col("o_orderkey").alias("id"),
        _pick(JOB_STATUS, "o_orderstatus").alias("status"),
        _pick(JOB_PRIORITY, "o_orderpriority").alias("priority"),
        F.concat(F.lit("user"), F.col("o_custkey").cast("string")).alias("submitter_id"),
        F.concat(F.lit("case"), (F.col("o_custkey") % 100).cast("string")).alias("case_number"),
        start.alias("created_at"), start.alias("started_at"),
        F.when(F.col("o_orderstatus") == "F", start + F.make_dt_interval(secs=F.floor("o_totalprice"))).alias("completed_at"),
    )


SQL_JOBS = f"""
SELECT o_orderkey AS id, {sql_case(JOB_STATUS, 'o_orderstatus')} AS status, {sql_case(JOB_PRIORITY, 'o_orderpriority')} AS priority,
  'user' || o_custkey AS submitter_id, 'case' || (o_custkey % 100) AS case_number, o_orderdate AS created_at, o_orderdate AS started_at,
  CASE WHEN o_orderstatus = 'F' THEN o_orderdate + to_seconds(CAST(floor(o_totalprice) AS BIGINT)) END AS completed_at
FROM orders"""

# ----- pipeline events ------------------------------------------------------

EVENT_KINDS = {
    "view": "model_deployment", "click": "data_pipeline", "error": "inference", "purchase": "compliance", "signup": "custom",
}


def pipeline_events(t: Tables) -> DataFrame:
    """pipeline_events: one per event, with gaps in the required fields that follow from its value."""
    v, e = F.floor("value"), F.col("event_id")
    name = F.when(v == 7, "").otherwise(F.concat(F.lit("model-"), F.col("user_id").cast("string")))
    digest = F.when(v == 11, "").when(v == 13, "not-a-hash").otherwise(F.sha2("props", 256))
    first = F.struct(name.alias("name"), F.lit("s3://bucket/a").alias("uri"), digest.alias("hash_sha256"))
    second = F.struct(F.lit("report").alias("name"), F.lit(None).cast("string").alias("uri"),
                      F.when(v == 7, "").otherwise(F.sha2(e.cast("string"), 256)).alias("hash_sha256"))
    return t.events.select(
        F.when(v == 3, "").otherwise(F.concat(F.lit("ev-"), e.cast("string"))).alias("event_id"),
        e.alias("seq"),
        _pick(EVENT_KINDS, "event_type").alias("event_kind"),
        F.when(F.col("event_type") == "signup", F.concat(F.lit("step"), (F.col("user_id") % 3).cast("string"))).alias("custom_name"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(v == 4, "").otherwise(F.concat(F.lit("src"), (F.col("user_id") % 5).cast("string"))).alias("source"),
        F.struct(F.lit("service").alias("type"),
                 F.when(v == 5, "").otherwise(F.concat(F.lit("user"), F.col("user_id").cast("string"))).alias("id"),
                 F.lit(None).cast("string").alias("auth_provider")).alias("actor"),
        F.when(v % 2 == 0, F.array(first)).otherwise(F.array(first, second)).alias("artifacts"),
        F.create_map(F.lit("props"), F.col("props"), F.lit("kind"), F.col("event_type")).alias("metadata"),
        F.when(v >= 80, "critical").when(v >= 50, "high").when(v >= 15, "normal").otherwise("low").alias("priority"),
        F.when(F.col("event_type") == "purchase", "approval_sign").when(F.col("event_type") == "click", "batch_sign")
        .when((F.col("event_type") == "signup") & (v > 40), "custom_flow").otherwise("simple_sign").alias("workflow_type"),
        F.when(v % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("lead"), F.lit("cto"))).alias("approvers"),
    )


SQL_PIPELINE = f"""
SELECT CASE WHEN v = 3 THEN '' ELSE 'ev-' || event_id END AS event_id, event_id AS seq, {sql_case(EVENT_KINDS, 'event_type')} AS event_kind,
  CASE WHEN event_type = 'signup' THEN 'step' || (user_id % 3) END AS custom_name, ts,
  CASE WHEN v = 4 THEN '' ELSE 'src' || (user_id % 5) END AS source, CASE WHEN v = 5 THEN '' ELSE 'user' || user_id END AS actor_id,
  CASE WHEN v = 7 THEN '' ELSE 'model-' || user_id END AS name1, CASE WHEN v = 11 THEN '' WHEN v = 13 THEN 'not-a-hash' ELSE sha256(props) END AS hash1,
  v % 2 <> 0 AS two, CASE WHEN v = 7 THEN '' ELSE sha256(CAST(event_id AS VARCHAR)) END AS hash2, props, event_type,
  CASE WHEN v >= 80 THEN 'critical' WHEN v >= 50 THEN 'high' WHEN v >= 15 THEN 'normal' ELSE 'low' END AS priority,
  CASE WHEN event_type = 'purchase' THEN 'approval_sign' WHEN event_type = 'click' THEN 'batch_sign'
    WHEN event_type = 'signup' AND v > 40 THEN 'custom_flow' ELSE 'simple_sign' END AS workflow_type, v % 3 = 0 AS no_approvers
FROM (SELECT *, CAST(floor(value) AS BIGINT) AS v FROM events)"""
