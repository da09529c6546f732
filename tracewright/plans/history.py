"""Registered queries: commit history."""

from pyspark.sql import functions as F

from tracewright import rules as R
from tracewright.operators import files as O
from tracewright.operators import history as H
from tracewright.plans import bindings as B
from tracewright.plans.files import INV, LANGUAGE
from tracewright.plans.registry import query

q = B.sql_str
COMMITS = B.SQL_COMMITS
CF = B.SQL_COMMIT_FILES
CHAT_RULES = R.MESSAGE_RULES + [R.Rule(
    "Repeated syllables", r"(?i)(anan|oren).*tion", "suspicious_code", "low", 0.6, "Suspicious commit message: syllables")]
CHATS = "SELECT role AS repo, sha1(conv_id || '-' || turn) AS hash, text AS message FROM conversations"


def _msg_sql(rules):
    return " UNION ALL ".join(
        f"SELECT repo, hash, {q(r.title)} AS title, {q(r.severity)} AS severity, CAST({r.confidence} AS DOUBLE) AS confidence FROM c WHERE regexp_matches(message, {q(r.pattern)})"
        for r in rules)


@query("e1_suspicious_messages", f"WITH c AS (SELECT repo, hash, message FROM ({COMMITS}) UNION ALL {CHATS}) {_msg_sql(CHAT_RULES)}")
def e1(t):
    chats = t.conversations.select(
        F.col("role").alias("repo"),
        F.sha1(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))).alias("hash"),
        F.col("text").alias("message"))
    rows = B.commits(t).select("repo", "hash", "message").unionByName(chats)
    return H.suspicious_messages(rows, CHAT_RULES).select(
        F.col("job_id").alias("repo"), F.col("evidence")["commit_hash"].alias("hash"), "title", "severity", "confidence")


TOTALS = f"""SELECT hash, count(*) AS files_changed, CAST(sum(added) AS BIGINT) AS lines_added, CAST(sum(removed) AS BIGINT) AS lines_removed,
  count(*) FILTER (status = 'D') AS files_deleted FROM ({CF}) GROUP BY hash"""


@query("e2_large_commits", f"SELECT * FROM ({TOTALS}) WHERE files_changed > 8 OR lines_added > 200")
def e2(t):
    return H.large_commits(B.commit_files(t), 8, 200)


@query("e3_off_hours", f"SELECT hash, author FROM ({COMMITS}) WHERE hour(ts) < 6 OR hour(ts) > 22")
def e3(t):
    return H.off_hours(B.commits(t)).select("hash", "author")


@query("e4_busy_days", f"""
WITH d AS (SELECT repo, CAST(ts AS DATE) AS day, count(*) AS commits FROM ({COMMITS}) GROUP BY ALL),
s AS (SELECT repo, avg(commits) AS mean, stddev_pop(commits) AS sd, sum(commits) AS total FROM d GROUP BY repo)
SELECT repo, strftime(day, '%Y-%m-%d') AS day, commits, round(mean, 6) AS mean, round(mean + 2 * sd, 6) AS threshold
FROM d JOIN s USING (repo) WHERE total >= 10 AND commits > mean + 2 * sd AND commits > 20""")
def e4(t):
    return H.busy_days(B.commits(t)).select(
        "repo", F.col("day").cast("string").alias("day"), "commits", F.round("mean", 6).alias("mean"),
        F.round("threshold", 6).alias("threshold"))


@query("e5_latest_commits", f"""
SELECT repo, hash FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY ts DESC, hash) AS rn FROM ({COMMITS})) WHERE rn <= 1000""")
def e5(t):
    return H.latest_commits(B.commits(t), 1000).select("repo", "hash")


@query("e6_sensitive_deletions", f"""
SELECT hash, path FROM ({CF}) WHERE status = 'D' AND {B.sql_any_contains('lower(path)', R.SENSITIVE_PATH_WORDS)}""")
def e6(t):
    return H.sensitive_deletions(B.commit_files(t)).select("hash", "path")


@query("e7_mass_deletions", f"SELECT * FROM ({TOTALS}) WHERE files_deleted > 0 AND files_changed > 5 AND lines_removed > lines_added * 2")
def e7(t):
    return H.mass_deletions(B.commit_files(t), 5, 2)


PEOPLE = f"""
SELECT email, max(author) AS name, count(*) AS commits, CAST(coalesce(sum(lines_added), 0) AS BIGINT) AS lines_added,
  CAST(coalesce(sum(lines_removed), 0) AS BIGINT) AS lines_removed, min(ts) AS first_commit, max(ts) AS last_commit
FROM ({COMMITS}) c LEFT JOIN ({TOTALS}) x ON x.hash = c.hash GROUP BY email"""


def _people(t):
    return H.contributors(B.commits(t), B.commit_files(t))


def _stamp(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


@query("e8_contributors", f"""
SELECT email, name, commits, lines_added, lines_removed, strftime(first_commit, '%Y-%m-%d %H:%M:%S') AS first_commit,
  strftime(last_commit, '%Y-%m-%d %H:%M:%S') AS last_commit FROM ({PEOPLE})""")
def e8(t):
    return _people(t).select("email", "name", "commits", "lines_added", "lines_removed", _stamp("first_commit"), _stamp("last_commit"))


@query("e9_high_impact", f"SELECT email, commits, lines_added FROM ({PEOPLE}) WHERE commits < 12 AND lines_added > 800")
def e9(t):
    return H.high_impact(_people(t), 12, 800).select("email", "commits", "lines_added")


EMAILS = f"SELECT DISTINCT unnest(regexp_extract_all(text, {q(R.EMAIL)})) AS email FROM documents UNION SELECT DISTINCT email FROM ({COMMITS})"


@query("e10_suspicious_email", f"SELECT email FROM ({EMAILS}) WHERE {B.sql_any_contains('lower(email)', R.THROWAWAY_DOMAINS + R.ROLE_ADDRESSES)}")
def e10(t):
    found = t.documents.select(F.explode(F.regexp_extract_all("text", F.lit(R.EMAIL), F.lit(0))).alias("email"))
    return H.suspicious_email(found.unionByName(B.commits(t).select("email")).distinct())


BRANCHES = "SELECT p_brand AS repo, CASE WHEN p_size > 25 THEN 'temp/' ELSE 'feature/' END || replace(p_name, ' ', '-') AS name, sha1(CAST(p_partkey AS VARCHAR)) AS last_commit FROM part"


@query("e11_suspicious_branches", f"SELECT repo, name, last_commit, 'low' AS severity FROM ({BRANCHES}) WHERE regexp_matches(name, {q(R.BRANCH_RULES[0].pattern)})")
def e11(t):
    branches = t.part.select(
        F.col("p_brand").alias("repo"),
        F.concat(F.when(F.col("p_size") > 25, "temp/").otherwise("feature/"), F.replace("p_name", F.lit(" "), F.lit("-"))).alias("name"),
        F.sha1(F.col("p_partkey").cast("string")).alias("last_commit"))
    ev = F.col("evidence")
    return H.suspicious_branches(branches).select(
        F.col("job_id").alias("repo"), ev["branch_name"].alias("name"), ev["last_commit"].alias("last_commit"), "severity")


@query("e12_file_churn", f"""
WITH c AS (SELECT path, count(*) AS modifications, strftime(max(ts), '%Y-%m-%d') AS last_modified FROM ({CF}) GROUP BY path)
SELECT *, 'low' AS severity FROM c WHERE modifications > 12
UNION ALL SELECT *, 'medium' FROM c WHERE modifications > 10 AND regexp_matches(lower(path), {q("(" + "|".join(s.replace(".", "[.]") for s in R.HISTORY_BINARY_SUFFIXES) + ")$")})""")
def e12(t):
    return H.file_churn(B.commit_files(t), 12, 10).select(
        "path", "modifications", F.date_format("last_modified", "yyyy-MM-dd").alias("last_modified"), "severity")


REFS = """SELECT 'src' || (user_id % 20) AS repo, CASE WHEN event_type IN ('signup', 'error') THEN 'tag' ELSE 'branch' END AS kind,
  CASE WHEN event_type IN ('signup', 'error') THEN 'v' || event_id ELSE event_type || '-' || user_id END AS name, ts, event_type = 'purchase' AS is_head FROM events WHERE user_id % 20 <> 7"""


@query("e13_repository_profile", f"""
SELECT repo, commit_count, contributors, last_commit, head_commit, age_days, file_count, size_bytes, languages, branch, coalesce(tags, 0) AS tags, latest_tag FROM (
  SELECT 'src' || (user_id % 20) AS repo, count(*) AS commit_count, count(DISTINCT email) AS contributors,
    strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_commit, max_by(hash, (ts, hash)) AS head_commit, CAST(date_diff('day', CAST(min(ts) AS DATE), DATE '2024-06-01') AS INT) AS age_days
  FROM ({COMMITS}) GROUP BY 1)
FULL JOIN (SELECT job_id AS repo, count(*) AS file_count, CAST(sum(size_bytes) AS BIGINT) AS size_bytes,
  array_to_string(list_sort(list_distinct(list({LANGUAGE}))), ',') AS languages FROM ({INV}) GROUP BY job_id) USING (repo)
LEFT JOIN (SELECT repo, max(name) FILTER (kind = 'branch' AND is_head) AS branch, count(*) FILTER (kind = 'tag') AS tags, max_by(name, (ts, name)) FILTER (kind = 'tag') AS latest_tag
  FROM ({REFS}) GROUP BY repo) USING (repo)""")
def e13(t):
    commits = B.commits(t).withColumn("repo", F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")))
    files = O.detect_language(O.inventory(B.doc_files(t)))
    tag = F.col("event_type").isin("signup", "error")
    refs = t.events.where("user_id % 20 <> 7").select(
        F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("repo"), F.when(tag, "tag").otherwise("branch").alias("kind"),
        F.when(tag, F.concat(F.lit("v"), F.col("event_id").cast("string"))).otherwise(F.concat_ws("-", "event_type", F.col("user_id").cast("string"))).alias("name"),
        F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "purchase").alias("is_head"))
    return H.repository_profile(commits, files, F.lit("2024-06-01").cast("date"), refs).select(
        "repo", "commit_count", "contributors", _stamp("last_commit"), "head_commit", "age_days", "file_count", "size_bytes",
        F.array_join("languages", ",").alias("languages"), "branch", "tags", "latest_tag")


_MSG = " OR ".join(f"regexp_matches(message, {q(r.pattern)})" for r in R.MESSAGE_RULES)


@query("e14_suspicious_commits", f"""
SELECT * FROM (
  SELECT c.hash, array_to_string(list_filter([CASE WHEN hour(ts) < 6 OR hour(ts) > 22 THEN 'unusual_time' END,
    CASE WHEN files_changed > 8 OR lines_added > 200 THEN 'large_changes' END, CASE WHEN {_MSG} THEN 'suspicious_message' END,
    CASE WHEN {B.sql_any_contains('lower(email)', R.THROWAWAY_DOMAINS + R.ROLE_ADDRESSES)} THEN 'suspicious_email' END], lambda x: x IS NOT NULL), ',') AS risk_indicators
  FROM ({COMMITS}) c LEFT JOIN ({TOTALS}) x ON x.hash = c.hash) WHERE risk_indicators <> ''""")
def e14(t):
    return H.suspicious_commits(B.commits(t), B.commit_files(t), files=8, lines=200).select(
        "hash", F.array_join("risk_indicators", ",").alias("risk_indicators"))


@query("e15_commit_timeline", f"""
SELECT hash, date_sub('second', ts, committed_at) AS commit_delay,
  date_sub('second', lag(ts) OVER (PARTITION BY author ORDER BY ts, hash), ts) AS gap FROM ({COMMITS})""")
def e15(t):
    return H.commit_timeline(B.commits(t)).select("hash", "commit_delay", "gap")


def graph_commits(t):
    e = F.col("event_id")
    parents = F.when(e == 0, F.array().cast("array<string>")).when(
        F.col("value") > 60, F.array(F.sha1((e - 1).cast("string")), F.sha1((e - 700).cast("string")))
    ).otherwise(F.array(F.sha1((e - 1).cast("string"))))
    return t.events.select(F.sha1(e.cast("string")).alias("hash"), parents.alias("parents"))


@query("e16_commit_graph", """
WITH c AS (SELECT sha1(CAST(event_id AS VARCHAR)) AS hash, CASE WHEN event_id = 0 THEN CAST([] AS VARCHAR[])
    WHEN value > 60 THEN [sha1(CAST(event_id - 1 AS VARCHAR)), sha1(CAST(event_id - 700 AS VARCHAR))] ELSE [sha1(CAST(event_id - 1 AS VARCHAR))] END AS parents FROM events),
m AS (SELECT hash, count(*) AS n FROM (SELECT hash, unnest(parents) AS p FROM c) WHERE p NOT IN (SELECT hash FROM c) GROUP BY hash)
SELECT c.hash, CAST(len(parents) AS INT) AS parent_count, CASE len(parents) WHEN 0 THEN 'root' WHEN 1 THEN 'linear' ELSE 'merge' END AS kind,
  coalesce(n, 0) AS missing_parents FROM c LEFT JOIN m ON m.hash = c.hash""")
def e16(t):
    return H.commit_graph(graph_commits(t))
