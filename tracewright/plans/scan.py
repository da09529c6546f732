"""Registered queries: security findings."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright import rules as R
from tracewright.operators import files as O
from tracewright.operators import reports as G
from tracewright.operators import scan as S
from tracewright.plans import bindings as B
from tracewright.plans.files import TYPED, _typed
from tracewright.plans.registry import query

FLAT = ["finding_id", "job_id", "path", "line_number", "finding_type", "severity", "title", "confidence"]


def flat(findings: DataFrame, evidence: str | None = None) -> DataFrame:
    cols = list(FLAT)
    if evidence:
        return findings.select(*cols, F.col("evidence")[evidence].alias("evidence"))
    return findings.select(*cols)


def sql_finding(source, rule, kind, severity, title, confidence, evidence=None, where="true", line="NULL", path="path"):
    """SELECT of the flat finding columns; arguments are SQL expressions."""
    ident = f"sha256(concat_ws('|', job_id, coalesce({path}, ''), coalesce(CAST({line} AS VARCHAR), ''), {rule}))"
    ev = f", {evidence} AS evidence" if evidence else ""
    return (
        f"SELECT {ident} AS finding_id, job_id, CAST({path} AS VARCHAR) AS path, CAST({line} AS INT) AS line_number, {kind} AS finding_type, "
        f"{severity} AS severity, {title} AS title, CAST({confidence} AS DOUBLE) AS confidence{ev} FROM ({source}) WHERE {where}"
    )


def sql_rules(source, rules, language=None, evidence=None):
    """UNION ALL of one SELECT per rule over exploded lines."""
    parts = []
    for r in rules:
        where = f"regexp_matches(line, {B.sql_str(r.pattern)})"
        if language and "*" not in r.languages:
            where += f" AND language IN {B.sql_in(r.languages)}"
        parts.append(sql_finding("SELECT * FROM lines", B.sql_str(r.name), B.sql_str(r.finding_type), B.sql_str(r.severity),
                                 B.sql_str(r.title), r.confidence, evidence, where, "line_number"))
    keep = "job_id, path" + (", language" if language else "")
    return f"WITH lines AS MATERIALIZED ({B.sql_explode(source, keep)}) " + " UNION ALL ".join(parts)


q = B.sql_str
PAGE = B.SQL_PAGE_FILES
CODE = B.SQL_CODE_FILES
DOC = B.SQL_DOC_FILES
# Words of the invented page hosts, so that the path scan has matches to report.
PATH_WORDS = R.SUSPICIOUS_PATH_FRAGMENTS + ["ion", "www", "page="]


@query("c1_scan_paths", " UNION ALL ".join(
    sql_finding(PAGE, q("path:" + w), "'suspicious_code'", "'medium'", "'Suspicious file path detected'", 0.7, q(w),
                f"contains(lower(path), {q(w)})") for w in PATH_WORDS))
def c1(t):
    return flat(S.scan_paths(B.page_files(t), PATH_WORDS), "pattern")


@query("c2_scan_hidden", sql_finding(
    DOC, "'hidden'", "'suspicious_code'", "'low'", "'Hidden directory detected'", 0.5, None,
    "contains(path, '/.') AND NOT contains(path, '/.git/') AND NOT contains(path, '/.github/')"))
def c2(t):
    return flat(S.scan_hidden(B.doc_files(t)))


SECRETS = R.SECRET_RULES + [R.TOKEN_ASSIGNMENT]
SQL_REDACT = r"""regexp_replace(regexp_replace(line, '([''"])[^''"]*([''"])', '\1***REDACTED***\2', 'g'), '(\w+\s*[=:]\s*)[\w\d]+', '\1***REDACTED***', 'g')"""


def _cols(df):
    return df.select("job_id", "path", "content")


@query("c3_scan_secrets", sql_rules(
    f"SELECT job_id, path, content FROM ({DOC}) UNION ALL SELECT job_id, path, content FROM ({CODE})", SECRETS, None, SQL_REDACT))
def c3(t):
    return flat(S.scan_secrets(_cols(B.doc_files(t)).unionByName(_cols(B.code_files(t))), SECRETS), "line_content")


@query("c4_severity_of", """
SELECT event_id, CASE WHEN value / 100 >= 0.9 THEN 'critical' WHEN value / 100 >= 0.7 THEN 'high' WHEN value / 100 >= 0.5 THEN 'medium' ELSE 'low' END AS severity FROM events""")
def c4(t):
    return t.events.select("event_id", S.severity_of(F.col("value") / 100).alias("severity"))


@query("c5_scan_vulnerabilities", sql_rules(
    f"SELECT job_id, path, language, content FROM ({PAGE}) UNION ALL SELECT job_id, path, language, content FROM ({CODE})",
    R.VULNERABILITY_RULES, True, B.sql_trim("line")))
def c5(t):
    cols = ["job_id", "path", "language", "content"]
    return flat(S.scan_vulnerabilities(B.page_files(t).select(*cols).unionByName(B.code_files(t).select(*cols))), "line_content")


@query("c6_scan_entropy", f"""
SELECT sha256(concat_ws('|', job_id, path, '', 'entropy')) AS finding_id, job_id, path, CAST(NULL AS INT) AS line_number, 'malware' AS finding_type,
  'medium' AS severity, 'High entropy file detected' AS title, CAST(0.4 AS DOUBLE) AS confidence FROM (
  SELECT job_id, path, -sum(p * log2(p)) AS entropy FROM (
    SELECT job_id, path, count(*) / sum(count(*)) OVER (PARTITION BY path) AS p FROM (
      SELECT job_id, path, unnest(regexp_extract_all(hex(encode(content)), '..')) AS b FROM ({DOC})) GROUP BY job_id, path, b) GROUP BY job_id, path)
WHERE entropy > 4.3""")
def c6(t):
    return flat(S.scan_entropy(B.doc_files(t), 4.3))


SIGS = R.SIGNATURES + [("Template marker", "token ="), ("Transmute", "transmute")]


@query("c7_scan_signatures", " UNION ALL ".join(
    sql_finding(f"SELECT job_id, path, content FROM ({DOC}) UNION ALL SELECT job_id, path, content FROM ({CODE})",
                q(n), "'malware'", "'high'", q(n), 0.7, None, f"contains(content, {q(s)})") for n, s in SIGS))
def c7(t):
    return flat(S.scan_signatures(_cols(B.doc_files(t)).unionByName(_cols(B.code_files(t))), SIGS))


SQL_OBF = f"""
SELECT doc_id, round(avg_line_length, 6) AS avg_line_length, round(long_line_ratio, 6) AS long_line_ratio, round(density, 6) AS density,
  avg_line_length > 100 OR long_line_ratio > 0.1 OR density > 0.84 AS is_obfuscated FROM (
  SELECT doc_id, list_sum([octet_length(encode(x)) for x in ls]) / len(ls) AS avg_line_length,
    len([x for x in ls if octet_length(encode(x)) > 200]) / len(ls) AS long_line_ratio,
    length(regexp_replace(content, '\\s', '', 'g')) / octet_length(encode(content)) AS density
  FROM (SELECT *, {B.sql_lines('content')} AS ls FROM ({DOC})))"""


@query("c8_is_obfuscated", SQL_OBF)
def c8(t):
    return S.is_obfuscated(B.doc_files(t), 0.84).select(
        "doc_id", F.round("avg_line_length", 6).alias("avg_line_length"),
        F.round("long_line_ratio", 6).alias("long_line_ratio"), F.round("density", 6).alias("density"), "is_obfuscated")


@query("c9_is_obfuscated_ml", f"""
SELECT doc_id, octet_length(encode(content)) / len(ls) > 100 OR len([x for x in ls if octet_length(encode(x)) > 200]) > len(ls) // 4 AS is_obfuscated
FROM (SELECT *, {B.sql_lines('content')} AS ls FROM ({DOC}))""")
def c9(t):
    return S.is_obfuscated_ml(B.doc_files(t)).select("doc_id", "is_obfuscated")


@query("c10_scan_backdoors", sql_rules(
    f"SELECT job_id, path, content FROM ({PAGE}) UNION ALL SELECT job_id, path, content FROM ({CODE})", R.BACKDOOR_RULES, None, B.sql_trim("line")))
def c10(t):
    return flat(S.scan_backdoors(_cols(B.page_files(t)).unionByName(_cols(B.code_files(t)))), "line_content")


EXEC = sql_finding(
    f"SELECT job_id, CAST(NULL AS VARCHAR) AS path, count(*) FILTER (file_type = 'executable') / count(*) AS ratio FROM ({TYPED}) GROUP BY job_id",
    "'exec_ratio'", "'anomaly'", "'medium'", "'Unusually high number of executable files'", 0.6, None, "ratio > LIMIT")
CONFIG = sql_finding(
    TYPED, "'config_credentials'", "'secret_exposure'", "'high'", "'Hardcoded credentials in configuration'", 0.8, None,
    "file_type = 'config' AND (" + " OR ".join(f"regexp_matches(content, {q(p)})" for p in R.CREDENTIAL_PATTERNS) + ")")
EXPOSED = sql_finding(
    f"SELECT * FROM ({TYPED})", "'exposed'", "'data_leak'", "'high'", "'Potentially sensitive file exposed'", 0.8, None,
    f"name IN {B.sql_in(R.EXPOSED_FILE_NAMES)}")


@query("c11_exec_ratio", EXEC.replace("LIMIT", "0.04"))
def c11(t):
    return flat(S.exec_ratio(_typed(t), 0.04))


@query("c12_scan_configs", CONFIG)
def c12(t):
    return flat(S.scan_configs(_typed(t)))


@query("c13_exposed_files", EXPOSED)
def c13(t):
    return flat(S.exposed_files(_typed(t)))


@query("c14_redact", f"""
SELECT path, line_number, {SQL_REDACT} AS redacted FROM ({B.sql_explode(CODE, 'path')})
UNION ALL SELECT path, line_number, {SQL_REDACT} FROM ({B.sql_explode(DOC, 'path')})""")
def c14(t):
    from tracewright.functions.lines import explode_lines
    files = B.code_files(t).select("path", "content").unionByName(B.doc_files(t).select("path", "content"))
    return explode_lines(files).select("path", F.col("line_number").cast("int"), S.redact(F.col("line")).alias("redacted"))


@query("c15_scan_repository", " UNION ALL ".join([EXEC.replace("LIMIT", "0.3"), CONFIG, EXPOSED]))
def c15(t):
    return flat(S.scan_repository(_typed(t)))


ALL_FILES = f"SELECT job_id, path, CAST(NULL AS VARCHAR) AS language, file_type, content FROM ({TYPED}) UNION ALL SELECT job_id, path, language, file_type, content FROM ({CODE})"
NAME = "string_split(path, '/')[-1]"
SQL_DENSE = f"""
SELECT * FROM (SELECT *, {B.sql_lines('content')} AS ls FROM f)
WHERE list_sum([octet_length(encode(x)) for x in ls]) / len(ls) > 100 OR len([x for x in ls if octet_length(encode(x)) > 200]) / len(ls) > 0.1
  OR length(regexp_replace(content, '\\s', '', 'g')) / octet_length(encode(content)) > 0.8"""


@query("c15_scan_all", f"WITH f AS MATERIALIZED ({ALL_FILES}), lines AS MATERIALIZED ({B.sql_explode('SELECT * FROM f', 'job_id, path, language')}) " + " UNION ALL ".join([
    *(sql_finding("SELECT * FROM f", q("path:" + w), "'suspicious_code'", "'medium'", "'Suspicious file path detected'", 0.7, None, f"contains(lower(path), {q(w)})")
      for w in R.SUSPICIOUS_PATH_FRAGMENTS),
    sql_finding("SELECT * FROM f", "'hidden'", "'suspicious_code'", "'low'", "'Hidden directory detected'", 0.5, None,
                "contains(path, '/.') AND NOT contains(path, '/.git/') AND NOT contains(path, '/.github/')"),
    sql_finding("SELECT * FROM f", "'exposed'", "'data_leak'", "'high'", "'Potentially sensitive file exposed'", 0.8, None, f"{NAME} IN {B.sql_in(R.EXPOSED_FILE_NAMES)}"),
    sql_finding("SELECT * FROM f", "'config_credentials'", "'secret_exposure'", "'high'", "'Hardcoded credentials in configuration'", 0.8, None,
                "file_type = 'config' AND (" + " OR ".join(f"regexp_matches(content, {q(p)})" for p in R.CREDENTIAL_PATTERNS) + ")"),
    sql_finding(SQL_DENSE, "'obfuscated'", "'suspicious_code'", "'medium'", "'Potentially obfuscated code detected'", 0.6),
    *(sql_finding("SELECT * FROM lines", q(r.name), q(r.finding_type), q(r.severity), q(r.title), r.confidence, None,
                  f"regexp_matches(line, {q(r.pattern)})" + ("" if "*" in r.languages else f" AND language IN {B.sql_in(r.languages)}"), "line_number")
      for r, _ in S.LINE_RULES)]))
def c15all(t):
    """Every finding of all files from one scan of their texts."""
    docs = _typed(t).select("job_id", "path", F.lit(None).cast("string").alias("language"), "file_type", "content")
    return flat(S.scan_all(docs.unionByName(B.code_files(t).select(*docs.columns))))


def flagship_findings(t) -> DataFrame:
    """Credential findings (any line of any document) and personal-data findings, per source."""
    files = B.doc_files(t)
    secrets = S.scan_secrets(files, SECRETS)
    pii = S.as_findings(
        O.contains_pii(files).where("contains_pii"), rule=F.lit("pii"), finding_type="data_leak", severity="medium",
        title="Personal data", confidence=0.8, evidence={"path": F.col("path")}, path=F.col("path"))
    return secrets.unionByName(pii).unionByName(S.exposed_files(files))


SQL_FLAGSHIP = f"""
SELECT job_id, path, 'secret_exposure' AS finding_type, CASE WHEN confidence >= 0.9 THEN 'critical' ELSE 'high' END AS severity, title, confidence FROM ({sql_rules(DOC, SECRETS)})
UNION ALL SELECT job_id, path, 'data_leak', 'medium', 'Personal data', CAST(0.8 AS DOUBLE) FROM ({DOC}) WHERE regexp_matches(content, '{R.SSN}') OR regexp_matches(content, '{R.CARD}')
UNION ALL SELECT job_id, path, 'data_leak', 'high', 'Potentially sensitive file exposed', CAST(0.8 AS DOUBLE) FROM ({DOC}) WHERE string_split(path, '/')[-1] IN {B.sql_in(R.EXPOSED_FILE_NAMES)}"""

SQL_WEIGHT = "CASE severity WHEN 'critical' THEN 10 WHEN 'high' THEN 7 WHEN 'medium' THEN 4 WHEN 'low' THEN 2 ELSE 1 END"


@query("risk_by_source", f"""
SELECT source AS job_id, coalesce(n, 0) AS total_findings, round(coalesce(score, 0), 9) AS risk_score, coalesce(cls, 'internal') AS classification
FROM (SELECT DISTINCT source FROM documents) LEFT JOIN (
  SELECT job_id, count(*) AS n, least(10, avg({SQL_WEIGHT} * confidence)) AS score,
    CASE WHEN bool_or(severity = 'critical') THEN 'restricted' WHEN bool_or(severity = 'high') THEN 'confidential' ELSE 'internal' END AS cls
  FROM ({SQL_FLAGSHIP}) GROUP BY job_id) ON job_id = source""")
def risk_by_source(t):
    """Flagship: risk score and classification per source."""
    jobs = t.documents.select(F.col("source").alias("job_id")).distinct()
    return G.job_risk(jobs, flagship_findings(t)).select(
        "job_id", "total_findings", F.round("risk_score", 9).alias("risk_score"), "classification")
