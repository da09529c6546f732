"""Registered queries: code analysis."""

from pyspark.sql import functions as F

from tracewright import rules as R
from tracewright.operators import code as C
from tracewright.plans import bindings as B
from tracewright.plans.registry import query
from tracewright.plans.scan import flat, q, sql_finding, sql_rules

CODE = B.SQL_CODE_FILES
DOC = B.SQL_DOC_FILES


@query("d1_language_rules", sql_rules(CODE, R.LANGUAGE_RULES, True, B.sql_trim("line")))
def d1(t):
    return flat(C.scan_language_rules(B.code_files(t)), "line_content")


@query("d2_practices", " UNION ALL ".join(
    sql_finding(CODE, q(p.name), "'compliance_violation'", "'low'", q("Best practice violation: " + p.name), 0.7, "language",
                f"language IN {B.sql_in(p.languages)} AND NOT regexp_matches(content, {q(p.pattern)})") for p in R.PRACTICES))
def d2(t):
    return flat(C.check_practices(B.code_files(t)), "language")


TL = B.sql_trim("line")


@query("d3_syntax_issues", f"""
SELECT path, line_number, issue FROM (
  SELECT path, line_number, CASE
    WHEN language = 'python' AND ends_with(t, chr(92)) AND trim(rtrim(line, chr(92)), {B.SQL_WS}) <> '' THEN 'line_continuation'
    WHEN language = 'javascript' AND t <> '' AND NOT regexp_matches(t, '[;{{}}]$') AND NOT starts_with(t, '//') THEN 'missing_semicolon' END AS issue
  FROM (SELECT *, {TL} AS t FROM ({B.sql_explode(CODE, 'path, language')}))) WHERE issue IS NOT NULL""")
def d3(t):
    return C.syntax_issues(B.code_files(t)).select("path", "line_number", F.col("evidence")["issue_type"].alias("issue"))


SQL_DEPS = f"""
SELECT job_id, path, line_number, trim({B.sql_trim("string_split(line, '=')[1]")}, '"') AS name, trim({B.sql_trim("string_split(line, '=')[2]")}, '"') AS version
FROM ({B.sql_explode(CODE, 'job_id, path')}) WHERE contains(line, ' = ') AND NOT starts_with({TL}, '#') AND len(string_split(line, '=')) = 2"""


@query("d4_dependencies", SQL_DEPS)
def d4(t):
    return C.extract_dependencies(B.code_files(t))


def _advisories(t):
    """Advisory table derived from part: library number and an id."""
    return t.part.where("p_size <= 10").select(
        F.concat(F.lit("lib_"), (F.col("p_partkey") % 50).cast("string")).alias("name"),
        F.concat(F.lit("CVE-2024-"), F.lpad(F.col("p_partkey").cast("string"), 6, "0")).alias("cve_id"))


SQL_ADV = "SELECT 'lib_' || (p_partkey % 50) AS name, 'CVE-2024-' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') AS cve_id FROM part WHERE p_size <= 10"


@query("d5_vulnerable_deps", f"""
SELECT path, line_number, d.name AS dependency, a.cve_id, cves, 'high' AS severity, CAST(0.9 AS DOUBLE) AS confidence
FROM ({SQL_DEPS}) d JOIN (SELECT name, min(cve_id) AS cve_id, string_agg(DISTINCT cve_id, ',' ORDER BY cve_id) AS cves FROM ({SQL_ADV}) GROUP BY name) a ON a.name = d.name""")
def d5(t):
    return C.vulnerable_deps(C.extract_dependencies(B.code_files(t)), _advisories(t)).select(
        "path", "line_number", F.col("evidence")["dependency_name"].alias("dependency"), "cve_id",
        F.col("evidence")["vulnerabilities"].alias("cves"), "severity", "confidence")


@query("d6_outdated_deps", f"""
SELECT path, line_number, d.name AS dependency, version, latest_version FROM ({SQL_DEPS}) d
JOIN (SELECT 'lib_' || n_nationkey AS name, '1.' || n_regionkey AS latest_version FROM nation) l ON l.name = d.name WHERE version <> latest_version""")
def d6(t):
    latest = t.nation.select(
        F.concat(F.lit("lib_"), F.col("n_nationkey").cast("string")).alias("name"),
        F.concat(F.lit("1."), F.col("n_regionkey").cast("string")).alias("latest_version"))
    ev = F.col("evidence")
    return C.outdated_deps(C.extract_dependencies(B.code_files(t)), latest).select(
        "path", "line_number", ev["dependency_name"].alias("dependency"), ev["version"].alias("version"),
        ev["latest_version"].alias("latest_version"))


BOTH = f"SELECT job_id, path, content FROM ({DOC}) UNION ALL SELECT job_id, path, content FROM ({CODE})"


def _both(t):
    cols = ["job_id", "path", "content"]
    return B.doc_files(t).select(*cols).unionByName(B.code_files(t).select(*cols))


@query("d7_quality_rules", sql_rules(BOTH, R.QUALITY_RULES))
def d7(t):
    return flat(C.quality_rules(_both(t)))


def _count(tok):
    return f"(length(content) - length(replace(content, {q(tok)}, ''))) // {len(tok)}"


COMPLEXITY = "1 + " + " + ".join(_count(tok) for tok in R.DECISION_TOKENS)


@query("d8_complexity", f"SELECT path, {COMPLEXITY} AS complexity, {COMPLEXITY} > 20 AS is_complex FROM ({BOTH})")
def d8(t):
    return C.complexity(_both(t)).select("path", "complexity", (F.col("complexity") > 20).alias("is_complex"))


@query("d8_complexity_findings", sql_finding(
    f"SELECT *, {COMPLEXITY} AS cx FROM ({BOTH})", "'complexity'", "'anomaly'", "'medium'", "'High cyclomatic complexity'", 0.9,
    "CAST(cx AS VARCHAR)", "cx > 5"))
def d8f(t):
    return flat(C.complexity_findings(_both(t), 5), "complexity")


@query("d9_long_functions", """
SELECT 'src/' || o_custkey || '/unit_' || o_orderkey || '.' || (['rs','py','js','ts','go','java','c','cpp','cs'])[CAST(o_custkey % 9 AS INT) + 1] AS path,
  7 AS line_number, 'fn run_' || o_orderkey AS function_name, CAST(CAST(floor(o_totalprice / 6000) AS BIGINT) + 1 AS VARCHAR) AS length
FROM orders WHERE floor(o_totalprice / 6000) >= 50""")
def d9(t):
    ev = F.col("evidence")
    return C.long_functions(B.code_files(t)).select(
        "path", "line_number", ev["function_name"].alias("function_name"), ev["length"].alias("length"))


@query("d10_anti_patterns", sql_rules(
    f"SELECT job_id, path, content FROM ({B.SQL_PAGE_FILES}) UNION ALL SELECT job_id, path, content FROM ({CODE})", R.ANTI_PATTERN_RULES))
def d10(t):
    cols = ["job_id", "path", "content"]
    return flat(C.anti_patterns(B.page_files(t).select(*cols).unionByName(B.code_files(t).select(*cols))))


SQL_DUP_LINES = f"""
SELECT path, line_number, {TL} AS line FROM ({B.sql_explode(BOTH, 'path')})
WHERE octet_length(encode({TL})) > 20 AND NOT starts_with({TL}, '//') AND NOT starts_with({TL}, '#')"""


@query("d11_duplicate_lines", f"""
SELECT line, count(*) AS occurrences, min(struct_pack(path := path, line_number := line_number)).path AS first_path,
  min(struct_pack(path := path, line_number := line_number)).line_number AS first_line
FROM ({SQL_DUP_LINES}) GROUP BY line HAVING count(*) > 2""")
def d11(t):
    return C.duplicate_lines(_both(t))


@query("d11_duplicate_locations", f"""
WITH l AS ({SQL_DUP_LINES}) SELECT l.line, occurrences, path, line_number FROM l
JOIN (SELECT line, count(*) AS occurrences FROM l GROUP BY line HAVING count(*) > 2) k ON k.line = l.line""")
def d11_loc(t):
    return C.duplicate_line_locations(_both(t))
