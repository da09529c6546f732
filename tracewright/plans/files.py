"""Registered queries: inventory, classification and content metrics."""

from pyspark.sql import functions as F

from tracewright import rules as R
from tracewright.operators import files as O
from tracewright.plans import bindings as B
from tracewright.plans.registry import query

INV = B.SQL_INVENTORY
DOC = B.SQL_DOC_FILES


def _typed(t):
    return O.classify_file_type(O.inventory(B.doc_files(t)))


def _sql_types():
    exts = {}
    for kind, values in R.OTHER_TYPE_EXTENSIONS.items():
        exts.update(dict.fromkeys(values, kind))
    exts.update(dict.fromkeys(R.DOCUMENT_EXTENSIONS, "document"))
    exts.update(dict.fromkeys(R.CODE_EXTENSIONS, "code"))
    exts.update(dict.fromkeys(R.CONFIG_EXTENSIONS, "config"))
    kinds = sorted(set(exts.values()))
    whens = " ".join(f"WHEN extension IN {B.sql_in([e for e, v in exts.items() if v == k])} THEN '{k}'" for k in kinds)
    return (
        f"CASE WHEN extension IS NOT NULL THEN CASE {whens} ELSE 'unknown' END "
        f"WHEN name IN {B.sql_in(R.CODE_NAMES)} THEN 'code' WHEN name IN {B.sql_in(R.DOCUMENT_NAMES)} THEN 'document' ELSE 'unknown' END"
    )


TYPED = f"SELECT *, {_sql_types()} AS file_type FROM ({INV})"


@query("b1_drop_skipped", f"SELECT job_id, path FROM ({DOC}) WHERE NOT {B.sql_any_contains('path', R.SKIP_FRAGMENTS)}")
def b1(t):
    return O.drop_skipped(B.doc_files(t)).select("job_id", "path")


SKIPPED = """coalesce(extension IN ('bin', 'obj', 'o', 'a', 'lib', 'png', 'jpg', 'jpeg', 'gif', 'bmp', 'ico', 'svg', 'mp3', 'mp4', 'avi', 'mkv', 'wav', 'flac',
  'zip', 'tar', 'gz', 'bz2', 'xz', '7z', 'rar', 'pdf', 'doc', 'docx', 'xls', 'xlsx', 'ppt', 'pptx'), false)"""


@query("b2_filter_analyzable", f"""
SELECT path, size_bytes, CASE WHEN size_bytes > 1048576 THEN 'too_large' WHEN {SKIPPED} THEN 'binary' END AS skip_reason FROM ({INV})""")
def b2(t):
    return O.filter_analyzable(O.inventory(B.doc_files(t)), max_mb=1).select("path", "size_bytes", "skip_reason")


@query("b3_file_type", f"SELECT path, file_type FROM ({TYPED})")
def b3(t):
    return _typed(t).select("path", "file_type")


@query("b4_binary_flag", f"SELECT path, coalesce(extension IN {B.sql_in(R.BINARY_EXTENSIONS)}, false) AS is_binary FROM ({INV})")
def b4(t):
    return O.flag_binary(O.inventory(B.doc_files(t))).select("path", "is_binary")


@query("b5_executable_flag", f"""
SELECT path, CASE WHEN extension IS NOT NULL THEN extension IN {B.sql_in(R.EXECUTABLE_EXTENSIONS)} ELSE (mode & 73) <> 0 END AS is_executable
FROM ({INV})""")
def b5(t):
    return O.flag_executable(O.inventory(B.doc_files(t))).select("path", "is_executable")


@query("b6_permissions", f"""
SELECT path, CAST(((mode >> 6) & 7) AS VARCHAR) || CAST(((mode >> 3) & 7) AS VARCHAR) || CAST((mode & 7) AS VARCHAR) AS permissions FROM ({DOC})""")
def b6(t):
    return O.permissions(B.doc_files(t)).select("path", "permissions")


@query("b7_hashes", "SELECT doc_id, sha256(text) AS hash_sha256, md5(text) AS hash_md5, sha1(text) AS hash_sha1 FROM documents")
def b7(t):
    return O.add_hashes(B.doc_files(t)).select("doc_id", "hash_sha256", "hash_md5", "hash_sha1")


@query("b7_sha512")
def b7_512(t):
    return O.add_hashes(B.doc_files(t)).select("doc_id", "hash_sha512")


@query("b8_encoding", """
SELECT doc_id, CASE WHEN text = '' THEN 'empty' WHEN starts_with(text, chr(65279)) THEN 'utf-8-bom' ELSE 'utf-8' END AS encoding FROM documents""")
def b8(t):
    return O.detect_encoding(B.doc_files(t)).select("doc_id", "encoding")


def _sql_language():
    langs = sorted(set(R.LANGUAGE_BY_EXTENSION.values()))
    whens = " ".join(f"WHEN extension IN {B.sql_in([e for e, v in R.LANGUAGE_BY_EXTENSION.items() if v == k])} THEN '{k}'" for k in langs)
    pre = " ".join(f"WHEN starts_with(content, {B.sql_str(p)}) THEN '{k}'" for p, k in R.LANGUAGE_BY_PREFIX)
    return f"CASE WHEN extension IS NOT NULL THEN CASE {whens} END ELSE CASE {pre} END END"


LANGUAGE = _sql_language()


@query("b9_language", f"SELECT path, {LANGUAGE} AS language FROM ({INV})")
def b9(t):
    return O.detect_language(O.inventory(B.doc_files(t))).select("path", "language")


@query("b10_content_metrics", f"""
SELECT doc_id, CAST(len(ls) AS BIGINT) AS line_count, length(content) AS char_count,
       CAST(len(list_filter(string_split_regex(content, '\\s+'), lambda x: x <> '')) AS BIGINT) AS word_count,
       CAST(len(list_filter(ls, lambda x: {B.sql_trim('x')} = '')) AS BIGINT) AS blank_lines, size_bytes AS byte_size
FROM (SELECT *, {B.sql_lines('content')} AS ls FROM ({DOC}))""")
def b10(t):
    return O.content_metrics(B.doc_files(t)).select(
        "doc_id", "line_count", "char_count", "word_count", "blank_lines", "byte_size")


def _sql_starts(prefixes):
    return "(" + " OR ".join(f"starts_with({B.sql_trim('line')}, {B.sql_str(p)})" for p in prefixes) + ")"


@query("b11_comment_lines", f"""
SELECT path, CAST(count(*) FILTER (WHERE CASE file_type WHEN 'code' THEN {_sql_starts(R.COMMENT_PREFIXES['code'])}
  WHEN 'config' THEN {_sql_starts(R.COMMENT_PREFIXES['config'])} ELSE {_sql_starts(['#'])} END) AS BIGINT) AS comment_lines
FROM ({B.sql_explode("SELECT path, file_type, content FROM (" + TYPED + ") UNION ALL SELECT path, file_type, content FROM (" + B.SQL_CODE_FILES + ")", "path, file_type")})
GROUP BY path""")
def b11(t):
    both = _typed(t).select("path", "file_type", "content").unionByName(
        B.code_files(t).select("path", "file_type", "content"))
    return O.comment_lines(both).select("path", "comment_lines")


@query("b12_content_flags", f"""
SELECT doc_id, {B.sql_any_contains('content', R.URL_MARKERS)} AS contains_urls,
       length(content) - length(replace(content, '@', '')) BETWEEN 1 AND 49 AS contains_emails,
       regexp_matches(content, '{R.IPV4}') AS contains_ip_addresses,
       {B.sql_any_contains('lower(content)', R.SECRET_WORDS)} AS contains_secrets
FROM ({DOC})""")
def b12(t):
    return O.content_flags(B.doc_files(t)).select(
        "doc_id", "contains_urls", "contains_emails", "contains_ip_addresses", "contains_secrets")


SQL_ENTROPY = f"""
SELECT doc_id, round(-sum(p * log2(p)), 6) AS entropy FROM (
  SELECT doc_id, count(*) / sum(count(*)) OVER (PARTITION BY doc_id) AS p FROM (
    SELECT doc_id, unnest(regexp_extract_all(hex(encode(content)), '..')) AS b FROM ({DOC})) GROUP BY doc_id, b) GROUP BY doc_id"""


@query("b13_byte_entropy", SQL_ENTROPY)
def b13(t):
    return O.byte_entropy(B.doc_files(t)).select("doc_id", F.round("entropy", 6).alias("entropy"))


SENSITIVITY = f"""CASE WHEN {B.sql_any_contains('lower(content)', R.SECRET_WORDS)} THEN 'confidential'
  WHEN {B.sql_any_contains('lower(content)', R.RESTRICTED_WORDS)} THEN 'restricted'
  WHEN regexp_matches(content, '{R.SSN}') OR regexp_matches(content, '{R.CARD}') THEN 'confidential' ELSE 'internal' END"""


@query("b14_sensitivity", f"SELECT doc_id, {SENSITIVITY} AS classification FROM ({DOC})")
def b14(t):
    return O.classify_sensitivity(B.doc_files(t)).select("doc_id", "classification")


@query("b15_contains_pii", f"SELECT doc_id, regexp_matches(text, '{R.SSN}') OR regexp_matches(text, '{R.CARD}') AS contains_pii FROM documents")
def b15(t):
    return O.contains_pii(B.doc_files(t)).select("doc_id", "contains_pii")


@query("b16_count_pii", f"""
SELECT doc_id, ssn_count, card_count, ssn_count + card_count AS pii_instances FROM (
  SELECT doc_id, CAST(len(regexp_extract_all(text, '{R.SSN}')) AS BIGINT) AS ssn_count,
         CAST(len(regexp_extract_all(text, '{R.CARD}')) AS BIGINT) AS card_count FROM documents)""")
def b16(t):
    return O.count_pii(B.doc_files(t)).select("doc_id", "ssn_count", "card_count", "pii_instances")


BOTH_FILES = f"SELECT job_id, path, file_type, content FROM ({TYPED}) UNION ALL SELECT job_id, path, file_type, content FROM ({B.SQL_CODE_FILES})"


@query("b17_content_findings", f"""
WITH f AS ({BOTH_FILES})
SELECT job_id, path, 'potential_secret' AS finding_type, 'medium' AS severity, CAST(NULL AS INT) AS line_number, CAST(NULL AS VARCHAR) AS context
FROM f WHERE {B.sql_any_contains('lower(content)', R.SECRET_WORDS)}
UNION ALL SELECT job_id, path, 'suspicious_content', 'high', NULL, NULL FROM f WHERE {B.sql_any_contains('lower(content)', R.SUSPICIOUS_WORDS)}
UNION ALL SELECT job_id, path, 'code_comment', 'low', line_number, {B.sql_trim('line')} FROM ({B.sql_explode("SELECT * FROM f WHERE file_type = 'code'", "job_id, path")})
  WHERE {B.sql_any_contains('lower(line)', R.TASK_WORDS)}""")
def b17(t):
    cols = ["job_id", "path", "file_type", "content"]
    return O.content_findings(_typed(t).select(*cols).unionByName(B.code_files(t).select(*cols)))


@query("b_file_analysis", f"""
SELECT path, file_type, {LANGUAGE} AS language, CASE WHEN {SKIPPED} THEN 'binary' END AS skip_reason, CASE WHEN NOT {SKIPPED} THEN sha256(content) END AS hash_sha256,
  CASE WHEN NOT {SKIPPED} THEN {SENSITIVITY} END AS classification, CASE WHEN NOT {SKIPPED} THEN CAST(len({B.sql_lines('content')}) AS BIGINT) END AS line_count
FROM ({TYPED}) WHERE NOT {B.sql_any_contains('path', R.SKIP_FRAGMENTS)}""")
def b_all(t):
    return O.analyze_files(B.doc_files(t)).select(
        "path", "file_type", "language", "skip_reason", "hash_sha256", "classification", F.col("metrics.line_count").alias("line_count"))
