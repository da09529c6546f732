"""Registered queries: text features, similarity and search."""

from pyspark.sql import functions as F

from tracewright import rules as R
from tracewright.operators import similarity as S
from tracewright.operators import text as X
from tracewright.plans import bindings as B
from tracewright.plans.files import TYPED, _typed
from tracewright.plans.registry import query

q = B.sql_str
DOC = B.SQL_DOC_FILES
CODE = B.SQL_CODE_FILES


def vectors(t):
    return t.embeddings.select(
        F.col("vec_id").alias("id"), F.concat(F.lit("lang"), F.col("label").cast("string")).alias("language"),
        F.concat(F.lit("job"), F.col("label").cast("string")).alias("job_id"), "embedding")


VEC = "SELECT vec_id AS id, 'lang' || label AS language, 'job' || label AS job_id, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings"
COS = "list_dot_product({a}.embedding, {b}.embedding) / sqrt(list_dot_product({a}.embedding, {a}.embedding)) / sqrt(list_dot_product({b}.embedding, {b}.embedding))"
AB = COS.format(a="a", b="b")


@query("f1_embed_text", f"""
SELECT doc_id, CASE WHEN regexp_matches(content, '[\\p{{L}}\\p{{N}}_]') THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS norm, 384 AS dim,
  CAST(len({B.sql_lines('content')}) AS BIGINT) AS line_count, length(content) AS char_count,
  CAST(CASE WHEN length(content) <= {X.SNIPPET_CHARS} THEN length(content) ELSE {X.SNIPPET_CHARS + 3} END AS INT) AS snippet_chars FROM ({DOC})""")
def f1(t):
    out = X.embed_text(B.doc_files(t))
    return out.select(
        "doc_id", F.round(S.norm(F.col("embedding")), 4).alias("norm"), F.size("embedding").alias("dim"),
        "line_count", "char_count", F.length("content_snippet").alias("snippet_chars"))


@query("f2_block_chunks", f"""
SELECT path, CAST((line_number - 1) // 50 * 50 + 1 AS INT) AS start_line, CAST(max(line_number) AS INT) AS end_line,
  sha256(string_agg(line, chr(10) ORDER BY line_number)) AS content_hash
FROM ({B.sql_explode(DOC, 'path')}) GROUP BY path, (line_number - 1) // 50""")
def f2(t):
    files = B.doc_files(t).select("path", "content", F.lit("text").alias("language"))
    return X.chunk_code(files).select("path", "start_line", "end_line", F.sha2("content", 256).alias("content_hash"))


@query("f2_brace_chunks", f"""
SELECT path, 7 AS start_line, CAST(8 + steps AS INT) AS end_line FROM (
  SELECT path, language, CAST(floor(o_totalprice / 6000) AS INT) AS steps FROM ({CODE}) JOIN orders ON o_orderkey = file_key)
WHERE language IN {B.sql_in(X.BRACE_LANGUAGES)}
UNION ALL SELECT path, CAST((line_number - 1) // 50 * 50 + 1 AS INT), CAST(max(line_number) AS INT)
FROM ({B.sql_explode("SELECT * FROM (" + CODE + ") WHERE language = 'csharp'", 'path')}) GROUP BY path, (line_number - 1) // 50""")
def f2b(t):
    """Python files hold no def or class line here and have no chunk."""
    return X.chunk_code(B.code_files(t)).select("path", "start_line", "end_line")


@query("f2_indent_chunks", """
SELECT o_orderkey AS id, start_line, end_line, n FROM orders, LATERAL (VALUES (1, 1, 1), (2, 2 + CAST(o_custkey % 7 AS INT), 1 + CAST(o_custkey % 7 AS INT)),
  (4 + CAST(o_custkey % 7 AS INT), 5 + CAST(o_custkey % 7 AS INT), 2)) v(start_line, end_line, n)""")
def f2i(t):
    """A class with a method of some lines, a plain line and a function, per order."""
    body = F.repeat(F.lit("        step()\n"), (F.col("o_custkey") % 7).cast("int"))
    files = t.orders.select(F.col("o_orderkey").alias("id"), F.lit("python").alias("language"), F.concat(
        F.lit("class Unit:\n    def run(self):\n"), body, F.lit("value = 1\ndef last():\n    return 0")).alias("content"))
    return X.chunk_code(files).select("id", "start_line", "end_line", F.size(F.split("content", "\n")).alias("n"))


@query("f3_cosine", f"SELECT a.id, round({AB}, 6) AS score FROM ({VEC}) a, (SELECT * FROM ({VEC}) WHERE id = 0) b")
def f3(t):
    v = vectors(t)
    probe = v.where("id = 0").select("embedding").scalar()
    return v.withColumn("probe", probe).select("id", F.round(S.cosine(F.col("embedding"), F.col("probe")), 6).alias("score"))


REPS = f"SELECT embedding, min(id) AS id, count(*) AS copies, min(language) AS language FROM ({VEC}) GROUP BY embedding"


@query("f4_similar_pairs", f"""
WITH r AS MATERIALIZED ({REPS}) SELECT * FROM (
  SELECT a.id AS id_a, b.id AS id_b, round({AB}, 6) AS score, a.copies AS copies_a, b.copies AS copies_b FROM r a JOIN r b ON a.id < b.id) WHERE score > 0.3""")
def f4(t):
    return S.similar_pairs(vectors(t).select("id", "embedding"), 0.3, block_rows=512).withColumn("score", F.round("score", 6))


@query("f4_copies", f"""
SELECT r.id AS representative, v.id FROM ({VEC}) v JOIN ({REPS}) r ON r.embedding = v.embedding WHERE r.copies > 1""")
def f4c(t):
    return S.copies_of(vectors(t))


@query("f5_similar_chunks", f"""
WITH r AS MATERIALIZED (SELECT language, embedding, min(id) AS id, count(*) AS copies FROM ({VEC}) GROUP BY language, embedding)
SELECT * FROM (SELECT a.id AS id_a, b.id AS id_b, a.language, round({AB}, 6) AS score, a.copies AS copies_a, b.copies AS copies_b
  FROM r a JOIN r b ON a.id < b.id AND a.language = b.language) WHERE score > 0.25""")
def f5(t):
    chunks = vectors(t).withColumn("file", F.col("id").cast("string")).withColumn("bytes", F.size("embedding"))
    return S.similar_chunks(chunks, 0.25, block_rows=512).withColumn("score", F.round("score", 6))


def _probe(t, vec_id):
    return t.embeddings.where(F.col("vec_id") == vec_id).select("embedding").scalar()


@query("f6_search_similar", f"""
SELECT a.id, round({AB}, 6) AS score FROM ({VEC}) a, (SELECT * FROM ({VEC}) WHERE id = 3) b
WHERE a.job_id <> 'job7' AND {AB} >= 0.05 ORDER BY {AB} DESC, a.id LIMIT 10""")
def f6(t):
    hits = S.search_similar(vectors(t), _probe(t, 3), 10, 0.05, [F.col("job_id") != "job7"])
    return hits.select("id", F.round("score", 6).alias("score"))


@query("f7_search_code", f"""
SELECT a.id, round({AB}, 6) AS score FROM ({VEC}) a, (SELECT * FROM ({VEC}) WHERE id = 3) b
WHERE a.language = 'lang4' AND a.job_id <> 'job5' ORDER BY {AB} DESC, a.id LIMIT 15""")
def f7(t):
    return S.search_code(vectors(t), _probe(t, 3), "lang4", "job5", 15, -1.0).select("id", F.round("score", 6).alias("score"))


@query("f8_knn_join", f"""
WITH v AS MATERIALIZED ({VEC}) SELECT query_id, id, score, rank FROM (
  SELECT a.id AS query_id, b.id AS id, round({AB}, 6) AS score, row_number() OVER (PARTITION BY a.id ORDER BY {AB} DESC, b.id) AS rank
  FROM v a JOIN v b ON a.id <> b.id) WHERE rank <= 5""")
def f8(t):
    v = vectors(t).select("id", "embedding")
    return S.knn_join(v, v, 5).select("query_id", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query("f9_search_facets", f"""
SELECT 'file_type' AS facet, file_type AS value, count(*) AS hits FROM ({TYPED}) WHERE contains(lower(content), 'tion') GROUP BY file_type
UNION ALL SELECT 'classification', lang, count(*) FROM ({TYPED}) WHERE contains(lower(content), 'tion') GROUP BY lang""")
def f9(t):
    hits = _typed(t).where(F.lower("content").contains("tion")).withColumn("classification", F.col("lang"))
    return S.search_facets(hits)


@query("f10_search_text", f"""
SELECT doc_id AS id, score, regexp_replace(snip, '(?i)(token|schver)', '<mark>\\1</mark>', 'g') AS snippet FROM (
  SELECT doc_id, (length(content) - length(replace(lower(content), 'token', ''))) // 5 + (length(content) - length(replace(lower(content), 'schver', ''))) // 6 AS score,
    regexp_extract(content, '(?i)[^\\n]{{0,40}}(?:token|schver)[^\\n]{{0,40}}') AS snip
  FROM ({DOC}) WHERE lang <> 'fr' AND (contains(lower(content), 'token') OR contains(lower(content), 'schver')))
ORDER BY score DESC, doc_id LIMIT 25""")
def f10(t):
    files = B.doc_files(t).withColumn("id", F.col("doc_id"))
    return S.search_text(files, ["token", "schver"], [F.col("lang") != "fr"], 25).select("id", "score", "snippet")


@query("f11_drop_job", f"SELECT job_id, count(*) AS vectors FROM ({VEC}) WHERE job_id <> 'job3' GROUP BY job_id")
def f11(t):
    return S.collection_stats(S.drop_job(vectors(t), "job3"))


def _docs(t):
    return t.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("content"))


@query("f12_exact_duplicates", "SELECT sha256(text) AS hash_sha256, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY text HAVING count(*) > 1")
def f12(t):
    return S.exact_duplicates(_docs(t))


@query("f12_duplicate_members", """
SELECT sha256(d.text) AS hash_sha256, first_id, doc_id AS id FROM documents d
JOIN (SELECT text, min(doc_id) AS first_id FROM documents GROUP BY text HAVING count(*) > 1) g ON g.text = d.text""")
def f12m(t):
    return S.duplicate_members(_docs(t))


@query("f13_exact_matches", """
WITH corpus AS (SELECT item_id AS id, text FROM benchmark UNION ALL SELECT 100000000 + conv_id * 1000 + turn, text FROM conversations),
mine AS (SELECT text, count(*) AS copies, min(id) AS first_id FROM (SELECT doc_id AS id, text FROM documents UNION ALL SELECT 1000000000 + conv_id, text FROM conversations) GROUP BY text)
SELECT sha256(m.text) AS hash_sha256, copies, first_id, c.id AS corpus_id FROM mine m JOIN corpus c ON c.text = m.text""")
def f13x(t):
    corpus = t.benchmark.select(F.col("item_id").alias("id"), F.col("text").alias("content")).unionByName(
        t.conversations.select((F.lit(100_000_000) + F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("content")))
    mine = _docs(t).unionByName(t.conversations.select(
        (F.lit(1_000_000_000) + F.col("conv_id")).alias("id"), F.col("text").alias("content")))
    return S.exact_matches(mine, corpus)


@query("f13_external_matches", f"""
WITH m AS MATERIALIZED (SELECT embedding, min(id) AS id, count(*) AS copies FROM ({VEC}) WHERE language < 'lang5' GROUP BY embedding),
k AS MATERIALIZED (SELECT embedding, min(id) AS id, max(language) AS risk_level FROM ({VEC}) WHERE language >= 'lang5' GROUP BY embedding)
SELECT a.id AS query_id, b.id AS corpus_id, round({AB}, 6) AS score, copies, risk_level FROM m a, k b WHERE {AB} >= 0.28""")
def f13(t):
    v = vectors(t)
    mine = v.where(F.col("language") < "lang5").select("id", "embedding")
    known = v.where(F.col("language") >= "lang5").select("id", "embedding", F.col("language").alias("risk_level"))
    return S.external_matches(mine, known, 0.28, block_rows=128).withColumn("score", F.round("score", 6))


@query("f13_external_links", f"""
WITH m AS MATERIALIZED (SELECT embedding, min(id) AS id, count(*) AS copies FROM ({VEC}) WHERE language < 'lang5' GROUP BY embedding),
k AS MATERIALIZED (SELECT embedding, min(id) AS id, count(*) AS n, max(language) AS risk_level FROM ({VEC}) WHERE language >= 'lang5' GROUP BY embedding),
h AS (SELECT a.id AS query_id, a.copies, b.id, b.n, risk_level, {AB} AS score FROM m a, k b WHERE {AB} >= 0.35)
SELECT query_id, any_value(copies) AS copies, CAST(sum(n) AS BIGINT) AS matches, arg_min(id, (-round(score, 12), id)) AS best_id,
  round(max(score), 6) AS best_score, max(risk_level) AS risk_level FROM h GROUP BY query_id""")
def f13l(t):
    v = vectors(t)
    mine = v.where(F.col("language") < "lang5").select("id", "embedding")
    known = v.where(F.col("language") >= "lang5").select("id", "embedding", F.col("language").alias("risk_level"))
    return S.external_links(mine, known, 0.35).withColumn("best_score", F.round("best_score", 6))


@query("f14_size_outliers", """
SELECT doc_id, round(m + 2 * s, 4) AS threshold FROM documents JOIN (SELECT source, avg(octet_length(encode(text))) AS m, stddev_pop(octet_length(encode(text))) AS s
  FROM documents GROUP BY source) USING (source) WHERE octet_length(encode(text)) > m + 2 * s""")
def f14(t):
    return X.size_outliers(B.doc_files(t), 2.0).select("doc_id", F.round("threshold", 4).alias("threshold"))


@query("f14_global_outliers", "SELECT doc_id FROM documents WHERE n_chars > (SELECT avg(n_chars) + 3 * stddev_pop(n_chars) FROM documents)")
def f14g(t):
    return X.global_size_outliers(t.documents, 3.0, "n_chars").select("doc_id")


@query("f15_char_anomalies", """
SELECT doc_id, round(a, 6) AS non_ascii_ratio, round(c, 6) AS control_ratio, a > 0.1 OR c > 0.05 AS is_anomalous FROM (
  SELECT doc_id, length(regexp_replace(text, '[\\x00-\\x7F]', '', 'g')) / octet_length(encode(text)) AS a,
    length(regexp_replace(text, '\\P{Cc}', '', 'g')) / octet_length(encode(text)) AS c FROM documents)""")
def f15(t):
    return X.char_anomalies(B.doc_files(t)).select(
        "doc_id", F.round("non_ascii_ratio", 6).alias("non_ascii_ratio"), F.round("control_ratio", 6).alias("control_ratio"), "is_anomalous")


def _n(tok):
    return f"(length(content) - length(replace(content, {q(tok)}, ''))) // {len(tok)}"


@query("f16_language_anomalies", f"""
SELECT path, CASE language WHEN 'python' THEN contains(content, 'exec(') OR contains(content, 'eval(') OR {_n(';')} > len({B.sql_lines('content')})
  WHEN 'javascript' THEN contains(content, 'eval(') OR contains(content, 'Function(') OR {_n('[]')} > 10 ELSE false END AS is_unusual FROM ({CODE})""")
def f16(t):
    return X.language_anomalies(B.code_files(t)).select("path", "is_unusual")


WORDS = R.CONCEPTS + ["tion", "token", "sch"]


@query("f17_concepts", f"""
SELECT doc_id, array_to_string(list_filter({B.sql_list(WORDS)}, lambda w: contains(lower(content), w)), ',') AS concepts FROM ({DOC})""")
def f17(t):
    return X.concepts(B.doc_files(t), WORDS).select("doc_id", F.array_join("concepts", ",").alias("concepts"))


POS, NEG = R.POSITIVE_WORDS + ["the"], R.NEGATIVE_WORDS + ["eau", "sch"]


def _hits(words):
    return " + ".join(f"(length(low) - length(replace(low, {q(w)}, ''))) // {len(w)}" for w in words)


@query("f18_sentiment", f"""
SELECT id, round(CASE WHEN p + n = 0 THEN 0 ELSE (p - n) / (p + n) END, 6) AS sentiment FROM (
  SELECT id, {_hits(POS)} AS p, {_hits(NEG)} AS n FROM (SELECT 'd' || doc_id AS id, lower(text) AS low FROM documents
    UNION ALL SELECT 'c' || conv_id || '.' || turn, lower(text) FROM conversations))""")
def f18(t):
    rows = t.documents.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.col("text").alias("content")).unionByName(
        t.conversations.select(F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("."), F.col("turn").cast("string")).alias("id"),
                               F.col("text").alias("content")))
    return X.sentiment(rows, POS, NEG).select("id", F.round("sentiment", 6).alias("sentiment"))


@query("f19_entities", f"""
SELECT id, kind, CAST(position AS INT) AS position, entity FROM (
  SELECT id, 'email' AS kind, unnest(e) AS entity, generate_subscripts(e, 1) - 1 AS position FROM f
  UNION ALL SELECT id, 'url', unnest(u), len(e) + generate_subscripts(u, 1) - 1 FROM f)""".replace(
    "FROM f", f"""FROM (SELECT id, regexp_extract_all(content, {q(R.EMAIL)}) AS e, regexp_extract_all(content, {q(R.URL)}) AS u FROM (
    SELECT 'd' || doc_id AS id, text AS content FROM documents UNION ALL SELECT 'p' || page_id, html FROM pages))"""))
def f19(t):
    rows = t.documents.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.col("text").alias("content")).unionByName(
        t.pages.select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("id"), F.col("html").alias("content")))
    return X.entities(rows)


ALL = f"SELECT path, content, file_type FROM ({TYPED}) UNION ALL SELECT path, content, file_type FROM ({CODE}) UNION ALL SELECT path, content, 'code' FROM ({B.SQL_PAGE_FILES})"


def _all(t):
    cols = ["path", "content", "file_type"]
    pages = B.page_files(t).withColumn("file_type", F.lit("code"))
    return _typed(t).select(*cols).unionByName(B.code_files(t).select(*cols)).unionByName(pages.select(*cols))


@query("f20_content_type", f"""
SELECT path, CASE WHEN {B.sql_any_contains('content', ['function', 'class', 'import'])} THEN 'code' WHEN contains(content, '# ') THEN 'documentation'
  WHEN contains(content, '{{') AND contains(content, '"') THEN 'configuration' ELSE 'text' END AS content_type FROM ({ALL})""")
def f20(t):
    return X.content_type(_all(t)).select("path", "content_type")


@query("f21_sensitivity", f"SELECT path, CASE WHEN {B.sql_any_contains('lower(content)', R.SENSITIVE_WORDS)} THEN 'sensitive' ELSE 'public' END AS sensitivity FROM ({ALL})")
def f21(t):
    return X.sensitivity(_all(t)).select("path", "sensitivity")


@query("f22_intent", f"""
SELECT path, CASE WHEN {B.sql_any_contains('lower(content)', R.MALICIOUS_WORDS)} OR (file_type = 'code' AND
  (octet_length(encode(content)) / len(ls) > 100 OR len([x for x in ls if octet_length(encode(x)) > 200]) > len(ls) // 4)) THEN 'suspicious' ELSE 'benign' END AS intent
FROM (SELECT *, {B.sql_lines('content')} AS ls FROM ({ALL}))""")
def f22(t):
    return X.intent(_all(t)).select("path", "intent")
