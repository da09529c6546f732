"""Text features, chunks and content anomalies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright import rules as R
from tracewright.functions.lines import WHITESPACE, any_contains, line_count, occurrences, split_lines, trimmed
from tracewright.functions.skew import join_counted
from tracewright.operators.scan import is_obfuscated_ml

SNIPPET_CHARS = 200
CHUNK_LINES = 50
# Which chunker a language uses; every other language is cut into line blocks.
BRACE_LANGUAGES = ["rust", "go", "java", "cpp", "c", "javascript", "typescript"]
INDENT_LANGUAGES = ["python"]


def embed_text(files: DataFrame, dim: int = 384, min_bytes: int = 0) -> DataFrame:
    """Hashed term-frequency vector of unit length for each file of at least ``min_bytes`` (all by default).

    Tokenizing, hashing and normalising are row-local JVM transforms that need no fitting.
    """
    text = F.col("content")
    rows = files.where(F.octet_length("content") >= min_bytes)
    words = RegexTokenizer(inputCol="content", outputCol="_words", pattern=r"[^\p{L}\p{N}_]+").transform(rows)
    tf = HashingTF(inputCol="_words", outputCol="_tf", numFeatures=dim).transform(words)
    unit = Normalizer(inputCol="_tf", outputCol="_unit", p=2.0).transform(tf)
    snippet = F.when(F.length(text) <= SNIPPET_CHARS, text).otherwise(
        F.concat(F.substring(text, 1, SNIPPET_CHARS), F.lit("...")))
    return (
        unit.withColumn("embedding", vector_to_array("_unit", "float32"))
        .withColumn("content_snippet", snippet).withColumn("line_count", line_count(text).cast("long"))
        .withColumn("char_count", F.char_length(text).cast("long")).drop("_words", "_tf", "_unit")
    )


_SPANS = "struct<start:int,depth:int,spans:array<struct<first:int,last:int>>>"


def _occurs(line: Column, token: str) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(token), F.lit("")))


def _fold_spans(marks: Column, end_at: Column) -> Column:
    """Spans of lines, 0-based, from marks(opens, level, step(acc, mark) ...) folded in line order.

    A new opening line ends the open span on the line before it, so no text between two definitions is lost.
    """
    def ended(acc: Column, last: Column) -> Column:
        return F.concat(acc["spans"], F.array(F.struct(acc["start"].alias("first"), last.cast("int").alias("last"))))

    def state(start: Column, depth: Column, spans: Column) -> Column:
        return F.struct(start.cast("int").alias("start"), depth.cast("int").alias("depth"), spans.alias("spans")).cast(_SPANS)

    def step(acc: Column, m: Column) -> Column:
        is_open = acc["start"] >= 0
        before = F.when(is_open, ended(acc, m["at"] - 1)).otherwise(acc["spans"])
        depth = F.when(m["relative"], acc["depth"] + m["level"]).otherwise(acc["depth"])
        closes = F.when(m["relative"], depth <= 0).otherwise(m["ends"] & (m["level"] <= acc["depth"]))
        last = F.when(m["relative"], m["at"]).otherwise(m["at"] - 1)
        return (
            F.when(m["opens"], state(m["at"], m["level"], before))
            .when(is_open & closes, state(F.lit(-1), F.lit(0), ended(acc, last)))
            .when(is_open, state(acc["start"], depth, acc["spans"])).otherwise(acc))

    empty = state(F.lit(-1), F.lit(0), F.array().cast("array<struct<first:int,last:int>>"))
    return F.aggregate(marks, empty, step, lambda acc: F.when(acc["start"] >= 0, ended(acc, end_at)).otherwise(acc["spans"]))


def _cut_spans(lines: Column, marks: Column) -> Column:
    spans = _fold_spans(marks, F.size(lines) - 1)
    return F.transform(spans, lambda s: F.struct(
        (s["first"] + 1).alias("start_line"), (s["last"] + 1).alias("end_line"),
        F.array_join(F.slice(lines, s["first"] + 1, s["last"] - s["first"] + 1), "\n").alias("content")))


def brace_chunks(content: Column) -> Column:
    """Chunks from a function header holding ``{`` to the line that balances its braces, or to the next header."""
    lines = split_lines(content)
    starters = ["fn ", "func ", "function ", "def "]
    return _cut_spans(lines, F.transform(lines, lambda line, i: F.struct(
        i.alias("at"), (line.contains("{") & any_contains(trimmed(line), starters)).alias("opens"),
        (_occurs(line, "{") - _occurs(line, "}")).alias("level"), F.lit(True).alias("relative"), F.lit(False).alias("ends"))))


def indent_chunks(content: Column) -> Column:
    """Chunks from a def or class line to the last line indented below it, or to the next such line."""
    lines = split_lines(content)

    def mark(line: Column, i: Column) -> Column:
        body = trimmed(line)
        indent = F.length(line) - F.length(F.ltrim(line, F.lit(WHITESPACE)))
        opens = (body.startswith("def ") | body.startswith("class ")) & body.endswith(":")
        return F.struct(i.alias("at"), opens.alias("opens"), indent.alias("level"), F.lit(False).alias("relative"),
                        ((body != "") & ~body.startswith("#")).alias("ends"))

    return _cut_spans(lines, F.transform(lines, mark))


def block_chunks(content: Column, size: int = CHUNK_LINES) -> Column:
    """Consecutive blocks of ``size`` lines, all inside the row: no shuffle."""
    lines = split_lines(content)
    n = F.size(lines)
    starts = F.when(n == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), n - 1, F.lit(size)))
    return F.transform(starts, lambda s: F.struct(
        (s + 1).cast("int").alias("start_line"), F.least(s + size, n).cast("int").alias("end_line"),
        F.array_join(F.slice(lines, s + 1, size), "\n").alias("content")))


def chunk_code(files: DataFrame) -> DataFrame:
    """One row per chunk; the chunker follows the language, in one pass over the files."""
    keep = [c for c in files.columns if c != "content"]
    lang, content = F.coalesce("language", F.lit("")), F.col("content")
    chunks = (
        F.when(lang.isin(BRACE_LANGUAGES), brace_chunks(content)).when(lang.isin(INDENT_LANGUAGES), indent_chunks(content))
        .otherwise(block_chunks(content)))
    return files.select(*keep, F.explode(chunks).alias("c")).select(*keep, "c.start_line", "c.end_line", "c.content")


def size_outliers(files: DataFrame, sigma: float = 3.0, size: str = "size_bytes") -> DataFrame:
    """Files larger than mean + sigma population deviations of their job."""
    stats = files.groupBy("job_id").agg(
        F.avg(size).alias("mean_size"), F.stddev_pop(size).alias("std_dev"), F.count("*").alias("_n"))
    rows = join_counted(files, stats, "job_id", "_n", salt=["path"]).drop("_n")
    return rows.withColumn("threshold", F.col("mean_size") + sigma * F.col("std_dev")).where(
        F.col(size) > F.col("threshold"))


def global_size_outliers(files: DataFrame, sigma: float = 3.0, size: str = "size_bytes") -> DataFrame:
    """The same over all files: a one-row aggregate as a scalar subquery, no window and no join."""
    limit = files.agg(F.avg(size) + sigma * F.stddev_pop(size)).scalar()
    return files.where(F.col(size) > limit)


def char_anomalies(files: DataFrame, non_ascii: float = 0.1, control: float = 0.05) -> DataFrame:
    text = F.col("content")
    size = F.octet_length("content")
    return (
        files.withColumn("non_ascii_ratio", F.when(size > 0, F.regexp_count(text, F.lit(r"[^\x00-\x7F]")) / size))
        .withColumn("control_ratio", F.when(size > 0, F.regexp_count(text, F.lit(r"\p{Cc}")) / size))
        .withColumn("is_anomalous", F.coalesce(
            (F.col("non_ascii_ratio") > non_ascii) | (F.col("control_ratio") > control), F.lit(False)))
    )


def language_anomalies(files: DataFrame) -> DataFrame:
    text = F.col("content")
    python = any_contains(text, ["exec(", "eval("]) | (occurrences(text, ";") > line_count(text))
    script = any_contains(text, ["eval(", "Function("]) | (occurrences(text, "[]") > 10)
    return files.withColumn(
        "is_unusual",
        F.when(F.col("language") == "python", python).when(F.col("language") == "javascript", script).otherwise(False))


def concepts(files: DataFrame, words: Sequence[str] = R.CONCEPTS) -> DataFrame:
    low = F.col("_low")
    return files.withColumn("_low", F.lower("content")).withColumn("concepts", F.array_compact(F.array(*[
        F.when(low.contains(w), F.lit(w)) for w in words]))).drop("_low")


def sentiment(files: DataFrame, positive: Sequence[str] = R.POSITIVE_WORDS, negative: Sequence[str] = R.NEGATIVE_WORDS) -> DataFrame:
    """(positive - negative) / (positive + negative) word hits, 0 when there are none."""
    low, pos, neg = F.col("_low"), F.col("_pos"), F.col("_neg")
    return (
        files.withColumn("_low", F.lower("content"))
        .withColumn("_pos", sum((occurrences(low, w) for w in positive), F.lit(0)))
        .withColumn("_neg", sum((occurrences(low, w) for w in negative), F.lit(0)))
        .withColumn("sentiment", F.when(pos + neg == 0, F.lit(0.0)).otherwise((pos - neg) / (pos + neg)))
        .drop("_low", "_pos", "_neg")
    )


def entities(files: DataFrame) -> DataFrame:
    """E-mail addresses, then URLs, each in order of appearance; one row per entity."""
    text = F.col("content")
    found = F.concat(
        F.transform(F.regexp_extract_all(text, F.lit(R.EMAIL), F.lit(0)),
                    lambda x: F.struct(F.lit("email").alias("kind"), x.alias("value"))),
        F.transform(F.regexp_extract_all(text, F.lit(R.URL), F.lit(0)),
                    lambda x: F.struct(F.lit("url").alias("kind"), x.alias("value"))))
    keep = [c for c in files.columns if c != "content"]
    return files.select(*keep, F.posexplode(found).alias("position", "e")).select(
        *keep, "position", F.col("e.kind").alias("kind"), F.col("e.value").alias("entity"))


def content_type(files: DataFrame) -> DataFrame:
    text = F.col("content")
    return files.withColumn(
        "content_type",
        F.when(any_contains(text, ["function", "class", "import"]), "code")
        .when(any_contains(text, ["# ", "## "]), "documentation")
        .when(text.contains("{") & text.contains('"'), "configuration").otherwise("text"))


def sensitivity(files: DataFrame) -> DataFrame:
    return files.withColumn(
        "sensitivity", F.when(any_contains(F.lower("content"), R.SENSITIVE_WORDS), "sensitive").otherwise("public"))


def intent(files: DataFrame) -> DataFrame:
    """Suspicious by word, or a code file that looks obfuscated."""
    bad = any_contains(F.lower("content"), R.MALICIOUS_WORDS)
    return is_obfuscated_ml(files).withColumn(
        "intent",
        F.when(bad | ((F.col("file_type") == "code") & F.col("is_obfuscated")), "suspicious").otherwise("benign")
    ).drop("is_obfuscated")
