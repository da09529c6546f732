"""File inventory, classification and content metrics."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright import rules as R
from tracewright.functions.lines import (
    WHITESPACE, any_contains, line_count, occurrences, split_lines, trimmed,
)
from tracewright.functions.plan import computed_once
from tracewright.model import lookup


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension_of(path: Column) -> Column:
    """Lower-case extension; a leading dot alone (``.env``) is a name, not an extension."""
    name = file_name(path)
    return F.when(name.rlike(r"(?s)\A.+\.[^.]*\z"), F.lower(F.regexp_extract(name, r"\.([^.]*)\z", 1)))


def inventory(files: DataFrame) -> DataFrame:
    """Add name and extension derived from ``path``."""
    return files.withColumn("name", file_name(F.col("path"))).withColumn("extension", extension_of(F.col("path")))


def drop_skipped(files: DataFrame, fragments: list[str] = R.SKIP_FRAGMENTS) -> DataFrame:
    return files.where(~any_contains(F.col("path"), fragments))


def flag_binary(files: DataFrame) -> DataFrame:
    return files.withColumn("is_binary", F.coalesce(F.col("extension").isin(R.BINARY_EXTENSIONS), F.lit(False)))


def filter_analyzable(files: DataFrame, max_mb: int | None = None) -> DataFrame:
    """Add ``skip_reason``: too_large over a limit the caller names, binary for likely-binary files that are
    not native executables, else null. Every file stays a row."""
    likely = F.coalesce(F.col("extension").isin(R.LIKELY_BINARY_EXTENSIONS), F.lit(False))
    native = F.coalesce(F.col("extension").isin(R.ANALYZABLE_BINARIES), F.lit(False))
    reason = F.when(likely & ~native, "binary")
    if max_mb is not None:
        reason = F.when(F.col("size_bytes") > max_mb * 1024 * 1024, "too_large").otherwise(reason)
    return files.withColumn("skip_reason", reason)


def classify_file_type(files: DataFrame) -> DataFrame:
    by_ext: dict[str, str] = {}
    for kind, exts in R.OTHER_TYPE_EXTENSIONS.items():
        by_ext.update(dict.fromkeys(exts, kind))
    by_ext.update(dict.fromkeys(R.DOCUMENT_EXTENSIONS, "document"))
    by_ext.update(dict.fromkeys(R.CODE_EXTENSIONS, "code"))
    by_ext.update(dict.fromkeys(R.CONFIG_EXTENSIONS, "config"))
    by_name = {**dict.fromkeys(R.CODE_NAMES, "code"), **dict.fromkeys(R.DOCUMENT_NAMES, "document")}
    kind = F.when(F.col("extension").isNotNull(), lookup(by_ext, F.col("extension"))).otherwise(
        lookup(by_name, F.col("name"))
    )
    return files.withColumn("file_type", F.coalesce(kind, F.lit("unknown")))


def flag_executable(files: DataFrame) -> DataFrame:
    by_mode = F.col("mode").bitwiseAND(0o111) != 0
    return files.withColumn(
        "is_executable",
        F.when(F.col("extension").isNotNull(), F.col("extension").isin(R.EXECUTABLE_EXTENSIONS)).otherwise(by_mode),
    )


def permissions(files: DataFrame) -> DataFrame:
    return files.withColumn("permissions", F.lower(F.conv(F.col("mode").bitwiseAND(0o777).cast("string"), 10, 8)))


def add_hashes(files: DataFrame, content: str = "content") -> DataFrame:
    c = F.col(content)
    return (
        files.withColumn("hash_sha256", F.sha2(c, 256)).withColumn("hash_sha512", F.sha2(c, 512))
        .withColumn("hash_md5", F.md5(c)).withColumn("hash_sha1", F.sha1(c))
    )


def detect_encoding(files: DataFrame, content: str = "content") -> DataFrame:
    """Byte-order marks first, then UTF-8 validity. ``content`` may be binary or string."""
    raw = F.col(content).cast("binary")
    head = F.hex(F.substring(raw, 1, 3))
    return files.withColumn(
        "encoding",
        F.when(F.octet_length(raw) == 0, "empty")
        .when(head == "EFBBBF", "utf-8-bom")
        .when(head.startswith("FFFE") | head.startswith("FEFF"), "utf-16")
        .when(F.is_valid_utf8(raw.cast("string")), "utf-8")
        .otherwise("binary"),
    )


def detect_language(files: DataFrame) -> DataFrame:
    by_prefix = F.lit(None).cast("string")
    for prefix, language in reversed(R.LANGUAGE_BY_PREFIX):
        by_prefix = F.when(F.col("content").startswith(prefix), language).otherwise(by_prefix)
    by_ext = lookup(R.LANGUAGE_BY_EXTENSION, F.col("extension"))
    return files.withColumn("language", F.when(F.col("extension").isNotNull(), by_ext).otherwise(by_prefix))


def _comment_count(text: Column, prefixes: list[str]) -> Column:
    """Each comment line matches once: a line start, blanks, then a prefix. No line array is built."""
    starts = "|".join(re.escape(p) for p in prefixes)
    return F.regexp_count(text, F.lit(rf"(?:\A|\n)[{WHITESPACE}]*(?:{starts})"))


def comment_lines(files: DataFrame) -> DataFrame:
    text = F.col("content")
    count = _comment_count(text, R.DEFAULT_COMMENT_PREFIXES)
    for kind, prefixes in R.COMMENT_PREFIXES.items():
        count = F.when(F.col("file_type") == kind, _comment_count(text, prefixes)).otherwise(count)
    return files.withColumn("comment_lines", count.cast("long"))


def content_metrics(files: DataFrame) -> DataFrame:
    """Line, character, word and blank-line counts plus byte size, without exploding lines."""
    text = F.col("content")
    blank = F.size(F.filter(split_lines(text), lambda x: trimmed(x) == "")).cast("long")
    return (
        files.withColumn("line_count", line_count(text).cast("long"))
        .withColumn("char_count", F.char_length(text).cast("long"))
        .withColumn("word_count", F.regexp_count(text, F.lit(r"(?U)[^\s]+")).cast("long"))
        .withColumn("blank_lines", blank)
        .withColumn("byte_size", F.octet_length(text).cast("long"))
    )


def has_secret_words(text: Column) -> Column:
    return any_contains(F.lower(text), R.SECRET_WORDS)


def content_flags(files: DataFrame) -> DataFrame:
    text = F.col("content")
    ats = occurrences(text, "@")
    return (
        files.withColumn("contains_urls", any_contains(text, R.URL_MARKERS))
        .withColumn("contains_emails", (ats > 0) & (ats < 50))
        .withColumn("contains_ip_addresses", text.rlike(R.IPV4))
        .withColumn("contains_secrets", has_secret_words(text))
    )


@F.pandas_udf(T.DoubleType())
def entropy_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Shannon entropy (bits) of the bytes of each value; 0 for empty content."""
    for values in batches:
        out = []
        for v in values:
            raw = v.encode() if isinstance(v, str) else bytes(v or b"")
            n = len(raw)
            if n == 0:
                out.append(0.0)
                continue
            p = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256) / n
            p = p[p > 0]
            out.append(float(-(p * np.log2(p)).sum()))
        yield pd.Series(out, dtype="float64")


def byte_entropy(files: DataFrame, content: str = "content") -> DataFrame:
    """Row-local: no shuffle, one Arrow pass over the content column."""
    return files.withColumn("entropy", entropy_of(F.col(content)))


def has_pii(text: Column) -> Column:
    return text.rlike(R.SSN) | text.rlike(R.CARD)


def contains_pii(files: DataFrame) -> DataFrame:
    return files.withColumn("contains_pii", has_pii(F.col("content")))


def classify_sensitivity(files: DataFrame) -> DataFrame:
    text, low = F.col("content"), F.col("_low")
    return files.withColumn("_low", F.lower(text)).withColumn(
        "classification",
        F.when(any_contains(low, R.SECRET_WORDS), "confidential")
        .when(any_contains(low, R.RESTRICTED_WORDS), "restricted")
        .when(has_pii(text), "confidential")
        .otherwise("internal"),
    ).drop("_low")


def count_pii(files: DataFrame) -> DataFrame:
    """Match instances per document, the report's ``pii_instances``."""
    text = F.col("content")
    return (
        files.withColumn("ssn_count", F.regexp_count(text, F.lit(R.SSN)).cast("long"))
        .withColumn("card_count", F.regexp_count(text, F.lit(R.CARD)).cast("long"))
        .withColumn("pii_instances", F.col("ssn_count") + F.col("card_count"))
    )


def content_findings(files: DataFrame) -> DataFrame:
    """Whole-file keyword findings and task comments of code files: one array per file, from one pass over the texts."""
    kinds = "array<struct<finding_type:string,severity:string,line_number:int,context:string>>"

    def found(kind: str, severity: str, line: Column, context: Column) -> Column:
        return F.struct(F.lit(kind).alias("finding_type"), F.lit(severity).alias("severity"), line.cast("int").alias("line_number"), context.cast("string").alias("context"))

    none = F.lit(None)
    low = computed_once(files, "_low", F.lower(F.col("content")))
    whole = F.array_compact(F.array(
        F.when(any_contains(F.col("_low"), R.SECRET_WORDS), found("potential_secret", "medium", none, none)),
        F.when(any_contains(F.col("_low"), R.SUSPICIOUS_WORDS), found("suspicious_content", "high", none, none)))).cast(kinds)
    tagged = F.transform(split_lines(F.col("content")), lambda x, i: F.struct((i + 1).alias("n"), x.alias("line")))
    tasks = F.transform(F.filter(tagged, lambda x: any_contains(F.lower(x["line"]), R.TASK_WORDS)), lambda x: found("code_comment", "low", x["n"], trimmed(x["line"])))
    has_tasks = (F.col("file_type") == "code") & any_contains(F.col("_low"), R.TASK_WORDS)
    comments = F.when(has_tasks, tasks.cast(kinds)).otherwise(F.array().cast(kinds))
    return low.select("job_id", "path", F.explode(F.concat(whole, comments)).alias("f")).select("job_id", "path", "f.*")


def analyze_files(files: DataFrame, max_mb: int | None = None) -> DataFrame:
    """The file-analysis row: every per-file attribute in one scan, metrics as a struct.

    A file with a ``skip_reason`` keeps its row; whatever is read from its content is null.
    """
    df = detect_language(classify_file_type(inventory(drop_skipped(files))))
    read = F.col("skip_reason").isNull()
    df = filter_analyzable(flag_binary(df), max_mb).withColumn("content", F.when(read, F.col("content")))
    df = comment_lines(content_flags(content_metrics(df)))
    df = classify_sensitivity(add_hashes(detect_encoding(df))).withColumn("classification", F.when(read, F.col("classification")))
    metrics = ["line_count", "char_count", "word_count", "blank_lines", "comment_lines", "byte_size",
               "contains_urls", "contains_emails", "contains_ip_addresses", "contains_secrets"]
    return df.withColumn("metrics", F.struct(*metrics)).drop(*metrics, "hash_md5", "hash_sha1", "hash_sha512")
