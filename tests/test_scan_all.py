"""The whole scan against the single scanners, and the literals that rules need."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tracewright import rules as R
from tracewright.functions.skew import maybe_repeated
from tracewright.operators import code as C
from tracewright.operators import files as O
from tracewright.operators import scan as S
from tracewright.plans import bindings as B
from tracewright.plans.registry import Tables

SF = "/root/testdata/sf0.001"
SAMPLES = [
    "AKIA" + "A1" * 8, "ghp_" + "a" * 36, "github_pat_" + "a" * 22 + "_" + "b" * 59, "API-Key = '" + "k" * 20, "apikey:" + "9" * 20, "-----BEGIN RSA PRIVATE KEY-----",
    "-----BEGIN PRIVATE KEY-----", "eyJh.eyJi.c", 'token = "' + "a0" * 20 + '"', "Select a + 'b", 'DELETE x || "', "insert concat 'x'", "shell_exec ( $x", "Popen($", "passthru ($a",
    "../x", "..\\x", "BackDoor", "KEYLOGGER", "rootkit", "Trojan", "eval (", "exec(", "system (", "unsafe {", "std::mem::transmute", 'cursor.execute("a % b"', ".innerHTML =",
    "exec.Command(a + b", "Statement.executeQuery(q + r", "strcpy", "sprintf(", "gets", "SqlCommand(a +", "catch (e) { }", "GoTo x", "ToDo", "fixme", "HACK", "x" * 130, "1234"]
RULES = [*R.SECRET_RULES, R.TOKEN_ASSIGNMENT, *R.VULNERABILITY_RULES, *R.BACKDOOR_RULES, *R.LANGUAGE_RULES, *R.QUALITY_RULES, *R.ANTI_PATTERN_RULES]


def holds(text, rule):
    low = text.lower() if rule.pattern.startswith("(?i)") else text
    return all(any(w in low for w in group) for group in rule.needs)


def test_every_rule_has_a_sample_and_its_literals():
    for rule in RULES:
        found = [s for s in SAMPLES if re.search(rule.pattern, s)]
        assert found, rule.name
        for s in found:
            for variant in (s, s.upper(), s.lower(), "é" + s + "Ü"):
                if re.search(rule.pattern, variant):
                    assert holds(variant, rule), (rule.name, variant)
    assert all(not any(w != w.lower() for g in r.needs for w in g) for r in RULES if r.pattern.startswith("(?i)"))


def test_literals_drop_no_line_of_the_tables(spark):
    """Every line that a pattern matches passes the literals, in prose, pages and generated text."""
    rnd = random.Random(1)
    words = SAMPLES + ["x", " ", "é", "= '", "(", "+", '"', "K", "İ"]
    texts = ["".join(rnd.choice(words) for _ in range(rnd.randrange(6))) for _ in range(3000)]
    lines = spark.createDataFrame([(t,) for t in texts], "line string").unionByName(Tables(spark, SF).pages.select(F.col("html").alias("line")))
    for rule in RULES:
        assert lines.where(F.col("line").rlike(rule.pattern) & ~S.may_match(F.col("line"), [rule])).count() == 0, rule.name


@pytest.fixture(scope="module")
def files(spark):
    t = Tables(spark, SF)
    docs = O.classify_file_type(O.inventory(B.doc_files(t))).select("job_id", "path", F.lit(None).cast("string").alias("language"), "file_type", "content")
    made = [(f"j{i % 3}", f"a/.hidden/backdoor_{i}.py" if i % 7 == 0 else f"src/{i}/.env" if i % 7 == 1 else f"src/{i}.js", ["python", "go", None, "c"][i % 4], "config" if i % 5 == 0 else "code",
             "\n".join([s, "plain", "\r", s + "\r"]) if i % 2 else "password = 'secret99'\n" + s) for i, s in enumerate(SAMPLES)]
    made += [("j", "empty", None, "code", ""), ("j", "null", None, "code", None)]
    return docs.unionByName(B.code_files(t).select(*docs.columns)).unionByName(spark.createDataFrame(made, docs.schema))


def rows(df):
    return sorted(map(tuple, df.select("finding_id", "job_id", "path", "line_number", "finding_type", "severity", "title", "confidence").collect()), key=str)


def test_whole_scan_equals_the_single_scanners(files):
    single = S.scan_files(files).unionByName(S.scan_configs(files)).unionByName(S.exposed_files(files)).unionByName(
        C.scan_language_rules(files)).unionByName(C.anti_patterns(files))
    got = S.scan_all(files)
    assert rows(got) == rows(single)
    shown = {r["finding_id"]: r["e"] for r in got.select("finding_id", F.col("evidence")["evidence"].alias("e")).collect()}
    for r in S.scan_secrets(files).select("finding_id", F.col("evidence")["line_content"].alias("e")).collect():
        assert shown[r["finding_id"]] == r["e"]


def test_whole_scan_reads_texts_once(spark):
    docs = O.classify_file_type(O.inventory(B.doc_files(Tables(spark, SF)))).withColumn("language", F.lit("go"))
    plan = S.scan_all(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and "Exchange" not in plan


def test_rare_keys_leave_before_the_shuffle(spark):
    rnd = random.Random(3)
    values = [rnd.randrange(-2**63, 2**63) for _ in range(3000)]
    keys = [v for i, v in enumerate(values) for _ in range(1 if i % 10 else 4)] + [-1] * 500
    df = spark.createDataFrame([(k,) for k in keys], "h long").repartition(4)
    kept = [r["h"] for r in maybe_repeated(df, "h", 2).collect()]
    counts = {k: keys.count(k) for k in set(values[::10]) | {-1}}
    assert all(kept.count(k) == n for k, n in counts.items())
    assert len(kept) <= 1.01 * sum(counts.values())
    few = [r["h"] for r in maybe_repeated(df, "h", 2, bits=1 << 15).collect()]  # more false hits, none lost
    assert all(few.count(k) == n for k, n in counts.items()) and len(few) < len(keys)


def test_line_figures_follow_the_lines(spark):
    """Line count, bytes in lines, long lines and density against the lines themselves, in any mix of line ends and alphabets."""
    rnd = random.Random(11)
    pieces = ["\n", "\r\n", "\r", "\n\n", "é" * 60, "x" * 199, "x" * 201, "\U0001f600" * 51, " ", "\u2028", "\u00a0", "\x1c", "a b", "\u3000\t"]
    texts = ["".join(rnd.choice(pieces) for _ in range(rnd.randrange(9))) for _ in range(500)] + [None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, content string")
    white = set("\t\n\x0b\x0c\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000") | {chr(c) for c in range(0x2000, 0x200B)}
    for r in S.obfuscation_metrics(df).collect():
        text = texts[r["id"]]
        lines = re.split(r"\r?\n", re.sub(r"\r?\n\Z", "", text)) if text else []
        sizes = [len(x.encode()) for x in lines]
        want = (sum(sizes) / len(lines), sum(n > 200 for n in sizes) / len(lines), sum(c not in white for c in text) / len(text.encode())) if lines else (None,) * 3
        assert (r["avg_line_length"], r["long_line_ratio"], r["density"]) == want, repr(text)


def test_lines_of_the_whole_scan_are_rows(spark, files):
    """Rules are tried on rows of lines: no pattern is left inside a lambda, where it would be interpreted."""
    plan = S.scan_all(files)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" in plan and not any("filter(transform(" in line for line in plan.splitlines())
    assert "regexp_extract_all" not in plan
