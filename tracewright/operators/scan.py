"""Security findings: line scanners share ``scan_lines``; the rest are per-file predicates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright import rules as R
from tracewright.functions.lines import any_contains, any_match, explode_lines, line_count, split_lines, trimmed
from tracewright.functions.plan import computed_once
from tracewright.model import as_findings, severity_of
from tracewright.operators.files import byte_entropy, file_name
from tracewright.rules import Rule


def _constants(values: Sequence, ix: Column) -> Column:
    """values[ix] for a driver-known list; Catalyst folds the array to one literal."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), ix + 1)


def _language_gate(rule: Rule, language: Column | None) -> Column | None:
    if "*" in rule.languages or language is None:
        return None
    return F.coalesce(language.isin(*rule.languages), F.lit(False))


def _guarded(rule: Rule, hit: Column, language: Column | None) -> Column:
    gate = _language_gate(rule, language)
    return hit if gate is None else gate & hit


def _folds(rule: Rule) -> bool:
    return rule.pattern.startswith("(?i)")


def _has_needs(text: Column, rule: Rule) -> Column:
    """Whether the text holds the literals of a rule."""
    return reduce(lambda a, b: a & b, [any_contains(text, list(group)) for group in rule.needs])


def may_match(text: Column, rules: Sequence[Rule], language: Column | None = None) -> Column:
    """Whether the literals of any rule are there: byte searches in place of patterns. The text is folded once, if at all."""
    free = [_guarded(r, F.lit(True), language) for r in rules if not r.needs]
    plain = [_guarded(r, _has_needs(text, r), language) for r in rules if r.needs and not _folds(r)]
    folded = [r for r in rules if r.needs and _folds(r)]
    tests = free + plain
    if folded:
        tests.append(F.exists(F.array(F.lower(text)), lambda low: reduce(lambda a, b: a | b, [_guarded(r, _has_needs(low, r), language) for r in folded])))
    return reduce(lambda a, b: a | b, tests)


def matching_rules(text: Column, rules: Sequence[Rule], language: Column | None = None) -> Column:
    """Array of the indexes of the rules that match; patterns are literals, compiled once per task."""
    def hit(rule: Rule) -> Column:
        found = text.rlike(rule.pattern)
        return _guarded(rule, found if not rule.needs or _folds(rule) else _has_needs(text, rule) & found, language)

    return F.array_compact(F.array(*[F.when(hit(r), F.lit(i)) for i, r in enumerate(rules)]))


def scan_lines(
    files: DataFrame, rules: Sequence[Rule], *, content: str = "content", redacted: bool = False
) -> DataFrame:
    """Findings for every (line, rule) match.

    Files without the literals of any rule are dropped before lines are exploded, lines without them before
    patterns are tried.
    """
    language = F.col("language") if "language" in files.columns else None
    keep = ["job_id", "path"] + (["language"] if language is not None else [])
    rows = files.select(*keep, F.col(content).alias("content")).where(may_match(F.col("content"), rules, language))
    lines = explode_lines(rows).where(may_match(F.col("line"), rules, language))
    hits = lines.withColumn("_ix", F.explode(matching_rules(F.col("line"), rules, language)))
    return _line_findings(hits, rules, redact(F.col("line")) if redacted else trimmed(F.col("line")))


def _line_findings(hits: DataFrame, rules: Sequence[Rule], text: Column) -> DataFrame:
    """Findings of (job_id, path, line_number, line, _ix) rows."""
    ix = F.col("_ix")
    return as_findings(
        hits,
        rule=_constants([r.name for r in rules], ix),
        finding_type=_constants([r.finding_type for r in rules], ix),
        severity=_constants([r.severity for r in rules], ix),
        title=_constants([r.title for r in rules], ix),
        confidence=_constants([r.confidence for r in rules], ix),
        evidence={"rule": _constants([r.name for r in rules], ix), "line_content": text},
        recommendation=_constants([r.recommendation for r in rules], ix),
        path=F.col("path"),
        line_number=F.col("line_number"),
        references=F.split(_constants([" ".join(r.references) for r in rules], ix), " "),
    )


def redact(text: Column) -> Column:
    for pattern, replacement in R.REDACTIONS:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def scan_paths(files: DataFrame, fragments: Sequence[str] = R.SUSPICIOUS_PATH_FRAGMENTS) -> DataFrame:
    """One finding per (file, fragment); the file is read once whatever the list length."""
    low = F.lower("path")
    found = F.filter(F.array(*[F.lit(f) for f in fragments]), lambda f: F.contains(low, f))
    hits = files.select("job_id", "path", F.explode(found).alias("fragment"))
    return as_findings(
        hits, rule=F.concat(F.lit("path:"), F.col("fragment")), finding_type="suspicious_code", severity="medium",
        title="Suspicious file path detected", confidence=0.7, evidence={"pattern": F.col("fragment")},
        recommendation="Find out what the file is for", path=F.col("path"),
    )


def scan_hidden(files: DataFrame) -> DataFrame:
    p = F.col("path")
    hidden = p.contains("/.") & ~p.contains("/.git/") & ~p.contains("/.github/")
    return as_findings(
        files.where(hidden), rule=F.lit("hidden"), finding_type="suspicious_code", severity="low",
        title="Hidden directory detected", confidence=0.5, evidence={"file_path": p},
        recommendation="List what the directory holds and who put it there", path=p,
    )


def scan_secrets(files: DataFrame, rules: Sequence[Rule] = R.SECRET_RULES) -> DataFrame:
    """Secret patterns; severity follows the rule's confidence, evidence is redacted."""
    found = scan_lines(files.drop("language"), rules, redacted=True)
    return found.withColumn("severity", severity_of(F.col("confidence")))


def scan_vulnerabilities(files: DataFrame, rules: Sequence[Rule] = R.VULNERABILITY_RULES) -> DataFrame:
    return scan_lines(files, rules)


def scan_backdoors(files: DataFrame, rules: Sequence[Rule] = R.BACKDOOR_RULES) -> DataFrame:
    return scan_lines(files, rules)


def scan_entropy(files: DataFrame, threshold: float = 7.5) -> DataFrame:
    hot = byte_entropy(files.select("job_id", "path", "content")).where(F.col("entropy") > threshold)
    return as_findings(
        hot, rule=F.lit("entropy"), finding_type="malware", severity="medium", title="High entropy file detected",
        confidence=0.4, evidence={"entropy": F.round("entropy", 6)}, path=F.col("path"),
        recommendation="Unpack or decrypt the file and look inside",
    )


def scan_signatures(files: DataFrame, signatures: Sequence[tuple[str, str]] = R.SIGNATURES) -> DataFrame:
    found = F.array_compact(F.array(*[F.when(F.col("content").contains(s), F.lit(n)) for n, s in signatures]))
    hits = files.select("job_id", "path", F.explode(found).alias("signature"))
    return as_findings(
        hits, rule=F.col("signature"), finding_type="malware", severity="high", title=F.col("signature"),
        confidence=0.7, evidence={"signature": F.col("signature")}, path=F.col("path"),
    )


def _line_stats(files: DataFrame) -> DataFrame:
    """Line count, bytes in lines and long lines; lines are only split where the text has 201 bytes between line ends."""
    content = F.col("content")
    plain = F.replace(content, F.lit("\r\n"), F.lit("\n"))
    line_ends = F.length(plain) - F.length(F.replace(plain, F.lit("\n"), F.lit("")))
    # 51 characters may be 201 bytes; in ASCII it takes as many characters
    maybe = F.when(F.length(content) == F.octet_length(content), content.rlike(r"(?m)^[^\n]{201}")).otherwise(content.rlike(r"(?m)^[^\n]{51}"))
    over = F.when(maybe, F.size(F.filter(split_lines(content), lambda x: F.octet_length(x) > 200))).otherwise(0)
    return computed_once(files, "_s", F.struct(
        line_count(plain).alias("n"), (F.octet_length(plain) - line_ends).cast("long").alias("bytes"), over.alias("long")))


def obfuscation_metrics(files: DataFrame) -> DataFrame:
    s = F.col("_s")
    dense = F.length(F.regexp_replace("content", r"(?U)\s+", "")) / F.octet_length("content")
    return (
        _line_stats(files)
        .withColumn("avg_line_length", F.when(s["n"] > 0, s["bytes"] / s["n"]))
        .withColumn("long_line_ratio", F.when(s["n"] > 0, s["long"] / s["n"]))
        .withColumn("density", F.when(s["n"] > 0, dense))
        .drop("_s")
    )


def is_obfuscated(files: DataFrame, density: float = 0.8) -> DataFrame:
    flag = (F.col("avg_line_length") > 100) | (F.col("long_line_ratio") > 0.1) | (F.col("density") > density)
    return obfuscation_metrics(files).withColumn("is_obfuscated", F.coalesce(flag, F.lit(False)))


def scan_obfuscated(files: DataFrame, density: float = 0.8) -> DataFrame:
    return as_findings(
        is_obfuscated(files, density).where("is_obfuscated"), rule=F.lit("obfuscated"),
        finding_type="suspicious_code", severity="medium", title="Potentially obfuscated code detected",
        confidence=0.6, evidence={"density": F.round("density", 6)}, path=F.col("path"),
        recommendation="Ask for the source this was made from",
    )


def is_obfuscated_ml(files: DataFrame) -> DataFrame:
    """Looser variant: whole bytes per line, long lines over a (whole) quarter of all lines."""
    s = F.col("_s")
    flag = (F.octet_length("content") / s["n"] > 100) | (s["long"] > F.floor(s["n"] / 4))
    return (
        _line_stats(files).withColumn("is_obfuscated", F.when(s["n"] > 0, flag).otherwise(False)).drop("_s")
    )


def exec_ratio(files: DataFrame, limit: float = 0.3) -> DataFrame:
    per_job = files.groupBy("job_id").agg(
        F.count_if(F.col("file_type") == "executable").alias("executables"), F.count("*").alias("total")
    ).withColumn("ratio", F.col("executables") / F.col("total"))
    return as_findings(
        per_job.where(F.col("ratio") > limit), rule=F.lit("exec_ratio"), finding_type="anomaly", severity="medium",
        title="Unusually high number of executable files", confidence=0.6,
        evidence={"executable_count": F.col("executables"), "total_files": F.col("total"),
                  "ratio": F.round("ratio", 6)},
        recommendation="Build programs from source; keep none in the repository",
    )


def scan_configs(files: DataFrame) -> DataFrame:
    hits = files.where((F.col("file_type") == "config") & any_match(F.col("content"), R.CREDENTIAL_PATTERNS))
    return as_findings(
        hits, rule=F.lit("config_credentials"), finding_type="secret_exposure", severity="high",
        title="Hardcoded credentials in configuration", confidence=0.8,
        evidence={"detection_method": F.lit("credential_pattern_matching")}, path=F.col("path"),
        recommendation="Inject the credentials when the service starts",
    )


def exposed_files(files: DataFrame, names: Sequence[str] = R.EXPOSED_FILE_NAMES) -> DataFrame:
    name = file_name(F.col("path"))
    return as_findings(
        files.where(name.isin(*names)), rule=F.lit("exposed"), finding_type="data_leak", severity="high",
        title="Potentially sensitive file exposed", confidence=0.8, evidence={"filename": name}, path=F.col("path"),
        recommendation="Take the file out of the tree and its history",
    )


def scan_repository(files: DataFrame) -> DataFrame:
    """Repository-level findings."""
    return exec_ratio(files).unionByName(scan_configs(files)).unionByName(exposed_files(files))


#: Line rules of a whole scan and whether the evidence is redacted.
LINE_RULES = (
    *((r, True) for r in R.SECRET_RULES), *((r, False) for r in R.VULNERABILITY_RULES), *((r, False) for r in R.BACKDOOR_RULES),
    *((r, False) for r in R.LANGUAGE_RULES), *((r, False) for r in R.ANTI_PATTERN_RULES))


def scan_all(files: DataFrame, line_rules: Sequence[tuple[Rule, bool]] = LINE_RULES) -> DataFrame:
    """All findings of files(job_id, path, language, file_type, content) from one scan of the texts.

    Every file gives one array: what its path and its whole text raise (path fragments, hidden folders, exposed names, configured
    credentials, obfuscation) and its lines, which become rows that all line rules are tried on. Lines are only split where a rule's
    literals are in the file, and patterns only tried where they are in the line. Rows are what the single scanners give.
    """
    rules, redacted = [r for r, _ in line_rules], [r.name for r, hidden in line_rules if hidden]
    language, path, content = F.col("language"), F.col("path"), F.col("content")

    def found(kind: str, evidence: Column, where: Column) -> Column:
        return F.when(where, F.struct(F.lit(kind).alias("kind"), F.lit(None).cast("int").alias("_ix"), F.lit(None).cast("int").alias("line_number"), evidence.cast("string").alias("line")))

    fragments = F.transform(
        F.filter(F.array(*[F.lit(f) for f in R.SUSPICIOUS_PATH_FRAGMENTS]), lambda f: F.contains(F.lower(path), f)), lambda f: found("path", f, F.lit(True)))
    name = file_name(path)
    hidden = path.contains("/.") & ~path.contains("/.git/") & ~path.contains("/.github/")
    whole = F.array(
        found("hidden", path, hidden), found("exposed", name, name.isin(*R.EXPOSED_FILE_NAMES)),
        found("config", F.lit("credential_pattern_matching"), (F.col("file_type") == "config") & any_match(content, R.CREDENTIAL_PATTERNS)),
        found("obfuscated", F.round("density", 6), F.col("is_obfuscated")))
    tagged = F.transform(split_lines(content), lambda x, i: F.struct(
        F.lit("line").alias("kind"), F.lit(None).cast("int").alias("_ix"), (i + 1).cast("int").alias("line_number"), x.alias("line")))
    empty = F.array().cast("array<struct<kind:string,_ix:int,line_number:int,line:string>>")
    lines = F.when(may_match(content, rules, language), tagged).otherwise(empty)
    is_line, line = F.col("kind") == "line", F.col("line")
    raised = is_obfuscated(files.select("job_id", "path", "language", "file_type", "content")).select(
        "job_id", "path", "language", F.explode(F.concat(fragments, F.array_compact(whole), lines)).alias("f")).select("job_id", "path", "language", "f.*")
    # Rows of lines, not lambdas over them: their tests are compiled.
    rows = raised.where(~is_line | may_match(line, rules, language)).withColumn(
        "_ix", F.explode(F.when(is_line, matching_rules(line, rules, language)).otherwise(F.array(F.col("_ix")))))
    by_kind = {
        "path": (F.concat(F.lit("path:"), F.col("line")), "suspicious_code", "medium", "Suspicious file path detected", 0.7),
        "hidden": (F.lit("hidden"), "suspicious_code", "low", "Hidden directory detected", 0.5),
        "exposed": (F.lit("exposed"), "data_leak", "high", "Potentially sensitive file exposed", 0.8),
        "config": (F.lit("config_credentials"), "secret_exposure", "high", "Hardcoded credentials in configuration", 0.8),
        "obfuscated": (F.lit("obfuscated"), "suspicious_code", "medium", "Potentially obfuscated code detected", 0.6)}
    ix, text = F.coalesce("_ix", F.lit(0)), F.col("line")

    def pick(place: int, of_rule: Column) -> Column:
        out = of_rule
        for kind, values in by_kind.items():
            out = F.when(F.col("kind") == kind, values[place] if isinstance(values[place], Column) else F.lit(values[place])).otherwise(out)
        return out

    rule = _constants([r.name for r in rules], ix)
    secret = _constants([r.finding_type == "secret_exposure" for r in rules], ix)
    confidence = _constants([r.confidence for r in rules], ix)
    shown = F.when(F.col("kind") != "line", text).when(rule.isin(*redacted), redact(text)).otherwise(trimmed(text))
    return as_findings(
        rows, rule=pick(0, rule), finding_type=pick(1, _constants([r.finding_type for r in rules], ix)),
        severity=pick(2, F.when(secret, severity_of(confidence)).otherwise(_constants([r.severity for r in rules], ix))),
        title=pick(3, _constants([r.title for r in rules], ix)), confidence=pick(4, confidence), evidence={"evidence": shown},
        recommendation=F.when(F.col("kind") == "line", _constants([r.recommendation for r in rules], ix)), path=path, line_number=F.col("line_number"))


def scan_files(files: DataFrame, secret_rules: Sequence[Rule] = R.SECRET_RULES) -> DataFrame:
    """All per-file findings."""
    parts = [
        scan_paths(files), scan_hidden(files), scan_secrets(files, secret_rules), scan_vulnerabilities(files),
        scan_obfuscated(files), scan_backdoors(files),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
