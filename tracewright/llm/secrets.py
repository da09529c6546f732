"""Secret scan with multipart linking.

Strong patterns report on their own: assignments, access identifiers and long hex strings. Weak parts are the secrets,
identifiers and service endpoints of some vendors (``VENDOR_PARTS``), which alone are too common to report.
Parts are linked by an interval join inside a scope (a paragraph; blank lines end one): a part reaches over its
whole scope, or ``reach`` code points to either side if the caller sets it, and a weak secret is reported when an access
identifier or an endpoint lies in its reach, an endpoint or a weak identifier when a secret (weak, or the value of an
assignment) does. The join sweeps sorted intervals, so a scope with many parts makes no pairs.

Cases: null and empty texts have no spans; equal rows give equal results; overlapping spans of different
kinds are all kept; every search is linear in the text, so very long ones and such of dots or digits alone take no more a
byte; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tracewright.llm.batches import text_column

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Weak parts by vendor: kind, pattern, least and most length, and a string a text must hold (a secret without one
#: needs a digit and both cases). Lengths and prefixes are the vendors'.
VENDOR_PARTS = {
    "aws": (("weak_secret", r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])", 40, 40, ""), ("weak_access", r"AKIA[A-Z0-9]+", 12, 19, "AKIA")),
    "azure": (("weak_secret", r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{86}==(?![A-Za-z0-9+/=])", 88, 88, "=="), ("weak_access", r"\bAccountName=[a-z0-9]+(?![A-Z])", 15, 36, "AccountName=")),
    "google": (("weak_secret", r"\bGOCSPX-[A-Za-z0-9_-]+", 35, 35, "GOCSPX-"),
               ("weak_access", r"(?<![0-9])[0-9]+-[a-z0-9]{32}\.apps\.googleusercontent\.com\b", 66, 84, ".apps.googleusercontent.com")),
}
_PARTS = [(kind, re.compile(pattern, re.ASCII), least, most, hint) for parts in VENDOR_PARTS.values() for kind, pattern, least, most, hint in parts]
_MIXED = [re.compile(p) for p in ("[0-9]", "[A-Z]", "[a-z]")]
URL = re.compile(r"\bhttps?://[A-Za-z0-9.-]+(?::\d+)?", re.ASCII)
#: Domains of the vendors' services; a host below one is an endpoint.
DOMAINS = ("amazonaws.com", "core.windows.net", "googleapis.com")
_LABELS = re.compile(r"[a-z0-9-]+(?:\.[a-z0-9-]+)*+", re.ASCII)
_DOMAIN = re.compile(r"\.(?:" + "|".join(map(re.escape, DOMAINS)) + r")\b", re.ASCII)
_WORD_EDGE = re.compile(r"\b(?=[a-z0-9-])", re.ASCII)
SCOPE_END = re.compile(r"\n[\x20\t]*\n")
#: Order in which kinds are listed at one start.
KINDS = ("assign", "access", "hex", "weak_secret", "weak_access", "endpoint")
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the strong patterns."""
    out = []
    folded = text.lower()
    if any(w in folded for w in _WORDS):
        out += [(m.start(), "assign", m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), "hex", m.end()) for m in HEX.finditer(text)]
    return out


def endpoints(text: str) -> list[tuple[int, int]]:
    """Spans of URLs' hosts and of host names below the vendors' domains.

    A host is a chain of labels up to the last vendor domain in it; chains are cut once from left to right, so
    the search takes one pass whatever the text.
    """
    out = [m.span() for m in URL.finditer(text)] if "://" in text else []
    if not any(d in text for d in DOMAINS):
        return out
    inside = np.array(out, np.int64).reshape(-1, 2)
    for chain in _LABELS.finditer(text):
        if not any(d in chain[0] for d in DOMAINS):
            continue
        k = int(np.searchsorted(inside[:, 0], chain.start(), side="right")) - 1
        low = max(chain.start(), int(inside[k, 1])) if k >= 0 else chain.start()  # a URL may end inside the chain
        first = _WORD_EDGE.search(text, low, chain.end()) if low < chain.end() else None
        last = [m for m in _DOMAIN.finditer(text, low, chain.end() + 1) if m.end() <= chain.end()] if first else []
        if last and last[-1].start() > first.start():
            out.append((first.start(), last[-1].end()))
    return out


def weak_parts(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of parts that are reported only beside their complement."""
    out = set()
    for kind, pattern, least, most, hint in _PARTS:
        if hint in text:
            for m in pattern.finditer(text):
                if least <= m.end() - m.start() <= most and (hint or all(p.search(m[0]) for p in _MIXED)):
                    out.add((m.start(), kind, m.end()))
    return sorted(out) + [(a, "endpoint", b) for a, b in endpoints(text)]


def meets(spans: np.ndarray, others: np.ndarray, reach: int) -> np.ndarray:
    """Whether each (scope, start, end) has one of the others within reach in its scope.

    Both sides are sorted by (scope, start); running maxima of the ends answer each span by one search.
    """
    if not len(spans) or not len(others):
        return np.zeros(len(spans), bool)
    others = others[np.lexsort((others[:, 1], others[:, 0]))]
    far = int(max(spans[:, 2].max(), others[:, 2].max())) + reach + 1
    start = others[:, 0] * 2 * far + others[:, 1]
    end = np.maximum.accumulate(others[:, 0] * 2 * far + others[:, 2])
    at = np.searchsorted(start, spans[:, 0] * 2 * far + spans[:, 2] + reach, side="right") - 1
    return (at >= 0) & (others[np.maximum(at, 0), 0] == spans[:, 0]) & (end[np.maximum(at, 0)] >= spans[:, 0] * 2 * far + spans[:, 1] - reach)


def linked_spans(text: str, base: list[tuple[int, str, int]], reach: int | None = None) -> list[tuple[int, str, int]]:
    """Weak parts whose complement lies within reach in the same scope; a scope is no longer than the text."""
    reach = len(text) if reach is None else reach
    weak = weak_parts(text)
    if not weak:
        return []
    ends = np.array([m.start() for m in SCOPE_END.finditer(text)], np.int64)

    def table(*kinds: str) -> np.ndarray:
        rows = [(s, e) for s, k, e in weak + base if k in kinds]
        found = np.array(rows, np.int64).reshape(-1, 2)
        return np.column_stack([np.searchsorted(ends, found[:, 0]), found])

    secrets, names, places = table("weak_secret", "assign"), table("access", "weak_access"), table("endpoint")
    out = []
    for kind, complement in (("weak_secret", np.concatenate([names, places])), ("weak_access", secrets), ("endpoint", secrets)):
        own = table(kind)
        out += [(int(s), kind, int(e)) for _, s, e in own[meets(own, complement, reach)]]
    return out


def listed(spans: list[tuple[int, str, int]]) -> str:
    """kind:start:end by start, then kind as listed."""
    return ",".join(f"{k}:{s}:{e}" for s, k, e in sorted(spans, key=lambda x: (x[0], KINDS.index(x[1]))))


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def scan_secrets(docs: DataFrame, reach: int | None = None) -> DataFrame:
    """Spans per document, in code points with exclusive ends; reach None links parts over their whole scope."""
    def run(batches):
        for batch in batches:
            rows = []
            for value in text_column(batch):
                text = value.as_py()
                base = base_spans(text)
                count = [sum(k == kind for _, k, _ in base) for kind in KINDS[:3]]
                rows.append((*count, hashlib.sha256(listed(base).encode()).hexdigest(), listed(base + linked_spans(text, base, reach))))
            columns = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]), *(pa.array(c, pa.string()) for c in columns[3:])],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
