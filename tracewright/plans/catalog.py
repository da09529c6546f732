"""All registered queries."""

from tracewright.plans import code, events, evidence, files, history, integrity, policy, reports, rule_language, scan, sources, streaming, text  # noqa: F401
from tracewright.plans.registry import ORACLE, QUERIES  # noqa: F401
