"""Column helpers for writing policy rules: quantifiers, bounds, clock and set tests.

Every helper returns a Column over built-ins, so rules stay row-local expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracewright.functions.lines import any_contains

# Text checks and clock bounds of the rule language.
EMAIL_ADDRESS = r"\A[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}\z"
MODEL_NAME = r"\A[a-z0-9\-_]+\z"
SENSITIVE_KEYWORDS = ["password", "secret", "api_key", "token"]
FIRST_HOUR, LAST_HOUR = 9, 17

Test = Callable[[Column], Column]


def every(items: Column, test: Test) -> Column:
    return F.forall(items, test)


def some(items: Column, test: Test) -> Column:
    return F.exists(items, test)


def count_where(items: Column, test: Test) -> Column:
    return F.size(F.filter(items, test))


def average_where(items: Column, test: Test, value: Test) -> Column:
    """Mean of ``value`` over the items that pass; null when none do."""
    kept = F.transform(F.filter(items, test), lambda x: value(x).cast("double"))
    return F.try_divide(F.aggregate(kept, F.lit(0.0), lambda a, x: a + x), F.size(kept))


def total(items: Column) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda a, x: a + x.cast("double"))


def valid_email(text: Column) -> Column:
    return text.rlike(EMAIL_ADDRESS)


def valid_model_name(text: Column) -> Column:
    return text.rlike(MODEL_NAME) & F.length(text).between(3, 50)


def mentions_sensitive(text: Column) -> Column:
    return any_contains(F.lower(text), SENSITIVE_KEYWORDS)


def rounded(score: Column) -> Column:
    return F.round(score * 100) / 100


def age_hours(stamp: Column, as_of: Column) -> Column:
    return F.timestamp_diff("SECOND", stamp, as_of) / 3600


def business_hours(ts: Column) -> Column:
    """Monday to Friday, 9 to 17 inclusive; weekday() counts from Monday = 0."""
    return (F.weekday(ts) <= 4) & F.hour(ts).between(FIRST_HOUR, LAST_HOUR)


def emergency_hours(ts: Column) -> Column:
    return (F.hour(ts) < 6) | (F.hour(ts) > 22)


def group_by_type(items: Column, kind: str) -> Column:
    """Map from each distinct ``kind`` to the items that have it."""
    kinds = F.array_sort(F.array_distinct(F.transform(items, lambda x: x[kind])))
    return F.map_from_arrays(kinds, F.transform(kinds, lambda k: F.filter(items, lambda x: x[kind] == k)))
