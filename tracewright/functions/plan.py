"""A small plan shaper."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column behind a generator, so that later filters on it do not recompute it."""
    return df.select("*", F.explode(F.array(value)).alias(name))
