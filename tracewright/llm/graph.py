"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.session import cut_lineage, few, release, remove_folder, reread, scratch_folder


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for every node of the edges (a, b): the smallest node that links reach.

    Each round takes the least label among the neighbours, hands it to the whole former component and
    follows labels one step, so the rounds grow with the logarithm of the longest path. Every round is written to
    the shared folder and read again, in two steps that keep its plans small, which cuts its lineage and lets joins go by its
    true size; the files go at the end.
    Minima are combined before the shuffle, so hubs are cheap.
    """
    spark = edges.sparkSession
    folder = scratch_folder(spark, "components")
    try:
        both = reread(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct(), f"{folder}/edges")
        rows, number = both.count(), 0
        labels = reread(few(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")), rows).select("node", F.least("node", "low").alias("comp")), f"{folder}/{number}")
        while True:
            near = few(both.join(labels.toDF("b", "label"), "b"), rows).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
            seen = reread(few(labels.join(near, "node"), rows).select("node", "comp", F.least("comp", "near").alias("low")), f"{folder}/seen-{number}")  # read four times below
            roots = seen.groupBy("comp").agg(F.min("low").alias("root"))
            hooked = few(seen.join(roots, "comp"), rows).select("node", "comp", "root")
            jump = hooked.select(F.col("node").alias("root"), F.col("root").alias("next"))
            number += 1
            fresh = reread(few(hooked.join(jump, "root"), rows).select("node", "comp", F.least("root", "next").alias("root")), f"{folder}/{number}")
            labels = fresh.select("node", F.col("root").alias("comp"))
            if not fresh.where("root < comp").limit(1).count():
                return cut_lineage(labels)
            release(spark)
    finally:
        remove_folder(spark, folder)
