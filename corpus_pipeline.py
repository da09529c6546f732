"""The corpus pipeline: stages over the documents table, each written as Parquet and reread by the next.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return
the columns of documents.

Cases: documents with a null id are judged by their text like others, but are never dropped as copies, since only ids
name the document that stays. Null and empty texts pass all stages and have no tokens. Rows that share an id are told
apart by their texts; rows of equal id and text are one from the third stage on. Very long texts are read whole. Ties go to
the smaller id. Other columns of documents are carried along, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import bpe, toxicity
from tracewright.llm.decontaminate import decontaminate
from tracewright.llm.jaccard import linked_texts
from tracewright.llm.lines import dedup_lines
from tracewright.session import checkpoint_dir, cut_lineage

#: Ids sent to all tasks at most, some 32 MB; beyond, they are joined by a shuffle.
BROADCAST_IDS = 1 << 18


def _joined(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Documents that match the ids on all columns of these (left_semi), or do not (left_anti)."""
    ids = cut_lineage(ids.distinct())
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, ids.columns, how)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain does not reject."""
    chain = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = toxicity.score_toxicity(docs, chain).where("NOT rejected")
    return scored.select(*[F.col("doc_id") if c == "doc_id" else F.col(f"rest.{c}").alias(c) for c in docs.columns])


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand earlier; those of which nothing is left go."""
    cut = dedup_lines(docs).where("n_removed = 0 OR text RLIKE '[^\\\\x09-\\\\x0D\\\\x20]'")
    kept = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("rest.n_chars")).alias("n_chars")}
    return cut.select(*[kept.get(c, F.col(f"rest.{c}").alias(c)) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of similar ones; rows of equal id and text are one.

    Documents are similar from 80 % of common five-word shingles on, the rule of stages on word shingles; the
    thin query of op9 has a contract of its own. Rows are told apart by id and text.
    """
    linked = cut_lineage(linked_texts(docs, percent=80, size=5).where("doc_id IS NOT NULL").select("doc_id", F.col("text_hash").alias("_hash"), "least"))
    key = ["doc_id", "_hash"]
    hashed = docs.withColumn("_hash", F.xxhash64("text"))
    kept = _joined(hashed, linked.where("doc_id <> least.doc_id OR _hash <> least.text_hash").select(*key), "left_anti")
    repeated = cut_lineage(linked.groupBy(*key).count().where("count > 1").select(*key))
    if repeated.limit(1).count():
        kept = _joined(kept, repeated, "left_anti").unionByName(_joined(kept, repeated, "left_semi").dropDuplicates(key))
    return kept.select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    docs_by_key = docs.withColumn("_key", F.xxhash64("doc_id", "text"))
    found = decontaminate(docs_by_key.select(F.col("_key").alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _joined(docs_by_key, found.where("contaminated").select(F.col("doc_id").alias("_key")), "left_anti").select(*docs.columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with digests of the ids and of the bytes they decode to."""
    return bpe.encode_digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("byte-level BPE", encode_tokens),
]
#: The classifier and the tokenizer cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; what a stage keeps is written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        place = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(place)
        docs = spark.read.parquet(place)
    return docs
