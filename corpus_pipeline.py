"""From raw documents to packed training sequences.

Each stage takes what the one before kept, written as Parquet and read again, and applies one corpus operator:
text of poor quality goes, of equal and of nearly equal texts one stays, contaminated documents go, and the rest is
packed. All stages but the last return the columns of ``documents``.

Defined results: null and empty texts pass the classifier, are equal to each other and near each other, so one of them
stays; null ids are ids like any other, but near duplicates whose ids are all null stay; rows that repeat an id and a text count as equal texts, rows that repeat an id
with different texts are documents of their own; of near duplicates the one with the smallest id stays, of several with
that id the one whose text has the smallest hash; an empty table gives no rows. What the stages write goes into a folder
of its own, which ``run`` leaves: its result is read from there.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import scratch, table, without
from tidemark.llm.decontamination import contamination
from tidemark.llm.exact_dedup import one_of_each
from tidemark.llm.packing import documents_packed
from tidemark.llm.quality import judged
from tidemark.llm.simhash import near_duplicates, others_of_groups


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity the classifier accepts."""
    return without(docs, judged(docs, table(spark, sf_dir, "labels")).where("NOT keep"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return one_of_each(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates."""
    return without(docs, others_of_groups(near_duplicates(docs)))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold too little of the benchmark to count as contaminated."""
    return without(docs, contamination(docs, table(spark, sf_dir, "benchmark")).where("contaminated"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences."""
    return documents_packed(docs)


STAGES = [
    ("quality", quality),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: The classifier, the fingerprints' hash and the tokenizer have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    base = f"{scratch(spark)}/tidemark-pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        path = f"{base}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
