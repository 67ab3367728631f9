"""A corpus from raw documents: each stage filters or edits what the one before it kept.

run() gives the mix: a row per document of it, with its text, the words taken and its places in training.

Null and empty texts go where the classifier puts them, are never near duplicates, leak nothing and take no words. Rows
with a null doc_id pass like others. Repeated rows are near duplicates, so one stays (all, if they have no words). Very long
texts are read whole. Extra columns pass through, but where mix() has a column of that name. An empty table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ledgerframe.llm import decontaminate, jaccard, mixing, quality, secrets
from ledgerframe.llm.common import shared_dir, table


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def single(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return jaccard.deduplicated(docs)


def untested(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets masked."""
    return secrets.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources, in training order, with the texts."""
    return mixing.with_texts(mixing.mix(docs), docs)


STAGES = [("quality classifier", good), ("n-gram Jaccard join", single), ("benchmark decontamination", untested), ("secret scans", masked), ("mixing sources to target weights", mixed)]

#: None: SQL can't express the classifier's fit.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    top = f"{shared_dir(spark)}/corpus_pipeline/{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{top}/{i}")
        docs = spark.read.parquet(f"{top}/{i}")
    return docs
