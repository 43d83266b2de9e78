"""A corpus pipeline of four stages: quality rules, toxicity, SimHash near-duplicates, best-fit packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. ``run`` writes
each stage's result as Parquet in the shared folder and reads it again for the next. All stages but the
last return the columns of documents; the last returns the packed pieces with their bins.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from scriptorium.llm import packing, quality_rules, queries, severity, simhash, tokens
from scriptorium.session import load, scratch_path


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the learned decision list keeps."""
    return quality_rules.keep_good(docs, quality_rules.fit(docs, load(spark, sf_dir, "labels")))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are expected to have the lowest severity grade."""
    return severity.keep_clean(docs, severity.fit_toxic(docs, load(spark, sf_dir, "labels")))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates."""
    return simhash.one_of_each(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of permitted lengths, in tokens as operators 3 and 5 count them."""
    shared = tokens.share(spark, public_tokenizers.path(queries.WORD_FILE))
    return packing.best_fit_pack(packing.with_length(docs, shared=shared))


STAGES = [("quality_rules", good), ("toxicity", clean), ("simhash_near_dedup", distinct), ("best_fit_packing", packed)]

#: No SQL: the first two stages learn their rules, the third fingerprints texts.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, stages: list = STAGES) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in stages:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
