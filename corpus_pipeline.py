"""Corpus pipeline: quality rules, n-gram Jaccard join, benchmark decontamination, secret scans, best-fit packing.

Each stage takes (spark, docs, sf_dir), works on everything its predecessor kept, and returns a DataFrame that is written as
Parquet and read again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphfold.llm import best_fit_packing, decontamination, jaccard_join, quality_rules, secret_scan
from graphfold.llm.common import materialise, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    docs = docs.select(*COLUMNS)
    return quality_rules.filter_documents(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar documents stays, the one with the least doc_id."""
    return jaccard_join.keep_one(docs.select(*COLUMNS))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; its secrets are replaced."""
    return secret_scan.redact(docs.select(*COLUMNS))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of at most 4096 tokens."""
    from public_tokenizers import path

    return best_fit_packing.pack_documents(docs, path("word_bpe_49k.json"))


STAGES = [("quality_rules", quality), ("ngram_jaccard_join", near_duplicates), ("benchmark_decontamination", decontaminate), ("secret_scans", secrets), ("best_fit_packing", packing)]

#: The trees of the first stage can't be written as SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
