"""Corpus pipeline: language ID, toxicity, exact dedup, near-dedup, packing.

Each stage takes (spark, docs, sf_dir), with docs as its predecessor left them, and returns the documents it keeps with
all their columns; the last returns the packing. Stages may be run one by one with their results written between them;
run() chains them over the documents table and writes each result to the shared folder.

Every stage judges rows, not ids: of rows that share an id each goes or stays for its own text. Empty and null texts are
rejected by the first stage, null ids are kept or dropped like others (the near-duplicate stage keeps them), repeated rows leave one
in the exact stage, an empty table gives an empty result, and further columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tributary.llm import exact_dedup, language_id, minhash_dedup, packing, toxicity
from tributary.llm.common import stash, table


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified (operator 10); rejected ones go."""
    return language_id.keep_identified(docs)


def detoxify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic (operator 5); its model is learned from the labels of the documents that are left."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts (operator 2)."""
    return exact_dedup.drop_copies(docs)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class (operator 7)."""
    return minhash_dedup.drop_near_copies(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of the documents that are left (operator 3)."""
    return packing.best_fit(docs)


STAGES = [("language_id", identify), ("toxicity", detoxify), ("exact_dedup", drop_exact), ("minhash_dedup", drop_near), ("best_fit_packing", pack)]
#: Models and alignment are beyond SQL; tests/llm compares the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
