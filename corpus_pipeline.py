"""The corpus pipeline: each stage is one operator; what it returns is written as Parquet and read as the next one's docs.

Each stage sees what its predecessor kept, decides on every row of it, and its decision takes effect: rows go, or
their texts are masked. What a stage has written besides its result is removed when that is stored, and a stage's
result when the next one's is.

Defined results: null texts, empty ones and those without a letter go in the first stage. Rows with a null id are
never near copies of others, but are judged by their texts in every other stage; of rows with one id one stays after
the second stage. Ties between copies go to the smallest id. Texts are taken whole, however long. Equal rows are one
document with one id, or stay beside each other with null ids. Other columns go through unchanged, whatever their
names, up to the last stage, which returns doc_id, ids, decoded. An empty table of documents or of benchmark items
gives an empty result, or removes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import bpe, decontaminate, langid, neardup, secrets
from factloom.llm.common import remove, table, tidy
from factloom.llm.queries import vocabulary


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose language no codeword fits, go."""
    return langid.keep_identified(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return neardup.drop_near_copies(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def credentials(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking credentials are masked."""
    return secrets.redact(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, decoded text: the encoded documents."""
    return bpe.encode(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [("language", language), ("near_copies", near_copies), ("benchmark", benchmark), ("credentials", credentials), ("token_ids", token_ids)]
#: Components and merges are iterative: no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs = tidy(stage)(spark, docs, sf_dir)  # stored, and what else the stage has written removed
        if folder is not None:
            remove(spark, folder)
        folder = docs.folder
    return docs
