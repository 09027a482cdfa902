"""Five stages that turn documents into a training mix; each stage's rows are written and read again by the next.

Each stage leaves no more behind it than a few bytes for each row that it drops or draws. Nulls, empty and
repeated rows, empty tables and further columns are treated as each stage says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom import on_workers
from factloom.llm import decontaminate, langid, mixing, secrets, simhash
from factloom.llm.shared import Tables, documents, released


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents without a letter (null texts too) and those that no learned language explains.

    Null langs, repeated rows, an empty table and further columns change nothing for the others.
    """
    on_workers(spark)
    return langid.accepted(docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the least doc_id, of each group of near duplicates.

    Null and empty texts are one group; of rows with the same doc_id the first in the files stays.
    """
    on_workers(spark)
    return simhash.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents in which a passage of the benchmark occurs; null and empty texts stay."""
    on_workers(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document, with a mark in place of each secret; null texts stay null."""
    on_workers(spark)
    return secrets.redacted(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draws the mix: a row for each copy of a document, whole, by shard; documents without words are never drawn."""
    on_workers(spark)
    return mixing.mixed(docs)


STAGES = [("language", language), ("dedup", dedup), ("decontamination", decontamination), ("secrets", secret_scan), ("mix", mix)]

#: SQL can express neither the models nor the draws; the tests hold each stage against a plain version or bounds instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, tables = documents(spark, sf_dir), Tables(spark)
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return tables.result(out)
        docs = tables.keep(out, name)
        released(out)
    raise AssertionError
