"""The ten queries over whole tables, and their SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom import on_workers

from . import decontaminate, html, langid, mixing, pitmanyor, quality, secrets, simhash, sql, tokens, urls
from .shared import documents


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "shards")


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    on_workers(spark)
    return html.extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(documents(spark, sf_dir))


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, fetched on a day of 2024 that its id gives, against a list of dated entries for every site of the table."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    captures = pages.select("page_id", "url", F.expr("date_add(date'2024-01-01', cast(page_id % 366 as int))").alias("fetched"))
    sites = pages.select(F.explode(urls.parents(urls.host(F.col("url")))).alias("pattern")).distinct().where("instr(pattern, '.') > 0")
    day = F.expr("date_add(date'2024-01-01', cast((ascii(pattern) * 31 + char_length(pattern) * 17) % 400 as int))")
    dated = sites.where("char_length(pattern) % 3 <> 0").withColumn("day", day)
    removed = dated.where("char_length(pattern) % 2 = 0").select("pattern", F.date_add("day", 45).alias("day"), F.lit(False).alias("added"))
    again = dated.where("char_length(pattern) % 4 = 0").select("pattern", F.date_add("day", 90).alias("day"), F.lit(True).alias("added"))
    entries = dated.select("pattern", "day", F.lit(True).alias("added")).unionByName(removed).unionByName(again)
    return urls.filtered(captures, entries)


def op7_pitmanyor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitmanyor.scored(documents(spark, sf_dir))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scanned(documents(spark, sf_dir))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identified(documents(spark, sf_dir))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rated(documents(spark, sf_dir))


QUERIES = {f.__name__: f for f in (op1_simhash, op2_mixing, op3_html, op4_decontamination, op5_tokens, op6_urls, op7_pitmanyor, op8_secrets, op9_langid, op10_quality)}

ORACLE_SQL: dict[str, str] = sql.ORACLE_SQL
