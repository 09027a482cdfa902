"""What a schema change would meet: counts and conflicts of an attribute's facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.db import Db


def attribute_impact(db: Db, ident: str) -> DataFrame:
    return db.facts(db.schema.get(ident)).agg(F.count("*").alias("datoms"), F.count_distinct("e").alias("entities"), F.count_distinct("v").alias("values"))


def cardinality_conflicts(db: Db, ident: str) -> DataFrame:
    """(e, n): entities with several values, which cardinality one would refuse."""
    return db.facts(db.schema.get(ident)).groupBy("e").agg(F.count("*").alias("n")).where("n > 1")


def duplicate_values(db: Db, ident: str) -> DataFrame:
    """(v, n): values of several entities, which uniqueness would refuse."""
    return db.facts(db.schema.get(ident)).groupBy("v").agg(F.count_distinct("e").alias("n")).where("n > 1")


def live_refs(db: Db, ident: str) -> DataFrame:
    return db.facts(db.schema.get(ident)).agg(F.count("*").alias("refs"))


def history_impact(db: Db, ident: str) -> DataFrame:
    return db.log().where(F.col("attr") == db.schema.get(ident).ident).agg(F.count("*").alias("datoms"), F.sum(F.col("added").cast("long")).alias("assertions"))
