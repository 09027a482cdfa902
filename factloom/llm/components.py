"""Connected components of a links table, by alternating large and small stars; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Tables


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v")
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    near = down.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.union(low.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, tables: Tables) -> DataFrame:
    """(node, label) for each node of links(u, v): label is the least node that it can reach.

    A link from a node to itself and repeated links are harmless; an empty table gives an empty one.
    Each round is written to the call's tables, so lineage stays short and lost executors cost a stage.
    """
    edges = tables.written(_small(links.select("u", "v")), "links")
    before = _mark(edges)
    while True:
        stars = tables.written(_large(edges), "links")
        after = tables.written(_small(stars), "links")
        tables.dropped(edges, stars)
        edges, now = after, _mark(after)
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
        before = now
