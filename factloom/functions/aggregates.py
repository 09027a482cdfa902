"""Aggregates of Datalog, over the distinct rows of find and with."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.plans.parse import QueryError

NUMERIC = {"sum", "avg", "variance", "stddev"}


def aggregate(op: str, n: int | None, c: Column, type_: str) -> tuple[Column, str]:
    """The column of an aggregate and its type; lists have the type of their items and a star."""
    if type_ == "sealed" and op in NUMERIC | {"min", "max", "median"}:
        raise QueryError(f"{op} can't read a sealed value")
    if op in NUMERIC and type_ not in ("long", "double", "ref", "instant"):
        raise QueryError(f"{op} takes numbers, not {type_}")
    if n is not None:
        raise QueryError(f"no aggregate ({op} {n} ...)")
    simple = {
        "count": (F.count(F.lit(1)), "long"), "count-distinct": (F.count_distinct(c), "long"), "sum": (F.sum(c), type_ if type_ == "double" else "long"), "avg": (F.avg(c.cast("double")), "double"),
        "min": (F.min(c), type_), "max": (F.max(c), type_), "distinct": (F.array_sort(F.collect_set(c)), type_ + "*"), "variance": (F.var_pop(c.cast("double")), "double"), "stddev": (F.stddev_pop(c.cast("double")), "double"),
    } if op in ("count", "count-distinct", "sum", "avg", "min", "max", "distinct", "variance", "stddev") else {}
    if op not in simple:
        raise QueryError(f"no aggregate {op}")
    return simple[op]


def ordered(op: str, n: int | None) -> bool:
    """Whether an aggregate picks by order, as ranked() does."""
    return op == "median" or n is not None


def ranked(op: str, n: int | None, rows: DataFrame, keys: Sequence[str], var: str, type_: str, name: str) -> tuple[DataFrame, str]:
    """(keys, name) for median, the lower of two middle values of any type, and for the first or last n distinct values, as a list.

    Values are counted by group first, so what is sorted are distinct values, and no task holds a group: only n of it.
    """
    if op not in ("median", "min", "max", "sample") or n is not None and (op == "median" or n < 0):
        raise QueryError(f"no aggregate ({op} {n} ...)")
    if type_ == "sealed":
        raise QueryError(f"{op} can't read a sealed value")
    by = [F.col(f"`{k}`") for k in keys]
    v = F.col(f"`{var}`").alias("__v")
    counts = rows.select(*by, v).groupBy(*by, "__v").agg(F.count("*").alias("__c"))
    if op == "median":
        group = Window.partitionBy(*by)
        half = F.floor((F.sum("__c").over(group) + 1) / 2)
        upto = F.sum("__c").over(group.orderBy("__v").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        found = counts.withColumns({"__half": half, "__upto": upto}).where("__upto >= __half and __upto - __c < __half")
        return found.select(*by, F.col("__v").alias(name)), type_
    order = F.desc("__v") if op == "max" else F.asc("__v")
    first = counts.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(order))).where(F.col("__r") <= F.lit(n))
    if not n:
        return counts.groupBy(*by).agg(F.array().cast(f"array<{dict(counts.dtypes)['__v']}>").alias(name)), type_ + "*"
    return first.groupBy(*by).agg(F.array_sort(F.collect_list("__v")).alias(name)), type_ + "*"
