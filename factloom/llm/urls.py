"""URL filters by a temporal list join, in DataFrame operations only.

A list has dated entries that add a pattern or remove it. Entries of a pattern become validity intervals
[since, until); each capture is joined as of its fetch date with the intervals of the patterns that its host
falls under: the host itself and each of its parent domains.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import OWN, Tables, with_row_id

#: Intervals that are broadcast at most; longer lists are joined by a shuffle, in which hot hosts are split.
SMALL = 200_000


def host(url: Column) -> Column:
    """The host of a URL in lower case, without user, port or a last dot; null where there is none."""
    found = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1)
    return F.nullif(F.rtrim(F.lower(found), F.lit(".")), F.lit(""))


def parents(name: Column) -> Column:
    """A host and its parent domains, longest first."""
    parts = F.split(name, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def intervals(entries: DataFrame) -> DataFrame:
    """(pattern, since, until) of entries(pattern, day, added): when each pattern was listed; until is null while it is.

    The last entry of a pattern's day counts (an addition over a removal of the same day); additions while listed
    and removals while not change nothing; entries without pattern, day or action are left out.
    """
    days = entries.where("pattern is not null and day is not null and added is not null").groupBy("pattern", "day").agg(F.max("added").alias("added"))
    by = Window.partitionBy("pattern").orderBy("day")
    turns = days.withColumn("was", F.coalesce(F.lag("added").over(by), F.lit(False))).where("added <> was")
    return turns.withColumn("until", F.lead("day").over(by)).where("added").select("pattern", F.col("day").alias("since"), "until")


def filtered(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures(url, fetched, ...) with host, blocked, pattern and since: the longest pattern listed on the fetch date.

    A capture without host or fetch date is not blocked; null, empty and malformed URLs have no host; repeated
    captures each get a row; empty captures give none, an empty list blocks nothing; columns of the new names in
    captures are replaced, others pass.
    """
    rid = f"{OWN}rid"
    with Tables(captures.sparkSession) as tables:
        marked = with_row_id(captures.drop("host", "blocked", "pattern", "since"), tables, rid)
        base = [c for c in marked.columns if c != rid]
        listed = tables.keep(intervals(entries), "intervals")
        listed = F.broadcast(listed) if listed.count() <= SMALL else listed
        rows = marked.withColumn("host", host(F.col("url")))
        each = rows.where("host is not null and fetched is not null").select(rid, "fetched", F.explode(parents(F.col("host"))).alias("pattern"))
        hit = each.join(listed, "pattern").where("since <= fetched and (until is null or fetched < until)")
        best = hit.groupBy(rid).agg(F.max(F.struct(F.char_length("pattern").alias("n"), "pattern", "since")).alias("best"))
        out = rows.join(best, rid, "left")
        return tables.result(out.select(*base, "host", F.col("best").isNotNull().alias("blocked"), F.col("best.pattern").alias("pattern"), F.col("best.since").alias("since")))
