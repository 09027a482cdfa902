"""Relationship-based access: which requests a set of relationship tuples grants, for all requests at once.

A tuple says that a subject (type:id, or all holders of a relation, type:id#relation) has a relation to an object; type:*
is every one of a type. A request is granted if its subject is reached from (relation, object) in MOST_HOPS hops.
What a request leads to depends on its relation and object alone, so every round joins the goals that are open of each such
pair with the tuples, checkpointed, and then the subjects that ask for the pair with what it has reached; granted ones leave.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.plans.compile import cut
from factloom.schema import Schema

MOST_HOPS, MOST_GOALS = 8, 10_000
#: Rows of one key that a task joins.
PART = 100_000
#: Relations through which a plain subject that is a group is opened.
EXPAND = ("member",)


def _kind(column: str) -> F.Column:
    return F.substring_index(column, ":", 1)


def _any(column: str) -> F.Column:
    return F.concat(_kind(column), F.lit(":*"))


def _spread(many: DataFrame, few: DataFrame, on: Sequence[str], by: Sequence[str], how: str, large: bool = False) -> DataFrame:
    """many joined with few on these columns; of a key that many has over PART times, its rows are dealt by other columns to
    parts that each meet few's. The list of such keys is broadcast: it has at most a PARTth of many's rows. large: neither
    side is broadcast, whatever Spark takes its size to be."""
    often = many.groupBy(*on).agg(F.count("*").alias("__n")).where(F.col("__n") > PART)
    often = F.broadcast(often.select(*on, F.ceil(F.col("__n") / PART).cast("int").alias("__n")))
    parts = F.coalesce("__n", F.lit(1))
    left = many.join(often, list(on), "left").withColumn("__part", F.pmod(F.hash(*by), parts)).drop("__n")
    right = few.join(often, list(on), "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__n")
    right = right.hint("merge") if large else right
    return left.join(right, [*on, "__part"], how).drop("__part")


def check(
    tuples: DataFrame, requests: DataFrame, rewrites: DataFrame | None = None, expand: Sequence[str] = EXPAND, most_hops: int = MOST_HOPS, most_goals: int = MOST_GOALS
) -> DataFrame:
    """rid, outcome (granted, denied or exhausted) and hops (null unless granted) for each of requests(rid, subject, relation, object).

    tuples: subject, relation, object. rewrites: relation, via_relation, on_relation, object_type (null: any): what has
    on_relation to a parent, by via_relation, of an object has relation to the object. A request that isn't granted
    before a round starts with most_goals or more behind it is exhausted; goals on what no tuple has as its object don't count. rids must differ; repeated tuples don't matter.
    """
    plain = F.substring_index("subject", "#", 1)
    edges = tuples.distinct().select(F.col("relation").alias("r"), F.col("object").alias("o"), plain.alias("s"), F.when(F.contains("subject", F.lit("#")), F.substring_index("subject", "#", -1)).alias("of"))
    edges = cut(edges)
    # only what is the object of a tuple can lead on: the users of a large group are never listed
    objects = edges.select(F.col("o").alias("p")).distinct()
    plain = edges.where("of is null")
    groups = _spread(plain.withColumn("p", F.explode(F.array_distinct(F.array("s", _any("s"))))), objects, ["p"], ["r", "o", "s"], "left_semi", large=True)
    paths = cut(edges.where("of is not null").unionByName(groups.drop("p").distinct()))
    wild = plain.where(F.col("s") == _any("s")).select(F.col("r").alias("goal"), "o", F.col("s").alias("all"))
    held = plain.select(F.col("r").alias("goal"), "o", F.col("s").alias("who"))
    # ar and ao: the relation and object that a request asks for
    asked = requests.select("rid", F.col("subject").alias("who"), F.col("relation").alias("ar"), F.col("object").alias("ao"))
    left = cut(asked.drop("rid").distinct())
    goals = cut(left.select("ar", "ao").distinct().select("ar", "ao", F.col("ar").alias("goal"), F.col("ao").alias("on")))
    seen = goals
    visits = granted = exhausted = None
    for hop in range(most_hops + 1):
        here = goals.withColumn("o", F.explode(F.array_distinct(F.array("on", _any("on")))))
        places = here.select("ar", "ao", "goal", "o").distinct()
        named = _spread(left, places, ["ar", "ao"], ["who"], "inner", large=True).join(held.hint("merge"), ["goal", "o", "who"], "left_semi")
        opened_to = places.join(wild, ["goal", "o"]).select("ar", "ao", "all").distinct()
        anyone = _spread(left.withColumn("all", _any("who")), opened_to, ["ar", "ao", "all"], ["who"], "left_semi")
        found = cut(named.select("who", "ar", "ao").unionByName(anyone.select("who", "ar", "ao")).distinct())
        granted = (lambda x: x if granted is None else granted.unionByName(x))(found.withColumn("hops", F.lit(hop)))
        left = cut(left.join(found.hint("merge"), ["who", "ar", "ao"], "left_anti"))
        met = here.join(paths, (F.col("goal") == F.col("r")) & (here["o"] == paths["o"])).select("ar", "ao", "s", "of")
        opened = F.when(F.col("of").isNotNull(), F.array("of")).otherwise(F.array(*map(F.lit, expand)).cast("array<string>"))
        after = met.select("ar", "ao", F.explode(opened).alias("goal"), F.col("s").alias("on"))
        if rewrites is not None:
            fits = F.col("object_type").isNull() | (F.col("object_type") == _kind("on"))
            derived = here.join(rewrites, F.col("goal") == F.col("relation")).where(fits)
            derived = derived.select("ar", "ao", "o", "via_relation", "on_relation")
            parents = derived.join(paths, (F.col("via_relation") == F.col("r")) & (derived["o"] == paths["o"]))
            after = after.unionByName(parents.select("ar", "ao", F.col("on_relation").alias("goal"), F.col("s").alias("on")))
        counted = goals.groupBy("ar", "ao").agg(F.count("*").alias("n"))
        visits = cut(counted if visits is None else visits.unionByName(counted).groupBy("ar", "ao").agg(F.sum("n").alias("n")))
        asking = left.select("ar", "ao").distinct()
        after = cut(after.distinct().join(asking, ["ar", "ao"], "left_semi").join(seen, ["ar", "ao", "goal", "on"], "left_anti"))
        spent = visits.where(F.col("n") >= most_goals).select("ar", "ao")
        over = cut(after.select("ar", "ao").distinct().join(spent, ["ar", "ao"], "left_semi"))
        exhausted = over if exhausted is None else exhausted.unionByName(over)
        goals = after.join(over, ["ar", "ao"], "left_anti")
        if goals.isEmpty():
            break
        seen = cut(seen.unionByName(goals))
    out = _spread(asked, granted, ["who", "ar", "ao"], ["rid"], "left", large=True)
    out = _spread(out, exhausted.withColumn("spent", F.lit(True)), ["ar", "ao"], ["rid"], "left")
    outcome = F.when(F.col("hops").isNotNull(), "granted").when(F.col("spent"), "exhausted").otherwise("denied")
    return out.select("rid", outcome.alias("outcome"), "hops")


def hidden(schema: Schema, bindings: Iterable[Mapping], views: Iterable[Mapping], matched: Iterable[tuple[str, str]]) -> set[str]:
    """The attributes that a reader with these matched (relation, object) may not see, for Db.hiding().

    bindings: relation, object (type:* for any), view or unfiltered; an exact object goes before the wildcard. views:
    name, filter_type (attribute-allowlist or attribute-denylist), attributes. What several views show is intersected;
    an unfiltered binding shows all; a match without a binding changes nothing.
    """
    bound = {(b["relation"], b["object"]): b for b in bindings}
    named = {v["name"]: v for v in views}
    out: set[str] = set()
    for relation, object_ in matched:
        b = bound.get((relation, object_)) or bound.get((relation, f"{object_.partition(':')[0]}:*"))
        if b and b.get("unfiltered"):
            return set()
        view = named.get(b["view"]) if b and b.get("view") else None
        if view:
            listed = {x.lstrip(":") for x in view["attributes"]}
            out |= listed if view["filter_type"] == "attribute-denylist" else set(schema.attributes) - listed
    return out
