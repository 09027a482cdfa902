"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Sizes: words of each document, summed by source and by block. A block is what shares the leading bits of
   a keyed hash of the row, so blocks are disjoint random parts of a source, of about BLOCK_WORDS words, or
   more where there would be over MOST_BLOCKS of them.
2. Targets: sources by code point, null last, weigh 5, 2, 1, repeating; they share 150 % of all words. Shares
   over 2 times a source's size stop there and the excess goes to the others by weight.
3. Quotas: a source gives its blocks in order of their number, twice over if need be, until its target is
   met. Of the block in which it is met, rows in hash order are taken whole while they fit, then again.
4. Splitting tree: the quotas, as counts of blocks by source, are split in two by a multivariate-
   hypergeometric draw, one half for each half of the output shards, and so on down to single shards. Sources
   are dealt to groups; the tree first splits the groups' quotas, and then, within each group on its own, the
   sources' quotas between the shards as the group's split says, which is the same law. Each shard
   draws its number of a source's blocks, in an order permuted by the seed, so no block copy goes to two
   shards; rows are then shuffled within the shard by a keyed hash.

All draws come from keyed hashes and seeded generators: reruns agree. One task handles one row for each source
(targets) or for each group (the top of the tree); documents, blocks, hot sources and the tree below the
groups stay distributed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import OWN, Tables, with_row_id

#: Fixed values of the mix.
WEIGHTS, SHARE, REPEATS = (5.0, 2.0, 1.0), 1.5, 2
SEED, SHARDS, BLOCK_WORDS = 42, 64, 1 << 15
#: Blocks of one source, and of all, at most; beyond, blocks are larger. The generator takes populations below 10 ** 9.
MOST_BITS, MOST_BLOCKS = 16, 1 << 28
#: Groups of sources in the tree.
GROUPS = 256
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame) -> DataFrame:
    """sources(source, source_size) with target: each one's share, never over REPEATS times its size.

    The shares are w * x with one x for all that stay below their limit. Ordered by limit / weight, those at
    their limit come first; what is left over the weight of the rest rises with each of them and falls after the
    last, so x is its maximum.
    """
    # one row a source; the order of all sources defines the weights, so a single window is meant
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    limit = F.col("source_size") * float(REPEATS)
    by_ratio = Window.partitionBy(F.lit(0)).orderBy(F.col("limit") / F.col("weight"), "weight", F.col("source").isNull(), "source")
    every = Window.partitionBy(F.lit(0))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) * F.lit(SHARE) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    heavy = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    out = sources.withColumn("weight", weight).withColumn("limit", limit).withColumn("level", left / heavy)
    out = out.withColumn("level", F.max("level").over(every))
    return out.select("source", "source_size", F.least(F.col("level") * F.col("weight"), F.col("limit")).alias("target"))


def split(quotas: np.ndarray, sizes: np.ndarray, seed: list[int]) -> np.ndarray:
    """How many of each row's quota go to each of the shards, by the tree: an array of rows by shards with those sums.

    sizes: blocks for each shard, of the same total.
    """
    out = np.zeros((len(quotas), len(sizes)), np.int64)
    todo = [(0, len(sizes), quotas.astype(np.int64))]
    while todo:
        left, right, counts = todo.pop()
        if right - left == 1:
            out[:, left] = counts
            continue
        mid = (left + right) // 2
        draws, rest, need = np.zeros_like(counts), int(counts.sum()), int(sizes[left:mid].sum())
        rng = np.random.Generator(np.random.Philox(np.random.SeedSequence([*seed, left, right])))
        for i, n in enumerate(counts.tolist()):  # one hypergeometric draw a row, given those before
            rest -= n
            draws[i] = int(rng.hypergeometric(n, rest, need)) if n and need else 0
            need -= int(draws[i])
        todo += [(left, mid, draws), (mid, right, counts - draws)]
    return out


def even(total: int, shards: int) -> np.ndarray:
    """total in shards parts, equal but for rounding."""
    at = np.arange(shards + 1, dtype=np.int64)
    return np.diff(at * (total // shards) + at * (total % shards) // shards)


def plan(rows: DataFrame, tables: Tables, shards: int = SHARDS, seed: int = SEED, block_words: int = BLOCK_WORDS) -> DataFrame:
    """rows(rid, doc_id, source, size, h) with source_size, target, taken and draws.

    h is a hash that is the row's own (see sized()). draws: structs (copy, shard, at) of the shards that get
    the row; a shard is read in the order of at. Rows of size 0 are never drawn.
    """
    source = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    # as many blocks as keep them near block_words, in powers of two up to 2 ** MOST_BITS a source
    words = F.greatest(F.lit(float(block_words)), F.sum("source_size").over(Window.partitionBy(F.lit(0))) / float(MOST_BLOCKS))
    bits = F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("source_size") / words))).cast("int")
    source = tables.written(source.select(F.col("source").alias("of"), "source_size", "target", F.least(bits, F.lit(MOST_BITS)).alias("bits"), F.round("target").cast("long").alias("want")), "targets")
    number = F.when(F.col("bits") > 0, F.expr("shiftrightunsigned(h, 64 - bits)")).otherwise(F.lit(0))
    blocked = rows.join(source, F.col("source").eqNullSafe(F.col("of"))).withColumn("block", number).drop("of", "bits")
    of_block = (F.sum("size").alias("words"), F.first("source_size").alias("source_size"), F.first("want").alias("want"))
    blocks = blocked.groupBy("source", "block").agg(*of_block).where("words > 0")
    so_far = F.sum("words").over(Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    copies = F.explode(F.sequence(F.lit(0), F.lit(REPEATS - 1)))
    drawn = blocks.withColumn("before", F.coalesce(so_far, F.lit(0))).withColumn("copy", copies)
    drawn = drawn.withColumn("before", F.col("before") + F.col("copy") * F.col("source_size")).where("before < want")
    room = F.when(F.col("before") + F.col("words") > F.col("want"), F.col("want") - F.col("before"))
    # the order in which the shards draw a source's blocks
    turn = F.row_number().over(Window.partitionBy("source").orderBy(F.xxhash64("copy", "block", F.lit(seed)), "copy", "block")) - 1
    drawn = tables.written(drawn.select("source", "block", "copy", room.alias("room"), turn.cast("long").alias("turn")), "drawn")
    leaves = _leaves(drawn.groupBy("source").agg(F.count("*").alias("quota")), shards, seed)
    at = leaves.select(F.col("source").alias("of"), "shard", F.explode(F.expr("sequence(first, first + n - 1)")).alias("place"))
    placed = drawn.join(at, F.col("source").eqNullSafe(F.col("of")) & (F.col("turn") == F.col("place")))
    turns = F.sort_array(F.collect_list(F.struct("copy", "shard", "room"))).alias("turns")  # REPEATS at most
    part = placed.groupBy(F.col("source").alias("of"), F.col("block").alias("nr")).agg(turns)
    both = blocked.join(part, F.col("source").eqNullSafe(F.col("of")) & (F.col("block") == F.col("nr")), "left").drop("of", "nr", "want")
    both = both.withColumn("turns", F.coalesce("turns", F.array().cast("array<struct<copy:int,shard:int,room:bigint>>")))
    ends = F.exists("turns", lambda t: t["room"].isNotNull())
    # only the block in which a source's target ends needs an order: its rows, while they fit
    end = F.filter("turns", lambda t: t["room"].isNotNull())[0]
    last = both.where(ends).select("source", "rid", "size", "h", end["room"].alias("room"), (F.lit(REPEATS) - end["copy"]).alias("most"))
    kind = dict(rows.dtypes)
    fits = last.groupBy("source").applyInArrow(_fitting, f"rid {kind['rid']}, fits int")
    out = both.where(~ends).withColumn("fits", F.lit(1)).unionByName(both.where(ends).join(fits, "rid"))
    times = lambda t: F.when(F.col("size") == 0, 0).when(t["room"].isNull(), 1).otherwise(F.col("fits"))
    copy = lambda t, k: F.struct((t["copy"] + k).alias("copy"), t["shard"].alias("shard"), F.xxhash64("h", t["copy"] + k, F.lit(seed)).alias("at"))
    draws = F.flatten(F.transform("turns", lambda t: F.filter(F.array(*[copy(t, k) for k in range(REPEATS)]), lambda _, k: k < times(t))))
    out = out.withColumn("draws", draws)
    return out.select("rid", "doc_id", "source", "size", "source_size", "target", (F.col("size") * F.size("draws")).alias("taken"), "draws")


def _fitting(rows: pa.Table) -> pa.Table:
    """How often each row of one block, in the order of h, fits in its room whole, one after another, most times at most."""
    size, left, most = rows["size"].to_numpy(), rows["room"][0].as_py(), rows["most"][0].as_py()
    fits, order = np.zeros(len(size), np.int32), np.lexsort((size, rows["h"].to_numpy())).tolist()
    for _ in range(most):
        for i in order:
            if size[i] <= left:
                fits[i] += 1
                left -= int(size[i])
    return pa.table({"rid": rows["rid"], "fits": fits})


def sized(docs: DataFrame, rid: Column, seed: int = SEED) -> DataFrame:
    """What plan() needs of docs(doc_id, text, source). Null texts have size 0, null sources are one source, repeated rows count each."""
    return docs.select(rid.alias("rid"), "doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("doc_id", "text", F.lit(seed)).alias("h"))


def mix_plan(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, block_words: int = BLOCK_WORDS) -> DataFrame:
    """plan() for docs(doc_id, text, source), with shards: copy:shard of each draw, comma-joined.

    Null and empty texts have size 0 and are never taken; null sources are one source; repeated rows count each;
    ties of the hash are taken alike in any order; an empty table gives an empty plan; other columns don't matter,
    whatever their names. One row a document is kept in the shared folder until released().
    """
    with Tables(docs.sparkSession) as tables:
        marked = with_row_id(docs.select("doc_id", "text", "source"), tables, "rid")
        out = plan(tables.written(sized(marked, F.col("rid"), seed), "sizes"), tables, shards, seed, block_words)
        listed = F.array_join(F.transform("draws", lambda d: F.concat_ws(":", d["copy"].cast("string"), d["shard"].cast("string"))), ",")
        return tables.result(tables.keep(out.withColumn("shards", listed), "plan"))


def mixed(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mix itself: docs' columns for each draw, whole, with mix_copy, mix_shard and mix_words; a partition holds whole shards, shuffled.

    Null and empty texts are never drawn; columns of the three names in docs are replaced, others pass; an empty
    table gives none; of tied and repeated rows each is drawn as itself.
    """
    rid, draw = f"{OWN}rid", f"{OWN}draw"
    with Tables(docs.sparkSession) as tables:
        marked = with_row_id(docs.drop("mix_copy", "mix_shard", "mix_words"), tables)
        draws = plan(tables.written(sized(marked, F.col(rid), seed), "sizes"), tables, shards, seed, block_words)
        draws = tables.keep(draws.where(F.size("draws") > 0).select(F.col("rid").alias(rid), F.col("size").alias(f"{OWN}size"), F.explode("draws").alias(draw)), "draws")
        each = marked.join(draws, rid)
        each = each.withColumns({"mix_copy": F.col(f"{draw}.copy"), "mix_shard": F.col(f"{draw}.shard"), "mix_words": F.col(f"{OWN}size")})
        dealt = each.repartition("mix_shard").sortWithinPartitions("mix_shard", f"{draw}.at")
        return tables.result(dealt.select(*[c for c in marked.columns if c != rid], "mix_copy", "mix_shard", "mix_words"))


def _leaves(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(source, shard, first, n) of the splitting tree over quotas(source, quota): one row a source and shard with blocks."""

    def top(table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values("group").reset_index(drop=True)
        counts = split(table["quota"].to_numpy(), even(int(table["quota"].sum()), shards), [seed])
        return pd.DataFrame({"group": table["group"], "counts": list(counts)})

    def below(key: tuple, table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values("source", na_position="last", kind="stable").reset_index(drop=True)
        counts = split(table["quota"].to_numpy(), np.asarray(table["counts"].iloc[0], np.int64), [seed, 1 + int(key[0])])
        row, shard = np.nonzero(counts)
        first = (np.cumsum(counts, axis=1) - counts)[row, shard]
        return pd.DataFrame({"source": table["source"].iloc[row].to_numpy(), "shard": shard.astype(np.int32), "first": first, "n": counts[row, shard]})

    grouped = quotas.withColumn("group", F.pmod(F.xxhash64("source", F.lit(seed)), F.lit(GROUPS)).cast("int"))
    sums = grouped.groupBy("group").agg(F.sum("quota").alias("quota")).withColumn("all", F.lit(0))
    sums = sums.groupBy("all").applyInPandas(top, "group int, counts array<long>")  # GROUPS rows at most
    return grouped.join(F.broadcast(sums), "group").groupBy("group").applyInPandas(below, "source string, shard int, first long, n long")
