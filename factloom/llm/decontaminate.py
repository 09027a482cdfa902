"""Benchmark decontamination with a positional inverted index, in DataFrame operations only.

The index holds a posting (document row, term, position) for each occurrence of a test term, that is a word
that some benchmark item has; no other term can matter to a phrase. For each window of an item its two rarest
terms in the corpus are its anchors. Where the postings of both, less their offsets in the item, meet, an
item may lie in a document; there the postings of the other terms, less their offsets, are intersected.
Runs of WINDOW or more consecutive offsets found are exact phrase matches. Where a share is asked for, items of
which so many chunks of CHUNK words have all their words close together, in one place, are proximity matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import OWN, Tables, row_id, with_row_id, without

WINDOW = 10
#: Words to a chunk; how far its words may be from its rarest; the fewest chunks to a proximity match; a share for words changed every eighth or more rarely.
CHUNK, REACH, FEWEST, NEAR = 5, 5, 3, 1 / 3
#: What stands between words; A-Z are lower-cased word by word.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Rows that are broadcast at most; larger tables are joined by a shuffle.
SMALL = 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_az(word: Column) -> Column:
    """A-Z in lower case and nothing else; the quick way where all is ASCII."""
    return F.when(F.octet_length(word) == F.char_length(word), F.lower(word)).otherwise(F.translate(word, _UPPER, _LOWER))


def small(df: DataFrame) -> DataFrame:
    """df, a written table, for broadcast if it has SMALL rows or fewer."""
    return F.broadcast(df) if df.count() <= SMALL else df


def item_terms(items: DataFrame) -> DataFrame:
    """(iid, item_id, n, off, word) for each word of items(item_id, text). Rows without words have none."""
    rows = items.select(row_id().alias("iid"), "item_id", F.filter(F.split(F.coalesce("text", F.lit("")), GAP, -1), lambda w: w != "").alias("w"))
    return rows.select("iid", "item_id", F.size("w").alias("n"), F.posexplode("w").alias("off", "word")).withColumn("word", lower_az(F.col("word")))


def index(docs: DataFrame, terms: DataFrame, tables: Tables) -> DataFrame:
    """Postings (rid, term, pos, doc_id, n_words) of terms(word, term) in docs(doc_id, text), written to the call's tables.

    Each document also has one posting of term 0, which carries doc_id and the number of words. Positions
    count from 0 or 1 in a document, whichever: only their differences matter.
    """
    w = F.split(F.coalesce("text", F.lit("")), GAP, -1)
    rows = docs.select(row_id().alias("rid"), "doc_id", w.alias("w"))
    ends = (F.element_at("w", 1) == "").cast("int") + F.when(F.size("w") > 1, (F.element_at("w", -1) == "").cast("int")).otherwise(0)
    # a blank can't be in a word; it marks the document's own posting
    every = rows.select("rid", "doc_id", (F.size("w") - ends).cast("long").alias("n_words"), F.posexplode(F.concat("w", F.array(F.lit(" ")))).alias("pos", "word"))
    own = F.col("term") == 0
    found = every.withColumn("word", lower_az(F.col("word"))).join(small(terms), "word")
    return tables.written(found.select("rid", "term", "pos", F.when(own, F.col("doc_id")).alias("doc_id"), F.when(own, F.col("n_words")).alias("n_words")), "postings")


def numbered(words: DataFrame, tables: Tables) -> DataFrame:
    """(word, term) for the distinct words of words(word), with term 0 for documents' own postings."""
    distinct = words.select("word").distinct().withColumn("term", row_id() + 1)
    own = words.sparkSession.createDataFrame([(" ", 0)], "word string, term long")
    return tables.written(distinct.unionByName(own), "terms")


def matches(postings: DataFrame, item_words: DataFrame, tables: Tables, window: int = WINDOW) -> DataFrame:
    """(rid, iid, start, end): the maximal runs of document positions that match an item over window words, or over all of a shorter item.

    item_words: iid, n, off, term.
    """
    often = postings.where("term > 0").groupBy("term").agg(F.count("*").alias("df"))
    ranked = tables.written(item_words.join(often, "term", "left"), "ranked")
    ahead = Window.partitionBy("iid").orderBy("off").rowsBetween(0, window - 1)
    width = F.least(F.col("n"), F.lit(window))
    rare = F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "off", "term")).over(ahead))
    windows = ranked.withColumn("rare", rare).where((F.col("off") <= F.col("n") - width) & (F.get("rare", F.lit(0))["df"] > 0))
    both = [F.get("rare", F.lit(k))[c].alias(n) for k, c, n in ((0, "off", "at"), (0, "term", "term"), (1, "off", "at2"), (1, "term", "term2"))]
    anchors = windows.groupBy("iid", *both).agg(F.min("off").alias("lo"), F.max(F.col("off") + width - 1).alias("hi"))
    anchors = tables.written(anchors, "anchors")
    # where both anchors' postings, less their offsets, meet (a window of one word has one); then what the items would have around them
    own = postings.where("term > 0").select("rid", "term", "pos")
    seeds = own.join(small(anchors), "term").withColumn("shift", F.col("pos") - F.col("at"))
    second = own.join(small(tables.written(anchors.select(F.col("term2").alias("term")).distinct(), "seconds")), "term", "left_semi")
    second = second.select("rid", F.col("term").alias("term2"), F.col("pos").alias("pos2"))
    met = seeds.where("term2 is not null").withColumn("pos2", F.col("shift") + F.col("at2")).join(second, ["rid", "term2", "pos2"], "left_semi")
    place = ["rid", "iid", "shift", "lo", "hi"]
    seeds = met.select(*place).unionByName(seeds.where("term2 is null").select(*place)).distinct()
    wanted = seeds.select("rid", "iid", "shift", F.explode(F.sequence("lo", "hi")).alias("off")).distinct()
    wanted = tables.written(wanted.join(small(ranked.select("iid", "off", "term", "n")), ["iid", "off"]).withColumn("pos", F.col("shift") + F.col("off")), "wanted")
    near = tables.written(wanted.select("rid").distinct(), "near")
    there = postings.where("term > 0").select("rid", "term", "pos").join(small(near), "rid", "left_semi")
    found = wanted.join(there, ["rid", "pos", "term"], "left_semi")
    run = F.col("off") - F.row_number().over(Window.partitionBy("rid", "iid", "shift").orderBy("off"))
    runs = found.withColumn("run", run).groupBy("rid", "iid", "shift", "run").agg(F.min("pos").alias("start"), F.max("pos").alias("end"), F.first("n").alias("n"))
    return runs.where(F.col("end") - F.col("start") + 1 >= F.least(F.col("n"), F.lit(window))).select("rid", "iid", "start", "end")


def proximity(postings: DataFrame, queries: DataFrame, within: int) -> DataFrame:
    """(rid, qid, start): the occurrences of a query's rarest term that have all its other terms within so many words.

    queries: qid, term, one row for each term of a query.
    """
    own = postings.where("term > 0").select("rid", "term", "pos")
    often = own.groupBy("term").agg(F.count("*").alias("df"))
    ranked = queries.select("qid", "term").distinct().join(often, "term", "left")
    size = queries.groupBy("qid").agg(F.count_distinct("term").alias("k"))
    rarest = ranked.groupBy("qid").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "term")).alias("low")).join(size, "qid").select("qid", "k", F.col("low.term").alias("term"))
    seeds = own.join(rarest, "term").select("rid", "qid", "k", F.col("pos").alias("start"))
    # positions in blocks of the reach, so that terms meet by equality
    blocks = seeds.withColumn("block", F.explode(F.expr(f"sequence((start - {within}) div {within + 1} - 1, (start + {within}) div {within + 1})")))
    wanted = blocks.join(ranked.select("qid", "term"), "qid")
    near = wanted.join(own.withColumn("block", F.expr(f"pos div {within + 1}")), ["rid", "term", "block"]).where(F.abs(F.col("pos") - F.col("start")) <= within)
    return near.groupBy("rid", "qid", "start", "k").agg(F.count_distinct("term").alias("met")).where("met = k").select("rid", "qid", "start")


def near_items(postings: DataFrame, item_words: DataFrame, share: float) -> DataFrame:
    """(rid, iid): the items of which share of the chunks, FEWEST at least, are met within twice the item's length.

    item_words: iid, n, off, term. Items of fewer than FEWEST chunks have none.
    """
    chunks = item_words.withColumn("chunk", F.expr(f"off div {CHUNK}")).where(f"(chunk + 1) * {CHUNK} <= n and n >= {FEWEST * CHUNK}")
    met = proximity(postings, chunks.select(F.struct("iid", "chunk").alias("qid"), "term"), REACH).select("rid", "qid.*", "start")
    # a place of the item's length is within one of the overlapping blocks of twice that
    placed = met.join(item_words.select("iid", "n").distinct(), "iid").withColumn("block", F.explode(F.expr("array(start div n, start div n - 1)")))
    many = placed.groupBy("rid", "iid", "n", "block").agg(F.count_distinct("chunk").alias("met"))
    return many.where(F.col("met") >= F.greatest(F.lit(FEWEST), F.expr(f"n div {CHUNK}") * F.lit(share))).select("rid", "iid").distinct()


def _results(docs: DataFrame, items: DataFrame, window: int, near: float | None, tables: Tables) -> DataFrame:
    """What contaminated() returns, not yet written."""
    words = tables.written(item_terms(items), "items")
    terms = numbered(words, tables)
    postings = index(docs, terms, tables)
    item_words = words.join(terms, "word").select("iid", "n", "off", "term")
    spans = tables.written(matches(postings, item_words, tables, window), "spans")
    hits = spans.select("rid", F.explode(F.sequence("start", "end")).alias("pos")).distinct().groupBy("rid").agg(F.count("*").alias("n_hit"))
    names = words.select("iid", F.col("item_id").cast("string").alias("item")).distinct()
    which = spans.select("rid", "iid").distinct().join(names, "iid").groupBy("rid").agg(F.array_sort(F.collect_set("item")).alias("which"))
    own = postings.where("term = 0").select("rid", "doc_id", "n_words")
    out = own.join(hits, "rid", "left").join(which, "rid", "left")
    found = F.coalesce("which", F.array().cast("array<string>"))
    hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    more = []
    if near is not None:
        close = near_items(postings, item_words, near).select("rid").distinct().withColumn("close", F.lit(True))
        out, more = out.join(close, "rid", "left"), [F.coalesce("close", F.lit(False)).alias("near_contaminated")]
    return out.select("doc_id", "n_words", hit.alias("n_hit"), F.size(found).cast("long").alias("n_items"), F.sha2(F.array_join(found, ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"), *more)


def contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, near: float | None = None) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated for each row of docs(doc_id, text), against items(item_id, text).

    Null and empty texts have no words; items without words never occur; an item_id of several rows counts once,
    a null item_id hits without being counted; repeated documents each get a row; empty tables of either kind hit
    nothing; other columns don't matter, whatever their names. These are exact phrases only; with near, the share
    of near_items(), the column near_contaminated tells proximity matches. One row a document is kept in the shared
    folder until released(); the postings are deleted.
    """
    with Tables(docs.sparkSession) as tables:
        return tables.result(tables.keep(_results(docs.select("doc_id", "text"), items, window, near, tables), "contaminated"))


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW, near: float | None = None) -> DataFrame:
    """docs without the rows that any item's window occurs in, nor, with near, any proximity match; columns as they came.

    Null and empty texts stay; of repeated rows all stay or none; empty tables of either kind change nothing;
    columns of any name pass.
    """
    rid = f"{OWN}rid"
    with Tables(docs.sparkSession) as tables:
        marked = with_row_id(docs, tables)
        bad = _results(marked.select(F.col(rid).alias("doc_id"), "text"), items, window, near, tables)
        bad = bad.where("contaminated" if near is None else "contaminated or near_contaminated").select(F.col("doc_id").alias(rid))
        return tables.result(without(marked, rid, tables.keep(bad, "bad")).select(*docs.columns))
