"""Token counts as an exact length histogram.

Documents are aggregated by encoded length, so what follows depends on the number of different lengths only.
Suffix sums over the lengths, in blocks so that no task holds all of them, answer for every context limit
how many documents fit, how many tokens there are, how many are left when texts are cut at the limit, and
which quantile the limit is.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .shared import Tables

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that cuts texts before byte pairs are merged, as this vocabulary was made with.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Lengths to a block of the prefix sums.
BLOCK = 512
_loaded: dict = {}


def encoding(path: str, pattern: str = PATTERN):
    if (path, pattern) not in _loaded:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _loaded[path, pattern] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path, pattern]


def lengths(path: str = VOCABULARY, pattern: str = PATTERN) -> Column:
    """A function of a text column: its tokens under the vocabulary file at path, which every executor has. Null: 0."""

    @F.arrow_udf(LongType())
    def count(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = encoding(path, pattern)
        for texts in parts:
            yield pa.array([len(coder.encode_ordinary(t.as_py())) if t.is_valid else 0 for t in texts], pa.int64())

    return count


def histogram(docs: DataFrame, path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(n_tokens, docs) of docs(text): null and empty texts have length 0, repeated rows count each."""
    return docs.select(lengths(path, pattern)("text").alias("n_tokens")).groupBy("n_tokens").agg(F.count("*").alias("docs"))


def limits(hist: DataFrame) -> DataFrame:
    """hist(n_tokens, docs), a written table, with, for the limit n_tokens: docs_within, tokens_within, docs_total, tokens_total, tokens_cut and quantile.

    tokens_cut is the total when longer texts are cut at the limit; quantile is the share of documents that fit.
    Between two lengths of the histogram, docs_within and tokens_within are those of the lower one.
    """
    rows = hist.withColumn("block", F.floor(F.col("n_tokens") / BLOCK)).withColumn("tokens", F.col("n_tokens") * F.col("docs"))
    blocks = rows.groupBy("block").agg(F.sum("docs").alias("bd"), F.sum("tokens").alias("bt"))
    # one row for BLOCK different lengths: as many as the longest text has blocks, whatever the corpus
    after, every = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(F.lit(0))
    zero = lambda c: F.coalesce(c, F.lit(0))
    sums = blocks.select("block", zero(F.sum("bd").over(after)).alias("sd"), zero(F.sum("bt").over(after)).alias("st"), F.sum("bd").over(every).alias("docs_total"), F.sum("bt").over(every).alias("tokens_total"))
    longer = Window.partitionBy("block").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    out = rows.join(sums, "block").withColumn("docs_over", F.col("sd") + zero(F.sum("docs").over(longer))).withColumn("tokens_over", F.col("st") + zero(F.sum("tokens").over(longer)))
    out = out.withColumn("docs_within", F.col("docs_total") - F.col("docs_over")).withColumn("tokens_within", F.col("tokens_total") - F.col("tokens_over"))
    cut = F.col("tokens_within") + F.col("n_tokens") * F.col("docs_over")
    return out.select("n_tokens", "docs", "docs_within", "tokens_within", "docs_total", "tokens_total", cut.alias("tokens_cut"), (F.col("docs_within") / F.col("docs_total")).alias("quantile"))


def token_counts(docs: DataFrame, path: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """limits() of the histogram of docs(text), which is made in one pass and kept in the shared folder until released().

    Null and empty texts have no tokens and count as documents; repeated rows count each; an empty table gives no
    rows; other columns don't matter.
    """
    with Tables(docs.sparkSession) as tables:
        return tables.result(limits(tables.keep(histogram(docs, path, pattern), "histogram")))


def quantile(table: DataFrame, q: float) -> int | None:
    """The least length that a share q of the documents of token_counts() doesn't exceed."""
    return table.where(F.col("docs_within") >= F.ceil(F.lit(q) * F.col("docs_total"))).agg(F.min("n_tokens")).first()[0]
