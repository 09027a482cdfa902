"""Secret scans, in DataFrame operations only: patterns, and character Markov models of random strings.

Two first-order models of characters are trained from labelled samples: random strings (the values that the
patterns find) and ordinary identifiers (words of texts without any). A run of token characters outside the
patterns' spans whose log-likelihood ratio, random against ordinary, is over a threshold is a secret too, or else the
stretch of it that has the largest ratio, if that is over the threshold.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import OWN

#: The patterns and their order.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "markov")
LEAST_VALUE = 6
#: What the models judge, and what they learn as ordinary: whole words that are too short to be judged, and of all words the parts in
#: letters of one case, so that secrets which no pattern finds teach them little.
RUN = r"[A-Za-z0-9+/_=-]{12,}"
ORDINARY = (r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{4,11}(?![A-Za-z0-9+/_=-])", r"[+/_=-]?[A-Z]?[a-z]{3,}[+/_=-]?")
#: Rows of either label that the models are trained on at most (by hash of the id).
ROWS = 20_000
#: Nats a character pair, and in all, that make a secret; added to each count; the share of the random model that is uniform over RUN's characters.
LEAST_MEAN, LEAST_TOTAL, ALPHA, UNIFORM = 0.5, 15.0, 0.05, 0.2
CODES, ALPHABET = 128, 67
SPAN = "array<struct<start:int,rank:int,end:int,value:string>>"
MARK = "[SECRET]"
#: Entries to a block of a running sum.
BLOCK = 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, also where body uses it within the functions of arrays."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(x: Column, op: Callable[[Column, Column], Column]) -> Column:
    """For each entry of an int array what op makes of 0 and all entries before it, in blocks: about BLOCK / 2 steps an entry."""
    fold = lambda part: F.aggregate(part, F.lit(0), op)

    def of(x: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / BLOCK).cast("int")), lambda b: fold(F.slice(x, b * BLOCK + 1, F.lit(BLOCK))))
        heads = let(blocks, lambda s: F.transform(s, lambda _, b: fold(F.slice(s, F.lit(1), b))))
        return let(heads, lambda h: F.transform(x, lambda _, i: op(F.get(h, F.floor(i / BLOCK).cast("int")), fold(F.slice(x, i - i % BLOCK + 1, i % BLOCK)))))

    return let(x, lambda x: F.when(F.size(x) > 0, of(x)).otherwise(F.array().cast("array<int>")))


def _spans(text: Column, pattern: str, rank: int) -> Column:
    """Where the pattern's matches in text lie: array of (start, rank, end, value). Code points, end exclusive."""

    def of(found: Column) -> Column:
        def at(pieces: Column) -> Column:
            steps = F.zip_with(F.slice(pieces, F.lit(1), F.size(found)), found, lambda p, m: F.char_length(p) + F.char_length(m))

            def span(before: Column) -> Column:
                start = lambda i: F.get(before, i) + F.char_length(F.get(pieces, i))
                return F.transform(found, lambda m, i: F.struct(start(i).alias("start"), F.lit(rank).alias("rank"), (start(i) + F.char_length(m)).alias("end"), m.alias("value")))

            return let(running(steps, lambda a, b: a + b), span)

        return F.when(F.size(found) > 0, let(F.split(text, pattern, -1), at)).otherwise(F.array().cast(SPAN))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), of)


def with_base(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with __fl_t, the text or "", and __fl_base, the patterns' spans (see SPAN; rank is the place in KINDS), by start and kind."""
    t = F.coalesce(F.col(text), F.lit(""))
    parts = [_spans(t, p, k) for k, p in enumerate((ASSIGN, ACCESS, HEX))]
    parts[0] = F.filter(parts[0], lambda s: F.char_length(F.regexp_extract(s["value"], ASSIGN, 2)) >= LEAST_VALUE)
    return docs.withColumns({f"{OWN}t": t, f"{OWN}base": F.sort_array(F.concat(*parts))})


def _pairs(value: Column) -> Column:
    """The character pairs of a string, as codes a * CODES + b; other characters count as one."""
    codes = F.transform(F.split(value, ""), lambda c: F.least(F.ascii(c), F.lit(CODES - 1)))
    pairs = let(codes, lambda c: F.zip_with(F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c) - 1), lambda a, b: a * CODES + b))
    return F.when(F.char_length(value) > 1, pairs).otherwise(F.array().cast("array<int>"))


def train(samples: DataFrame) -> list[float] | None:
    """The log-likelihood ratio of each character pair, from samples(value, secret): strings with a boolean label.

    The random model is a mixture of what was learned and the uniform one, which is all of it where no sample is
    secret; without ordinary samples there is no model (None). The result has CODES ** 2 numbers, whatever the samples.
    """
    pairs = samples.where("value is not null").select("secret", F.explode(_pairs(F.col("value"))).alias("pair")).groupBy("secret", "pair").agg(F.count("*").alias("n"))
    tables = {True: [0] * CODES**2, False: [0] * CODES**2}
    for r in pairs.where("secret is not null").collect():  # 2 * CODES ** 2 rows at most
        tables[r["secret"]][r["pair"]] += r["n"]
    if not any(tables[False]):
        return None
    learned = any(tables[True])

    def ratio(a: int, b: int) -> float:
        of = lambda label: (tables[label][a * CODES + b] + ALPHA) / (totals[label][a] + ALPHA * CODES)
        random = UNIFORM / ALPHABET + (1 - UNIFORM) * of(True) if learned else 1 / ALPHABET
        return round(math.log(random / of(False)), 6)

    totals = {label: [sum(t[a * CODES : (a + 1) * CODES]) for a in range(CODES)] for label, t in tables.items()}
    return [ratio(a, b) for a in range(CODES) for b in range(CODES)]


def labelled(docs: DataFrame, rows: int = ROWS) -> DataFrame:
    """Samples for train() from docs(doc_id, text), by hash of the id: values of base spans are secret, words of texts without any are not.

    Of the texts in which a pattern may match about rows are read, however rare they are, and of all texts as many.
    """
    docs = docs.select("doc_id", "text")
    maybe = F.coalesce(F.col("text").rlike("|".join((ASSIGN, ACCESS, HEX))), F.lit(False))
    total, some = docs.agg(F.count("*"), F.count_if(maybe)).first()
    part = lambda n: F.pmod(F.xxhash64("doc_id", F.lit(8)), F.lit(1 << 20)) < min(1.0, rows / max(1, n)) * (1 << 20)
    found = with_base(docs.where(part(some) & maybe).select("text"))
    inner = F.transform(f"{OWN}base", lambda s: F.when(s["rank"] == 0, F.regexp_extract(s["value"], ASSIGN, 2)).otherwise(s["value"]))
    secret = found.select(F.explode(inner).alias("value"), F.lit(True).alias("secret"))
    words = F.concat(*[F.regexp_extract_all("text", F.lit(x), F.lit(0)) for x in ORDINARY])
    plain = docs.where(part(total) & ~maybe).select(F.explode(words).alias("value"), F.lit(False).alias("secret"))
    return secret.unionByName(plain)


def _gaps(base: Column, text: Column) -> Column:
    """The stretches outside base spans, in order: array of (at, part)."""
    ends = F.concat(F.transform(base, lambda b: b["end"]), F.array(F.lit(0)))

    def of(reach: Column) -> Column:
        to = lambda i: F.coalesce(F.get(base, i)["start"], F.char_length(text))
        all_ = F.transform(reach, lambda r, i: F.struct(r.alias("at"), F.substring(text, r + 1, F.greatest(F.lit(0), to(i) - r)).alias("part")))
        return F.filter(all_, lambda g: F.char_length(g["part"]) > 0)

    whole = F.array(F.struct(F.lit(0).alias("at"), text.alias("part")))
    return F.when(F.size(base) > 0, let(running(ends, lambda a, b: F.greatest(a, b)), of)).otherwise(whole)


def _judged(run: Column, table: Column) -> Column:
    """A run's span, or its stretch of the largest ratio, with whether it is a secret: (from, to, secret), to exclusive."""
    score = lambda p: F.get(table, p) - LEAST_MEAN
    zero = F.struct(*[F.lit(x).alias(n) for n, x in (("i", 0), ("sum", 0.0), ("now", 0.0), ("since", 0), ("best", 0.0), ("lo", 0), ("hi", 0))])

    def step(s: Column, p: Column) -> Column:
        fresh = s["now"] <= 0
        now = F.when(fresh, score(p)).otherwise(s["now"] + score(p))
        since = F.when(fresh, s["i"]).otherwise(s["since"])
        return let(F.struct(now.alias("now"), since.alias("since"), score(p).alias("x")), lambda v: F.struct(
            (s["i"] + 1).alias("i"), (s["sum"] + v["x"]).alias("sum"), v["now"].alias("now"), v["since"].alias("since"), F.greatest(s["best"], v["now"]).alias("best"),
            F.when(v["now"] > s["best"], v["since"]).otherwise(s["lo"]).alias("lo"), F.when(v["now"] > s["best"], s["i"] + 1).otherwise(s["hi"]).alias("hi")))

    def verdict(s: Column) -> Column:
        whole = (s["sum"] >= 0) & (s["sum"] + s["i"] * LEAST_MEAN >= LEAST_TOTAL)
        part = s["best"] + (s["hi"] - s["lo"]) * LEAST_MEAN >= LEAST_TOTAL
        return F.struct(F.when(whole, F.lit(0)).otherwise(s["lo"]).alias("from"), (F.when(whole, s["i"]).otherwise(s["hi"]) + 1).alias("to"), (whole | part).alias("secret"))

    return let(F.aggregate(_pairs(run), zero, step), verdict)


def with_spans(docs: DataFrame, model: list[float] | None) -> DataFrame:
    """with_base() and __fl_spans: the base spans with those that the model adds, by start and kind. Added spans never overlap base ones."""
    out = with_base(docs)
    if model is None:
        return out.withColumn(f"{OWN}spans", F.col(f"{OWN}base"))
    table = F.split(F.lit(",".join(map(str, model))), ",").cast("array<double>")  # folded to one literal
    rank = len(KINDS) - 1

    def added(gap: Column) -> Column:
        judged = F.transform(_spans(gap["part"], RUN, rank), lambda r: F.struct(r.alias("r"), _judged(r["value"], table).alias("j")))
        secret = F.filter(judged, lambda x: x["j"]["secret"])
        return F.transform(secret, lambda x: F.struct((gap["at"] + x["r"]["start"] + x["j"]["from"]).alias("start"), F.lit(rank).alias("rank"), (gap["at"] + x["r"]["start"] + x["j"]["to"]).alias("end"), F.lit("").alias("value")))

    base, t = F.col(f"{OWN}base"), F.col(f"{OWN}t")
    more = F.flatten(F.transform(_gaps(base, t), added))
    return out.withColumn(f"{OWN}spans", F.sort_array(F.concat(base, more.cast(SPAN))))


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scanned(docs: DataFrame, rows: int = ROWS) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans for each row of docs(doc_id, text), without a shuffle.

    Null and empty texts have no spans; spans that begin alike stand in the order of KINDS; repeated rows get equal
    answers; an empty table gives none; other columns don't matter, whatever their names.
    """
    docs = docs.select("doc_id", "text")
    out = with_spans(docs, train(labelled(docs, rows)))
    base = F.col(f"{OWN}base")
    n = [F.size(F.filter(base, (lambda k: lambda s: s["rank"] == k)(k))).cast("long").alias(f"n_{KINDS[k]}") for k in range(3)]
    return out.select("doc_id", *n, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col(f"{OWN}spans")).alias("spans"))


def redacted(docs: DataFrame, rows: int = ROWS) -> DataFrame:
    """docs with MARK in place of each secret (overlapping ones share it), n_chars to match where docs has it; other columns as they came.

    Null texts stay null and texts without secrets as they are; repeated rows get equal texts; an empty table stays
    empty; columns of any name pass.
    """
    out = with_spans(docs, train(labelled(docs, rows)))
    t, spans = F.col(f"{OWN}t"), F.col(f"{OWN}spans")
    ends = F.concat(F.transform(spans, lambda s: s["end"]), F.array(F.lit(0)))

    def of(reach: Column) -> Column:
        # a span that starts before the end of those so far adds nothing but, maybe, its own end
        start = lambda i: F.coalesce(F.get(spans, i)["start"], F.char_length(t))
        mark = lambda i: F.when(i < F.size(spans), F.lit(MARK)).otherwise(F.lit(""))
        return F.array_join(F.transform(reach, lambda r, i: F.when((start(i) >= r) | (i == F.size(spans)), F.concat(F.substring(t, r + 1, F.greatest(F.lit(0), start(i) - r)), mark(i))).otherwise(F.lit(""))), "")

    new = F.when(F.size(spans) > 0, let(running(ends, lambda a, b: F.greatest(a, b)), of)).otherwise(F.col("text"))
    out = out.withColumn(f"{OWN}new", new)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size(spans) > 0, F.char_length(f"{OWN}new").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars")))
    return out.withColumn("text", F.col(f"{OWN}new")).select(*docs.columns)
