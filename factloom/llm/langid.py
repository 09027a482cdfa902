"""Language identification by prediction by partial matching (PPM).

Each language has a context tree of bytes: how often each byte followed each context of up to ORDER bytes in
the training texts. The statistics are frozen; a byte costs -log2 p bits, where p comes from the longest
context that has been seen: n / (total + kinds) for a byte seen there n times, and else the escape
probability kinds / (total + kinds) (method C) times p in the next shorter context, down to 1 / 256. The
language with the shortest exact code length for the whole text is predicted.

The trees are laid out as tables of the runs of bytes that occur, for each length of context, with what they cost
in every language. A byte is looked up in the longest context, and goes down a length, at the price of the
escape, while no language knows it there. So a model takes what the distinct runs take, however much is learned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import OWN

#: Bytes of context.
ORDER = 3
UNKNOWN = "und"
#: What accepted() lets a text cost: so many times the median bits a byte of its language's held-out texts, and so many bits besides, which a
#: short text with a code or two in it may need. Words that the trees haven't seen cost far less than twice what known ones do; other scripts, codes and noise cost more.
TIMES, SPARE_BITS = 2.0, 256.0
#: Costs are rounded up to such a part of a bit before their median is taken.
PART = 1024
#: Bytes of a text that are scored at a time, and that are counted at a time; distinct runs that a counting task holds before it passes them on.
CHUNK, HELD = 1 << 18, 1 << 20


class Numbers:
    """A sorted array of numbers without repeats, with a hash table of their places that is half full at most."""

    def __init__(self, known: np.ndarray):
        self.known, self.bits = known, max(4, (2 * len(known)).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        left, at = np.arange(len(known), dtype=np.int32), self._first(known)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            open_ = self.slots[at] != left
            left, at = left[open_], self._next(at[open_])

    def _first(self, x: np.ndarray) -> np.ndarray:
        return (x.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).view(np.int64)

    def _next(self, at: np.ndarray) -> np.ndarray:
        return at + 1 & (1 << self.bits) - 1

    def places(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where wanted are, and whether they are there at all."""
        at = self._first(wanted)
        place = self.slots[at]
        there = self.known[place] == wanted  # an empty slot has -1: the last number, which is not wanted there
        open_ = np.flatnonzero(~there & (place >= 0))
        at = at[open_]
        while len(open_):
            at = self._next(at)
            place[open_] = found = self.slots[at]
            there[open_] = hit = self.known[found] == wanted[open_]
            more = ~hit & (found >= 0)
            open_, at = open_[more], at[more]
        return place, there


@dataclass
class Level:
    """runs (a context and the next byte) and contexts of one length, by number; cost, escape: their bits by language."""

    runs: Numbers
    cost: np.ndarray
    contexts: Numbers
    escape: np.ndarray


@dataclass
class Model:
    """langs: names; code: a number below size for each byte; levels: by length of context, from 0."""

    langs: list[str]
    code: np.ndarray
    size: int
    levels: list[Level]

    def lengths(self, text: bytes) -> np.ndarray:
        """The exact code length of text in bits, for each language."""
        total = np.zeros(len(self.langs))
        for at in range(0, len(text), CHUNK):
            part = self.code[np.frombuffer(text, np.uint8, min(CHUNK, len(text) - at) + min(at, ORDER), max(0, at - ORDER))]
            part = np.concatenate([np.zeros(ORDER - min(at, ORDER), part.dtype), part])
            run = part[:-ORDER].astype(np.int64)
            for k in range(1, ORDER + 1):
                run = run * self.size + part[k : len(part) - ORDER + k]
            for k in range(ORDER, -1, -1):
                level, run = self.levels[k], run % self.size ** (k + 1)
                place, there = level.runs.places(run)
                total += level.cost[place[there]].sum(axis=0, dtype=np.float64)
                run = run[~there]
                if not len(run):
                    break
                place, there = level.contexts.places(run // self.size)
                total += level.escape[place[there]].sum(axis=0, dtype=np.float64)
            total += 8.0 * len(run)  # bytes that were never seen
        return total

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language, and its posterior under equal priors (0 for UNKNOWN)."""
        return self.judge(text)[:2]

    def judge(self, text: str | None) -> tuple[str, float, float, int]:
        """predict(), with the text's bits in that language and its bytes."""
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, 0.0, 0
        data = text.encode("utf-8", "surrogatepass")
        bits = self.lengths(data)
        best = int(bits.argmin())
        return self.langs[best], float(1 / np.exp2(np.maximum(bits[best] - bits, -1000.0)).sum()), float(bits[best]), len(data)


def _grams(texts: list[bytes]) -> np.ndarray:
    """Each byte with its ORDER predecessors as one number, 0 before the start; a byte counts as itself plus one."""
    out = []
    for t in texts:
        b = np.concatenate([np.zeros(ORDER, np.int64), np.frombuffer(t, np.uint8).astype(np.int64) + 1])
        g = b[: len(b) - ORDER]
        for k in range(1, ORDER + 1):
            g = g * 257 + b[k : len(b) - ORDER + k]
        out.append(g)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _chunks(texts: Iterator[bytes]) -> Iterator[np.ndarray]:
    """_grams() of texts, of about CHUNK bytes at a time; longer texts in pieces."""
    some, size = [], 0
    for t in texts:
        if len(t) > CHUNK:
            for at in range(0, len(t), CHUNK):
                yield _grams([t[max(0, at - ORDER) : at + CHUNK]])[min(at, ORDER) :]
            continue
        some.append(t)
        size += len(t)
        if size > CHUNK:
            yield _grams(some)
            some, size = [], 0
    yield _grams(some)


def _summed(gram: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct grams with the sums of their n."""
    order = np.argsort(gram, kind="stable")
    gram, n = gram[order], n[order]
    first = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]])
    return gram[first], np.add.reduceat(n, first)


def counts(labelled: DataFrame) -> DataFrame:
    """(lang, gram, n): how often each run of ORDER + 1 bytes occurs in labelled(text, lang), by language; null texts have none."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def passed_on() -> Iterator[pa.RecordBatch]:
            for lang, (gram, n) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram), pa.array(n)], ["lang", "gram", "n"])
            held.clear()

        for batch in batches:
            where: dict[str, list[int]] = {}
            for i, lang in enumerate(batch.column(1).to_pylist()):
                where.setdefault(lang, []).append(i)
            for lang, rows in where.items():
                for grams in _chunks((batch.column(0)[i].as_py() or "").encode("utf-8", "surrogatepass") for i in rows):
                    if len(grams):
                        gram, n = np.unique(grams, return_counts=True)
                        if lang in held:
                            gram, n = _summed(np.concatenate([held[lang][0], gram]), np.concatenate([held[lang][1], n]))
                        held[lang] = gram, n
                    if sum(len(x) for x, _ in held.values()) > HELD:
                        yield from passed_on()
        yield from passed_on()

    each = labelled.select("text", "lang").mapInArrow(count, "lang string, gram long, n long")
    return each.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def build(langs: np.ndarray, grams: np.ndarray, n: np.ndarray) -> Model:
    """The frozen trees of counts()'s columns."""
    names = sorted(set(langs.tolist()))
    number = {name: j for j, name in enumerate(names)}
    lang = np.fromiter(map(number.__getitem__, langs.tolist()), np.int64, len(langs))
    digits = grams[:, None] // 257 ** np.arange(ORDER, -1, -1)[None, :] % 257  # oldest first; the last is the byte itself
    seen = np.unique(digits[digits > 0]) - 1
    size = len(seen) + 2  # 0 is before the start, the last is any byte never seen
    code = np.full(256, size - 1, np.uint16)
    code[seen] = np.arange(1, len(seen) + 1)
    run = np.zeros(len(grams), np.int64)
    for k in range(ORDER + 1):
        run = run * size + np.where(digits[:, k] > 0, code[np.maximum(digits[:, k], 1) - 1], 0)
    levels: list[Level] = []
    p = np.empty((0, len(names)))
    for k in range(ORDER + 1 if names else 0):  # p: of each run with a context of k bytes, by language
        runs, inverse = np.unique(run % size ** (k + 1), return_inverse=True)
        table = np.bincount(inverse * len(names) + lang, weights=n, minlength=len(runs) * len(names)).reshape(len(runs), len(names))
        contexts, first, mine = np.unique(runs // size, return_index=True, return_inverse=True)
        total, kinds = np.add.reduceat(table, first), np.add.reduceat((table > 0).astype(np.int64), first)
        escape = np.where(total > 0, kinds / np.maximum(1, total + kinds), 1.0)
        below = p[np.searchsorted(levels[-1].runs.known, runs % size**k)] if k else 1 / 256
        p = np.where(table > 0, table / np.maximum(1, total + kinds)[mine], escape[mine] * below)
        levels.append(Level(Numbers(runs), (-np.log2(p)).astype(np.float32), Numbers(contexts), (-np.log2(escape)).astype(np.float32)))
    return Model(names, code, size, levels)


def _usable(docs: DataFrame) -> DataFrame:
    """The rows with text and language."""
    return docs.where("text is not null and lang is not null")


def train(labelled: DataFrame) -> Model:
    """A model of all of labelled(text, lang), whole texts. Rows without text or language are left out."""
    table = counts(_usable(labelled)).toArrow()  # the distinct runs, by language
    langs = table["lang"].combine_chunks().dictionary_encode()
    names = np.array(langs.dictionary.to_pylist(), object)
    return build(names[langs.indices.to_numpy()], table["gram"].to_numpy(), table["n"].to_numpy())


def predictor(model: Model, spark) -> Column:
    """A function of a text column: struct (lang_pred, score, bits, bytes)."""
    held = spark.sparkContext.broadcast(model)  # of the size of the distinct runs

    kinds = {"lang_pred": pa.string(), "score": pa.float64(), "bits": pa.float64(), "bytes": pa.int64()}

    @F.arrow_udf("lang_pred string, score double, bits double, bytes long")
    def predict(texts: pa.Array) -> pa.Array:
        found = [held.value.judge(t.as_py()) for t in texts]
        return pa.StructArray.from_arrays([pa.array([x[k] for x in found], kind) for k, kind in enumerate(kinds.values())], list(kinds))

    return predict


def fold() -> Column:
    """crc32 of the id as text, modulo 4; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4))


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score for each row of docs(doc_id, text, lang).

    Null and empty texts, and texts without a letter, are UNKNOWN with score 0, as is everything when no row is
    labelled. Of languages that tie the first by name is taken; repeated rows get equal answers; an empty table
    gives none; other columns don't matter.
    """
    model = train(docs.where(fold() != 2))
    out = docs.select("doc_id", (fold() == 2).alias("held_out"), predictor(model, docs.sparkSession)("text").alias("p"))
    return out.select("doc_id", "held_out", "p.lang_pred", "p.score")


def limits(predict: Column, labelled: DataFrame) -> dict[str, float]:
    """The most bits a byte that a text of each language may cost, by what all labelled texts that the model hasn't seen cost.

    predict: a predictor(). Texts of another language than predicted don't count.
    """
    p = _usable(labelled).select("lang", predict("text").alias("p")).where("p.lang_pred = lang and p.bytes > 0")
    costs = p.groupBy("lang", F.ceil(F.col("p.bits") / F.col("p.bytes") * PART).alias("parts")).agg(F.count("*").alias("n"))
    # one row for each rounded cost, however many texts
    same = Window.partitionBy("lang")
    ranked = costs.select("lang", "parts", F.sum("n").over(same.orderBy("parts")).alias("upto"), F.sum("n").over(same).alias("all"))
    middle = ranked.where("2 * upto >= all").groupBy("lang").agg(F.min("parts").alias("parts"))
    return {r["lang"]: TIMES * r["parts"] / PART for r in middle.collect()}


def accepted(docs: DataFrame) -> DataFrame:
    """docs without the rows that are UNKNOWN or that no learned language explains; columns as they came.

    A text is explained if its code length in the predicted language is within limits(). The trees learn from one
    part of the labelled rows and limits from another; a language without rows in the latter has no limit.
    Null and letterless texts go; repeated rows stay or go together; without any labelled row all go; an empty
    table stays empty; columns of any name pass.
    """
    predict = predictor(train(docs.where(fold().isin(0, 1))), docs.sparkSession)
    most = limits(predict, docs.where(fold() == 3))
    limit = F.element_at(F.create_map(*[F.lit(x) for lang, n in most.items() for x in (lang, n)]), F.col(f"{OWN}p.lang_pred")) if most else F.lit(None)
    fits = limit.isNull() | (F.col(f"{OWN}p.bits") <= limit * F.col(f"{OWN}p.bytes") + SPARE_BITS)
    return docs.withColumn(f"{OWN}p", predict("text")).where((F.col(f"{OWN}p.lang_pred") != UNKNOWN) & fits).select(*docs.columns)
