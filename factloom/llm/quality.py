"""Quality rules with suffix-array repetition.

The words of a batch of documents are numbered document by document, so no suffix of one document shares a
prefix with one of another, and one suffix array serves the batch: prefix doubling, where after each step
only suffixes that are still tied are sorted again. The ranks of every step are kept; adjacent suffixes
find their longest common prefix (LCP) by descending through them. Each position of an LCP interval of
at least LEAST words starts a maximal repeat; the union of these spans is what repetition covers.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

SYMBOLS, SPACES = "#*$%&|<>", " \t\n\r\x0b\x0c"
#: Words of a repeat that counts, and what a kept text may have: the share of its words that repeats cover (well below the base
#: rules' share of repeated words, so that it tells more than they do), and the words of the longest.
LEAST, MOST_COVERED, LONGEST = 10, 0.1, 100
#: Limits of the base rules: words at least, repeated words in a hundred at most.
MIN_WORDS, MOST_REPEATED = 50, 50
BATCH = 1 << 18
_WORDY = re.compile(r"[^ \t\n\r\x0b\x0c]")


def ranks(keys: np.ndarray) -> list[np.ndarray]:
    """For steps k = 0, 1, ...: the rank of each suffix by its first 2 ** k numbers (equal: same rank), until all differ."""
    n = len(keys)
    order = np.argsort(keys, kind="stable")
    rank = np.empty(n, np.int32)
    fresh = np.r_[True, keys[order[1:]] != keys[order[:-1]]] if n else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(fresh, np.arange(n), 0)) if n else np.zeros(0, np.int64)
    rank[order] = start  # the place of the first of the tied
    levels, width = [rank], 1
    tied = _tied(fresh)
    while len(tied):
        # places of the order that are tied, group by group
        at = order[tied]
        group = rank[at].astype(np.int64)
        nxt = at + width
        second = np.where(nxt < n, rank[np.minimum(nxt, n - 1)], -1).astype(np.int64)
        sub = np.lexsort((second, group))
        order[tied] = at = at[sub]
        group, second = group[sub], second[sub]
        new = np.r_[True, (group[1:] != group[:-1]) | (second[1:] != second[:-1])]
        rank = rank.copy()
        rank[at] = np.maximum.accumulate(np.where(new, tied, 0))
        levels.append(rank)
        tied = tied[_tied(new)]
        width *= 2
    levels.append(order.astype(np.int32))
    return levels


def _tied(fresh: np.ndarray) -> np.ndarray:
    return np.flatnonzero(~(fresh & np.r_[fresh[1:], True])) if len(fresh) else np.zeros(0, np.int64)


def repeats(levels: list[np.ndarray], least: int) -> np.ndarray:
    """For each position the words of the longest repeat that starts there, 0 where it has fewer than least."""
    *levels, order = levels
    n = len(order)
    a, b = order[:-1].astype(np.int64), order[1:].astype(np.int64)
    lcp = np.zeros(max(0, n - 1), np.int64)
    base = 1 << (least.bit_length() - 1)  # a level whose prefixes are no longer than least
    first = levels[min(base.bit_length() - 1, len(levels) - 1)]
    live = np.flatnonzero(first[a] == first[b]) if len(levels) > base.bit_length() - 1 else np.zeros(0, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x, y = a[live] + lcp[live], b[live] + lcp[live]
        ok = (x < n) & (y < n)
        same = ok & (levels[k][np.minimum(x, n - 1)] == levels[k][np.minimum(y, n - 1)])
        lcp[live[same]] += 1 << k
    out = np.zeros(n, np.int64)
    good = np.flatnonzero(lcp >= least)
    np.maximum.at(out, a[good], lcp[good])
    np.maximum.at(out, b[good], lcp[good])
    return out


def covered(starts: np.ndarray) -> np.ndarray:
    """Which positions lie in a span [i, i + starts[i])."""
    reach = np.maximum.accumulate(np.where(starts > 0, np.arange(len(starts)) + starts, 0))
    return reach > np.arange(len(starts))


def measures(texts: list[str | None], least: int = LEAST) -> dict[str, np.ndarray]:
    """A number for each text: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_covered and longest."""
    texts = [t or "" for t in texts]
    words = [t.encode("utf-8", "surrogatepass").split() for t in texts]
    n_words = np.array([len(w) for w in words], np.int64)
    ids = []
    base = 0
    for w in words:
        number = defaultdict(count(base).__next__)
        ids.append(np.fromiter(map(number.__getitem__, w), np.int64, len(w)))
        base += len(number)
    keys = np.concatenate(ids) if ids else np.zeros(0, np.int64)
    n, ends = len(keys), np.cumsum(n_words)
    out = {"n_words": n_words}
    out["word_chars"] = np.array([len(t) - sum(map(t.count, SPACES)) for t in texts], np.int64)
    out["n_symbols"] = np.array([sum(map(t.count, SYMBOLS)) for t in texts], np.int64)
    lines = [[x for x in t.split("\n") if _WORDY.search(x)] for t in texts]
    out["n_dup_lines"] = np.array([len(x) - len(set(x)) for x in lines], np.int64)
    levels = ranks(keys)
    hit = np.zeros(n + 3, bool)
    if n >= 3:  # windows of three words: two words' rank, and the third
        two = levels[min(1, len(levels) - 2)].astype(np.int64)
        three = two[:-2] * (base + 1) + keys[2:]
        doc = np.repeat(np.arange(len(words)), n_words)
        inner = np.flatnonzero(doc[:-2] == doc[2:])
        order = inner[np.argsort(three[inner], kind="stable")]
        same = three[order[1:]] == three[order[:-1]]
        twice = order[np.r_[same, False] | np.r_[False, same]]
        for k in range(3):
            hit[twice + k] = True
    starts = repeats(levels, least)
    out["n_repeat_words"] = _by_doc(hit[:n], ends, n_words)
    out["n_covered"] = _by_doc(covered(starts), ends, n_words)
    longest = np.zeros(len(words), np.int64)
    full = np.flatnonzero(n_words)
    if len(full):
        longest[full] = np.maximum.reduceat(starts, (ends - n_words)[full])
    return out | {"longest": longest}


def _by_doc(x: np.ndarray, ends: np.ndarray, n: np.ndarray) -> np.ndarray:
    run = np.r_[0, np.cumsum(x, dtype=np.int64)]
    return run[ends] - run[ends - n]


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_covered long, longest_repeat long"


def rated(docs: DataFrame, least: int = LEAST, most_covered: float = MOST_COVERED, longest: int = LONGEST) -> DataFrame:
    """SCHEMA for each row of docs(doc_id, text), in one pass without a shuffle.

    Null and empty texts have no words and fail the base rules; repeated rows get equal answers; a null doc_id
    stays null; an empty table gives none; other columns don't matter. Memory: about 100 bytes a word of the
    longest text.
    """

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, end in _parts(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()):
                m = measures(batch.column(1).slice(at, end - at).to_pylist(), least)
                n = m["n_words"]
                failed = (n < MIN_WORDS) | (100 * m["n_repeat_words"] > MOST_REPEATED * n)
                kept = ~failed & (m["n_covered"] <= most_covered * n) & (m["longest"] <= longest)
                cols = [m[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")] + [failed, kept, m["n_covered"], m["longest"]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), *map(pa.array, cols)], [c.split()[0] for c in SCHEMA.split(", ")])

    docs = docs.select("doc_id", "text")
    return docs.mapInArrow(rate, SCHEMA.replace("doc_id long", f"doc_id {dict(docs.dtypes)['doc_id']}"))


def _parts(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about BATCH * 8 bytes."""
    at = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > BATCH * 8:
            yield at, i
            at, total = i, 0
        total += n
    if at < len(sizes):
        yield at, len(sizes)
