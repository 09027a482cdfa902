"""Language-model scoring by a hierarchical Pitman-Yor model.

Restaurants: one for each context, a context being the word before (its 64-bit hash), or the start of a text,
which follows the end of another; all share one parent, the restaurant of words without context, whose base gives each of
the V known tokens, and all unknown ones together, 1 / (V + 1). A dish is a token. A context restaurant
keeps for each dish its customers c and tables t; the tables are the parent's customers.

The seating is sampled by Gibbs sweeps. A step takes all customers of one dish out of one restaurant, with their
tables out of the parent, and proposes a new seating of them, one after another: customer n + 1 opens a table with
the weight of a new one, given the tables opened so far, where the n seated weigh n - discount * t. How many
customers come before the next new table is drawn from its exact law at once, so the work is in tables, not in
customers. A Metropolis test (see reseat()) then makes the step leave the conditional distribution of the seating
unchanged. A dish of one customer has one table and needs no step. All dishes step side by side, given the others as
the sweep before left them, which is how the sampler is distributed and where it departs from a sequential one. The
score averages the predictive probabilities over SAMPLES sweeps after BURN_IN.

How it is spread out: a task turns its documents into blocks of tokens and sends, for each bucket of words, the
block's distinct (word, context) pairs with their training counts. A bucket owns its words' dishes in all
restaurants and in the parent; it numbers its pairs, and keeps of each block only the numbers it asks for. A sweep
needs nothing from other buckets but the tables of the restaurants that have dishes of several customers. Between sweeps
a bucket sends what it has of each such context to the context's own bucket, which adds up and answers. In the end
buckets answer each block's pairs, and blocks sum up their documents. What follows a step is a table in the shared
folder, and what came before it is deleted.
"""

from __future__ import annotations

import math
import struct
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count, repeat

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Tables, settled

#: Contexts to a message of tables, at most.
CONTEXTS = 1 << 16
#: Sweeps before the first that is kept, and sweeps that are kept.
BURN_IN, SAMPLES, SEED = 3, 3, 42
CONCENTRATION = 1.0
#: Dishes that are seated one by one rather than side by side.
FEW = 512
#: Bytes of text to a bucket of words; tokens to a block.
BUCKET_BYTES, BLOCK_TOKENS = 24_000_000, 3 << 19
END = np.uint64(1)
MESSAGE = "kind int, bucket int, block long, data binary"
#: Kinds of rows: a block's pairs for a bucket, a block's documents, a bucket's pairs, totals, replies, questions and answers about contexts, a seating, and what a block asks of a bucket.
PAIRS, BLOCK, KNOWN, TOTAL, REPLY, ASK, TOLD, SEATED, WANTED = range(9)
#: The block of a bucket's pairs, before those of blocks; then come its seating and the answers about its contexts.
STATE = -(1 << 62)
#: What is summed over all buckets.
REST = ("words", "tokens", "once", "twice", "root_once", "root_twice", "customers", "tables")


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes; their planes of bytes compress better than their numbers."""
    parts = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        data = zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, a.itemsize).T).tobytes())
        parts.append(struct.pack("<cBQQ", a.dtype.kind.encode(), a.itemsize, len(a), len(data)) + data)
    return b"".join(parts)


def unpacked(data: bytes) -> list[np.ndarray]:
    out, at, head = [], 0, struct.calcsize("<cBQQ")
    while at < len(data):
        kind, size, n, length = struct.unpack_from("<cBQQ", data, at)
        raw = zstandard.ZstdDecompressor().decompress(data[at + head : at + head + length], max_output_size=max(1, n * size)) if n else b""
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).reshape(-1).view(np.dtype(f"{kind.decode()}{size}")))
        at += head + length
    return out


def _row(kind: int, bucket: int, block: int, data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([bucket], pa.int32()), pa.array([block], pa.int64()), pa.array([data], pa.binary())], ["kind", "bucket", "block", "data"])


def _ids(ids: pa.Array) -> bytes:
    """An array of whatever type, with its length before it."""
    batch, sink = pa.RecordBatch.from_arrays([ids], ["doc_id"]), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    data = sink.getvalue().to_pybytes()
    return struct.pack("<Q", len(data)) + data


# Blocks of documents

def _encode(buckets: int, tokens: int = BLOCK_TOKENS):
    """Rows of documents (doc_id, held, text) to messages: PAIRS to buckets, BLOCK for the block itself, which a bucket keeps."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, kind = TaskContext.get().partitionId() << 32, pa.int64()
        number: dict[bytes, int] = defaultdict(count().__next__)
        rids, held, ids, lens, total = [], [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            hashes = np.fromiter(map(xxhash.xxh64_intdigest, number, repeat(SEED)), np.uint64, len(number))
            hashes = np.r_[hashes, END]
            lengths = np.array(lens, np.int64) + 1
            ends = np.cumsum(lengths)
            word = np.full(int(ends[-1]), len(hashes) - 1, np.int64)  # the end, but for where the words go
            inner = np.ones(len(word), bool)
            inner[ends - 1] = False
            word[inner] = np.concatenate(ids)
            order = np.lexsort((hashes, hashes % np.uint64(buckets)))
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            plain = np.argsort(hashes)
            place = np.empty(len(plain), np.int64)
            place[plain] = np.arange(len(plain))
            context = place[np.r_[len(hashes) - 1, word[:-1]]]  # a text follows an end
            word = rank[word]
            pairs, pair = np.unique(word * len(order) + context, return_inverse=True)
            learn = np.repeat(~np.array(held, bool), lengths)
            train = np.bincount(pair[learn], minlength=len(pairs)).astype(np.uint32)
            of, context, hashes = pairs // len(order), hashes[plain][pairs % len(order)], hashes[order]
            where = (hashes % np.uint64(buckets)).astype(np.int64)
            for b in np.unique(where):
                lo, hi = np.searchsorted(where, [b, b + 1])
                first, last = np.searchsorted(of, [lo, hi])
                contexts, k = np.unique(context[first:last], return_inverse=True)
                yield _row(PAIRS, int(b), block, packed(hashes[lo:hi], np.bincount(of[first:last] - lo, minlength=hi - lo).astype(np.uint32), contexts, k.astype(np.uint32), train[first:last]))
            # a document's pairs in ascending order, as differences
            doc = np.repeat(np.arange(len(lengths)), lengths)
            pair = pair[np.lexsort((pair, doc))]
            step = np.diff(pair, prepend=0)
            step[ends[:-1]] = pair[ends[:-1]]
            yield _row(BLOCK, ((block >> 32) + block % (1 << 32)) % buckets, block, _ids(pa.array(rids, kind)) + packed(lengths.astype(np.uint32), step.astype(np.uint32), np.bincount(of).astype(np.uint32)))

        for batch in batches:
            kind = batch.column(0).type
            for rid, hold, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").lower().split()
                rids.append(rid), held.append(hold), lens.append(len(words))
                ids.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
                total += len(words) + 1
                if total >= tokens:
                    yield from flush()
                    block += 1
                    number.clear()
                    number.default_factory = count().__next__
                    rids, held, ids, lens, total = [], [], [], [], 0
        if rids:
            yield from flush()

    return encode


# Buckets of words

def _merge(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """(words, pairs of each, contexts, each pair's place in them, customers) that add up parts; pairs by word and context."""
    words, contexts = np.unique(np.concatenate([p[0] for p in parts])), np.unique(np.concatenate([p[2] for p in parts]))
    key = np.concatenate([_keys(words, contexts, *p[:4]) for p in parts])
    key, at = np.unique(key, return_inverse=True)
    c = np.bincount(at, np.concatenate([p[4] for p in parts]), len(key)).astype(np.int64)
    return words, np.bincount(key // len(contexts), minlength=len(words)), contexts, key % len(contexts), c


def _keys(words: np.ndarray, contexts: np.ndarray, own: np.ndarray, n: np.ndarray, own_contexts: np.ndarray, k: np.ndarray) -> np.ndarray:
    """A message's pairs as word * len(contexts) + context, by the places in words and contexts."""
    return np.repeat(np.searchsorted(words, own), n) * len(contexts) + np.searchsorted(contexts, own_contexts)[k]


def _steps(sorted_: np.ndarray) -> np.ndarray:
    return np.diff(sorted_, prepend=0).astype(np.uint32)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """The logarithm of the gamma function of positive numbers."""
    low = np.where(x < 8, x, 1.0)
    shift = np.log(low * (low + 1) * (low + 2) * (low + 3) * (low + 4) * (low + 5) * (low + 6) * (low + 7))
    y = np.where(x < 8, x + 8, x)
    series = (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - (1 / 360 - (1 / 1260 - 1 / (1680 * y * y)) / (y * y)) / (y * y)) / y
    return series - np.where(x < 8, shift, 0.0)


def _rising(start: np.ndarray, end: np.ndarray, plus: np.ndarray) -> np.ndarray:
    """log of (start + plus) (start + 1 + plus) ... (end - 1 + plus)."""
    out, few = np.zeros(len(start)), end - start <= 12
    i = np.flatnonzero(few)
    x, left, product = start[i] + plus[i], (end - start)[i], np.ones(len(i))
    k = np.flatnonzero(left > 0)
    while len(k):
        product[k] *= x[k]
        x[k] += 1
        left[k] -= 1
        k = k[left[k] > 0]
    out[i] = np.log(product)
    i = np.flatnonzero(~few)
    out[i] = log_gamma(end[i] + plus[i]) - log_gamma(start[i] + plus[i])
    return out


class Opening:
    """The weight of a new table for each dish, by the tables t that it has: (rest + discount * t) * (up + shared * t) / (down + shared * t)."""

    def __init__(self, rest: np.ndarray, discount: float, up: np.ndarray, down: np.ndarray, shared: int):
        self.rest, self.discount, self.up, self.down, self.shared = rest, discount, up, down, shared

    def __call__(self, i: np.ndarray, t: np.ndarray) -> np.ndarray:
        return (self.rest[i] + self.discount * t) * (self.up[i] + self.shared * t) / (self.down[i] + self.shared * t)


def seat(c: np.ndarray, weight: Opening, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Dishes' c customers seated one after another: (dish, n) for each table but a dish's first, by dish and n.

    Table t + 1 is opened by customer n + 1.
    """
    discount, live = weight.discount, np.flatnonzero(c > 1)
    n, t, dishes, opened = np.ones(len(live)), np.ones(len(live)), [], []
    while len(live) > FEW:
        new, end, taken = weight(live, t), c[live].astype(float), -discount * t
        stay = lambda to, i=slice(None): _rising(n[i], to, taken[i]) - _rising(n[i], to, taken[i] + new[i])  # noqa: B023, E731
        u = np.log(rng.random(len(live)) + 1e-300)
        at_end = stay(end)
        opens = np.flatnonzero(u >= at_end)
        # the first customer by whom the chance of no new table has fallen below u
        low, high, at_low, at_high, turn = n[opens], end[opens], np.zeros(len(opens)), at_end[opens], 0
        while len(wide := np.flatnonzero(high - low > 1)):
            a, b, turn = low[wide], high[wide], turn + 1
            middle = np.floor((a + b) / 2)
            if turn % 2:  # the logarithm of the chance falls about evenly with that of the customer
                x, y, shift = np.log(a + taken[opens[wide]]), np.log(b + taken[opens[wide]]), taken[opens[wide]]
                middle = np.clip(np.floor(np.exp(x + (y - x) * (u[opens[wide]] - at_low[wide]) / (at_high[wide] - at_low[wide])) - shift), a + 1, b - 1)
            at = stay(middle, opens[wide])
            fallen = at <= u[opens[wide]]
            high[wide], low[wide] = np.where(fallen, middle, b), np.where(fallen, a, middle)
            at_high[wide], at_low[wide] = np.where(fallen, at, at_high[wide]), np.where(fallen, at_low[wide], at)
        dishes.append(live[opens])
        opened.append(high - 1)
        more = high < end[opens]
        live, n, t = live[opens][more], high[more], t[opens][more] + 1
    for i, n_, t_ in zip(live.tolist(), n.tolist(), t.tolist()):
        places = _seat_one(int(c[i]), int(n_), int(t_), float(weight.rest[i]), discount, float(weight.up[i]), float(weight.down[i]), weight.shared, rng)
        dishes.append(np.full(len(places), i))
        opened.append(np.array(places, float))
    none = np.zeros(0)
    dish, places = np.concatenate([*dishes, none]).astype(np.int64), np.concatenate([*opened, none]).astype(np.int64)
    order = np.argsort(dish, kind="stable")
    return dish[order], places[order]


def _seat_one(c: int, n: int, t: int, rest: float, discount: float, up: float, down: float, shared: int, rng: np.random.Generator) -> list[int]:
    """seat() for what is left of one dish, without arrays."""
    out, lg, log = [], math.lgamma, math.log
    while n < c:
        new, taken = (rest + discount * t) * (up + shared * t) / (down + shared * t), -discount * t
        first = lg(n + taken + new) - lg(n + taken)
        u = log(rng.random() + 1e-300)
        low, high, at_low, at_high = n, c, 0.0, lg(c + taken) - lg(c + taken + new) + first
        if u < at_high:
            break
        turn = 0
        while high - low > 1:
            middle, turn = (low + high) // 2, turn + 1
            if turn % 2:  # the logarithm of the chance falls about evenly with that of the customer
                x, y = log(low + taken), log(high + taken)
                middle = min(high - 1, max(low + 1, int(math.exp(x + (y - x) * (u - at_low) / (at_high - at_low)) - taken)))
            at = lg(middle + taken) - lg(middle + taken + new) + first
            if at <= u:
                high, at_high = middle, at
            else:
                low, at_low = middle, at
        out.append(high - 1)
        n, t = high, t + 1
    return out


def log_weight(some: np.ndarray, c: np.ndarray, dish: np.ndarray, opened: np.ndarray, weight: Opening) -> np.ndarray:
    """For some dishes (sorted) the sum of the logs of the sums of weights that their customers chose among, in a seating as seat() gives it."""
    mine = np.isin(dish, some)
    dish, opened = np.searchsorted(some, dish[mine]), opened[mine]
    # a stretch of customers for each number of tables
    of = np.concatenate([np.arange(len(some)), dish])
    t = np.concatenate([np.ones(len(some)), _places(np.bincount(dish, minlength=len(some))) + 2.0])
    start = np.concatenate([np.ones(len(some)), opened + 1.0])
    order = np.lexsort((t, of))
    of, t, start = of[order], t[order], start[order]
    last = np.r_[of[1:] != of[:-1], True]
    end = np.where(last, c[some][of], np.r_[start[1:], 0])
    return np.bincount(of, _rising(start, np.maximum(start, end), weight(some[of], t) - weight.discount * t), len(some))


def _places(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... for each group of so many."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def reseat(c: np.ndarray, dish: np.ndarray, opened: np.ndarray, weight: Opening, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """A Metropolis step for each dish's seating, (dish, opened) as seat() gives it.

    The probability of a seating is the product of the weights chosen; seat() proposes it with that, divided by
    the product of the sums of weights that each was chosen among. So the ratio of those sums decides; it is 1
    where one table follows one table.
    """
    other, places = seat(c, weight, rng)
    some = np.unique(np.concatenate([dish, other]))
    if not len(some):
        return dish, opened
    gain = log_weight(some, c, other, places, weight) - log_weight(some, c, dish, opened, weight)
    takes = np.log(rng.random(len(some)) + 1e-300) < gain
    keep, come = ~takes[np.searchsorted(some, dish)], takes[np.searchsorted(some, other)]
    dish, opened = np.concatenate([dish[keep], other[come]]), np.concatenate([opened[keep], places[come]])
    order = np.argsort(dish, kind="stable")
    return dish[order], opened[order]


def _totals(sums: dict[str, float]) -> np.ndarray:
    return np.array([sums.get(k, 0) for k in REST], np.float64)


class Weights:
    """What restaurants share: the discounts, and the parent's customers and tables."""

    def __init__(self, counts: np.ndarray, now: np.ndarray):
        rest, sums = dict(zip(REST, counts)), dict(zip(REST, now))
        share = lambda one, two: min(0.95, max(0.05, one / (one + 2 * two))) if one else 0.5
        self.discount, self.root_discount = share(rest["once"], rest["twice"]), share(rest["root_once"], rest["root_twice"])
        self.words, self.tokens = int(rest["words"]), int(rest["tokens"])
        self.root_customers, self.root_tables, self.base = sums["customers"], sums["tables"], 1 / (rest["words"] + 1)

    def below(self) -> float:
        return (CONCENTRATION + self.root_discount * self.root_tables) * self.base

    def root(self, customers: np.ndarray, tables: np.ndarray, out: np.ndarray | float = 0.0) -> np.ndarray:
        """The parent's predictive probability of words with so many customers and tables there, of whose customers out are out of all."""
        return (customers - self.root_discount * tables + self.below()) / (CONCENTRATION + self.root_customers - out)


class Seating:
    """A bucket's dishes of several customers and its words' tables in the parent, as they are between sweeps.

    Of each word: n, how many such dishes there are, and single, how many dishes of one customer. Of each dish:
    k, its context's place among contexts, and c. dish, opened: its tables but the first (see seat()); word,
    root_opened: the same of the words in the parent. Of each context with several customers of one dish, here or
    elsewhere: hashes, and single, its dishes of one customer. past: what kept sweeps left of t by dish, root tables by
    word, and, once told, tables by context.
    """

    FIELDS = ("n", "single", "k", "c", "dish", "opened", "word", "root_opened", "hashes", "alone")

    def __init__(self, *arrays: np.ndarray):
        for name, x in zip(self.FIELDS, arrays):
            setattr(self, name, x if name == "hashes" else x.astype(np.int64))
        self.past = [x.astype(np.int64) for x in arrays[len(self.FIELDS) :]]
        self.of = np.repeat(np.arange(len(self.n)), self.n)

    @classmethod
    def read(cls, data: bytes) -> Seating:
        n, single, k, c, dish, opened, word, root_opened, *rest = unpacked(data)
        return cls(n, single, k, c, np.cumsum(dish, dtype=np.int64), opened, np.cumsum(word, dtype=np.int64), root_opened, *rest)

    def written(self) -> bytes:
        small = lambda x: x.astype(np.uint32)
        return packed(small(self.n), small(self.single), small(self.k), self.c, _steps(self.dish), self.opened, _steps(self.word), self.root_opened, self.hashes, small(self.alone), *map(small, self.past))

    def tables(self) -> np.ndarray:
        return 1 + np.bincount(self.dish, minlength=len(self.c))

    def guests(self) -> np.ndarray:
        return self.single + np.bincount(self.of, self.tables(), len(self.n)).astype(np.int64)

    def roots(self) -> np.ndarray:
        """Tables of each word in the parent."""
        return np.minimum(1, self.guests()) + np.bincount(self.word, minlength=len(self.n))

    def by_context(self, t: np.ndarray) -> np.ndarray:
        return np.bincount(self.k, t, len(self.hashes)).astype(np.int64)

    def step(self, w: Weights, elsewhere: np.ndarray, rng: np.random.Generator) -> None:
        """One sweep; elsewhere: the tables of each context with all its dishes."""
        t, guests, roots = self.tables(), self.guests(), self.roots()
        others = guests[self.of] - t
        root = np.minimum(roots[self.of], others)
        # the tables here are customers of the parent, who share its tables
        up = others - w.root_discount * np.maximum(root, 1) + w.below()
        here = Opening(CONCENTRATION + w.discount * (elsewhere[self.k] - t), w.discount, up, CONCENTRATION + w.root_customers - t, 1)
        self.dish, self.opened = reseat(self.c, self.dish, self.opened, here, rng)
        guests = self.guests()
        there = self.root_opened < guests[self.word]  # of customers who have left, the last ones
        self.word, self.root_opened = self.word[there], self.root_opened[there]
        above = Opening(CONCENTRATION + w.root_discount * (w.root_tables - roots), w.root_discount, np.full(len(roots), w.base), np.ones(len(roots)), 0)
        self.word, self.root_opened = reseat(guests, self.word, self.root_opened, above, rng)


def _context_bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Contexts go to buckets by range, so that those of a bucket stand together."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _ask(buckets: int, bucket: int, hashes: np.ndarray, *own: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A bucket's part of numbers about contexts (sorted): ASK, to the contexts' buckets."""
    to = _context_bucket(hashes, buckets)
    for b in np.unique(to):
        first, last = (int(x) for x in np.searchsorted(to, [b, b + 1]))
        for lo in range(first, last, CONTEXTS):
            hi = min(last, lo + CONTEXTS)
            yield _row(ASK, int(b), STATE + 2 + lo, struct.pack("<q", bucket) + packed(hashes[lo:hi], *(x[lo:hi].astype(np.uint64) for x in own)))


def _tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Questions, a contexts' bucket at a time, to answers (TOLD): the sums over all buckets."""

    def done(asked: list) -> Iterator[pa.RecordBatch]:
        hashes, at = np.unique(np.concatenate([a[2] for a in asked]), return_inverse=True)
        sums = [np.bincount(at, np.concatenate(x), len(hashes)).astype(np.uint64)[at] for x in zip(*(a[3:] for a in asked))]
        first = 0
        for bucket, block, h, *_ in asked:
            yield _row(TOLD, bucket, block, packed(*(x[first : first + len(h)] for x in sums)))
            first += len(h)

    now, asked = None, []
    for batch in batches:
        for bucket, block, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
            if bucket != now and asked:
                yield from done(asked)
                asked = []
            now, data = bucket, data.as_py()
            asked.append((struct.unpack_from("<q", data)[0], block, *unpacked(data[8:])))
    if asked:
        yield from done(asked)


def _told(answers: list[list[np.ndarray]], n: int) -> list[np.ndarray]:
    return [np.concatenate(x).astype(np.int64) for x in zip(*answers)] if answers else [np.zeros(0, np.int64)] * n


def _collect(buckets: int):
    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Messages, a bucket at a time, to its pairs (KNOWN), what blocks want of it (WANTED), questions, and what the task's buckets sum up to (TOTAL)."""
        total = np.zeros(len(REST))

        def done(bucket: int, parts: list, held: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
            nonlocal total
            words, n, contexts, k, c = _merge(parts)
            of = np.repeat(np.arange(len(words)), n)
            keys = of * len(contexts) + k
            dishes = np.bincount(of, c > 0, len(words))
            total += _totals({"words": (dishes > 0).sum(), "tokens": c.sum(), "once": (c == 1).sum(), "twice": (c == 2).sum(), "root_once": (dishes == 1).sum(), "root_twice": (dishes == 2).sum(), "customers": (c > 0).sum(), "tables": (dishes > 0).sum()})
            yield _row(KNOWN, bucket, STATE, packed(n.astype(np.uint32), contexts, k.astype(np.uint32), c.astype(np.uint64)))
            yield from _ask(buckets, bucket, contexts, *(np.bincount(k, x, len(contexts)) for x in (c, c == 1, c > 0)))
            for block, data in held:
                own, m, own_contexts, own_k, _ = unpacked(data)
                # a message's pairs stand in the order of words and contexts, as the bucket's do
                yield _row(WANTED, bucket, block, packed(_steps(np.searchsorted(words, own)), m, _steps(np.searchsorted(keys, _keys(words, contexts, own, m, own_contexts, own_k)))))

        now, parts, held, size = None, [], [], 0
        for batch in batches:
            for kind, bucket, block, data in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3)):
                if kind == BLOCK:
                    yield _row(kind, bucket, block, data.as_py())
                    continue
                if bucket != now and parts:
                    yield from done(now, parts, held)
                    parts, held, size = [], [], 0
                now, data = bucket, data.as_py()
                held.append((block, data))
                parts.append(tuple(x if x.dtype == np.uint64 else x.astype(np.int64) for x in unpacked(data)))
                size += len(parts[-1][3])
                if size > 4_000_000 and len(parts) > 1:
                    parts = [_merge(parts)]
                    size = len(parts[0][3]) // 2
        if parts:
            yield from done(now, parts, held)
        yield _row(TOTAL, -1, -1, packed(total))

    return collect


def _swept(buckets: int, bucket: int, s: Seating) -> Iterator[pa.RecordBatch]:
    yield _row(SEATED, bucket, STATE + 1, s.written())
    yield from _ask(buckets, bucket, s.hashes, s.by_context(s.tables()))


def _first(buckets: int, counts: np.ndarray):
    """A bucket's pairs with the sums of its contexts to the same without contexts' hashes, and its seating after one sweep."""

    def done(bucket: int, data: bytes, answers: list, total: np.ndarray) -> Iterator[pa.RecordBatch]:
        n, contexts, k, c = (x if i == 1 else x.astype(np.int64) for i, x in enumerate(unpacked(data)))
        customers, single, dishes = _told(answers, 3)
        of, several, live = np.repeat(np.arange(len(n)), n), c > 1, np.flatnonzero(customers > single)
        yield _row(KNOWN, bucket, STATE, packed(n.astype(np.uint32), k.astype(np.uint32), c.astype(np.uint64), customers.astype(np.uint64), single.astype(np.uint32)))
        place = np.zeros(len(contexts), np.int64)
        place[live] = np.arange(len(live))
        none = np.zeros(0, np.int64)
        s = Seating(np.bincount(of[several], minlength=len(n)), np.bincount(of[c == 1], minlength=len(n)), place[k[several]], c[several], none, none, none, none, contexts[live], single[live])
        s.step(Weights(counts, counts), dishes[live], np.random.default_rng([SEED, 0, bucket]))
        total += _totals({"customers": s.guests().sum(), "tables": s.roots().sum()})
        yield from _swept(buckets, bucket, s)

    return _by_bucket(done)


def _sweep(buckets: int, counts: np.ndarray, now: np.ndarray, sweep: int, keep: bool):
    """A bucket's seating with the tables of its contexts to the next; keep: whether what it comes from stays as a sample."""

    def done(bucket: int, data: bytes, answers: list, total: np.ndarray) -> Iterator[pa.RecordBatch]:
        s = Seating.read(data)
        elsewhere = s.alone + _told(answers, 1)[0]
        if keep:
            s.past += [s.tables(), s.guests(), s.roots(), elsewhere]
        s.step(Weights(counts, now), elsewhere, np.random.default_rng([SEED, sweep, bucket]))
        total += _totals({"customers": s.guests().sum(), "tables": s.roots().sum()})
        yield from _swept(buckets, bucket, s)

    return _by_bucket(done)


def _by_bucket(done: Callable):
    """A function of rows, a bucket's state and then its answers, that calls done with each bucket's."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, now, state, answers = np.zeros(len(REST)), None, None, []
        for batch in batches:
            for kind, bucket, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3)):
                if kind != TOLD:
                    if state is not None:
                        yield from done(now, state, answers, total)
                    now, state, answers = bucket, data.as_py(), []
                else:
                    answers.append(unpacked(data.as_py()))
        if state is not None:
            yield from done(now, state, answers, total)
        yield _row(TOTAL, -1, -1, packed(total))

    return each


def _answer(counts: np.ndarray, samples: list[np.ndarray]):
    """A bucket's pairs, seating and answers, then what blocks want of it, to replies: each word's training count, each pair's log10 probability."""

    def ready(known: bytes, seated: bytes, answers: list) -> tuple[np.ndarray, np.ndarray]:
        n, k, c, customers, single = (x.astype(np.int64) for x in unpacked(known))
        s = Seating.read(seated)
        s.past += [s.tables(), s.guests(), s.roots(), s.alone + _told(answers, 1)[0]]
        of, several, live = np.repeat(np.arange(len(n)), n), c > 1, np.flatnonzero(customers > single)
        t, tables, p = np.minimum(c, 1), single.copy(), np.zeros(len(c))
        for i, now in enumerate(samples):
            w = Weights(counts, now)
            t[several], guests, roots, tables[live] = s.past[4 * i : 4 * i + 4]
            new = CONCENTRATION + w.discount * tables
            p += (c - w.discount * t + new[k] * w.root(guests, roots)[of]) / (CONCENTRATION + customers[k])
        return np.bincount(of, c, len(n)).astype(np.uint64), np.log10(p / len(samples)).astype(np.float32)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = seated = made = None
        answers: list = []
        for batch in batches:
            for kind, bucket, block, data in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3)):
                data = data.as_py()
                if kind == KNOWN:
                    known, answers, made = data, [], None
                elif kind == SEATED:
                    seated = data
                elif kind == TOLD:
                    answers.append(unpacked(data))
                else:
                    if made is None:
                        made = ready(known, seated, answers)
                        known = seated = None
                        answers = []
                    words, _, pairs = unpacked(data)
                    yield _row(REPLY, bucket, block, packed(made[0][np.cumsum(words, dtype=np.int64)], made[1][np.cumsum(pairs, dtype=np.int64)]))

    return answer


def _score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block's documents, then its replies by bucket, to a row for each document."""

    def done(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
        cut = 8 + struct.unpack_from("<Q", rows[0][1])[0]
        rids = pa.ipc.open_stream(rows[0][1][8:cut]).read_next_batch().column(0)
        lengths, step, of = unpacked(rows[0][1][cut:])
        replies = [unpacked(data) for _, data in sorted(rows[1:])]
        known, logs = np.concatenate([r[0] for r in replies]).astype(float), np.concatenate([r[1] for r in replies]).astype(float)
        counts = np.repeat(known, of)
        ends = np.cumsum(lengths.astype(np.int64))
        starts = ends - lengths
        run = np.cumsum(step.astype(np.int64))
        pair = run - np.repeat(np.r_[0, run[ends[:-1] - 1]], lengths)
        add = lambda x: np.add.reduceat(x[pair], starts)
        return pa.RecordBatch.from_arrays([rids, pa.array(lengths.astype(np.int64)), pa.array(add((counts > 0).astype(np.int64))), pa.array(add(np.log10(counts + 0.1))), pa.array(add(logs))], ["doc_id", "n_tokens", "n_known", "base", "score"])

    now, rows = None, []
    for batch in batches:
        for bucket, block, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
            if block != now and rows:
                yield done(rows)
                rows = []
            now = block
            rows.append((bucket, data.as_py()))
    if rows:
        yield done(rows)


def _summed(totals: DataFrame) -> np.ndarray:
    """The sum of TOTAL rows: collected by place, so its size is fixed."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(REST))
        for batch in batches:
            for data in batch.column(0):
                total += unpacked(data.as_py())[0]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["place", "x"])

    each = totals.where(f"kind = {TOTAL}").select("data").mapInArrow(spread, "place long, x double")
    out = np.zeros(len(REST))
    for place, x in each.groupBy("place").agg(F.sum("x")).collect():
        out[place] = x
    return out


def fold() -> Column:
    """crc32 of the id as text, modulo 10; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(10))


def scored(docs: DataFrame, burn_in: int = BURN_IN, samples: int = SAMPLES, bucket_bytes: int = BUCKET_BYTES, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for each row of docs(doc_id, text).

    Null and empty texts are the end token alone; repeated rows count, and are scored, each; without training
    rows every token is unknown; an empty table gives none; other columns don't matter, whatever their names. Memory:
    about 100 bytes a word of the longest text, and of a bucket. burn_in and samples are 1 at least. One row a document is kept in the shared
    folder until released().
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(8, -(-size // bucket_bytes))
    by_bucket = lambda df: df.repartition(buckets, "bucket").sortWithinPartitions("bucket", "block")
    of = lambda df, *kinds: df.where(F.col("kind").isin(list(kinds)))
    told = lambda df: by_bucket(of(df, ASK)).mapInArrow(_tell, MESSAGE)
    with Tables(spark) as tables:
        table = lambda df, name: tables.written(df, name, "kind")
        encoded = docs.select("doc_id", (fold() == 0).alias("held_out"), "text").mapInArrow(_encode(buckets, block_tokens), MESSAGE)
        pairs = table(by_bucket(encoded).mapInArrow(_collect(buckets), MESSAGE), "pairs")
        counts = _summed(pairs)  # a job between, so that Spark's listeners let go of the last one
        settled(spark)
        state = table(by_bucket(of(pairs, KNOWN).unionByName(told(pairs))).mapInArrow(_first(buckets, counts), MESSAGE), "first")
        now = _summed(state)
        tables.dropped_kinds(pairs, KNOWN, ASK)
        settled(spark)
        known, past = state, []
        for sweep in range(1, burn_in + samples):
            keep = sweep > burn_in
            if keep:
                past.append(now)
            after = table(by_bucket(of(state, SEATED).unionByName(told(state))).mapInArrow(_sweep(buckets, counts, now, sweep, keep), MESSAGE), "sweep")
            tables.dropped_kinds(state, SEATED, ASK)
            state, now = after, _summed(after)
            settled(spark)
        past.append(now)
        every = of(known, KNOWN).unionByName(of(state, SEATED)).unionByName(told(state)).unionByName(of(pairs, WANTED))
        replies = by_bucket(every).mapInArrow(_answer(counts, past), MESSAGE)
        dealt = replies.unionByName(of(pairs, BLOCK).withColumn("bucket", F.lit(-1))).repartition(buckets, "block").sortWithinPartitions("block", "bucket")
        scores = dealt.mapInArrow(_score, f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long, n_known long, base double, score double")
        w = Weights(counts, now)
        base = F.col("base") - F.col("n_tokens") * F.lit(float(np.log10(w.tokens + 0.1 * (w.words + 1))))
        out = scores.select("doc_id", (fold() == 0).alias("held_out"), "n_tokens", "n_known", F.lit(w.tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
        out = tables.keep(out, "scores")
    settled(spark)
    return tables.result(out)


def perplexity(scores: DataFrame) -> float:
    """Of the held-out rows of scored(): 10 to the power of minus the mean log10 probability of a token."""
    total, n = scores.where("held_out").agg(F.sum("score"), F.sum("n_tokens")).first()
    return float(10 ** (-total / n)) if n else float("nan")
