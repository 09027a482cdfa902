"""The Pitman-Yor sampler against its exact laws and against a textbook sampler that moves one customer at a time."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np

from factloom.llm import pitmanyor


def held(i) -> bool:
    return zlib.crc32(str(i).encode()) % 10 == 0


def bigrams(words: list) -> list[tuple]:
    return list(zip([None, *words], [*words, None]))


def constant(n: int, rest: float, discount: float, base: float) -> pitmanyor.Opening:
    return pitmanyor.Opening(np.full(n, rest), discount, np.full(n, base), np.ones(n), 0)


def test_number_of_tables():
    # concentration 1, discount 1/2, a parent of probability 1: the plain process
    rng, n = np.random.default_rng(1), 4000
    dish, opened = pitmanyor.seat(np.full(n, 1000), constant(n, 1.0, 0.5, 1.0), rng)
    want = 2 * (math.exp(math.lgamma(1001.5) - math.lgamma(1.5) - math.lgamma(1001)) - 1)
    some = 1 + np.bincount(dish, minlength=n)
    one = np.array([1 + len(pitmanyor._seat_one(1000, 1, 1, 1.0, 0.5, 1.0, 1.0, 0, rng)) for _ in range(n)])
    for t in (some, one):
        assert abs(t.mean() - want) < 4 * t.std() / n**0.5
    assert (np.diff(opened[dish == 0]) > 0).all() and opened.min() >= 1 and opened.max() <= 999


def test_steps_keep_the_conditional_law():
    def exact(c: int, rest: float, d: float, base: float) -> dict[int, float]:
        weight = Counter()

        def go(n: int, t: int, x: float) -> None:
            if n == c:
                weight[t] += x
                return
            go(n + 1, t, x * (n - d * t))
            go(n + 1, t + 1, x * (rest + d * t) * base)

        go(1, 1, 1.0)
        return {t: x / sum(weight.values()) for t, x in weight.items()}

    rng, n = np.random.default_rng(2), 20000
    for c, rest, d, base in ((6, 1.5, 0.5, 0.2), (3, 1.0, 0.8, 0.05), (9, 3.0, 0.3, 0.6)):
        dish = opened = np.zeros(0, np.int64)
        seen = Counter()
        for k in range(25):
            dish, opened = pitmanyor.reseat(np.full(n, c), dish, opened, constant(n, rest, d, base), rng)
            if k > 5:
                seen.update((1 + np.bincount(dish, minlength=n)).tolist())
        for t, p in exact(c, rest, d, base).items():
            assert abs(seen[t] / sum(seen.values()) - p) < 0.006


def test_log_gamma():
    x = np.array([0.01, 0.5, 1, 3.3, 7.99, 8, 50, 1e6])
    assert np.allclose(pitmanyor.log_gamma(x), [math.lgamma(y) for y in x], rtol=1e-12, atol=1e-10)
    start, end, plus = np.array([1.0, 1, 5, 2]), np.array([1.0, 9, 600, 14]), np.array([0.3, -0.5, 2.0, 0.1])
    assert np.allclose(pitmanyor._rising(start, end, plus), [sum(math.log(i + p) for i in range(int(a), int(b))) for a, b, p in zip(start, end, plus)])


def brute(train: list[list[str]], d: float, dr: float, base: float, sweeps: int, burn: int, asked: list[list[str]]) -> list[float]:
    """Gibbs sampling with tables as lists of their customers; the log10 probability of each asked text."""
    r, theta = random.Random(0), pitmanyor.CONCENTRATION
    rest, root = defaultdict(lambda: defaultdict(list)), defaultdict(list)
    customers, tables, rc, rt = Counter(), Counter(), 0, 0

    def parent(w):
        return (sum(root[w]) - dr * len(root[w]) + (theta + dr * rt) * base) / (theta + rc)

    def pick(weights):
        return r.choices(range(len(weights)), weights)[0]

    def add(u, w):
        nonlocal rc, rt
        at = rest[u][w]
        i = pick([n - d for n in at] + [(theta + d * tables[u]) * parent(w)])
        customers[u] += 1
        if i < len(at):
            at[i] += 1
            return
        at.append(1)
        tables[u] += 1
        j = pick([n - dr for n in root[w]] + [(theta + dr * rt) * base])
        rc += 1
        if j < len(root[w]):
            root[w][j] += 1
        else:
            root[w].append(1)
            rt += 1

    def remove(u, w):
        nonlocal rc, rt
        at = rest[u][w]
        i = pick(at)
        at[i] -= 1
        customers[u] -= 1
        if not at[i]:
            at.pop(i)
            tables[u] -= 1
            j = pick(root[w])
            root[w][j] -= 1
            rc -= 1
            if not root[w][j]:
                root[w].pop(j)
                rt -= 1

    pairs = [p for doc in train for p in bigrams(doc)]
    for p in pairs:
        add(*p)
    sums = Counter()
    wanted = {p for doc in asked for p in bigrams(doc)}
    for k in range(sweeps):
        for p in pairs:
            remove(*p)
            add(*p)
        if k >= burn:
            for u, w in wanted:
                at = rest[u][w] if u in rest else []
                sums[u, w] += (sum(at) - d * len(at) + (theta + d * tables[u]) * parent(w)) / (theta + customers[u]) / (sweeps - burn)
    return [sum(math.log10(sums[p]) for p in bigrams(doc)) for doc in asked]


def corpus(n: int) -> list[list[str]]:
    r = random.Random(3)

    def text():
        x, out = r.randrange(40), []
        for _ in range(r.randint(0, 25)):
            x = (x * 7 + int(r.expovariate(1) * 2)) % 40
            out.append(f"w{x}")
        return out

    return [text() for _ in range(n)]


def test_scores_are_those_of_the_textbook_sampler(spark):
    docs = corpus(300)
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id long, text string").repartition(3)
    out = pitmanyor.scored(df, block_tokens=700)
    got = {x["doc_id"]: x for x in out.collect()}
    train = [w for i, w in enumerate(docs) if not held(i)]
    pairs = Counter(p for w in train for p in bigrams(w))
    of = Counter(w for _, w in pairs)
    share = lambda c: sum(v == 1 for v in c.values()) / (sum(v == 1 for v in c.values()) + 2 * sum(v == 2 for v in c.values()))
    want = brute(train, share(pairs), min(0.95, max(0.05, share(of))) if any(v == 1 for v in of.values()) else 0.5, 1 / (len(of) + 1), 40, 15, docs)
    gaps = [abs(x - got[i]["score"]) / (len(docs[i]) + 1) for i, x in enumerate(want)]
    assert np.mean(gaps) < 0.01 and max(gaps) < 0.06
    mine = [(got[i]["score"], got[i]["base_score"], x, len(docs[i]) + 1) for i, x in enumerate(want) if held(i)]
    loss = lambda k: 10 ** (-sum(m[k] for m in mine) / sum(m[3] for m in mine))
    assert abs(loss(0) / loss(2) - 1) < 0.02 and loss(0) < loss(1)  # held-out perplexity: as the textbook's, better than the base's
    assert math.isclose(pitmanyor.perplexity(out), loss(0), rel_tol=1e-6)
    # blocks and buckets are only where the work is done
    other = {x["doc_id"]: x["score"] for x in pitmanyor.scored(df, bucket_bytes=100).collect()}
    assert np.mean([abs(other[i] - got[i]["score"]) for i in other]) < 0.1


def test_predictions_are_a_distribution():
    rng = np.random.default_rng(5)
    c = np.array([5, 2, 3, 7, 2, 2])  # three words, two contexts
    none = np.zeros(0, np.int64)
    s = pitmanyor.Seating(np.array([2, 2, 2]), np.array([1, 0, 2]), np.array([0, 1] * 3), c, none, none, none, none, np.array([3, 9], np.uint64), np.array([1, 2]))
    counts = np.zeros(len(pitmanyor.REST))
    counts[[pitmanyor.REST.index(x) for x in ("words", "tokens", "once", "twice", "root_once", "root_twice", "customers", "tables")]] = [3, 24, 3, 2, 1, 1, 9, 3]
    now = counts
    for _ in range(20):
        elsewhere = s.alone + s.by_context(s.tables())
        s.step(pitmanyor.Weights(counts, now), elsewhere, rng)
        now = counts.copy()
        now[-2:] = s.guests().sum(), s.roots().sum()
        assert (s.tables() >= 1).all() and (s.tables() <= c).all() and (s.roots() >= 1).all() and (s.roots() <= s.guests()).all()
        again = pitmanyor.Seating.read(s.written())
        assert all(np.array_equal(getattr(s, f), getattr(again, f)) for f in s.FIELDS)
    w = pitmanyor.Weights(counts, now)
    parent = np.r_[w.root(s.guests(), s.roots()), w.root(0, 0)]
    assert math.isclose(parent.sum(), 1)
    own = np.r_[c[::2] - w.discount * s.tables()[::2], 0]  # context 0, which has one word once besides: word 0
    single = np.r_[1 - w.discount, 0, 0, 0]
    t = s.tables()[::2].sum() + 1
    p = (own + single + (pitmanyor.CONCENTRATION + w.discount * t) * parent) / (pitmanyor.CONCENTRATION + c[::2].sum() + 1)
    assert math.isclose(p.sum(), 1)


def test_contexts_are_words(spark):
    # two words that 4,095 hash classes of contexts can't tell apart
    import xxhash

    seen, pair = {}, None
    for i in range(4000):
        key = (xxhash.xxh64_intdigest(f"x{i}".encode(), pitmanyor.SEED) >> 40) % 4095
        if key in seen:
            pair = seen[key], f"x{i}"
            break
        seen[key] = f"x{i}"
    rows = [(i, f"{pair[i % 2]} {'pq'[i % 2]}") for i in range(400)]
    got = {r["doc_id"]: r["score"] for r in pitmanyor.scored(spark.createDataFrame([*rows, (1000, f"{pair[0]} q"), (1001, f"{pair[0]} never")], "doc_id long, text string")).collect()}
    assert got[0] > -0.4 and got[1] > -0.4 and got[1000] < -1.5 and got[1001] < got[1000]


def test_without_training(spark):
    ids = [i for i in range(100) if held(i)]
    got = pitmanyor.scored(spark.createDataFrame([(i, "a b a") for i in ids], "doc_id long, text string")).collect()
    assert len(got) == len(ids) and all(r["n_known"] == 0 and math.isclose(r["score"], 0, abs_tol=1e-6) for r in got)
