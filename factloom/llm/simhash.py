"""SimHash near-duplicates by anchor points of a covering code.

Fingerprints have 64 bits and link at 3 or fewer differing bits. The anchors are the words of the code
G + G + {0}: G is the perfect binary Golay code of 23 bits (covering radius 3), used on bits 0-22 and
23-45, and bits 46-63 have the one word zero. A fingerprint's excess at an anchor is the sum over the two
Golay blocks of max(0, distance - 3): how far it is beyond the covering radius. For fingerprints x and y at
distance 3 or less take a point z between them, at most 1 from x and at most 2 from y, and the anchor that
covers z: x has excess at most 1 there and y at most 2. So it is enough to replicate each fingerprint to
the anchors within the covering radius plus 2 and to compare, per anchor, those within radius plus 1
with all: the threshold is shared by the two sides, and a fingerprint has 61 copies on average where the
whole threshold on one side would take 302.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations, islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .components import components
from .shared import OWN, Tables, with_row_id, without

SEED = 42
BITS = 64
THRESHOLD = 3
SHINGLE = 3
#: Fixed value: the generator polynomial of the Golay code of 23 bits, x^11+x^10+x^6+x^5+x^4+x^2+1.
GOLAY = 0b110001110101
RADIUS = 3
#: Shingles hashed at a time, and anchor rows compared at a time.
CHUNK, ROWS = 1 << 16, 1 << 20
#: Copies of an anchor that one task compares; larger anchors are dealt to several.
HOT = 1 << 17
#: Rows that are broadcast at most.
SMALL = 200_000


def fingerprint(text: str | None) -> int:
    """The fingerprint of a text as an unsigned number; null and texts without words have 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - SHINGLE + 1)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)))) if len(words) >= SHINGLE else iter([b" ".join(words)])
    counts = np.zeros(BITS, np.int64)
    for _ in range(0, n, CHUNK):
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, islice(shingles, CHUNK), repeat(SEED)), np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


@F.arrow_udf(LongType())
def fingerprint_column(texts: pa.Array) -> pa.Array:
    return pa.array(np.array([fingerprint(t.as_py()) for t in texts], np.uint64).view(np.int64))


@cache
def _golay() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and the high 11 bits; for each syndrome what turns a block's upper 12 bits into those of the near code words, and the excess."""

    def rest(x: int) -> int:
        for i in range(22, 10, -1):
            if x >> i & 1:
                x ^= GOLAY << (i - 11)
        return x

    low, high = np.array([rest(i) for i in range(1 << 12)]), np.array([rest(i << 12) for i in range(1 << 11)])
    near: list[list[tuple[int, int]]] = [[] for _ in range(1 << 11)]
    for weight in range(RADIUS + THRESHOLD):  # excess up to 2
        for bits in combinations(range(23), weight):
            e = sum(1 << b for b in bits)
            near[low[e & 0xFFF] ^ high[e >> 12]].append((max(0, weight - RADIUS), e >> 11))
    width = max(map(len, near))
    turn, excess = np.zeros((1 << 11, width), np.int32), np.full((1 << 11, width), 99, np.int8)
    for s, found in enumerate(near):
        for k, (x, e) in enumerate(sorted(found)):
            excess[s, k], turn[s, k] = x, e
    return low, high, turn, excess


def anchors(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For fingerprints (uint64): the row, anchor and excess of each copy."""
    low, high, turn, excess = _golay()
    side = []
    for shift in (0, 23):
        block = (prints >> np.uint64(shift) & np.uint64((1 << 23) - 1)).astype(np.int64)
        s = low[block & 0xFFF] ^ high[block >> 12]
        side.append(((block >> 11)[:, None].astype(np.int32) ^ turn[s], excess[s]))
    total = side[0][1][:, :, None] + side[1][1][:, None, :]
    row, i, j = np.nonzero(total <= THRESHOLD - 1)
    return row, side[0][0][row, i] << 12 | side[1][0][row, j], total[row, i, j]


def _replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column(0).to_numpy(zero_copy_only=False)
        for at in range(0, len(prints), 2048):
            part = prints[at : at + 2048]
            row, anchor, excess = anchors(part.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(part[row]), pa.array(excess <= 1)], ["anchor", "fp", "near"])


def _union(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """label (each node's lower neighbour or itself) with the links u-v joined in."""
    while True:
        while not np.array_equal(up := label[label], label):
            label = up
        a, b = label[u], label[v]
        open_ = a != b
        if not open_.any():
            return label
        u, v, a, b = u[open_], v[open_], a[open_], b[open_]
        label = label.copy()
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))


def _near_pairs(anchor: np.ndarray, fp: np.ndarray, near: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row pairs of an anchor (sorted) at THRESHOLD or fewer differing bits, at least one of them near."""
    first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    size = np.diff(np.r_[first, len(anchor)])
    for at, n in zip(first[size > 2048], size[size > 2048]):
        vary = np.bitwise_or.reduce(fp[at : at + n] ^ fp[at])
        bits = [1 << i for i in range(BITS) if int(vary) >> i & 1]
        masks = sum(len(bits) ** k for k in (1, 2, 3))
        if masks < n:  # few bits differ in a large group: look each neighbour up instead of comparing all pairs
            order = np.argsort(fp[at : at + n], kind="stable")
            known = fp[at : at + n][order]
            for k in range(1, THRESHOLD + 1):
                for some in combinations(bits, k):
                    other = known ^ np.uint64(sum(some))
                    found = np.minimum(np.searchsorted(known, other), n - 1)
                    hit = np.flatnonzero(known[found] == other)
                    yield at + order[hit], at + order[found[hit]]
            size = np.where(first == at, 1, size)
    end = np.repeat(first + size, np.diff(np.r_[first, len(anchor)]))
    rows, lag = np.arange(len(anchor)), 1
    while len(rows := rows[rows + lag < end[rows]]):
        other = rows + lag
        hit = (np.bitwise_count(fp[rows] ^ fp[other]) <= THRESHOLD) & (near[rows] | near[other])
        if hit.any():
            yield rows[hit], other[hit]
        lag += 1


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links that connect the fingerprints of each cell, one fewer than those of a group at most. Rows come sorted by cell."""

    def links(cell: np.ndarray, fp: np.ndarray, near: np.ndarray) -> pa.RecordBatch | None:
        label = nodes = None
        wait: list[tuple[np.ndarray, np.ndarray]] = []
        waiting = 0

        def settle() -> None:
            nonlocal label, nodes, waiting
            if nodes is None:
                nodes = np.unique(fp)
                label = np.arange(len(nodes))
            u, v = (np.searchsorted(nodes, fp[np.concatenate(x)]) for x in zip(*wait))
            label = _union(label, u, v)
            wait.clear()
            waiting = 0

        for pair in _near_pairs(cell, fp, near):
            wait.append(pair)
            waiting += len(pair[0])
            if waiting > ROWS:
                settle()
        if wait:
            settle()
        if label is None:
            return None
        tied = np.flatnonzero(label != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[tied].view(np.int64)), pa.array(nodes[label[tied]].view(np.int64))], ["u", "v"])

    held: list[tuple[np.ndarray, ...]] = []
    rows, least = 0, ROWS
    for batch in batches:
        held.append((batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64), batch.column(2).to_numpy(zero_copy_only=False)))
        rows += batch.num_rows
        if rows >= least:
            cols = [np.concatenate(x) for x in zip(*held)]
            cut = int(np.searchsorted(cols[0], cols[0][-1]))  # the last cell may go on
            if cut and (out := links(*(c[:cut] for c in cols))):
                yield out
            held, rows = [tuple(c[cut:] for c in cols)], rows - cut
            least = max(ROWS, 2 * rows)
    if held and (out := links(*(np.concatenate(x) for x in zip(*held)))):
        yield out


def _cells(copies: DataFrame, hot: int, tables: Tables) -> DataFrame:
    """copies(anchor, fp, near) as (cell, fp, near): a cell for each anchor, and for those of more than hot copies one for each two parts of them.

    A part holds about half of hot, so any two copies of an anchor meet in a cell of about hot, and no cell grows with the input.
    """
    large = copies.groupBy("anchor").agg(F.count("*").alias("n")).where(F.col("n") > hot)
    large = tables.written(large.select("anchor", F.ceil(F.col("n") * 2 / hot).cast("int").alias("parts")), "hot")
    n = large.count()
    if not n:
        return copies.select(F.col("anchor").cast("long").alias("cell"), "fp", "near")
    large = F.broadcast(large) if n <= SMALL else large
    mine = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    other = F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1)))
    each = copies.join(large, "anchor", "left").withColumn("mine", F.coalesce(mine, F.lit(0))).withColumn("other", other)
    cell = F.xxhash64("anchor", F.least("mine", "other"), F.greatest("mine", "other"))
    return each.select(F.when(F.col("parts").isNull(), F.col("anchor").cast("long")).otherwise(cell).alias("cell"), "fp", "near")


def links(prints: DataFrame, tables: Tables, hot: int = HOT) -> DataFrame:
    """(u, v) links that connect the distinct fingerprints of prints(fp) as all pairs within THRESHOLD do."""
    copies = prints.select("fp").mapInArrow(_replicate, "anchor int, fp long, near boolean")
    dealt = _cells(copies, hot, tables).repartition("cell").sortWithinPartitions("cell")
    return dealt.mapInArrow(_compare, "u long, v long").distinct()


def groups(rows: DataFrame, tables: Tables) -> DataFrame:
    """(fp, component_id, keep) for each fingerprint of rows(rid, doc_id, fp): the least doc_id of its component, and the one rid that stays.

    A component without any doc_id has a null component_id; keep is then its least rid.
    """
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")
    each = tables.written(rows.groupBy("fp").agg(F.min(first).alias("low")), "prints")
    tied = tables.written(components(links(each, tables), tables), "tied")
    named = each.join(tied.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("label", "fp").alias("label"))
    least = named.groupBy("label").agg(F.min("low").alias("least"))
    return named.join(least, "label").select("fp", F.col("least.doc_id").alias("component_id"), F.col("least.rid").alias("keep"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for each row of docs(doc_id, text).

    Null and empty texts have fingerprint zero and link like any other; repeated rows each get a row; of tied rows
    the first place in the files names the rest; rows with a null doc_id belong to their component but never name
    it; an empty table gives none. Other columns are ignored, whatever their names. One row a document is kept in
    the shared folder until released().
    """
    with Tables(docs.sparkSession) as tables:
        marked = with_row_id(docs.select("doc_id", "text"), tables, "rid")
        rows = tables.written(marked.select("doc_id", "rid", fingerprint_column("text").alias("fp")), "rows")
        out = rows.join(groups(rows, tables), "fp")
        out = out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
        return tables.result(tables.keep(out, "components"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with one row of each component, that of the least doc_id, of equal ones the first in the files; columns as they came.

    Null and empty texts are near duplicates of one another, so one of them stays; rows with a null doc_id stay
    only where their component has no other; an empty table stays empty; columns of any name pass.
    """
    rid = f"{OWN}rid"
    with Tables(docs.sparkSession) as tables:
        marked = with_row_id(docs, tables)
        rows = tables.written(marked.select("doc_id", F.col(rid).alias("rid"), fingerprint_column("text").alias("fp")), "rows")
        gone = rows.join(groups(rows, tables), "fp").where(F.col("rid") != F.col("keep")).select(F.col("rid").alias(rid))
        return tables.result(without(marked, rid, tables.keep(gone, "gone")).select(*docs.columns))
