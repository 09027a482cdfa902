"""Where facts come from: an append-only log, or ordinary wide tables seen as facts."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from functools import cached_property, partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.schema import SHIFT, TX, TYPES, Attribute, Schema

VALUES = [(column, {"v_instant": "timestamp", "v_bool": "boolean", "v_bytes": "binary", "v_double": "double", "v_long": "bigint", "v_ref": "bigint"}.get(column, "string")) for column, _ in TYPES.values()]
#: A row of the log: one assertion or retraction; seq is its place in its transaction.
LOG = "e bigint, a bigint, attr string, vt string, " + ", ".join(f"{c} {t}" for c, t in VALUES) + ", t bigint, seq int, added boolean"


#: Bytes of a log, as Spark estimates them, that one task folds; below FEW_SHARES of them Spark chooses the tasks.
SHARE, FEW_SHARES, MOST_SHARES = 16 << 20, 12, 20_000

#: What value_key() gives.
KEY = {"n": "bigint", "d": "double", "s": "string", "b": "binary"}
KEY_TYPE = ",key:struct<" + ",".join(f"{n}:{t}" for n, t in KEY.items()) + ">"
#: Signs of a string and what stands for them in EDN; the backslash first.
ESCAPES = (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r"))


def tx_of(t: Column) -> Column:
    return F.lit(TX << SHIFT).bitwiseOR(t)


def shown(column: Column, type_: str) -> Column:
    """A log value as a query sees it: instants in milliseconds."""
    return F.unix_millis(column) if type_ == "instant" else column


@dataclass(frozen=True)
class View:
    """current, as-of t (inclusive), since t (exclusive) or history; each replaces the one before."""

    kind: str = "current"
    t: int | None = None


def _last(log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of each fact, what was last said of it.

    A maximum of structs is found by sorting. Few facts recur in a part of a file, so rows are dealt by their keys before
    it, and those of a large log to as many tasks as it has shares: a task's memory doesn't follow the log.
    """
    shares = int(log._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) // SHARE
    dealt = log.repartition(min(shares, MOST_SHARES), *keys) if shares >= FEW_SHARES else log.repartition(*keys)
    return dealt.groupBy(*keys).agg(F.max(F.struct("t", "seq", "added")).alias("last"))


def folded(log: DataFrame, view: View, keys: Sequence[str], no_history: Sequence[str] = ()) -> DataFrame:
    """The log's rows that a view shows: of each fact the last, if it asserts, but all in history."""
    if view.kind == "history":
        return log.where(~F.col("attr").isin(list(no_history))) if no_history else log
    if view.kind == "as-of":
        log = log.where(F.col("t") <= view.t)
    last = _last(log, keys).where("last.added")
    out = last.select(*keys, "last.t", "last.seq", "last.added")
    return out.where(F.col("t") > view.t) if view.kind == "since" else out


@dataclass(frozen=True)
class LogSource:
    """Facts of a log DataFrame (see LOG), and maybe a snapshot: the log's rows that were current at snapshot_t.

    Views of a basis at the snapshot or later read it with the log after it, so the log before it isn't folded again.
    """

    log: DataFrame
    schema: Schema
    view: View = field(default_factory=View)
    snapshot: DataFrame | None = None
    snapshot_t: int = 0

    def _folded(self, shape: Callable[[DataFrame], DataFrame], keys: Sequence[str], no_history: Sequence[str] = ()) -> DataFrame:
        """folded() of shape(log), where shape filters and projects rows."""
        view = self.view
        if self.snapshot is None or view.kind == "history" or view.kind == "as-of" and view.t < self.snapshot_t:
            return folded(shape(self.log), view, keys, no_history)
        tail = self.log.where(F.col("t") > self.snapshot_t)
        tail = tail.where(F.col("t") <= view.t) if view.kind == "as-of" else tail
        last = _last(shape(tail), keys)
        touched = last.select(*[F.col(k).alias(f"__{k}") for k in keys])
        names = [*keys, "t", "seq", "added"]
        # no shuffle of the snapshot while what came after it is small
        kept = shape(self.snapshot).join(touched, reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]), "left_anti").select(*names)
        out = kept.unionByName(last.where("last.added").select(*keys, "last.t", "last.seq", "last.added"))
        return out.where(F.col("t") > view.t) if view.kind == "since" else out

    def current(self) -> DataFrame:
        """The log's own rows that the view shows."""
        return self._folded(lambda log: log, [c for c in self.log.columns if c not in ("t", "seq", "added")])

    def attribute(self, a: Attribute, sealed: bool = False) -> DataFrame:
        """(e, v, tx, added) of one attribute; v is ciphertext if sealed."""
        column = "v_bytes" if sealed else TYPES[a.type][0]
        shape = lambda log: log.where(F.col("attr") == a.ident).select("e", "attr", F.col(column).alias("v"), "t", "seq", "added")
        rows = self._folded(shape, ["e", "attr", "v"], [x.ident for x in self.schema.attributes.values() if x.no_history])
        return rows.select("e", (F.col("v") if sealed else shown(F.col("v"), a.type)).alias("v"), tx_of(F.col("t")).alias("tx"), "added")

    def star(self, attributes: Sequence[Attribute]) -> DataFrame | None:
        """(e, one column an attribute) for cardinality-one attributes, in one scan: a pivot by entity."""
        if self.view.kind == "history" or any(a.many for a in attributes) or len(attributes) < 2:
            return None
        rows = self._folded(lambda log: log.where(F.col("attr").isin([a.ident for a in attributes])), ["e", "attr", *dict.fromkeys(TYPES[a.type][0] for a in attributes)])
        picks = [F.max(F.when(F.col("attr") == a.ident, F.col(TYPES[a.type][0]))).alias(a.ident) for a in attributes]
        out = rows.groupBy("e").agg(*picks)
        return out.select("e", *[shown(F.col(f"`{a.ident}`"), a.type).alias(a.ident) for a in attributes])

    def everything(self, typed: bool = False) -> DataFrame:
        """(e, attr, v, tx, added) with v as EDN text, for patterns whose attribute is a variable; typed: and with key, which orders values of a type."""
        columns = [c for c, _ in VALUES]
        rows = self._folded(lambda log: log.where(F.col("attr").isin(list(self.schema.attributes))), ["e", "attr", "vt", *columns], [x.ident for x in self.schema.attributes.values() if x.no_history])
        keys = [F.coalesce(*[value_key(shown(F.col(column), t), t)[n] for t, (column, _) in TYPES.items()]).alias(n) for n in KEY]
        more = [F.struct(*keys).alias("key")] if typed else []
        return rows.select("e", "attr", log_text().alias("v"), tx_of(F.col("t")).alias("tx"), "added", *more)

    def many(self, a: Attribute, rows: int) -> bool:
        """Whether there may be so many facts of an attribute; by the log's size, as they aren't counted."""
        return int(self.log._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) >= SHARE

    def at(self, view: View) -> LogSource:
        return replace(self, view=view)


@dataclass(frozen=True)
class Table:
    """A wide table as facts: a key expression (SQL), a partition for entity ids, and attributes as SQL over its columns."""

    frame: DataFrame
    key: str
    partition: int
    columns: dict[str, str]  # ident -> SQL expression; references are already entity ids

    @cached_property
    def rows(self) -> int:
        return self.frame.count()


@dataclass(frozen=True)
class RelationalSource:
    """Wide tables as current facts, without copying; null columns are absent facts."""

    tables: tuple[Table, ...]
    schema: Schema

    def table_of(self, a: Attribute) -> Table:
        return next(t for t in self.tables if a.ident in t.columns)

    def _scan(self, table: Table, attributes: Sequence[Attribute]) -> DataFrame:
        """(e, one column an attribute); of many-valued attributes, whose SQL gives arrays, the set as an array."""
        e = entity(table.partition, table.key).alias("e")
        return table.frame.select(e, *[self._cell(a, F.expr(table.columns[a.ident])).alias(a.ident) for a in attributes])

    @staticmethod
    def _cell(a: Attribute, v: Column) -> Column:
        one = (lambda x: F.unix_millis(x.cast("timestamp"))) if a.type == "instant" else (lambda x: x.cast(TYPES[a.type][1]))
        return F.array_distinct(F.filter(F.transform(v, one), lambda x: x.isNotNull())) if a.many else one(v)

    def attribute(self, a: Attribute, sealed: bool = False) -> DataFrame:
        out = self._scan(self.table_of(a), [a])
        v = F.explode(f"`{a.ident}`") if a.many else F.col(f"`{a.ident}`")
        out = out.select("e", v.alias("v")).where("v is not null")
        return out.select("e", "v", F.lit(TX << SHIFT).alias("tx"), F.lit(True).alias("added"))

    def star(self, attributes: Sequence[Attribute]) -> DataFrame | None:
        table = self.table_of(attributes[0])
        if any(a.many or a.ident not in table.columns for a in attributes):
            return None
        return self._scan(table, attributes)

    def wide(self, attributes: Sequence[Attribute]) -> DataFrame | None:
        """star() with many-valued attributes as arrays."""
        table = self.table_of(attributes[0])
        return self._scan(table, attributes) if all(a.ident in table.columns for a in attributes) else None

    def everything(self, typed: bool = False) -> DataFrame:
        out = None
        for table in self.tables:
            attributes = [self.schema.attributes[i] for i in table.columns if i in self.schema.attributes]

            def fact(a: Attribute, v: Column) -> Column:
                fields = [F.lit(a.ident).alias("attr"), edn_text(v, a.type).alias("v")]
                return F.struct(*fields, F.struct(*[c.alias(n) for n, c in value_key(v, a.type).items()]).alias("key")) if typed else F.struct(*fields)

            one = [F.transform(f"`{a.ident}`", partial(fact, a)) if a.many else F.array(fact(a, F.col(f"`{a.ident}`"))) for a in attributes]
            none = F.array().cast(f"array<struct<attr:string,v:string{KEY_TYPE if typed else ''}>>")
            pairs = F.concat(*[F.coalesce(x, none) for x in one])
            rows = self._scan(table, attributes).select("e", F.inline(pairs)).where("v is not null")
            rows = rows.select("e", "attr", "v", F.lit(TX << SHIFT).alias("tx"), F.lit(True).alias("added"), *(["key"] if typed else []))
            out = rows if out is None else out.unionByName(rows)
        return out

    def many(self, a: Attribute, rows: int) -> bool:
        """Whether the table that has an attribute has so many rows."""
        return self.table_of(a).rows >= rows

    def at(self, view: View) -> RelationalSource:
        if view.kind != "current":
            raise ValueError("wide tables have no history")
        return self


def entity(partition: int, key: str) -> Column:
    return F.lit(partition << SHIFT).bitwiseOR(F.expr(key).cast("bigint"))


def reference(partition: int, key: str) -> str:
    """SQL for a reference to the entity that has this key in a partition."""
    return f"({partition << SHIFT}L | cast({key} as bigint))"


def key_of(e: str) -> str:
    """SQL for the key in an entity id."""
    return f"({e} & {(1 << SHIFT) - 1}L)"


def edn_text(v: Column, type_: str) -> Column:
    """A value as EDN text, equal for equal values: what a value of unknown type is compared by."""
    if type_ == "string":
        for sign, escaped in ESCAPES:
            v = F.replace(v, F.lit(sign), F.lit(escaped))
        return F.concat(F.lit('"'), v, F.lit('"'))
    if type_ == "uuid":
        return F.concat(F.lit('#uuid "'), v, F.lit('"'))
    if type_ == "keyword":
        return F.concat(F.lit(":"), F.ltrim(v, F.lit(":")))
    if type_ in ("bytes", "sealed"):
        return F.concat(F.lit(f"#{type_} "), F.lit('"' if type_ == "sealed" else ""), F.hex(v), F.lit('"' if type_ == "sealed" else ""))
    return v.cast("string")


def value_key(v: Column, type_: str) -> dict[str, Column]:
    """What orders values of one type, as columns of which one isn't null: number, double, text or bytes."""
    kind = {"double": "d", "string": "s", "keyword": "s", "uuid": "s", "bytes": "b", "sealed": "b"}.get(type_, "n")
    v = F.ltrim(v, F.lit(":")) if type_ == "keyword" else v
    return {n: (v if n == kind else F.lit(None)).cast(t) for n, t in KEY.items()}


def log_text() -> Column:
    """A log row's value as EDN text."""
    plain = F.coalesce(*[edn_text(shown(F.col(column), t), t) for t, (column, _) in TYPES.items()])
    return F.when(F.col("vt") == "sealed", edn_text(F.col("v_bytes"), "sealed")).otherwise(plain)


def read_log(spark: SparkSession, path: str, until: int | None = None) -> DataFrame:
    """The committed transactions under path; until pins the basis."""
    schema = T._parse_datatype_string(LOG)
    out = spark.read.schema(schema).option("basePath", path).parquet(path)
    return out if until is None else out.where(F.col("t") <= until)

