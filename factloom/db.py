"""A database value: facts at a basis, seen through a view; everything that reads goes through it."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace
from itertools import islice
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.edn import Keyword, Tagged, order
from factloom.functions.aggregates import aggregate, ordered, ranked
from factloom.plans import compile as plan
from factloom.plans import parse as parsing
from factloom.plans.parse import QueryError
from factloom.schema import SHIFT, Attribute, Schema
from factloom.sources.facts import LogSource, RelationalSource, View, log_text, tx_of, value_key

#: What a reader without the key sees of a sealed value.
REDACTED = Tagged("redacted", None)
ORDERS = {"eavt": ["e", "attr", "key", "tx"], "aevt": ["attr", "e", "key", "tx"], "avet": ["attr", "key", "e", "tx"], "vaet": ["key", "attr", "e", "tx"]}


@dataclass(frozen=True)
class Db:
    spark: SparkSession
    source: LogSource | RelationalSource
    schema: Schema
    basis_t: int = 0
    idents: dict[str, int] = field(default_factory=dict)
    hidden: frozenset[str] = frozenset()
    sealed: frozenset[str] = frozenset()  # protected attributes whose key the reader lacks

    # What the compiler asks

    def attribute(self, ident: Any) -> Attribute | None:
        """An attribute by keyword or id; None if the reader may not see it; unknown ones are errors."""
        if isinstance(ident, int):
            names = [n for n in self.schema.attributes if self.schema.id_of(n) == ident]
            if not names:
                raise QueryError(f"unknown attribute {ident}")
            ident = names[0]
        a = self.schema.get(ident)
        return None if a.ident in self.hidden else a

    def facts(self, a: Attribute) -> DataFrame:
        if a.ident not in self.sealed:
            return self.source.attribute(a)
        if a.protection.missing == "error":
            raise QueryError(f"no key of {a.protection.name} to read :{a.ident}")
        rows = self.source.attribute(a, sealed=True)
        return rows.where(F.lit(False)) if a.protection.missing == "hide" else rows

    def type_of(self, a: Attribute) -> str:
        """The type that a query sees; sealed values are of one type, which nothing but itself equals."""
        return "sealed" if a.ident in self.sealed else a.type

    def can_star(self, attributes: Sequence[Attribute]) -> bool:
        if any(a is None or a.many or a.ident in self.sealed for a in attributes):
            return False
        if isinstance(self.source, RelationalSource):
            return len({id(self.source.table_of(a)) for a in attributes}) == 1
        return self.source.view.kind != "history"

    def star(self, attributes: Sequence[Attribute]) -> DataFrame | None:
        return self.source.star(attributes)

    def everything(self, typed: bool = False) -> DataFrame:
        df = self.source.everything(typed)
        policy = {m: [i for i in self.sealed if self.schema.attributes[i].protection.missing == m] for m in ("hide", "error")}
        if hidden := sorted(self.hidden.union(policy["hide"])):
            df = df.where(~F.col("attr").isin(hidden))
        if failing := sorted(set(policy["error"]) - self.hidden):
            df = df.withColumn("v", F.when(F.col("attr").isin(failing), F.raise_error(F.concat(F.lit("no key to read :"), "attr"))).otherwise(F.col("v")))
        return df

    def resolve(self, value: Any) -> int | None:
        """An entity id from an id, an ident or a lookup reference; None if there is none."""
        if isinstance(value, int) and not isinstance(value, bool):
            return value
        if isinstance(value, Keyword):
            if value.name in self.idents:
                return self.idents[value.name]
            return self.schema.id_of(value.name) if value.name in self.schema.attributes else None
        if isinstance(value, (list, tuple)) and len(value) == 2 and isinstance(value[0], Keyword):
            return self.lookup(value[0], value[1])
        if isinstance(value, Tagged) and value.tag == "eid":
            return value.value
        raise QueryError(f"no entity: {value}")

    def lookup(self, ident: Any, value: Any) -> int | None:
        a = self.attribute(ident)
        if a is None:
            return None
        row = self.facts(a).where(plan.same((F.col("v"), self.type_of(a)), plan.coerced(value, a))).select("e").orderBy("e").first()
        return row and row[0]

    # Views

    def _at(self, view: View) -> Db:
        return replace(self, source=self.source.at(view))

    def current(self) -> Db:
        return self._at(View())

    def as_of(self, t: int | dt.datetime) -> Db:
        t = self.t_at(t)
        return self.current() if 0 < self.basis_t <= t else self._at(View("as-of", t))

    def since(self, t: int | dt.datetime) -> Db:
        return self._at(View("since", self.t_at(t)))

    def history(self) -> Db:
        return self._at(View("history"))

    def t_at(self, t: int | dt.datetime) -> int:
        """The last t committed at an instant or before; 0 if there is none."""
        if isinstance(t, int):
            return t
        rows = self.log().where((F.col("attr") == "db/txInstant") & (F.col("v_instant") <= F.lit(t)))
        return rows.agg(F.coalesce(F.max("t"), F.lit(0))).first()[0]

    def log(self) -> DataFrame:
        if not isinstance(self.source, LogSource):
            raise QueryError("wide tables have no log")
        return self.source.log

    def hiding(self, idents: Sequence[str]) -> Db:
        """The database for a reader who may not see some attributes: they never bind, join or show."""
        return replace(self, hidden=self.hidden | {i.lstrip(":") for i in idents})

    def with_(self, rows: DataFrame) -> Db:
        """A database with more log rows, without committing them."""
        source = replace(self.source, log=self.log().unionByName(rows), schema=self.schema)
        return replace(self, source=source, basis_t=self.basis_t + 1)

    # Raw access

    def datoms(self, index: str = "eavt", *prefix: Any, limit: int | None = None) -> DataFrame:
        """(e, attr, v, tx, added) in index order, v as EDN text; only what starts with prefix. Values are ordered and compared as their type is, attributes by name."""
        out = self._indexed(index)
        for column, x in zip(ORDERS[index], self._components(index, prefix)):
            out = out.where(F.col(column).eqNullSafe(x))
        return self._ordered(out, index, limit)

    def seek_datoms(self, index: str, *start: Any, limit: int | None = None) -> DataFrame:
        """datoms() from the first that is not before start."""
        columns = ORDERS[index][: len(start)]
        at = F.struct(*[x.alias(c) for c, x in zip(columns, self._components(index, start))])
        return self._ordered(self._indexed(index).where(F.struct(*columns) >= at), index, limit)

    def datoms_for_attribute(self, ident: Any) -> DataFrame:
        """(e, v, tx, added) of one attribute in order of e and v, v typed."""
        a = self.attribute(ident)
        out = self.facts(a) if a else self.spark.createDataFrame([], "e bigint, v string, tx bigint, added boolean")
        return out.orderBy("e", "v", "tx", "added")

    def values(self, entity: Any, ident: Any) -> DataFrame:
        """(v) of one entity and attribute."""
        a, e = self.attribute(ident), self.resolve(entity)
        none = a is None or e is None
        return self.spark.createDataFrame([], "v string") if none else self.facts(a).where((F.col("e") == e) & F.col("added")).select("v").orderBy("v")

    def _ordered(self, df: DataFrame, index: str, limit: int | None) -> DataFrame:
        df = df.orderBy(*ORDERS[index], "added")
        return (df if limit is None else df.limit(limit)).select("e", "attr", "v", "tx", "added")

    def _indexed(self, index: str) -> DataFrame:
        out = self.everything(typed=True)
        if index == "avet":
            return out.where(F.col("attr").isin([a.ident for a in self.schema.attributes.values() if a.indexed or a.unique]))
        if index == "vaet":
            return out.where(F.col("attr").isin([a.ident for a in self.schema.attributes.values() if a.type == "ref"]))
        return out

    def _components(self, index: str, given: Sequence[Any]) -> list[Column]:
        out, a = [], Attribute("x/x", "ref")  # in vaet all values are references
        for column, x in zip(ORDERS[index], given):
            if column == "attr":
                a = self.schema.get(x)
                out.append(F.lit(a.ident))
            elif column == "e":
                out.append(F.lit(self.resolve(x)).cast("bigint"))
            elif column == "tx":
                out.append(tx_of(F.lit(x).cast("bigint")) if x < 1 << SHIFT else F.lit(x).cast("bigint"))
            else:
                value, type_ = (F.lit(self.resolve(x)), "ref") if a.type == "ref" else plan.coerced(x, a)
                out.append(F.struct(*[c.alias(n) for n, c in value_key(value, type_).items()]))
        return out

    def index_range(self, ident: Any, start: Any = None, end: Any = None) -> DataFrame:
        """(e, v, tx) of an indexed or unique attribute with start <= v < end, by value."""
        a = self.attribute(ident)
        if a is None or not (a.indexed or a.unique):
            raise QueryError(f"{ident} isn't indexed")
        out = self.facts(a)
        if start is not None:
            out = out.where(F.col("v") >= plan.coerced(start, a)[0])
        if end is not None:
            out = out.where(F.col("v") < plan.coerced(end, a)[0])
        return out.select("e", "v", "tx").orderBy("v", "e")

    def tx_range(self, start: int | None = None, end: int | None = None) -> DataFrame:
        """(t, seq, e, attr, v, added) of start <= t < end, a row for each datom, in order of t and seq; v as EDN text.

        Rows of a log that was loaded may share t and seq: what follows in the order deals them to many tasks.
        """
        log = self.log()
        log = log if start is None else log.where(F.col("t") >= start)
        log = log if end is None else log.where(F.col("t") < end)
        return log.select("t", "seq", "e", "attr", log_text().alias("v"), "added").orderBy("t", "seq", "e", "attr", "v", "added")

    def recorded_since(self, t: int) -> DataFrame:
        return self.log().where(F.col("t") > t)

    def stats(self) -> DataFrame:
        """(attr, datoms, entities, values) of the view."""
        return self.everything().groupBy("attr").agg(F.count("*").alias("datoms"), F.count_distinct("e").alias("entities"), F.count_distinct("v").alias("values"))

    # Queries

    def q(self, query: Any, *inputs: Any, functions: dict | None = None) -> Result:
        return q(query, self, *inputs, functions=functions)

    def pull(self, pattern: Any, entity: Any) -> Any:
        from factloom.operators.pull import pull_many

        e = self.resolve(entity)
        return None if e is None else pull_many(self, pattern, [e])[0]

    def pull_many(self, pattern: Any, entities: Sequence[Any]) -> list:
        from factloom.operators.pull import pull_many

        return pull_many(self, pattern, [self.resolve(x) for x in entities])

    def entity(self, e: Any) -> Any:
        from factloom.operators.pull import Entity

        return Entity(self, self.resolve(e))


@dataclass
class Result:
    """What a query found: a DataFrame (df), and its EDN shape when it is asked for."""

    df: DataFrame
    shape: str
    types: list[str]
    pulls: dict[int, tuple] = field(default_factory=dict)

    def rows(self) -> list[list]:
        """The rows as Python values, in EDN order."""
        out = [[_python(x, t) for x, t in zip(row, self.types)] for row in self.df.collect()]
        for k, (db, pattern) in self.pulls.items():
            found = db.pull_many(pattern, [r[k] for r in out])
            for r, x in zip(out, found):
                r[k] = x
        return sorted(out, key=order)

    def chunks(self, size: int = 10_000) -> Iterator[list[list]]:
        """The rows as Python values, size at a time and in no order, fetched a partition at a time. Pull isn't applied."""
        rows = ([_python(x, t) for x, t in zip(row, self.types)] for row in self.df.toLocalIterator())
        while part := list(islice(rows, size)):
            yield part

    def value(self) -> Any:
        """A list of rows, a list of values, one row or one value, as :find says."""
        if self.shape == "rel":
            return self.rows()
        if self.shape == "coll":
            return [r[0] for r in self.rows()]
        rows = self.rows()
        if not rows:
            return None
        return rows[0] if self.shape == "tuple" else rows[0][0]


def _python(x: Any, type_: str) -> Any:
    if x is None:
        return None
    if type_.endswith("*"):
        return [_python(y, type_[:-1]) for y in x]
    if type_ == "keyword":
        return Keyword(str(x).lstrip(":"))
    if type_ == "sealed":
        return REDACTED
    if type_ == "any":
        from factloom.edn import read

        return read(x)
    return bytes(x) if type_ == "bytes" else x


def q(query: Any, *inputs: Any, functions: dict[str, tuple[Callable, Any, str]] | None = None) -> Result:
    """Runs a Datalog query; inputs go with its :in, where $ stands for databases and % for rules.

    functions: name -> (function of columns, result type, shape), shape being scalar, coll, tuple or rel.
    """
    parsed = parsing.parse(query)
    if len(inputs) != len(parsed.inputs):
        raise QueryError(f"the query has {len(parsed.inputs)} inputs, not {len(inputs)}")
    dbs = {x.name: v for x, v in zip(parsed.inputs, inputs) if isinstance(x, parsing.Symbol) and x.name.startswith("$")}
    if not dbs:
        raise QueryError("a query needs a database")
    any_ = next(iter(dbs.values()))
    ctx = plan.Context(any_.spark, dbs, functions=functions or {})
    frame = plan.Frame()
    for x, v in zip(parsed.inputs, inputs):
        if isinstance(x, parsing.Symbol) and x.name == "%":
            ctx.rules = plan.flattened(parsing.rules(v))
        elif not (isinstance(x, parsing.Symbol) and x.name.startswith("$")):
            frame = _input(ctx, frame, x, v, any_)
    ctx.recurs = plan.recursive(ctx.rules, parsed.where)
    needed = {f.var for f in parsed.find} | set(parsed.with_)
    frame = plan.conjunction(ctx, parsed.where, frame, needed)
    return _project(parsed, frame, dbs)


def _input(ctx: plan.Context, frame: plan.Frame, x: Any, v: Any, db: Db) -> plan.Frame:
    cell = lambda y: db.resolve(y) if isinstance(y, (list, tuple)) and len(y) == 2 and isinstance(y[0], Keyword) else y

    def checked(y: Any) -> Any:
        out = cell(y)
        if out is None:
            raise QueryError(f"no entity {y}")
        return out

    if isinstance(x, parsing.Symbol):
        names, rows = [x.name], [[checked(v)]]
    elif len(x) == 2 and isinstance(x[1], parsing.Symbol) and x[1].name == "...":
        names, rows = [x[0].name], [[checked(y)] for y in v]
    elif len(x) == 1 and isinstance(x[0], list):
        names, rows = [s.name for s in x[0]], [list(map(checked, r)) for r in v]
    else:
        names, rows = [s.name for s in x], [list(map(checked, v))]
    if any(len(r) != len(names) for r in rows):
        raise QueryError(f"an input doesn't fit {x}")
    keep = [k for k, n in enumerate(names) if n != "_"]
    part = plan.rows_frame(ctx.spark, [names[k] for k in keep], [[r[k] for k in keep] for r in rows])
    return plan.joined(frame, part, set(part.types))


def _project(query: parsing.Query, frame: plan.Frame, dbs: dict[str, Db]) -> Result:
    names = list(dict.fromkeys([f.var for f in query.find] + query.with_))
    base = frame.df.select(*[F.col(f"`{n}`") for n in names]).distinct()
    columns, types, pulls = [], [], {}
    label = lambda k, f: f.var.lstrip("?") if f.kind != "agg" else f"{f.op}_{f.var.lstrip('?')}"
    labels: list[str] = []
    for k, f in enumerate(query.find):
        name = label(k, f)
        labels.append(name if name not in labels else f"{name}_{k}")
    if any(f.kind == "agg" for f in query.find):
        keys = list(dict.fromkeys(f.var for f in query.find if f.kind != "agg"))
        aggs, apart = [], []
        for k, f in enumerate(query.find):
            if f.kind == "agg":
                type_ = frame.types[f.var]
                if ordered(f.op, f.n):
                    part, type_ = ranked(f.op, f.n, base, keys, f.var, type_, f"__a{k}")
                    apart.append(part)
                else:
                    column, type_ = aggregate(f.op, f.n, F.col(f"`{f.var}`"), type_)
                    aggs.append(column.alias(f"__a{k}"))
                columns.append(F.col(f"__a{k}").alias(labels[k]))
                types.append(type_)
            else:
                columns.append(F.col(f"`{f.var}`").alias(labels[k]))
                types.append(frame.types[f.var])
        # no rows, no group: not even one without keys
        df = base.groupBy(*[F.col(f"`{n}`") for n in keys]).agg(F.count(F.lit(1)).alias("__n"), *aggs).where("__n > 0")
        for part in apart:
            df = df.join(part, keys) if keys else df.crossJoin(part)
        df = df.select(*columns)
    else:
        df = base.select(*[F.col(f"`{f.var}`").alias(labels[k]) for k, f in enumerate(query.find)])
        df = df.distinct() if query.with_ == [] and len(names) != len(query.find) else df
        types = [frame.types[f.var] for f in query.find]
    for k, f in enumerate(query.find):
        if f.kind == "pull":
            pulls[k] = (dbs[f.source], f.pattern)
    if query.shape in ("tuple", "scalar") and not pulls:
        df = df.orderBy(*df.columns).limit(1)
    return Result(df, query.shape, types, pulls)
