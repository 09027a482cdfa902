"""SQL over facts: a wide view for each namespace, and the facts themselves."""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.db import Db
from factloom.plans.parse import QueryError
from factloom.schema import TYPES

_TOKEN = re.compile(r"'(?:[^']|'')*'|`[^`]*`|\"[^\"]*\"|--[^\n]*|/\*.*?\*/|\$\d+|\w+|\s+|.", re.S)
_WRITES = re.compile(r"^\s*(insert|update|delete|merge|create|drop|alter|truncate|replace|grant|set|use|cache|refresh|load)\b", re.I)


@dataclass(frozen=True, eq=False)
class Token:
    text: str
    depth: int  # brackets around it; a bracket has that of what is outside


def tokens(sql: str) -> list[Token]:
    """Words, quoted parts, blanks and single signs; comments are blanks."""
    out, depth = [], 0
    for m in _TOKEN.finditer(sql):
        x = m.group()
        depth -= x in (")", "]")
        out.append(Token(" " if x.startswith(("--", "/*")) else x, depth))
        depth += x in ("(", "[")
    return out


def name_of(t: Token) -> str:
    """A name as written if it is quoted, else in lower case."""
    if t.text[0] in "\"`":
        return t.text[1:-1]
    if not re.fullmatch(r"\w+", t.text):
        raise QueryError(f"{t.text} isn't a name")
    return t.text.lower()


def _spoken(sql: str) -> str:
    """The caller's dialect in Spark's: $1, ARRAY[...], array_has, sys.datoms and names in double quotes."""
    found, out, arrays, i = tokens(sql), [], [], 0
    while i < len(found):
        t, after = found[i], found[i + 1].text if i + 1 < len(found) else ""
        word = t.text.lower()
        if t.text[0] == "$" and len(t.text) > 1:
            out.append(f":p{t.text[1:]}")
        elif t.text[0] == '"' and len(t.text) > 1:
            out.append(f"`{t.text[1:-1]}`")
        elif word == "array" and after == "[":
            out.append("array(")
            arrays.append(t.depth)
            i += 1
        elif t.text == "]" and arrays and arrays[-1] == t.depth:
            out.append(")")
            arrays.pop()
        elif word == "array_has":
            out.append("array_contains")
        elif word == "sys" and after == "." and i + 2 < len(found) and found[i + 2].text.lower() in ("datoms", "attributes", "idents"):
            out.append(f"sys_{found[i + 2].text.lower()}")
            i += 2
        else:
            out.append(t.text)
        i += 1
    return "".join(out)


class SqlSession:
    """One database value as views in a session of its own: <namespace>, _global, sys_datoms, sys_attributes and sys_idents."""

    def __init__(self, db: Db):
        self.db, self.spark = db, db.spark.newSession()
        self.namespaces: list[str] = []
        current = not (hasattr(db.source, "view") and db.source.view.kind == "history")
        for ns in dict.fromkeys(a.namespace for a in db.schema.attributes.values()) if current else ():
            if ns not in ("db", "db.install"):
                self._register(self.table(ns), ns or "_global")
                self.namespaces.append(ns or "_global")
        self._register(db.everything(), "sys_datoms")
        rows = [(db.schema.id_of(a.ident), a.ident, a.type, "many" if a.many else "one", a.unique, a.component, a.indexed, a.no_history, a.doc) for a in db.schema.attributes.values()]
        self._register(db.spark.createDataFrame(rows, "id long, ident string, value_type string, cardinality string, uniqueness string, component boolean, indexed boolean, no_history boolean, doc string"), "sys_attributes")
        self._register(db.spark.createDataFrame([(r[1], r[0]) for r in rows], "ident string, e long"), "sys_idents")

    def _register(self, df: DataFrame, name: str) -> None:
        DataFrame(self._rewrapped(df), self.spark).createOrReplaceTempView(f"`{name}`")

    def _rewrapped(self, df: DataFrame) -> Any:
        jvm = self.spark._jvm
        return jvm.org.apache.spark.sql.classic.Dataset.ofRows(self.spark._jsparkSession, df._jdf.queryExecution().analyzed())

    def table(self, ns: str) -> DataFrame:
        """A row for each entity with an attribute of the namespace: null where one is absent, [] where many are."""
        mine = [a for a in self.db.schema.attributes.values() if a.namespace == ns]
        if any(a.name == "e" for a in mine):
            raise QueryError(f"namespace {ns} has an attribute e")
        seen = [a for a in mine if a.ident not in self.db.hidden]
        out = star = None
        if seen and hasattr(self.db.source, "wide"):
            star = self.db.source.wide(seen)
        elif len(seen) > 1 and self.db.can_star(seen):
            star = self.db.star(seen)
        if star is not None:
            cell = lambda a: F.array_sort(F.transform(f"`{a.ident}`", lambda x: self._shown(x, a))) if a.many else self._shown(F.col(f"`{a.ident}`"), a)
            out = star.select("e", *[(F.coalesce(cell(a), F.array().cast(f"array<{self._type(a)}>")) if a.many else cell(a)).alias(a.name) for a in seen])
            out = out.where(" or ".join(f"size(`{a.name}`) > 0" if a.many else f"`{a.name}` is not null" for a in seen))
        if out is None:
            parts = [self._facts(a).select("e", F.lit(a.name).alias("n"), *[(self._cell(a) if b == a else F.lit(None).cast(self._type(b))).alias(b.name) for b in seen]) for a in seen]
            rows = parts[0]
            for p in parts[1:]:
                rows = rows.unionByName(p)
            aggs = [(F.coalesce(F.array_sort(F.collect_set(a.name)), F.array().cast(f"array<{self._type(a)}>")) if a.many else self._only(a)).alias(a.name) for a in seen]
            out = rows.groupBy("e").agg(*aggs)
        for a in mine:
            if a not in seen:  # a reader who may not see it finds nothing there
                out = out.withColumn(a.name, F.array().cast(f"array<{self._type(a)}>") if a.many else F.lit(None).cast(self._type(a)))
        return out.select("e", *[a.name for a in mine])

    def _facts(self, a: Any) -> DataFrame:
        return self.db.source.attribute(a, sealed=True) if a.ident in self.db.sealed and a.protection.missing != "hide" else self.db.facts(a)

    def _cell(self, a: Any) -> Any:
        """A value as a column of the view: null where it is sealed, or an error if its class says so and it is read."""
        if a.ident not in self.db.sealed:
            return self._shown(F.col("v"), a)
        none = F.lit(None)
        return (F.raise_error(F.lit(f"no key to read :{a.ident}")) if a.protection.missing == "error" else none).cast(self._type(a))

    @staticmethod
    def _only(a: Any) -> Any:
        values = F.collect_set(a.name)
        return F.when(F.size(values) <= 1, F.get(values, 0)).otherwise(F.raise_error(F.lit(f":{a.ident} has several values")))

    @staticmethod
    def _type(a: Any) -> str:
        return "timestamp" if a.type == "instant" else TYPES[a.type][1]

    @staticmethod
    def _shown(c: Any, a: Any) -> Any:
        if a.type == "instant":
            return F.timestamp_millis(c)
        return F.concat(F.lit(":"), F.ltrim(c, F.lit(":"))) if a.type == "keyword" else c

    def query(self, sql: str, *params: Any) -> DataFrame:
        """A SELECT; $1, $2 ... are params; array_has, ARRAY[...] and sys.datoms are understood."""
        if _WRITES.match(sql):
            raise QueryError("only queries are allowed here")
        return self.spark.sql(_spoken(sql), args={f"p{k}": v for k, v in enumerate(params, 1)})

    def tables(self) -> list[str]:
        return [*self.namespaces, "sys_datoms", "sys_attributes", "sys_idents"]
