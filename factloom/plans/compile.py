"""Datalog clauses to DataFrames.

Variables are columns and a set of bindings is a DataFrame, so joins, filters and aggregates are Catalyst's.
The compiler decides what Catalyst can't see: it orders clauses so that they stay connected, reads patterns
about one entity of one table in a single scan, drops variables that nothing needs any more, turns patterns
that bind nothing new into semi-joins, negation into anti-joins and recursion into a semi-naive loop.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from itertools import count
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.edn import Keyword, Tagged
from factloom.functions.builtins import FUNCTIONS, PREDICATES, comparable
from factloom.plans.demand import adorned, askable, calls, reach, recurring
from factloom.plans.parse import (BLANK, Const, Function, Not, Or, Pattern, Predicate, QueryError, Rule, RuleCall, Var, all_vars, bound_vars, needed_vars)
from factloom.schema import TYPES, Attribute
from factloom.sources.facts import edn_text

WHOLE = ("long", "ref", "instant")
#: Rounds of a recursion whose tables are read side by side before they are written as one.
TOGETHER = 16
#: Rows of a table or relation from which a query with recursion doesn't leave it to Spark whether to broadcast it: Spark
#: would go by the size of the compressed file.
MANY = 100_000


@dataclass
class Frame:
    """Bindings so far: a DataFrame with a column for each variable, or none yet, and the variables' types."""

    df: DataFrame | None = None
    types: dict[str, str] = field(default_factory=dict)

    def keep(self, names: set[str]) -> Frame:
        kept = [v for v in self.types if v in names]
        if self.df is None or len(kept) == len(self.types):
            return self
        df = self.df.select(*[F.col(f"`{v}`") for v in kept]) if kept else self.df.select(F.lit(1).alias("__any"))
        return Frame(df, {v: self.types[v] for v in kept})


@dataclass
class Context:
    spark: SparkSession
    dbs: dict[str, Any]
    rules: dict[str, list[Rule]] = field(default_factory=dict)
    functions: dict[str, Any] = field(default_factory=dict)
    done: dict[str, Frame] = field(default_factory=dict)  # relations of recursive rules
    fresh: Any = field(default_factory=count)
    within: bool = False  # a rule's body, within its fixpoint
    recurs: bool = False  # the query calls a recursive rule

    def db(self, source: str) -> Any:
        if source not in self.dbs:
            raise QueryError(f"no database {source}")
        return self.dbs[source]


def literal(value: Any) -> tuple[Column, str]:
    """A constant as a column, and its type."""
    if isinstance(value, bool):
        return F.lit(value), "boolean"
    if isinstance(value, int):
        return F.lit(value).cast("bigint"), "long"
    if isinstance(value, float):
        return F.lit(value), "double"
    if isinstance(value, Keyword):
        return F.lit(value.name), "keyword"
    if isinstance(value, Tagged) and value.tag == "uuid":
        return F.lit(value.value), "uuid"
    if hasattr(value, "timestamp"):
        return F.lit(int(value.timestamp() * 1000)).cast("bigint"), "instant"
    if isinstance(value, bytes):
        return F.lit(value), "bytes"
    if isinstance(value, str):
        return F.lit(value), "string"
    raise QueryError(f"no constant: {value}")


def same(x: tuple[Column, str], y: tuple[Column, str]) -> Column:
    """Whether two typed values are one value: references, integers and instants meet, other types don't."""
    (a, s), (b, t) = x, y
    if s == t or s in WHOLE and t in WHOLE:
        return a == b
    if "any" in (s, t):
        return (a if s == "any" else edn_text(a, s)) == (b if t == "any" else edn_text(b, t))
    return F.lit(False)


def coerced(value: Any, a: Attribute) -> tuple[Column, str]:
    """A constant in the value place of an attribute's pattern."""
    if isinstance(value, int) and not isinstance(value, bool):
        if a.type == "double":
            return F.lit(float(value)), "double"
        if a.type in WHOLE:
            return F.lit(value).cast("bigint"), a.type
    return literal(value)


def conjunction(ctx: Context, clauses: Sequence[Any], start: Frame, needed: set[str]) -> Frame:
    """start joined with all clauses; only needed variables stay."""
    left, frame = list(clauses), start
    narrow = bool(start.types)
    while left:
        i = _next(ctx, left, frame)
        clause = left.pop(i)
        live = needed.union(*map(_wants, left)) if left else set(needed)
        narrow = narrow or isinstance(clause, Predicate) or isinstance(clause, Pattern) and any(isinstance(clause.terms[k], Const) for k in (0, 2))
        if isinstance(clause, RuleCall):
            frame = _rule(ctx, clause, frame, live, narrow).keep(live)
        elif isinstance(clause, Or) and len(groups := _ragged(clause, set(frame.types))) > 1:
            # branches that leave a variable unbound go on without it, each with what follows
            parts = [conjunction(ctx, [replace(clause, branches=g), *left], frame, needed) for g in groups]
            lost = sorted(needed - set.intersection(*(set(p.types) for p in parts)))
            if lost:
                raise QueryError(f"some branches leave {' '.join(lost)} unbound")
            return united(parts, [n for n in parts[0].types if n in needed])
        else:
            frame = _apply(ctx, clause, frame, left, live).keep(live)
    return frame


def _ragged(c: Or, bound: set[str]) -> list[list]:
    """The branches of an or-join by which of its variables they bind."""
    groups: dict[frozenset, list] = {}
    for branch in c.branches:
        binds = set().union(*map(bound_vars, branch)) & set(c.join if c.join is not None else all_vars(c))
        groups.setdefault(frozenset(binds | bound), []).append(branch)
    return list(groups.values())


def _wants(c: Any) -> set[str]:
    """What a clause needs of the frame: for nested clauses all that could be shared."""
    if isinstance(c, Not) and c.join is None:
        return set().union(*map(_wants, c.clauses)) if c.clauses else set()
    return all_vars(c)


def _next(ctx: Context, left: list, frame: Frame) -> int:
    bound = set(frame.types)
    best = None
    for i, c in enumerate(left):
        others = [x for k, x in enumerate(left) if k != i]
        if isinstance(c, (Predicate, Function)):
            if not needed_vars(c) <= bound:
                continue
            rank = 0
        elif isinstance(c, Pattern):
            constants = sum(isinstance(t, Const) for t in c.terms[:3])
            connected = frame.df is None or bool(all_vars(c) & bound) or not all_vars(c)
            rank = (10 if connected else 40) - constants
        elif isinstance(c, RuleCall):
            rank = 20 if frame.df is None or all_vars(c) & bound else 41
            if not _required(ctx, c) <= bound:
                continue
        elif isinstance(c, Or):
            if not needed_vars(c) <= bound or not _open(c) <= bound:
                continue
            rank = 30
        else:
            outer = set().union(bound, *map(bound_vars, others))
            if (all_vars(c) & outer) - bound:
                continue
            rank = 5 if all_vars(c) & bound else 35
        if best is None or rank < best[0]:
            best = (rank, i)
    if best is None:
        missing = sorted(set().union(*map(needed_vars, left)) - bound)
        raise QueryError(f"unbound: {' '.join(missing) or left[0]}")
    return best[1]


def _open(c: Or) -> set[str]:
    """Variables that some branch of an or uses without binding them."""
    out = set()
    for branch in c.branches:
        bound = set().union(*map(bound_vars, branch))
        out |= (set().union(*map(needed_vars, branch)) - bound) & (set(c.join) if c.join is not None else set().union(*map(all_vars, branch)))
    return out


def _required(ctx: Context, c: RuleCall) -> set[str]:
    if c.name not in ctx.rules:
        raise QueryError(f"no rule {c.name}")
    rule = ctx.rules[c.name][0]
    if len(c.args) != len(rule.required) + len(rule.free):
        raise QueryError(f"{c.name} takes {len(rule.required) + len(rule.free)} arguments")
    return {t.name for t in c.args[: len(rule.required)] if isinstance(t, Var) and t != BLANK}


def _apply(ctx: Context, c: Any, frame: Frame, left: list, live: set[str]) -> Frame:
    if isinstance(c, Pattern):
        return _pattern(ctx, c, frame, left, live)
    if isinstance(c, Predicate):
        return _predicate(ctx, c, frame)
    if isinstance(c, Function):
        return _function(ctx, c, frame)
    if isinstance(c, Not):
        return _negation(ctx, c, frame)
    return _union(ctx, c.branches, sorted(c.join if c.join is not None else all_vars(c)), frame, live)


# Patterns

def _pattern(ctx: Context, c: Pattern, frame: Frame, left: list, live: set[str]) -> Frame:
    db = ctx.db(c.source)
    e, a, v, tx, added = c.terms
    if isinstance(a, Var):
        scan = _everything(ctx, db, c)
    else:
        attribute = db.attribute(a.value)
        group = [(c, attribute)]
        if isinstance(e, Var) and e != BLANK and tx == BLANK and added == BLANK:
            for other in [x for x in left if isinstance(x, Pattern) and x.source == c.source and x.terms[0] == e and isinstance(x.terms[1], Const) and x.terms[3:] == [BLANK, BLANK]]:
                more = db.attribute(other.terms[1].value)
                if attribute is not None and more is not None and more.ident not in [g[1].ident for g in group] and db.can_star([g[1] for g in group] + [more]):
                    group.append((other, more))
        star = db.star([g[1] for g in group]) if len(group) > 1 else None
        if star is not None:
            for other, _ in group[1:]:
                left[:] = [x for x in left if x is not other]
            scan = _bind(ctx, db, star.where(" and ".join(f"`{g.ident}` is not null" for _, g in group)), [(e, "e", "ref")] + [(g.terms[2], f"`{x.ident}`", x.type, x) for g, x in group])
        elif attribute is None:  # hidden
            scan = _bind(ctx, db, ctx.spark.createDataFrame([], "e bigint, v string, tx bigint, added boolean"), [(e, "e", "ref"), (v, "v", "string"), (tx, "tx", "ref"), (added, "added", "boolean")])
        else:
            scan = _bind(ctx, db, db.facts(attribute), [(e, "e", "ref"), (v, "v", db.type_of(attribute), attribute), (tx, "tx", "ref"), (added, "added", "boolean")])
    wanted = live.union(frame.types, *map(all_vars, left)) if left else live | set(frame.types)
    scan = scan.keep(wanted)
    if ctx.recurs and not isinstance(a, Var) and attribute is not None and db.source.many(attribute, MANY):
        scan = Frame(scan.df.hint("merge"), scan.types)
    return joined(frame, scan, live)


def recursive(rules: dict[str, list[Rule]], clauses: Sequence[Any]) -> bool:
    """Whether clauses call a recursive rule, directly or not."""
    start = "%"
    return any(n in reach(rules, n) for n in reach(rules | {start: [Rule(start, [], [], list(clauses))]}, start))


def _bind(ctx: Context, db: Any, df: DataFrame, places: list) -> Frame:
    """df filtered by the constants of a pattern, with its variables as columns; a variable in two places joins them."""
    at: dict[str, tuple[Column, str]] = {}
    for t, column, type_, *attribute in places:
        here = (F.col(column), type_)
        if isinstance(t, Const):
            if (column == "e" or type_ == "ref") and isinstance(t.value, (list, tuple)) and len(t.value) == 2 and isinstance(t.value[0], Keyword):
                df = _referred(db, df, column, t.value)
            elif column == "e" or type_ == "ref":
                value = db.resolve(t.value)
                df = df.where(F.lit(False)) if value is None else df.where(here[0] == F.lit(value).cast("bigint"))
            elif attribute:
                df = df.where(same(here, coerced(t.value, attribute[0])))
            else:
                df = df.where(same(here, literal(t.value)))
        elif t != BLANK:
            if t.name in at:
                df = df.where(same(at[t.name], here))
            else:
                at[t.name] = here
    df = df.select(*[c.alias(n) for n, (c, _) in at.items()]) if at else df.select(F.lit(1).alias("__any")).limit(1)
    return Frame(df, {n: t for n, (_, t) in at.items()})


def _referred(db: Any, df: DataFrame, column: str, ref: Any) -> DataFrame:
    """df where a column is the entity of a lookup reference: part of the plan, so nothing is read to compile it."""
    a = db.attribute(ref[0])
    if a is None:
        return df.where(F.lit(False))
    tag = f"__{uuid.uuid4().hex[:8]}"
    who = db.facts(a).where(same((F.col("v"), db.type_of(a)), coerced(ref[1], a))).select(F.col("e").alias(tag))
    return df.join(who, F.col(column) == F.col(tag), "left_semi")


def _everything(ctx: Context, db: Any, c: Pattern) -> Frame:
    e, a, v, tx, added = c.terms
    df = db.everything()
    if isinstance(v, Const):
        column, type_ = literal(v.value)
        df = df.where(F.col("v") == edn_text(column, type_))
        v = BLANK
    return _bind(ctx, db, df, [(e, "e", "ref"), (a, "attr", "keyword"), (v, "v", "any"), (tx, "tx", "ref"), (added, "added", "boolean")])


def joined(frame: Frame, other: Frame, live: set[str]) -> Frame:
    """The natural join: a semi-join where the other side has nothing new that is needed."""
    if frame.df is None:
        return other
    shared = [v for v in other.types if v in frame.types]
    new = [v for v in other.types if v not in frame.types and v in live]
    tag = f"__{uuid.uuid4().hex[:8]}_"
    right = other.df.select(*[F.col(f"`{v}`").alias(tag + v) for v in other.types]) if other.types else other.df
    on = [same((F.col(f"`{v}`"), frame.types[v]), (F.col(f"`{tag}{v}`"), other.types[v])) for v in shared]
    if not shared:
        right = right if new else right.limit(1)
        df = frame.df.crossJoin(right) if new else frame.df.join(right, F.lit(True), "left_semi")
    else:
        df = frame.df.join(right, on, "inner" if new else "left_semi")
    types = frame.types | {v: other.types[v] for v in new}
    return Frame(df.select(*[F.col(f"`{v}`") for v in frame.types], *[F.col(f"`{tag}{v}`").alias(v) for v in new]) if types else df, types)


# Predicates and functions

def _typed(ctx: Context, args: list, frame: Frame) -> list[tuple[Column, str]]:
    out = []
    for t in args:
        if isinstance(t, Const):
            out.append(literal(t.value))
        elif t == BLANK or t.name not in frame.types:
            raise QueryError(f"{t.name} isn't bound")
        else:
            out.append((F.col(f"`{t.name}`"), frame.types[t.name]))
    return out


def _some(ctx: Context, frame: Frame) -> Frame:
    return frame if frame.df is not None else Frame(ctx.spark.range(1).select(F.lit(1).alias("__any")), {})


def _predicate(ctx: Context, c: Predicate, frame: Frame) -> Frame:
    frame = _some(ctx, frame)
    if c.name == "missing?":
        e, a = c.args
        attribute = ctx.db(c.source).attribute(a.value)
        if attribute is None:
            return frame
        who = _typed(ctx, [e], frame)[0]
        return Frame(frame.df.join(ctx.db(c.source).facts(attribute).select(F.col("e").alias("__e")), same(who, (F.col("__e"), "ref")), "left_anti"), frame.types)
    args = _typed(ctx, c.args, frame)
    if any(t == "sealed" for _, t in args):  # satisfies nothing, not even a difference
        return Frame(frame.df.where(F.lit(False)), frame.types)
    if c.name in PREDICATES:
        return Frame(frame.df.where(PREDICATES[c.name](args, c.name)), frame.types)
    if c.name in ctx.functions:
        fn, type_, shape = ctx.functions[c.name]
        if type_ != "boolean" or shape != "scalar":
            raise QueryError(f"{c.name} isn't a predicate")
        return Frame(frame.df.where(fn(*[a for a, _ in args])), frame.types)
    raise QueryError(f"no predicate {c.name}")


def _set(frame: Frame, target: Any, value: tuple[Column, str]) -> Frame:
    """A value for a variable: a new column, or a filter where it is bound."""
    if target == BLANK:
        return frame
    if isinstance(target, Const):
        return Frame(frame.df.where(same(value, literal(target.value))), frame.types)
    if target.name in frame.types:
        return Frame(frame.df.where(same((F.col(f"`{target.name}`"), frame.types[target.name]), value)), frame.types)
    return Frame(frame.df.withColumn(target.name, value[0]), frame.types | {target.name: value[1]})


def _function(ctx: Context, c: Function, frame: Frame) -> Frame:
    frame = _some(ctx, frame)
    kind, target = c.binding
    if c.name == "ground":
        return _ground(ctx, c.args[0].value, kind, target, frame)
    if c.name == "get-else":
        return _get_else(ctx, c, frame, target)
    args = _typed(ctx, c.args, frame)
    if any(t == "sealed" for _, t in args):
        raise QueryError(f"{c.name} can't read a sealed value")
    if c.name in PREDICATES:
        value, shape = (PREDICATES[c.name](args, c.name), "boolean"), "scalar"
    elif c.name in FUNCTIONS:
        value, shape = FUNCTIONS[c.name](args, c.name), "scalar"
    elif c.name in ctx.functions:
        fn, type_, shape = ctx.functions[c.name]
        value = (fn(*[a for a, _ in args]), type_)
    else:
        raise QueryError(f"no function {c.name}")
    if kind == "scalar":
        return _set(frame, target, value)
    tag = f"__{uuid.uuid4().hex[:8]}"
    columns = [F.col(f"`{v}`") for v in frame.types]
    if kind == "coll" and shape == "coll":
        return _drop(_set(Frame(frame.df.select(*columns, F.explode(value[0]).alias(tag)), frame.types), target, (F.col(tag), value[1])))
    if kind == "tuple" and shape == "tuple" or kind == "rel" and shape == "rel":
        rows = frame.df.select(*columns, (F.explode(value[0]) if kind == "rel" else value[0]).alias(tag))
        names = rows.schema[tag].dataType.fieldNames()
        out = Frame(rows.where(F.lit(len(names) == len(target))), frame.types)
        for name, t, type_ in zip(names, target, value[1]):
            out = _set(out, t, (F.col(f"{tag}.`{name}`"), type_))
        return _drop(out)
    raise QueryError(f"{c.name} doesn't give a {kind}")


def _drop(frame: Frame) -> Frame:
    return Frame(frame.df.select(*[F.col(f"`{v}`") for v in frame.types]) if frame.types else frame.df, frame.types)


def rows_frame(spark: SparkSession, names: Sequence[str], rows: Sequence[Sequence[Any]]) -> Frame:
    """A relation of constants."""
    types: dict[str, str] = {}
    for k, n in enumerate(names):
        kinds = {literal(r[k])[1] for r in rows}
        types[n] = kinds.pop() if len(kinds) == 1 else "double" if kinds == {"long", "double"} else "any" if kinds else "string"
    if not rows:
        return Frame(spark.createDataFrame([], ", ".join(f"`{n}` string" for n in names)), types)
    cells = lambda r: [literal(float(x) if types[n] == "double" else x)[0] if types[n] != "any" else edn_text(*literal(x)) for n, x in zip(names, r)]
    array = F.array(*[F.struct(*[c.alias(n) for n, c in zip(names, cells(r))]) for r in rows])
    return Frame(spark.range(1).select(F.inline(array)), types)


def _ground(ctx: Context, value: Any, kind: str, target: Any, frame: Frame) -> Frame:
    if kind == "scalar":
        return _set(frame, target, literal(value))
    if kind == "tuple":
        if len(value) != len(target):
            return Frame(frame.df.where(F.lit(False)), frame.types)
        for t, x in zip(target, value):
            frame = _set(frame, t, literal(x))
        return frame
    targets, rows = ([target], [[x] for x in value]) if kind == "coll" else (target, [r for r in value if len(r) == len(target)])
    names = [t.name if isinstance(t, Var) and t != BLANK else f"__{k}" for k, t in enumerate(targets)]
    out = rows_frame(ctx.spark, names, rows)
    keep = {n: t for n, t in out.types.items() if not n.startswith("__")}
    return joined(frame if frame.types else Frame(), Frame(out.df.select(*[F.col(f"`{n}`") for n in keep]), keep), set(keep))


def _get_else(ctx: Context, c: Function, frame: Frame, target: Any) -> Frame:
    e, a, default = c.args
    db = ctx.db(c.source)
    attribute = db.attribute(a.value)
    other = coerced(default.value, attribute or Attribute("x/x", "string")) if isinstance(default, Const) else _typed(ctx, [default], frame)[0]
    if attribute is None:
        return _set(frame, target, other)
    tag = f"__{uuid.uuid4().hex[:8]}"
    values = db.facts(attribute).groupBy(F.col("e").alias(tag + "e")).agg(F.min("v").alias(tag + "v"))
    who = _typed(ctx, [e], frame)[0]
    df = frame.df.join(values, same(who, (F.col(tag + "e"), "ref")), "left")
    value = F.coalesce(F.col(tag + "v"), other[0]) if comparable(db.type_of(attribute), other[1]) else None
    if value is None:
        value, type_ = F.coalesce(edn_text(F.col(tag + "v"), db.type_of(attribute)), edn_text(*other)), "any"
    else:
        type_ = db.type_of(attribute)
    return _drop(_set(Frame(df, frame.types), target, (value, type_)))


# Negation and disjunction

def _negation(ctx: Context, c: Not, frame: Frame) -> Frame:
    frame = _some(ctx, frame)
    inner = set().union(*map(_wants, c.clauses)) if c.clauses else set()
    shared = sorted((set(c.join) if c.join is not None else inner) & set(frame.types))
    open_ = set().union(*(needed_vars(x) | (_open(x) if isinstance(x, Or) else set()) for x in c.clauses)) - set().union(*map(bound_vars, c.clauses))
    unbound = set(shared) - set().union(*map(bound_vars, c.clauses))
    seed = _seed(frame, shared) if (open_ | unbound) & set(shared) else Frame()
    clauses = c.clauses
    if c.join is not None:  # only the listed variables are the outer ones
        inner_names = _fresh(ctx, c.clauses, set(c.join))
        clauses = [renamed(x, inner_names) for x in c.clauses]
    body = conjunction(ctx, clauses, seed, set(shared))
    if not shared:
        return Frame(frame.df.join(body.df.limit(1).select(F.lit(1).alias("__none")), F.lit(True), "left_anti"), frame.types)
    tag = f"__{uuid.uuid4().hex[:8]}_"
    right = body.df.select(*[F.col(f"`{v}`").alias(tag + v) for v in shared])
    on = [same((F.col(f"`{v}`"), frame.types[v]), (F.col(f"`{tag}{v}`"), body.types[v])) for v in shared]
    return Frame(frame.df.join(right, on, "left_anti"), frame.types)


def _seed(frame: Frame, names: Sequence[str]) -> Frame:
    names = [n for n in names if n in frame.types]
    return Frame(frame.df.select(*[F.col(f"`{n}`") for n in names]).distinct(), {n: frame.types[n] for n in names}) if names else Frame()


def _union(ctx: Context, branches: list[list], names: Sequence[str], frame: Frame, live: set[str]) -> Frame:
    """Branches, each on its own or from the shared bindings where it needs them, united and joined back."""
    bound = [n for n in names if n in frame.types]
    parts = []
    for branch in branches:
        binds = set().union(*map(bound_vars, branch))
        needs = set().union(*map(_wants, branch))
        locals_ = _fresh(ctx, branch, set(names))
        body = [renamed(x, locals_) for x in branch]
        seed = _seed(frame, bound) if (needs - binds) & set(bound) or set(bound) - binds else Frame()
        parts.append(conjunction(ctx, body, seed, set(names)))
    if len({frozenset(set(p.types) & set(names)) for p in parts}) == 1:
        names = [n for n in names if n in parts[0].types]
    have = [n for n in names if all(n in p.types for p in parts)]
    for p in parts:
        if set(p.types) & set(names) - set(have):
            raise QueryError(f"some branches leave {sorted(set(names) - set(have))} unbound")
    out = united(parts, have)
    return joined(frame, out, live)


def united(parts: Sequence[Frame], names: Sequence[str]) -> Frame:
    types = {}
    for n in names:
        kinds = {p.types[n] for p in parts}
        types[n] = kinds.pop() if len(kinds) == 1 else ("ref" if "ref" in kinds else "long") if kinds <= set(WHOLE) else "any"
    df = None
    for p in parts:
        cols = [(edn_text(F.col(f"`{n}`"), p.types[n]) if types[n] == "any" and p.types[n] != "any" else F.col(f"`{n}`")).alias(n) for n in names]
        rows = p.df.select(*cols) if cols else p.df.select(F.lit(1).alias("__any")).limit(1)
        df = rows if df is None else df.unionByName(rows)
    return Frame(df.distinct(), types)


def _fresh(ctx: Context, clauses: Sequence[Any], outer: set[str]) -> dict[str, Any]:
    """New names for the variables of clauses that aren't outer ones."""
    inner = set().union(*map(_every_var, clauses)) if clauses else set()
    return {n: Var(f"{n}~{next(ctx.fresh)}") for n in inner - outer}


def _every_var(c: Any) -> set[str]:
    if isinstance(c, Not):
        return set().union(set(c.join or ()), *map(_every_var, c.clauses))
    if isinstance(c, Or):
        return set().union(set(c.join or ()), *(_every_var(x) for b in c.branches for x in b))
    return all_vars(c)


def renamed(c: Any, names: dict[str, Any]) -> Any:
    """A clause with variables replaced by other terms."""
    if not names:
        return c
    sub = lambda t: names.get(t.name, t) if isinstance(t, Var) else t
    if isinstance(c, Pattern):
        return replace(c, terms=list(map(sub, c.terms)))
    if isinstance(c, Function):
        kind, target = c.binding
        return replace(c, args=list(map(sub, c.args)), binding=(kind, list(map(sub, target)) if isinstance(target, list) else sub(target)))
    if isinstance(c, (Predicate, RuleCall)):
        return replace(c, args=list(map(sub, c.args)))
    join = None if c.join is None else [t.name for t in map(lambda n: sub(Var(n)), c.join) if isinstance(t, Var) and t != BLANK]
    if isinstance(c, Not):
        return Not([renamed(x, names) for x in c.clauses], join)
    return Or([[renamed(x, names) for x in b] for b in c.branches], join, [t.name for t in map(lambda n: sub(Var(n)), c.required) if isinstance(t, Var)])


# Rules

def flattened(rules: dict[str, list[Rule]]) -> dict[str, list[Rule]]:
    """Rules with a definition for each branch of an or that the recursion goes through, so that each round can see its calls."""
    fresh, out = count(), {}
    for name, definitions in rules.items():
        group, todo, done = recurring(rules, name), list(definitions), []
        while todo:
            rule = todo.pop(0)
            at = next((c for c in rule.clauses if isinstance(c, Or) and not c.required and any(x in group for x, _ in calls({name: [Rule(name, [], [], [c])]}, name))), None)
            if at is None:
                done.append(rule)
                continue
            rest = [c for c in rule.clauses if c is not at]
            for branch in at.branches:
                inner = set() if at.join is None else set().union(*map(_every_var, branch)) - set(at.join)
                names = {n: Var(f"{n}~{next(fresh)}") for n in inner}
                todo.append(replace(rule, clauses=rest + [renamed(c, names) for c in branch]))
        out[name] = done
    return out


def _rule(ctx: Context, c: RuleCall, frame: Frame, live: set[str], narrow: bool) -> Frame:
    _required(ctx, c)
    if _done(c) in ctx.done or c.name in reach(ctx.rules, c.name):
        return joined(frame, _called(_recursive(ctx, c, frame, narrow), c), live)
    branches, names = [], sorted({t.name for t in c.args if isinstance(t, Var) and t != BLANK})
    for rule in ctx.rules[c.name]:
        head = rule.required + rule.free
        sub = _fresh(ctx, rule.clauses, set(head))
        extra = []
        for h, t in zip(head, c.args):
            if isinstance(t, Const) or t == BLANK:
                sub[h] = Var(f"{h}~{next(ctx.fresh)}")
                if isinstance(t, Const):
                    extra.append(Function("ground", [t], ("scalar", sub[h])))
            elif h in [x for x, y in zip(head, c.args) if y == t][:1]:
                sub[h] = t
            else:
                sub[h] = t
        branches.append([*extra, *[renamed(_with_source(x, c.source), sub) for x in rule.clauses]])
    return _union(ctx, branches, names, frame, live)


def _with_source(c: Any, source: str) -> Any:
    """Rule bodies read the database that the call names."""
    if source == "$":
        return c
    if isinstance(c, Not):
        return Not([_with_source(x, source) for x in c.clauses], c.join)
    if isinstance(c, Or):
        return Or([[_with_source(x, source) for x in b] for b in c.branches], c.join, c.required)
    return replace(c, source=source) if c.source == "$" else c


def _called(relation: Frame, c: RuleCall) -> Frame:
    """A rule's relation with a call's arguments in place of its columns."""
    df, at = relation.df, {}
    for k, t in enumerate(c.args):
        here = (F.col(f"h{k}"), relation.types[f"h{k}"])
        if isinstance(t, Const):
            df = df.where(same(here, literal(t.value)))
        elif t != BLANK and t.name in at:
            df = df.where(same(at[t.name], here))
        elif t != BLANK:
            at[t.name] = here
    df = df.select(*[x.alias(n) for n, (x, _) in at.items()]) if at else df.select(F.lit(1).alias("__any")).limit(1)
    return Frame(df, {n: t for n, (_, t) in at.items()})


def _done(c: RuleCall) -> str:
    return c.name if c.source == "$" else f"{c.source} {c.name}"


def _recursive(ctx: Context, c: RuleCall, frame: Frame, narrow: bool) -> Frame:
    """A recursive rule's relation: all of it, or of a narrow frame's arguments what is asked for."""
    if _done(c) not in ctx.done:
        at = ctx if c.source == "$" else replace(ctx, dbs=ctx.dbs | {"$": ctx.db(c.source)}, done={})
        if not ctx.within and (narrow or any(isinstance(t, Const) for t in c.args)):
            found = demanded(at, c, frame)
            if found is not None:
                return found
        fixpoint(at, c.name)
        ctx.done[_done(c)] = at.done[c.name]
    return ctx.done[_done(c)]


def demanded(ctx: Context, c: RuleCall, frame: Frame) -> Frame | None:
    """What a recursive rule gives for the arguments that a call has in a frame; None if that can't be told apart from all it gives."""
    given = tuple(askable(t, set(frame.types)) for t in c.args)
    seed = f"{c.name}!{next(ctx.fresh)}"
    made = adorned(ctx.rules, c.name, given, seed)
    if made is None:
        return None
    rules, goal = made
    terms = [literal(t.value) if isinstance(t, Const) else (F.col(f"`{t.name}`"), frame.types[t.name]) for t, x in zip(c.args, given) if x]
    asked = _some(ctx, frame).df.select(*[x.alias(f"h{k}") for k, (x, _) in enumerate(terms)]).distinct()
    inner = replace(ctx, rules=rules, done=ctx.done | {seed: Frame(asked, {f"h{k}": t for k, (_, t) in enumerate(terms)})})
    fixpoint(inner, goal)
    return inner.done[goal]


def fixpoint(ctx: Context, name: str, most: int = 10_000) -> None:
    """The relations of a rule and of those it recurs with, by semi-naive iteration.

    A round joins what the last one found new with all there is, and keeps what is new in turn; each round's
    tables are checkpointed, so plans stay short. Negation within the recursion is refused.
    """
    group = recurring(ctx.rules, name)
    for n in group:
        if any(other in group and negated for other, negated in calls(ctx.rules, n)):
            raise QueryError(f"{n} recurs through not")
    total: dict[str, Frame] = {}
    rows = dict.fromkeys(group, 0)
    bases: dict[str, list[list[Any]]] = {n: [] for n in group}
    steps: list[tuple[str, Rule, list[Any]]] = []
    for n in group:
        for rule in ctx.rules[n]:
            recurs = any(x in group for x, _ in calls({n: [rule]}, n))
            (steps.append((n, rule, rule.clauses)) if recurs else bases[n].append(rule))
    inner = replace(ctx, done=dict(ctx.done), within=True)

    def body(rule: Rule, clauses: list[Any]) -> Frame:
        head = rule.required + rule.free
        out = conjunction(inner, clauses, Frame(), set(head))
        return Frame(out.df.select(*[F.col(f"`{v}`").alias(f"h{k}") for k, v in enumerate(head)]), {f"h{k}": out.types[v] for k, v in enumerate(head)})

    for n in group:
        if bases[n]:
            parts = [body(r, r.clauses) for r in bases[n]]
            total[n], rows[n] = _counted(_cut(united(parts, list(parts[0].types))))
    if name not in total and not total:
        raise QueryError(f"{name} has no definition that doesn't recur")
    while lacking := sorted(group - set(total)):  # found by calling the others, which tell the types
        n, rule = next(((n, r) for n in lacking for r in ctx.rules[n] if not {x for x, _ in calls({n: [r]}, n)} & set(lacking)), (None, None))
        if rule is None:
            raise QueryError(f"{' '.join(lacking)} can't be computed")
        inner.done |= total
        first = body(rule, rule.clauses)
        total[n] = Frame(first.df.limit(0), first.types)
    delta = dict(total)
    for round_ in range(most):
        found: dict[str, list[Frame]] = {n: [] for n in group}
        for n, rule, clauses in steps:
            places = [i for i, c in enumerate(clauses) if isinstance(c, RuleCall) and c.name in group]
            for i in places or [None]:  # one call sees what is new, the others everything
                inner.done |= {f"{g}": total[g] for g in group} | {f"{g}+": delta[g] for g in group}
                inner.rules = dict(ctx.rules) | {f"{g}+": ctx.rules[g] for g in group}
                found[n].append(body(rule, [replace(c, name=c.name + "+") if k == i else c for k, c in enumerate(clauses)]))
        new: dict[str, Frame] = {}
        for n in group:
            if not found[n]:
                new[n] = Frame(total[n].df.limit(0), total[n].types)
                continue
            every = united(found[n], list(total[n].types))
            names = list(total[n].types)
            old = total[n].df.select(*[F.col(x).alias(f"__{x}") for x in names])
            new[n] = _cut(Frame(every.df.join(old, [same((F.col(x), every.types[x]), (F.col(f"__{x}"), total[n].types[x])) for x in names], "left_anti"), every.types))
        fresh = {}
        for n in group:
            new[n], fresh[n] = _counted(new[n])
        more = [n for n in group if fresh[n]]
        if not more:
            break
        for n in more:  # rounds' tables are read together, and now and then written as one
            total[n] = Frame(total[n].df.unionByName(new[n].df), total[n].types)
            total[n] = _cut(total[n]) if round_ % TOGETHER == TOGETHER - 1 else total[n]
            rows[n] += fresh[n]
            total[n] = _weighed(total[n], rows[n])
        delta = new
    else:
        raise QueryError(f"{name} doesn't end after {most} rounds")
    ctx.done.update(total)


def _weighed(frame: Frame, rows: int) -> Frame:
    """A frame that joins don't broadcast if it has MANY rows."""
    return Frame(frame.df.hint("merge"), frame.types) if rows >= MANY else frame


def _counted(frame: Frame) -> tuple[Frame, int]:
    """_weighed() by its rows, and these."""
    rows = frame.df.count()
    return _weighed(frame, rows), rows


def _cut(frame: Frame) -> Frame:
    return Frame(cut(frame.df), frame.types)


def cut(df: DataFrame) -> DataFrame:
    """df computed, with its lineage cut by a checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and context.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or f"/tmp/checkpoints/{context.applicationId}")
    return df.checkpoint()
