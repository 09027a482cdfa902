"""Datalog queries: from EDN to clauses, with the checks that need no data."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache
from typing import Any

from factloom.plans import build
from factloom.edn import EdnList, Keyword, Symbol, read


class QueryError(ValueError):
    pass


@dataclass(frozen=True)
class Var:
    name: str


@dataclass(frozen=True)
class Const:
    value: Any


BLANK = Var("_")


@dataclass
class Pattern:
    source: str
    terms: list  # e, a, v, tx, added


@dataclass
class Predicate:
    name: str
    args: list
    source: str = "$"


@dataclass
class Function:
    name: str
    args: list
    binding: Any  # ("scalar", var) | ("tuple", [vars]) | ("coll", var) | ("rel", [vars])
    source: str = "$"


@dataclass
class Not:
    clauses: list
    join: list | None = None


@dataclass
class Or:
    branches: list
    join: list | None = None
    required: list = field(default_factory=list)


@dataclass
class RuleCall:
    name: str
    args: list
    source: str = "$"


@dataclass
class Rule:
    name: str
    required: list
    free: list
    clauses: list


@dataclass
class Find:
    """A find element: a variable, an aggregate or a pull."""

    kind: str
    var: str
    op: str = ""
    n: int | None = None
    pattern: Any = None
    source: str = "$"


@dataclass
class Query:
    shape: str
    find: list
    with_: list
    inputs: list
    where: list


def _name(x: Any) -> str | None:
    return x.name if isinstance(x, Symbol) else None


def is_var(x: Any) -> bool:
    return isinstance(x, Symbol) and x.name.startswith("?")


def term(x: Any) -> Any:
    if isinstance(x, Symbol):
        if x.name == "_":
            return BLANK
        if x.name.startswith("?"):
            return Var(x.name)
    return Const(x)


@lru_cache(maxsize=512)
def _cached(text: str) -> Query:
    return _parse(read(text))


def parse(query: Any) -> Query:
    if isinstance(query, build.Query):
        query = str(query)
    return _cached(query) if isinstance(query, str) else _parse(query)


def _parse(form: Any) -> Query:
    if isinstance(form, dict):
        parts = {k.name: v for k, v in form.items()}
    elif isinstance(form, list):
        parts, now = {}, None
        for x in form:
            if isinstance(x, Keyword) and x.name in ("find", "with", "in", "where"):
                now = parts.setdefault(x.name, [])
            elif now is None:
                raise QueryError("a query starts with :find")
            else:
                now.append(x)
    else:
        raise QueryError("a query is a vector or a map")
    if not parts.get("find"):
        raise QueryError("a query needs :find")
    shape, elements = _find_shape(list(parts["find"]))
    inputs = list(parts.get("in", [Symbol("$")]))
    query = Query(shape, [_find(x) for x in elements], [x.name for x in parts.get("with", [])], inputs, [clause(c) for c in parts.get("where", [])])
    bound = set().union(*map(bound_vars, query.where), *map(_input_vars, inputs))
    for v in [f.var for f in query.find] + query.with_:
        if v not in bound:
            raise QueryError(f"{v} isn't bound")
    return query


def _find_shape(find: list) -> tuple[str, list]:
    if len(find) == 2 and _name(find[1]) == ".":
        return "scalar", find[:1]
    if len(find) == 1 and isinstance(find[0], list):
        inner = find[0]
        if len(inner) == 2 and _name(inner[1]) == "...":
            return "coll", inner[:1]
        return "tuple", inner
    return "rel", find


def _find(x: Any) -> Find:
    if is_var(x):
        return Find("var", x.name)
    if isinstance(x, (EdnList, list)) and x:
        head = _name(x[0])
        if head == "pull":
            rest = list(x[1:])
            source = rest.pop(0).name if _name(rest[0]) and rest[0].name.startswith("$") else "$"
            return Find("pull", rest[0].name, pattern=rest[1], source=source)
        if len(x) == 3 and isinstance(x[1], int) and is_var(x[2]):
            return Find("agg", x[2].name, head, x[1])
        if len(x) == 2 and is_var(x[1]):
            return Find("agg", x[1].name, head)
    raise QueryError(f"can't find {x}")


def _input_vars(x: Any) -> set[str]:
    if is_var(x):
        return {x.name}
    if isinstance(x, list):
        return set().union(*map(_input_vars, x)) if x else set()
    return set()


def clause(form: Any, in_or: bool = False) -> Any:
    if isinstance(form, EdnList):
        items, source = list(form), "$"
        if _name(items[0]) and items[0].name.startswith("$"):
            source, items = items[0].name, items[1:]
        head = _name(items[0])
        if head == "not":
            return Not([clause(c) for c in items[1:]])
        if head == "not-join":
            return Not([clause(c) for c in items[2:]], [v.name for v in items[1]])
        if head == "and":
            if not in_or:
                raise QueryError("and belongs in or")
            return [clause(c) for c in items[1:]]
        if head in ("or", "or-join"):
            vars_, required, rest = None, [], items[1:]
            if head == "or-join":
                vars_ = list(items[1])
                if vars_ and isinstance(vars_[0], list):
                    required = [v.name for v in vars_[0]]
                    vars_ = [*vars_[0], *vars_[1:]]
                vars_, rest = [v.name for v in vars_], items[2:]
            branches = [b if isinstance(b := clause(c, True), list) else [b] for c in rest]
            if not branches:
                raise QueryError("or needs branches")
            if vars_ is None and len({frozenset(set().union(*map(all_vars, b))) for b in branches}) > 1:
                raise QueryError("the branches of or need the same variables")
            return Or(branches, vars_, required)
        if head is None:
            raise QueryError(f"no clause: {form}")
        return RuleCall(head, [term(x) for x in items[1:]], source)
    if isinstance(form, list) and form:
        if isinstance(form[0], EdnList):
            call = list(form[0])
            name, args, source = _name(call[0]), call[1:], "$"
            if name in ("missing?", "get-else") and args and _name(args[0]) and args[0].name.startswith("$"):
                source, args = args[0].name, args[1:]
            args = [term(x) for x in args]
            if len(form) == 1:
                return Predicate(name, args, source)
            if len(form) == 2:
                return Function(name, args, _binding(form[1]), source)
            raise QueryError(f"no clause: {form}")
        items, source = list(form), "$"
        if _name(items[0]) and items[0].name.startswith("$"):
            source, items = items[0].name, items[1:]
        if not 1 <= len(items) <= 5:
            raise QueryError(f"a pattern has one to five terms: {form}")
        return Pattern(source, [term(x) for x in items] + [BLANK] * (5 - len(items)))
    raise QueryError(f"no clause: {form}")


def _binding(x: Any) -> tuple:
    if isinstance(x, Symbol):
        return ("scalar", term(x))
    if isinstance(x, list):
        if len(x) == 2 and _name(x[1]) == "...":
            return ("coll", term(x[0]))
        if len(x) == 1 and isinstance(x[0], list):
            return ("rel", [term(y) for y in x[0]])
        return ("tuple", [term(y) for y in x])
    raise QueryError(f"no binding: {x}")


def rules(forms: Any) -> dict[str, list[Rule]]:
    forms = read(forms) if isinstance(forms, str) else forms
    out: dict[str, list[Rule]] = {}
    for form in forms:
        head, *body = form
        name, *args = head
        required = [v.name for v in args[0]] if args and isinstance(args[0], list) else []
        free = [v.name for v in (args[1:] if required else args)]
        rule = Rule(name.name, required, free, [clause(c) for c in body])
        if out.get(rule.name) and len(out[rule.name][0].required + out[rule.name][0].free) != len(required + free):
            raise QueryError(f"the definitions of {rule.name} differ in arity")
        out.setdefault(rule.name, []).append(rule)
    return out


def _binding_vars(b: tuple) -> set[str]:
    targets = b[1] if isinstance(b[1], list) else [b[1]]
    return {t.name for t in targets if isinstance(t, Var) and t != BLANK}


def _vars(terms: list) -> set[str]:
    return {t.name for t in terms if isinstance(t, Var) and t != BLANK}


def all_vars(c: Any) -> set[str]:
    """The variables that a clause shares with what is around it."""
    if isinstance(c, Pattern):
        return _vars(c.terms)
    if isinstance(c, Predicate):
        return _vars(c.args)
    if isinstance(c, Function):
        return _vars(c.args) | _binding_vars(c.binding)
    if isinstance(c, RuleCall):
        return _vars(c.args)
    if isinstance(c, (Not, Or)) and c.join is not None:
        return set(c.join)
    if isinstance(c, Not):
        return set().union(*map(all_vars, c.clauses)) if c.clauses else set()
    return set().union(*(all_vars(x) for b in c.branches for x in b))


def bound_vars(c: Any) -> set[str]:
    """The variables that a clause can bind."""
    if isinstance(c, (Predicate, Not)):
        return set()
    if isinstance(c, Function):
        return _binding_vars(c.binding)
    return all_vars(c)


def needed_vars(c: Any) -> set[str]:
    """The variables that must be bound before a clause."""
    if isinstance(c, (Predicate, Function)):
        return _vars(c.args)
    if isinstance(c, Or):
        return set(c.required)
    return set()
