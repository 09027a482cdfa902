"""Predicates and functions of Datalog as column expressions, with static types."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.plans.parse import QueryError

Typed = tuple[Column, str]
NUMBERS = ("long", "double", "instant", "ref")


def comparable(x: str, y: str) -> bool:
    return x == y or x in NUMBERS and y in NUMBERS


def _chain(op: Callable[[Column, Column], Column], any_: bool = False):
    def build(args: list[Typed], name: str) -> Column:
        if not args:
            raise QueryError(f"{name} needs arguments")
        for (_, x), (_, y) in zip(args, args[1:]):
            if not comparable(x, y):
                raise QueryError(f"{name}: {x} and {y} have no order")
        return reduce(lambda a, b: a | b if any_ else a & b, [op(x[0], y[0]) for x, y in zip(args, args[1:])], F.lit(not any_ or len(args) < 2))

    return build


def _equal(args: list[Typed], name: str) -> Column:
    parts = [x[0] == y[0] if comparable(x[1], y[1]) else F.lit(False) for x, y in zip(args, args[1:])]
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def _differ(args: list[Typed], name: str) -> Column:
    parts = [x[0] != y[0] if comparable(x[1], y[1]) else F.lit(True) for x, y in zip(args, args[1:])]
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def _of(type_: str, op: Callable[..., Column], n: int = 1):
    def build(args: list[Typed], name: str) -> Column:
        if len(args) != n or any(t != type_ for _, t in args):
            raise QueryError(f"{name} takes {n} {type_}")
        return op(*[c for c, _ in args])

    return build


PREDICATES: dict[str, Callable[[list[Typed], str], Column]] = {
    "<": _chain(lambda a, b: a < b), "<=": _chain(lambda a, b: a <= b), ">": _chain(lambda a, b: a > b), ">=": _chain(lambda a, b: a >= b),
    "=": _equal, "==": _equal, "!=": _differ, "not=": _differ,
    "even?": _of("long", lambda a: a % 2 == 0), "odd?": _of("long", lambda a: a % 2 != 0), "zero?": _of("long", lambda a: a == 0), "pos?": _of("long", lambda a: a > 0), "neg?": _of("long", lambda a: a < 0),
    "true?": _of("boolean", lambda a: a), "false?": _of("boolean", lambda a: ~a),
    "starts-with?": _of("string", lambda a, b: a.startswith(b), 2), "ends-with?": _of("string", lambda a, b: a.endswith(b), 2), "includes?": _of("string", lambda a, b: a.contains(b), 2),
}


def _numbers(args: list[Typed], name: str, least: int = 1) -> str:
    if len(args) < least or any(t not in NUMBERS for _, t in args):
        raise QueryError(f"{name} takes numbers")
    return "double" if any(t == "double" for _, t in args) else "long"


def _fold(op: Callable[[Column, Column], Column]):
    def build(args: list[Typed], name: str) -> Typed:
        type_ = _numbers(args, name)
        cast = [c.cast("double") if type_ == "double" else c for c, _ in args]
        return reduce(op, cast), type_

    return build


def _minus(args: list[Typed], name: str) -> Typed:
    type_ = _numbers(args, name)
    return (-args[0][0], type_) if len(args) == 1 else _fold(lambda a, b: a - b)(args, name)


def _divide(args: list[Typed], name: str) -> Typed:
    """Doubles. An integer divisor of zero is an error; a double one gives infinities, or NaN for 0 / 0."""
    if len(args) != 2:
        raise QueryError("/ takes two numbers")
    _numbers(args, name)
    (a, _), (b, kind) = args
    x, y = a.cast("double"), b.cast("double")
    if kind != "double":
        return x / y, "double"
    inf = F.lit(float("inf"))
    return F.when(y != 0, x / F.when(y != 0, y)).when(x > 0, inf).when(x < 0, -inf).otherwise(F.lit(float("nan"))), "double"


def _longs(op: Callable[..., Column], n: int):
    def build(args: list[Typed], name: str) -> Typed:
        if len(args) != n or any(t not in ("long", "ref", "instant") for _, t in args):
            raise QueryError(f"{name} takes {n} integers")
        return op(*[c for c, _ in args]), "long"

    return build


def _pick(op: Callable[..., Column]):
    def build(args: list[Typed], name: str) -> Typed:
        if any(not comparable(args[0][1], t) for _, t in args):
            raise QueryError(f"{name}: no order")
        type_ = "double" if any(t == "double" for _, t in args) else args[0][1]
        return (op(*[c for c, _ in args]) if len(args) > 1 else args[0][0]), type_

    return build


def display(c: Column, type_: str) -> Column:
    """A value as str shows it: whole doubles without a fraction."""
    if type_ == "double":
        whole = (c == F.floor(c).cast("double")) & (F.abs(c) < 1e15)
        return F.when(whole, c.cast("decimal(38,0)").cast("string")).otherwise(F.regexp_replace(c.cast("string"), "Infinity", "inf"))
    return F.concat(F.lit(":"), F.ltrim(c, F.lit(":"))) if type_ == "keyword" else c.cast("string")


def _str(args: list[Typed], name: str) -> Typed:
    return F.concat(F.lit(""), *[display(c, t) for c, t in args]), "string"


def _subs(args: list[Typed], name: str) -> Typed:
    if len(args) not in (2, 3) or args[0][1] != "string" or any(t != "long" for _, t in args[1:]):
        raise QueryError("subs takes a string and one or two places")
    s, start = args[0][0], args[1][0]
    end = F.least(args[2][0], F.char_length(s).cast("long")) if len(args) == 3 else F.char_length(s).cast("long")
    places = [a[0] for a in args[1:]]
    bad = reduce(lambda a, b: a | b, [p < 0 for p in places])
    out = s.substr((start + 1).cast("int"), F.greatest(F.lit(0).cast("long"), end - start).cast("int"))
    return F.when(bad, F.raise_error(F.lit("subs: a negative place")).cast("string")).otherwise(out), "string"


def _text(op: Callable[[Column], Column], type_: str = "string"):
    def build(args: list[Typed], name: str) -> Typed:
        if len(args) != 1 or args[0][1] != "string":
            raise QueryError(f"{name} takes a string")
        return op(args[0][0]), type_

    return build


def _abs(args: list[Typed], name: str) -> Typed:
    return F.abs(args[0][0]), _numbers(args, name)


FUNCTIONS: dict[str, Callable[[list[Typed], str], Typed]] = {
    "+": _fold(lambda a, b: a + b), "*": _fold(lambda a, b: a * b), "-": _minus, "/": _divide,
    "quot": _longs(lambda a, b: _quot(a, b), 2),
    "rem": _longs(lambda a, b: a % b, 2), "mod": _longs(lambda a, b: F.pmod(a, F.abs(b)), 2),
    "inc": _longs(lambda a: a + 1, 1), "dec": _longs(lambda a: a - 1, 1), "abs": _abs, "min": _pick(F.least), "max": _pick(F.greatest),
    "str": _str, "count": _text(lambda a: F.char_length(a).cast("long"), "long"), "subs": _subs, "upper-case": _text(F.upper), "lower-case": _text(F.lower), "identity": lambda args, name: args[0],
}


def _quot(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)
