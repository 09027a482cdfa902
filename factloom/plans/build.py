"""Datalog queries and rules put together in Python; they become the text that parse() reads."""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Any

from factloom import edn
from factloom.edn import Keyword


@dataclass(frozen=True)
class Form:
    """A piece of a query: its text is taken as it is, all other values are quoted as EDN."""

    text: str

    def __str__(self) -> str:
        return self.text

    def bind(self, shape: Any) -> Form:
        """A call bound to a variable, or to tup(), coll() or rel()."""
        return Form(f"{self.text[:-1]} {_text(shape)}]")

    def within(self, source: str) -> Form:
        """A pattern or not of another database than $."""
        return Form(f"{self.text[0]}{source} {self.text[1:]}")


def _text(x: Any) -> str:
    return x.text if isinstance(x, Form) else edn.write(x)


def _joined(*parts: Any) -> str:
    return " ".join(map(_text, parts))


def var(name: str) -> Form:
    if not name.lstrip("?"):
        raise ValueError("a variable needs a name")
    return Form("?" + name.lstrip("?"))


def attr(name: str) -> Keyword:
    return Keyword(name.lstrip(":"))


BLANK, DB = Form("_"), Form("$")


def data(entity: Any, attribute: Any = BLANK, *more: Any) -> Form:
    """A pattern: entity, attribute, value, transaction, added; trailing ones may be left out."""
    return Form(f"[{_joined(entity, attribute, *more)}]")


def call(name: str, *args: Any) -> Form:
    """A predicate, or with bind() a function."""
    return Form(f"[({_joined(Form(name), *args)})]")


def tup(*variables: Form) -> Form:
    return Form(f"[{_joined(*variables)}]")


def coll(variable: Form) -> Form:
    return Form(f"[{variable} ...]")


def rel(*variables: Form) -> Form:
    return Form(f"[[{_joined(*variables)}]]")


def rule(name: str, *args: Any) -> Form:
    return Form(f"({_joined(Form(name), *args)})")


def not_(*clauses: Form) -> Form:
    return rule("not", *clauses)


def not_join(variables: list[Form], *clauses: Form) -> Form:
    return rule("not-join", tup(*variables), *clauses)


def all_(*clauses: Form) -> Form:
    """Clauses that hold together, as a branch of an or."""
    return rule("and", *clauses)


def or_(*branches: Form) -> Form:
    return rule("or", *branches)


def or_join(variables: list[Form], *branches: Form) -> Form:
    return rule("or-join", tup(*variables), *branches)


def agg(name: str, variable: Form, n: int | None = None) -> Form:
    """count, count-distinct, sum, avg, median, min, max, sample, distinct, variance or stddev; n for lists."""
    return rule(name, *([] if n is None else [n]), variable)


def pull(entity: Form, pattern: str) -> Form:
    return Form(f"(pull {entity} {pattern})")


@dataclass(frozen=True)
class Query:
    shown: str
    extra: tuple[Form, ...] = ()
    inputs: tuple[Form, ...] = ()
    clauses: tuple[Form, ...] = ()

    @classmethod
    def find(cls, *elements: Form) -> Query:
        return cls(_joined(*elements))

    @classmethod
    def find_collection(cls, element: Form) -> Query:
        return cls(f"[{element} ...]")

    @classmethod
    def find_tuple(cls, *elements: Form) -> Query:
        return cls(f"[{_joined(*elements)}]")

    @classmethod
    def find_scalar(cls, element: Form) -> Query:
        return cls(f"{element} .")

    def with_(self, *variables: Form) -> Query:
        return replace(self, extra=self.extra + variables)

    def in_(self, *inputs: Form) -> Query:
        """More inputs after $: variables, tup(), coll(), rel(), Form("$other") or Form("%")."""
        return replace(self, inputs=self.inputs + inputs)

    def where(self, *clauses: Form) -> Query:
        return replace(self, clauses=self.clauses + clauses)

    def __str__(self) -> str:
        given = f" :in $ {_joined(*self.inputs)}" if self.inputs else ""
        kept = f" :with {_joined(*self.extra)}" if self.extra else ""
        return f"[:find {self.shown}{kept}{given} :where {_joined(*self.clauses)}]"


@dataclass(frozen=True)
class RuleSet:
    rules: tuple[str, ...] = ()

    def define(self, head: Form, *clauses: Form) -> RuleSet:
        """Another definition of the rule that head, made by rule(), names."""
        return RuleSet(self.rules + (f"[{_joined(head, *clauses)}]",))

    def __str__(self) -> str:
        return f"[{' '.join(self.rules)}]"
