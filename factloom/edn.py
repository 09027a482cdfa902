"""EDN: a reader, a printer and the total order of its values."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass
from decimal import Decimal
from typing import Any


@dataclass(frozen=True, order=True)
class Keyword:
    name: str

    def __str__(self) -> str:
        return f":{self.name}"

    __repr__ = __str__


@dataclass(frozen=True, order=True)
class Symbol:
    name: str

    def __str__(self) -> str:
        return self.name

    __repr__ = __str__


class EdnList(tuple):
    """A list in round brackets; vectors are Python lists."""


@dataclass(frozen=True)
class Tagged:
    tag: str
    value: Any


class EdnError(ValueError):
    pass


_TOKENS = re.compile(r"""[\s,]*(;[^\n]*|\#_|\#\{|[()\[\]{}]|"(?:\\.|[^\\"])*"|\\(?:\w+|.)|\#[A-Za-z][\w./-]*|[^\s,()\[\]{}"';]+|$)""", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", '"': '"', "\\": "\\"}
_CHARS = {"newline": "\n", "space": " ", "tab": "\t", "return": "\r"}
_CLOSE = {"(": ")", "[": "]", "{": "}", "#{": "}"}


def _hashable(x: Any) -> Any:
    if isinstance(x, EdnList):
        return EdnList(map(_hashable, x))
    if isinstance(x, list):
        return tuple(map(_hashable, x))
    if isinstance(x, dict):
        return tuple((_hashable(k), _hashable(v)) for k, v in x.items())
    return x


class _Reader:
    def __init__(self, text: str):
        self.text, self.at = text, 0

    def token(self) -> str:
        while True:
            m = _TOKENS.match(self.text, self.at)
            if m is None:
                raise EdnError(f"unreadable at {self.at}")
            self.at = m.end()
            if not m[1].startswith(";"):
                return m[1]

    def value(self, token: str | None = None) -> Any:
        token = self.token() if token is None else token
        if not token:
            raise EdnError("unexpected end")
        if token in _CLOSE:
            items = []
            while (t := self.token()) != _CLOSE[token]:
                if not t:
                    raise EdnError(f"unclosed {token}")
                if t == "#_":
                    self.value()
                    continue
                items.append(self.value(t))
            if token == "(":
                return EdnList(items)
            if token == "[":
                return items
            if token == "#{":
                return frozenset(map(_hashable, items))
            if len(items) % 2:
                raise EdnError("a map needs pairs")
            return {_hashable(k): v for k, v in zip(items[::2], items[1::2])}
        if token == "#_":
            self.value()
            return self.value()
        if token[0] in ")]}":
            raise EdnError(f"unexpected {token}")
        if token[0] == '"':
            return re.sub(r"\\(u[0-9A-Fa-f]{4}|.)", lambda m: chr(int(m[1][1:], 16)) if len(m[1]) == 5 else _ESCAPES.get(m[1], m[1]), token[1:-1], flags=re.S)
        if token[0] == "\\":
            return _CHARS.get(token[1:], token[1:])
        if token[0] == ":":
            return Keyword(token[1:])
        if token[0] == "#":
            value = self.value()
            if token == "#inst":
                return value if isinstance(value, int) else dt.datetime.fromisoformat(value)
            if token == "#uuid":
                return Tagged("uuid", str(value).replace("-", "").lower())
            return Tagged(token[1:], value)
        if token in ("nil", "true", "false"):
            return {"nil": None, "true": True, "false": False}[token]
        if re.fullmatch(r"[+-]?\d+N?", token):
            return int(token.rstrip("N"))
        if re.fullmatch(r"[+-]?\d+(\.\d*)?([eE][+-]?\d+)?M?", token):
            return Decimal(token[:-1]) if token.endswith("M") else float(token)
        if token in ("##Inf", "##-Inf", "##NaN"):
            return float(token[2:].lower())
        return Symbol(token)


def read(text: str) -> Any:
    """The one value of a text."""
    reader = _Reader(text)
    value = reader.value()
    if reader.token():
        raise EdnError("more than one value")
    return value


def read_all(text: str) -> list:
    reader, out = _Reader(text), []
    while token := reader.token():
        if token == "#_":
            reader.value()
        else:
            out.append(reader.value(token))
    return out


def write(x: Any) -> str:
    if x is None:
        return "nil"
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, str):
        return '"' + "".join({"\n": "\\n", "\t": "\\t", "\r": "\\r", '"': '\\"', "\\": "\\\\"}.get(c, c) for c in x) + '"'
    if isinstance(x, EdnList):
        return "(" + " ".join(map(write, x)) + ")"
    if isinstance(x, (list, tuple)):
        return "[" + " ".join(map(write, x)) + "]"
    if isinstance(x, (set, frozenset)):
        return "#{" + " ".join(map(write, sorted(x, key=order))) + "}"
    if isinstance(x, dict):
        return "{" + ", ".join(f"{write(k)} {write(v)}" for k, v in sorted(x.items(), key=lambda kv: order(kv[0]))) + "}"
    if isinstance(x, dt.datetime):
        return f'#inst "{x.isoformat()}"'
    if isinstance(x, Tagged):
        return f"#{x.tag} {write(x.value)}"
    return str(x)


def order(x: Any) -> tuple:
    """A sort key: nil, booleans, integers, doubles, strings, keywords, symbols, lists, vectors, maps, sets, tagged."""
    if x is None:
        return (0,)
    if isinstance(x, bool):
        return (1, x)
    if isinstance(x, int):
        return (2, x)
    if isinstance(x, dt.datetime):
        return (2, int(x.timestamp() * 1000))
    if isinstance(x, (float, Decimal)):
        return (3, float(x))
    if isinstance(x, str):
        return (4, x)
    if isinstance(x, Keyword):
        return (5, x.name)
    if isinstance(x, Symbol):
        return (6, x.name)
    if isinstance(x, EdnList):
        return (7, tuple(map(order, x)))
    if isinstance(x, (list, tuple)):
        return (8, tuple(map(order, x)))
    if isinstance(x, dict):
        return (9, tuple(sorted((order(k), order(v)) for k, v in x.items())))
    if isinstance(x, (set, frozenset)):
        return (10, tuple(sorted(map(order, x))))
    return (11, str(x))
