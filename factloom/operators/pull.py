"""Pull: entities as nested maps, read level by level for all roots at once; and lazy entities."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import functions as F

from factloom.edn import EdnList, Keyword, Symbol, Tagged, order, read
from factloom.plans.parse import QueryError

LIMIT = 1000
ID = Keyword("db/id")


class _Spec:
    def __init__(self, attr: str, reverse: bool = False):
        self.attr, self.reverse, self.key = attr, reverse, Keyword(attr if not reverse else attr.replace("/", "/_"))
        self.limit: int | None = LIMIT
        self.default, self.has_default, self.sub, self.depth = None, False, None, None  # depth: int or "..."


def parse_pattern(pattern: Any) -> tuple[bool, bool, list[_Spec]]:
    """(wildcard, wants the id, specs)."""
    pattern = read(pattern) if isinstance(pattern, str) else pattern
    wild, with_id, specs = False, False, []

    def spec(x: Any) -> _Spec:
        options = []
        if isinstance(x, (list, EdnList)):
            x, *options = x
        if not isinstance(x, Keyword):
            raise QueryError(f"no pull attribute: {x}")
        ns, _, name = x.name.rpartition("/")
        out = _Spec(f"{ns}/{name[1:]}" if name.startswith("_") else x.name, name.startswith("_"))
        for k, v in zip(options[::2], options[1::2]):
            if k == Keyword("as"):
                out.key = v
            elif k == Keyword("limit"):
                out.limit = v
            elif k == Keyword("default"):
                out.default, out.has_default = v, True
            else:
                raise QueryError(f"no pull option {k}")
        return out

    for x in pattern:
        if isinstance(x, Symbol) and x.name == "*":
            wild = True
        elif x == ID:
            with_id = True
        elif isinstance(x, dict):
            for k, v in x.items():
                k = list(k) if isinstance(k, tuple) and not isinstance(k, EdnList) else k
                s = spec(k)
                if isinstance(v, int) or isinstance(v, Symbol) and v.name == "...":
                    if s.reverse:
                        raise QueryError("a reverse attribute can't recur")
                    s.depth = v if isinstance(v, int) else "..."
                else:
                    s.sub = parse_pattern(v)
                specs.append(s)
        else:
            specs.append(spec(x))
    return wild, with_id, specs


class _Reader:
    """Values by entity and attribute, fetched for a level's entities in one job each and kept for the pull."""

    def __init__(self, db: Any):
        self.db, self.forward, self.backward = db, {}, {}

    def fetch(self, attr: str, ids: Sequence[int], reverse: bool) -> None:
        a = self.db.attribute(Keyword(attr))
        cache = self.backward if reverse else self.forward
        todo = [e for e in dict.fromkeys(ids) if (attr, e) not in cache]
        for e in todo:
            cache[attr, e] = []
        if a is None or not todo:
            return
        side, other = ("v", "e") if reverse else ("e", "v")
        who = self.db.spark.createDataFrame([(e,) for e in todo], "k bigint")
        rows = self.db.facts(a).where("added").join(F.broadcast(who), F.col(side) == F.col("k")).select("k", other).collect()  # roots are the caller's own list
        for k, x in rows:
            if a.ident in self.db.sealed:
                cache[attr, k].append(Tagged("redacted", Keyword(a.protection.name)))
                continue
            cache[attr, k].append(Keyword(x.lstrip(":")) if a.type == "keyword" and not reverse else x)
        for e in todo:
            cache[attr, e].sort(key=order)


def pull_many(db: Any, pattern: Any, entities: Sequence[int]) -> list:
    """A map for each entity, None where nothing is found."""
    reader, parsed = _Reader(db), parse_pattern(pattern)
    out = _pull(reader, parsed, [(e, (e,)) for e in entities if e is not None])
    found = dict(zip([e for e in entities if e is not None], out))
    return [found.get(e) or None for e in entities]


def _pull(reader: _Reader, parsed: tuple, roots: list[tuple[int, tuple]], depth: dict | None = None) -> list[dict]:
    """One level: attributes of all roots are read together; roots carry the path of entities that led to them."""
    wild, with_id, specs = parsed
    db, depth = reader.db, depth or {}
    if wild:
        named = {s.attr for s in specs if not s.reverse}
        specs = [*specs, *[_Spec(n) for n in db.schema.attributes if n not in named and n not in db.hidden]]
    out: list[dict] = [({ID: e} if with_id or wild else {}) for e, _ in roots]
    for s in specs:
        a = db.attribute(Keyword(s.attr))
        if a is None:
            continue
        if s.reverse and a.type != "ref":
            raise QueryError(f":{s.attr} isn't a reference")
        reader.fetch(s.attr, [e for e, _ in roots], s.reverse)
        cache = reader.backward if s.reverse else reader.forward
        values = [cache[s.attr, e][: s.limit] if s.limit is not None else cache[s.attr, e] for e, _ in roots]
        shown: dict[tuple[int, int], Any] = {}
        if a.type == "ref":
            sub, below = s.sub, {}
            if s.depth is not None:
                left = depth.get(s.attr, s.depth)
                sub, below = parsed, {**depth, s.attr: left if left == "..." else left - 1}
                if left != "..." and left <= 0:
                    sub = None
            elif sub is None and a.component and not s.reverse:
                sub = (True, True, [])
            children = [(i, k, x, path) for i, ((_, path), vs) in enumerate(zip(roots, values)) for k, x in enumerate(vs)]
            go = [c for c in children if sub is not None and c[2] not in c[3]] if s.depth is not None or s.sub is None else [c for c in children if sub is not None]
            got = _pull(reader, sub, [(x, (*path, x)) for _, _, x, path in go], below) if go else []
            shown = {(i, k): {ID: x} for i, k, x, _ in children}
            for (i, k, x, _), m in zip(go, got):
                shown[i, k] = m if m or s.sub is not None else {ID: x}
        for i, vs in enumerate(values):
            items = [shown.get((i, k), x) for k, x in enumerate(vs)]
            items = [x for x in items if x != {}]
            one = a.component if s.reverse else not a.many
            if items:
                out[i].setdefault(s.key, items[0] if one else items)
            elif s.has_default:
                out[i].setdefault(s.key, s.default)
    return [dict(sorted(m.items(), key=lambda kv: order(kv[0]))) for m in out]


class Entity:
    """Lazy navigation from one entity."""

    def __init__(self, db: Any, e: int):
        self.db, self.id = db, e

    def get(self, attr: str | Keyword, default: Any = None) -> Any:
        key = attr if isinstance(attr, Keyword) else Keyword(attr.lstrip(":"))
        a = self.db.attribute(key)
        if a is None:
            return default
        reader = _Reader(self.db)
        reader.fetch(a.ident, [self.id], False)
        values = reader.forward[a.ident, self.id]
        values = [Entity(self.db, x) for x in values] if a.type == "ref" else values
        return (values if a.many else values[0]) if values else default

    def keys(self) -> list[str]:
        return sorted(r[0] for r in self.db.everything().where(F.col("e") == self.id).select("attr").distinct().collect())

    def reverse(self, attr: str) -> list[Entity]:
        reader = _Reader(self.db)
        reader.fetch(attr.lstrip(":"), [self.id], True)
        return [Entity(self.db, x) for x in reader.backward[attr.lstrip(":"), self.id]]

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Entity) and other.id == self.id

    def __hash__(self) -> int:
        return hash(self.id)
