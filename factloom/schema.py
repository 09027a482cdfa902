"""Attributes: what a fact's value is, how many an entity may have, and what is unique."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from typing import Any

from .edn import Keyword

#: Value types, the log's column for each, and the type that a query sees. Instants are milliseconds.
TYPES = {
    "boolean": ("v_bool", "boolean"), "long": ("v_long", "bigint"), "double": ("v_double", "double"), "instant": ("v_instant", "bigint"), "uuid": ("v_uuid", "string"),
    "keyword": ("v_keyword", "string"), "string": ("v_string", "string"), "bytes": ("v_bytes", "binary"), "ref": ("v_ref", "bigint"),
}
#: Entity ids: a partition in the upper bits, a number in the lower 42.
SHIFT, DB, TX, USER, VIRTUAL = 42, 0, 1, 2, 16
FIRST_ATTRIBUTE, FIRST_USER = 100, 1000


class SchemaError(ValueError):
    pass


@dataclass(frozen=True)
class Protection:
    """A class of protected attributes: whose key seals them, what a reader without it gets, and bytes that values are padded to."""

    name: str
    missing: str = "redact"
    padding: int | None = None

    def __post_init__(self) -> None:
        if self.missing not in ("redact", "hide", "error"):
            raise SchemaError(f"unknown policy {self.missing}")
        if self.padding is not None and self.padding < 16:
            raise SchemaError("padding is 16 or more")


@dataclass(frozen=True)
class Attribute:
    ident: str
    type: str
    many: bool = False
    unique: str | None = None
    component: bool = False
    indexed: bool = False
    no_history: bool = False
    retired: bool = False
    doc: str | None = None
    protection: Protection | None = None

    def __post_init__(self) -> None:
        if self.type not in TYPES:
            raise SchemaError(f"unknown value type {self.type}")
        if self.unique not in (None, "identity", "value"):
            raise SchemaError(f"unknown uniqueness {self.unique}")
        if self.component and self.type != "ref":
            raise SchemaError(f":{self.ident}: only references can be components")
        if self.protection is not None and (self.type == "ref" or self.unique or self.indexed):
            raise SchemaError(f":{self.ident}: what is protected can't be a reference, unique or indexed")

    @property
    def namespace(self) -> str:
        return self.ident.rpartition("/")[0]

    @property
    def name(self) -> str:
        return self.ident.rpartition("/")[2]


@dataclass(frozen=True)
class Schema:
    attributes: dict[str, Attribute] = field(default_factory=dict)

    @classmethod
    def of(cls, attributes: Iterable[Attribute]) -> Schema:
        return cls({a.ident: a for a in attributes})

    @classmethod
    def from_edn(cls, forms: Iterable[dict]) -> Schema:
        """Maps with :db/ident, :db/valueType, :db/cardinality and so on; those with :db.protect/ident are protection classes."""

        def last(x: Any) -> str:
            return x.name.rpartition("/")[2] if isinstance(x, Keyword) else str(x)

        maps = [{k.name: v for k, v in form.items()} for form in forms]
        classes = {f["db.protect/ident"].name: Protection(f["db.protect/ident"].name, last(f.get("db.protect/on-missing-key", "redact")), f.get("db.protect/padding")) for f in maps if "db.protect/ident" in f}
        out = []
        for f in maps:
            if "db.protect/ident" not in f:
                out.append(Attribute(f["db/ident"].name, last(f["db/valueType"]), last(f.get("db/cardinality", "one")) == "many", last(f["db/unique"]) if "db/unique" in f else None,
                                     bool(f.get("db/isComponent")), bool(f.get("db/index")), bool(f.get("db/noHistory")), bool(f.get("db/retired")), f.get("db/doc"),
                                     _class(classes, f["db/protection"].name) if "db/protection" in f else None))
        return cls.of(out)

    @classmethod
    def from_toml(cls, text: str) -> Schema:
        """[[entity]] groups (name, attributes), [[attribute]] declarations (group, name) and [protect.<name>] classes.

        An attribute is a type, or a table with type and many or cardinality, unique, index, component, no-history, doc and protection.
        """
        import tomllib

        top = tomllib.loads(text)
        if more := set(top) - {"schema-version", "entity", "attribute", "protect"}:
            raise SchemaError(f"unknown sections: {' '.join(sorted(more))}")
        if top.get("schema-version", 1) != 1:
            raise SchemaError("unknown schema-version")
        classes = {f"protect/{n}": Protection(f"protect/{n}", c.get("on-missing-key", "redact"), c.get("padding")) for n, c in top.get("protect", {}).items()}
        groups = [g["name"] for g in top.get("entity", [])]
        if len(set(groups)) < len(groups):
            raise SchemaError("a group has several blocks")
        found = [(f"{g['name']}/{n}", a) for g in top.get("entity", []) for n, a in g.get("attributes", {}).items()]
        found += [(f"{a['group']}/{a['name']}" if "group" in a else a["name"], {k: v for k, v in a.items() if k not in ("group", "name")}) for a in top.get("attribute", [])]
        out: dict[str, Attribute] = {}
        for ident, a in found:
            a = {"type": a} if isinstance(a, str) else a
            if ident in out:
                raise SchemaError(f":{ident} is declared twice")
            if more := set(a) - {"type", "many", "cardinality", "unique", "index", "component", "no-history", "doc", "protection"}:
                raise SchemaError(f":{ident}: unknown options: {' '.join(sorted(more))}")
            if "type" not in a or {"many", "cardinality"} <= set(a) or a.get("cardinality", "one") not in ("one", "many"):
                raise SchemaError(f":{ident} needs a type and one cardinality")
            many = a.get("many", a.get("cardinality") == "many")
            protection = _class(classes, a["protection"]) if "protection" in a else None
            out[ident] = Attribute(ident, a["type"], many, a.get("unique"), a.get("component", False), a.get("index", False), a.get("no-history", False), doc=a.get("doc"), protection=protection)
        return cls(out)

    def get(self, ident: str | Keyword) -> Attribute:
        name = ident.name if isinstance(ident, Keyword) else ident.lstrip(":")
        if name not in self.attributes:
            raise SchemaError(f"unknown attribute :{name}")
        return self.attributes[name]

    def merged(self, other: Schema) -> Schema:
        return Schema(self.attributes | other.attributes)

    def id_of(self, ident: str) -> int:
        """An attribute's entity id: its place in the schema."""
        return FIRST_ATTRIBUTE + list(self.attributes).index(ident)

    def without(self, idents: Iterable[str]) -> Schema:
        gone = set(idents)
        return Schema({k: v for k, v in self.attributes.items() if k not in gone})

    def changed(self, ident: str, **what: Any) -> Schema:
        return Schema(self.attributes | {ident: replace(self.get(ident), **what)})


def _class(classes: dict[str, Protection], name: str) -> Protection:
    if name not in classes:
        raise SchemaError(f"no protection class {name}")
    return classes[name]
