"""Transactions: forms are validated against the basis, and committed as one folder of the log."""

from __future__ import annotations

import datetime as dt
import os
import time
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.db import Db
from factloom.edn import EdnList, Keyword, Tagged, read
from factloom.schema import FIRST_USER, SHIFT, TX, TYPES, USER, Attribute, Schema
from factloom.sources.facts import LOG, LogSource, View, read_log
from factloom.sources.sealing import closed, opened, sealed

EPOCH = dt.datetime(1970, 1, 1)
INSTANT = Attribute("db/txInstant", "instant")
#: On the transaction of a schema change: the digest of its plan.
AUDIT = Attribute("db/schemaDigest", "string")


class TxError(ValueError):
    pass


class BasisMismatch(TxError):
    pass


@dataclass
class Report:
    db_before: Db
    db_after: Db
    tx_data: list[tuple[int, str, Any, int, bool]]
    tempids: dict[str, int]
    tx_instant: dt.datetime


class Connection:
    """A log folder with one subfolder for each transaction, t=<n>.

    The commit is the exclusive creation of claims/<n>, which names the folder that is then renamed into the log.
    Of writers of one t only one can create the claim; if it stops before the rename, the next writer does it. A claim
    also has the marks of its basis (the last instant and the highest entity), so a transaction needn't read the log for them.
    """

    def __init__(self, spark: SparkSession, path: str, schema: Schema, keys: Mapping[str, bytes] | None = None):
        """keys: class of protected attributes -> its key, of 16, 24 or 32 bytes."""
        self.keys = dict(keys or {})
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema.merged(Schema.of([INSTANT, AUDIT]))
        self.functions: dict[str, Callable] = {}
        jvm = spark._jvm
        self._at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._at(f"{self.path}/log"))
        self._fs.mkdirs(self._at(f"{self.path}/claims"))

    def basis(self) -> int:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at(f"{self.path}/log"))]
        return max((int(n[2:]) for n in names if n.startswith("t=")), default=0)

    def sync(self) -> Db:
        """The database at the last transaction that anyone has committed, also one that has only been claimed."""
        self._settle(self.basis() + 1)
        return self.db()

    def sync_to(self, t: int, timeout: float = 60.0, pause: float = 0.2) -> Db:
        """The database once its basis is t or more; an error if it isn't within timeout seconds."""
        until = time.monotonic() + timeout
        while self.basis() < t:
            if time.monotonic() > until:
                raise TxError(f"the basis is {self.basis()}, not {t}, after {timeout} s")
            time.sleep(pause)
        return self.db()

    def _marks(self, t: int) -> tuple[dt.datetime | None, int | None] | None:
        """The last instant and the highest entity at t, as its claim says; None where there is none."""
        claim = self._claim(t)
        if claim is None or len(claim) < 3:
            return None
        return (EPOCH + dt.timedelta(milliseconds=int(claim[1])) if claim[1] else None), (int(claim[2]) if claim[2] else None)

    def _claim(self, t: int) -> list[str] | None:
        at = self._at(f"{self.path}/claims/{t}")
        if not self._fs.exists(at):
            return None
        stream = self._fs.open(at)
        try:
            return bytes(stream.readAllBytes()).decode().split("\n")
        finally:
            stream.close()

    def db(self) -> Db:
        t = self.basis()
        log = read_log(self.spark, f"{self.path}/log", t) if t else self.spark.createDataFrame([], LOG)
        snapshot, since = self._snapshot(t)
        snapshot = None if snapshot is None else opened(snapshot, self.schema, self.keys)
        source = LogSource(opened(log, self.schema, self.keys), self.schema, snapshot=snapshot, snapshot_t=since)
        return Db(self.spark, source, self.schema, t, sealed=closed(self.schema, self.keys))

    def function(self, name: str, fn: Callable) -> None:
        """A transaction function: (db, *args) -> forms."""
        self.functions[name.lstrip(":")] = fn

    def transact(self, forms: Any, expected_basis_t: int | None = None, instant: dt.datetime | None = None, audit: dict[str, Any] | None = None) -> Report:
        before = self.db()
        if expected_basis_t is not None and expected_basis_t != before.basis_t:
            raise BasisMismatch(f"the basis is {before.basis_t}")
        data, tempids = _Prepared(self, before, before.basis_t + 1).run(read(forms) if isinstance(forms, str) else list(forms))
        return self._commit(before, data, tempids, instant, audit or {})

    def _commit(self, before: Db, data: list[tuple], tempids: dict[str, int], instant: dt.datetime | None, audit: dict[str, Any]) -> Report:
        t = before.basis_t + 1
        marks = self._marks(before.basis_t)
        last = marks[0] if marks else before.log().where("attr = 'db/txInstant'").agg(F.max("v_instant")).first()[0]
        now = (instant or dt.datetime.now(dt.timezone.utc)).replace(tzinfo=None)
        now = now.replace(microsecond=now.microsecond // 1000 * 1000)
        if last is not None and now <= last:
            now = last + dt.timedelta(milliseconds=1)
        rows = [*data, (TX << SHIFT | t, "db/txInstant", now, True), *((TX << SHIFT | t, ident, v, True) for ident, v in audit.items())]
        staged = f"{self.path}/_staging/{uuid.uuid4().hex}"
        sealed(self._frame(rows), self.schema, self.keys).coalesce(1).write.parquet(staged)
        high = max([e for e, *_ in data if e >> SHIFT == USER], default=None)
        self._publish(staged, t, now, high if marks is None or marks[1] is None else max(marks[1], high or 0), marks is not None or not before.basis_t)
        return Report(before, self.db(), [(e, a, v, t, added) for e, a, v, added in rows], tempids, now)

    def staged(self) -> Staged:
        """Several statements that are committed as one transaction, or not at all."""
        return Staged(self)

    def fork(self, path: str, t: int | None = None) -> Connection:
        """A copy of the log as of t, or of all of it, in a new folder, with a life of its own."""
        out = Connection(self.spark, path, self.schema, self.keys)
        if out.basis():
            raise TxError(f"{path} has a log already")
        log = read_log(self.spark, f"{self.path}/log", min(self.basis() if t is None else t, self.basis()))
        if self.basis():
            log.repartition("t").write.mode("append").partitionBy("t").parquet(f"{out.path}/log")
        return out

    def load(self, facts: DataFrame) -> int:
        """Bulk assertion of a DataFrame in the log's schema but for t, as one transaction; nothing is checked. Returns t."""
        t = self.basis() + 1
        staged = f"{self.path}/_staging/{uuid.uuid4().hex}"
        sealed(facts.drop("t").select(*[c for c in self.spark.createDataFrame([], LOG).columns if c != "t"]), self.schema, self.keys).write.parquet(staged)
        self._publish(staged, t)
        return t

    def _publish(self, staged: str, t: int, instant: dt.datetime | None = None, high: int | None = None, marked: bool = False) -> None:
        """Claims t for a staged folder and puts it into the log; marked: whether instant and high are all that a reader of t needs."""
        self._settle(t)
        if self._fs.exists(self._at(f"{self.path}/log/t={t}")):
            raise BasisMismatch(f"another transaction took t={t}")
        lines = [staged] + ([str(round((instant - EPOCH).total_seconds() * 1000)) if instant else "", "" if high is None else str(high)] if marked else [])
        if not self._create(f"{self.path}/claims/{t}", "\n".join(lines).encode()):
            self._settle(t)
            raise BasisMismatch(f"another transaction took t={t}")
        self._settle(t)

    def _settle(self, t: int) -> None:
        """Puts the folder that a claim names into the log, if its writer hasn't: whoever renames it, it's the same folder."""
        claim, target = self._claim(t), self._at(f"{self.path}/log/t={t}")
        if claim is None or not claim[0] or self._fs.exists(target):
            return
        source = self._at(claim[0])
        try:
            moved = self._fs.exists(source) and self._fs.rename(source, target)
        except Exception:  # another renames it now
            moved = False
        if not moved and not self._fs.exists(target):
            raise TxError(f"t={t} is claimed, but {claim[0]} can't be put into the log")

    def _create(self, path: str, data: bytes) -> bool:
        """A new file, or False if there is one: an exclusive creation, which on a local disk Hadoop doesn't have."""
        if self._fs.getScheme() == "file":
            local = self._at(path).toUri().getPath()
            part = f"{local}.{uuid.uuid4().hex}"
            with open(part, "wb") as f:
                f.write(data)
            try:
                os.link(part, local)
            except FileExistsError:
                return False
            finally:
                os.unlink(part)
            return True
        try:
            out = self._fs.create(self._at(path), False)
        except Exception:
            if self._fs.exists(self._at(path)):
                return False
            raise
        out.write(data)
        out.close()
        return True

    def _frame(self, rows: Sequence[tuple]) -> DataFrame:
        out = []
        for seq, (e, ident, v, added) in enumerate(rows):
            a = self.schema.get(ident)
            values = {c: None for c, _ in TYPES.values()}
            values[TYPES[a.type][0]] = v
            out.append((e, self.schema.id_of(ident), ident, a.type, *values.values(), 0, seq, added))
        return self.spark.createDataFrame(out, LOG).drop("t")

    def snapshot(self) -> int:
        """Writes what is current at the basis, by attribute and entity, for later reads to begin from. Returns its t."""
        t = self.basis()
        before, since = self._snapshot(t)
        if t == since:
            return t
        log = read_log(self.spark, f"{self.path}/log", t)
        rows = LogSource(log, self.schema, snapshot=before, snapshot_t=since).current()
        staged = f"{self.path}/_staging/{uuid.uuid4().hex}"
        rows.repartitionByRange("attr", "e").sortWithinPartitions("attr", "e").write.parquet(staged)
        target = self._at(f"{self.path}/current/basis-{t}")
        self._fs.mkdirs(target.getParent())
        if not self._fs.exists(target):  # else another has written the same
            self._fs.rename(self._at(staged), target)
        return t

    def _snapshot(self, until: int) -> tuple[DataFrame | None, int]:
        """The last snapshot that isn't after until, and its t; None and 0 if there is none."""
        at = self._at(f"{self.path}/current")
        names = [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []
        t = max((n for n in (int(x.rpartition("-")[2]) for x in names if x.startswith("basis-")) if n <= until), default=0)
        return (read_log(self.spark, f"{self.path}/current/basis-{t}") if t else None), t

    def compact(self) -> DataFrame:
        """The current facts with values as text, read from a snapshot of the basis."""
        self.snapshot()
        return self.db().source.everything()


class Staged:
    """A transaction in the making: each statement sees those before it; readers see none until commit()."""

    def __init__(self, conn: Connection):
        self.conn, self.base = conn, conn.db()
        self.rows: list[tuple] = []
        self.tempids: dict[str, int] = {}
        self._db = self.base

    def db(self) -> Db:
        return self._db

    def transact(self, forms: Any, expected_basis_t: int | None = None) -> Report:
        before = self._db
        if expected_basis_t is not None and expected_basis_t != before.basis_t:
            raise BasisMismatch(f"the basis is {before.basis_t}")
        t = self.base.basis_t + 1
        data, tempids = _Prepared(self.conn, before, t).run(read(forms) if isinstance(forms, str) else list(forms))
        self.rows += data
        self.tempids |= tempids
        if data:
            self._db = self.base.with_(self.conn._frame(self.rows).withColumn("t", F.lit(t).cast("long")))
        return Report(before, self._db, [(e, a, v, t, added) for e, a, v, added in data], tempids, dt.datetime.now(dt.timezone.utc).replace(tzinfo=None))

    def commit(self) -> Report:
        """Fails if another transaction has come between. Of a temporary id used twice the last entity is reported."""
        return self.conn._commit(self.base, self.rows, self.tempids, None, {})


class _Prepared:
    """Forms applied in order to a working copy of the facts that they touch."""

    def __init__(self, conn: Connection, db: Db, t: int):
        self.conn, self.db, self.t = conn, db, t
        self.schema, self.out, self.tempids = conn.schema, [], {}
        self.known: dict[tuple[int, str], list] = {}
        marks = conn._marks(db.basis_t) if db.basis_t < t and db.basis_t == conn.basis() else None
        high = marks[1] if marks else db.log().where(F.shiftright("e", SHIFT) == USER).agg(F.max("e")).first()[0]
        self.next = self.fresh = max(high + 1 if high is not None else 0, USER << SHIFT | FIRST_USER)
        self.held: dict[tuple[str, Any], int | None] = {}
        self.claims: dict[tuple[str, Any], list[int]] = {}

    def run(self, forms: list, depth: int = 0) -> tuple[list, dict]:
        ops = self._expand(forms, 0)
        self._prime(ops)
        for op in ops:  # a temporary id with a unique identity that exists is that entity
            if op[0] == "add" and isinstance(op[1], str) and op[1] not in self.tempids:
                a = self.schema.get(op[2])
                if a.unique == "identity" and (found := self._holder(a, op[3])) is not None:
                    self.tempids[op[1]] = found
        for op in ops:
            getattr(self, f"_{op[0]}")(*op[1:])
        return self.out, self.tempids

    def _prime(self, ops: list[tuple]) -> None:
        """Reads in one job what the forms will ask of entities that they name by id, and in one each the holders of unique values."""
        pairs = {(op[1], op[2]) for op in ops if len(op) > 2 and isinstance(op[1], int) and not isinstance(op[1], bool)}
        if len(pairs) > 1:
            ids, idents = {e for e, _ in pairs}, {self.schema.get(i).ident for _, i in pairs}
            self.known = {(e, i): [] for e in ids for i in idents}
            columns = list(dict.fromkeys(TYPES[self.schema.get(i).type][0] for i in idents))
            rows = self.db.log().where(F.col("e").isin(list(ids)) & F.col("attr").isin(list(idents)))
            rows = rows.groupBy("e", "attr", *columns).agg(F.max(F.struct("t", "seq", "added")).alias("m")).where("m.added")
            for row in rows.collect():  # the values of the entities that the forms name
                self.known[row["e"], row["attr"]].append(row[TYPES[self.schema.get(row["attr"]).type][0]])
        plain = {"string": str, "long": int, "uuid": str}
        asked: dict[str, set] = {}
        for op in ops:
            a = self.schema.get(op[2]) if op[0] == "add" else None
            if a and a.unique and isinstance(op[3], plain.get(a.type, ())) and not isinstance(op[3], bool):
                asked.setdefault(a.ident, set()).add(op[3])
        for ident, values in asked.items():
            if len(values) > 1:
                self.held |= {(ident, v): None for v in values}
                rows = self.db.facts(self.schema.get(ident)).where(F.col("v").isin(list(values))).groupBy("v").agg(F.min("e"))
                self.held |= {(ident, v): e for v, e in rows.collect()}

    def _holder(self, a: Attribute, v: Any) -> int | None:
        """The entity that has a unique value at the basis."""
        if isinstance(v, (str, int)) and not isinstance(v, Keyword) and (a.ident, v) in self.held:
            return self.held[a.ident, v]
        return self.db.lookup(Keyword(a.ident), v)

    def _expand(self, forms: list, depth: int) -> list[tuple]:
        if depth > 16:
            raise TxError("transaction functions call each other too deep")
        ops: list[tuple] = []
        for form in forms:
            if isinstance(form, dict):
                e = form.get(Keyword("db/id"), f"__{len(ops)}_{depth}_{id(form)}")
                for k, v in form.items():
                    if k != Keyword("db/id"):
                        many = self.schema.get(k).many and isinstance(v, (list, tuple, set, frozenset)) and not self._is_lookup(v)
                        ops += [("add", e, k.name, x) for x in (v if many else [v])]
                continue
            head, *args = form
            name = head.name if isinstance(head, Keyword) else str(head)
            if name == "db/add":
                ops.append(("add", args[0], args[1].name, args[2]))
            elif name == "db/retract":
                ops.append(("retract", args[0], args[1].name, *(args[2:] or [None])))
            elif name in ("db/cas", "db.fn/cas"):
                ops.append(("cas", args[0], args[1].name, args[2], args[3]))
            elif name in ("db/retractEntity", "db.fn/retractEntity"):
                ops.append(("retract_entity", args[0]))
            elif name in self.conn.functions:
                made = self.conn.functions[name](self.db, *args)
                ops += self._expand(made, depth + 1)
            else:
                raise TxError(f"no operation :{name}")
        return ops

    @staticmethod
    def _is_lookup(v: Any) -> bool:
        return isinstance(v, (list, tuple)) and not isinstance(v, EdnList) and len(v) == 2 and isinstance(v[0], Keyword)

    def _entity(self, e: Any) -> int:
        if isinstance(e, str):
            if e == "datomic.tx":
                return TX << SHIFT | self.t
            if e not in self.tempids:
                self.tempids[e] = self.next
                self.next += 1
            return self.tempids[e]
        if e == Keyword("db/current-tx"):
            return TX << SHIFT | self.t
        found = self.db.resolve(e)
        if found is None:
            raise TxError(f"no entity {e}")
        return found

    def _value(self, a: Attribute, v: Any) -> Any:
        if a.type == "ref":
            return self._entity(v)
        if a.type == "double" and isinstance(v, int) and not isinstance(v, bool):
            return float(v)
        if a.type == "instant" and isinstance(v, int) and not isinstance(v, bool):
            return dt.datetime.fromtimestamp(v / 1000, dt.timezone.utc).replace(tzinfo=None)
        if a.type == "keyword" and isinstance(v, Keyword):
            return v.name
        if a.type == "uuid" and isinstance(v, Tagged):
            return v.value
        kinds = {"boolean": bool, "long": int, "double": float, "instant": dt.datetime, "uuid": str, "string": str, "bytes": bytes}
        if a.type not in kinds or not isinstance(v, kinds[a.type]) or a.type == "long" and isinstance(v, bool):
            raise TxError(f":{a.ident} takes {a.type}, not {v!r}")
        return v

    def _values(self, e: int, a: Attribute) -> list:
        key = (e, a.ident)
        if key not in self.known and self.fresh <= e < self.next:
            self.known[key] = []
        if key not in self.known:
            column = TYPES[a.type][0]
            rows = self.db.log().where((F.col("e") == e) & (F.col("attr") == a.ident)).groupBy(column).agg(F.max(F.struct("t", "seq", "added")).alias("m")).where("m.added")
            self.known[key] = [r[0] for r in rows.collect()]  # one entity's values of one attribute
        return self.known[key]

    def _emit(self, e: int, a: Attribute, v: Any, added: bool) -> None:
        if a.ident in self.db.sealed:
            raise TxError(f"no key of {a.protection.name} to write :{a.ident}")
        values = self._values(e, a)
        values.append(v) if added else values.remove(v)
        self.out.append((e, a.ident, v, added))
        if a.unique and added:
            self.claims.setdefault((a.ident, v), []).append(e)

    def _add(self, e: Any, ident: str, v: Any) -> None:
        a = self.schema.get(ident)
        if a.namespace in ("db", "db.install") and a.ident != "db/txInstant":
            raise TxError(f":{ident} belongs to the engine")
        if a.retired:
            raise TxError(f":{a.ident} is retired")
        e, v = self._entity(e), self._value(a, v)
        values = self._values(e, a)
        if v in values:
            return
        if a.unique:
            held = self._holder(a, v)
            taken = any(x != e and v in self._values(x, a) for x in self.claims.get((a.ident, v), ()))
            if taken or held is not None and held != e and v in self._values(held, a):
                raise TxError(f":{ident} {v!r} is taken")
        if not a.many and values:
            self._emit(e, a, values[0], False)
        self._emit(e, a, v, True)

    def _retract(self, e: Any, ident: str, v: Any) -> None:
        a, e = self.schema.get(ident), self._entity(e)
        for x in list(self._values(e, a)):
            if v is None or x == self._value(a, v):
                self._emit(e, a, x, False)

    def _cas(self, e: Any, ident: str, old: Any, new: Any) -> None:
        a, e = self.schema.get(ident), self._entity(e)
        if a.many:
            raise TxError(f":{ident} has many values")
        if a.retired:
            raise TxError(f":{a.ident} is retired")
        values = self._values(e, a)
        if (values[0] if values else None) != (None if old is None else self._value(a, old)):
            raise TxError(f":{ident} isn't {old!r}")
        if values:
            self._emit(e, a, values[0], False)
        self._emit(e, a, self._value(a, new), True)

    def _retract_entity(self, e: Any) -> None:
        todo, seen = [self._entity(e)], set()
        while todo:
            level = [x for x in dict.fromkeys(todo) if x not in seen]
            seen.update(level)
            todo = []
            self._read_all(level)
            for e in level:
                for a in self.schema.attributes.values():
                    values = list(self._values(e, a))
                    if a.component:
                        todo += values
                    for v in values:
                        self._emit(e, a, v, False)
                    if a.type == "ref":
                        for other in self.backs.get((e, a.ident), ()):
                            if e in self._values(other, a):
                                self._emit(other, a, e, False)

    def _read_all(self, entities: list[int]) -> None:
        """All values of some entities, and who refers to them: in two jobs."""
        self.backs: dict[tuple[int, str], list[int]] = {}
        columns = [c for c, _ in TYPES.values()]
        fold = lambda rows, *keys: rows.groupBy(*keys).agg(F.max(F.struct("t", "seq", "added")).alias("m")).where("m.added").collect()
        new = [e for e in entities if not self.fresh <= e < self.next]
        found: dict[tuple[int, str], list] = {(e, i): [] for e in new for i in self.schema.attributes}
        for row in fold(self.db.log().where(F.col("e").isin(new)), "e", "attr", *columns):
            if row["attr"] in self.schema.attributes:
                found[row["e"], row["attr"]].append(row[TYPES[self.schema.get(row["attr"]).type][0]])
        for key, values in found.items():
            self.known.setdefault(key, values)
        for row in fold(self.db.log().where(F.col("v_ref").isin(entities)), "e", "attr", "v_ref"):
            self.backs.setdefault((row["v_ref"], row["attr"]), []).append(row["e"])
        for (e, ident), values in self.known.items():  # who refers to them in this transaction
            for v in values:
                if v in entities and self.schema.get(ident).type == "ref" and e not in self.backs.setdefault((v, ident), []):
                    self.backs[v, ident].append(e)
