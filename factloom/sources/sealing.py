"""Sealed values: what protected attributes hold in the log, for readers with and without a class's key.

A sealed row has its value as ciphertext in v_bytes and "sealed" as its vt. Sealing is deterministic for an
attribute: AES-GCM by Spark's own functions, with a nonce that a keyed hash takes from attribute and value,
so equal values look equal and retractions find what was asserted. It isn't AES-GCM-SIV: bytes sealed
elsewhere don't open here. Keys are literals of the plans that seal and open, so a cluster whose plans or
event logs others read should redact them (spark.sql.redaction.string.regex).
"""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.schema import TYPES, Attribute, Schema

SEALED = "sealed"


def closed(schema: Schema, keys: Mapping[str, bytes]) -> frozenset[str]:
    """The attributes that a holder of keys (class name -> key) can't read."""
    return frozenset(a.ident for a in schema.attributes.values() if a.protection is not None and a.protection.name not in keys)


def _text(a: Attribute) -> Column:
    c = F.col(TYPES[a.type][0])
    return F.hex(c) if a.type == "bytes" else F.unix_micros(c).cast("string") if a.type == "instant" else c.cast("string")


def _value(a: Attribute, text: Column) -> Column:
    if a.type == "bytes":
        return F.unhex(text)
    if a.type == "instant":
        return F.timestamp_micros(text.cast("bigint"))
    return text.cast({"boolean": "boolean", "long": "bigint", "double": "double"}.get(a.type, "string"))


def seal(a: Attribute, key: bytes) -> Column:
    """The ciphertext of an attribute's value in a log row."""
    text = _text(a)
    framed = F.concat(F.char_length(text).cast("string"), F.lit(":"), text)
    if a.protection.padding:
        framed = F.concat(framed, F.repeat(F.lit(" "), F.pmod(-F.octet_length(framed), F.lit(a.protection.padding)).cast("int")))
    own = F.lit(hmac.new(key, a.ident.encode(), hashlib.sha256).digest())
    mark = F.sha2(F.concat(own, F.unhex(F.sha2(F.concat(own, framed.cast("binary")), 256))), 256)
    return F.aes_encrypt(framed.cast("binary"), F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.unhex(F.substring(mark, 1, 24)), F.lit(a.ident.encode()))


def opened_value(a: Attribute, key: bytes) -> Column:
    """The value behind v_bytes; a wrong key or a ciphertext of another attribute fails."""
    framed = F.aes_decrypt(F.col("v_bytes"), F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.lit(a.ident.encode())).cast("string")
    size = F.substring_index(framed, ":", 1)
    return _value(a, F.substring(framed, F.char_length(size) + 2, size.cast("int")))


def sealed(rows: DataFrame, schema: Schema, keys: Mapping[str, bytes]) -> DataFrame:
    """Log rows with the values of protected attributes sealed; without the key, such rows fail."""
    for a in schema.attributes.values():
        if a.protection is None:
            continue
        mine, column = (F.col("attr") == a.ident) & (F.col("vt") != SEALED), TYPES[a.type][0]
        key = keys.get(a.protection.name)
        made = F.raise_error(F.lit(f"no key of {a.protection.name} to seal :{a.ident}")).cast("binary") if key is None else seal(a, key)
        rows = rows.withColumns({
            "v_bytes": F.when(mine, made).otherwise(F.col("v_bytes")), "vt": F.when(mine, F.lit(SEALED)).otherwise(F.col("vt")),
            **({column: F.when(~mine, F.col(column))} if column != "v_bytes" else {}),
        })
    return rows


def opened(log: DataFrame, schema: Schema, keys: Mapping[str, bytes]) -> DataFrame:
    """The log with the values that keys open as if they had never been sealed."""
    for a in schema.attributes.values():
        if a.protection is None or a.protection.name not in keys:
            continue
        mine, column = (F.col("attr") == a.ident) & (F.col("vt") == SEALED), TYPES[a.type][0]
        log = log.withColumns({
            column: F.when(mine, opened_value(a, keys[a.protection.name])).otherwise(F.col(column)), "vt": F.when(mine, F.lit(a.type)).otherwise(F.col("vt")),
            **({"v_bytes": F.when(~mine, F.col("v_bytes"))} if column != "v_bytes" else {}),
        })
    return log
