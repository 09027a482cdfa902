"""The driver's tables as facts, and a log derived from the orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.db import Db
from factloom.schema import Attribute, Schema
from factloom.sources.facts import VALUES, LogSource, RelationalSource, Table, entity, reference

#: Partition of each table's entities; the key column; and its attributes: name, type, SQL.
PARTITIONS = {"region": 16, "nation": 17, "customer": 18, "supplier": 19, "part": 20, "orders": 21, "lineitem": 22, "events": 23, "document": 24}
TABLES = {
    "region": ("region", "r_regionkey", [("key", "long", "r_regionkey"), ("name", "string", "r_name")]),
    "nation": ("nation", "n_nationkey", [("key", "long", "n_nationkey"), ("name", "string", "n_name"), ("region", "ref", reference(16, "n_regionkey"))]),
    "customer": ("customer", "c_custkey", [("key", "long", "c_custkey"), ("name", "string", "c_name"), ("nation", "ref", reference(17, "c_nationkey")), ("acctbal", "double", "c_acctbal"), ("segment", "string", "c_mktsegment")]),
    "supplier": ("supplier", "s_suppkey", [("key", "long", "s_suppkey"), ("name", "string", "s_name"), ("nation", "ref", reference(17, "s_nationkey")), ("acctbal", "double", "s_acctbal")]),
    "part": ("part", "p_partkey", [("key", "long", "p_partkey"), ("name", "string", "p_name"), ("brand", "string", "p_brand"), ("type", "string", "p_type"), ("size", "long", "p_size"), ("price", "double", "p_retailprice"), ("words", "string*", "split(p_name, ' ')")]),
    "orders": ("orders", "o_orderkey", [("key", "long", "o_orderkey"), ("customer", "ref", reference(18, "o_custkey")), ("status", "string", "o_orderstatus"), ("price", "double", "o_totalprice"), ("date", "instant", "o_orderdate"), ("priority", "string", "o_orderpriority")]),
    "lineitem": ("lineitem", "row_index", [("order", "ref", reference(21, "l_orderkey")), ("part", "ref", reference(20, "l_partkey")), ("supplier", "ref", reference(19, "l_suppkey")), ("quantity", "double", "l_quantity"), ("extended", "double", "l_extendedprice"), ("discount", "double", "l_discount"), ("returned", "string", "l_returnflag"), ("shipped", "instant", "l_shipdate")]),
    "events": ("events", "event_id", [("key", "long", "event_id"), ("user", "long", "user_id"), ("type", "string", "event_type"), ("value", "double", "value"), ("at", "instant", "ts"), ("props", "string", "props")]),
}


def warehouse(spark: SparkSession, sf_dir: str) -> Db:
    tables, attributes = [], []
    for ns, (file, key, columns) in TABLES.items():
        frame = spark.read.parquet(f"{sf_dir}/{file}.parquet")
        if key == "row_index":  # no column is unique; the scan's row numbers are
            frame = frame.select("*", F.col("_metadata.row_index").alias("row_index"))
        tables.append(Table(frame, key, PARTITIONS[ns], {f"{ns}/{name}": sql for name, _, sql in columns}))
        attributes += [Attribute(f"{ns}/{name}", type_.rstrip("*"), many=type_.endswith("*"), unique="identity" if name == "key" else None, indexed=name in ("key", "price", "date")) for name, type_, _ in columns]
    schema = Schema.of(attributes)
    return Db(spark, RelationalSource(tuple(tables), schema), schema)


def sparse(spark: SparkSession, sf_dir: str) -> Db:
    """Orders whose priority is a fact only where it is the highest."""
    frame = spark.read.parquet(f"{sf_dir}/orders.parquet")
    columns = {"orders/key": "o_orderkey", "orders/urgent": "if(o_orderpriority = '1-URGENT', o_orderpriority, null)"}
    schema = Schema.of([Attribute("orders/key", "long", unique="identity"), Attribute("orders/urgent", "string")])
    return Db(spark, RelationalSource((Table(frame, "o_orderkey", PARTITIONS["orders"], columns),), schema), schema)


def chain(spark: SparkSession, sf_dir: str) -> Db:
    """Parts, each with a reference to the part whose key is its size."""
    frame = spark.read.parquet(f"{sf_dir}/part.parquet")
    columns = {"node/key": "p_partkey", "node/next": reference(PARTITIONS["part"], "p_size")}
    schema = Schema.of([Attribute("node/key", "long", unique="identity"), Attribute("node/next", "ref")])
    return Db(spark, RelationalSource((Table(frame, "p_partkey", PARTITIONS["part"], columns),), schema), schema)


def _rows(df: DataFrame, attr: str, a: int, vt: str, column: str, value: str, t: int, seq: int, added: bool) -> DataFrame:
    values = [(F.expr(value) if c == column else F.lit(None)).cast(kind).alias(c) for c, kind in VALUES]
    return df.select(entity(PARTITIONS["orders"], "o_orderkey").alias("e"), F.lit(a).cast("bigint").alias("a"), F.lit(attr).alias("attr"), F.lit(vt).alias("vt"), *values, F.lit(t).cast("bigint").alias("t"), F.lit(seq).alias("seq"), F.lit(added).alias("added"))


def orders_log(spark: SparkSession, sf_dir: str) -> Db:
    """t=1 adds each order's key, price and status O; t=2 replaces the status by the real one; t=3 retracts the price of every tenth key."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    moved = orders.where("o_orderstatus <> 'O'")
    log = _rows(orders, "order/key", 100, "long", "v_long", "o_orderkey", 1, 0, True)
    for part in (
        _rows(orders, "order/price", 101, "double", "v_double", "o_totalprice", 1, 1, True),
        _rows(orders, "order/status", 102, "string", "v_string", "'O'", 1, 2, True),
        _rows(moved, "order/status", 102, "string", "v_string", "'O'", 2, 0, False),
        _rows(moved, "order/status", 102, "string", "v_string", "o_orderstatus", 2, 1, True),
        _rows(orders.where("o_orderkey % 10 = 0"), "order/price", 101, "double", "v_double", "o_totalprice", 3, 0, False),
    ):
        log = log.unionByName(part)
    schema = Schema.of([Attribute("order/key", "long", unique="identity", indexed=True), Attribute("order/price", "double", indexed=True), Attribute("order/status", "string")])
    return Db(spark, LogSource(log, schema), schema, basis_t=3)

