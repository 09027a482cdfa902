"""The registered queries of the fact engine, and the SQL they are checked against."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.db import q
from factloom.edn import Keyword, write
from factloom.operators import access, impact, migration
from factloom.schema import Attribute, Protection, Schema
from factloom.sources.connection import BasisMismatch, Connection, TxError
from factloom.streaming import reports

from .mutation import execute
from .sql import SqlSession
from .warehouse import chain, orders_log, sparse, warehouse

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def datalog(name: str, query: str, columns: str, sql: str, *inputs, dbs=lambda s, d: [warehouse(s, d)], rounded: dict[str, int] | None = None, functions: dict | None = None) -> None:
    """Registers a Datalog query whose columns are renamed to those of the SQL; sums of doubles are rounded on both sides, as they depend on the order, and moved off the ties of rounding."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = q(query, *dbs(spark, sf_dir), *inputs, functions=functions).df.toDF(*columns.split())
        return df.withColumns({c: F.round(F.col(c) + 0.0000037, n) for c, n in (rounded or {}).items()})

    QUERIES[name], ORACLE_SQL[name] = run, sql


C, O, N, P, S = "customer", "orders", "nation", "part", "supplier"

datalog("pattern_const", '[:find ?k ?n :where [?c :customer/segment "BUILDING"] [?c :customer/key ?k] [?c :customer/name ?n]]', "k n", "select c_custkey k, c_name n from customer where c_mktsegment = 'BUILDING'")
datalog("pattern_join", "[:find ?ok ?cn :where [?o :orders/customer ?c] [?o :orders/key ?ok] [?c :customer/name ?cn]]", "ok cn", "select o_orderkey ok, c_name cn from orders join customer on o_custkey = c_custkey")
datalog("star_join", "[:find ?nation (count ?o) (avg ?p) :with ?o :where [?o :orders/customer ?c] [?o :orders/price ?p] [?c :customer/nation ?n] [?n :nation/name ?nation]]", "nation n_orders price", "select n_name nation, count(*) n_orders, round(avg(o_totalprice) + 0.0000037, 4) price from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey group by 1", rounded={"price": 4})
datalog("reverse_ref", '[:find ?k :where [?n :nation/name "NATION_3"] [?s :supplier/nation ?n] [?s :supplier/key ?k]]', "k", "select s_suppkey k from supplier join nation on s_nationkey = n_nationkey where n_name = 'NATION_3'")
datalog("repeated_var", "[:find ?k :where [?p :part/size ?x] [?p :part/key ?k] [?q :part/key ?x] [?q :part/size ?x]]", "k", "select distinct p.p_partkey k from part p join part q on q.p_partkey = p.p_size and q.p_size = p.p_size")
datalog("attr_var", '[:find ?a (count ?e) :where [?e ?a "NATION_3"]]', "a n", "select 'nation/name' a, count(*) n from nation where n_name = 'NATION_3' having count(*) > 0")
datalog("lookup_ref", "[:find ?n :where [[:customer/key 7] :customer/name ?n]]", "n", "select c_name n from customer where c_custkey = 7")
datalog("pred_range", "[:find ?k ?p :where [?o :orders/price ?p] [(> ?p 400000.0)] [(<= ?p 450000)] [?o :orders/key ?k]]", "k p", "select o_orderkey k, o_totalprice p from orders where o_totalprice > 400000 and o_totalprice <= 450000")
datalog("pred_chained", "[:find ?k :where [?p :part/size ?s] [?p :part/key ?k] [(< 10 ?s 20 30)]]", "k", "select p_partkey k from part where p_size > 10 and p_size < 20")
datalog("pred_neq", '[:find ?s (count ?o) :where [?o :orders/status ?s] [(!= ?s "F")]]', "s n", "select o_orderstatus s, count(*) n from orders where o_orderstatus <> 'F' group by 1")
datalog("pred_strings", '[:find ?n :where [?p :part/name ?n] [(starts-with? ?n "red")] [(ends-with? ?n "g")] [(includes? ?n " ")]]', "n", "select distinct p_name n from part where p_name like 'red%' and p_name like '%g' and p_name like '% %'")
datalog("pred_parity", "[:find ?k :where [?s :supplier/key ?k] [(odd? ?k)] [(pos? ?k)]]", "k", "select s_suppkey k from supplier where s_suppkey % 2 = 1 and s_suppkey > 0")
datalog("missing", "[:find ?k :where [?p :part/key ?k] (not [?l :lineitem/part ?p] [?l :lineitem/quantity ?q] [(> ?q 45.0)])]", "k", "select p_partkey k from part where p_partkey not in (select l_partkey from lineitem where l_quantity > 45)")
# in this database an order without the highest priority has no priority at all
datalog("missing_attr", "[:find ?k :where [?e :orders/key ?k] [(missing? $ ?e :orders/urgent)]]", "k", "select o_orderkey k from orders where o_orderpriority <> '1-URGENT'", dbs=lambda s, d: [sparse(s, d)])
datalog("get_else", '[:find ?k ?x :where [?e :orders/key ?k] [(get-else $ ?e :orders/urgent "no") ?x]]', "k x", "select o_orderkey k, case when o_orderpriority = '1-URGENT' then o_orderpriority else 'no' end x from orders", dbs=lambda s, d: [sparse(s, d)])
datalog("not_basic", '[:find ?k :where [?c :customer/key ?k] (not [?c :customer/segment "BUILDING"])]', "k", "select c_custkey k from customer where c_mktsegment <> 'BUILDING'")
datalog("not_join", '[:find ?n :where [?x :nation/name ?n] (not-join [?x] [?s :supplier/nation ?x] [?s :supplier/acctbal ?b] [(> ?b 9000.0)])]', "n", "select n_name n from nation where n_nationkey not in (select s_nationkey from supplier where s_acctbal > 9000)")
datalog("or_basic", '[:find ?k :where [?o :orders/key ?k] (or [?o :orders/status "F"] [?o :orders/priority "1-URGENT"])]', "k", "select o_orderkey k from orders where o_orderstatus = 'F' or o_orderpriority = '1-URGENT'")
datalog("or_join", '[:find ?n :where [?x :nation/name ?n] (or-join [?x] (and [?c :customer/nation ?x] [?c :customer/acctbal ?b] [(> ?b 9900.0)]) [?x :nation/key 3])]', "n", "select n_name n from nation where n_nationkey = 3 or n_nationkey in (select c_nationkey from customer where c_acctbal > 9900)")
datalog("in_scalar", "[:find ?k :in $ ?seg :where [?c :customer/segment ?seg] [?c :customer/key ?k]]", "k", "select c_custkey k from customer where c_mktsegment = 'MACHINERY'", "MACHINERY")
datalog("in_coll", "[:find ?n :in $ [?k ...] :where [?c :customer/key ?k] [?c :customer/name ?n]]", "n", "select c_name n from customer where c_custkey in (1, 5, 9)", [1, 5, 9])
datalog("in_rel", "[:find ?k ?label :in $ [[?st ?label]] :where [?o :orders/status ?st] [?o :orders/key ?k]]", "k label", "select o_orderkey k, case o_orderstatus when 'F' then 'done' else 'open' end label from orders where o_orderstatus in ('F', 'O')", [["F", "done"], ["O", "open"]])
datalog("in_tuple", "[:find ?k :in $ [?lo ?hi] :where [?p :part/size ?s] [(<= ?lo ?s ?hi)] [?p :part/key ?k]]", "k", "select p_partkey k from part where p_size between 5 and 7", [5, 7])
datalog("cross_product", "[:find ?a ?b :where [?r :region/name ?a] [?n :nation/name ?b]]", "a b", "select r_name a, n_name b from region, nation")
datalog("theta_join", "[:find ?a ?b :where [?r :region/key ?a] [?n :nation/key ?b] [(< ?a ?b)]]", "a b", "select cast(r_regionkey as bigint) a, cast(n_nationkey as bigint) b from region, nation where r_regionkey < n_nationkey")
datalog("fn_arith", "[:find ?k ?x :where [?p :part/key ?k] [?p :part/size ?s] [(* ?s 3) ?y] [(- ?y 1) ?z] [(+ ?z ?k) ?x]]", "k x", "select p_partkey k, p_size * 3 - 1 + p_partkey x from part")
datalog("fn_quot_rem_mod", "[:find ?k ?a ?b ?c :where [?p :part/key ?k] [(- 7 ?k) ?d] [(quot ?d 3) ?a] [(rem ?d 3) ?b] [(mod ?d 3) ?c]]", "k a b c", "select p_partkey k, cast(trunc((7 - p_partkey) / 3.0) as bigint) a, (7 - p_partkey) % 3 b, ((7 - p_partkey) % 3 + 3) % 3 c from part")
datalog("fn_divide", "[:find ?k ?x :where [?p :part/key ?k] [(/ ?k 4) ?x]]", "k x", "select p_partkey k, p_partkey / 4.0::double x from part")
datalog("fn_str", '[:find ?x :where [?n :nation/key ?k] [?n :nation/name ?m] [(str ?k "-" ?m) ?x]]', "x", "select concat(n_nationkey, '-', n_name) x from nation")
datalog("fn_subs_case", "[:find ?a ?b ?c :where [?r :region/name ?m] [(subs ?m 1 3) ?a] [(lower-case ?m) ?b] [(count ?m) ?c]]", "a b c", "select substr(r_name, 2, 2) a, lower(r_name) b, cast(length(r_name) as bigint) c from region")
datalog("ground_rel", '[:find ?x ?n :where [(ground [[1 "one"] [2 "two"]]) [[?k ?x]]] [?r :region/key ?k] [?r :region/name ?n]]', "x n", "select case r_regionkey when 1 then 'one' else 'two' end x, r_name n from region where r_regionkey in (1, 2)")
datalog("agg_count_set", "[:find (count ?s) :where [?o :orders/status ?s]]", "n", "select count(distinct o_orderstatus) n from orders")
datalog("agg_count_with", "[:find (count ?s) :with ?o :where [?o :orders/status ?s]]", "n", "select count(*) n from orders")
datalog("agg_count_distinct", "[:find ?s (count-distinct ?c) :with ?o :where [?o :orders/status ?s] [?o :orders/customer ?c]]", "s n", "select o_orderstatus s, count(distinct o_custkey) n from orders group by 1")
datalog("agg_sum", "[:find ?b (sum ?s) :with ?p :where [?p :part/brand ?b] [?p :part/size ?s]]", "b s", "select p_brand b, cast(sum(p_size) as bigint) s from part group by 1")
datalog("agg_median", "[:find ?b (median ?s) :with ?p :where [?p :part/brand ?b] [?p :part/size ?s]]", "b m", "select p_brand b, cast(quantile_disc(p_size, 0.5) as bigint) m from part group by 1")
datalog("agg_min_max", "[:find ?b (min ?s) (max ?s) :with ?p :where [?p :part/brand ?b] [?p :part/size ?s]]", "b lo hi", "select p_brand b, cast(min(p_size) as bigint) lo, cast(max(p_size) as bigint) hi from part group by 1")
datalog("agg_grouped_multi", "[:find ?s ?pr (count ?o) (min ?k) (max ?k) :where [?o :orders/status ?s] [?o :orders/priority ?pr] [?o :orders/key ?k]]", "s pr n lo hi", "select o_orderstatus s, o_orderpriority pr, count(*) n, min(o_orderkey) lo, max(o_orderkey) hi from orders group by 1, 2")
datalog("or_and", '[:find ?k :where [?o :orders/key ?k] (or (and [?o :orders/status "F"] [?o :orders/priority "1-URGENT"]) (and [?o :orders/status "O"] [?o :orders/priority "5-LOW"]))]', "k", "select o_orderkey k from orders where (o_orderstatus = 'F' and o_orderpriority = '1-URGENT') or (o_orderstatus = 'O' and o_orderpriority = '5-LOW')")
datalog("agg_sum_avg", "[:find ?b (sum ?s) (avg ?s) :with ?p :where [?p :part/brand ?b] [?p :part/size ?s]]", "b s a", "select p_brand b, cast(sum(p_size) as bigint) s, avg(cast(p_size as double)) a from part group by 1")
datalog("find_coll", "[:find [?n ...] :where [_ :region/name ?n]]", "n", "select r_name n from region")
datalog("find_tuple", "[:find [?k ?n] :where [?x :nation/key ?k] [?x :nation/name ?n]]", "k n", "select cast(n_nationkey as bigint) k, n_name n from nation order by 1, 2 limit 1")
datalog("find_scalar", '[:find ?k . :where [?x :nation/name "NATION_9"] [?x :nation/key ?k]]', "k", "select cast(n_nationkey as bigint) k from nation where n_name = 'NATION_9'")

RULES = """[[(rich ?x) [?x :customer/acctbal ?b] [(> ?b 9500.0)]] [(rich ?x) [?x :supplier/acctbal ?b] [(> ?b 9500.0)]]
  [(next ?a ?b) [?a :part/key ?k] [(inc ?k) ?m] [(mod ?k 7) ?z] [(!= ?z 0)] [?b :part/key ?m]]
  [(reach ?a ?b) (next ?a ?b)] [(reach ?a ?b) (next ?a ?c) (reach ?c ?b)]
  [(even-step ?a ?b) (next ?a ?c) (next ?c ?b)] [(even-step ?a ?b) (odd-step ?a ?c) (next ?c ?b)]
  [(odd-step ?a ?b) (next ?a ?b)] [(odd-step ?a ?b) (even-step ?a ?c) (next ?c ?b)]
  [(plain ?x) [?x :customer/key _] (not (rich ?x))]]"""
_REACH = "with recursive r(a, b) as (select p_partkey, p_partkey + 1 from part where p_partkey % 7 <> 0 and p_partkey + 1 < (select count(*) from part) union select r.a, r.b + 1 from r where r.b % 7 <> 0 and r.b + 1 < (select count(*) from part))"
datalog("rule_union", "[:find ?n :in $ % :where (rich ?x) (or [?x :customer/name ?n] [?x :supplier/name ?n])]", "n", "select c_name n from customer where c_acctbal > 9500 union select s_name from supplier where s_acctbal > 9500", RULES)
datalog("rule_closure", "[:find ?x ?y :in $ % :where (reach ?a ?b) [?a :part/key ?x] [?b :part/key ?y]]", "x y", _REACH + " select a x, b y from r", RULES)
datalog("rule_bound", "[:find ?y :in $ % ?x :where [?a :part/key ?x] (reach ?a ?b) [?b :part/key ?y]]", "y", _REACH + " select b y from r where a = 8", RULES, 8)
datalog("rule_bound_end", "[:find ?x :in $ % :where [?b :part/key 14] (reach ?a ?b) [?a :part/key ?x]]", "x", _REACH + " select a x from r where b = 14", RULES)
datalog("rule_mutual", "[:find ?x ?y :in $ % :where (even-step ?a ?b) [?a :part/key ?x] [?b :part/key ?y]]", "x y", _REACH + " select a x, b y from r where (b - a) % 2 = 0", RULES)
datalog("rule_not", "[:find (count ?x) :in $ % :where (plain ?x)]", "n", "select count(*) n from customer where not c_acctbal > 9500", RULES)


datalog("rule_alias", "[:find ?n :in $ % :where (named ?x ?n) [?x :nation/region ?r] [?r :region/key 1]]", "n", "select n_name n from nation where n_regionkey = 1", "[[(named ?e ?name) [?e :nation/name ?name]]]")
datalog("rule_required", "[:find ?n ?k :in $ % ?k :where (of ?k ?n)]", "n k", "select n_name n, cast(3 as bigint) k from nation where n_nationkey = 3", "[[(of [?k] ?n) [?x :nation/key ?k] [?x :nation/name ?n]]]", 3)


def timed(name: str, view: Callable, query: str, columns: str, sql: str, *inputs) -> None:
    datalog(name, query, columns, sql, *inputs, dbs=lambda s, d: view(orders_log(s, d)))


STATUS = "[:find ?k ?s :where [?o :order/key ?k] [?o :order/status ?s]]"
timed("view_current", lambda db: [db], STATUS, "k s", "select o_orderkey k, o_orderstatus s from orders")
timed("view_as_of", lambda db: [db.as_of(1)], STATUS, "k s", "select o_orderkey k, 'O' s from orders")
timed("view_since", lambda db: [db.since(1)], "[:find ?k ?s :where [?o :order/status ?s] [(mod ?o 4398046511104) ?k]]", "k s", "select o_orderkey k, o_orderstatus s from orders where o_orderstatus <> 'O'")
timed("view_history", lambda db: [db.history()], "[:find ?a ?s (count ?o) :where [?o :order/status ?s ?tx ?a]]", "added s n", "select true added, s, sum(n)::bigint n from (select 'O' s, count(*) n from orders union all select o_orderstatus, count(*) from orders where o_orderstatus <> 'O' group by 1) group by s union all select false, 'O', count(*) from orders where o_orderstatus <> 'O'")
timed("view_price", lambda db: [db], "[:find (count ?o) :where [?o :order/price ?p]]", "n", "select count(*) n from orders where o_orderkey % 10 <> 0")
timed("multi_db", lambda db: [db, db.as_of(2)], "[:find ?k :in $ $old :where [?o :order/key ?k] [$old ?o :order/price ?p] (not [?o :order/price ?p])]", "k", "select o_orderkey k from orders where o_orderkey % 10 = 0")
timed("tx_join", lambda db: [db], "[:find ?t (count ?o) :where [?o :order/status ?s ?tx] [(mod ?tx 4398046511104) ?t]]", "t n", "select case when o_orderstatus = 'O' then 1 else 2 end::bigint t, count(*) n from orders group by 1")


def frames(name: str, sql: str):
    def register(f):
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return register


@frames("index_range", "select o_orderkey k, o_totalprice v from orders where o_totalprice >= 1000 and o_totalprice < 50000")
def index_range(spark, sf_dir):
    return warehouse(spark, sf_dir).index_range(":orders/price", 1000, 50000).selectExpr("e & 4398046511103 k", "v")


@frames("seek_datoms", "select p, v from (select 'price' p, o_totalprice v from orders where o_totalprice >= 300000 union all select 'key', p_partkey from part union all select 'price', p_retailprice from part union all select 'key', r_regionkey from region union all select 'key', s_suppkey from supplier)")
def seek_datoms(spark, sf_dir):
    """Everything in AVET order from a price on: higher prices, and all that is indexed under later attributes."""
    df = warehouse(spark, sf_dir).seek_datoms("avet", ":orders/price", 300000)
    return df.selectExpr("split(attr, '/')[1] p", "cast(v as double) v")


@frames("seek_numbers", "select o_orderkey v from orders where o_orderkey >= 9 order by 1 limit 200")
def seek_numbers(spark, sf_dir):
    """In AVET 10 follows 9."""
    return warehouse(spark, sf_dir).seek_datoms("avet", ":orders/key", 9, limit=200).selectExpr("cast(v as bigint) v")


@frames("datoms_prefix", "select 'customer/name' attr, '\"' || c_name || '\"' v from customer where c_custkey = 7 union all select 'customer/key', '7' from customer where c_custkey = 7 union all select 'customer/segment', '\"' || c_mktsegment || '\"' from customer where c_custkey = 7 union all select 'customer/nation', ((17::bigint << 42) + c_nationkey)::varchar from customer where c_custkey = 7 union all select 'customer/acctbal', 'd' from customer where c_custkey = 7")
def datoms_prefix(spark, sf_dir):
    """All facts of one customer; the text of the double is checked in datoms_double."""
    return warehouse(spark, sf_dir).datoms("eavt", (18 << 42) + 7).selectExpr("attr", "if(attr = 'customer/acctbal', 'd', v) v")


@frames("datoms_double", "select o_orderkey k, o_totalprice v from orders where o_totalprice = (select min(o_totalprice) from orders)")
def datoms_double(spark, sf_dir):
    db = warehouse(spark, sf_dir)
    least = db.index_range(":orders/price").first()["v"]
    return db.datoms("avet", ":orders/price", least).selectExpr("e & 4398046511103 k", "cast(v as double) v")


@frames("datoms_vaet", "select s_suppkey k from supplier where s_nationkey = 4")
def datoms_vaet(spark, sf_dir):
    return warehouse(spark, sf_dir).datoms("vaet", (17 << 42) + 4, ":supplier/nation").selectExpr("e & 4398046511103 k")


@frames("datoms_limit", "select l_quantity v from lineitem order by 1 limit 1000")
def datoms_limit(spark, sf_dir):
    db = warehouse(spark, sf_dir)
    return db.datoms("aevt", ":lineitem/quantity").selectExpr("cast(v as double) v").orderBy("v").limit(1000)


@frames("datoms_for_attribute", "select event_id k, event_type v from events")
def datoms_for_attribute(spark, sf_dir):
    return warehouse(spark, sf_dir).datoms_for_attribute(":events/type").selectExpr("e & 4398046511103 k", "v")


@frames("values_of", "select c_name v from customer where c_custkey = 11")
def values_of(spark, sf_dir):
    return warehouse(spark, sf_dir).values([Keyword("customer/key"), 11], ":customer/name")


@frames("lookup_value", "select ((18::bigint << 42) + 12) e from customer where c_custkey = 12")
def lookup_value(spark, sf_dir):
    return spark.createDataFrame([(warehouse(spark, sf_dir).lookup(Keyword("customer/key"), 12),)], "e long")


@frames("tx_range", "select t::bigint t, k, a, s, added from (select 1 t, o_orderkey k, 'order/key' a, o_orderkey::varchar s, true added from orders union all select 1, o_orderkey, 'order/price', 'd', true from orders union all select 1, o_orderkey, 'order/status', '\"O\"', true from orders union all select 2, o_orderkey, 'order/status', '\"O\"', false from orders where o_orderstatus <> 'O' union all select 2, o_orderkey, 'order/status', '\"' || o_orderstatus || '\"', true from orders where o_orderstatus <> 'O' union all select 3, o_orderkey, 'order/price', 'd', false from orders where o_orderkey % 10 = 0)")
def tx_range(spark, sf_dir):
    return orders_log(spark, sf_dir).tx_range(1, 4).selectExpr("t", "e & 4398046511103 k", "attr a", "if(attr = 'order/price', 'd', v) s", "added")


@frames("recorded_since", "select 3::bigint t, o_orderkey k from orders where o_orderkey % 10 = 0")
def recorded_since(spark, sf_dir):
    return orders_log(spark, sf_dir).recorded_since(2).selectExpr("t", "e & 4398046511103 k")


@frames("stats", "select 'order/key' attr, count(*) datoms, count(*) entities, count(distinct o_orderkey) \"values\" from orders union all select 'order/price', count(*), count(*), count(distinct o_totalprice) from orders where o_orderkey % 10 <> 0 union all select 'order/status', count(*), count(*), count(distinct o_orderstatus) from orders")
def stats(spark, sf_dir):
    return orders_log(spark, sf_dir).stats()


@frames("sql_wide_scan", "select n_name name, count(*) n, round(sum(c_acctbal), 2) total from customer join nation on c_nationkey = n_nationkey where c_mktsegment = 'BUILDING' group by 1")
def sql_wide_scan(spark, sf_dir):
    return SqlSession(warehouse(spark, sf_dir)).query("select n.name, count(*) n, round(sum(c.acctbal), 2) total from customer c join nation n on c.nation = n.e where c.segment = $1 group by n.name", "BUILDING")


@frames("sql_sys_datoms", "select 'nation/name' attr, count(*) n from nation union all select 'region/name', count(*) from region")
def sql_sys_datoms(spark, sf_dir):
    return SqlSession(warehouse(spark, sf_dir)).query("select attr, count(*) n from sys.datoms where attr in ('nation/name', 'region/name') group by attr")


@frames("impact_counts", "select count(*) datoms, count(*) entities, count(distinct o_orderpriority) \"values\" from orders")
def impact_counts(spark, sf_dir):
    return impact.attribute_impact(warehouse(spark, sf_dir), "orders/priority")


@frames("impact_duplicates", "select c_mktsegment v, count(*) n from customer group by 1 having count(*) > 1")
def impact_duplicates(spark, sf_dir):
    return impact.duplicate_values(warehouse(spark, sf_dir), "customer/segment")


def listed(name: str, find: str, sql: str) -> None:
    """Registers an aggregate of part sizes by brand that gives a list, as text on both sides."""

    def run(spark, sf_dir):
        df = q(f"[:find ?b {find} :where [?p :part/brand ?b] [?p :part/size ?s]]", warehouse(spark, sf_dir)).df.toDF("b", "l")
        return df.selectExpr("b", "array_join(l, ',') l")

    QUERIES[name], ORACLE_SQL[name] = run, f"select p_brand b, array_to_string({sql}, ',') l from part group by 1"


SIZES = "list_sort(list(distinct p_size))"
listed("agg_min_n", "(min 3 ?s)", f"{SIZES}[1:3]")
listed("agg_max_n", "(max 3 ?s)", f"{SIZES}[-3:]")
listed("agg_sample", "(sample 2 ?s)", f"{SIZES}[1:2]")
listed("agg_distinct", "(distinct ?s)", SIZES)


@frames("agg_var_std", "select p_brand b, round(var_pop(p_size), 6) v, round(stddev_pop(p_size), 6) d from part group by 1")
def agg_var_std(spark, sf_dir):
    df = q("[:find ?b (variance ?s) (stddev ?s) :with ?p :where [?p :part/brand ?b] [?p :part/size ?s]]", warehouse(spark, sf_dir)).df
    return df.toDF("b", "v", "d").selectExpr("b", "round(v, 6) v", "round(d, 6) d")


@frames("impact_cardinality", "select o_orderkey k, 2::bigint n from orders where o_orderstatus <> 'O'")
def impact_cardinality(spark, sf_dir):
    """Orders whose status has had two values, as all that was ever asserted shows."""
    db = orders_log(spark, sf_dir)
    db = replace(db, source=replace(db.source, log=db.source.log.where("added")))
    return impact.cardinality_conflicts(db, "order/status").selectExpr("e & 4398046511103 k", "n")


@frames("impact_live_refs", "select count(*) refs from orders")
def impact_live_refs(spark, sf_dir):
    return impact.live_refs(warehouse(spark, sf_dir), "orders/customer")


@frames("impact_history", "select sum(n)::bigint datoms, sum(a)::bigint assertions from (select count(*) n, count(*) a from orders union all select 2 * count(*), count(*) from orders where o_orderstatus <> 'O')")
def impact_history(spark, sf_dir):
    return impact.history_impact(orders_log(spark, sf_dir), "order/status")


@frames("sql_rollup", "select r.r_name region, n.n_name nation, count(*) n from nation n join region r on n_regionkey = r_regionkey group by rollup(r.r_name, n.n_name)")
def sql_rollup(spark, sf_dir):
    return SqlSession(warehouse(spark, sf_dir)).query("select r.name region, n.name nation, count(*) n from nation n join region r on n.region = r.e group by rollup(r.name, n.name)")


@frames("sql_window", "select p_partkey k, cast(row_number() over (partition by p_brand order by p_size, p_partkey) as bigint) place from part qualify place <= 3")
def sql_window(spark, sf_dir):
    return SqlSession(warehouse(spark, sf_dir)).query("select k, place from (select key k, cast(row_number() over (partition by brand order by size, key) as bigint) place from part) x where place <= 3")


@frames("sql_set_ops", "select n_nationkey::bigint k from nation intersect select s_nationkey from supplier except select c_nationkey from customer where c_acctbal > 9900")
def sql_set_ops(spark, sf_dir):
    sql = "select n.e & 4398046511103 k from nation n intersect select nation & 4398046511103 from supplier except select nation & 4398046511103 from customer where acctbal > $1"
    return SqlSession(warehouse(spark, sf_dir)).query(sql, 9900.0)


@frames("access_check", "select c_custkey k, case when n_regionkey in (1, 2) then 'granted' else 'denied' end outcome, case n_regionkey when 1 then 1 when 2 then 2 end hops from customer join nation on c_nationkey = n_nationkey")
def access_check(spark, sf_dir):
    """Who may view a report: members of the nations of region 1, which is its viewer, and of region 2, which owns its folder."""
    at = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    members = at("customer").selectExpr("concat('user:', c_custkey) subject", "'member' relation", "concat('nation:', c_nationkey) object")
    viewers = at("nation").selectExpr("concat('nation:', n_nationkey, '#member') subject", "if(n_regionkey = 1, 'viewer', 'owner') relation", "concat(if(n_regionkey = 1, 'report:', 'folder:'), n_regionkey) object")
    inside = spark.createDataFrame([("folder:2", "parent", "report:1")], "subject string, relation string, object string")
    rewrites = spark.createDataFrame([("viewer", "parent", "owner", "report")], "relation string, via_relation string, on_relation string, object_type string")
    requests = at("customer").selectExpr("c_custkey rid", "concat('user:', c_custkey) subject", "'viewer' relation", "'report:1' object")
    return access.check(members.union(viewers).union(inside), requests, rewrites).withColumnRenamed("rid", "k")


# Operators on the widest tables, and on attributes with many values

L, E = "lineitem", "events"
datalog("lineitem_star", '[:find ?k ?q ?d :where [?l :lineitem/returned "R"] [?l :lineitem/quantity ?q] [?l :lineitem/discount ?d] [?l :lineitem/order ?o] [?o :orders/key ?k] [(>= ?q 49.0)]]', "k q d", "select distinct l_orderkey k, l_quantity q, l_discount d from lineitem where l_returnflag = 'R' and l_quantity >= 49")
datalog("lineitem_join", "[:find ?n (count ?l) (sum ?q) :with ?l :where [?l :lineitem/supplier ?s] [?s :supplier/nation ?x] [?x :nation/name ?n] [?l :lineitem/quantity ?q]]", "n c q", "select n_name n, count(*) c, round(sum(l_quantity) + 0.0000037, 2) q from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey group by 1", rounded={"q": 2})
datalog("lineitem_parts", "[:find ?b (count-distinct ?o) :with ?l :where [?l :lineitem/part ?p] [?p :part/brand ?b] [?l :lineitem/order ?o]]", "b n", "select p_brand b, count(distinct l_orderkey) n from lineitem join part on l_partkey = p_partkey group by 1")
datalog("events_users", "[:find ?t (count-distinct ?u) (max ?v) :with ?e :where [?e :events/type ?t] [?e :events/user ?u] [?e :events/value ?v]]", "t n m", "select event_type t, count(distinct user_id) n, max(value) m from events group by 1")
datalog("many_values", '[:find ?k :where [?p :part/words "red"] [?p :part/key ?k]]', "k", "select p_partkey k from part where list_contains(string_split(p_name, ' '), 'red')")
datalog("many_group", "[:find ?w (count ?p) :where [?p :part/words ?w]]", "w n", "select w, count(distinct p_partkey) n from (select p_partkey, unnest(string_split(p_name, ' ')) w from part) group by 1")
datalog("attr_var_many", '[:find ?a (count ?e) :where [?e ?a "red"]]', "a n", "select 'part/words' a, count(*) n from part where list_contains(string_split(p_name, ' '), 'red') having count(*) > 0 union all select 'part/name', count(*) from part where p_name = 'red' having count(*) > 0")
datalog("attr_quotes", "[:find ?k ?v :where [?e ?a ?v] [?e :events/key ?k] [(< ?k 50)] [?e :events/props ?v]]", "k v", "select event_id k, props v from events where event_id < 50")
datalog("agg_median_double", "[:find ?s (median ?p) :with ?o :where [?o :orders/status ?s] [?o :orders/price ?p]]", "s m", "select o_orderstatus s, quantile_disc(o_totalprice, 0.5) m from orders group by 1")
datalog("agg_median_text", "[:find ?s (median ?p) :with ?o :where [?o :orders/status ?s] [?o :orders/priority ?p]]", "s m", "select o_orderstatus s, quantile_disc(o_orderpriority, 0.5) m from orders group by 1")
datalog("agg_global", "[:find (count ?l) (min ?q) (max ?q) (median ?q) :with ?l :where [?l :lineitem/quantity ?q]]", "n lo hi m", "select count(*) n, min(l_quantity) lo, max(l_quantity) hi, quantile_disc(l_quantity, 0.5) m from lineitem")

# Clauses that no query above shows

datalog("pred_equal", "[:find ?k :where [?p :part/size ?s] [?p :part/key ?k] [(= ?s 7)]]", "k", "select p_partkey k from part where p_size = 7")
datalog("pred_equal_vars", "[:find ?a ?b :where [?n :nation/key ?a] [?r :region/key ?b] [(== ?a ?b)]]", "a b", "select n_nationkey::bigint a, r_regionkey::bigint b from nation, region where n_nationkey = r_regionkey")
datalog("pred_signs", "[:find ?k :where [?p :part/key ?k] [(- ?k 20) ?d] [(neg? ?d)] [(even? ?k)] [(rem ?k 3) ?z] [(zero? ?z)]]", "k", "select p_partkey k from part where p_partkey < 20 and p_partkey % 2 = 0 and p_partkey % 3 = 0")
datalog("pred_booleans", "[:find ?k ?y :where [?p :part/key ?k] [(odd? ?k) ?x] [(true? ?x)] [(< ?k 100) ?y] [(false? ?y)]]", "k y", "select p_partkey k, false y from part where p_partkey % 2 = 1 and p_partkey >= 100")
datalog("pred_as_function", "[:find ?k ?big :where [?o :orders/key ?k] [?o :orders/price ?p] [(> ?p 200000.0) ?big]]", "k big", "select o_orderkey k, o_totalprice > 200000 big from orders")
datalog("extern_predicate", "[:find ?k :where [?p :part/key ?k] [?p :part/name ?n] [(long-name? ?n)]]", "k", "select p_partkey k from part where length(p_name) > 8", functions={"long-name?": (lambda n: F.char_length(n) > 8, "boolean", "scalar")})
datalog("extern_scalar", "[:find ?k ?x :where [?p :part/key ?k] [?p :part/name ?n] [(reversed ?n) ?x]]", "k x", "select p_partkey k, reverse(p_name) x from part", functions={"reversed": (lambda n: F.reverse(n), "string", "scalar")})
datalog("extern_collection", "[:find ?w (count ?p) :where [?p :part/name ?n] [(words ?n) [?w ...]]]", "w n", "select w, count(distinct p_partkey) n from (select p_partkey, unnest(string_split(p_name, ' ')) w from part) group by 1", functions={"words": (lambda n: F.split(n, " "), "string", "coll")})
datalog("self_reference", "[:find ?k :where [?e :node/next ?e] [?e :node/key ?k]]", "k", "select p_partkey k from part where p_size = p_partkey", dbs=lambda s, d: [chain(s, d)])
datalog("semi_join", "[:find ?n :where [?c :customer/name ?n] [?o :orders/customer ?c]]", "n", "select distinct c_name n from customer where c_custkey in (select o_custkey from orders)")
datalog("fn_abs_dec", "[:find ?k ?a ?d :where [?p :part/key ?k] [(- 50 ?k) ?x] [(abs ?x) ?a] [(dec ?k) ?d]]", "k a d", "select p_partkey k, abs(50 - p_partkey) a, p_partkey - 1 d from part")
datalog("fn_min_max", "[:find ?k ?a ?b :where [?p :part/key ?k] [?p :part/size ?s] [(min ?s ?k 30) ?a] [(max ?s ?k) ?b]]", "k a b", "select p_partkey k, least(p_size, p_partkey, 30)::bigint a, greatest(p_size, p_partkey)::bigint b from part")
datalog("fn_identity_upper", "[:find ?a ?b :where [?r :region/name ?m] [(lower-case ?m) ?l] [(upper-case ?l) ?a] [(identity ?m) ?b]]", "a b", "select upper(lower(r_name)) a, r_name b from region")
datalog("fn_str_types", '[:find ?x :where [?o :orders/key ?k] [?o :orders/date ?d] [(< ?k 200)] [(str ?k "/" ?d) ?x]]', "x", "select o_orderkey || '/' || epoch_ms(o_orderdate) x from orders where o_orderkey < 200")
datalog("instants", "[:find ?k ?d :where [?o :orders/date ?d] [(>= ?d 820454400000)] [?o :orders/key ?k]]", "k d", "select o_orderkey k, epoch_ms(o_orderdate) d from orders where epoch_ms(o_orderdate) >= 820454400000")
datalog("instant_between", "[:find (count ?l) :in $ ?from ?to :where [?l :lineitem/shipped ?d] [(<= ?from ?d)] [(< ?d ?to)]]", "n", "select count(*) n from lineitem where epoch_ms(l_shipdate) >= 820454400000 and epoch_ms(l_shipdate) < 852076800000", 820454400000, 852076800000)
datalog("ground_scalar", "[:find ?k ?x :where [(ground 3) ?k] [?n :nation/key ?k] [?n :nation/name ?x]]", "k x", "select n_nationkey::bigint k, n_name x from nation where n_nationkey = 3")
datalog("ground_coll", "[:find ?x :where [(ground [2 4 99]) [?k ...]] [?n :nation/key ?k] [?n :nation/name ?x]]", "x", "select n_name x from nation where n_nationkey in (2, 4)")
datalog("ground_tuple", "[:find ?x ?y :where [(ground [2 4]) [?k ?j]] [?n :nation/key ?k] [?n :nation/name ?x] [?m :nation/key ?j] [?m :nation/name ?y]]", "x y", "select a.n_name x, b.n_name y from nation a, nation b where a.n_nationkey = 2 and b.n_nationkey = 4")
datalog("map_form", '{:find [?n] :in [$ ?r] :where [[?x :region/key ?r] [?y :nation/region ?x] [?y :nation/name ?n]]}', "n", "select n_name n from nation where n_regionkey = 2", 2)
datalog("lookup_input", "[:find ?n :in $ ?c :where [?o :orders/customer ?c] [?o :orders/priority ?n]]", "n", "select distinct o_orderpriority n from orders where o_custkey = 7", [Keyword("customer/key"), 7])
datalog("lookup_in_value", "[:find (count ?s) :where [?s :supplier/nation [:nation/key 3]]]", "n", "select count(*) n from supplier where s_nationkey = 3 having count(*) > 0")
datalog("or_join_unbound", "[:find ?k ?b :where [?n :nation/key ?k] (or-join [?n ?b] (and [?n :nation/region ?r] [?r :region/key 1] [?r :region/key ?b]) [?n :nation/key 0]) [?q :region/key ?b]]", "k b", "select n_nationkey::bigint k, 1::bigint b from nation where n_regionkey = 1 union select 0::bigint, r_regionkey::bigint from region, nation where n_nationkey = 0")
datalog("intersect", '[:find ?k :where [?o :orders/status "F"] [?o :orders/key ?k] [?l :lineitem/order ?o] [?l :lineitem/returned "R"]]', "k", "select o_orderkey k from orders where o_orderstatus = 'F' intersect select l_orderkey from lineitem where l_returnflag = 'R'")
datalog("not_in_two", "[:find (count ?c) :where [?c :customer/key _] (not [?o :orders/customer ?c] [?l :lineitem/order ?o] [?l :lineitem/quantity ?q] [(> ?q 48.0)])]", "n", "select count(*) n from customer where c_custkey not in (select o_custkey from orders join lineitem on l_orderkey = o_orderkey where l_quantity > 48)")
datalog("rule_in_other_db", "[:find ?k :in $ $old % :where [?o :order/key ?k] ($old priced ?o) (not (priced ?o))]", "k", "select o_orderkey k from orders where o_orderkey % 10 = 0", "[[(priced ?o) [?o :order/price _]]]", dbs=lambda s, d: [orders_log(s, d), orders_log(s, d).as_of(2)])
datalog("collection_of_refs", "[:find [?c ...] :where [?o :orders/price ?p] [(> ?p 480000.0)] [?o :orders/customer ?x] [?x :customer/key ?c]]", "c", "select distinct o_custkey c from orders where o_totalprice > 480000")

timed("view_sharing", lambda db: [db.as_of(3), db.as_of(99)], "[:find (count ?o) :in $ $b :where [?o :order/price ?p] [$b ?o :order/price ?p]]", "n", "select count(*) n from orders where o_orderkey % 10 <> 0")
timed("view_since_none", lambda db: [db.since(2), db], "[:find (count ?o) :in $ $now :where [$now ?o :order/key _] (not [?o :order/price _])]", "n", "select count(*) n from orders")
timed("history_added", lambda db: [db.history()], "[:find ?k :where [?o :order/price _ _ false] [(mod ?o 4398046511104) ?k]]", "k", "select o_orderkey k from orders where o_orderkey % 10 = 0")


# SQL

def sql_query(name: str, text: str, oracle: str, *params) -> None:
    QUERIES[name], ORACLE_SQL[name] = (lambda spark, sf_dir: SqlSession(warehouse(spark, sf_dir)).query(text, *params)), oracle


sql_query("sql_sys_attributes", "select ident, value_type, cardinality, uniqueness from sys.attributes where ident like 'nation/%' or ident = 'part/words'", "select * from (values ('nation/key', 'long', 'one', 'identity'), ('nation/name', 'string', 'one', null), ('nation/region', 'ref', 'one', null), ('part/words', 'string', 'many', null)) x(ident, value_type, cardinality, uniqueness)")
sql_query("sql_sys_idents", "select count(*) n, count(distinct e) d from sys.idents where ident like 'lineitem/%'", "select 8 n, 8 d")
sql_query("sql_many_cells", "select key k, words[0] w, cast(size(words) as bigint) n from part where array_has(words, 'red')", "select p_partkey k, list_sort(list_distinct(string_split(p_name, ' ')))[1] w, len(list_distinct(string_split(p_name, ' '))) n from part where list_contains(string_split(p_name, ' '), 'red')")
sql_query("sql_like_case", "select name, case when acctbal < 0 then 'owes' else 'has' end s from customer where name like '%7' and segment in ('BUILDING', $1)", "select c_name as name, case when c_acctbal < 0 then 'owes' else 'has' end s from customer where c_name like '%7' and c_mktsegment in ('BUILDING', 'MACHINERY')", "MACHINERY")
sql_query("sql_order_limit", "select key k, price p from orders order by price desc, key limit 25", "select o_orderkey k, o_totalprice p from orders order by 2 desc, 1 limit 25")
sql_query("sql_outer_join", "select n.key k, count(s.e) c from nation n left join supplier s on s.nation = n.e and s.acctbal > 9000 group by n.key", "select n_nationkey::bigint k, count(s_suppkey) c from nation left join supplier on s_nationkey = n_nationkey and s_acctbal > 9000 group by 1")
sql_query("sql_exists", "select c.key k from customer c where exists (select 1 from orders o where o.customer = c.e and o.price > 450000)", "select c_custkey k from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 450000)")
sql_query("sql_with", "with t as (select customer c, sum(price) p from orders group by customer) select count(*) n from t where p > 1000000", "with t as (select o_custkey c, sum(o_totalprice) p from orders group by 1) select count(*) n from t where p > 1000000")
sql_query("sql_array_join", "select p.key k, r.name w from part p join (select explode(array('red', 'green', 'blue')) name) r on array_has(p.words, r.name)", "select p_partkey k, w from part, (select unnest(['red', 'green', 'blue']) w) where list_contains(string_split(p_name, ' '), w)")
sql_query("sql_time", "select year(date) y, count(*) n from orders group by year(date)", "select year(o_orderdate)::int y, count(*) n from orders group by 1")
sql_query("sql_params", "select count(*) n from lineitem where quantity >= $1 and returned = $2", "select count(*) n from lineitem where l_quantity >= 30 and l_returnflag = 'A'", 30.0, "A")


@frames("sql_history", "select count(*) n, count_if(not added) r from (select true added from orders union all select true from orders union all select true from orders union all select unnest([true, false]) from orders where o_orderstatus <> 'O' union all select false from orders where o_orderkey % 10 = 0)")
def sql_history(spark, sf_dir):
    return SqlSession(orders_log(spark, sf_dir).history()).query("select count(*) n, count_if(not added) r from sys.datoms")


@frames("sql_as_of", "select o_orderkey k, 'O' s, o_totalprice p from orders")
def sql_as_of(spark, sf_dir):
    return SqlSession(orders_log(spark, sf_dir).as_of(1)).query("select key k, status s, price p from `order`")


@frames("windowed_events", "select time_bucket(interval 1 hour, ts) as start, event_type, count(*) n, round(sum(value), 6) total from events group by 1, 2")
def windowed_events(spark, sf_dir):
    return reports.windowed(spark.read.parquet(f"{sf_dir}/events.parquet")).selectExpr("cast(start as timestamp_ntz) start", "event_type", "n", "round(total, 6) total")


# Transactions, pull, writes and what else needs a log of its own: one of nations and regions, in the shared folder

LEDGER = Schema.of([
    Attribute("nation/key", "long", unique="identity", indexed=True), Attribute("nation/name", "string", indexed=True), Attribute("nation/region", "ref"), Attribute("nation/tags", "string", many=True),
    Attribute("region/key", "long", unique="identity"), Attribute("region/name", "string"), Attribute("region/seat", "ref", component=True), Attribute("seat/city", "string"),
    Attribute("nation/next", "ref"), Attribute("tx/source", "string"), Attribute("nation/secret", "string", protection=Protection("protect/pii")),
])
K = Keyword


def folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None) or f"/tmp/checkpoints/{spark.sparkContext.applicationId}"
    return f"{base}/ledger-{uuid.uuid4().hex}"


def ledger(spark: SparkSession, sf_dir: str, keys=None) -> Connection:
    """t=1: regions with a seat each; t=2: nations, by a temporary id each, with two tags and the next nation's key."""
    conn = Connection(spark, folder(spark), LEDGER, keys)
    at = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet").collect()  # 5 and 25 rows
    conn.transact([{K("region/key"): r["r_regionkey"], K("region/name"): r["r_name"], K("region/seat"): f"seat{r['r_regionkey']}"} for r in at("region")] + [[K("db/add"), f"seat{r['r_regionkey']}", K("seat/city"), f"city of {r['r_name']}"] for r in at("region")])
    nations = at("nation")
    conn.transact([{K("db/id"): f"n{n['n_nationkey']}", K("nation/key"): n["n_nationkey"], K("nation/name"): n["n_name"], K("nation/region"): [K("region/key"), n["n_regionkey"]], K("nation/tags"): ["x", n["n_name"][-1]], K("nation/next"): f"n{n['n_nationkey'] + 1 if n['n_nationkey'] < len(nations) - 1 else n['n_nationkey']}"} for n in nations])
    return conn


def on_ledger(name: str, sql: str):
    def register(f):
        QUERIES[name], ORACLE_SQL[name] = (lambda spark, sf_dir: f(spark, ledger(spark, sf_dir))), sql
        return f

    return register


def asked(db, query: str, columns: str, *inputs) -> DataFrame:
    return db.q(query, *inputs).df.toDF(*columns.split())


NAMES = "[:find ?k ?n :where [?x :nation/key ?k] [?x :nation/name ?n]]"


@on_ledger("tx_map_forms", "select n_nationkey::bigint k, n_name n, r_name r, 'city of ' || r_name c from nation join region on n_regionkey = r_regionkey")
def tx_map_forms(spark, conn):
    return asked(conn.db(), "[:find ?k ?n ?r ?c :where [?x :nation/key ?k] [?x :nation/name ?n] [?x :nation/region ?g] [?g :region/name ?r] [?g :region/seat ?s] [?s :seat/city ?c]]", "k n r c")


@on_ledger("tx_upsert", "select n_nationkey::bigint k, case when n_nationkey = 3 then 'renamed' else n_name end n from nation")
def tx_upsert(spark, conn):
    return asked(conn.transact('[{:nation/key 3 :nation/name "renamed"}]').db_after, NAMES, "k n")


@on_ledger("tx_retract", "select n_nationkey::bigint k, n_name n from nation where n_nationkey not in (4, 5)")
def tx_retract(spark, conn):
    return asked(conn.transact('[[:db/retract [:nation/key 4] :nation/name] [:db/retract [:nation/key 5] :nation/name "NATION_5"]]').db_after, NAMES, "k n")


@on_ledger("tx_cas", "select n_nationkey::bigint k, case when n_nationkey = 6 then 'swapped' else n_name end n, case when n_nationkey = 6 then 'refused' end again from nation")
def tx_cas(spark, conn):
    conn.transact('[[:db/cas [:nation/key 6] :nation/name "NATION_6" "swapped"]]')
    try:
        conn.transact('[[:db/cas [:nation/key 6] :nation/name "NATION_6" "again"]]')
        refused = "done"
    except TxError:
        refused = "refused"
    return asked(conn.db(), NAMES, "k n").selectExpr("k", "n", f"if(k = 6, '{refused}', null) again")


@on_ledger("tx_retract_entity", "select r_regionkey::bigint k, (select count(*) from nation where n_regionkey = r_regionkey and r_regionkey <> 1) n, case when r_regionkey <> 1 then 1 else 0 end::bigint seats from region where r_regionkey <> 1 union all select null, (select count(*) from nation where n_regionkey = 1), 0")
def tx_retract_entity(spark, conn):
    """Region 1 goes with its seat, and so do the references of its nations."""
    db = conn.transact("[[:db/retractEntity [:region/key 1]]]").db_after
    by = asked(db, "[:find ?k (count ?n) (count-distinct ?s) :with ?n :where [?r :region/key ?k] [?n :nation/region ?r] [?r :region/seat ?s]]", "k n seats")
    left = asked(db, "[:find ?n :where [?n :nation/key _] (not [?n :nation/region _])]", "e").selectExpr("cast(null as bigint) k", "count(*) n", "0L seats")
    return by.unionByName(left)


@on_ledger("tx_with", "select 'with' db, count(*) + 1 n from nation union all select 'log', count(*) from nation")
def tx_with(spark, conn):
    staged = conn.staged()
    staged.transact('[{:nation/key 1000 :nation/name "not committed"}]')
    count = "[:find (count ?x) :where [?x :nation/key _]]"
    return asked(staged.db(), count, "n").selectExpr("'with' db", "n").unionByName(asked(conn.db(), count, "n").selectExpr("'log' db", "n"))


@on_ledger("tx_staged", "select n_nationkey::bigint k, case n_nationkey when 2 then 'second' else n_name end n from nation union all select 500, 'made' from nation where n_nationkey = 0")
def tx_staged(spark, conn):
    staged = conn.staged()
    staged.transact('[{:nation/key 2 :nation/name "first"} {:nation/key 500 :nation/name "made"}]')
    staged.transact('[[:db/cas [:nation/key 2] :nation/name "first" "second"]]')
    return asked(staged.commit().db_after, NAMES, "k n")


@on_ledger("tx_report", "select a, v, added from (values ('nation/name', 'NATION_7', false), ('nation/name', 'seven', true), ('tx/source', 'import', true)) x(a, v, added)")
def tx_report(spark, conn):
    report = conn.transact('[{:nation/key 7 :nation/name "seven"} {:db/id "datomic.tx" :tx/source "import"}]')
    return spark.createDataFrame([(a, str(v), added) for _, a, v, _, added in report.tx_data if a != "db/txInstant"], "a string, v string, added boolean")


@on_ledger("tx_metadata", "select n_nationkey::bigint k, 'import' s from nation where n_nationkey in (8, 9)")
def tx_metadata(spark, conn):
    db = conn.transact('[{:nation/key 8 :nation/name "h"} {:nation/key 9 :nation/name "i"} {:db/id "datomic.tx" :tx/source "import"}]').db_after
    return asked(db, "[:find ?k ?s :where [?x :nation/name _ ?tx] [?tx :tx/source ?s] [?x :nation/key ?k]]", "k s")


@on_ledger("tx_function", "select n_nationkey::bigint k, n_name || '!' n from nation where n_nationkey = 10")
def tx_function(spark, conn):
    conn.function("louder", lambda db, e: [[K("db/add"), e, K("nation/name"), db.values(e, ":nation/name").first()[0] + "!"]])
    return asked(conn.transact("[[:louder [:nation/key 10]]]").db_after, NAMES, "k n").where("k = 10")


@on_ledger("tx_fence", "select 'refused' outcome, 3::bigint basis")
def tx_fence(spark, conn):
    old = conn.staged()
    old.transact('[{:nation/key 11 :nation/name "late"}]')
    conn.transact('[{:nation/key 11 :nation/name "first"}]')
    try:
        old.commit()
        outcome = "done"
    except BasisMismatch:
        outcome = "refused"
    return spark.createDataFrame([(outcome, conn.basis())], "outcome string, basis long")


@on_ledger("view_instants", "select 'before' v, 0::bigint n union all select 'after', count(*) from nation")
def view_instants(spark, conn):
    first = conn.db().log().where("t = 1 and attr = 'db/txInstant'").first()["v_instant"]
    last = conn.db().log().where("t = 2 and attr = 'db/txInstant'").first()["v_instant"]
    count = lambda t, v: asked(conn.db().as_of(t), "[:find ?x :where [?x :nation/key _]]", "x").selectExpr(f"'{v}' v", "count(*) n")
    return count(first, "before").unionByName(count(last, "after"))


@on_ledger("tx_instants", "select t::bigint t, true rising from (values (1), (2)) x(t)")
def tx_instants(spark, conn):
    rows = asked(conn.db(), "[:find ?t ?i :where [?tx :db/txInstant ?i] [(mod ?tx 4398046511104) ?t]]", "t i")
    return rows.selectExpr("t", "coalesce(i > lag(i) over (order by t), true) rising")


def pulled(name: str, sql: str, pattern: str, entities: str, n: int) -> None:
    """Registers a pull of n entities by key as EDN text."""

    @on_ledger(name, sql)
    def run(spark, conn):
        found = conn.db().pull_many(pattern, [[K(entities), k] for k in range(n)])
        return spark.createDataFrame([(k, write(x)) for k, x in enumerate(found)], "k long, x string").withColumn("x", F.regexp_replace("x", ":db/id [0-9]+", ":db/id"))


pulled("pull_attributes", "select n_nationkey::bigint k, '{:nation/key ' || n_nationkey || ', :nation/name \"' || n_name || '\"}' x from nation", "[:nation/key :nation/name]", "nation/key", 25)
pulled("pull_nested", "select n_nationkey::bigint k, '{:nation/region {:region/name \"' || r_name || '\"}}' x from nation join region on n_regionkey = r_regionkey", "[{:nation/region [:region/name]}]", "nation/key", 25)
pulled("pull_reverse", "select r_regionkey::bigint k, '{:nation/_region [' || string_agg('{:nation/key ' || n_nationkey || '}', ' ' order by n_nationkey) || ']}' x from nation join region on n_regionkey = r_regionkey group by 1", "[{:nation/_region [:nation/key]}]", "region/key", 5)
pulled("pull_options", "select n_nationkey::bigint k, '{\"label\" \"' || n_name || '\", :nation/secret \"none\", :nation/tags [\"' || right(n_name, 1) || '\"]}' x from nation", '[(:nation/name :as "label") (:nation/tags :limit 1) (:nation/secret :default "none")]', "nation/key", 25)
pulled("pull_recursive", "select n_nationkey::bigint k, case when n_nationkey < 23 then '{:nation/key ' || n_nationkey || ', :nation/next {:nation/key ' || (n_nationkey + 1) || ', :nation/next {:nation/key ' || (n_nationkey + 2) || ', :nation/next {:db/id}}}}' end x from nation where n_nationkey < 20", "[:nation/key {:nation/next 2}]", "nation/key", 20)
pulled("pull_component", "select r_regionkey::bigint k, '{:region/key ' || r_regionkey || ', :region/seat {:seat/city \"city of ' || r_name || '\"}}' x from region", "[:region/key {:region/seat [:seat/city]}]", "region/key", 5)


@on_ledger("pull_in_find", "select n_nationkey::bigint k, '{:region/key ' || n_regionkey || '}' x from nation where n_nationkey < 6")
def pull_in_find(spark, conn):
    rows = conn.db().q("[:find ?k (pull ?r [:region/key]) :where [?n :nation/key ?k] [(< ?k 6)] [?n :nation/region ?r]]").rows()
    return spark.createDataFrame([(k, write(x)) for k, x in rows], "k long, x string")


@on_ledger("entity_walk", "select n_nationkey::bigint k, 'city of ' || r_name c from nation join region on n_regionkey = r_regionkey where n_nationkey < 3")
def entity_walk(spark, conn):
    db = conn.db()
    return spark.createDataFrame([(k, db.entity([K("nation/key"), k]).get(":nation/region").get(":region/seat").get(":seat/city")) for k in range(3)], "k long, c string")


@on_ledger("sql_insert", "select n_nationkey::bigint k, n_name as name from nation union all select 100 + n_nationkey, n_name || ' two' from nation where n_regionkey = 2")
def sql_insert(spark, conn):
    execute(conn, "insert into nation (key, name) select key + 100, name || ' two' from nation n where n.region in (select e from region where key = 2)")
    return SqlSession(conn.db()).query("select key k, name from nation")


@on_ledger("sql_update", "select n_nationkey::bigint k, case when n_nationkey < 4 then lower(n_name) else n_name end as name from nation")
def sql_update(spark, conn):
    execute(conn, "update nation set name = lower(name) where key < $1", 4)
    return SqlSession(conn.db()).query("select key k, name from nation")


@on_ledger("sql_delete", "select n_nationkey::bigint k, n_name as name from nation where n_nationkey >= 4")
def sql_delete(spark, conn):
    execute(conn, "delete from nation where key < 4")
    return SqlSession(conn.db()).query("select key k, name from nation")


@on_ledger("sql_refusals", "select * from (values ('insert', true), ('update', true), ('history', true)) x(what, refused)")
def sql_refusals(spark, conn):
    def refused(f) -> bool:
        try:
            f()
            return False
        except Exception:
            return True

    session = SqlSession(conn.db())
    rows = [("insert", refused(lambda: session.query("insert into nation (key) values (1)"))), ("update", refused(lambda: execute(conn, "update nation set e = 1"))), ("history", refused(lambda: execute(conn, "delete from nation", db=conn.db().history())))]
    return spark.createDataFrame(rows, "what string, refused boolean")


@on_ledger("snapshot_reads", "select n_nationkey::bigint k, case when n_nationkey = 12 then 'after' else n_name end n from nation")
def snapshot_reads(spark, conn):
    conn.snapshot()
    return asked(conn.transact('[{:nation/key 12 :nation/name "after"}]').db_after, NAMES, "k n")


@on_ledger("fork_log", "select 'fork' l, count(*) + 1 n from nation union all select 'log', count(*) from nation")
def fork_log(spark, conn):
    other = conn.fork(folder(spark))
    other.transact('[{:nation/key 900 :nation/name "only there"}]')
    count = "[:find (count ?x) :where [?x :nation/key _]]"
    return asked(other.db(), count, "n").selectExpr("'fork' l", "n").unionByName(asked(conn.db(), count, "n").selectExpr("'log' l", "n"))


@on_ledger("feed", "select t::bigint t, a, n from (select 1 t, 'region/name' a, count(*) n from region union all select 2, 'nation/name', count(*) from nation)")
def feed(spark, conn):
    """What a subscriber has been given, written down as it came."""
    at = folder(spark)
    reports.subscribe(spark, conn.path, f"{at}/checkpoint", lambda df: df.write.mode("append").parquet(f"{at}/seen")).awaitTermination()
    return spark.read.parquet(f"{at}/seen").where("attr in ('region/name', 'nation/name')").groupBy("t", "attr").agg(F.count("*").alias("n")).withColumnRenamed("attr", "a")


@on_ledger("schema_plan", "select * from (values ('nation/name:uniqueness', true), ('nation/tags:cardinality', false), ('nation/zip', true)) x(step, free)")
def schema_plan(spark, conn):
    """Names can become unique, tags can't become one, and a new attribute needs nothing."""
    wish = Schema.of([replace(LEDGER.get("nation/name"), unique="value"), replace(LEDGER.get("nation/tags"), many=False), Attribute("nation/zip", "string")])
    made = migration.plan(conn.db(), wish)
    names = {"nation/name:unique": "nation/name:uniqueness", "nation/tags:many": "nation/tags:cardinality"}
    steps = [(x.key, x.blocked is None) for x in made.steps]
    known = {k.split(":")[0]: k for k in ("nation/name:uniqueness", "nation/tags:cardinality", "nation/zip")}
    return spark.createDataFrame([(known.get(names.get(k, k).split(":")[0], k), free) for k, free in steps], "step string, free boolean")


@on_ledger("hidden_attributes", "select 'seen' who, count(*) n from nation union all select 'hidden', 0")
def hidden_attributes(spark, conn):
    count = lambda db, who: asked(db, "[:find ?x :where [?x :nation/name _]]", "x").selectExpr(f"'{who}' who", "count(*) n")
    return count(conn.db(), "seen").unionByName(count(conn.db().hiding([":nation/name"]), "hidden"))


def protected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that are read with the key, and are neither read nor found without it."""
    conn = ledger(spark, sf_dir, {"protect/pii": b"k" * 32})
    conn.transact([{K("nation/key"): k, K("nation/secret"): f"s{k}"} for k in range(5)])
    query = "[:find ?k :in $ ?s :where [?x :nation/secret ?s] [?x :nation/key ?k]]"
    shut = Connection(spark, conn.path, LEDGER).db()
    return asked(conn.db(), query, "k", "s3").selectExpr("'key' who", "k").unionByName(asked(shut, query, "k", "s3").selectExpr("'none' who", "k"))


QUERIES["protected"], ORACLE_SQL["protected"] = protected, "select 'key' who, n_nationkey::bigint k from nation where n_nationkey = 3"
