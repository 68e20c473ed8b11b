"""The registered queries: name, DataFrame plan and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

import math
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import distributions, lineage, rng
from brindle.operators import anonymize, filters, generate, hierarchy, mapping, pii, pipeline, profile, quality, relational, relationships, sql, subset, validate
from brindle.plans import specs
from brindle.streaming import events as stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Registers a plan under its function's name, with its SQL."""

    def add(plan):
        QUERIES[plan.__name__] = plan
        if oracle:
            ORACLES[plan.__name__] = oracle
        return plan

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- damaged inputs, the same in both engines ----------------------------------------------------------------------


def orders_nulls(spark, d) -> DataFrame:
    o = t(spark, d, "orders")
    return o.withColumns({"o_totalprice": F.when(F.col("o_orderkey") % 13 != 0, F.col("o_totalprice")), "o_orderstatus": F.when(F.col("o_orderkey") % 29 != 0, F.col("o_orderstatus"))})


ORDERS_NULLS = "orders_nulls AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 29 <> 0 THEN o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 13 <> 0 THEN o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority FROM orders)"


def orders_outliers(spark, d) -> DataFrame:
    return t(spark, d, "orders").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 997 == 0, F.col("o_totalprice") * 100).otherwise(F.col("o_totalprice")))


ORDERS_OUTLIERS = "oo AS (SELECT * REPLACE (CASE WHEN o_orderkey % 997 = 0 THEN o_totalprice * 100 ELSE o_totalprice END AS o_totalprice) FROM orders)"


def ledger(spark, d) -> DataFrame:
    li, p = t(spark, d, "lineitem"), F.col("l_extendedprice")
    back = F.col("l_returnflag") == "R"
    return li.select(F.year("l_shipdate").alias("ship_year"), "l_returnflag", F.when(~back, p).otherwise(0.0).alias("debit"), F.when(back, p).otherwise(0.0).alias("credit"))


def balanced_ledger(spark, d) -> DataFrame:
    one = ledger(spark, d)
    return one.unionByName(one.select("ship_year", "l_returnflag", F.col("credit").alias("debit"), F.col("debit").alias("credit")))


LEDGER = "ledger AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS ship_year, l_returnflag, CASE WHEN l_returnflag <> 'R' THEN l_extendedprice ELSE 0.0 END AS debit, CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0.0 END AS credit FROM lineitem)"


def edges(spark, d) -> DataFrame:
    """region -> nation -> customer as one edge table."""
    n, c, r = t(spark, d, "nation"), t(spark, d, "customer"), t(spark, d, "region")
    top = r.select(F.lit("ALL").alias("parent"), F.concat(F.lit("R"), F.col("r_regionkey")).alias("child"))
    mid = n.select(F.concat(F.lit("R"), F.col("n_regionkey")).alias("parent"), F.concat(F.lit("N"), F.col("n_nationkey")).alias("child"))
    low = c.select(F.concat(F.lit("N"), F.col("c_nationkey")).alias("parent"), F.concat(F.lit("C"), F.col("c_custkey")).alias("child"))
    return top.unionByName(mid).unionByName(low)


EDGES = "edges AS (SELECT 'ALL' AS parent, 'R' || r_regionkey AS child FROM region UNION ALL SELECT 'R' || n_regionkey, 'N' || n_nationkey FROM nation UNION ALL SELECT 'N' || c_nationkey, 'C' || c_custkey FROM customer)"
WALK = "w(root, element, level, path) AS (SELECT {start}, 0, [{start1}] {from_} UNION ALL SELECT w.root, e.child, w.level + 1, list_append(w.path, e.child) FROM w JOIN edges e ON e.parent = w.element WHERE NOT list_contains(w.path, e.child) AND w.level < 50)"


# ---- flagship ------------------------------------------------------------------------------------------------------------


@query(f"""
WITH {LEDGER}, s AS (
  SELECT ship_year, l_returnflag, CAST(sum(CAST(debit AS DECIMAL(18,2))) AS DOUBLE) AS total_debit, CAST(sum(CAST(credit AS DECIMAL(18,2))) AS DOUBLE) AS total_credit
  FROM ledger GROUP BY ALL)
SELECT ship_year, l_returnflag, total_debit, total_credit, round(total_debit - total_credit, 4) AS difference,
       abs(round(total_debit - total_credit, 4)) AS abs_difference, abs(round(total_debit - total_credit, 4)) <= 0.01 AS balanced FROM s""")
def balance_grouped(spark, d):
    return validate.check_balance(ledger(spark, d), "debit", "credit", ["ship_year", "l_returnflag"])


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances by ship year and flag beside the completeness score of the table."""
    score = quality.quality_scores(t(spark, sf_dir, "lineitem"), dimensions=("completeness",)).select(F.col("score").alias("completeness"))
    return balance_grouped(spark, sf_dir).crossJoin(F.broadcast(score)).orderBy("ship_year", "l_returnflag")  # one row


# ---- filters, projections, pipeline ----------------------------------------------------------------------------------------


@query("SELECT * FROM orders WHERE o_orderstatus IN ('O', 'F') AND o_totalprice >= 100000 AND regexp_matches(o_orderpriority, '^[12]-')")
def filter_ops(spark, d):
    return filters.filter_rows(t(spark, d, "orders"), [{"column": "o_orderstatus", "operator": "in", "value": ["O", "F"]}, {"column": "o_totalprice", "operator": ">=", "value": 100000}, {"column": "o_orderpriority", "operator": "contains", "value": "^[12]-"}])


@query(f"WITH {ORDERS_NULLS} SELECT o_orderkey, o_orderstatus FROM orders_nulls WHERE o_totalprice IS NULL AND o_orderstatus IS NOT NULL AND o_orderpriority NOT IN ('1-URGENT')")
def filter_nulls(spark, d):
    return filters.filter_rows(orders_nulls(spark, d), [{"column": "o_totalprice", "operator": "is_null"}, {"column": "o_orderstatus", "operator": "is_not_null"}, {"column": "o_orderpriority", "operator": "not_in", "value": ["1-URGENT"]}]).select("o_orderkey", "o_orderstatus")


@query("""
SELECT flag, l_linestatus, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty, count(l_quantity) AS n FROM (SELECT l_returnflag AS flag, * FROM lineitem WHERE l_quantity > 10)
GROUP BY ALL ORDER BY flag, l_linestatus LIMIT 4""")
def transform_pipeline(spark, d):
    steps = [
        {"type": "filter", "conditions": [{"column": "l_quantity", "operator": ">", "value": 10}]},
        {"operation": "select", "columns": ["l_returnflag", "l_linestatus", "l_quantity"]},
        {"op": "rename", "config": {"mapping": {"l_returnflag": "flag"}}},
        {"type": "cast", "casts": {"l_quantity": "int"}},
        {"type": "aggregate", "group_by": ["flag", "l_linestatus"], "aggregations": [{"column": "l_quantity", "function": "sum", "alias": "qty"}, {"column": "l_quantity", "function": "count", "alias": "n"}]},
        '{"type": "sort", "columns": ["flag", "l_linestatus"]}',
        {"type": "no such step"},
        {"type": "limit", "n": 4},
    ]
    return pipeline.transform(t(spark, d, "lineitem"), steps)[0]


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'owes' WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END AS band FROM customer")
def case_when(spark, d):
    band = filters.case_when([{"when": "c_acctbal < 0", "then": "owes"}, {"when": "c_acctbal < 5000", "then": "low"}], "high")
    return t(spark, d, "customer").select("c_custkey", band.alias("band"))


@query("SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment, lower(c_name) AS c_name FROM customer")
def transform_column_lower(spark, d):
    return sql.transform_column(t(spark, d, "customer"), "c_name", "lower").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment", "c_name")


@query("SELECT p_partkey, regexp_extract(p_brand, '[0-9]+') AS p_brand FROM part")
def transform_column_extract(spark, d):
    return sql.transform_column(t(spark, d, "part"), "p_brand", "extract", {"pattern": "[0-9]+"}).select("p_partkey", "p_brand")


@query("SELECT p_partkey, replace(p_type, ' ', '_') AS p_type, round(p_retailprice, 1) AS p_retailprice FROM part")
def transform_column_replace_round(spark, d):
    df = sql.transform_column(t(spark, d, "part"), "p_type", "replace", {"old": " ", "new": "_"})
    return sql.transform_column(df, "p_retailprice", "round", {"decimals": 1}).select("p_partkey", "p_type", "p_retailprice")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem")
def add_column(spark, d):
    return sql.add_column(t(spark, d, "lineitem"), "net", "l_extendedprice * (1 - l_discount)").select("l_orderkey", "l_linenumber", "net")


# ---- joins ---------------------------------------------------------------------------------------------------------------------


def _on(how, left_rows=None):
    def plan(spark, d):
        c, o = t(spark, d, "customer").filter("c_custkey % 10 <> 0").select("c_custkey", "c_name"), t(spark, d, "orders").select("o_orderkey", "o_custkey")
        return relational.join_tables(o, c, "o_custkey", "c_custkey", how)

    return plan


for _how, _sql in {"inner": "JOIN", "left": "LEFT JOIN", "semi": "SEMI JOIN", "anti": "ANTI JOIN"}.items():
    _f = _on({"semi": "left_semi", "anti": "left_anti"}.get(_how, _how))
    _f.__name__ = f"join_{_how}"
    query(f"SELECT o_orderkey, o_custkey{', c_name' if _how in ('inner', 'left') else ''} FROM orders {_sql} (SELECT * FROM customer WHERE c_custkey % 10 <> 0) c ON o_custkey = c_custkey")(_f)


@query("SELECT n.n_nationkey, n.n_name, s.s_suppkey FROM (SELECT * FROM nation WHERE n_nationkey % 5 <> 0) n FULL JOIN (SELECT * FROM supplier WHERE s_nationkey < 20) s ON n.n_nationkey = s.s_nationkey")
def join_full(spark, d):
    n, s = t(spark, d, "nation").filter("n_nationkey % 5 <> 0"), t(spark, d, "supplier").filter("s_nationkey < 20")
    return relational.join_on(n, s, "t1.n_nationkey = t2.s_nationkey", "full").select("n_nationkey", "n_name", "s_suppkey")


@query("SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def join_theta(spark, d):
    n = t(spark, d, "nation")
    return relational.join_on(n, n, "t1.n_regionkey = t2.n_regionkey AND t1.n_nationkey < t2.n_nationkey").select(F.col("t1.n_nationkey").alias("a"), F.col("t2.n_nationkey").alias("b"))


@query("SELECT r_name, n_name FROM region, nation")
def join_cross(spark, d):
    return relational.join_files([t(spark, d, "region").select("r_name"), t(spark, d, "nation").select("n_name")], [], "cross")


@query("""
SELECT n_nationkey AS nationkey, n_name AS name, c_name AS name_file1, c_acctbal AS acctbal, s_name AS name_file2, s_acctbal AS acctbal_file2
FROM nation JOIN customer ON n_nationkey = c_nationkey JOIN supplier ON n_nationkey = s_nationkey""")
def join_files_nway(spark, d):
    n = t(spark, d, "nation").select(F.col("n_nationkey").alias("nationkey"), F.col("n_name").alias("name"))
    c = t(spark, d, "customer").select(F.col("c_nationkey").alias("nationkey"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("acctbal"))
    s = t(spark, d, "supplier").select(F.col("s_nationkey").alias("nationkey"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("acctbal"))
    return relational.join_files([n, c, s], ["nationkey"], repeats=True)


@query("""
WITH l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), r AS (SELECT user_id, ts AS at, min(event_id) AS seen FROM events WHERE event_type = 'view' GROUP BY ALL)
SELECT l.event_id, l.user_id, l.ts, r.seen, r.at FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.at""")
def as_of_join(spark, d):
    e = t(spark, d, "events")
    views = e.filter("event_type = 'view'").groupBy("user_id", F.col("ts").alias("at")).agg(F.min("event_id").alias("seen"))
    return relational.as_of_join(e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts"), views, "ts", "at", ["user_id"], ["seen"], 3 * 86_400)


@query("""
WITH r AS (SELECT p_partkey, p_retailprice AS low, p_retailprice + 1 AS high FROM part), o AS (SELECT p_partkey AS part, p_retailprice AS price FROM part)
SELECT o.part, o.price, r.p_partkey FROM o JOIN r ON o.price >= r.low AND o.price < r.high""")
def range_join(spark, d):
    r = t(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("low"), (F.col("p_retailprice") + 1).alias("high"))
    return relational.range_join(t(spark, d, "part").select(F.col("p_partkey").alias("part"), F.col("p_retailprice").alias("price")), r, "price", "low", "high", 10.0, repeats=True).select("part", "price", "p_partkey")


# ---- sets ---------------------------------------------------------------------------------------------------------------------


def _keys(spark, d):
    return t(spark, d, "customer").select(F.col("c_nationkey").alias("k")), t(spark, d, "supplier").filter("s_suppkey % 3 = 0").select(F.col("s_nationkey").alias("k"))


_A, _B = "SELECT c_nationkey AS k FROM customer", "SELECT s_nationkey AS k FROM supplier WHERE s_suppkey % 3 = 0"


@query(f"{_A} UNION ALL {_B}")
def union_relaxed(spark, d):
    return relational.union_files(_keys(spark, d))


@query(f"{_A} UNION {_B}")
def union_distinct(spark, d):
    return relational.union_distinct(*_keys(spark, d))


@query(f"{_A} INTERSECT {_B}")
def set_intersect(spark, d):
    a, b = _keys(spark, d)
    return a.intersect(b)


@query(f"{_A} EXCEPT {_B}")
def set_except(spark, d):
    a, b = _keys(spark, d)
    return a.subtract(b)


# ---- aggregates, shape, nulls ----------------------------------------------------------------------------------------------------


@query("""
SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS l_quantity_sum, round(avg(l_quantity), 6) AS l_quantity_avg, count(l_tax) AS l_tax_count, min(l_shipdate) AS first_ship,
       max(l_extendedprice) AS l_extendedprice_max, arg_min(l_orderkey, l_orderkey * 10 + l_linenumber) AS first_order, arg_max(l_orderkey, l_orderkey * 10 + l_linenumber) AS last_order
FROM lineitem GROUP BY ALL""")
def aggregate_all(spark, d):
    li = t(spark, d, "lineitem").withColumn("l_quantity", F.col("l_quantity").cast("long")).withColumn("pos", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    a = lambda c, f, n=None: {"column": c, "function": f} | ({"alias": n} if n else {})
    out = relational.aggregate(li, ["l_returnflag", "l_linestatus"], [a("l_quantity", "sum"), a("l_quantity", "avg"), a("l_tax", "count"), a("l_shipdate", "min", "first_ship"), a("l_extendedprice", "max"), a("l_orderkey", "first", "first_order"), a("l_orderkey", "last", "last_order")], "pos")
    return out.withColumn("l_quantity_avg", F.round("l_quantity_avg", 6))


@query("SELECT o_orderpriority, " + ", ".join(f"CAST(sum(CASE WHEN o_orderstatus = '{s}' THEN CAST(o_totalprice AS DECIMAL(18,2)) END) AS DOUBLE) AS \"{s}\"" for s in "FOP") + " FROM orders GROUP BY ALL")
def pivot_sum(spark, d):
    o = t(spark, d, "orders").withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(18,2)"))
    p = relational.pivot(o, "o_totalprice", "o_orderpriority", "o_orderstatus", "sum", ["F", "O", "P"])
    return p.select("o_orderpriority", *(F.col(c).cast("double").alias(c) for c in "FOP"))


@query("""SELECT l_orderkey, l_linenumber, 'l_quantity' AS measure, l_quantity AS amount FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'l_extendedprice', l_extendedprice FROM lineitem
UNION ALL SELECT l_orderkey, l_linenumber, 'l_tax', l_tax FROM lineitem""")
def unpivot_measures(spark, d):
    return relational.unpivot(t(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_quantity", "l_extendedprice", "l_tax"], "measure", "amount")


@query("SELECT o_orderpriority AS value, count(*) AS \"count\", round(count(*) * 100.0 / sum(count(*)) OVER (), 1) AS pct FROM orders GROUP BY ALL ORDER BY 2 DESC, 1 LIMIT 3")
def value_counts_top(spark, d):
    return relational.value_counts(t(spark, d, "orders"), "o_orderpriority", 3)


def _fill(strategy, expr, **p):
    def plan(spark, d):
        return relational.fill_nulls(orders_nulls(spark, d), "o_totalprice", strategy, order_by="o_orderkey", **p).select("o_orderkey", F.round("o_totalprice", 6).alias("o_totalprice"))

    plan.__name__ = f"fill_null_{strategy}"
    query(f"WITH {ORDERS_NULLS} SELECT o_orderkey, round({expr}, 6) AS o_totalprice FROM orders_nulls")(plan)


_fill("literal", "coalesce(o_totalprice, 0.0)", value=0.0)
_fill("forward", "last_value(o_totalprice IGNORE NULLS) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
_fill("backward", "first_value(o_totalprice IGNORE NULLS) OVER (ORDER BY o_orderkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)")
_fill("mean", "coalesce(o_totalprice, (SELECT avg(o_totalprice) FROM orders_nulls))")
_fill("median", "coalesce(o_totalprice, (SELECT median(o_totalprice) FROM orders_nulls))")


@query(f"WITH {ORDERS_NULLS} SELECT o_orderkey, coalesce(o_orderstatus, (SELECT o_orderstatus FROM orders_nulls WHERE o_orderstatus IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS o_orderstatus FROM orders_nulls")
def fill_null_mode(spark, d):
    return relational.fill_nulls(orders_nulls(spark, d), "o_orderstatus", "mode").select("o_orderkey", "o_orderstatus")


@query(f"WITH {ORDERS_NULLS} SELECT o_orderkey FROM orders_nulls WHERE o_totalprice IS NOT NULL AND o_orderstatus IS NOT NULL")
def drop_nulls(spark, d):
    return relational.drop_nulls(orders_nulls(spark, d)).select("o_orderkey")


@query("SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL")
def unique_first(spark, d):
    return relational.unique(t(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "first", "o_orderkey")


@query("SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL")
def unique_last(spark, d):
    return relational.unique(t(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "last", "o_orderkey")


@query("SELECT o_custkey, any_value(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL HAVING count(*) = 1")
def unique_none(spark, d):
    return relational.unique(t(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "none")


@query(f"WITH {ORDERS_NULLS} SELECT o_orderkey, o_orderstatus, row_number() OVER (ORDER BY o_orderstatus DESC NULLS FIRST, o_orderkey) - 1 AS place FROM orders_nulls")
def sort_nulls_first(spark, d):
    rows = relational.sort(orders_nulls(spark, d).select("o_orderkey", "o_orderstatus"), ["o_orderstatus", "o_orderkey"], [True, False])
    return lineage.placed(rows)


@query("SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_k(spark, d):
    return subset.top_n(t(spark, d, "orders"), 25, [F.desc("o_totalprice"), "o_orderkey"])


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 100")
def paginate(spark, d):
    return relational.paginate(t(spark, d, "orders").select("o_orderkey", "o_totalprice"), 3, 50, ["o_orderkey"])


@query("SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 197) || '...' ELSE text END AS text, lang FROM documents ORDER BY doc_id LIMIT 100")
def preview_truncate(spark, d):
    return relational.preview(t(spark, d, "documents").select("doc_id", "text", "lang"), 500, ["doc_id"])


@query("SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total, count(*) AS \"count\" FROM orders GROUP BY ALL ORDER BY total DESC, o_custkey LIMIT 20")
def top_groups(spark, d):
    o = t(spark, d, "orders").withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(18,2)"))
    return relational.top_groups(o, "o_custkey", "o_totalprice").withColumn("total", F.col("total").cast("double"))


# ---- SQL and changes -----------------------------------------------------------------------------------------------------------------


@query("SELECT o_orderpriority, count(*) AS n, max(o_totalprice) AS top FROM orders WHERE o_orderstatus = 'O' GROUP BY 1")
def sql_single(spark, d):
    return sql.query(spark, t(spark, d, "orders"), "SELECT o_orderpriority, count(*) AS n, max(o_totalprice) AS top FROM data WHERE o_orderstatus = 'O' GROUP BY 1")


_FOUR_WAY = """SELECT r_name, n_name, CAST(CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18,4))) AS DECIMAL(28,4)) AS DOUBLE) AS revenue, count(DISTINCT o_orderkey) AS orders_n
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1998-01-01' GROUP BY r_name, n_name"""


@query(_FOUR_WAY)
def sql_context(spark, d):
    return sql.run_sql(spark, _FOUR_WAY, {n: t(spark, d, n) for n in ("lineitem", "orders", "customer", "nation", "region")})


@query("SELECT o_orderstatus, o_orderpriority, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total, CAST(grouping(o_orderstatus) AS INTEGER) AS g FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def sql_cube(spark, d):
    return sql.query(spark, t(spark, d, "orders"), "SELECT o_orderstatus, o_orderpriority, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total, CAST(grouping(o_orderstatus) AS INT) AS g FROM data GROUP BY CUBE (o_orderstatus, o_orderpriority)", None)


@query("SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS n, o_totalprice - lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS change FROM orders")
def sql_window(spark, d):
    return sql.query(spark, t(spark, d, "orders"), "SELECT o_custkey, o_orderkey, row_number() OVER w AS n, o_totalprice - lag(o_totalprice) OVER w AS change FROM data WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)", None)


@query(f"WITH {ORDERS_NULLS} SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice FROM orders_nulls")
def update_where(spark, d):
    return sql.update(orders_nulls(spark, d), {"o_orderstatus": "X", "o_totalprice": "o_totalprice * 2"}, {"o_orderstatus": "O", "o_orderpriority": "1-URGENT"}, ["o_totalprice"]).select("o_orderkey", "o_orderstatus", "o_totalprice")


@query(f"WITH {ORDERS_NULLS} SELECT o_orderkey FROM orders_nulls WHERE NOT coalesce(o_totalprice > 200000, false)")
def delete_where(spark, d):
    return sql.delete(orders_nulls(spark, d), "o_totalprice > 200000").select("o_orderkey")


@query(f"WITH {ORDERS_NULLS} SELECT o_orderkey FROM orders_nulls WHERE NOT (o_orderstatus = 'O')")
def delete_strict(spark, d):
    return sql.delete(orders_nulls(spark, d), {"o_orderstatus": "O"}, strict_sql=True).select("o_orderkey")


# ---- profiles --------------------------------------------------------------------------------------------------------------------------


def _profile_sql(table: str, cols: dict[str, str]) -> str:
    """cols: name -> Spark type; numbers have mean and std."""
    rows = []
    for c, kind in cols.items():
        number = kind in ("int", "bigint", "double")
        stat = f"round(avg({c}), 6), round(stddev_samp({c}), 4)" if number else "CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE)"
        rows.append(f"SELECT '{c}' AS \"column\", '{kind}' AS dtype, count(*) AS row_count, count(*) - count({c}) AS null_count, count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS unique_count, {stat} FROM {table}")
    head = 'SELECT "column", dtype, row_count, null_count, CAST(unique_count AS BIGINT) AS unique_count, mean, std FROM ('
    return f"{head}SELECT * FROM ({' UNION ALL '.join(rows)}) AS x(\"column\", dtype, row_count, null_count, unique_count, mean, std))"


_CUSTOMER = {"c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string"}



def _rounded_profile(df: DataFrame) -> DataFrame:
    return profile.profile(df).select("column", "dtype", "row_count", "null_count", "unique_count", F.round("mean", 6).alias("mean"), F.round("std", 4).alias("std"))


@query(_profile_sql("customer", _CUSTOMER))
def profile_columns(spark, d):
    return _rounded_profile(t(spark, d, "customer"))


@query(f"WITH {ORDERS_NULLS} " + _profile_sql("orders_nulls", {"o_totalprice": "double", "o_orderstatus": "string"}))
def profile_nulls(spark, d):
    return _rounded_profile(orders_nulls(spark, d).select("o_totalprice", "o_orderstatus"))


@query("""
WITH x AS (SELECT c_name, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS d, substr(p_brand, 1, 3) AS b FROM customer JOIN orders ON o_custkey = c_custkey JOIN part ON p_partkey = o_orderkey % 100)
SELECT 'd' AS "column", 'date_iso' AS pattern, round(avg(CASE WHEN regexp_matches(d, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') THEN 1.0 ELSE 0.0 END) * 100, 1) AS match_percentage FROM x
UNION ALL SELECT 'd', 'phone', round(avg(CASE WHEN regexp_matches(d, '^[-0-9+() ]{7,20}$') THEN 1.0 ELSE 0.0 END) * 100, 1) FROM x""")
def pattern_detect(spark, d):
    x = t(spark, d, "customer").join(t(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey")).join(t(spark, d, "part"), F.col("p_partkey") == F.col("o_orderkey") % 100)
    return profile.detect_patterns(x.select("c_name", F.to_date("o_orderdate").cast("string").alias("d"))).filter("column = 'd'")


@query("""
SELECT 'o_totalprice' AS "column", min(o_totalprice) AS min, max(o_totalprice) AS max, round(avg(o_totalprice), 6) AS mean, bool_or(o_totalprice < 0) AS has_negatives, bool_and(o_totalprice = floor(o_totalprice)) AS all_integers,
       bool_and(o_totalprice = floor(o_totalprice)) AND count(DISTINCT o_totalprice) = count(*) AS likely_id FROM orders
UNION ALL SELECT 'o_orderkey', min(o_orderkey), max(o_orderkey), round(avg(o_orderkey), 6), bool_or(o_orderkey < 0), true, count(DISTINCT o_orderkey) = count(*) FROM orders""")
def numeric_characteristics(spark, d):
    return profile.numeric_characteristics(t(spark, d, "orders"), ["o_totalprice", "o_orderkey"]).withColumn("mean", F.round("mean", 6))


@query("""
SELECT 'p_type' AS "column", CAST(min(length(p_type)) AS INTEGER) AS min_length, CAST(max(length(p_type)) AS INTEGER) AS max_length, round(avg(length(p_type)), 6) AS avg_length, min(length(p_type)) = max(length(p_type)) AS all_same_length,
       bool_or(regexp_matches(p_type, '[0-9]')) AS contains_digits, bool_or(regexp_matches(p_type, '[a-zA-Z]')) AS contains_letters, round(count(DISTINCT p_type) / count(*), 6) AS unique_ratio FROM part""")
def string_characteristics(spark, d):
    return profile.string_characteristics(t(spark, d, "part"), ["p_type"]).withColumn("avg_length", F.round("avg_length", 6)).withColumn("unique_ratio", F.round("unique_ratio", 6))


@query("""
SELECT 'o_orderkey' AS name, 'Whole Number' AS target_type, false AS nullable, count(DISTINCT o_orderkey) = count(*) AS "unique", 'Unknown' AS semantic_type FROM orders
UNION ALL SELECT 'o_totalprice', 'Decimal Number', false, count(DISTINCT o_totalprice) = count(*), 'Amount' FROM orders
UNION ALL SELECT 'o_orderdate', 'Date/Time', false, count(DISTINCT o_orderdate) = count(*), 'Date' FROM orders""")
def schema_infer(spark, d):
    return profile.infer_schema(t(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")).select("name", "target_type", "nullable", "unique", "semantic_type")


@query("SELECT * FROM (VALUES ('sales', 7, 1.0::DOUBLE, 'orders'), ('financial', 0, 0.0::DOUBLE, NULL), ('inventory', 0, 0.0::DOUBLE, NULL), ('hr', 0, 0.0::DOUBLE, NULL)) AS x(domain, score, confidence, subtype)")
def domain_detect(spark, d):
    """Five columns with a word of sales (order, price, order, order, order), and the pattern of an order's date."""
    o = t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
    return profile.domain_frame(o.toDF(*(c.removeprefix("o_") for c in o.columns)))


@query("""
WITH pairs AS (
  SELECT 'customer' AS st, 'c_nationkey' AS sc, 'nation' AS tt, 'n_nationkey' AS tc, (SELECT count(*) FROM (SELECT DISTINCT c_nationkey AS k FROM customer INTERSECT SELECT n_nationkey FROM nation)) AS shared,
         least((SELECT count(DISTINCT c_nationkey) FROM customer), (SELECT count(*) FROM nation)) AS least_n, 'N:1' AS rel
  UNION ALL SELECT 'customer', 'c_custkey', 'orders', 'o_custkey', (SELECT count(*) FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders)), least((SELECT count(*) FROM customer), (SELECT count(DISTINCT o_custkey) FROM orders)), '1:N')
SELECT st AS source_table, sc AS source_column, tt AS target_table, tc AS target_column, shared / least_n AS overlap_ratio, rel AS relationship_type FROM pairs""")
def relationships_overlap(spark, d):
    found = relationships.overlaps({n: t(spark, d, n) for n in ("customer", "orders", "nation")})
    want = (F.col("source_column") == "c_nationkey") & (F.col("target_column") == "n_nationkey") | (F.col("source_column") == "c_custkey") & (F.col("target_column") == "o_custkey")
    return found.filter(want).select("source_table", "source_column", "target_table", "target_column", "overlap_ratio", "relationship_type")


@query()
def relationships_ranked(spark, d):
    return relationships.find_relationships({n: t(spark, d, n) for n in ("customer", "orders", "nation", "supplier")})


# ---- validation ---------------------------------------------------------------------------------------------------------------------------


@query(f"""
WITH {ORDERS_NULLS}, dups AS (SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderkey % 50 = 0),
r AS (
  SELECT 'price set' AS rule_name, 'not_null' AS rule_type, 'o_totalprice' AS "column", count(*) FILTER (o_totalprice IS NULL) AS violations FROM orders_nulls
  UNION ALL SELECT 'range', 'range', 'o_totalprice', count(*) FILTER (o_totalprice < 1000 OR o_totalprice > 300000) FROM orders_nulls
  UNION ALL SELECT 'status', 'enum', 'o_orderstatus', count(DISTINCT CASE WHEN o_orderstatus NOT IN ('O', 'F') THEN o_orderstatus END) + max(CASE WHEN o_orderstatus IS NULL THEN 1 ELSE 0 END) FROM orders_nulls
  UNION ALL SELECT 'priority', 'regex', 'o_orderpriority', count(*) FILTER (NOT regexp_matches(o_orderpriority, '^[1-4]-')) FROM orders_nulls
  UNION ALL SELECT 'length', 'length', 'o_orderpriority', count(*) FILTER (length(o_orderpriority) > 6) FROM orders_nulls
  UNION ALL SELECT 'dear', 'custom_sql', '', count(*) FILTER (NOT (o_totalprice > 5000)) FROM orders_nulls
  UNION ALL SELECT 'customer', 'referential', 'o_custkey', (SELECT count(*) FROM orders_nulls ANTI JOIN (SELECT * FROM customer WHERE c_custkey % 10 <> 0) c ON o_custkey = c_custkey)
  UNION ALL SELECT 'key', 'unique', 'o_orderkey', count(*) - count(DISTINCT o_orderkey) FROM orders_nulls
  UNION ALL SELECT 'pair', 'unique', 'o_custkey,o_orderpriority', (SELECT count(*) FROM (SELECT 1 FROM orders_nulls GROUP BY o_custkey, o_orderpriority HAVING count(*) > 1))
)
SELECT rule_name, rule_type, "column", CAST(violations AS BIGINT) AS violations, violations = 0 AS passed FROM r""")
def rules_all(spark, d):
    rules = [
        {"name": "price set", "type": "not_null", "columns": ["o_totalprice"]},
        {"name": "range", "type": "range", "columns": ["o_totalprice"], "config": {"min": 1000, "max": 300000}},
        {"name": "status", "type": "enum", "columns": ["o_orderstatus"], "config": {"values": ["O", "F"]}},
        {"name": "priority", "type": "regex", "columns": ["o_orderpriority"], "config": {"pattern": "^[1-4]-"}},
        {"name": "length", "type": "length", "columns": ["o_orderpriority"], "config": {"max": 6}},
        {"name": "dear", "type": "custom_sql", "config": {"expression": "o_totalprice > 5000"}},
        {"name": "customer", "type": "referential", "columns": ["o_custkey"], "config": {"reference": "customer", "column": "c_custkey"}},
        {"name": "key", "type": "unique", "columns": ["o_orderkey"]},
        {"name": "pair", "type": "unique", "columns": ["o_custkey", "o_orderpriority"]},
    ]
    return validate.check_rules(orders_nulls(spark, d), rules, {"customer": t(spark, d, "customer").filter("c_custkey % 10 <> 0")})


@query(f"""
WITH {LEDGER}, both_ AS (SELECT ship_year, debit, credit FROM ledger UNION ALL SELECT ship_year, credit, debit FROM ledger),
s AS (SELECT ship_year, CAST(sum(CAST(debit AS DECIMAL(18,2))) AS DOUBLE) - CAST(sum(CAST(credit AS DECIMAL(18,2))) AS DOUBLE) AS x FROM both_ GROUP BY 1)
SELECT bool_and(abs(round(x, 4)) <= 0.01) AS balanced, count(*) AS "groups", count(*) FILTER (abs(round(x, 4)) > 0.01) AS imbalanced_groups, max(abs(round(x, 4))) AS largest_difference FROM s""")
def balance_total(spark, d):
    return validate.balance_summary(balanced_ledger(spark, d), "debit", "credit", ["ship_year"])


@query("""
WITH d AS (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0 UNION ALL SELECT c_custkey + 1000000 FROM customer WHERE c_custkey < 20),
f AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1), j AS (SELECT f.k AS fk, f.n, d.c_custkey AS dk FROM f FULL JOIN (SELECT DISTINCT c_custkey FROM d) d ON f.k = d.c_custkey)
SELECT 'o_custkey' AS fact_key, 'customer' AS dimension, count(fk) AS fact_unique_keys, count(dk) AS dimension_unique_keys, count(*) FILTER (dk IS NULL) AS orphan_values_count, CAST(coalesce(sum(n) FILTER (dk IS NULL), 0) AS BIGINT) AS orphan_records_count,
       CAST(0 AS BIGINT) AS null_keys, count(*) FILTER (fk IS NULL) AS unused_dimension_values_count, round((count(fk) - count(*) FILTER (dk IS NULL)) * 100.0 / count(fk), 2) AS fact_to_dimension,
       round((count(dk) - count(*) FILTER (fk IS NULL)) * 100.0 / count(dk), 2) AS dimension_used, count(*) FILTER (dk IS NULL) = 0 AS integrity_valid FROM j""")
def referential_integrity(spark, d):
    c = t(spark, d, "customer").select("c_custkey")
    dim = c.filter("c_custkey % 10 <> 0").unionByName(c.filter("c_custkey < 20").select((F.col("c_custkey") + 1000000).alias("c_custkey")))
    return validate.check_integrity(t(spark, d, "orders"), {"customer": (dim, "c_custkey")}, {"o_custkey": "customer"})


@query("""
WITH f AS (SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2), d AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_orderkey % 3 = 0)
SELECT count(*) AS fact_unique_keys, count(*) FILTER (d.l_partkey IS NULL) AS orphan_values_count, CAST(coalesce(sum(n) FILTER (d.l_partkey IS NULL), 0) AS BIGINT) AS orphan_records_count
FROM f LEFT JOIN d ON f.l_partkey = d.l_partkey AND f.l_suppkey = d.l_suppkey""")
def referential_composite(spark, d):
    li = t(spark, d, "lineitem")
    return validate.check_composite_integrity(li, li.filter("l_orderkey % 3 = 0"), ["l_partkey", "l_suppkey"], ["l_partkey", "l_suppkey"])


@query("""
WITH x AS (SELECT CAST(year(l_shipdate) AS INTEGER) AS y, l_returnflag AS f, l_extendedprice AS p FROM lineitem)
SELECT CASE WHEN grouping(y) = 0 THEN 1 WHEN grouping(f) = 0 THEN 2 ELSE 0 END AS level, CASE WHEN grouping(y) = 0 THEN 'ship_year' WHEN grouping(f) = 0 THEN 'l_returnflag' ELSE '(all)' END AS "column",
       coalesce(CAST(y AS VARCHAR), f) AS group_value, CAST(sum(CAST(p AS DECIMAL(18,2))) AS DOUBLE) AS total, count(*) AS "count" FROM x GROUP BY GROUPING SETS ((y), (f), ())""")
def totals_grouping_sets(spark, d):
    li = t(spark, d, "lineitem").withColumn("ship_year", F.year("l_shipdate"))
    return validate.check_totals(li, "l_extendedprice", ["ship_year", "l_returnflag"])


_IQR = """WITH {oo}, n AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice) - 1 AS r, count(*) OVER () AS n FROM oo),
q AS (SELECT max(CASE WHEN r = CAST(round((n - 1) * 0.25) AS BIGINT) THEN v END) AS q1, max(CASE WHEN r = CAST(round((n - 1) * 0.75) AS BIGINT) THEN v END) AS q3 FROM n),
b AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM q)
SELECT 'o_totalprice' AS "column", 'iqr' AS method, round(lo, 6) AS lower, round(hi, 6) AS upper, count(*) FILTER (o_totalprice < lo OR o_totalprice > hi) AS outlier_count, round(count(*) FILTER (o_totalprice < lo OR o_totalprice > hi) * 100.0 / count(*), 1) AS outlier_pct FROM oo, b GROUP BY lo, hi"""


@query(_IQR.replace("{oo}", ORDERS_OUTLIERS))
def outliers_iqr(spark, d):
    return validate.detect_outliers(orders_outliers(spark, d), ["o_totalprice"]).select("column", "method", F.round("lower", 6).alias("lower"), F.round("upper", 6).alias("upper"), "outlier_count", "outlier_pct")


@query(f"""WITH {ORDERS_OUTLIERS}, s AS (SELECT avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS s FROM oo)
SELECT 'o_totalprice' AS "column", 'zscore' AS method, count(*) FILTER (abs(o_totalprice - m) > 3 * s) AS outlier_count, round(count(*) FILTER (abs(o_totalprice - m) > 3 * s) * 100.0 / count(*), 1) AS outlier_pct FROM oo, s""")
def outliers_zscore(spark, d):
    return validate.detect_outliers(orders_outliers(spark, d), ["o_totalprice"], "zscore").select("column", "method", "outlier_count", "outlier_pct")


def _anomaly_sql(columns):
    rows = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER (abs({c} - m) > 3 * s) AS outlier_count FROM lineitem, (SELECT avg({c}) AS m, stddev_samp({c}) AS s FROM lineitem)" for c in columns)
    return rows


@query(_anomaly_sql(["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))
def anomalies_all(spark, d):
    return validate.detect_anomalies(t(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]).select("column", "outlier_count")


# ---- quality ---------------------------------------------------------------------------------------------------------------------------------


RULES = quality.RuleBuilder().require_range("o_totalprice", 1000, 300000).require_values("o_orderstatus", ["O", "F"]).require_unique("o_orderkey").require_freshness("o_orderdate", 100).build()


def damaged(spark, d):
    o = orders_nulls(spark, d).select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    return o.unionByName(o.filter("o_orderkey % 50 = 0")).withColumn("start_at", F.col("o_orderdate")).withColumn("end_at", F.when(F.col("o_orderkey") % 17 == 0, F.col("o_orderdate") - F.expr("INTERVAL 1 DAY")).otherwise(F.col("o_orderdate") + F.expr("INTERVAL 7 DAYS")))


_DAMAGED = f"""{ORDERS_NULLS}, base AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate FROM orders_nulls), u AS (SELECT * FROM base UNION ALL SELECT * FROM base WHERE o_orderkey % 50 = 0),
dm AS (SELECT *, o_orderdate AS start_at, CASE WHEN o_orderkey % 17 = 0 THEN o_orderdate - INTERVAL 1 DAY ELSE o_orderdate + INTERVAL 7 DAY END AS end_at FROM u)"""
_DM_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "start_at", "end_at"]
_NULL_PCT = " + ".join(f"(100.0 - (count(*) - count({c})) * 100.0 / count(*))" for c in _DM_COLS)
_UNIQ_PCT = " + ".join(f"((count(DISTINCT {c}) + max(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END)) * 100.0 / count(*))" for c in _DM_COLS)


def _off(c):
    return f"(SELECT 100.0 - least(30.0, count(*) FILTER (abs({c} - m) > 3 * s) * 200.0 / count({c})) FROM dm, (SELECT avg({c}) AS m, stddev_pop({c}) AS s FROM dm) WHERE {c} IS NOT NULL)"


@query(f"""WITH {_DAMAGED}, s AS (
  SELECT 'completeness' AS dimension, ({_NULL_PCT}) / 7 AS score, 0.25::DOUBLE AS weight FROM dm
  UNION ALL SELECT 'uniqueness', ((SELECT count(*) FROM (SELECT DISTINCT * FROM dm)) * 100.0 / count(*) + ({_UNIQ_PCT}) / 7) / 2, 0.2::DOUBLE FROM dm
  UNION ALL SELECT 'validity', ((count(*) - count(*) FILTER (o_totalprice < 1000) - count(*) FILTER (o_totalprice > 300000)) * 100.0 / count(*) + (count(*) - count(*) FILTER (o_orderstatus NOT IN ('O', 'F'))) * 100.0 / count(*)) / 2, 0.2::DOUBLE FROM dm
  UNION ALL SELECT 'accuracy', ({_off('o_orderkey')} + {_off('o_custkey')} + {_off('o_totalprice')}) / 3, 0.15::DOUBLE
  UNION ALL SELECT 'consistency', count(*) FILTER (start_at <= end_at) * 100.0 / count(*), 0.1::DOUBLE FROM dm
  UNION ALL SELECT 'timeliness', greatest(0.0, 100.0 - (date_diff('day', CAST(max(o_orderdate) AS DATE), DATE '2001-12-31') - 100) / 100.0 * 100.0), 0.1::DOUBLE FROM dm)
SELECT dimension, round(score, 2) AS score, weight, CAST(round(CAST(CAST(round(score, 2) * weight AS VARCHAR) AS DECIMAL(30,15)), 2) AS DOUBLE) AS weighted_contribution FROM s""")
def quality_overall(spark, d):
    return quality.quality_scores(damaged(spark, d), RULES, "2001-12-31")


@query(f"""WITH {_DAMAGED}, s AS (SELECT 'completeness' AS dimension, round(({_NULL_PCT}) / 7, 2) AS b FROM dm)
SELECT dimension, 100.0::DOUBLE AS score_before, b AS score_after, round(b - 100.0, 2) AS change, CASE WHEN b - 100.0 < -1 THEN 'declined' ELSE 'unchanged' END AS direction FROM s""")
def quality_compare(spark, d):
    clean = t(spark, d, "orders")
    return quality.compare_quality(quality.quality_scores(clean, dimensions=("completeness",)), quality.quality_scores(damaged(spark, d), RULES, dimensions=("completeness",)))


@query(f"""WITH {_DAMAGED}, n AS (SELECT count(*) AS n FROM dm)
SELECT * FROM (
  SELECT CASE WHEN p > 20 THEN 'critical' WHEN p > 5 THEN 'warning' ELSE 'info' END AS severity, 'completeness' AS dimension, c AS "column", 'missing_values' AS issue_type, k AS affected_rows, p AS affected_percentage
  FROM (SELECT 'o_orderstatus' AS c, count(*) - count(o_orderstatus) AS k, round((count(*) - count(o_orderstatus)) * 100.0 / count(*), 2) AS p FROM dm UNION ALL SELECT 'o_totalprice', count(*) - count(o_totalprice), round((count(*) - count(o_totalprice)) * 100.0 / count(*), 2) FROM dm)
  UNION ALL SELECT 'critical', 'uniqueness', 'o_orderkey', 'duplicate_keys', count(*) - count(DISTINCT o_orderkey), round((count(*) - count(DISTINCT o_orderkey)) * 100.0 / count(*), 2) FROM dm
  UNION ALL SELECT CASE WHEN p > 20 THEN 'critical' WHEN p > 5 THEN 'warning' ELSE 'info' END, 'validity', c, 'invalid_values', k, p FROM (
    SELECT 'o_totalprice' AS c, count(*) FILTER (o_totalprice < 1000) + count(*) FILTER (o_totalprice > 300000) AS k, round((count(*) FILTER (o_totalprice < 1000) + count(*) FILTER (o_totalprice > 300000)) * 100.0 / count(*), 2) AS p FROM dm
    UNION ALL SELECT 'o_orderstatus', count(*) FILTER (o_orderstatus NOT IN ('O', 'F')), round(count(*) FILTER (o_orderstatus NOT IN ('O', 'F')) * 100.0 / count(*), 2) FROM dm)) WHERE affected_rows > 0""")
def quality_issues(spark, d):
    return quality.quality_issues(damaged(spark, d), RULES)


# ---- mapping and hierarchies ---------------------------------------------------------------------------------------------------------------------


@query("""
WITH v AS (SELECT DISTINCT c_nationkey AS a FROM customer), n AS (SELECT count(*) AS k FROM v JOIN nation ON a = n_nationkey), s AS (SELECT count(*) AS k FROM v JOIN (SELECT DISTINCT s_nationkey FROM supplier) ON a = s_nationkey)
SELECT 'customer' AS source_file, 'c_nationkey' AS source_column, 'nation' AS target_file, 'n_nationkey' AS target_column, 'exact' AS match_type, round((SELECT k FROM n) / count(*), 2) AS match_confidence FROM v
UNION ALL SELECT 'customer', 'c_nationkey', 'supplier', 's_nationkey', 'exact', round((SELECT k FROM s) / count(*), 2) FROM v HAVING (SELECT k FROM s) / count(*) > 0.7""")
def mapping_discover_exact(spark, d):
    found = mapping.discover({n: t(spark, d, n) for n in ("customer", "nation", "supplier")}, source="customer")
    return found.filter("source_column = 'c_nationkey' AND target_column IN ('n_nationkey', 's_nationkey')")


def _fuzzy_sql(source: str, target: str, least: float) -> str:
    """All pairs; the longest common subsequence by a row of its table for each letter of the source, kept as a list."""
    return f"""a AS (SELECT DISTINCT trim({source}) AS s FROM part), b AS (SELECT DISTINCT trim({target}) AS t FROM part),
lcs(s, t, i, r) AS (
  SELECT s, t, 0, list_transform(range(length(t) + 1), lambda x: 0::BIGINT) FROM a, b
  UNION ALL
  SELECT s, t, i + 1, list_reduce(list_prepend([0::BIGINT], list_transform(range(1, length(t) + 1), lambda j: [j])), lambda acc, j: list_append(acc, CASE WHEN substr(s, CAST(i + 1 AS BIGINT), 1) = substr(t, j[1], 1) THEN r[j[1]] + 1 ELSE greatest(r[j[1] + 1], acc[j[1]]) END))
  FROM lcs WHERE i < length(s)
),
q AS (SELECT s, t, round(2.0 * r[length(t) + 1] / (length(s) + length(t)), 4)::DOUBLE AS ratio FROM lcs WHERE i = length(s)),
best AS (SELECT s AS source, t AS target, ratio FROM q WHERE ratio >= {least} QUALIFY row_number() OVER (PARTITION BY s ORDER BY ratio DESC, t) = 1)"""


@query(f"WITH RECURSIVE {_fuzzy_sql("replace(p_brand, '#', '-no ')", 'p_brand', 0.7)} SELECT * FROM best")
def fuzzy_match(spark, d):
    p = t(spark, d, "part")
    return mapping.fuzzy_matches(p.select(F.regexp_replace("p_brand", "#", "-no ").alias("brand")), p, "brand", "p_brand", 0.7)


_MAP_SQL = "m(value, target) AS (VALUES ('A', 'kept'), ('N', 'kept'), ('R', 'back'))"


def _groups(spark, d):
    m = spark.createDataFrame([("A", "kept"), (" N", "kept"), ("R", "old"), ("R", "back2"), ("R", "back"), ("", "x")], "s string, t string").withColumn("o", F.monotonically_increasing_id())
    return mapping.group_amounts(t(spark, d, "lineitem"), "l_extendedprice", "l_returnflag", mapping.last_mapping(m, "s", "t", "o"))


@query(f"WITH {_MAP_SQL} SELECT target AS \"group\", round(CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE), 2) AS total, count(*) AS \"count\", true AS mapped FROM lineitem JOIN m ON value = l_returnflag GROUP BY 1")
def validate_amounts_groups(spark, d):
    return _groups(spark, d)


@query(f"""WITH {_MAP_SQL}, g AS (SELECT target, round(CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE), 2) AS total FROM lineitem JOIN m ON value = l_returnflag GROUP BY 1),
x AS (SELECT round(sum(total) FILTER (target = 'kept'), 4) AS l, round(sum(total) FILTER (target = 'back'), 4) AS r FROM g)
SELECT 'ratio_in_range' AS rule, l AS left_sum, r AS right_sum, round(l / r, 4) AS difference, l / r BETWEEN 1 AND 10 AS passed FROM x""")
def validate_amounts_ratio(spark, d):
    return mapping.check_amounts(_groups(spark, d), {"type": "ratio_in_range", "left": ["kept"], "right": ["back"], "min": 1, "max": 10})


@query(f"""WITH {_MAP_SQL}, g AS (SELECT target, round(CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE), 2) AS total FROM lineitem JOIN m ON value = l_returnflag GROUP BY 1),
x AS (SELECT round(sum(total) FILTER (target = 'kept'), 4) AS l, round(sum(total) FILTER (target = 'back'), 4) AS r FROM g)
SELECT 'sum_equals' AS rule, l AS left_sum, r AS right_sum, round(l - r, 4) AS difference, abs(l - r) <= 0.01 AS passed FROM x""")
def validate_amounts_sum(spark, d):
    return mapping.check_amounts(_groups(spark, d), {"type": "sum_equals", "left": ["kept"], "right": ["back"]})


@query("""SELECT coalesce(a.v, b.v) AS value, CASE WHEN a.v IS NOT NULL AND b.v IS NOT NULL THEN 'both' WHEN b.v IS NULL THEN 'left_only' ELSE 'right_only' END AS status
FROM (SELECT DISTINCT n_name AS v FROM nation WHERE n_nationkey < 15) a FULL JOIN (SELECT DISTINCT n_name AS v FROM nation WHERE n_nationkey > 9) b ON a.v = b.v""")
def compare_structures(spark, d):
    n = t(spark, d, "nation")
    return mapping.compare_structures(n.filter("n_nationkey < 15"), n.filter("n_nationkey > 9"), "n_name", "n_name")


@query(f"""WITH {EDGES}, p AS (SELECT DISTINCT parent AS e FROM edges), c AS (SELECT DISTINCT child AS e FROM edges), a AS (SELECT e FROM p UNION SELECT e FROM c)
SELECT 'child_references_parent' AS hierarchy_pattern, CAST(0 AS BIGINT) AS self_referencing_rows, count(*) AS element_count, count(*) FILTER (e NOT IN (SELECT e FROM c)) AS root_count, count(*) FILTER (e NOT IN (SELECT e FROM p)) AS leaf_count, 3 AS max_depth FROM a""")
def hierarchy_analyze(spark, d):
    return hierarchy.analyze(edges(spark, d), "parent", "child")


@query("SELECT 'C5' AS element, 0 AS level UNION ALL SELECT 'N' || c_nationkey, 1 FROM customer WHERE c_custkey = 5 UNION ALL SELECT 'R' || n_regionkey, 2 FROM nation, customer WHERE n_nationkey = c_nationkey AND c_custkey = 5 UNION ALL SELECT 'ALL', 3")
def hierarchy_path(spark, d):
    return hierarchy.path_to_root(edges(spark, d), "parent", "child", "C5")


@query("SELECT 'N' || n_nationkey AS element, 1 AS level FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'C' || c_custkey, 2 FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 1")
def hierarchy_descendants(spark, d):
    return hierarchy.descendants(edges(spark, d), "parent", "child", "R1")


@query("SELECT 'N' || n_nationkey AS element FROM nation WHERE n_regionkey = 2")
def hierarchy_children(spark, d):
    return hierarchy.children(edges(spark, d), "parent", "child", "R2")


@query("""SELECT 1 AS level, 'r_name' AS "column", count(DISTINCT r_name) AS unique_values FROM region UNION ALL SELECT 2, 'n_name', count(DISTINCT n_name) FROM nation""")
def hierarchy_levels(spark, d):
    return hierarchy.level_counts(t(spark, d, "nation").join(t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")), ["r_name", "n_name"])


@query(f"""WITH RECURSIVE {EDGES}, a AS (SELECT parent AS e FROM edges UNION SELECT child FROM edges), m AS (SELECT 'C' || c_custkey AS e, CAST(c_acctbal AS DECIMAL(18,2)) AS x FROM customer),
w(root, element, lvl) AS (SELECT e, e, 0 FROM a UNION ALL SELECT w.root, edges.child, w.lvl + 1 FROM w JOIN edges ON edges.parent = w.element WHERE w.lvl < 50),
s AS (SELECT root, CAST(sum(x) AS DOUBLE) AS total FROM w JOIN m ON m.e = w.element GROUP BY 1)
SELECT a.e AS element, round(coalesce(CAST(m.x AS DOUBLE), 0.0), 2) AS direct_amount, round(coalesce(s.total, 0.0), 2) AS total_amount FROM a LEFT JOIN m ON m.e = a.e LEFT JOIN s ON s.root = a.e""")
def hierarchy_rollup(spark, d):
    amounts = t(spark, d, "customer").select(F.concat(F.lit("C"), F.col("c_custkey")).alias("key"), "c_acctbal")
    return hierarchy.rollup(edges(spark, d), "parent", "child", amounts, "key", "c_acctbal")


# ---- personal data ---------------------------------------------------------------------------------------------------------------------------------


def _bounded(pattern: str) -> str:
    """A pattern whose word bounds know all letters, as Spark's do: a bound at the front or end becomes a letter that isn't one of a word, or the text's end."""
    out = re.sub(r"\\b(?=$|[|)])", "(?:$|[^\\\\p{L}\\\\p{N}_])", pattern)
    return re.sub(r"\\b", "(?:^|[^\\\\p{L}\\\\p{N}_])", out)


def _rate_sql(p) -> str:
    text = _bounded(p.pattern).replace("'", "''")
    return f"SELECT 'text' AS \"column\", '{p.name}' AS pii_type, round(avg(CASE WHEN regexp_matches(text, '{text}', 'i') THEN 1.0 ELSE 0.0 END), 6) AS match_rate FROM documents WHERE text IS NOT NULL"


@query(" UNION ALL ".join(_rate_sql(p) for p in pii.CATALOGUE if p.pattern))
def pii_match_rates(spark, d):
    return pii.match_rates(t(spark, d, "documents"), ["text"]).select("column", "pii_type", F.round("match_rate", 6).alias("match_rate"))


@query()
def pii_detect(spark, d):
    c = t(spark, d, "customer").select(F.col("c_name").alias("customer_name"), F.concat(F.lit("user"), F.col("c_custkey"), F.lit("@example.com")).alias("email"), F.col("c_acctbal").alias("balance"))
    return pii.detect_pii(c)


_SSN = "lpad(CAST(c_custkey * 7919 % 1000 AS VARCHAR), 3, '0') || '-' || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') || '-' || lpad(CAST(c_custkey * 31 % 10000 AS VARCHAR), 4, '0')"


@query(f"""WITH x AS (SELECT c_custkey, {_SSN} AS ssn FROM customer)
SELECT c_custkey, substr(ssn, 1, 3) NOT IN ('000', '666') AND substr(ssn, 1, 3) < '900' AND substr(ssn, 5, 2) <> '00' AND substr(ssn, 8, 4) <> '0000' AS valid FROM x""")
def ssn_validate(spark, d):
    part = lambda n, w: F.lpad((n).cast("string"), w, "0")
    k = F.col("c_custkey")
    ssn = F.concat_ws("-", part(k * 7919 % 1000, 3), part(k % 100, 2), part(k * 31 % 10000, 4))
    return t(spark, d, "customer").select("c_custkey", pii.valid_ssn(ssn).alias("valid"))


_CARD, _IBAN = "'453201511283' || right('000' || CAST(c_custkey % 10000 AS VARCHAR), 4)", "'GB' || right('0' || CAST(c_custkey % 100 AS VARCHAR), 2) || 'WEST12345698765432'"


@query(f"""WITH x AS (SELECT c_custkey, {_CARD} AS card, {_IBAN} AS iban FROM customer),
l AS (SELECT c_custkey, iban, list_sum([CASE WHEN i % 2 = 1 THEN CASE WHEN 2 * d > 9 THEN 2 * d - 9 ELSE 2 * d END ELSE d END FOR d, i IN [CAST(substr(card, k, 1) AS INTEGER) FOR k IN range(1, 17)]]) AS luhn FROM x),
m AS (SELECT c_custkey, luhn, CAST(list_aggregate([CASE WHEN c >= 'A' THEN CAST(ord(c) - 55 AS VARCHAR) ELSE c END FOR c IN string_split(substr(iban, 5) || substr(iban, 1, 4), '')], 'string_agg', '') AS HUGEINT) AS number FROM l)
SELECT c_custkey, luhn % 10 = 0 AS card_ok, number % 97 = 1 AS iban_ok FROM m""")
def card_iban_validate(spark, d):
    k = F.col("c_custkey")
    card = F.concat(F.lit("453201511283"), F.lpad((k % 10000).cast("string"), 4, "0"))
    iban = F.concat(F.lit("GB"), F.lpad((k % 100).cast("string"), 2, "0"), F.lit("WEST12345698765432"))
    return t(spark, d, "customer").select("c_custkey", pii.valid_card(card).alias("card_ok"), pii.valid_iban(iban).alias("iban_ok"))


def _people(spark, d):
    k = F.col("c_custkey")
    return t(spark, d, "customer").select(
        "c_custkey",
        F.concat(F.lit("user"), k, F.lit("@mail.example.org")).alias("email"),
        F.concat(F.lit("555-010-"), F.lpad((k % 10000).cast("string"), 4, "0")).alias("phone"),
        F.concat(F.lit("4532-0151-1283-"), F.lpad((k % 10000).cast("string"), 4, "0")).alias("card"),
        F.concat(F.lit("123-45-"), F.lpad((k % 10000).cast("string"), 4, "0")).alias("ssn"),
        F.when(k % 10 != 0, F.col("c_name")).alias("c_name"),
        (k % 90).cast("int").alias("age"),
        F.date_add(F.to_date(F.lit("1950-01-01")), (k % 20000).cast("int")).alias("dob"),
        F.concat(F.lpad((k % 100000).cast("string"), 5, "0"), F.lit("-1234")).alias("zip"),
        F.concat(F.lit("10."), k % 256, F.lit(".7.9")).alias("ip"),
        (F.col("c_acctbal") * 20).alias("salary"),
        "c_mktsegment",
    )


_PEOPLE = """people AS (SELECT c_custkey, 'user' || c_custkey || '@mail.example.org' AS email, '555-010-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') AS phone, '4532-0151-1283-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') AS card,
  '123-45-' || lpad(CAST(c_custkey % 10000 AS VARCHAR), 4, '0') AS ssn, CASE WHEN c_custkey % 10 <> 0 THEN c_name END AS c_name, c_custkey % 90 AS age, CAST(DATE '1950-01-01' + CAST(c_custkey % 20000 AS INTEGER) AS DATE) AS dob,
  lpad(CAST(c_custkey % 100000 AS VARCHAR), 5, '0') || '-1234' AS zip, '10.' || (c_custkey % 256) || '.7.9' AS ip, c_acctbal * 20 AS salary, c_mktsegment FROM customer)"""


@query(f"""WITH {_PEOPLE} SELECT c_custkey, substr(email, 1, 1) || '***@' || 'm***.com' AS email, '***-***-' || right(phone, 4) AS phone, '****-****-****-' || right(card, 4) AS card, '***-**-' || right(ssn, 4) AS ssn,
  CASE WHEN length(c_name) > 4 THEN substr(c_name, 1, greatest(1, CAST(floor(length(c_name) / 4) AS INTEGER))) || repeat('*', length(c_name) - 2 * greatest(1, CAST(floor(length(c_name) / 4) AS INTEGER))) || right(c_name, greatest(1, CAST(floor(length(c_name) / 4) AS INTEGER))) ELSE repeat('*', length(c_name)) END AS c_name FROM people""")
def mask_all(spark, d):
    m = anonymize.mask
    return _people(spark, d).select("c_custkey", m(F.col("email"), "email").alias("email"), m(F.col("phone"), "phone").alias("phone"), m(F.col("card"), "credit_card").alias("card"), m(F.col("ssn"), "ssn").alias("ssn"), m(F.col("c_name")).alias("c_name"))


@query(f"WITH {_PEOPLE} SELECT c_custkey, substr(sha256('42:' || email), 1, 16) AS email, '[REDACTED]' AS ssn FROM people")
def hash_redact(spark, d):
    out, _ = anonymize.anonymize(_people(spark, d).select("c_custkey", "email", "ssn"), {"email": {"strategy": "hash"}, "ssn": {"pii_type": "ssn"}}, "c_custkey")
    return out


@query(f"""WITH {_PEOPLE} SELECT c_custkey, (age // 10 * 10) || '-' || (age // 10 * 10 + 9) AS age, (year(dob) // 10 * 10) || 's' AS dob, substr(zip, 1, 3) || 'XX' AS zip, '10.' || (c_custkey % 256) || '.0.0/16' AS ip,
  CASE WHEN salary < 30000 THEN '<$30K' WHEN salary < 50000 THEN '$30K-$50K' WHEN salary < 75000 THEN '$50K-$75K' WHEN salary < 100000 THEN '$75K-$100K' WHEN salary < 150000 THEN '$100K-$150K' ELSE '$150K+' END AS salary, substr(c_name, 1, 3) AS c_name FROM people""")
def generalize_all(spark, d):
    g = anonymize.generalize
    kinds = {"age": "age", "dob": "date_of_birth", "zip": "zip_code", "ip": "ip_address", "salary": "salary", "c_name": None}
    return _people(spark, d).select("c_custkey", *(g(F.col(c), k).alias(c) for c, k in kinds.items()))


@query(f"WITH {_PEOPLE} SELECT c_custkey, CASE WHEN c_name IS NOT NULL THEN {rng.sql_pick(42, 'first', 'c_custkey', anonymize.FIRST_NAMES)} || ' ' || {rng.sql_pick(42, 'last', 'c_custkey', anonymize.LAST_NAMES)} END AS c_name FROM people")
def synthetic_name(spark, d):
    return _people(spark, d).select("c_custkey", anonymize.synthetic(F.col("c_name"), "full_name", F.col("c_custkey"), 42).alias("c_name"))


@query(f"WITH {_PEOPLE}, v AS (SELECT DISTINCT c_name FROM people WHERE c_name IS NOT NULL), k AS (SELECT c_name, 'TKN_' || repeat('0', greatest(0, 6 - length(CAST(row_number() OVER (ORDER BY c_name) AS VARCHAR)))) || row_number() OVER (ORDER BY c_name) AS token FROM v) SELECT c_custkey, token AS c_name FROM people LEFT JOIN k USING (c_name)")
def tokenize(spark, d):
    return anonymize.anonymize(_people(spark, d).select("c_custkey", "c_name"), {"c_name": {"strategy": "tokenize"}}, "c_custkey")[0]


@query(f"""WITH {_PEOPLE}, r AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS n FROM people WHERE c_name IS NOT NULL), v AS (SELECT c_name AS x, row_number() OVER (ORDER BY md5('42:' || c_custkey), c_custkey) AS n FROM people WHERE c_name IS NOT NULL)
SELECT p.c_custkey, v.x AS c_name FROM people p LEFT JOIN r ON p.c_custkey = r.c_custkey LEFT JOIN v ON r.n = v.n""")
def shuffle_column(spark, d):
    return anonymize.shuffled(_people(spark, d).select("c_custkey", "c_name"), "c_name", "c_custkey", 42)


@query(f"WITH {_PEOPLE} SELECT c_custkey, round(salary + salary * 0.1 * ({rng.sql_uniform(42, 'noise', 'c_custkey')} * 2 - 1), 6) AS salary FROM people")
def noise_column(spark, d):
    return _people(spark, d).select("c_custkey", F.round(anonymize.noise(F.col("salary"), F.col("c_custkey"), 42), 6).alias("salary"))


@query(f"WITH {_PEOPLE} SELECT c_custkey, substr(sha256('email:' || sha256('42:' || email)), 1, 16) AS email FROM people")
def consistent_hash(spark, d):
    return _people(spark, d).select("c_custkey", anonymize.consistent_hash(F.col("email"), "email", 42).alias("email"))


@query(f"""WITH RECURSIVE {_fuzzy_sql("p_brand || 's'", 'p_brand', 0.7)}, n AS (SELECT count(*) AS n, count(*) FILTER (s IN (SELECT source FROM best)) AS k FROM a)
SELECT 'a' AS source_file, 'kind' AS source_column, 'b' AS target_file, 'p_brand' AS target_column, 'fuzzy' AS match_type, round(k / n, 2) AS match_confidence FROM n WHERE round(k / n, 2) > 0.7""")
def mapping_discover_fuzzy(spark, d):
    kinds = t(spark, d, "part").select("p_brand").distinct()
    return mapping.discover({"a": kinds.select(F.concat(F.col("p_brand"), F.lit("s")).alias("kind")), "b": kinds}, 0.7, "a", fuzzy=True)


# ---- subsets and distributions ------------------------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey FROM orders ORDER BY md5('42:' || o_orderkey), o_orderkey LIMIT 500")
def subset_random(spark, d):
    return subset.random_subset(t(spark, d, "orders").select("o_orderkey"), 500, "o_orderkey")


def _strata_sql(want):
    return f"""WITH g AS (SELECT o_orderstatus AS s, count(*) AS k FROM orders GROUP BY 1), r AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('42:' || o_orderkey), o_orderkey) AS n FROM orders)
SELECT o_orderkey, o_orderstatus FROM r JOIN g ON s = o_orderstatus WHERE n <= {want}"""


@query(_strata_sql("greatest(1, floor(k * (600::DOUBLE / (SELECT count(*) FROM orders))))"))
def subset_stratified(spark, d):
    return subset.stratified_subset(t(spark, d, "orders").select("o_orderkey", "o_orderstatus"), 600, "o_orderstatus", "o_orderkey")


@query(_strata_sql("greatest(1, 600 // (SELECT count(*) FROM g))"))
def subset_equal(spark, d):
    return subset.stratified_subset(t(spark, d, "orders").select("o_orderkey", "o_orderstatus"), 600, "o_orderstatus", "o_orderkey", equal=True)


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-03-01' AND DATE '1996-05-31'")
def subset_time_window(spark, d):
    return subset.time_window(t(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "1996-03-01", "1996-05-31")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM (SELECT o_orderkey FROM orders ORDER BY md5('42:' || o_orderkey), o_orderkey LIMIT 200))")
def subset_referential(spark, d):
    return subset.referential_subset(t(spark, d, "orders"), {"lines": (t(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), "l_orderkey", "o_orderkey")}, 200, "o_orderkey")["lines"]


@query("WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS n, count(*) OVER () // 300 AS k FROM orders) SELECT o_orderkey FROM r WHERE n % k = 0 AND n // k < 300")
def subset_systematic(spark, d):
    return subset.systematic_subset(t(spark, d, "orders").select("o_orderkey"), 300, ["o_orderkey"])


_SUB = "s AS (SELECT * FROM orders WHERE o_orderkey % 7 = 0)"


def _pair(spark, d):
    o = t(spark, d, "orders")
    return o, o.filter("o_orderkey % 7 = 0")


@query(f"""WITH {_SUB}, p AS (SELECT o_orderpriority AS v, count(*) / (SELECT count(*) FROM orders) AS p FROM orders GROUP BY 1), q AS (SELECT o_orderpriority AS v, count(*) / (SELECT count(*) FROM s) AS q FROM s GROUP BY 1)
SELECT round(1 - sum(abs(coalesce(p, 0) - coalesce(q, 0))) / 2, 3) AS similarity FROM p FULL JOIN q USING (v)""")
def dist_tvd(spark, d):
    return subset.total_variation(*_pair(spark, d), "o_orderpriority")


@query(f"""WITH {_SUB}, p AS (SELECT o_orderpriority AS v, count(*) / (SELECT count(*) FROM orders) AS p FROM orders GROUP BY 1), q AS (SELECT o_orderpriority AS v, count(*) / (SELECT count(*) FROM s) AS q FROM s GROUP BY 1),
x AS (SELECT coalesce(p, 0) + 1e-10 AS p, coalesce(q, 0) + 1e-10 AS q FROM p FULL JOIN q USING (v)), n AS (SELECT p / sum(p) OVER () AS p, q / sum(q) OVER () AS q FROM x), m AS (SELECT p, q, (p + q) / 2 AS m FROM n)
SELECT round(greatest(0.0, 1 - sqrt(greatest(sum(p * ln(p / m) + q * ln(q / m)) / 2, 0.0))), 3) AS similarity FROM m""")
def dist_categorical_js(spark, d):
    return subset.categorical_similarity(*_pair(spark, d), "o_orderpriority")


@query(f"WITH {_SUB} SELECT round(least(1.0, (SELECT date_diff('day', CAST(min(o_orderdate) AS DATE), CAST(max(o_orderdate) AS DATE)) FROM s) / (SELECT date_diff('day', CAST(min(o_orderdate) AS DATE), CAST(max(o_orderdate) AS DATE)) FROM orders)), 3) AS similarity")
def dist_temporal(spark, d):
    return subset.temporal_similarity(*_pair(spark, d), "o_orderdate")


@query(f"WITH {_SUB} SELECT round(greatest(0.0, 1 - 2 * abs((SELECT avg(CASE WHEN o_totalprice > 150000 THEN 1.0 ELSE 0.0 END) FROM orders) - (SELECT avg(CASE WHEN o_totalprice > 150000 THEN 1.0 ELSE 0.0 END) FROM s))), 3) AS similarity")
def dist_boolean(spark, d):
    a, b = (x.withColumn("dear", F.col("o_totalprice") > 150000) for x in _pair(spark, d))
    return subset.boolean_similarity(a, b, "dear")


def _near_sql(c: str) -> str:
    near = lambda f: f"greatest(0.0, 1.0 - CASE WHEN a.{f} = 0 THEN CASE WHEN b.{f} = 0 THEN 0.0 ELSE 1.0 END ELSE least(1.0, abs(a.{f} - b.{f}) / abs(a.{f})) END)"
    one = f"SELECT avg({c}) AS m, stddev_samp({c}) AS s, quantile_cont({c}::DOUBLE, 0.5) AS q FROM"
    return f"SELECT '{c}' AS \"column\", round(({near('m')} + {near('s')} + {near('q')} + 1.0) / 4, 3) AS similarity FROM ({one} orders) a, ({one} s) b"


@query(f"WITH {_SUB} {_near_sql('o_totalprice')} UNION ALL {_near_sql('o_custkey')} UNION ALL {_near_sql('o_orderkey')}")
def dist_numeric(spark, d):
    return subset.numeric_similarity(*_pair(spark, d), ["o_totalprice", "o_custkey", "o_orderkey"])


@query()
def dist_compare(spark, d):
    return subset.compare_distributions(*_pair(spark, d))


# ---- generated tables ----------------------------------------------------------------------------------------------------------------------------------


def _date_dim_sql(fiscal: int, extra: str = "") -> str:
    fm = f"(month(d) - {fiscal} + 12) % 12 + 1" if fiscal != 1 else "month(d)"
    fy = f"year(d) + CASE WHEN month(d) >= {fiscal} THEN 1 ELSE 0 END" if fiscal != 1 else "year(d)"
    i = lambda x: f"CAST({x} AS INTEGER)"
    return f"""WITH x AS (SELECT CAST(generate_series AS DATE) AS d FROM generate_series(DATE '2023-01-01', DATE '2024-12-31', INTERVAL 1 DAY))
SELECT {i("strftime(d, '%Y%m%d')")} AS date_key, d AS full_date, {i('year(d)')} AS year, {i('quarter(d)')} AS quarter, {i('month(d)')} AS month, monthname(d) AS month_name, substr(monthname(d), 1, 3) AS month_name_short, {i('week(d)')} AS week,
 {i('day(d)')} AS day_of_month, {i('isodow(d)')} AS day_of_week, dayname(d) AS day_name, substr(dayname(d), 1, 3) AS day_name_short, {i('dayofyear(d)')} AS day_of_year, isodow(d) >= 6 AS is_weekend, isodow(d) < 6 AS is_weekday,
 strftime(d, '%Y-%m') AS year_month, year(d) || '-Q' || quarter(d) AS year_quarter, {i(fy)} AS fiscal_year, {i(f'(({fm}) - 1) // 3 + 1')} AS fiscal_quarter, {i(fm)} AS fiscal_month{extra} FROM x"""


@query(_date_dim_sql(1))
def date_dimension(spark, d):
    return generate.date_dimension(spark, "2023-01-01", "2024-12-31")


_HOLIDAY = "CASE strftime(d, '%m-%d') WHEN '01-01' THEN 'New Year''s Day' WHEN '07-04' THEN 'Independence Day' WHEN '12-25' THEN 'Christmas Day' WHEN '12-31' THEN 'New Year''s Eve' END"


@query(_date_dim_sql(7, f", {_HOLIDAY} AS holiday_name, {_HOLIDAY} IS NOT NULL AS is_holiday"))
def date_dimension_fiscal(spark, d):
    return generate.date_dimension(spark, "2023-01-01", "2024-12-31", 7, True)


def _case(table: dict, key: str) -> str:
    return f"(CASE {key} {' '.join(f'WHEN {k} THEN {float(v)!r}::DOUBLE' for k, v in table.items())} ELSE 1.0::DOUBLE END)" if table else "1.0::DOUBLE"


def _series_sql(name: str, start: str, end: str, base: float) -> str:
    p = generate.time_pattern(name)
    n = f"CAST(date_diff('day', DATE '{start}', d) AS DOUBLE)"
    b = f"{base!r}::DOUBLE"
    trend = {"linear": f"({b} + {p.get('slope')!r}::DOUBLE * {n} * {b})", "exponential": f"({b} * exp({p.get('rate')!r}::DOUBLE * {n}))"}.get(p.get("trend"), b)
    week = {i + 1: w for i, w in enumerate((p.get("weekly_weights") or {}).values())}
    events = generate.event_table(p, int(start[:4]), int(end[:4]))
    ev = _case({f"DATE '{k}'": v for k, v in events.items()}, "d")
    noise = f"least(1.5::DOUBLE, greatest(0.5::DOUBLE, 1.0::DOUBLE + {float(p['noise_std'])!r}::DOUBLE * {rng.sql_normal(42, 'noise', 'd')}))"
    value = f"{trend} * {_case(p.get('monthly_weights') or {}, 'month(d)')} * {_case(p.get('quarterly_weights') or {}, 'quarter(d)')} * {_case(week, 'isodow(d)')} * {ev} * {noise}"
    return f"WITH x AS (SELECT CAST(generate_series AS DATE) AS d FROM generate_series(DATE '{start}', DATE '{end}', INTERVAL 1 DAY)) SELECT d AS date, round({value}, 4) AS value FROM x"


def _series(name):
    def plan(spark, d):
        return generate.time_series(spark, name, "2023-01-01", "2024-12-31", 1000.0).select("date", F.round("value", 4).alias("value"))

    plan.__name__ = f"time_series_{name}"
    query(_series_sql(name, "2023-01-01", "2024-12-31", 1000.0))(plan)


for _n in ("retail_seasonal", "financial_quarterly", "linear_growth", "exponential_growth"):
    _series(_n)


@query("SELECT * FROM (VALUES ('Prime Day', DATE '2024-07-15', 2.5::DOUBLE), ('Prime Day', DATE '2024-07-16', 2.5), ('Singles Day', DATE '2024-11-11', 2.0)) AS x(event, date, multiplier)")
def special_event_dates(spark, d):
    return generate.special_event_dates(spark, specs.TIME_PATTERNS["ecommerce_flash"], 2024, 2024)


@query("SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{n}', {dp}, {str(c in specs.MAJOR_CURRENCIES).lower()})" for c, n, _, dp, _, _, _ in specs.CURRENCIES) + ") AS x(currency_code, currency_name, decimal_places, is_major)")
def currency_dimension(spark, d):
    return generate.currency_dimension(spark).select("currency_code", "currency_name", "decimal_places", "is_major")


def _fx_sql(targets, first="2024-01-01"):
    rates = {c: (r, v) for c, _, _, _, _, r, v in specs.CURRENCIES}
    vals = ", ".join(f"('{c}', {rates[c][0]!r}::DOUBLE, {rates[c][1]!r}::DOUBLE)" for c in sorted(set(targets)))
    z = rng.sql_normal(42, "fx", "code || ':' || CAST(d AS VARCHAR)")
    return f"""x AS (SELECT CAST(generate_series AS DATE) AS d FROM generate_series(DATE '{first}', DATE '2024-03-31', INTERVAL 1 DAY) WHERE isodow(generate_series) < 6), c(code, r0, vol) AS (VALUES {vals}),
w AS (SELECT d, code, r0, CASE WHEN row_number() OVER (PARTITION BY code ORDER BY d) > 1 THEN vol * sqrt(1::DOUBLE / 252) * {z} ELSE 0.0 END AS step FROM x, c),
u AS (SELECT d, code, r0 * exp(sum(step) OVER (PARTITION BY code ORDER BY d ROWS UNBOUNDED PRECEDING)) AS r FROM w),
l AS (SELECT d AS date, code AS target, CASE WHEN r >= 100 THEN round(r, 2) WHEN r >= 1 THEN round(r, 4) ELSE round(r, 6) END AS rate FROM u)"""


@query(f"WITH {_fx_sql(['EUR', 'JPY', 'CAD'])} SELECT date, 'USD' AS base, target, rate FROM l")
def exchange_rates(spark, d):
    return generate.rates_long(spark, "USD", ["EUR", "JPY", "CAD"], "2024-01-01", "2024-03-31")


@query(f"WITH {_fx_sql(['EUR', 'JPY'])} SELECT a.date, a.target AS base, b.target, round(b.rate / a.rate, 6) AS rate FROM l a JOIN l b ON a.date = b.date")
def triangular_rates(spark, d):
    return generate.triangular_rates(generate.rates_long(spark, "USD", ["EUR", "JPY"], "2024-01-01", "2024-03-31"))


@query(f"""WITH {_fx_sql(['EUR', 'JPY'], '2023-12-25')}, k AS (SELECT range AS id FROM range(5000)),
tx AS (SELECT id + 1 AS transaction_id, CAST(DATE '2024-01-01' + CAST({rng.sql_bits(42, 'tx.date', 'id')} % 91 AS INTEGER) AS DATE) AS transaction_date, {rng.sql_weighted(rng.sql_uniform(42, 'tx.currency', 'id'), ['USD', 'EUR', 'JPY'], [1.0, 1.0, 1.0])} AS transaction_currency,
  round(exp(5::DOUBLE + 1::DOUBLE * {rng.sql_normal(42, 'tx.amount', 'id')}), 2) AS transaction_amount FROM k),
m AS (SELECT tx.*, CASE WHEN transaction_currency = 'USD' THEN 1.0::DOUBLE ELSE l.rate END AS exchange_rate, l.date AS rate_date FROM tx ASOF LEFT JOIN l ON tx.transaction_currency = l.target AND tx.transaction_date >= l.date)
SELECT transaction_id, transaction_date, transaction_currency, transaction_amount, exchange_rate, rate_date, 'USD' AS reporting_currency, round(transaction_amount / exchange_rate, 1) AS reporting_amount FROM m""")
def multicurrency_fact(spark, d):
    made = generate.multicurrency_fact(spark, 5000, ["USD", "EUR", "JPY"], "USD", "2024-01-01", "2024-03-31")
    return made.withColumn("reporting_amount", F.round(F.col("transaction_amount") / F.col("exchange_rate"), 1))


@query(f"""WITH k AS (SELECT range AS id FROM range(2000)), q AS (SELECT id, {rng.sql_bits(42, 'quantity', 'id')} % 120 + 1 AS quantity, round(5::DOUBLE + {rng.sql_uniform(42, 'unit_price', 'id')} * 495::DOUBLE, 2) AS unit_price FROM k),
t AS (SELECT *, CASE WHEN quantity < 10 THEN 0.0 WHEN quantity < 25 THEN 0.05 WHEN quantity < 50 THEN 0.10 WHEN quantity < 100 THEN 0.15 ELSE 0.20 END::DOUBLE AS discount_rate FROM q)
SELECT id, quantity, unit_price, discount_rate, CAST(round(CAST(CAST(quantity * unit_price * (1 - discount_rate) AS VARCHAR) AS DECIMAL(30,15)), 2) AS DOUBLE) AS total_amount FROM t""")
def correlated_tiered_formula(spark, d):
    base = [{"name": "quantity", "type": "integer", "min": 1, "max": 120}, {"name": "unit_price", "type": "uniform", "min": 5, "max": 500, "round_to": 2}]
    return generate.correlated_fact(spark, 2000, base, ["sales_quantity_discount", "sales_total_calculation"])


@query(f"""WITH m AS (SELECT avg(l_extendedprice) AS m, stddev_pop(l_extendedprice) AS s FROM lineitem),
x AS (SELECT l_orderkey, l_linenumber, l_orderkey * 10 + l_linenumber AS k, l_extendedprice, m, s FROM lineitem, m)
SELECT l_orderkey, l_linenumber, round(greatest(50::DOUBLE + 15::DOUBLE * (0.85::DOUBLE * (l_extendedprice - m) / s + sqrt(1 - 0.85::DOUBLE * 0.85::DOUBLE) * {rng.sql_normal(42, 'unit_cost', 'k')}), 5::DOUBLE), 1) AS unit_cost FROM x""")
def correlated_statistical(spark, d):
    li = t(spark, d, "lineitem").withColumn("k", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    rule = specs.CORRELATIONS["price_cost_correlation"] | {"source": ["l_extendedprice"], "round_to": 1}
    return generate.correlate(li, rule, "k").select("l_orderkey", "l_linenumber", "unit_cost")


@query("WITH k AS (SELECT range AS id FROM range(1000)), x AS (SELECT id, (['North', 'South', 'Abroad'])[CAST(id % 3 AS INTEGER) + 1] AS region FROM k) SELECT id, region, CASE region "
    + " ".join(f"WHEN '{r}' THEN {rng.sql_weighted(rng.sql_uniform(42, 'shipping_cost', 'id'), list(w), list(w.values()))}" for r, w in specs.CORRELATIONS["region_shipping_cost"]["distributions"].items())
    + f" ELSE {rng.sql_weighted(rng.sql_uniform(42, 'shipping_cost', 'id'), [6.99, 9.99], [0.5, 0.5])} END::DOUBLE AS shipping_cost FROM x")
def correlated_categorical(spark, d):
    return generate.correlated_fact(spark, 1000, [{"name": "region", "type": "list", "values": ["North", "South", "Abroad"]}], ["region_shipping_cost"])


@query("WITH k AS (SELECT range AS id FROM range(1000)) SELECT id, CASE WHEN id < 100 AND id % 2 = 0 THEN 'a' WHEN id >= 900 THEN 'b' ELSE 'c' END AS grp FROM k")
def correlated_conditional(spark, d):
    return generate.correlate(spark.range(1000), {"type": "conditional", "target": "grp", "conditions": [("id < 100 and id % 2 == 0", "a"), ("id >= 900", "b")], "default": "c"})


@query(f"""WITH s AS (SELECT avg(l_extendedprice) AS m1, stddev_pop(l_extendedprice) AS d1, avg(l_quantity) AS m2, stddev_pop(l_quantity) AS d2 FROM lineitem)
SELECT l_orderkey, l_linenumber, round(100::DOUBLE + 10::DOUBLE * (0.6::DOUBLE * ((l_extendedprice - m1) / d1) + 0.5::DOUBLE * ((l_quantity - m2) / d2) + {math.sqrt(1 - 0.61)!r}::DOUBLE * {rng.sql_normal(42, 'score', 'l_orderkey * 10 + l_linenumber')}), 5) AS score FROM lineitem, s""")
def correlated_copula(spark, d):
    rule = {"type": "copula", "source": ["l_extendedprice", "l_quantity"], "correlations": {"l_extendedprice": 0.6, "l_quantity": 0.5}, "target": "score", "mean": 100, "std": 10}
    li = t(spark, d, "lineitem").withColumn("k", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return generate.correlate(li, rule, "k").select("l_orderkey", "l_linenumber", F.round("score", 5).alias("score"))


@query(f"""WITH k AS (SELECT range AS id FROM range(500)) SELECT id + 1 AS customer_id, {rng.sql_pick(42, 'customer_name.name.f', 'id', anonymize.FIRST_NAMES)} || ' ' || {rng.sql_pick(42, 'customer_name.name.l', 'id', anonymize.LAST_NAMES)} AS customer_name,
 {rng.sql_pick(42, 'city.city', 'id', anonymize.CITIES)} AS city, {rng.sql_pick(42, 'segment.segment', 'id', specs.POOLS['segment'])} AS segment FROM k""")
def dimension_customer(spark, d):
    return generate.dimension(spark, "customer", 500).select("customer_id", "customer_name", "city", "segment")


@query(f"""WITH k AS (SELECT range AS id FROM range(3000)) SELECT id + 1 AS sales_id, {rng.sql_bits(42, 'customer_id', 'id')} % 500 + 1 AS customer_id,
 {rng.sql_weighted(rng.sql_uniform(42, 'order_status', 'id'), *specs.FACTS['sales']['attributes'][0][1:])} AS order_status FROM k""")
def fact_sales(spark, d):
    return generate.fact(spark, "sales", 3000, {"customer_id": 500}, ("2024-01-01", "2024-12-31")).select("sales_id", "customer_id", "order_status")


@query(f"""WITH k AS (SELECT range AS id FROM range(2000)), f AS (SELECT id + 1 AS sales_id, {rng.sql_bits(42, 'customer_id', 'id')} % 100 + 1 AS customer_id, {rng.sql_bits(42, 'product_id', 'id')} % 100 + 1 AS product_id, {rng.sql_bits(42, 'geography_id', 'id')} % 100 + 1 AS geography_id,
  CAST(strftime(DATE '2023-01-01' + CAST({rng.sql_bits(42, 'date_key', 'id')} % 731 AS INTEGER), '%Y%m%d') AS INTEGER) AS date_key, {rng.sql_weighted(rng.sql_uniform(42, 'order_status', 'id'), *specs.FACTS['sales']['attributes'][0][1:])} AS order_status FROM k),
c AS (SELECT range + 1 AS customer_id, {rng.sql_pick(42, 'city.city', 'range', anonymize.CITIES)} AS city FROM range(100)), p AS (SELECT range + 1 AS product_id, {rng.sql_pick(42, 'category.category', 'range', specs.POOLS['category'])} AS category FROM range(100))
SELECT sales_id, customer_id, product_id, geography_id, date_key, order_status, city, category FROM f JOIN c USING (customer_id) JOIN p USING (product_id)""")
def star_schema(spark, d):
    s = generate.star_schema(spark, "sales", 2000, 100)
    out = s["fact_sales"].join(s["dim_customer"], "customer_id").join(s["dim_product"].select("product_id", "category"), "product_id")
    return out.select("sales_id", "customer_id", "product_id", "geography_id", "date_key", "order_status", "city", "category")


def _measured(name: str, stream: str) -> str:
    kind, low, high = generate.by_name(name, generate.NAMED_MEASURES)
    v = f"{float(low)!r}::DOUBLE + {rng.sql_uniform(42, stream, 'id')} * {float(high - low)!r}::DOUBLE"
    return f"CAST(round({v}) AS BIGINT) AS {name}" if kind == "integer" else f"round({v}, 2) AS {name}"


@query(f"""WITH k AS (SELECT range AS id FROM range(5000)) SELECT id + 1 AS sales_id, {', '.join(f"{rng.sql_bits(42, f'sales.{c}', 'id')} % {n} + 1 AS {c}" for c, n in (('customer_id', 50), ('product_id', 10), ('store_id', 1)))},
CAST(strftime(DATE '2022-01-01' + CAST({rng.sql_bits(42, 'sales.date', 'id')} % 1461 AS INTEGER), '%Y%m%d') AS INTEGER) AS date_key, {', '.join(_measured(m, f'sales.{m}') for m in specs.INDUSTRIES['retail']['facts']['sales'][2])} FROM k""")
def industry_retail(spark, d):
    return generate.industry_schema(spark, "retail", 0.01)["fact_sales"]


_SAMPLES = ("uniform", "normal", "exponential", "pareto", "sequential", "cyclic", "weighted_choice")


@query(f"""WITH k AS (SELECT range AS id FROM range(1000)) SELECT id, round({rng.sql_uniform(42, 'u', 'id')} * 9 + 1, 6) AS u, round(5::DOUBLE + 2::DOUBLE * {rng.sql_normal(42, 'n', 'id')}, 5) AS n, round(-3::DOUBLE * ln(1 - {rng.sql_uniform(42, 'e', 'id')}), 6) AS e,
 round(pow(1 - {rng.sql_uniform(42, 'p', 'id')}, -1::DOUBLE / 3) * 2, 5) AS p, 10 + id * 5 AS s, (['a', 'b', 'c'])[CAST(id % 3 AS INTEGER) + 1] AS c, {rng.sql_weighted(rng.sql_uniform(42, 'w', 'id'), ['x', 'y'], [0.2, 0.8])} AS w FROM k""")
def sampler_closed(spark, d):
    k, s = F.col("id"), distributions.sample
    return spark.range(1000).select(
        "id",
        F.round(s("uniform", 42, "u", k, low=1, high=10), 6).alias("u"),
        F.round(s("normal", 42, "n", k, mean=5, std=2), 5).alias("n"),
        F.round(s("exponential", 42, "e", k, scale=3), 6).alias("e"),
        F.round(s("pareto", 42, "p", k, alpha=3, scale=2), 5).alias("p"),
        s("sequential", 42, "s", k, start=10, step=5).alias("s"),
        s("cyclic", 42, "c", k, values=["a", "b", "c"]).alias("c"),
        s("weighted_choice", 42, "w", k, values=["x", "y"], weights=[0.2, 0.8]).alias("w"),
    )


@query()
def sampler_discrete(spark, d):
    k, s = F.col("id"), distributions.sample
    return spark.range(1000).select("id", s("poisson", 42, "p", k, lam=3).alias("p"), s("binomial", 42, "b", k, n=10, p=0.3).alias("b"), s("beta", 42, "t", k, a=2, b=5).alias("t"), s("lognormal", 42, "l", k).alias("l"))


@query("SELECT l_orderkey, l_linenumber, CAST(l_quantity AS FLOAT)::DOUBLE AS l_quantity FROM lineitem")
def powerbi_optimize(spark, d):
    out, _ = profile.narrowed(t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"))
    return out.select(F.col("l_orderkey").cast("long").alias("l_orderkey"), F.col("l_linenumber").cast("int").alias("l_linenumber"), F.col("l_quantity").cast("double").alias("l_quantity"))


# ---- event windows (the same functions run on a stream) --------------------------------------------------------------------




@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,4))) AS DOUBLE) AS total, round(avg(value), 6) AS mean FROM events GROUP BY ALL")
def events_tumbling(spark, d):
    return stream.windowed(t(spark, d, "events")).withColumn("mean", F.round("mean", 6))


@query("""WITH x AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM x)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS n FROM s GROUP BY user_id, k""")
def events_sessions(spark, d):
    return stream.sessions(t(spark, d, "events"), gap="6 hours")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, count(*) AS \"rows\", count(*) FILTER (NOT coalesce(value >= 1 AND event_type IN ('view', 'click', 'purchase'), false)) AS violations FROM events GROUP BY ALL")
def events_violations(spark, d):
    return stream.violations(t(spark, d, "events"), [{"column": "value", "operator": ">=", "value": 1}, {"column": "event_type", "operator": "in", "value": ["view", "click", "purchase"]}])


from brindle.plans import catalogue_io  # noqa: E402, F401  (registers its queries here)
