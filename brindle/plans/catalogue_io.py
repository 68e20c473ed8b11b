"""More registered queries: files written and read again, SQL text, reports' and rules' tables, templates, and what tools return."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.functions import lineage, rng
from brindle.operators import generate, hierarchy, mapping, pii, profile, quality, relational, relationships, sql, subset
from brindle.plans.catalogue import ORDERS_NULLS, query, t
from brindle.sources import files, readers, reports, writers

# ---- files --------------------------------------------------------------------------------------------------------------

_ORDERS = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS o_orderdate, o_orderpriority FROM orders"


def _orders(spark, d):
    o = t(spark, d, "orders")
    return o.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.to_date("o_orderdate").cast("string").alias("o_orderdate"), "o_orderpriority")


@query(_ORDERS)
def csv_round_trip(spark, d):
    """Written with another delimiter and quotes, read with its schema."""
    o = _orders(spark, d)
    path = writers.write_csv(o, f"{lineage.scratch(spark, 'csv')}/orders.csv", quote_all=True)
    return readers.read_table(spark, path, o.schema)


@query(_ORDERS)
def csv_inferred(spark, d):
    """Types are inferred; dates stay text."""
    path = writers.write_csv(_orders(spark, d), f"{lineage.scratch(spark, 'csv')}/orders.csv")
    got = readers.read_table(spark, path)
    return got.select(*(F.col(c).cast("long") if c in ("o_orderkey", "o_custkey") else F.col(c) for c in got.columns))


@query(_ORDERS)
def parquet_round_trip(spark, d):
    return readers.read_table(spark, writers.write_parquet(_orders(spark, d), f"{lineage.scratch(spark, 'parquet')}/orders.parquet", "zstd", 1 << 20))


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey, CAST(n_nationkey * 0.5 AS DOUBLE) AS half FROM nation")
def xlsx_round_trip(spark, d):
    n = t(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("long").alias("n_regionkey"), (F.col("n_nationkey") * 0.5).cast("double").alias("half"))
    path = f"{lineage.scratch(spark, 'xlsx')}/nation.xlsx"
    readers.write_xlsx(n, path)
    kinds = dict(n.dtypes)
    return readers.read_table(spark, path).select(*(F.col(c).cast(kinds[c]).alias(c) for c in n.columns))


@query("SELECT 'nation' AS name, count(*) AS \"rows\" FROM nation UNION ALL SELECT 'region', count(*) FROM region UNION ALL SELECT 'supplier', count(*) FROM supplier")
def export_many(spark, d):
    held = {n: t(spark, d, n) for n in ("nation", "region", "supplier")}
    written = writers.write_many(held, lineage.scratch(spark, "many"))
    return relational.union_files([readers.read_table(spark, p).agg(F.lit(n).alias("name"), F.count("*").alias("rows")) for n, p in written.items()])


@query("SELECT 'nation.parquet' AS folder, 'parquet' AS kind, true AS readable, count(*) > 0 AS has_rows FROM nation UNION ALL SELECT 'region.csv', 'csv', true, count(*) > 0 FROM region")
def list_files(spark, d):
    top = lineage.scratch(spark, "listed")
    writers.write_parquet(t(spark, d, "nation").coalesce(1), f"{top}/nation.parquet")
    writers.write_csv(t(spark, d, "region").coalesce(1), f"{top}/region.csv")
    found = readers.list_files_frame(spark, top, "part-*", recursive=True)
    return found.select(F.regexp_extract("path", r"/([^/]+)/[^/]+$", 1).alias("folder"), F.regexp_extract("path", r"\.([a-z]+)$", 1).alias("kind"), "readable", (F.col("size_bytes") > 0).alias("has_rows"))


@query("SELECT 'n_nationkey|n_name|n_regionkey' AS line UNION ALL SELECT n_nationkey || '|' || n_name || '|' || n_regionkey FROM nation")
def csv_preview(spark, d):
    lines = writers.preview_csv(t(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), 100, "|")
    return spark.createDataFrame([(x,) for x in lines], "line string")


@query("SELECT unnest(['snappy', 'gzip', 'lz4', 'zstd', 'none']) AS codec, (SELECT count(*) FROM supplier) AS \"rows\"")
def compare_codecs(spark, d):
    top = lineage.scratch(spark, "codecs")
    found = writers.compare_codecs(t(spark, d, "supplier"), top)
    return relational.union_files([spark.read.parquet(f"{top}/codec-{c}.parquet").agg(F.lit(c).alias("codec"), F.count("*").alias("rows")) for c in found["codecs"]])


@query("SELECT s_suppkey, s_name, s_acctbal + 1 AS s_acctbal FROM supplier")
def replace_source(spark, d):
    """A table that is written over while it is read."""
    path = writers.write_parquet(t(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal"), f"{lineage.scratch(spark, 'over')}/supplier.parquet")
    writers.replace_source(readers.read_table(spark, path).withColumn("s_acctbal", F.col("s_acctbal") + 1), path)
    return readers.read_table(spark, path)


@query("SELECT 'nation' AS alias, 'dimension' AS role, count(*) AS \"rows\" FROM nation UNION ALL SELECT 'region', 'dimension', count(*) FROM region UNION ALL SELECT 'supplier', 'fact', count(*) FROM supplier")
def context_roles(spark, d):
    held = readers.Contexts(spark).load([{"path": f"{d}/{n}.parquet", "role": r} for n, r in (("nation", "dimension"), ("region", "dimension"), ("supplier", "fact"))])
    return spark.createDataFrame([(s["alias"], s["role"], s["rows"]) for s in held.summary()], "alias string, role string, rows long")


@query("SELECT count(*) AS \"rows\" FROM customer")
def head_limited(spark, d):
    """n_rows above the table's size reads it whole."""
    return readers.read_table(spark, f"{d}/customer.parquet", n_rows=2_000_000_000).agg(F.count("*").alias("rows"))


# ---- SQL text -----------------------------------------------------------------------------------------------------------


@query("SELECT n_regionkey, count(n_nationkey) AS n, max(n_name) AS n_name_max FROM nation WHERE n_nationkey > 2 GROUP BY n_regionkey")
def text_aggregate(spark, d):
    text = sql.build({"type": "aggregate", "table": "nation", "group_by": ["n_regionkey"], "aggregations": [{"function": "count", "column": "n_nationkey", "alias": "n"}, {"function": "max", "column": "n_name"}], "where": "n_nationkey > 2"})
    return sql.run_sql(spark, text, {"nation": t(spark, d, "nation")})


@query("SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def text_join(spark, d):
    text = sql.build({"type": "join", "left": "nation", "right": "region", "on": "n_regionkey = r_regionkey", "columns": ["n_name", "r_name"]})
    return sql.run_sql(spark, text, {n: t(spark, d, n) for n in ("nation", "region")})


@query("SELECT n_name AS name FROM nation WHERE n_regionkey = 1 UNION ALL SELECT n_name FROM nation WHERE n_nationkey < 20")
def text_union_all(spark, d):
    text = sql.build({"type": "union", "statements": [sql.select_text("nation", ["n_name AS name"], {"n_regionkey": 1}), sql.select_text("nation", ["n_name AS name"], "n_nationkey < 20")], "keep_all": True})
    return sql.run_sql(spark, text, {"nation": t(spark, d, "nation")})


@query("SELECT n_nationkey AS k, n_name AS v FROM nation UNION ALL SELECT r_regionkey, r_name FROM region")
def union_all(spark, d):
    return relational.union_files([t(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("v")), t(spark, d, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("v"))])


# ---- profiles, relationships, rules -----------------------------------------------------------------------------------------


@query("SELECT 'customer' AS \"table\", count(*) AS \"rows\", 'fact' AS role FROM customer UNION ALL SELECT 'nation', count(*), 'dimension' FROM nation UNION ALL SELECT 'orders', count(*), 'fact' FROM orders")
def star_suggestion(spark, d):
    found = relationships.suggest_star_schema({n: t(spark, d, n) for n in ("nation", "orders", "customer")})
    return spark.createDataFrame([(r["table"], r["rows"], r["role"]) for r in found], "table string, rows long, role string")


@query("SELECT 'a' AS from_table, 'nation_key' AS from_column, 'b' AS to_table, 'nation_key' AS to_column, CASE WHEN (SELECT count(DISTINCT c_nationkey) = count(*) FROM customer) THEN '1' ELSE 'N' END || ':1' AS cardinality")
def key_relationships(spark, d):
    a, b = t(spark, d, "customer").select(F.col("c_nationkey").alias("nation_key")), t(spark, d, "nation").select(F.col("n_nationkey").alias("nation_key"))
    return spark.createDataFrame(relationships.key_relationships({"a": a, "b": b}), "from_table string, from_column string, to_table string, to_column string, cardinality string")


@query("SELECT s_suppkey, round(s_acctbal / 100, 2) AS score, CASE WHEN s_acctbal / 100 >= 97 THEN 'A+' WHEN s_acctbal / 100 >= 93 THEN 'A' WHEN s_acctbal / 100 >= 90 THEN 'A-' WHEN s_acctbal / 100 >= 87 THEN 'B+' WHEN s_acctbal / 100 >= 83 THEN 'B' WHEN s_acctbal / 100 >= 80 THEN 'B-' WHEN s_acctbal / 100 >= 77 THEN 'C+' WHEN s_acctbal / 100 >= 73 THEN 'C' WHEN s_acctbal / 100 >= 70 THEN 'C-' WHEN s_acctbal / 100 >= 67 THEN 'D+' WHEN s_acctbal / 100 >= 63 THEN 'D' WHEN s_acctbal / 100 >= 60 THEN 'D-' ELSE 'F' END AS grade FROM supplier")
def letter_grades(spark, d):
    score, out = F.col("s_acctbal") / 100, F.lit("F")
    for name, low in reversed(quality.GRADES[:-1] if quality.GRADES[-1][0] == "F" else quality.GRADES):
        out = F.when(score >= low, name).otherwise(out)
    return t(spark, d, "supplier").select("s_suppkey", F.round(score, 2).alias("score"), out.alias("grade"))


@query(f"""WITH {ORDERS_NULLS}, n AS (SELECT count(*) AS n, count(o_totalprice) AS p, count(*) FILTER (o_totalprice BETWEEN 1000 AND 300000) AS v FROM orders_nulls)
SELECT 'o_totalprice' AS "column", n - p AS nulls, p - v AS outside FROM n""")
def rules_from_yaml(spark, d):
    """Rules by chained calls, written as YAML, read again and applied."""
    path = f"{lineage.scratch(spark, 'rules')}/rules.yaml"
    built = quality.RuleBuilder().require_not_null("o_totalprice").require_range("o_totalprice", 1000, 300000).rules
    files.write_text(spark, path, built.to_yaml())
    p = quality.Rules.from_yaml(files.read_text(spark, path)).columns["o_totalprice"]
    c = F.col("o_totalprice")
    low, high = (next(v for k, v in p.items() if k.startswith(x) and not isinstance(v, bool) and "null" not in k) for x in ("min", "max"))
    from brindle.plans.catalogue import orders_nulls

    return orders_nulls(spark, d).agg(F.count_if(c.isNull()).alias("nulls"), F.count_if((c < low) | (c > high)).alias("outside")).select(F.lit("o_totalprice").alias("column"), "nulls", "outside")


@query("SELECT 'Suppliers' AS title, count(*) AS \"rows\", 2 AS sections FROM supplier")
def report_round_trip(spark, d):
    """A JSON report, written and read again."""
    s = t(spark, d, "supplier")
    text = reports.render("Suppliers", {"rows": s.count()}, {"columns": profile.profile(s.select("s_suppkey", "s_acctbal")).collect(), "regions": t(spark, d, "region").collect()}, "json")
    path = files.write_text(spark, f"{lineage.scratch(spark, 'report')}/report.json", text)
    made = spark.read.option("multiLine", True).schema("title string, summary struct<rows: long>, columns array<string>, regions array<string>").json(path)
    return made.select("title", "summary.rows", ((F.size("columns") > 0).cast("int") + (F.size("regions") > 0).cast("int")).alias("sections"))


@query("SELECT n_nationkey, CASE n_name WHEN 'FRANCE' THEN 'FR' WHEN 'GERMANY' THEN 'DE' ELSE 'other' END AS code FROM nation")
def mapping_apply(spark, d):
    """A mapping that is defined, kept, loaded again and applied."""
    path = f"{lineage.scratch(spark, 'mappings')}/mappings.json"
    mapping.Mappings(path, spark).define("codes", {"FRANCE": "FR", "GERMANY": "DE"})
    return mapping.Mappings(path, spark).apply(t(spark, d, "nation").select("n_nationkey", "n_name"), "codes", "n_name", "code", "other").drop("n_name")


@query("SELECT source_column, target_column FROM (VALUES ('c_nationkey', 'n_nationkey')) AS x(source_column, target_column) WHERE (SELECT count(*) FROM customer) > 0")
def join_paths(spark, d):
    found = mapping.discover({"customer": t(spark, d, "customer").select("c_nationkey"), "nation": t(spark, d, "nation").select("n_nationkey")}, source="customer")
    return mapping.suggest_join_paths(found).select("source_column", "target_column")


@query("SELECT 'parent_child' AS hierarchy_type, 'parent_key' AS parent, 'child_key' AS child")
def hierarchy_detect(spark, d):
    found = hierarchy.detect_columns(t(spark, d, "nation").select(F.col("n_regionkey").alias("parent_key"), F.col("n_nationkey").alias("child_key")))
    return spark.createDataFrame([(found["hierarchy_type"], found["parent"], found["child"])], "hierarchy_type string, parent string, child string")


@query("SELECT * FROM (VALUES ('email_address', 'email'), ('ssn', 'ssn')) AS x(\"column\", pii_type)")
def pii_names(spark, d):
    found = pii.quick_scan(["email_address", "ssn", "o_total"])
    rows = [(c, max(s, key=s.get)) for c, s in found.items()]  # of equals, the first of the catalogue
    return spark.createDataFrame(rows, "column string, pii_type string")


# ---- subsets and generated tables -----------------------------------------------------------------------------------------------


@query("""WITH f AS (SELECT o_orderkey, o_custkey FROM orders ORDER BY md5('42:' || o_orderkey), o_orderkey LIMIT 300)
SELECT 'orders' AS name, count(*) AS "rows" FROM f UNION ALL SELECT 'customer', count(DISTINCT o_custkey) FROM f""")
def subset_star(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    out = subset.star_subset(o, {"customer": (t(spark, d, "customer").select("c_custkey"), "c_custkey")}, 300, "o_orderkey")
    main = next(k for k in out if k != "customer")
    return relational.union_files([df.agg(F.lit("customer" if n == "customer" else "orders").alias("name"), F.count("*").alias("rows")) for n, df in ((main, out[main]), ("customer", out["customer"]))])


@query("SELECT CAST(greatest(1, floor(count(*) * 0.1)) AS BIGINT) AS size FROM orders")
def subset_size(spark, d):
    n = t(spark, d, "orders").count()
    return spark.createDataFrame([(subset.target_size(n, percent=10),)], "size long")


@query(f"""WITH k AS (SELECT s_suppkey AS k, CAST(CASE WHEN s_acctbal > 0 THEN s_acctbal END AS DECIMAL(28,9)) AS w FROM supplier),
b AS (SELECT k, w FROM k WHERE w > 0), n AS (SELECT count(*) AS n FROM orders)
SELECT (SELECT n FROM n) AS drawn, 0 AS without_key, count(*) > 0 AS keys_known FROM b""")
def weighted_keys(spark, d):
    """Keys drawn by weight: every row has one, and only of positive weight (shares are held against weights in the tests)."""
    made = generate.weighted_keys(t(spark, d, "orders").select("o_orderkey"), t(spark, d, "supplier"), "s_suppkey", "s_acctbal", "supplier_key", "o_orderkey")
    good = t(spark, d, "supplier").filter("s_acctbal > 0").select(F.col("s_suppkey").alias("supplier_key"), F.lit(True).alias("good"))
    joined = made.join(good, "supplier_key", "left")
    return joined.agg(F.count("*").alias("drawn"), F.count_if(F.col("supplier_key").isNull()).cast("int").alias("without_key"), F.every(F.coalesce("good", F.lit(False))).alias("keys_known"))


_TEMPLATE = """
columns:
  - {name: row_id, generator: sequence, config: {start: 10}}
  - {name: code, generator: pattern, config: {pattern: "A-{n:3}"}}
  - {name: kind, generator: choice, config: {choices: [x, y], weights: [0.25, 0.75]}}
  - {name: size, generator: dependent_value, config: {depends_on: kind, mappings: {x: 1, y: 2}, default: 0}}
  - {name: twice, generator: formula, config: {formula: "size * 2"}}
validations:
  - {rule: "twice >= 2", message: twice is set}
"""


@query(f"""WITH k AS (SELECT range AS k FROM range(1500)), c AS (SELECT k, {rng.sql_weighted(rng.sql_uniform(42, 'kind', 'k'), ['x', 'y'], [0.25, 0.75])} AS kind FROM k)
SELECT k + 10 AS row_id, 'A-' || repeat('0', greatest(0, 3 - length(CAST(k + 1 AS VARCHAR)))) || (k + 1) AS code, kind, CASE kind WHEN 'x' THEN 1 ELSE 2 END AS size, CASE kind WHEN 'x' THEN 2 ELSE 4 END::DOUBLE AS twice FROM c""")
def from_template(spark, d):
    out = generate.from_template(spark, _TEMPLATE, 1500)
    return out.withColumns({"size": F.col("size").cast("int"), "twice": F.col("twice").cast("double")})


@query("SELECT transaction_currency, \"count\" FROM (VALUES ('EUR', 0), ('USD', 0)) AS x(transaction_currency, \"count\") WHERE \"count\" > 0 UNION ALL SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'EUR' ELSE 'USD' END, count(*) FROM orders GROUP BY ALL")
def currency_breakdown(spark, d):
    o = t(spark, d, "orders").select(F.when(F.col("o_orderkey") % 3 == 0, "EUR").otherwise("USD").alias("transaction_currency"), F.col("o_totalprice").alias("transaction_amount"), F.col("o_totalprice").alias("reporting_amount"))
    return generate.currency_breakdown(o).select("transaction_currency", "count")
