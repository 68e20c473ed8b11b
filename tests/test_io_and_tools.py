"""Files in and out, the tools' envelopes, and streams."""

import json
import os

import pytest
from pyspark.sql import functions as F

from brindle.plans.tools import TOOLS, Engine
from brindle.sources import readers, reports, writers
from brindle.streaming import events

SMALL = "/root/testdata/sf0.001"


def test_csv_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b", "2024-01-02"), (2, None, "2024-01-03")], "k int, v string, d string")
    path = writers.write_csv(df, f"{tmp_path}/x.csv", single_file=True)
    back = readers.read_table(spark, path)
    assert os.path.isfile(path) and dict(back.dtypes) == {"k": "int", "v": "string", "d": "string"} and sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    assert dict(readers.read_table(spark, path, parse_dates=True).dtypes)["d"] == "date"
    writers.replace_source(back.filter("k = 1"), path)
    assert readers.read_table(spark, path).count() == 1
    assert writers.preview_csv(df, 1) == ["k,v,d", "1,a,b,2024-01-02"]


def test_xlsx_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, "a & b", 1.5, True), (2, None, None, False)], "k int, v string, x double, b boolean")
    writers_path = f"{tmp_path}/x.xlsx"
    readers.write_xlsx(df.withColumn("b", F.col("b").cast("string")), writers_path)
    back = readers.read_table(spark, writers_path)
    assert dict(back.dtypes) == {"k": "bigint", "v": "string", "x": "double", "b": "boolean"}
    assert sorted(map(tuple, back.collect())) == [(1, "a & b", 1.5, True), (2, None, None, False)]


def test_parquet_and_listing(spark, tmp_path):
    df = spark.range(100)
    writers.write_parquet(df, f"{tmp_path}/a.parquet", "zstd", single_file=True)
    assert readers.parquet_metadata(f"{tmp_path}/a.parquet")["num_rows"] == 100
    assert [f["name"] for f in readers.list_files(str(tmp_path), "*.parquet")] == ["a.parquet"]
    assert readers.list_files_frame(spark, str(tmp_path), "*.parquet").first().readable
    assert writers.compare_codecs(df, f"{tmp_path}/codecs", ("snappy", "zstd"))["recommended"] in ("snappy", "zstd")
    with pytest.raises(ValueError):
        readers.read_table(spark, "x.json")


def test_scans_prune(spark):
    df = readers.read_table(spark, f"{SMALL}/lineitem.parquet").filter("l_quantity > 45").select("l_orderkey")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity" in plan and "l_comment" not in plan and "ReadSchema: struct<l_orderkey:bigint,l_quantity" in plan


def test_tools(spark, tmp_path):
    e = Engine(spark)
    o, c, n = (f"{SMALL}/{x}.parquet" for x in ("orders", "customer", "nation"))
    assert len(TOOLS) == 51
    assert not e.run("no such tool")["success"] and "missing" in e.run("03_query_data")["error"] and not e.run("01_analyze_file", file_path="/no/file.parquet")["success"]
    out = f"{tmp_path}/out"
    os.makedirs(out)
    h = f"{out}/h.csv"
    writers.write_csv(spark.createDataFrame([("T", "A"), ("A", "x")], "parent string, child string"), h, single_file=True)
    a = f"{out}/a.csv"
    writers.write_csv(spark.createDataFrame([("x", 2.5)], "key string, amount double"), a, single_file=True)
    t = f"{out}/t.yaml"
    open(t, "w").write("columns:\n  - {name: k, generator: sequence}\n")
    calls = {
        "01_list_files": {"directory": SMALL},
        "01_read_file_preview": {"file_path": o},
        "01_analyze_file": {"file_path": c},
        "01_detect_domain": {"file_path": o},
        "01_find_relationships": {"file_paths": [c, n]},
        "01_profile_column": {"file_path": o, "column": "o_orderpriority"},
        "01_suggest_schema": {"file_path": o},
        "02_generate_dimension": {"dimension_type": "customer", "row_count": 10, "output_path": f"{out}/dim.parquet"},
        "02_generate_fact": {"fact_type": "sales", "row_count": 10, "dimensions": {"customer_id": 5}, "date_range": ["2024-01-01", "2024-02-01"]},
        "02_generate_date_dimension": {"start_date": "2024-01-01", "end_date": "2024-01-10"},
        "02_generate_from_template": {"template_path": t, "row_count": 5},
        "02_generate_star_schema": {"domain": "hr", "fact_rows": 10, "dimension_rows": 5, "output_dir": f"{out}/star"},
        "02_generate_time_series": {"pattern": "retail_seasonal", "start_date": "2024-01-01", "end_date": "2024-01-10"},
        "02_list_time_patterns": {},
        "02_generate_correlated_fact": {"row_count": 10, "base_columns": [{"name": "quantity", "type": "integer", "max": 9}], "correlations": ["sales_quantity_discount"]},
        "02_list_correlation_patterns": {},
        "02_generate_currency_dimension": {"majors_only": True},
        "02_generate_exchange_rates": {"base_currency": "USD", "target_currencies": ["EUR"], "start_date": "2024-01-01", "end_date": "2024-01-10"},
        "02_generate_multicurrency_fact": {"row_count": 20, "currencies": ["USD", "EUR"], "reporting_currency": "USD", "start_date": "2024-01-01", "end_date": "2024-01-10"},
        "02_generate_industry_schema": {"industry": "retail", "scale_factor": 0.0001},
        "02_list_industry_templates": {},
        "03_query_data": {"file_path": o, "query": "SELECT count(*) AS n FROM data"},
        "03_update_data": {"file_path": n, "set_values": {"n_name": "X"}, "where_conditions": {"n_nationkey": 3}, "output_path": f"{out}/n.parquet"},
        "03_delete_data": {"file_path": n, "where_conditions": {"n_nationkey": 3}, "confirm": True, "output_path": f"{out}/n2.parquet"},
        "03_transform_data": {"file_path": n, "transformations": [{"type": "limit", "n": 2}]},
        "03_merge_files": {"file_paths": [n, n]},
        "04_validate_data": {"file_path": o, "rules": [{"name": "k", "type": "not_null", "columns": ["o_orderkey"]}]},
        "04_check_referential_integrity": {"fact_path": o, "dimension_paths": {"c": c}, "keys": {"o_custkey": "c"}},
        "04_validate_balance": {"file_path": f"{SMALL}/lineitem.parquet", "debit_column": "l_extendedprice", "credit_column": "l_extendedprice"},
        "04_detect_anomalies": {"file_path": o, "columns": ["o_totalprice"]},
        "04_score_data_quality": {"file_path": o},
        "04_compare_quality": {"before_path": o, "after_path": o},
        "04_generate_quality_report": {"file_path": o, "output_path": f"{out}/q.html", "format": "html"},
        "05_export_csv": {"file_path": n, "output_path": f"{out}/n.csv"},
        "05_export_parquet": {"file_path": n, "output_path": f"{out}/n3.parquet"},
        "05_optimize_for_powerbi": {"file_path": o},
        "07_list_tools": {},
        "07_get_tool_help": {"tool_name": "03_query_data"},
        "07_get_domain_prompt": {"domain": "sales"},
        "08_discover_mappings": {"file_paths": [c, n]},
        "08_define_mapping": {"name": "m", "values": {"a": "b"}, "store_path": f"{out}/m.json"},
        "08_validate_amounts": {"source_path": o, "amount_column": "o_totalprice", "group_column": "o_orderstatus", "rule": {"type": "sum_equals", "left": ["O"], "right": ["F"]}},
        "08_load_context": {"files": [{"path": o, "alias": "ord"}, {"path": c}]},
        "08_query_context": {"query": "SELECT count(*) AS n FROM ord JOIN customer ON o_custkey = c_custkey"},
        "08_analyze_hierarchy": {"file_path": h},
        "08_rollup_through_hierarchy": {"hierarchy_path": h, "amounts_path": a, "key_column": "key", "amount_column": "amount", "element": "T"},
        "09_detect_pii": {"file_path": c},
        "09_anonymize_file": {"file_path": c, "output_path": f"{out}/anon.parquet", "strategies": {"c_name": "hash"}},
        "09_generate_anonymization_report": {"file_path": c, "output_path": f"{out}/p.json", "format": "json"},
        "10_create_subset": {"file_path": o, "strategy": "stratified", "key_column": "o_orderkey", "target_size": 20, "stratify_columns": ["o_orderstatus"], "output_path": f"{out}/s.parquet"},
        "10_analyze_subset": {"source_path": o, "subset_path": f"{out}/s.parquet"},
    }
    assert set(calls) == set(TOOLS)
    bad = {}
    for name in sorted(calls, key=lambda n: n == "10_analyze_subset"):
        got = e.run(name, **calls[name])
        json.dumps(got)
        if not got["success"]:
            bad[name] = got
    assert not bad
    assert e.run("08_query_context", query="SELECT count(*) AS n FROM ord")["rows"][0]["n"] == spark.read.parquet(o).count()
    assert "breakdown" in e.run("08_rollup_through_hierarchy", **calls["08_rollup_through_hierarchy"])
    assert not e.run("03_delete_data", file_path=n, where_conditions={})["success"]


def test_reports():
    text = [reports.render("T", {"a": 1}, {"S": [{"x": "<|>", "y": None}], "E": []}, k) for k in reports.FORMATS]
    assert "\\|" in text[0] and "&lt;|&gt;" in text[1] and json.loads(text[2])["S"][0]["x"] == "<|>"
    with pytest.raises(ValueError):
        reports.render("T", {}, {}, "pdf")


def test_streams_agree_with_tables(spark, tmp_path):
    table = spark.read.parquet(f"{SMALL}/events.parquet")
    table.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(f"{tmp_path}/in")
    live = events.read_stream(spark, f"{tmp_path}/in", table.schema, 1)
    for name, make in {"w": events.windowed, "s": events.sessions}.items():
        q = events.write_stream(make(live, delay="40 days"), f"{tmp_path}/{name}", f"{tmp_path}/{name}-c")
        q.awaitTermination(120)
        got = {tuple(r) for r in spark.read.parquet(f"{tmp_path}/{name}").collect()}
        assert got <= {tuple(r) for r in make(table).collect()}
    q = events.write_stream(events.deduplicated(live.union(live), delay="40 days"), f"{tmp_path}/d", f"{tmp_path}/d-c")
    q.awaitTermination(120)
    assert spark.read.parquet(f"{tmp_path}/d").count() == table.count()
