"""Queries over whole tables: every row of the inputs takes part."""

import re
from collections import Counter

from brindle.operators import pii
from brindle.plans import catalogue

SMALL = "/root/testdata/sf0.001"


def column(spark, table, *names):
    return [tuple(r) for r in spark.read.parquet(f"{SMALL}/{table}.parquet").select(*names).collect()]


def test_joins_read_whole_tables(spark):
    suppliers = Counter(k for (k,) in column(spark, "supplier", "s_nationkey"))
    want = Counter({name: suppliers[k] for name, k in column(spark, "customer", "c_name", "c_nationkey") if suppliers[k]})
    assert Counter(r.name_file1 for r in catalogue.QUERIES["join_files_nway"](spark, SMALL).collect()) == want
    parts = column(spark, "part", "p_partkey", "p_retailprice")
    got = {(r.part, r.p_partkey) for r in catalogue.QUERIES["range_join"](spark, SMALL).collect()}
    assert got == {(a, b) for a, x in parts for b, y in parts if y <= x < y + 1} and {b for _, b in got} == {k for k, _ in parts}


def test_sort_returns_all_rows_in_order(spark):
    rows = [(k, None if k % 29 == 0 else s) for k, s in column(spark, "orders", "o_orderkey", "o_orderstatus")]
    want = sorted(rows, key=lambda r: (r[1] is not None, -ord(r[1] or "A"), r[0]))
    got = catalogue.QUERIES["sort_nulls_first"](spark, SMALL).collect()
    assert [(r.o_orderkey, r.o_orderstatus) for r in sorted(got, key=lambda r: r.place)] == want and [r.place for r in sorted(got, key=lambda r: r.place)] == list(range(len(rows)))


def test_match_rates_of_all_types(spark):
    texts = [x for (x,) in column(spark, "documents", "text") if x is not None]
    want = {c.name: round(sum(bool(re.search(c.pattern, x, re.I)) for x in texts) / len(texts), 6) for c in pii.CATALOGUE if c.pattern}
    got = {r.pii_type: r.match_rate for r in catalogue.QUERIES["pii_match_rates"](spark, SMALL).collect()}
    assert got == want and len(got) > 3
