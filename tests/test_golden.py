"""Small tables by hand: nulls, ties, cycles, empty tables, and the documented balance cases."""

import pytest
from pyspark.sql import functions as F

from brindle.functions.similarity import indel_ratio, name_similarity
from brindle.operators import anonymize, filters, generate, hierarchy, mapping, pii, pipeline, profile, quality, relational, relationships, sql, subset, validate

BALANCED = [("2024-01", "1000", 100.0, 0.0), ("2024-01", "2000", 0.0, 100.0), ("2024-02", "1000", 200.0, 0.0), ("2024-02", "2000", 0.0, 200.0)]


def ledger(spark, rows):
    return spark.createDataFrame(rows, "period string, account string, debit double, credit double")


def test_balance(spark):
    one = validate.balance_summary(ledger(spark, BALANCED), "debit", "credit", ["period"]).first()
    assert one.balanced and one.imbalanced_groups == 0
    bad = validate.balance_summary(ledger(spark, [BALANCED[0], ("2024-01", "2000", 0.0, 90.0)]), "debit", "credit", ["period"]).first()
    assert not bad.balanced and bad.imbalanced_groups == 1
    near = ledger(spark, [("p", "a", 100.0, 99.995)])
    assert validate.check_balance(near, "debit", "credit", digits=4).first().balanced
    assert validate.balance_summary(ledger(spark, BALANCED).limit(0), "debit", "credit").first().balanced


def test_rules_on_empty_and_null(spark):
    df = spark.createDataFrame([(1, None), (1, "x"), (None, None)], "a int, b string")
    rules = [
        {"name": "n", "type": "not_null", "columns": ["a", "b"]},
        {"name": "u", "type": "unique", "columns": ["a"]},
        {"name": "e", "type": "enum", "columns": ["b"], "config": {"values": ["x"]}},
        {"name": "r", "type": "range", "columns": ["a"], "config": {"min": 5}},
        {"name": "?", "type": "no such rule", "columns": ["a"]},
    ]
    got = {(r.rule_name, r.column): (r.violations, r.passed) for r in validate.check_rules(df, rules).collect()}
    assert got == {("n", "a"): (1, False), ("n", "b"): (2, False), ("u", "a"): (1, False), ("e", "b"): (1, False), ("r", "a"): (2, False), ("?", "a"): (-1, False)}
    assert all(r.violations <= 0 for r in validate.check_rules(df.limit(0), rules).collect())


def test_filters_and_text(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    assert filters.filter_rows(df, [{"column": "v", "operator": "is_null"}]).first().k == 2
    with pytest.raises(ValueError, match="unknown operator"):
        filters.condition("v", "like", "x")
    assert df.filter(filters.equals({"v": None})).count() == 1 and df.filter(filters.equals({})).count() == 2
    assert sql.select_text("t", ["a"], {"b": "O'x", "c": None}, limit=3) == "SELECT a FROM t WHERE b = 'O''x' AND c IS NULL LIMIT 3"
    assert sql.build({"type": "union", "statements": ["A", "B"], "keep_all": True}) == "A UNION ALL B"
    assert sql.build({"type": "update", "table": "t", "values": {"a": 1}, "where": {"b": True}}) == "UPDATE t SET a = 1 WHERE b = TRUE"
    assert "JOIN u ON" in sql.join_text("t", "u", "t.a = u.a", "left") and sql.insert_text("t", {"a": None}) == "INSERT INTO t (a) VALUES (NULL)"
    assert sql.delete_text("t", "a > 1") == "DELETE FROM t WHERE a > 1" and "SUM(x) AS x_sum" in sql.aggregate_text("t", ["g"], [{"function": "sum", "column": "x"}])
    assert sql.case_text([{"when": "a", "then": 1}], 2, "c") == "CASE WHEN a THEN 1 ELSE 2 END AS c"


def test_sql_names_do_not_meet(spark):
    a, b = spark.range(3).toDF("credit_limit"), spark.range(9).toDF("credit_limit")
    one, two = sql.query(spark, a, "SELECT credit_limit FROM data"), sql.query(spark, b, "WITH x AS (SELECT * FROM data) SELECT count(*) AS n FROM x")
    assert one.count() == 3 and two.first().n == 9 and sql.query(spark, b, "SELECT credit_limit FROM data", 2).count() == 2


def test_delete_keeps_unknown(spark):
    df = spark.createDataFrame([(1,), (None,), (3,)], "a int")
    assert {r.a for r in sql.delete(df, "a > 2").collect()} == {1, None}
    assert {r.a for r in sql.delete(df, "a > 2", strict_sql=True).collect()} == {1}


def test_pipeline_steps(spark):
    df = spark.createDataFrame([(1, None), (2, "y"), (2, "y")], "a int, b string")
    out, log = pipeline.transform(df, [{"op": "fill_nulls", "column": "b", "value": "-"}, "not json", {"type": "unique"}, {"type": "add_literal", "name": "c", "value": "a + 1"}, {"type": "add_column", "name": "d", "expression": "a + 1"}, {"type": "drop_columns", "columns": "a"}])
    assert sorted(map(tuple, out.collect())) == [("-", "a + 1", 2), ("y", "a + 1", 3)] and [x["applied"] for x in log] == [True, False, True, True, True, True]
    with pytest.raises(ValueError):
        pipeline.transform(df, [{"type": "drop_columns", "columns": ["zz"]}])


def test_union_needs_names(spark):
    with pytest.raises(ValueError):
        relational.union_files([spark.range(1), spark.range(1).toDF("x")])


def test_nearest_rank_spreads(spark):
    import random

    v = [random.Random(1).gauss(0, 10) ** 3 for _ in range(777)] + [5.0] * 300
    df = spark.createDataFrame([(x,) for x in v] + [(None,)], "v double")
    got = {r.q: r.value for r in validate.nearest_rank(df.selectExpr("'c' AS column", "v"), (0.0, 0.25, 0.5, 0.75, 1.0)).collect()}
    v.sort()
    assert got == {q: v[int((len(v) - 1) * q + 0.5)] for q in (0.0, 0.25, 0.5, 0.75, 1.0)}


def test_fill_and_empty(spark):
    df = spark.createDataFrame([(i, None if i % 3 else float(i)) for i in range(40)], "k int, v double")
    got = {r.k: r.v for r in relational.fill_nulls(df, "v", "forward", order_by="k").collect()}
    assert all(got[k] == k - k % 3 for k in got)
    assert relational.fill_nulls(df.limit(0), "v", "backward", order_by="k").count() == 0
    assert profile.profile(df.limit(0)).count() == 2 and profile.profile(df.limit(1)).filter("column = 'v'").first().std is None


def test_edges(spark):
    contains = spark.createDataFrame([("T", "A"), ("T", "B"), ("A", "x"), ("A", "y"), ("B", "y"), ("x", "x"), ("y", "y"), ("B", "B")], "p string, c string")
    amounts = spark.createDataFrame([("x", 10.0), ("y", 5.0), ("B", 1.0)], "k string, v double")
    got = {r.element: r.total_amount for r in hierarchy.rollup(contains, "p", "c", amounts, "k", "v").collect()}
    assert got["A"] == 15 and got["T"] == 20 and got["x"] == 10  # y counts on both its paths; B holds children, so its own amount doesn't
    assert hierarchy.analyze(contains, "p", "c").first().hierarchy_pattern == "contains_children"
    up = spark.createDataFrame([(None, "T"), ("T", "A"), ("A", "x")], "p string, c string")
    one = hierarchy.analyze(up, "p", "c").first()
    assert (one.root_count, one.leaf_count, one.max_depth) == (1, 1, 2)
    assert [r.element for r in hierarchy.path_to_root(up, "p", "c", "x").orderBy("level").collect()] == ["x", "A", "T"]
    cycle = spark.createDataFrame([("T", "A"), ("A", "T"), ("A", "x")], "p string, c string")
    assert {r.element for r in hierarchy.descendants(cycle, "p", "c", "T").collect()} == {"A", "x"}
    assert hierarchy.detect_columns(spark.createDataFrame([("a", "b"), ("b", "c")], "Formula_Header string, Formula_Element string"))["parent"] == "Formula_Header"
    tree = hierarchy.breakdown(hierarchy.rollup(up, "p", "c", amounts, "k", "v"), up, "p", "c", "T")
    assert tree["total_amount"] == 10 and tree["children"][0]["children"][0]["element"] == "x"


def test_personal_data(spark):
    cases = [("123-45-6789", True, None), ("000-12-3456", False, None), ("4532015112830366", None, True), ("4532015112830367", None, False), (None, None, None), ("", False, False)]
    df = spark.createDataFrame([(c[0],) for c in cases], "v string").select("v", pii.valid_ssn(F.col("v")).alias("s"), pii.valid_card(F.col("v")).alias("c"))
    got = {r.v: (r.s, r.c) for r in df.collect()}
    assert got["123-45-6789"][0] and not got["000-12-3456"][0] and got["4532015112830366"][1] and not got["4532015112830367"][1] and got[None] == (None, None)
    iban = spark.createDataFrame([("GB82 WEST 1234 5698 7654 32",), ("GB82WEST12345698765433",)], "v string").select(pii.valid_iban(F.col("v")).alias("ok"))
    assert [r.ok for r in iban.collect()] == [True, False]
    people = spark.createDataFrame([("a@b.org", "x"), ("c@d.net", "y")], "email string, note string")
    found = pii.detect_pii(people)
    assert pii.best_types(found)["email"] == "email" and pii.risk(found)["risk_score"] >= 25
    assert pii.name_confidence("id").get("username") == 0.7 and pii.name_confidence("email")["email"] == 0.9


def test_anonymise(spark):
    df = spark.createDataFrame([(i, f"n{i % 3}" if i % 4 else None, "1@2@3", float(i)) for i in range(20)], "k int, name string, mail string, pay double")
    plan = {"name": {"strategy": "tokenize"}, "mail": {"strategy": "mask", "pii_type": "email"}, "pay": {"strategy": "noise", "percent": 5}}
    out, lookups = anonymize.anonymize(df, plan, "k")
    rows = {r.k: r for r in out.collect()}
    assert all((rows[i].name is None) == (i % 4 == 0) and abs(rows[i].pay - i) <= 0.05 * i for i in range(20)) and rows[0].mail == "1***3"
    back = {r.k: r.name for r in anonymize.detokenize(out, "name", lookups["name"]).collect()}
    assert back == {i: (f"n{i % 3}" if i % 4 else None) for i in range(20)}
    mixed = anonymize.shuffled(df, "name", "k", 1)
    count = lambda d: sorted(r.name or "" for r in d.collect())
    assert count(mixed) == count(df) and all((r.name is None) == (r.k % 4 == 0) for r in mixed.collect())
    twice = [sorted(map(str, anonymize.anonymize(df, {"name": {"strategy": "synthetic", "pii_type": "full_name"}}, "k")[0].repartition(n).collect())) for n in (1, 7)]
    assert twice[0] == twice[1]
    ages = spark.createDataFrame([("0",), ("9",), ("10",), ("x",), (None,)], "a string").select(anonymize.generalize(F.col("a"), "age").alias("a"))
    assert [r.a for r in ages.collect()] == ["0-9", "0-9", "10-19", "x", None]


def test_token_store(spark, tmp_path):
    store = anonymize.TokenStore(spark, f"file://{tmp_path}/tokens")
    one = spark.createDataFrame([("b",), ("a",), (None,)], "v string")
    two = spark.createDataFrame([("c",), ("a",)], "v string")
    first = [r.v for r in store.tokens(one, "v").collect()]
    second = [r.v for r in store.tokens(two, "v").collect()]
    assert sorted(map(str, first)) == ["None", "TKN_000001", "TKN_000002"]
    assert sorted(second) == ["TKN_000001", "TKN_000003"] and store.stats().first().tokens == 3
    assert sorted(r.v for r in store.original(store.tokens(two, "v"), "v").collect()) == ["a", "c"]
    other = anonymize.TokenStore(spark, f"file://{tmp_path}/other")
    other.load(store.table())
    assert other.stats().first().tokens == 3
    store.reset()
    assert store.table().count() == 0


def test_strata(spark):
    df = spark.createDataFrame([(i, "a" if i < 90 else "b" if i < 99 else "c") for i in range(100)], "k int, s string")
    got = [r.s for r in subset.stratified_subset(df, 20, "s", "k").collect()]
    assert (got.count("a"), got.count("b"), got.count("c")) == (18, 1, 1)
    assert subset.random_subset(df, 500, "k").count() == 100 and subset.target_size(50_000) == 10_000 and subset.target_size(500, percent=10) == 50
    compared = subset.compare_distributions(df, df.filter("k % 2 = 0"))
    assert subset.distribution_summary(compared)["overall_similarity"] > 0.8


def test_fuzzy(spark):
    assert indel_ratio("abc", "abc") == 100 and indel_ratio("", "") == 100 and indel_ratio("ab", "cd") == 0 and round(indel_ratio("lewenstein", "levenshtein"), 1) == 85.7
    assert name_similarity("cust_id", "CustID") == 1 and name_similarity("customer", "customer_id") == 0.8
    a = spark.createDataFrame([("Cash at bank",), ("Stocks in progress",), ("zzz",), (None,)], "v string")
    b = spark.createDataFrame([("Cash at banks",), ("Stock in progress",), ("Other",)], "v string")
    got = {r.source: r.target for r in mapping.fuzzy_matches(a, b, "v", "v", 0.8).collect()}
    assert got == {"Cash at bank": "Cash at banks", "Stocks in progress": "Stock in progress"}
    import random

    r = random.Random(2)
    words = ["".join(r.choice("abcd") for _ in range(r.randint(1, 9))) for _ in range(60)]
    x, y = (spark.createDataFrame([(w,) for w in ws], "v string") for ws in (words[:30], words[30:]))
    for least in (0.6, 0.8):
        want = {s for s in words[:30] if any(round(indel_ratio(s, t) / 100, 4) >= least for t in words[30:])}
        assert {m.source for m in mapping.fuzzy_matches(x, y, "v", "v", least).collect()} == want


def test_grades_and_rules():
    assert quality.grade(96.5) == "A" and quality.grade(96.5, legacy=True) == "F" and quality.grade(100) == "A+" and quality.grade(12) == "F"
    rules = quality.domain_rules("sales")
    assert quality.Rules.from_yaml(rules.to_yaml()) == rules and rules.columns["quantity"]["min"] == 1


def test_relationships(spark):
    a = spark.createDataFrame([(i,) for i in range(5)], "customer_id int")
    b = spark.createDataFrame([(i % 5, i) for i in range(20)], "customer_id long, x long")
    one = relationships.find_relationships({"a": a, "b": b}).first()
    assert (one.source_column, one.target_column, one.relationship_type, one.confidence) == ("customer_id", "customer_id", "1:N", 1.0)
    assert relationships.key_relationships({"a": a, "b": b})[0]["cardinality"] == "1:N"
    assert relationships.suggest_star_schema({"a": a, "b": b})[0]["role"] == "fact"


def test_generators(spark):
    d = generate.dimension(spark, [{"name": "k", "generator": "integer", "unique": True}, {"name": "v", "values": ["p", "q"], "weights": [0.9, 0.1], "nullable": 0.1}], 2000)
    n = d.groupBy("v").count().collect()
    assert d.select("k").distinct().count() == 2000 and {r.v: r["count"] for r in n}["p"] > 1500 and 100 < {r.v: r["count"] for r in n}[None] < 300
    for template in generate.specs.DIMENSIONS:
        assert generate.dimension(spark, template, 20).count() == 20
    for template in generate.specs.FACTS:
        f = generate.fact(spark, template, 300, {"x_id": 7}, ("2024-01-01", "2024-01-31"))
        low_high = f.agg(F.min("x_id").alias("a"), F.max("x_id").alias("b"), F.min("date_key").alias("c"), F.max("date_key").alias("d")).first()
        assert low_high.a >= 1 and low_high.b <= 7 and low_high.c >= 20240101 and low_high.d <= 20240131
        for name, _, low, high, _ in generate.specs.FACTS[template]["measures"]:
            one = f.agg(F.min(name), F.max(name)).first()
            assert low <= one[0] and one[1] <= high
    same = [sorted(map(str, generate.fact(spark, "sales", 200).repartition(k).collect())) for k in (1, 5)]
    assert same[0] == same[1]
    for domain in generate.STARS:
        assert f"fact_{domain}" in generate.star_schema(spark, domain, 50, 10)
    for industry in generate.specs.INDUSTRIES:
        tables = generate.industry_schema(spark, industry, 0.001)
        assert all(df.limit(1).count() == 1 for df in tables.values())
    w = generate.weighted_keys(spark.range(3000), spark.createDataFrame([(1, 1.0), (2, 3.0)], "k int, w double"), "k", "w", "fk", "id").groupBy("fk").count().collect()
    assert 0.2 < {r.fk: r["count"] for r in w}[1] / 3000 < 0.3


def test_events_and_formulas(spark):
    assert generate.event_days("fourth_thursday_november+1", 2024)[0].isoformat() == "2024-11-29"
    assert generate.event_days("last_monday_may", 2024)[0].isoformat() == "2024-05-27" and generate.event_days("fifth_friday_february", 2023) == []
    assert len(generate.event_days("12-24", 2024, 3)) == 3 and generate.event_days("2023-01-01", 2024) == []
    s = {r.date.isoformat(): r.value for r in generate.time_series(spark, {"monthly_weights": {"1": 2.0}, "noise_std": 0, "events": [("e", "01-05", 3.0, 1)]}, "2024-01-04", "2024-02-01", 10.0).collect()}
    assert s["2024-01-04"] == 20 and s["2024-01-05"] == 60 and s["2024-02-01"] == 10
    assert generate.time_series(spark, "website_traffic", "2024-01-01", "2024-01-02", grain="hour").count() == 48
    assert generate.formula_sql("a ** 2 + (b) == 3", ["a", "b"]) == "pow(a, 2) + (b) = 3"
    with pytest.raises(ValueError, match="unknown names"):
        generate.formula_sql("__import__('os')", ["a"])
    assert len(generate.list_time_patterns("retail")) >= 4
    loaded = generate.load_time_patterns("p:\n  monthly_weights: {1: 0.5}\n  special_events:\n    - {name: x, date: 2024-03-01, multiplier: 2}\n")
    assert loaded["p"]["events"] == [("x", "2024-03-01", 2.0, 1)]


def test_correlation_holds(spark):
    df = generate.correlated_fact(spark, 4000, [{"name": "price", "type": "normal", "mean": 50, "std": 5}], [{"type": "statistical", "source": ["price"], "target": "cost", "correlation": 0.8, "mean": 10, "std": 2}])
    assert abs(df.corr("price", "cost") - 0.8) < 0.05


def test_rates(spark):
    fx = generate.multicurrency_fact(spark, 500, ["USD", "EUR"], "USD", "2024-01-06", "2024-01-31")
    rows = fx.collect()
    assert len(rows) == 500 and all(r.exchange_rate and (r.transaction_currency != "USD" or r.exchange_rate == 1) for r in rows)
    assert all(r.rate_date is None or r.rate_date <= r.transaction_date for r in rows)
    wide = generate.exchange_rates(spark, "EUR", ["USD", "JPY"], "2024-01-01", "2024-01-31")
    assert wide.columns == ["date", "EUR_USD", "EUR_JPY"] and wide.filter("EUR_USD IS NULL").count() == 0


TEMPLATE = """
columns:
  - {name: key, generator: sequence, config: {start: 1}}
  - {name: code, generator: pattern, config: {pattern: "P-{number:6}"}}
  - {name: kind, generator: choice, config: {choices: [A, B], weights: [0.5, 0.5]}}
  - {name: sub, generator: dependent_choice, config: {depends_on: kind, mappings: {A: [a1, a2], B: [b1]}}}
  - {name: cost, generator: distribution, config: {type: uniform, min: 5, max: 10}}
  - {name: price, generator: formula, config: {formula: "cost * (1 + random.uniform(0.2, 0.5))"}}
  - {name: day, generator: date_range, config: {start: "2024-01-01", end: "2024-01-05"}}
  - {name: n, generator: distribution, config: {type: poisson, lambda: 3, min: 1, max: 20}}
  - {name: fk, generator: dimension_lookup, config: {dimension: customer, distribution: pareto, pareto_alpha: 1.5, size: 50}}
  - {name: account, generator: hierarchical_code, config: {levels: [{digits: 1}, {digits: 3}]}}
  - {name: up, generator: parent, config: {source: account}}
validations:
  - {rule: "price >= cost", message: dearer}
  - {rule: "n > 5", message: many}
"""


def test_template(spark):
    df = generate.from_template(spark, TEMPLATE, 300)
    rows = df.collect()
    assert all(r.code == f"P-{r.key:06d}" and r["sub"][0] == r.kind.lower() and 1.19 * r.cost <= r.price <= 1.51 * r.cost and 1 <= r.fk <= 50 and r.up == r.account[0] for r in rows)
    got = {r.rule_name: r.passed for r in validate.check_rules(df, generate.template_checks(TEMPLATE)).collect()}
    assert got == {"dearer": True, "many": False}
