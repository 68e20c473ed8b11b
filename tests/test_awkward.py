"""Cases that a short cut would lose: wide numbers, deep and shared hierarchies, null keys and orders, hot groups, common letters."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from brindle.functions.similarity import indel_ratio
from brindle.operators import anonymize, generate, hierarchy, mapping, relational


def test_tokens_past_six_digits(spark, tmp_path):
    got = anonymize.tokens(spark.range(1_000_001).selectExpr("concat('v', id) AS v"), "v")
    one = got.agg(F.count("*"), F.count_distinct("token"), F.max(F.length("token")), F.min("token"), F.max(F.regexp_extract("token", "([0-9]+)$", 1).cast("long"))).first()
    assert tuple(one) == (1_000_001, 1_000_001, 11, "TKN_000001", 1_000_001)
    store = anonymize.TokenStore(spark, f"file://{tmp_path}/tokens")
    store.load(spark.createDataFrame([("c", "old", "TKN_999999")], store.SCHEMA))
    made = store.tokens(spark.createDataFrame([("old",), ("new",), ("newer",)], "c string"), "c")
    assert sorted(r.c for r in made.collect()) == ["TKN_1000000", "TKN_1000001", "TKN_999999"]


def test_codes_past_their_width(spark):
    text = 'columns: [{name: a, generator: pattern, config: {pattern: "X{n:2}"}}, {name: b, generator: hierarchical_code, config: {levels: [{digits: 1}, {digits: 1}]}}]'
    rows = generate.from_template(spark, text, 150).collect()
    assert len({r.a for r in rows}) == 150 and {len(r.a) for r in rows} == {3, 4} and len({r.b for r in rows}) == 150


def test_many_deep_chains(spark):
    n, depth = 20_000, 20
    chains = spark.range(n * depth).selectExpr(f"concat('c', id div {depth}, '-', id % {depth}) AS parent", f"concat('c', id div {depth}, '-', id % {depth} + 1) AS child")
    amounts = spark.range(n).selectExpr(f"concat('c', id, '-{depth}') AS key", "CAST(id % 100 AS DOUBLE) AS amount")
    one = hierarchy.rollup(chains, "parent", "child", amounts, "key", "amount")
    got = one.agg(F.count("*"), F.sum("total_amount")).first()
    assert got[0] == n * (depth + 1) and got[1] == (depth + 1) * sum(i % 100 for i in range(n))
    assert hierarchy.analyze(chains, "parent", "child").first().max_depth == depth


def brute_rollup(edges, amounts):
    """Every path from every element."""
    below = defaultdict(set)
    for p, c in edges:
        if p != c:
            below[p].add(c)
    own = {k: v for k, v in amounts.items() if k not in below}

    def total(x, path):
        return own.get(x, 0) + sum(total(c, {*path, c}) for c in below[x] if c not in path)

    every = {x for e in edges for x in e}
    return {x: total(x, {x}) for x in every}


@pytest.mark.parametrize("cycle", [False, True])
def test_shared_children(spark, cycle):
    r = random.Random(3)
    edges = [(f"n{a}", f"n{b}") for b in range(1, 20) for a in {r.randrange(max(0, b - 6), b) for _ in range(2)}] + [("n19", "n19")]
    if cycle:
        edges.append(("n18", "n15"))
    amounts = {f"n{i}": i * 10.0 for i in range(20)}
    df = spark.createDataFrame(edges, "parent string, child string")
    held = spark.createDataFrame(list(amounts.items()), "key string, amount double")
    got = {x.element: x.total_amount for x in hierarchy.rollup(df, "parent", "child", held, "key", "amount", 25).collect()}
    assert got == pytest.approx(brute_rollup(edges, amounts))


def test_fills_by_text_and_null_orders(spark):
    r = random.Random(4)
    rows = [(i, f"g{i % 3}" if i % 5 else None, f"k{i:04d}" if i % 7 else None, r.choice([None, i])) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, g string, o string, v int")

    def brute(strategy, grouped):
        out = {}
        groups = defaultdict(list)
        for row in rows:
            groups[row[1] if grouped else 0].append(row)
        for held in groups.values():
            held = sorted((x for x in held if x[2] is not None), key=lambda x: x[2], reverse=strategy == "backward")
            last = None
            for i, _, _, v in held:
                last = v if v is not None else last
                out[i] = last
        return out

    for grouped in (False, True):
        got = {x.id: x.v for x in relational._fill_ordered(df, "v", "backward", "o", ["g"] if grouped else [], 16).collect()}
        assert {i: got[i] for i in brute("backward", grouped)} == brute("backward", grouped) and len(got) == 300
    lone = spark.createDataFrame([(None, 5), (None, None), ("a", None), ("b", 7)], "o string, v int")
    assert Counter(x.v for x in relational.fill_nulls(lone.filter("o IS NOT NULL OR v IS NOT NULL"), "v", "forward", order_by="o").collect()) == Counter([5, 5, 7])


def test_as_of_of_a_null_group(spark):
    left = spark.createDataFrame([(1, None, "2024-03-01"), (2, "a", "2024-03-01"), (3, "b", "2024-03-01")], "id int, g string, at string").withColumn("at", F.to_timestamp("at"))
    right = spark.createDataFrame([(None, "2024-01-01", 7), ("a", "2024-01-02", 8)], "g string, seen string, v int").withColumn("seen", F.to_timestamp("seen"))
    got = {x.id: x.v for x in relational.as_of_join(left, right, "at", "seen", ["g"], ["v"]).collect()}
    assert got == {1: 7, 2: 8, 3: None}


@pytest.mark.parametrize("least", [0.7, 0.8, 0.9])
def test_fuzzy_matches_by_brute_force(spark, least):
    r = random.Random(5)
    base = ["".join(r.choice("abcde ") for _ in range(r.randint(1, 14))).strip() or "x" for _ in range(120)]

    def worn(s):
        s = list(s)
        for _ in range(r.randint(0, 3)):
            k = r.randrange(len(s) + 1)
            s[k : k + r.randint(0, 1)] = [r.choice("abcde")] * r.randint(0, 1)
        return "".join(s).strip() or "y"

    other = [worn(s) for s in base]
    a, b = (spark.createDataFrame([(s,) for s in x], "v string") for x in (base, other))
    want = {}
    for s in set(base):
        best = min(((-round(indel_ratio(s, t) / 100, 4), t) for t in set(other) if round(indel_ratio(s, t) / 100, 4) >= least), default=None)
        if best:
            want[s] = (best[1], -best[0])
    got = {x.source: (x.target, x.ratio) for x in mapping.fuzzy_matches(a, b, "v", "v", least).collect()}
    assert got == want and len(want) > 30


def test_weighted_keys_follow_weights(spark):
    weights = {1: 1.0, 2: 3.0, 3: 0.0, 4: None, 5: 0.1, 6: 0.9, 7: -2.0}
    dim = spark.createDataFrame(list(weights.items()), "k int, w double")
    got = Counter(x.to for x in generate.weighted_keys(spark.range(20_000), dim, "k", "w", "to", "id", buckets=3).collect())
    assert set(got) == {1, 2, 5, 6} and sum(got.values()) == 20_000
    assert all(got[k] / 20_000 == pytest.approx(weights[k] / 5, abs=0.015) for k in got)
    assert generate.weighted_keys(spark.range(3), dim.filter("k = 3"), "k", "w", "to", "id").filter("to IS NULL").count() == 3


def test_backward_fill_carries_values_along(spark):
    """A frame from the row to the end is read again for each row: quadratic in a chunk."""
    df = spark.range(40_000).selectExpr("id", "CASE WHEN id % 1000 = 999 THEN id END AS v")
    filled = relational.fill_nulls(df, "v", "backward", order_by="id")
    assert "unboundedfollowing" not in filled._jdf.queryExecution().executedPlan().toString().lower()
    assert filled.filter("v IS NULL OR v <> id div 1000 * 1000 + 999").count() == 0 and filled.count() == 40_000


def test_joins_with_many_rows_a_key_are_spread(spark):
    """The rows of a small table are few tasks' work, unless they are dealt before the join that multiplies them."""
    from brindle.plans import catalogue

    for name in ("join_files_nway", "range_join"):
        assert "RoundRobinPartitioning" in catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString(), name


def test_range_join_of_repeated_values(spark):
    """Distinct values and ranges meet once: the same rows as from all, repeated ones, nulls and rows without a range included."""
    r = random.Random(5)
    values = [r.choice([None, -0.0, 0.0, 1.5, 3.0, 7.25, 90.0]) for _ in range(120)]
    ranges = [r.choice([(0.0, 1.0), (1.5, 3.0), (-5.0, 8.0), (3.0, 3.0), (None, 4.0), (2.0, None)]) for _ in range(60)]
    left = spark.createDataFrame(list(enumerate(values)), "i int, x double")
    right = spark.createDataFrame([(i, *x) for i, x in enumerate(ranges)], "j int, low double, high double")
    pairs = [(i, j) for i, x in enumerate(values) for j, (a, b) in enumerate(ranges) if None not in (x, a, b) and a <= x < b]
    alone = [(i, None) for i in range(120) if i not in {i for i, _ in pairs}]
    for how, want in (("inner", pairs), ("left", pairs + alone)):
        got = relational.range_join(left, right, "x", "low", "high", 2.0, how, repeats=True)
        assert got.columns == ["i", "x", "j", "low", "high"] and Counter((g.i, g.j) for g in got.collect()) == Counter(want), how
    assert relational.range_join(left, right.limit(0), "x", "low", "high", 2.0, repeats=True).count() == 0


def _shuffled(plan):
    """Rows written to shuffles by an executed plan."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return _shuffled(plan.executedPlan())
    if name.endswith("QueryStageExec"):
        return _shuffled(plan.plan())
    own = plan.metrics().apply("shuffleRecordsWritten").value() if name == "ShuffleExchangeExec" else 0
    return own + sum(_shuffled(plan.children().apply(i)) for i in range(plan.children().size()))


def test_range_join_shuffles_blocks_not_rows_by_range(spark):
    """Each of 3000 rows matches 50 of 100 ranges: the rows go to shuffles a few times, not once for each range."""
    left = spark.range(3000).selectExpr("id AS i", "double(id % 100) AS x")
    right = spark.range(3000).selectExpr("id AS j", "double(id % 100) AS low", "double(id % 100 + 50) AS high")
    done = relational.range_join(left, right, "x", "low", "high", 1000.0, repeats=True)._jdf.queryExecution()
    assert done.toRdd().count() == 30 * 30 * sum(0 <= x - a < 50 for x in range(100) for a in range(100))
    assert _shuffled(done.executedPlan()) < 5 * (3000 + 3000)


def test_range_join_of_a_hot_value_is_many_blocks(spark):
    """Rows of one value fill several blocks and pieces: each pair comes once, and generated code doesn't hold the pairs of two blocks in memory."""
    left = spark.range(9000).selectExpr("id AS i", "if(id < 8900, 5.0D, double(id)) AS x", "CAST(NULL AS INT) AS empty")
    right = spark.range(300).selectExpr("id AS j", "if(id < 290, 5.0D, 8999.5D) AS low", "if(id < 290, 25.0D, 9001.0D) AS high", "array(id) AS more")
    for how, rows in (("inner", 8900 * 290), ("left", 8900 * 290 + 100)):
        out = relational.range_join(left, right, "x", "low", "high", 10.0, how, repeats=True)
        assert out.columns == ["i", "x", "empty", "j", "low", "high", "more"]
        one = out.selectExpr("count(*)", "count(DISTINCT i, j)", "sum(i * 300 + j)", "count_if(more[0] = j)").first()
        assert tuple(one) == (rows, 8900 * 290, sum(range(8900)) * 300 * 290 + 8900 * sum(range(290)), 8900 * 290), how
    blocks = relational._blocks(left, ["x"], F.floor(F.col("x") / 10.0), "l")
    sizes = [[len(p["rows"]) for p in b["l"]] for b in blocks.collect()]
    assert sum(map(sum, sizes)) == 9000 and max(map(sum, sizes)) <= 4096 and max(map(max, sizes)) <= 128 and sum(sum(s) > 100 for s in sizes) > 1
