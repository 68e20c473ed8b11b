"""Validation: a rule compiler (all simple rules in one aggregate), balances, referential integrity, totals and outliers."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.operators.profile import is_number, stacked, union_all

# ---- rules -------------------------------------------------------------------------------------------------------


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


def _violation(kind: str, column: str, p: dict) -> Column | None:
    """The aggregate that counts a simple rule's violations; nulls pass range, regex, length and custom_sql rules."""
    c = _col(column) if column else None
    if kind == "not_null":
        return F.count_if(c.isNull())
    if kind == "range":
        low, high = p.get("min", p.get("min_value")), p.get("max", p.get("max_value"))
        bad = F.lit(False)
        bad = bad | (c < low) if low is not None else bad
        bad = bad | (c > high) if high is not None else bad
        return F.count_if(bad)
    if kind == "regex":
        return F.count_if(~c.rlike(p["pattern"]))
    if kind == "length":
        n, low, high = F.length(c.cast("string")), p.get("min", p.get("min_length")), p.get("max", p.get("max_length"))
        bad = F.lit(False)
        bad = bad | (n < low) if low is not None else bad
        bad = bad | (n > high) if high is not None else bad
        return F.count_if(bad)
    if kind == "custom_sql":
        return F.count_if(~F.expr(p.get("expression") or p["sql"]))
    if kind == "enum":
        wrong = ~c.isin(*p.get("values", p.get("allowed_values")))
        return F.count_distinct(F.when(wrong, c)) + F.max(c.isNull().cast("int")).cast("long")
    return None


RULES = ("not_null", "unique", "range", "regex", "custom_sql", "referential", "enum", "length")


def check_rules(df: DataFrame, rules: list[dict], references: dict[str, DataFrame] | None = None) -> DataFrame:
    """rule_name, rule_type, column, violations, passed; rules: {name, type, columns, config}.

    enum counts wrong distinct values, null among them; unique counts rows beyond the first of a value (one column) or repeated
    keys (several); referential counts rows whose key the reference (config: reference, column) lacks.  A rule of unknown type fails."""
    simple: dict[str, dict[str, Column]] = {}
    others, n = [], 0
    for rule in rules:
        kind, p = rule.get("type"), rule.get("config") or {}
        columns = [rule["columns"]] if isinstance(rule.get("columns"), str) else list(rule.get("columns") or [""])
        if kind == "unique":
            others.append(_tagged(_repeats(df, columns), rule, ",".join(columns)))
            continue
        for column in columns:
            if kind == "referential":
                ref = (references or {})[p["reference"]]
                others.append(_tagged(_missing(df, column, ref, p.get("column", column)), rule, column))
                continue
            bad = _violation(kind, column, p)
            bad = F.max(F.lit(-1).cast("long")) if bad is None else bad
            simple[str(n)] = {"rule_name": F.max(F.lit(rule.get("name", kind))), "rule_type": F.max(F.lit(str(kind))), "column": F.max(F.lit(column)), "violations": F.coalesce(bad.cast("long"), F.lit(0).cast("long"))}
            n += 1
    frames = ([stacked(df, simple, "__n").drop("__n")] if simple else []) + others
    return union_all(frames).withColumn("passed", F.col("violations") == 0)


def _tagged(counted: DataFrame, rule: dict, column: str) -> DataFrame:
    return counted.select(F.lit(rule.get("name", rule["type"])).alias("rule_name"), F.lit(rule["type"]).alias("rule_type"), F.lit(column).alias("column"), F.col("violations").cast("long").alias("violations"))


def _repeats(df: DataFrame, columns: list[str]) -> DataFrame:
    groups = df.groupBy(*(_col(c) for c in columns)).agg(F.count("*").alias("n"))
    bad = F.sum(F.col("n") - 1) if len(columns) == 1 else F.count_if(F.col("n") > 1)
    return groups.agg(F.coalesce(bad, F.lit(0)).alias("violations"))


def _missing(df: DataFrame, column: str, ref: DataFrame, ref_column: str) -> DataFrame:
    keys = ref.select(F.col(ref_column).alias("__key")).distinct()
    return df.select(_col(column).alias("__key")).filter("__key IS NOT NULL").join(keys, "__key", "left_anti").agg(F.count("*").alias("violations"))


# ---- balances ------------------------------------------------------------------------------------------------------


def money(c: str, digits: int = 2) -> Column:
    """Exact sums: decimal first, double after."""
    return F.sum(_col(c).cast(T.DecimalType(18, digits)))


def check_balance(df: DataFrame, debit: str, credit: str, group_by: Sequence[str] = (), tolerance: float = 0.01, digits: int = 2) -> DataFrame:
    """total_debit, total_credit, difference, abs_difference and balanced, for each group or overall."""
    sums = df.groupBy(*group_by).agg(F.coalesce(money(debit, digits), F.lit(0)).cast("double").alias("total_debit"), F.coalesce(money(credit, digits), F.lit(0)).cast("double").alias("total_credit"))
    out = sums.withColumn("difference", F.round(F.col("total_debit") - F.col("total_credit"), 4)).withColumn("abs_difference", F.abs("difference"))
    return out.withColumn("balanced", F.col("abs_difference") <= tolerance)


def balance_summary(df: DataFrame, debit: str, credit: str, group_by: Sequence[str] = (), tolerance: float = 0.01, digits: int = 2) -> DataFrame:
    """One row: balanced, groups, imbalanced_groups, largest_difference."""
    return check_balance(df, debit, credit, group_by, tolerance, digits).agg(
        F.coalesce(F.bool_and("balanced"), F.lit(True)).alias("balanced"), F.count("*").alias("groups"), F.count_if(~F.col("balanced")).alias("imbalanced_groups"), F.max("abs_difference").alias("largest_difference")
    )


# ---- referential integrity --------------------------------------------------------------------------------------------


def check_integrity(fact: DataFrame, dimensions: dict[str, tuple[DataFrame, str | None]], keys: dict[str, str]) -> DataFrame:
    """A row for each fact key: keys maps it to a dimension; a dimension's key is named, or of the same name, or its first column.

    A null key counts as an orphan value, but not as an orphan record; null_keys says how many there are."""
    out = []
    for key, name in keys.items():
        dim, dim_key = dimensions[name]
        dim_key = dim_key or (key if key in dim.columns else dim.columns[0])
        # Distinct values with counts on either side, one full join of those.
        f = fact.groupBy(_col(key).alias("k")).agg(F.count("*").alias("records"))
        d = dim.groupBy(_col(dim_key).alias("k")).agg(F.lit(True).alias("known"))
        both = f.join(d, f["k"].eqNullSafe(d["k"]), "full").select(F.coalesce(f["k"], d["k"]).alias("k"), "records", F.coalesce("known", F.lit(False)).alias("known"))
        row = both.agg(
            F.count_if(F.col("records").isNotNull()).alias("fact_unique_keys"),
            F.count_if("known").alias("dimension_unique_keys"),
            F.count_if(F.col("records").isNotNull() & ~F.col("known")).alias("orphan_values_count"),
            F.coalesce(F.sum(F.when(~F.col("known") & F.col("k").isNotNull(), F.col("records"))), F.lit(0)).alias("orphan_records_count"),
            F.coalesce(F.sum(F.when(F.col("k").isNull(), F.col("records"))), F.lit(0)).alias("null_keys"),
            F.count_if(F.col("records").isNull()).alias("unused_dimension_values_count"),
        )
        share = lambda part, whole: F.round(F.coalesce(F.try_divide(F.col(part) * 100.0, F.col(whole)), F.lit(100.0)), 2)
        out.append(
            row.withColumn("matched", F.col("fact_unique_keys") - F.col("orphan_values_count"))
            .withColumn("used", F.col("dimension_unique_keys") - F.col("unused_dimension_values_count"))
            .select(F.lit(key).alias("fact_key"), F.lit(name).alias("dimension"), "fact_unique_keys", "dimension_unique_keys", "orphan_values_count", "orphan_records_count", "null_keys", "unused_dimension_values_count", share("matched", "fact_unique_keys").alias("fact_to_dimension"), share("used", "dimension_unique_keys").alias("dimension_used"), (F.col("orphan_values_count") == 0).alias("integrity_valid"))
        )
    return union_all(out)


def check_composite_integrity(fact: DataFrame, dimension: DataFrame, fact_keys: Sequence[str], dim_keys: Sequence[str]) -> DataFrame:
    """Distinct key combinations of the fact (with a null in none) that the dimension lacks, and their records."""
    names = [f"k{i}" for i in range(len(fact_keys))]
    f = fact.select(*(_col(k).alias(n) for k, n in zip(fact_keys, names, strict=True))).dropna().groupBy(*names).agg(F.count("*").alias("records"))
    d = dimension.select(*(_col(k).alias(n) for k, n in zip(dim_keys, names, strict=True))).dropna().distinct().withColumn("known", F.lit(True))
    return f.join(d, names, "left").agg(F.count("*").alias("fact_unique_keys"), F.count_if(F.col("known").isNull()).alias("orphan_values_count"), F.coalesce(F.sum(F.when(F.col("known").isNull(), F.col("records"))), F.lit(0)).alias("orphan_records_count"))


# ---- totals ------------------------------------------------------------------------------------------------------------


def check_totals(df: DataFrame, measure: str, group_columns: Sequence[str], digits: int = 2) -> DataFrame:
    """level, column, group_value, total, count: a grouping set for each column and one for all rows (level 0), in one pass."""
    total = F.sum(_col(measure).cast(T.DecimalType(18, digits))).cast("double").alias("total")
    sets = df.groupingSets([[c] for c in group_columns] + [[]], *group_columns).agg(total, F.count("*").alias("count"), F.grouping_id(*group_columns).alias("gid"))
    n = len(group_columns)
    at = lambda i: F.col("gid") == (2**n - 1) - (1 << (n - 1 - i))
    pick = lambda make, other: reduce(lambda out, i: F.when(at(i), make(i)).otherwise(out), range(n), other)
    return sets.select(pick(lambda i: F.lit(i + 1), F.lit(0)).alias("level"), pick(lambda i: F.lit(group_columns[i]), F.lit("(all)")).alias("column"), pick(lambda i: _col(group_columns[i]).cast("string"), F.lit(None).cast("string")).alias("group_value"), "total", "count")


def check_hierarchy(totals: DataFrame, expected: float | None = None, tolerance: float = 0.01) -> DataFrame:
    """For each column: do its groups add up to the total of all rows (and to an expected total)?"""
    whole = totals.filter("level = 0").select(F.col("total").alias("whole"))
    sums = totals.filter("level > 0").groupBy("level", "column").agg(F.sum("total").alias("total")).crossJoin(F.broadcast(whole))  # one row
    fits = F.abs(F.col("total") - F.col("whole")) <= tolerance
    return sums.withColumn("consistent", fits if expected is None else fits & (F.abs(F.col("whole") - expected) <= tolerance))


# ---- outliers ------------------------------------------------------------------------------------------------------------


def nearest_rank(values: DataFrame, quantiles: Sequence[float]) -> DataFrame:
    """values (column, v): for each column and q the value at row round((n - 1) * q), in order."""
    return _at_ranks(values, [(float(q), f"CAST(round((n - 1) * {float(q)!r}D) AS BIGINT)") for q in quantiles])


def exact_median(values: DataFrame) -> DataFrame:
    """values (column, v): column, median (the mean of the two middle values)."""
    both = _at_ranks(values, [(0.5, "CAST(floor((n - 1) / 2) AS BIGINT)"), (0.5, "CAST(ceil((n - 1) / 2) AS BIGINT)")])
    return both.groupBy("column").agg(F.avg("value").alias("median"))


def _at_ranks(values: DataFrame, ranks: Sequence[tuple[float, str]], accuracy: int = 10_000) -> DataFrame:
    """The values at exact ranks, each near a quantile, without sorting a column in one task: column, q, rank, value.

    A quantile sketch, whatever the distribution, brackets each rank between two values; rows below the bracket are counted, and only the
    distinct values inside it (about 4 / accuracy of the rows) are sorted."""
    held = values.filter("v IS NOT NULL AND NOT isnan(v)")
    e = 2.0 / accuracy
    edges = ", ".join(f"{max(0.0, q - e)!r}D, {min(1.0, q + e)!r}D" for q, _ in ranks)
    sketch = held.groupBy("column").agg(F.expr(f"percentile_approx(v, array({edges}), {accuracy})").alias("at"), F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    one = lambda i, q, rank: F.struct(
        F.lit(i).alias("i"),
        F.lit(q).alias("q"),
        F.expr(rank).alias("rank"),
        (F.col("lo") if q - e <= 0 else F.col("at")[2 * i]).alias("low"),
        (F.col("hi") if q + e >= 1 else F.col("at")[2 * i + 1]).alias("high"),
    )
    brackets = sketch.select("column", F.explode(F.array(*(one(i, q, r) for i, (q, r) in enumerate(ranks)))).alias("b")).select("column", "b.*")
    rows = held.join(F.broadcast(brackets), "column").filter("v <= high")  # a row a column and quantile
    counts = rows.groupBy("column", "i", "q", "rank", F.when(F.col("v") < F.col("low"), F.lit(None)).otherwise(F.col("v")).alias("v")).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(Window.partitionBy("column", "i").orderBy(F.asc_nulls_first("v")).rowsBetween(Window.unboundedPreceding, 0))
    return counts.withColumn("upto", upto).filter("v IS NOT NULL AND rank < upto").groupBy("column", "i", "q", "rank").agg(F.min("v").alias("value"))


def _long(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), _col(c).cast("double").alias("v")) for c in columns))).alias("p")).select("p.*")


def detect_outliers(df: DataFrame, columns: Sequence[str] | None = None, method: str = "iqr", threshold: float | None = None) -> DataFrame:
    """column, method, lower, upper, mean, std, outlier_count, outlier_pct.

    iqr (default threshold 1.5): below q1 - t * iqr or above q3 + t * iqr, nearest-rank quartiles; zscore (3.0): more than t sample deviations off."""
    columns = list(columns) if columns else [f.name for f in df.schema.fields if is_number(f.dataType)]
    t = float(threshold if threshold is not None else {"iqr": 1.5, "zscore": 3.0}.get(method, 0))
    null = F.lit(None).cast("double")
    if method == "iqr":
        q = nearest_rank(_long(df, columns), (0.25, 0.75)).groupBy("column").agg(F.max(F.when(F.col("q") == 0.25, F.col("value"))).alias("q1"), F.max(F.when(F.col("q") == 0.75, F.col("value"))).alias("q3"))
        limits = q.select("column", (F.col("q1") - t * (F.col("q3") - F.col("q1"))).alias("lower"), (F.col("q3") + t * (F.col("q3") - F.col("q1"))).alias("upper"), null.alias("mean"), null.alias("std"))
    elif method == "zscore":
        stats = stacked(df, {c: {"mean": F.avg(_col(c).cast("double")), "std": F.stddev_samp(_col(c).cast("double"))} for c in columns})
        limits = stats.select("column", (F.col("mean") - t * F.col("std")).alias("lower"), (F.col("mean") + t * F.col("std")).alias("upper"), "mean", "std")
    else:
        raise ValueError(f"unknown method {method!r}")
    long = _long(df, columns).join(F.broadcast(limits), "column", "left")  # a row a column
    off = (F.col("v") < F.col("lower")) | (F.col("v") > F.col("upper"))
    out = long.groupBy("column").agg(*(F.max(x).alias(x) for x in ("lower", "upper", "mean", "std")), F.count_if(off).alias("outlier_count"), F.count("v").alias("n"))
    pct = F.round(F.coalesce(F.try_divide(F.col("outlier_count") * 100.0, F.col("n")), F.lit(0.0)), 1)
    return out.select("column", F.lit(method).alias("method"), "lower", "upper", "mean", "std", "outlier_count", pct.alias("outlier_pct"))


def detect_anomalies(df: DataFrame, columns: Sequence[str] | None = None, method: str = "zscore", threshold: float = 3.0) -> DataFrame:
    """Outliers of all numeric columns, most first; one threshold for either method."""
    return detect_outliers(df, columns, method, threshold).orderBy(F.desc("outlier_count"), "column")
