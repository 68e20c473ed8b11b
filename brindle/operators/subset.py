"""Subsets with a reproducible draw, and similarity of distributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.functions import rng
from brindle.functions.lineage import ranked
from brindle.operators.profile import is_number, stacked


def target_size(n: int, size: int | None = None, percent: float | None = None) -> int:
    """size, or percent of n, or by default the larger of a tenth and 10,000; n at most."""
    want = size if size is not None else int(n * percent / 100) if percent is not None else max(int(n * 0.1), 10_000)
    return min(n, want)


def random_subset(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    """Exactly n rows (fewer if there aren't so many): the first by a hash of the key."""
    return df.orderBy(rng.order_key(seed, F.col(key)), key).limit(n)


def stratified_subset(df: DataFrame, n: int, strata: str | Sequence[str], key: str, seed: int = 42, equal: bool = False) -> DataFrame:
    """max(1, int(group * n / rows)) of each stratum, or max(1, n // strata) with equal.

    Ranks within a stratum come from hash buckets, so a stratum that holds most rows spreads over tasks."""
    by = [strata] if isinstance(strata, str) else list(strata)
    d = df.withColumn("__h", rng.order_key(seed, F.col(key))).withColumn("__b", F.substring("__h", 1, 2))
    sizes = d.groupBy(*by, "__b").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("__base", F.coalesce(F.sum("__n").over(before), F.lit(0))).withColumn("__size", F.sum("__n").over(Window.partitionBy(*by)))
    groups = sizes.select(*by, "__size").distinct().agg(F.count("*").alias("g"), F.sum("__size").alias("n")).first()
    want = F.lit(max(1, n // max(1, groups.g))) if equal else F.greatest(F.lit(1), F.floor(F.col("__size") * F.lit(n / max(1, groups.n or 0))))
    same = None
    for c in [*by, "__b"]:
        one = d[c].eqNullSafe(sizes[c])
        same = one if same is None else same & one
    joined = d.join(sizes, same).select(d["*"], "__base", "__size")
    rank = F.col("__base") + F.row_number().over(Window.partitionBy(*by, "__b").orderBy("__h", key))
    return joined.withColumn("__r", rank).filter(F.col("__r") <= want).select(*df.columns)


def time_window(df: DataFrame, column: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Rows whose date lies between start and end, both inclusive."""
    day = F.to_date(F.col(f"`{column}`"))
    df = df.filter(day >= F.to_date(F.lit(start))) if start else df
    return df.filter(day <= F.to_date(F.lit(end))) if end else df


def referential_subset(main: DataFrame, related: dict[str, tuple[DataFrame, str, str]], n: int, key: str, seed: int = 42) -> dict[str, DataFrame]:
    """A random subset of the main table, and of each related table (frame, its key, the main table's key) the rows that it refers to."""
    chosen = random_subset(main, n, key, seed)
    out = {"main": chosen}
    for name, (df, own, theirs) in related.items():
        out[name] = df.join(chosen.select(F.col(theirs).alias("__k")).distinct(), F.col(own) == F.col("__k"), "left_semi")
    return out


def star_subset(fact: DataFrame, dimensions: dict[str, tuple[DataFrame, str]], n: int, key: str, seed: int = 42) -> dict[str, DataFrame]:
    """A random subset of the fact and the dimension rows that it uses (frame, shared key)."""
    return referential_subset(fact, {d: (df, k, k) for d, (df, k) in dimensions.items()}, n, key, seed)


def top_n(df: DataFrame, n: int, order_by: Sequence[str]) -> DataFrame:
    return df.orderBy(*order_by).limit(n)


def systematic_subset(df: DataFrame, n: int, order_by: Sequence[str], start: int = 0) -> DataFrame:
    """Every k-th row from start, k = rows // n, n at most."""
    rows = ranked(df, order_by)
    step = max(1, df.count() // max(1, n))
    at = F.col("rank") - start
    return rows.filter((at >= 0) & (at % step == 0) & (F.floor(at / step) < n)).drop("rank")


# ---- similarity ------------------------------------------------------------------------------------------------------


def _shares(df: DataFrame, column: str, name: str) -> DataFrame:
    counts = df.groupBy(F.col(f"`{column}`").cast("string").alias("value")).agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(counts.agg(F.sum("n").alias("total")))).select("value", (F.col("n") / F.col("total")).alias(name))  # one row


def total_variation(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """similarity: 1 - half the summed differences of the values' shares."""
    x, y = _shares(a, column, "p"), _shares(b, column, "q")
    both = x.join(y, x["value"].eqNullSafe(y["value"]), "full")
    return both.agg(F.round(F.lit(1.0) - F.sum(F.abs(F.coalesce("p", F.lit(0.0)) - F.coalesce("q", F.lit(0.0)))) / 2, 3).alias("similarity"))


def categorical_similarity(a: DataFrame, b: DataFrame, column: str, eps: float = 1e-10) -> DataFrame:
    """similarity: 1 - the root of the Jensen-Shannon divergence (natural logarithm) of the non-null values' shares."""
    x, y = _shares(a.filter(F.col(f"`{column}`").isNotNull()), column, "p"), _shares(b.filter(F.col(f"`{column}`").isNotNull()), column, "q")
    both = x.join(y, "value", "full").select((F.coalesce("p", F.lit(0.0)) + eps).alias("p"), (F.coalesce("q", F.lit(0.0)) + eps).alias("q"))
    sums = both.agg(F.sum("p").alias("sp"), F.sum("q").alias("sq"))
    both = both.crossJoin(F.broadcast(sums)).select((F.col("p") / F.col("sp")).alias("p"), (F.col("q") / F.col("sq")).alias("q")).withColumn("m", (F.col("p") + F.col("q")) / 2)  # one row
    js = F.sum(F.col("p") * F.ln(F.col("p") / F.col("m")) + F.col("q") * F.ln(F.col("q") / F.col("m"))) / 2
    return both.agg(F.round(F.greatest(F.lit(0.0), F.lit(1.0) - F.sqrt(F.greatest(js, F.lit(0.0)))), 3).alias("similarity"))


def _near(a: Column, b: Column) -> Column:
    """1 - the relative difference to the first, 0 at least."""
    return F.greatest(F.lit(0.0), F.lit(1.0) - F.when(a == 0, F.when(b == 0, 0.0).otherwise(1.0)).otherwise(F.least(F.lit(1.0), F.abs(a - b) / F.abs(a))))


def numeric_similarity(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, similarity: mean of the nearness of mean, deviation and median, and of 1 - twice the difference of null shares."""

    from brindle.operators.validate import exact_median

    def stats(df: DataFrame, tag: str) -> DataFrame:
        m = {c: {f"mean_{tag}": F.avg(F.col(f"`{c}`").cast("double")), f"std_{tag}": F.stddev_samp(F.col(f"`{c}`").cast("double")), f"null_{tag}": F.avg(F.col(f"`{c}`").isNull().cast("double"))} for c in columns}
        values = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("v")) for c in columns))).alias("x")).select("x.*")
        return stacked(df, m).join(exact_median(values).withColumnRenamed("median", f"median_{tag}"), "column", "left")

    both = stats(a, "a").join(stats(b, "b"), "column")
    parts = [_near(F.coalesce(F.col(f"{s}_a"), F.lit(0.0)), F.coalesce(F.col(f"{s}_b"), F.lit(0.0))) for s in ("mean", "std", "median")]
    parts.append(F.greatest(F.lit(0.0), F.lit(1.0) - 2 * F.abs(F.col("null_a") - F.col("null_b"))))
    return both.select("column", F.round(sum(parts, F.lit(0.0)) / 4, 3).alias("similarity"))


def temporal_similarity(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """similarity: days that b spans over days that a spans, 1 at most."""
    days = lambda df, n: df.agg(F.datediff(F.max(F.to_date(F.col(f"`{column}`"))), F.min(F.to_date(F.col(f"`{column}`")))).cast("double").alias(n))
    both = days(a, "x").crossJoin(days(b, "y"))  # one row each
    return both.select(F.round(F.when(F.col("x") > 0, F.least(F.lit(1.0), F.col("y") / F.col("x"))).otherwise(1.0), 3).alias("similarity"))


def boolean_similarity(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """similarity: 1 - twice the difference of the shares of true, 0 at least."""
    rate = lambda df, n: df.agg(F.avg(F.col(f"`{column}`").cast("int")).alias(n))
    return rate(a, "x").crossJoin(rate(b, "y")).select(F.round(F.greatest(F.lit(0.0), 1 - 2 * F.abs(F.coalesce("x", F.lit(0.0)) - F.coalesce("y", F.lit(0.0)))), 3).alias("similarity"))  # one row each


#: Grades of a mean similarity.
SIMILARITY_GRADES = (("A", 0.9), ("B", 0.8), ("C", 0.7), ("D", 0.6), ("F", 0.0))


def compare_distributions(a: DataFrame, b: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """column, type, similarity of common columns."""
    from brindle.operators.profile import union_all

    fields = {f.name: f.dataType for f in a.schema.fields if f.name in b.columns and (not columns or f.name in columns)}
    numbers = [c for c, t in fields.items() if is_number(t)]
    out = [numeric_similarity(a, b, numbers).select("column", F.lit("numeric").alias("type"), "similarity")] if numbers else []
    for c, t in fields.items():
        if c in numbers:
            continue
        kind = "boolean" if isinstance(t, T.BooleanType) else "temporal" if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)) else "categorical"
        make = {"boolean": boolean_similarity, "temporal": temporal_similarity, "categorical": categorical_similarity}[kind]
        out.append(make(a, b, c).select(F.lit(c).alias("column"), F.lit(kind).alias("type"), "similarity"))
    return union_all(out)


def distribution_summary(compared: DataFrame) -> dict:
    rows = compared.collect()  # a row a column
    mean = sum(r.similarity for r in rows) / len(rows) if rows else 1.0
    poor = sorted(r["column"] for r in rows if r.similarity < 0.7)
    return {"overall_similarity": round(mean, 3), "grade": next(g for g, low in SIMILARITY_GRADES if mean >= low), "columns": {r["column"]: r.similarity for r in rows}, "recommendations": [f"Draw more rows or stratify by {c}" for c in poor] or ["The subset represents the source"]}
