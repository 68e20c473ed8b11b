"""Mapping between tables: discovery by value overlap, exact then fuzzy lookups, amounts by group, structure comparison."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.functions.similarity import indel_ratio_column
from brindle.operators.relationships import overlaps
from brindle.sources import files

#: Names of hierarchy columns and words of aggregation lines.
HIERARCHY_NAMES = re.compile(r"level|lvl|tier|depth|parent|header|group|category", re.IGNORECASE)
TOTAL_WORDS = r"(?i)total|sum|subtotal"


def trimmed(df: DataFrame, column: str, name: str) -> DataFrame:
    return df.select(F.trim(F.col(f"`{column}`").cast("string")).alias(name)).filter(f"{name} <> ''")


def grams(c):
    """The letter pairs of a text with its ends marked, each with how often it came before: as a set they count repeats."""
    s = F.concat(F.lit("^"), c, F.lit("$"))
    pairs = F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: F.substr(s, i, F.lit(2)))
    return F.transform(pairs, lambda g, i: F.concat(g, F.size(F.filter(F.slice(pairs, F.lit(1), i + 1), lambda h: h == g)).cast("string")))


def _rare_grams(values: DataFrame, name: str, order: DataFrame, least: float) -> DataFrame:
    """(name, length, g): of each value's pairs the rarest ones, as many as a partner of the least ratio must share one of.

    A partner of length m shares l = least * (n + m) / 2 letters in order at least; n - l letters taken out of the value cost two of its pairs
    each, m - l put in cost one: the most over all m >= least * n / (2 - least) is what may be lost."""
    lost = f"floor(greatest(0, {2 - 1.5 * least!r} * n + {1 - 1.5 * least!r} * n * {least / (2 - least)!r}) + 1e-9)"
    rows = values.withColumn("n", F.length(name)).withColumn("g", F.explode(grams(F.col(name)))).join(order, "g")
    nth = F.row_number().over(Window.partitionBy(name).orderBy("df", "g"))
    return rows.withColumn("nth", nth).filter(f"nth <= {lost} + 1").select(name, "n", "g")


def fuzzy_matches(left: DataFrame, right: DataFrame, left_col: str, right_col: str, least: float = 0.8) -> DataFrame:
    """source, target, ratio: for each distinct left value its best right value by Indel ratio of at least `least` (ties: the smaller).

    Above a ratio of 2/3, candidates share one of their rare letter pairs (prefixes by rarity, as many as the ratio needs), and their lengths allow
    it; at most 2/3, two values may share no pair, and candidates share a letter.  The ratio itself is computed for candidates only."""
    a = trimmed(left, left_col, "source").distinct()
    b = trimmed(right, right_col, "target").distinct()
    if least > 2 / 3 + 1e-3:
        bound = least - 1e-4  # ratios are rounded
        pairs_of = lambda d, c: d.select(F.explode(grams(F.col(c))).alias("g"))
        order = pairs_of(a, "source").unionByName(pairs_of(b, "target")).groupBy("g").agg(F.count("*").alias("df"))
        x, y = _rare_grams(a, "source", order, bound).withColumnRenamed("n", "la"), _rare_grams(b, "target", order, bound).withColumnRenamed("n", "lb")
    else:
        single = lambda c: F.explode(F.array_distinct(F.split(c, "")))
        x = a.withColumn("la", F.length("source")).withColumn("g", single(F.col("source")))
        y = b.withColumn("lb", F.length("target")).withColumn("g", single(F.col("target")))
    allowed = F.abs(F.col("la") - F.col("lb")) <= (1 - least) * (F.col("la") + F.col("lb")) + 1e-9
    pairs = x.join(y, "g").filter(allowed).select("source", "target").distinct()
    scored = pairs.withColumn("ratio", F.round(indel_ratio_column(F.col("source"), F.col("target")) / 100.0, 4)).filter(F.col("ratio") >= least)
    return scored.groupBy("source").agg(F.min_by(F.struct("target", "ratio"), F.struct(-F.col("ratio"), F.col("target"))).alias("m")).select("source", "m.target", "m.ratio")


def discover(tables: dict[str, DataFrame], threshold: float = 0.7, source: str | None = None, fuzzy: bool = False) -> DataFrame:
    """source_file, source_column, target_file, target_column, match_type, match_confidence: columns whose distinct values are found in another column
    for more than the threshold: exactly, or else (with fuzzy, between text columns) by fuzzy match of all distinct values."""
    found = overlaps(tables, 1)
    flip = found.select(
        F.col("target_table").alias("source_table"), F.col("target_column").alias("source_column"), F.col("source_table").alias("target_table"), F.col("source_column").alias("target_column"), F.col("distinct_b").alias("distinct_a"), "shared"
    )
    both = found.select(*flip.columns).unionByName(flip).withColumn("r", F.col("shared") / F.col("distinct_a"))
    if source:
        both = both.filter(F.col("source_table") == source)
    shape = ["source_file", "source_column", "target_file", "target_column", "match_type", "match_confidence"]
    exact = both.filter(F.col("r") > threshold).select(F.col("source_table").alias(shape[0]), "source_column", F.col("target_table").alias(shape[2]), "target_column", F.lit("exact").alias(shape[4]), F.round("r", 2).alias(shape[5]))
    if not fuzzy:
        return exact
    texts = {n: [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)] for n, df in tables.items()}
    near = None
    for a in tables if source is None else [source]:
        for b in (n for n in tables if n != a):
            for x in texts[a]:
                for y in texts[b]:
                    n = trimmed(tables[a], x, "source").distinct().agg(F.count("*").alias("n"))
                    hit = fuzzy_matches(tables[a], tables[b], x, y, threshold).agg(F.count("*").alias("k")).crossJoin(n)  # one row each
                    row = hit.select(F.lit(a).alias(shape[0]), F.lit(x).alias(shape[1]), F.lit(b).alias(shape[2]), F.lit(y).alias(shape[3]), F.lit("fuzzy").alias(shape[4]), F.round(F.try_divide(F.col("k"), F.col("n")), 2).alias(shape[5]))
                    near = row if near is None else near.unionByName(row)
    if near is None:
        return exact
    return exact.unionByName(near.filter(F.col(shape[5]) > threshold).join(exact.select(*shape[:4]), shape[:4], "left_anti"))


def fuzzy_column_match(left: DataFrame, right: DataFrame, left_col: str, right_col: str, threshold: float = 0.7) -> float:
    """The share of distinct left values that have a fuzzy match."""
    n = trimmed(left, left_col, "source").distinct().count()
    return fuzzy_matches(left, right, left_col, right_col, threshold).count() / n if n else 0.0


def hierarchy_columns(df: DataFrame) -> dict:
    """Columns named like a hierarchy's, and text columns with aggregation lines."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    hits = df.agg(*(F.bool_or(F.col(f"`{c}`").rlike(TOTAL_WORDS)).alias(c) for c in texts)).first() if texts else {}
    return {"columns": [c for c in df.columns if HIERARCHY_NAMES.search(c)], "aggregation_columns": [c for c in texts if hits[c]]}


def suggest_join_paths(found: DataFrame, least: float = 0.9) -> DataFrame:
    return found.filter(F.col("match_confidence") >= least)


class Mappings:
    """Named value mappings kept as one JSON file, in any place that Spark reaches."""

    def __init__(self, path: str, spark: SparkSession | None = None):
        self.path, self.spark = path, spark or SparkSession.active()
        self.held = json.loads(files.read_text(self.spark, path)) if files.exists(self.spark, path) else {}

    def _save(self) -> None:
        files.write_text(self.spark, self.path, json.dumps(self.held, indent=1, sort_keys=True))

    def define(self, name: str, values: dict[str, str], description: str = "") -> None:
        self.held[name] = {"values": values, "description": description}
        self._save()

    def get(self, name: str) -> dict:
        return self.held[name]

    def delete(self, name: str) -> bool:
        there = self.held.pop(name, None) is not None
        self._save()
        return there

    def list(self) -> list[str]:
        return sorted(self.held)

    def apply(self, df: DataFrame, name: str, column: str, to: str, default: str | None = None) -> DataFrame:
        values = self.held[name]["values"]
        if not values:
            return df.withColumn(to, F.lit(default).cast("string"))
        table = F.create_map(*(F.lit(x) for kv in values.items() for x in kv))
        return df.withColumn(to, F.coalesce(table[F.trim(F.col(f"`{column}`").cast("string"))], F.lit(default)))


# ---- amounts -----------------------------------------------------------------------------------------------------------


def last_mapping(mapping: DataFrame, source_col: str, target_col: str, order_by: str | None = None) -> DataFrame:
    """(value, target): blanks skipped, trimmed; of repeated values the last by order_by counts (else the greatest target)."""
    m = mapping.select(F.trim(F.col(f"`{source_col}`").cast("string")).alias("value"), F.trim(F.col(f"`{target_col}`").cast("string")).alias("target"), *([F.col(order_by).alias("o")] if order_by else []))
    m = m.filter("value <> '' AND target <> ''")
    return m.groupBy("value").agg((F.max_by("target", F.struct("o", "target")) if order_by else F.max("target")).alias("target"))


def group_amounts(source: DataFrame, amount_col: str, group_col: str, mapping: DataFrame | None = None, fuzzy: float | None = None) -> DataFrame:
    """group, total (rounded to 2 digits), count, mapped: amounts by group, or by the group's target where a mapping (value, target) has one.

    The source is summed by its distinct values first; the lookup, exact and then fuzzy, sees distinct values only."""
    value = F.trim(F.col(f"`{group_col}`").cast("string"))
    sums = source.groupBy(value.alias("value")).agg(F.sum(F.col(f"`{amount_col}`").cast(T.DecimalType(18, 2))).alias("t"), F.count("*").alias("n"))
    if mapping is None:
        return sums.select(F.col("value").alias("group"), F.round(F.col("t").cast("double"), 2).alias("total"), F.col("n").alias("count"), F.lit(True).alias("mapped"))
    out = sums.join(mapping, "value", "left")
    if fuzzy is not None:
        near = fuzzy_matches(out.filter("target IS NULL"), mapping, "value", "value", fuzzy).select(F.col("source").alias("value"), F.col("target").alias("as_value"))
        near = near.join(mapping.select(F.col("value").alias("as_value"), F.col("target").alias("near")), "as_value").select("value", "near")
        out = out.join(near, "value", "left").withColumn("target", F.coalesce("target", "near"))
    groups = out.groupBy(F.coalesce("target", F.lit("(unmapped)")).alias("group")).agg(F.round(F.sum("t").cast("double"), 2).alias("total"), F.sum("n").alias("count"), F.bool_and(F.col("target").isNotNull()).alias("mapped"))
    return groups


def check_amounts(groups: DataFrame, rule: dict, tolerance: float = 0.01) -> DataFrame:
    """left_sum, right_sum, difference, passed for sum_equals {left, right}, difference_equals {left, right, expected}, groups_balance {left, right}
    or ratio_in_range {left, right, min, max} (difference is then the ratio); left and right are lists of groups."""
    total = lambda names: F.round(F.coalesce(F.sum(F.when(F.col("group").isin(*names), F.col("total"))), F.lit(0.0)), 4)
    sums = groups.agg(total(rule["left"]).alias("left_sum"), total(rule["right"]).alias("right_sum"))
    kind = rule["type"]
    diff = F.col("left_sum") - F.col("right_sum")
    if kind == "sum_equals":
        value, passed = diff, F.abs(diff) <= tolerance
    elif kind == "difference_equals":
        value, passed = diff, F.abs(diff - rule["expected"]) <= tolerance
    elif kind == "groups_balance":
        value = F.col("left_sum") + F.col("right_sum")
        passed = F.abs(value) <= tolerance
    elif kind == "ratio_in_range":
        value = F.try_divide("left_sum", "right_sum")
        passed = F.coalesce(value.between(rule["min"], rule["max"]), F.lit(False))
    else:
        raise ValueError(f"unknown rule {kind!r}")
    return sums.select(F.lit(kind).alias("rule"), "left_sum", "right_sum", F.round(value, 4).alias("difference"), passed.alias("passed"))


def coverage(groups: DataFrame) -> DataFrame:
    """rows, mapped_rows, coverage_pct of grouped amounts."""
    return groups.agg(F.sum("count").alias("rows"), F.coalesce(F.sum(F.when(F.col("mapped"), F.col("count"))), F.lit(0)).alias("mapped_rows")).withColumn("coverage_pct", F.round(F.coalesce(F.try_divide(F.col("mapped_rows") * 100.0, F.col("rows")), F.lit(0.0)), 2))


def compare_structures(left: DataFrame, right: DataFrame, left_col: str, right_col: str) -> DataFrame:
    """value, status (both, left_only, right_only) of trimmed distinct values."""
    a = trimmed(left, left_col, "value").distinct().withColumn("l", F.lit(True))
    b = trimmed(right, right_col, "value").distinct().withColumn("r", F.lit(True))
    return a.join(b, "value", "full").select("value", F.when(F.col("l") & F.col("r"), "both").when(F.col("l"), "left_only").otherwise("right_only").alias("status"))


def any_of(columns: Sequence[str], words: Sequence[str]) -> str | None:
    return next((c for c in columns if any(w in c.lower() for w in words)), None)
