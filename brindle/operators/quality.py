"""Quality scores in six dimensions: two fused passes over the table, then arithmetic on one small row."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

import yaml
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.operators.profile import is_number, stacked, with_counts

#: Weights of the dimensions, grade bounds, common patterns.
WEIGHTS = {"completeness": 0.25, "uniqueness": 0.20, "validity": 0.20, "accuracy": 0.15, "consistency": 0.10, "timeliness": 0.10}
GRADES = (("A+", 97), ("A", 93), ("A-", 90), ("B+", 87), ("B", 83), ("B-", 80), ("C+", 77), ("C", 73), ("C-", 70), ("D+", 67), ("D", 63), ("D-", 60), ("F", 0))
COMMON_PATTERNS = {
    "email": r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$",
    "phone_us": r"^\+?1?[-.\s]?\(?[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}$",
    "phone_intl": r"^\+[1-9]\d{1,14}$",
    "zip_us": r"^\d{5}(-\d{4})?$",
    "ssn": r"^\d{3}-?\d{2}-?\d{4}$",
    "credit_card": r"^\d{4}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}$",
    "url": r"^https?://[^\s/$.?#].[^\s]*$",
    "ip_v4": r"^(\d{1,3}\.){3}\d{1,3}$",
    "uuid": r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    "date_iso": r"^\d{4}-\d{2}-\d{2}$",
    "currency": r"^\$?\d{1,3}(,\d{3})*(\.\d{2})?$",
}


def grade(score: float, legacy: bool = False) -> str:
    """The first grade whose bound the score reaches; legacy: bounds hold for whole numbers, and scores between two grades are F."""
    name = next(g for g, low in GRADES if score >= low) if score >= 0 else "F"
    if legacy and name not in ("A+", "F"):
        upper = GRADES[[g for g, _ in GRADES].index(name) - 1][1] - 1
        return name if score <= upper else "F"
    return name


# ---- rules -----------------------------------------------------------------------------------------------------------


@dataclass
class Rules:
    """columns: per column not_null, max_null_pct, unique, min, max, values, pattern, min_length, max_length, severity;
    checks: date_order {start, end} and sum_equals {columns, total, tolerance}; date_column and max_age_days for timeliness."""

    columns: dict[str, dict] = field(default_factory=dict)
    checks: list[dict] = field(default_factory=list)
    keys: list[str] = field(default_factory=list)
    date_column: str | None = None
    max_age_days: int = 365

    @staticmethod
    def from_yaml(text: str) -> Rules:
        return Rules(**{k: v for k, v in (yaml.safe_load(text) or {}).items() if k in Rules.__dataclass_fields__})

    def to_yaml(self) -> str:
        return yaml.safe_dump(asdict(self), sort_keys=True)


class RuleBuilder:
    """Rules by chained calls."""

    def __init__(self):
        self.rules = Rules()

    def _set(self, column: str, **p) -> RuleBuilder:
        self.rules.columns.setdefault(column, {}).update({k: v for k, v in p.items() if v is not None})
        return self

    def require_not_null(self, column: str, max_null_pct: float = 0.0, severity: str = "warning") -> RuleBuilder:
        return self._set(column, not_null=True, max_null_pct=max_null_pct, severity=severity)

    def require_unique(self, column: str, severity: str = "warning") -> RuleBuilder:
        self.rules.keys.append(column)
        return self._set(column, unique=True, severity=severity)

    def require_range(self, column: str, min_val=None, max_val=None) -> RuleBuilder:
        return self._set(column, min=min_val, max=max_val)

    def require_values(self, column: str, values: Sequence) -> RuleBuilder:
        return self._set(column, values=list(values))

    def require_pattern(self, column: str, pattern: str) -> RuleBuilder:
        return self._set(column, pattern=COMMON_PATTERNS.get(pattern, pattern))

    def require_length(self, column: str, min_length: int | None = None, max_length: int | None = None) -> RuleBuilder:
        return self._set(column, min_length=min_length, max_length=max_length)

    def require_date_order(self, start: str, end: str) -> RuleBuilder:
        self.rules.checks.append({"type": "date_order", "start": start, "end": end})
        return self

    def require_freshness(self, column: str, max_age_days: int = 365) -> RuleBuilder:
        self.rules.date_column, self.rules.max_age_days = column, max_age_days
        return self

    def build(self) -> Rules:
        return self.rules


def domain_rules(domain: str) -> Rules:
    """Default rules of a business domain."""
    needs = {
        "financial": (["!account_id", "amount", "transaction_date"], ["transaction_id"], {"amount": 0}),
        "sales": (["!order_id", "customer_id", "order_date"], ["order_id"], {"quantity": 1, "unit_price": 0}),
        "healthcare": (["!patient_id", "encounter_date"], ["encounter_id"], {}),
        "hr": (["!employee_id"], ["employee_id"], {"salary": 0}),
    }
    b = RuleBuilder()
    present, single, least = needs.get(domain, ([], [], {}))
    for c in present:
        b.require_not_null(c.lstrip("!"), severity="critical" if c[0] == "!" else "warning")
    for c in single:
        b.require_unique(c, severity="critical")
    for c, low in least.items():
        b.require_range(c, min_val=low)
    return b.build()


# ---- scores ----------------------------------------------------------------------------------------------------------


def _invalid(c, p: dict):
    """How many ways a value breaks its rules (a row may count several times, as violations add up)."""
    bad = [c < p["min"]] if "min" in p else []
    bad += [c > p["max"]] if "max" in p else []
    bad += [~c.isin(*p["values"])] if "values" in p else []
    bad += [~c.cast("string").rlike(p["pattern"])] if "pattern" in p else []
    n = F.length(c.cast("string"))
    bad += [n < p["min_length"]] if "min_length" in p else []
    bad += [n > p["max_length"]] if "max_length" in p else []
    return bad


def column_metrics(df: DataFrame, rules: Rules) -> DataFrame:
    """column, rows, nulls, unique_count, mean, std (population), invalid (null without value rules): one pass and one shuffle of values."""
    measures = {}
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        bad = _invalid(c, rules.columns.get(f.name, {}))
        number = is_number(f.dataType)
        measures[f.name] = {
            "rows": F.count(F.lit(1)),
            "nulls": F.count_if(c.isNull()),
            "mean": F.avg(c.cast("double")) if number else F.max(F.lit(None).cast("double")),
            "std": F.stddev_pop(c.cast("double")) if number else F.max(F.lit(None).cast("double")),
            "present": F.count(c),
            "invalid": F.sum(sum((F.coalesce(b.cast("long"), F.lit(0)) for b in bad), F.lit(0))) if bad else F.max(F.lit(None).cast("long")),
        }
    return with_counts(stacked(df, measures), df)


def _auto_checks(df: DataFrame, rules: Rules) -> list[dict]:
    if rules.checks:
        return rules.checks
    starts = [c for c in df.columns if c.lower().startswith("start")]
    return [{"type": "date_order", "start": s, "end": e} for s in starts for e in df.columns if e.lower() == "end" + s.lower()[5:]]


def quality_scores(df: DataFrame, rules: Rules | None = None, reference_date: str | None = None, dimensions: Sequence[str] = tuple(WEIGHTS)) -> DataFrame:
    """dimension, score, weight, weighted_contribution (both rounded to 2 digits) for the dimensions asked for.

    completeness: mean of 100 - null percent; uniqueness: mean of the share of rows that aren't copies and of the columns' distinct
    shares; validity: mean share of valid values over columns with value rules; accuracy: 100 - twice the percentage of values over
    three deviations off (30 at most; columns with over ten values); consistency: share of checks that hold; timeliness: by the age
    of the newest date."""
    rules = rules or Rules()
    cols = column_metrics(df, rules)
    n = F.col("rows")
    parts = cols.agg(
        F.avg(F.lit(100.0) - F.col("nulls") * 100.0 / n).alias("completeness"),
        F.avg(F.col("unique_count") * 100.0 / n).alias("distinct_share"),
        F.avg(F.when(F.col("invalid").isNotNull(), F.greatest(F.lit(0), n - F.col("invalid")) * 100.0 / n)).alias("validity"),
        F.max(n).alias("n"),
    )
    numbers = [f.name for f in df.schema.fields if is_number(f.dataType)]
    limits = cols.filter("std IS NOT NULL AND present > 10").select("column", "mean", "std")
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("double").alias("v")) for c in numbers)) if numbers else F.array().cast("array<struct<column:string,v:double>>")).alias("p")).select("p.*").filter("v IS NOT NULL")
    off = F.count_if((F.col("std") > 0) & (F.abs(F.col("v") - F.col("mean")) > 3 * F.col("std")))
    accuracy = long.join(F.broadcast(limits), "column").groupBy("column").agg(off.alias("off"), F.count("*").alias("held"))  # a row a column
    accuracy = accuracy.agg(F.coalesce(F.avg(F.lit(100.0) - F.least(F.lit(30.0), F.col("off") * 200.0 / F.col("held"))), F.lit(100.0)).alias("accuracy"))
    copies = df.groupBy(*(F.col(f"`{c}`") for c in df.columns)).agg(F.lit(1).alias("one")).agg(F.count("*").alias("rows_once"))
    checks = _auto_checks(df, rules)
    held = []
    for c in checks:
        if c["type"] == "date_order":
            held.append(F.coalesce(F.sum((F.col(f"`{c['start']}`") <= F.col(f"`{c['end']}`")).cast("long")), F.lit(0)))
        else:
            total = sum((F.coalesce(F.col(f"`{x}`").cast("double"), F.lit(0.0)) for x in c["columns"]), F.lit(0.0))
            held.append(F.coalesce(F.sum((F.abs(total - F.col(f"`{c['total']}`")) <= c.get("tolerance", 0.01)).cast("long")), F.lit(0)))
    known = [F.count(F.when(F.col(f"`{c['start']}`").isNotNull() & F.col(f"`{c['end']}`").isNotNull(), 1)) if c["type"] == "date_order" else F.count(F.col(f"`{c['total']}`")) for c in checks]
    consistent = F.coalesce(F.try_divide(sum(held, F.lit(0)) * 100.0, sum(known, F.lit(0))), F.lit(100.0)) if checks else F.max(F.lit(100.0))
    today = F.to_date(F.lit(reference_date)) if reference_date else F.current_date()
    age = F.datediff(today, F.max(F.to_date(F.col(f"`{rules.date_column}`")))).cast("double") if rules.date_column else F.max(F.lit(None).cast("double"))
    more = df.agg(consistent.alias("consistency"), age.alias("age"))
    m = F.lit(float(rules.max_age_days))
    timely = F.when(F.col("age").isNull(), 100.0).when(F.col("age") > m, F.greatest(F.lit(0.0), 100.0 - (F.col("age") - m) / m * 100.0)).otherwise(F.greatest(F.lit(80.0), 100.0 - F.col("age") / m * 20.0))
    one = parts.crossJoin(accuracy).crossJoin(copies).crossJoin(more)  # one row each
    unique = (F.coalesce(F.col("rows_once") * 100.0 / F.col("n"), F.lit(100.0)) + F.col("distinct_share")) / 2
    scores = {"completeness": F.col("completeness"), "uniqueness": unique, "validity": F.coalesce("validity", F.lit(100.0)), "accuracy": F.col("accuracy"), "consistency": F.col("consistency"), "timeliness": timely}
    rows = F.array(*(F.struct(F.lit(d).alias("dimension"), F.round(F.coalesce(scores[d], F.lit(100.0)), 2).alias("score"), F.lit(WEIGHTS[d]).alias("weight")) for d in dimensions))
    return one.select(F.explode(rows).alias("r")).select("r.*").withColumn("weighted_contribution", F.round(F.col("score") * F.col("weight"), 2))


def overall(scores: DataFrame) -> dict:
    """overall_score (contributions of the dimensions asked for, not renormalised), normalized_score, grade, recommendations."""
    rows = scores.collect()  # six rows at most
    total, weight = sum(r.weighted_contribution for r in rows), sum(r.weight for r in rows)
    return {"overall_score": round(total, 2), "normalized_score": round(total / weight, 2) if weight else 0.0, "grade": grade(total), "dimensions": {r.dimension: r.score for r in rows}, "recommendations": recommendations({r.dimension: r.score for r in rows})}


ADVICE = {
    "completeness": "Fill or explain missing values in the emptiest columns",
    "uniqueness": "Remove repeated rows and check keys",
    "validity": "Look at values outside their allowed ranges, lists or patterns",
    "accuracy": "Look at values far from the mean",
    "consistency": "Look at rows whose dates or sums contradict each other",
    "timeliness": "Load newer records",
}


def recommendations(scores: dict[str, float], below: float = 80.0) -> list[str]:
    return [ADVICE[d] for d, s in sorted(scores.items(), key=lambda x: x[1]) if s < below][:10]


def quality_issues(df: DataFrame, rules: Rules | None = None) -> DataFrame:
    """severity, dimension, column, issue_type, affected_rows, affected_percentage."""
    rules = rules or Rules()
    cols = column_metrics(df, rules)
    text = lambda get, other: F.coalesce(F.create_map(*(x for c in df.columns for x in (F.lit(c), F.lit(get(rules.columns.get(c, {})))))) [F.col("column")], F.lit(other))
    pct = F.round(F.coalesce(F.try_divide(F.col("bad") * 100.0, F.col("rows")), F.lit(0.0)), 2)
    severity = F.when(F.col("affected_percentage") > 20, "critical").when(F.col("affected_percentage") > 5, "warning").otherwise("info")
    shape = lambda f, d, kind, sev: f.withColumn("affected_percentage", pct).select(sev.alias("severity"), F.lit(d).alias("dimension"), "column", F.lit(kind).alias("issue_type"), F.col("bad").alias("affected_rows"), "affected_percentage")
    allowed = text(lambda p: float(p.get("max_null_pct", 0.0)), 0.0)
    nulls = shape(cols.withColumn("bad", F.col("nulls")).filter(F.col("bad") * 100.0 > allowed * F.col("rows")), "completeness", "missing_values", severity)
    keys = shape(cols.filter(F.col("column").isin(*(rules.keys or [""]))).withColumn("bad", F.col("rows") - F.col("unique_count")).filter("bad > 0"), "uniqueness", "duplicate_keys", F.lit("critical"))
    wrong = shape(cols.withColumn("bad", F.col("invalid")).filter("bad > 0"), "validity", "invalid_values", severity)
    return nulls.unionByName(keys).unionByName(wrong)


def compare_quality(before: DataFrame, after: DataFrame) -> DataFrame:
    """dimension, score_before, score_after, change, direction (improved or declined by over 1, else unchanged) of two score tables."""
    a, b = before.select("dimension", F.col("score").alias("score_before")), after.select("dimension", F.col("score").alias("score_after"))
    out = a.join(F.broadcast(b), "dimension").withColumn("change", F.round(F.col("score_after") - F.col("score_before"), 2))  # six rows
    return out.withColumn("direction", F.when(F.col("change") > 1, "improved").when(F.col("change") < -1, "declined").otherwise("unchanged"))


def verdict(change: float) -> str:
    return "significant improvement" if change > 5 else "improvement" if change > 1 else "significant decline" if change < -5 else "decline" if change < -1 else "no significant change"
