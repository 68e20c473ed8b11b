"""Generators: date, business and currency dimensions, facts, time series, correlated columns, rates and star schemas.

Every value is a function of seed, column and row number, so a table is the same however it is partitioned.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from datetime import date, timedelta

import yaml
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.functions import distributions, rng
from brindle.functions.distributions import clip
from brindle.functions.text import padded
from brindle.operators import anonymize
from brindle.plans import specs

# ---- dates ---------------------------------------------------------------------------------------------------------


def dates(spark: SparkSession, start: str, end: str, step: str = "day", column: str = "date") -> DataFrame:
    """One row a date; step: day, weekday, week or month."""
    unit = {"weekday": "day"}.get(step, step)
    df = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(start)), F.to_date(F.lit(end)), F.expr(f"INTERVAL 1 {unit}"))).alias(column))
    return df.filter(F.weekday(column) < 5) if step == "weekday" else df


def date_dimension(spark: SparkSession, start: str, end: str, fiscal_start: int = 1, holidays: bool = False, country: str = "US") -> DataFrame:
    """A row a day with calendar and fiscal parts; a fiscal year is named after the year in which it ends."""
    d = F.col("full_date")
    names = lambda pool, n: F.element_at(F.array(*map(F.lit, pool)), n)
    month, day = F.month(d), F.weekday(d) + 1
    fmonth = F.pmod(month - fiscal_start, F.lit(12)) + 1 if fiscal_start != 1 else month
    fyear = F.year(d) + F.when(month >= fiscal_start, 1).otherwise(0) if fiscal_start != 1 else F.year(d)
    out = dates(spark, start, end, column="full_date").select(
        F.date_format(d, "yyyyMMdd").cast("int").alias("date_key"),
        d,
        F.year(d).alias("year"),
        F.quarter(d).alias("quarter"),
        month.alias("month"),
        names(specs.MONTHS, month).alias("month_name"),
        F.substring(names(specs.MONTHS, month), 1, 3).alias("month_name_short"),
        F.weekofyear(d).alias("week"),
        F.dayofmonth(d).alias("day_of_month"),
        day.alias("day_of_week"),
        names(specs.WEEKDAYS, day).alias("day_name"),
        F.substring(names(specs.WEEKDAYS, day), 1, 3).alias("day_name_short"),
        F.dayofyear(d).alias("day_of_year"),
        (day >= 6).alias("is_weekend"),
        (day < 6).alias("is_weekday"),
        F.date_format(d, "yyyy-MM").alias("year_month"),
        F.concat(F.year(d).cast("string"), F.lit("-Q"), F.quarter(d).cast("string")).alias("year_quarter"),
        fyear.alias("fiscal_year"),
        (F.floor((fmonth - 1) / 3) + 1).cast("int").alias("fiscal_quarter"),
        fmonth.cast("int").alias("fiscal_month"),
    )
    if not holidays:
        return out
    table = F.create_map(*(F.lit(x) for (m, n), name in specs.US_HOLIDAYS.items() for x in (f"{m:02d}-{n:02d}", name))) if country.upper() == "US" else F.lit(None)
    name = table[F.date_format(d, "MM-dd")] if country.upper() == "US" else F.lit(None).cast("string")
    return out.withColumn("holiday_name", name).withColumn("is_holiday", F.col("holiday_name").isNotNull())


_ORDINALS = {"first": 0, "second": 1, "third": 2, "fourth": 3, "fifth": 4}


def event_days(rule: str, year: int, days: int = 1) -> list[date]:
    """The days of an event in a year: MM-DD, an ISO date, or <first..fifth|last>_<weekday>_<month> with an offset in days."""
    rule = str(rule)
    m = re.fullmatch(r"(\w+?)_(\w+?)_([a-z]+)([+-]\d+)?", rule)
    if m:
        month = [x.lower() for x in specs.MONTHS].index(m[3]) + 1
        weekday = specs.DAYS.index(m[2])
        every = [d for d in (date(year, month, 1) + timedelta(days=i) for i in range(31)) if d.month == month and d.weekday() == weekday]
        n = -1 if m[1] == "last" else _ORDINALS[m[1]]
        if n >= len(every):
            return []
        first = every[n] + timedelta(days=int(m[4] or 0))
    elif len(rule) == 5:
        first = date(year, *map(int, rule.split("-")))
    else:
        first = date.fromisoformat(rule)
        if first.year != year:
            return []
    return [first + timedelta(days=i) for i in range(days)]


def event_table(pattern: dict, first: int, last: int) -> dict[date, float]:
    """The largest multiplier of each day with an event."""
    out: dict[date, float] = {}
    for _, rule, factor, days in pattern.get("events", []):
        for year in range(first, last + 1):
            for d in event_days(rule, year, days):
                out[d] = max(out.get(d, 0.0), factor)
    return out


def special_event_dates(spark: SparkSession, pattern: dict, first: int, last: int) -> DataFrame:
    """event, date, multiplier."""
    rows = [(n, d, float(f)) for n, rule, f, days in pattern.get("events", []) for y in range(first, last + 1) for d in event_days(rule, y, days)]
    return spark.createDataFrame(rows, "event string, date date, multiplier double")


def time_pattern(name_or_spec: str | dict) -> dict:
    """A pattern by name, or a custom one with keys of any text form made whole numbers."""
    p = specs.TIME_PATTERNS[name_or_spec] if isinstance(name_or_spec, str) else dict(name_or_spec)
    for key in ("monthly_weights", "quarterly_weights", "hourly_weights"):
        if p.get(key):
            p = p | {key: {int(k): float(v) for k, v in p[key].items()}}
    return p


def load_time_patterns(text: str) -> dict[str, dict]:
    """Patterns from YAML: weights by month, quarter, hour and day_of_week, and special_events."""
    out = {}
    for name, p in (yaml.safe_load(text) or {}).items():
        events = [(e["name"], str(e["date"]), float(e.get("multiplier", 1)), int(e.get("duration_days", 1))) for e in p.get("special_events", [])]
        out[name] = time_pattern(p | {"events": events, "weekly_weights": p.get("day_of_week") or p.get("weekly_weights") or {}, "hourly_weights": p.get("daily_weights") or {}})
    return out


def list_time_patterns(category: str | None = None) -> list[dict]:
    return [{"name": n, "category": p["category"], "description": p["description"]} for n, p in specs.TIME_PATTERNS.items() if category in (None, p["category"])]


def _weights(table: dict, key: Column) -> Column:
    out = None
    for k, w in table.items():
        out = F.when(key == k, F.lit(float(w))) if out is None else out.when(key == k, F.lit(float(w)))
    return F.lit(1.0) if out is None else out.otherwise(1.0)


def series_value(pattern: dict, base: Column, day: Column, start: str, years: tuple[int, int], seed: int = 42, noise: bool = True) -> Column:
    """base times trend, month, quarter, weekday, event and clipped noise, then bounds and rounding."""
    n = F.datediff(day, F.to_date(F.lit(start))).cast("double")
    trend = {
        "linear": lambda: base + F.lit(float(pattern.get("slope", 0))) * n * base,
        "exponential": lambda: base * F.exp(F.lit(float(pattern.get("rate", 0))) * n),
        "logarithmic": lambda: base * (1 + F.lit(float(pattern.get("rate", 0))) * F.ln(n + 1)),
    }.get(pattern.get("trend"), lambda: base)
    v = trend() * _weights(pattern.get("monthly_weights") or {}, F.month(day)) * _weights(pattern.get("quarterly_weights") or {}, F.quarter(day))
    week = {specs.DAYS.index(d): w for d, w in (pattern.get("weekly_weights") or {}).items()}
    v = v * _weights(week, F.weekday(day))
    events = event_table(pattern, *years)
    if events:
        table = F.create_map(*(F.lit(x) for d, f in sorted(events.items()) for x in (d.isoformat(), f)))  # some dozen days a year
        v = v * F.coalesce(table[day.cast("string")], F.lit(1.0))
    std = pattern.get("noise_std", 0)
    if noise and std:
        v = v * clip(F.lit(1.0) + F.lit(float(std)) * rng.normal(seed, "noise", day), pattern.get("noise_min", 0.5), pattern.get("noise_max", 1.5))
    v = clip(v, pattern.get("min_value"), pattern.get("max_value"))
    return F.round(v, pattern["round_to"]) if pattern.get("round_to") is not None else v


def time_series(spark: SparkSession, pattern: str | dict, start: str, end: str, base: float = 100.0, grain: str = "day", seed: int = 42, noise: bool = True, extra: list[dict] = (), value_column: str = "value") -> DataFrame:
    """date (timestamp for grain hour) and value, and extra columns {name, type: choice, sequence or constant}."""
    p = time_pattern(pattern)
    years = (int(start[:4]), int(end[:4]))
    df = dates(spark, start, end, "day" if grain == "hour" else grain)
    df = df.withColumn(value_column, series_value(p, F.lit(float(base)), F.col("date"), start, years, seed, noise))
    if grain == "hour":
        hours = p.get("hourly_weights") or {h: 1.0 for h in range(24)}
        df = df.withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23)))).withColumn(value_column, F.col(value_column) * _weights(hours, F.col("hour")))
        df = df.select(F.expr("make_timestamp(year(date), month(date), day(date), hour, 0, 0)").alias("date"), value_column)
    for c in extra:
        at = F.datediff(F.to_date("date"), F.to_date(F.lit(start)))
        made = {"choice": lambda c=c: rng.weighted(rng.uniform(seed, c["name"], F.col("date")), c["values"], c.get("weights") or [1.0] * len(c["values"])), "sequence": lambda c=c, at=at: at + F.lit(c.get("start", 1)), "constant": lambda c=c: F.lit(c.get("value"))}[c.get("type", "constant")]
        df = df.withColumn(c["name"], made())
    return df


def apply_pattern(df: DataFrame, date_col: str, value_col: str, pattern: str | dict, seed: int = 42) -> DataFrame:
    """A value column made anew by a pattern around its mean."""
    p = time_pattern(pattern)
    one = df.agg(F.avg(value_col).alias("m"), F.min(F.to_date(date_col)).alias("a"), F.max(F.to_date(date_col)).alias("b")).first()
    if one.a is None:
        return df
    return df.withColumn(value_col, series_value(p, F.lit(float(one.m)), F.to_date(date_col), one.a.isoformat(), (one.a.year, one.b.year), seed))


# ---- values and dimensions -----------------------------------------------------------------------------------------------


def value(kind: str, name: str, key: Column, seed: int, unique: bool = False, low: float = 0, high: float = 1000) -> Column:
    """A column's value by generator name; unknown names give a word.  Unique ones hold the row number."""
    s = f"{name}.{kind}"
    pick = lambda pool, tag="": rng.pick(seed, s + tag, key, list(pool))
    number = lambda a, b, tag="": (rng.bits(seed, s + tag, key) % (b - a + 1) + a)
    text = lambda c: c.cast("string")
    title = lambda tag="": F.initcap(pick(specs.POOLS["word"], tag))
    day = lambda a, b: F.date_add(F.to_date(F.lit(a)), number(0, (date.fromisoformat(b) - date.fromisoformat(a)).days).cast("int"))
    made = {
        "integer": lambda: key + 1 if unique else number(int(low), int(high)),
        "decimal": lambda: F.round(distributions.uniform_between(rng.uniform(seed, s, key), low, high), 2),
        "float": lambda: F.round(distributions.uniform_between(rng.uniform(seed, s, key), low, high), 2),
        "boolean": lambda: rng.uniform(seed, s, key) < 0.5,
        "string": lambda: F.concat(F.lit(f"{name}_"), text(key + 1)),
        "date": lambda: day("2020-01-01", "2025-12-31"),
        "date_of_birth": lambda: day("1940-01-01", "2005-12-31"),
        "name": lambda: F.concat_ws(" ", pick(anonymize.FIRST_NAMES, ".f"), pick(anonymize.LAST_NAMES, ".l")),
        "first_name": lambda: pick(anonymize.FIRST_NAMES),
        "last_name": lambda: pick(anonymize.LAST_NAMES),
        "company": lambda: F.concat_ws(" ", pick(anonymize.LAST_NAMES, ".n"), pick(specs.POOLS["company_end"], ".e")),
        "email": lambda: F.concat(F.lower(pick(anonymize.FIRST_NAMES, ".f")), F.lit("."), text(key + 1), F.lit("@"), pick(anonymize.EMAIL_DOMAINS, ".d")),
        "phone": lambda: F.concat(F.lit("555-"), text(number(100, 999, ".a")), F.lit("-"), text(number(1000, 9999, ".b"))),
        "address": lambda: F.concat_ws(" ", text(number(1, 9999, ".h")), pick(anonymize.LAST_NAMES, ".s"), pick(anonymize.STREET_TYPES, ".t")),
        "city": lambda: pick(anonymize.CITIES),
        "zipcode": lambda: padded(number(501, 99_950), 5),
        "text": lambda: F.concat_ws(" ", *(pick(specs.POOLS["word"], f".{i}") for i in range(7))),
        "sentence": lambda: F.concat(title(".0"), F.lit(" "), F.concat_ws(" ", *(pick(specs.POOLS["word"], f".{i}") for i in range(1, 6))), F.lit(".")),
        "uuid": lambda: F.regexp_replace(F.md5(F.concat(F.lit(f"{seed}:{s}:"), text(key))), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"),
        "sku": lambda: F.concat(F.upper(F.substring(F.md5(F.concat(F.lit(f"{seed}:{s}:"), text(key))), 1, 3)), F.lit("-"), padded(key + 1, 5)),
        "product_name": lambda: F.concat_ws(" ", title(".w"), pick(specs.POOLS["edition"], ".e")),
    }
    if kind in made:
        return made[kind]()
    out = pick(specs.POOLS.get(kind, specs.POOLS["word"]))
    return F.when(key < len(specs.POOLS.get(kind, specs.POOLS["word"])), F.element_at(F.array(*map(F.lit, specs.POOLS.get(kind, specs.POOLS["word"]))), (key + 1).cast("int"))).otherwise(F.concat_ws("_", out, text(key))) if unique else out


def dimension(spark: SparkSession, template: str | list[dict], rows: int, seed: int = 42) -> DataFrame:
    """A dimension by template or by columns {name, generator or type, unique, values, weights, nullable (share of nulls), min, max}."""
    if isinstance(template, str):
        columns = [{"name": n, "generator": g.lstrip("!"), "unique": g[0] == "!"} for n, g in specs.DIMENSIONS[template]]
    else:
        columns = template
    key, out = F.col("id"), []
    for c in columns:
        if c.get("values"):
            v = rng.weighted(rng.uniform(seed, c["name"], key), c["values"], c.get("weights") or [1.0] * len(c["values"]))
        else:
            v = value(c.get("generator") or c.get("type", "string"), c["name"], key, seed, c.get("unique", False), c.get("min", 0), c.get("max", 1000))
        if c.get("nullable"):
            v = F.when(rng.uniform(seed, f"{c['name']}.null", key) >= (0.03 if c["nullable"] is True else c["nullable"]), v)
        out.append(v.alias(c["name"]))
    return spark.range(rows).select(*out)


def measure(name: str, kind: str, low: float, high: float, shape: str, key: Column, seed: int) -> Column:
    """A measure between low and high: uniform; normal around the middle (a sixth of the range as deviation); exponential from low (a quarter as
    scale); lognormal squeezed into the range by its logistic place, which needs no pass over the data."""
    width = high - low
    u, z = rng.uniform(seed, name, key), rng.normal(seed, name, key)
    v = {
        "uniform": lambda: distributions.uniform_between(u, low, high),
        "normal": lambda: F.lit(low + width / 2) + F.lit(width / 6) * z,
        "exponential": lambda: F.lit(float(low)) + distributions.exponential(u, width / 4),
        "lognormal": lambda: F.lit(float(low)) + F.lit(float(width)) * F.exp(z * 0.5) / (F.exp(z * 0.5) + 4),
    }[shape]()
    v = clip(v, low, high)
    return F.round(v).cast("long") if kind == "integer" else F.round(v, 4 if width <= 1 else 2)


def fact(spark: SparkSession, template: str, rows: int, dimension_sizes: dict[str, int] | None = None, date_range: tuple[str, str] | None = None, seed: int = 42) -> DataFrame:
    """A fact by template: its id, a foreign key (1..size) for each dimension, date_key within the range, measures and attributes."""
    spec, key = specs.FACTS[template], F.col("id")
    out = [(key + 1).alias(f"{template}_id")]
    out += [(rng.bits(seed, k, key) % n + 1).alias(k) for k, n in (dimension_sizes or {}).items()]
    if date_range:
        days = (date.fromisoformat(date_range[1]) - date.fromisoformat(date_range[0])).days + 1
        out.append(F.date_format(F.date_add(F.to_date(F.lit(date_range[0])), (rng.bits(seed, "date_key", key) % days).cast("int")), "yyyyMMdd").cast("int").alias("date_key"))
    out += [measure(n, k, a, b, s, key, seed).alias(n) for n, k, a, b, s in spec["measures"]]
    out += [rng.weighted(rng.uniform(seed, n, key), v, w).alias(n) for n, v, w in spec["attributes"]]
    return spark.range(rows).select(*out)


def weighted_keys(facts: DataFrame, dim: DataFrame, key: str, weight: str, to: str, row_key: str, seed: int = 42, buckets: int = 256) -> DataFrame:
    """A foreign key drawn by the dimension's weights: exact cumulative weights, and a range join by bins of about one key's share.

    Weights are summed in two levels (hash buckets, then keys within one), so no task sees the whole dimension; as decimals, so that each
    key's share begins where the one before ends.  Null, zero and negative weights are never drawn; without any other one the key is null."""
    from brindle.operators.relational import range_join

    w = dim.select(F.col(key).alias(to), F.col(weight).cast("decimal(28,9)").alias("__w")).filter("__w > 0").withColumn("__b", F.expr(f"pmod(xxhash64(`{to}`), {buckets})"))
    held = w.groupBy("__b").agg(F.sum("__w").alias("__held"), F.count("*").alias("__n"))
    one = held.agg(F.sum("__held").alias("t"), F.sum("__n").alias("n")).first()
    if not one.n:
        return facts.withColumn(to, F.lit(None).cast(dim.schema[key].dataType))
    upto = lambda c, *part: F.sum(c).over(Window.partitionBy(*part).orderBy("__b" if not part else to).rowsBetween(Window.unboundedPreceding, 0))
    bases = held.select("__b", (upto("__held") - F.col("__held")).alias("__base"))  # a row a bucket
    shares = w.withColumn("__upto", upto("__w", "__b")).join(bases, "__b")
    shares = shares.select(to, (F.col("__base") + F.col("__upto") - F.col("__w")).cast("double").alias("__low"), (F.col("__base") + F.col("__upto")).cast("double").alias("__high"))
    drawn = facts.withColumn("__u", rng.uniform(seed, to, F.col(row_key)) * F.lit(float(one.t)))
    return range_join(drawn, shares, "__u", "__low", "__high", float(one.t) / one.n, "left").drop("__u", "__low", "__high")


#: What a custom dimension's column holds, by the first words that its name has (a name that ends in _id: unique numbers).
NAMED_COLUMNS = (
    (("date",), {"generator": "date"}),
    (("first", "name"), {"generator": "first_name"}),
    (("last", "name"), {"generator": "last_name"}),
    (("name",), {"generator": "company"}),
    (("type",), {"numbered": 5}),
    (("category",), {"numbered": 5}),
    (("status",), {"numbered": 5}),
    (("city",), {"generator": "city"}),
    (("state",), {"generator": "state"}),
    (("country",), {"generator": "country"}),
    (("region",), {"generator": "region"}),
    (("amount",), {"generator": "decimal", "min": 10, "max": 1000}),
    (("price",), {"generator": "decimal", "min": 10, "max": 1000}),
    (("cost",), {"generator": "decimal", "min": 10, "max": 1000}),
    (("rate",), {"generator": "decimal", "min": 0, "max": 0.3}),
    (("percent",), {"generator": "decimal", "min": 0, "max": 0.3}),
    (("minutes",), {"generator": "integer", "min": 5, "max": 120}),
    (("duration",), {"generator": "integer", "min": 5, "max": 120}),
    (("email",), {"generator": "email"}),
    ((), {"generator": "string"}),
)
#: Type and range of a custom measure, likewise.
NAMED_MEASURES = (
    (("amount",), ("decimal", 10, 5000)),
    (("total",), ("decimal", 10, 5000)),
    (("charge",), ("decimal", 10, 5000)),
    (("quantity",), ("integer", 1, 100)),
    (("count",), ("integer", 1, 100)),
    (("units",), ("integer", 1, 100)),
    (("rate",), ("decimal", 0, 1)),
    (("percent",), ("decimal", 0, 1)),
    (("minutes",), ("integer", 1, 480)),
    (("time",), ("integer", 1, 480)),
    (("duration",), ("integer", 1, 480)),
    (("days",), ("integer", 1, 30)),
    (("balance",), ("decimal", -10_000, 100_000)),
    ((), ("decimal", 0, 1000)),
)


def by_name(name: str, table):
    """The entry of the first row of the table all of whose words the name has."""
    return next(entry for words, entry in table if all(w in name.lower() for w in words))


def named_column(name: str) -> dict:
    """The column of a custom dimension, by its name."""
    if name.lower().endswith("_id"):
        return {"generator": "integer", "unique": True}
    entry = by_name(name, NAMED_COLUMNS)
    if "numbered" not in entry:
        return entry
    return {"values": [f"{name.replace('_', ' ').title()} {i + 1}" for i in range(entry["numbered"])]}


def industry_schema(spark: SparkSession, industry: str, scale: float = 1.0, start: str = "2022-01-01", end: str = "2025-12-31", seed: int = 42) -> dict[str, DataFrame]:
    """dim_* and fact_* tables of an industry; keys of facts lie in their dimensions."""
    spec = specs.INDUSTRIES[industry]
    out, sizes = {"dim_date": date_dimension(spark, start, end)}, {}
    for name, d in spec.items():
        if name == "facts":
            continue
        n = max(1, int(d[1] * scale))
        columns = d[2]
        out[f"dim_{name}"] = dimension(spark, [{"name": c} | named_column(c) for c in columns], n, seed)
        sizes[columns[0]] = n
    days = (date.fromisoformat(end) - date.fromisoformat(start)).days + 1
    for name, (_, rows, measures, keys) in spec["facts"].items():
        k = F.col("id")
        cols = [(k + 1).alias(f"{name}_id")]
        for c in keys:
            if c == "date_key":
                cols.append(F.date_format(F.date_add(F.to_date(F.lit(start)), (rng.bits(seed, f"{name}.date", k) % days).cast("int")), "yyyyMMdd").cast("int").alias(c))
            else:
                cols.append((rng.bits(seed, f"{name}.{c}", k) % sizes[c] + 1).alias(c))
        for m in measures:
            kind, a, b = by_name(m, NAMED_MEASURES)
            cols.append(measure(f"{name}.{m}", kind, a, b, "uniform", k, seed).alias(m))
        out[f"fact_{name}"] = spark.range(max(1, int(rows * scale))).select(*cols)
    return out


#: Dimensions of the star schemas by domain.
STARS = {"sales": ("customer", "product", "geography"), "finance": ("account", "department"), "inventory": ("product", "warehouse", "supplier"), "hr": ("employee", "department")}


def star_schema(spark: SparkSession, domain: str, fact_rows: int = 100_000, dimension_rows: int = 1000, date_range: tuple[str, str] = ("2023-01-01", "2024-12-31"), seed: int = 42) -> dict[str, DataFrame]:
    """The domain's dimensions, a date dimension and its fact."""
    out = {f"dim_{d}": dimension(spark, d, dimension_rows, seed) for d in STARS[domain]}
    out["dim_date"] = date_dimension(spark, *date_range)
    out[f"fact_{domain}"] = fact(spark, domain, fact_rows, {f"{d}_id": dimension_rows for d in STARS[domain]}, date_range, seed)
    return out


# ---- correlated columns -------------------------------------------------------------------------------------------------


def _standard(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    one = df.agg(*(f(F.col(c).cast("double")).alias(f"{c}:{n}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    return {c: (one[f"{c}:m"] or 0.0, one[f"{c}:s"] or 0.0) for c in columns}


def correlate(df: DataFrame, rule: dict, key: str = "id", seed: int = 42) -> DataFrame:
    """Adds rule['target'] by type: statistical, categorical, formula, tiered, conditional or copula (several sources, linearly mixed)."""
    target, sources, k, kind = rule["target"], rule.get("source", []), F.col(key), rule["type"]
    bounded = lambda v: clip(v, rule.get("min_value"), rule.get("max_value"))
    rounded = lambda v: F.round(v, rule["round_to"]) if rule.get("round_to") is not None else v
    if kind in ("statistical", "copula"):
        rho = [float(rule["correlation"])] if kind == "statistical" else [float(rule["correlations"][s]) for s in sources]
        strength = math.sqrt(sum(r * r for r in rho))
        if strength > 1:
            rho, strength = [r / strength for r in rho], 1.0
        stats = _standard(df, sources)
        z = F.lit(0.0)
        for r, s in zip(rho, sources, strict=True):
            m, d = stats[s]
            z = z + F.lit(r) * ((F.col(s).cast("double") - F.lit(m)) / F.lit(d) if d else F.lit(0.0))
        z = z + F.lit(math.sqrt(max(0.0, 1 - strength * strength))) * rng.normal(seed, target, k)
        v = rounded(bounded(F.lit(float(rule.get("mean", 0))) + F.lit(float(rule.get("std", 1))) * z))
    elif kind == "categorical":
        u, c, v = rng.uniform(seed, target, k), F.col(sources[0]).cast("string"), None
        for name, shares in rule["distributions"].items():
            one = rng.weighted(u, list(shares), list(shares.values()))
            v = F.when(c == name, one) if v is None else v.when(c == name, one)
        rest = rule.get("default")
        v = v.otherwise(rng.weighted(u, list(rest), list(rest.values())) if rest else F.lit(None))
    elif kind == "formula":
        v = rounded(bounded(F.expr(formula_sql(rule["formula"], df.columns))))
    elif kind == "tiered":
        c, v = F.col(sources[0]), None
        for low, high, x in rule["tiers"]:
            held = (c >= low) & (c < high) if high is not None else c >= low
            v = F.when(held, F.lit(x)) if v is None else v.when(held, F.lit(x))
        v = v.otherwise(F.lit(rule.get("default")))
    elif kind == "conditional":
        v = None
        for cond, x in rule["conditions"]:
            held = F.expr(formula_sql(cond, df.columns))
            v = F.when(held, F.lit(x)) if v is None else v.when(held, F.lit(x))
        v = v.otherwise(F.lit(rule.get("default")))
    else:
        raise ValueError(f"unknown correlation {kind!r}")
    return df.withColumn(target, v)


def formula_sql(text: str, columns: Sequence[str]) -> str:
    """Arithmetic and comparisons over the table's columns as SQL: ** becomes pow, == becomes =; other names are errors."""
    names = set(re.findall(r"[A-Za-z_]\w*", re.sub(r"'[^']*'", "", text)))
    unknown = names - set(columns) - {"and", "or", "not", "AND", "OR", "NOT", "in", "abs", "round", "sqrt", "exp", "ln", "pow", "least", "greatest"}
    if unknown:
        raise ValueError(f"unknown names in formula: {sorted(unknown)}")
    atom = r"([A-Za-z_]\w*|\d+(?:\.\d+)?|\([^()]*\))"
    while "**" in text:
        new = re.sub(atom + r"\s*\*\*\s*" + atom, r"pow(\1, \2)", text)
        if new == text:
            raise ValueError("can't read the power in the formula")
        text = new
    return text.replace("==", "=")


def correlated_fact(spark: SparkSession, rows: int, base: list[dict], rules: list[dict], seed: int = 42) -> DataFrame:
    """Base columns {name, type: uniform, normal, choice, sequence, list or constant, ...} and rules in order (presets by name)."""
    k = F.col("id")
    df = spark.range(rows)
    for c in base:
        n = c["name"]
        made = {
            "uniform": lambda: distributions.uniform_between(rng.uniform(seed, n, k), c.get("min", 0), c.get("max", 1)),  # noqa: B023
            "normal": lambda: F.lit(float(c.get("mean", 0))) + F.lit(float(c.get("std", 1))) * rng.normal(seed, n, k),  # noqa: B023
            "integer": lambda: rng.bits(seed, n, k) % (int(c.get("max", 100)) - int(c.get("min", 0)) + 1) + int(c.get("min", 0)),  # noqa: B023
            "choice": lambda: rng.weighted(rng.uniform(seed, n, k), c["values"], c.get("weights") or [1.0] * len(c["values"])),  # noqa: B023
            "sequence": lambda: k + int(c.get("start", 1)),  # noqa: B023
            "list": lambda: F.element_at(F.array(*map(F.lit, c["values"])), (k % len(c["values"])).cast("int") + 1),  # noqa: B023
            "constant": lambda: F.lit(c.get("value")),  # noqa: B023
        }[c["type"]]()
        df = df.withColumn(n, F.round(made, c["round_to"]) if c.get("round_to") is not None else made)
    for rule in rules:
        df = correlate(df, specs.CORRELATIONS[rule] if isinstance(rule, str) else rule, "id", seed)
    return df


# ---- currencies ------------------------------------------------------------------------------------------------------------


def currency_dimension(spark: SparkSession, codes: Sequence[str] | None = None, majors_only: bool = False) -> DataFrame:
    rows = [(c, n, s, d, p, c in specs.MAJOR_CURRENCIES) for c, n, s, d, p, _, _ in specs.CURRENCIES if (not codes or c in codes) and (not majors_only or c in specs.MAJOR_CURRENCIES)]
    return spark.createDataFrame(rows, "currency_code string, currency_name string, symbol string, decimal_places int, country string, is_major boolean")


def _rate(code: str) -> tuple[float, float]:
    return next((r, v) for c, _, _, _, _, r, v in specs.CURRENCIES if c == code)


def rates_long(spark: SparkSession, base: str, targets: Sequence[str], start: str, end: str, grain: str = "weekday", seed: int = 42) -> DataFrame:
    """date, base, target, rate: a geometric random walk for each currency against the dollar, from its reference rate, and their quotients."""
    steps = {"day": 365, "weekday": 252, "week": 52, "month": 12}[grain]
    codes = sorted({base, *targets} - {"USD"})
    df = dates(spark, start, end, grain)
    table = spark.createDataFrame([(c, *_rate(c)) for c in codes] or [("EUR", *_rate("EUR"))], "code string, first double, volatility double")
    walk = df.crossJoin(F.broadcast(table))  # some dozen currencies
    z = rng.normal(seed, "fx", F.concat_ws(":", "code", F.col("date").cast("string")))
    w = Window.partitionBy("code").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)  # some thousand dates each
    started = F.row_number().over(Window.partitionBy("code").orderBy("date")) > 1
    walk = walk.withColumn("z", z).withColumn("step", F.when(started, F.col("volatility") * F.lit(math.sqrt(1 / steps)) * F.col("z")).otherwise(0.0))
    usd = walk.select("date", "code", (F.col("first") * F.exp(F.sum("step").over(w))).alias("usd")).unionByName(df.select("date", F.lit("USD").alias("code"), F.lit(1.0).alias("usd")))
    b = usd.filter(F.col("code") == base).select("date", F.col("usd").alias("base_usd"))
    out = usd.filter(F.col("code").isin(*targets)).join(b, "date").withColumn("r", F.col("usd") / F.col("base_usd"))
    return out.select("date", F.lit(base).alias("base"), F.col("code").alias("target"), F.when(F.col("r") >= 100, F.round("r", 2)).when(F.col("r") >= 1, F.round("r", 4)).otherwise(F.round("r", 6)).alias("rate"))


def exchange_rates(spark: SparkSession, base: str, targets: Sequence[str], start: str, end: str, grain: str = "weekday", seed: int = 42) -> DataFrame:
    """date and a column base_target for each target."""
    long = rates_long(spark, base, targets, start, end, grain, seed)
    return long.groupBy("date").agg(*(F.max(F.when(F.col("target") == t, F.col("rate"))).alias(f"{base}_{t}") for t in targets))


def triangular_rates(long: DataFrame) -> DataFrame:
    """date, base, target, rate for all pairs of targets, by way of the common base (rounded to 6 digits)."""
    a = long.select("date", F.col("target").alias("x"), F.col("rate").alias("rx"))
    b = long.select("date", F.col("target").alias("y"), F.col("rate").alias("ry"))
    return a.join(b, "date").select("date", F.col("x").alias("base"), F.col("y").alias("target"), F.round(F.col("ry") / F.col("rx"), 6).alias("rate"))


def multicurrency_fact(spark: SparkSession, rows: int, currencies: Sequence[str], reporting: str, start: str, end: str, seed: int = 42, weights: Sequence[float] | None = None) -> DataFrame:
    """Transactions in several currencies with the rate in force on their day (the latest weekday's), and the converted amount."""
    from brindle.operators.relational import as_of_join

    days, k = (date.fromisoformat(end) - date.fromisoformat(start)).days + 1, F.col("id")
    tx = spark.range(rows).select(
        (k + 1).alias("transaction_id"),
        F.date_add(F.to_date(F.lit(start)), (rng.bits(seed, "tx.date", k) % days).cast("int")).alias("transaction_date"),
        rng.weighted(rng.uniform(seed, "tx.currency", k), list(currencies), list(weights or [1.0] * len(currencies))).alias("transaction_currency"),
        F.round(distributions.lognormal(rng.normal(seed, "tx.amount", k), 5, 1), 2).alias("transaction_amount"),
    )
    first = (date.fromisoformat(start) - timedelta(days=7)).isoformat()  # a weekend start has a rate too
    rates = rates_long(spark, reporting, [c for c in currencies if c != reporting], first, end, "weekday", seed).select(F.col("target").alias("transaction_currency"), F.col("date").alias("rate_date"), F.col("rate").alias("exchange_rate"))
    out = as_of_join(tx, rates, "transaction_date", "rate_date", ["transaction_currency"], ["exchange_rate"])
    rate = F.when(F.col("transaction_currency") == reporting, F.lit(1.0)).otherwise(F.col("exchange_rate"))
    return out.withColumn("exchange_rate", rate).withColumn("reporting_currency", F.lit(reporting)).withColumn("reporting_amount", F.round(F.col("transaction_amount") / F.col("exchange_rate"), 2))


def currency_breakdown(fx: DataFrame) -> DataFrame:
    return fx.groupBy("transaction_currency").agg(F.count("*").alias("count"), F.round(F.sum(F.col("transaction_amount").cast("decimal(18,2)")).cast("double"), 2).alias("total_amount"), F.round(F.sum(F.col("reporting_amount").cast("decimal(18,2)")).cast("double"), 2).alias("total_reporting"))


# ---- templates ---------------------------------------------------------------------------------------------------------------


def from_template(spark: SparkSession, text: str, rows: int, seed: int = 42, dimensions: dict[str, DataFrame] | None = None) -> DataFrame:
    """A table from YAML columns {name, generator, config}: sequence, pattern, faker, choice, dependent_choice, dependent_value, lookup, distribution,
    formula, date_range, dimension_lookup, hierarchical_code, parent, level.  Columns may use those above them."""
    spec = yaml.safe_load(text)
    k, df = F.col("__k"), spark.range(rows).withColumnRenamed("id", "__k")
    for c in spec["columns"]:
        name, g, p = c["name"], c.get("generator", c.get("type", "string")), c.get("config") or {}
        df = df.withColumn(name, _templated(df, name, g, p, k, seed, dimensions or {}))
    return df.drop("__k")


def _templated(df: DataFrame, name: str, g: str, p: dict, k: Column, seed: int, dims: dict[str, DataFrame]) -> Column:
    u = rng.uniform(seed, name, k)
    if g == "sequence":
        return k + F.lit(p.get("start", 1))
    if g == "pattern":
        parts = []
        for lit_part, field, width in re.findall(r"([^{]*)(?:\{(\w+)(?::(\d+))?\})?", p["pattern"]):
            parts += [F.lit(lit_part)] if lit_part else []
            if field:
                parts.append(F.lit(str(p.get("year", 2024))) if field == "year" else padded(k + 1, int(width)) if width else (k + 1).cast("string"))
        return F.concat(*parts)
    if g == "faker":
        return F.concat(F.lit(p.get("prefix", "")), value(p.get("method", "word"), name, k, seed).cast("string"))
    if g == "choice":
        return rng.weighted(u, p["choices"], p.get("weights") or [1.0] * len(p["choices"]))
    if g in ("dependent_choice", "lookup"):
        c, out = F.col(p.get("depends_on") or p["source"]).cast("string"), None
        for key, values in p["mappings"].items():
            one = rng.pick(seed, name, k, list(values))
            out = F.when(c == str(key), one) if out is None else out.when(c == str(key), one)
        return out
    if g == "dependent_value":
        c, out = F.col(p.get("depends_on") or p.get("source")).cast("string"), None
        for key, v in p["mappings"].items():
            out = F.when(c == str(key), F.lit(v)) if out is None else out.when(c == str(key), F.lit(v))
        return out.otherwise(F.lit(p.get("default")))
    if g == "distribution":
        kind = p.get("type", "uniform")
        if kind == "choice":
            return rng.weighted(u, p["choices"], p.get("weights") or [1.0] * len(p["choices"]))
        args = {"uniform": {"low": p.get("min", 0), "high": p.get("max", 1)}, "normal": {"mean": p.get("mean", 0), "std": p.get("std", 1)}, "poisson": {"lam": p.get("lambda", 1)}}.get(kind, {x: y for x, y in p.items() if x not in ("type", "min", "max")})
        v = clip(distributions.sample(kind, seed, name, k, **args), p.get("min"), p.get("max"))
        return v.cast("long") if kind == "poisson" else F.round(v, p.get("round_to", 2))
    if g == "formula":
        drawn = re.search(r"random\.uniform\(([^,]+),([^)]+)\)", p["formula"])
        if not drawn:
            return F.round(F.expr(formula_sql(p["formula"], df.columns)), 2)
        # The drawn number is a column of its own inside a struct, which the formula's text can name.
        sql = formula_sql(p["formula"].replace(drawn[0], "__drawn"), [*df.columns, "__drawn"])
        low, high = float(drawn[1]), float(drawn[2])
        text = f"CAST(conv(substring(md5(concat('{seed}:{name}:', CAST(__k AS STRING))), 1, 8), 16, 10) AS BIGINT) / {rng.TWO_32!r}D"
        return F.round(F.expr(sql.replace("__drawn", f"({low!r}D + {high - low!r}D * ({text}))")), 2)
    if g == "date_range":
        days = (date.fromisoformat(str(p["end"])) - date.fromisoformat(str(p["start"]))).days + 1
        return F.date_add(F.to_date(F.lit(str(p["start"]))), (rng.bits(seed, name, k) % days).cast("int"))
    if g == "dimension_lookup":
        size = dims[p["dimension"]].count() if p["dimension"] in dims else int(p.get("size", 1000))
        if p.get("distribution") == "pareto":
            return F.least(F.lit(size), F.floor(distributions.pareto(u, p.get("pareto_alpha", 1.5)))).cast("long")
        if p.get("distribution") == "weighted_recent":
            return F.least(F.lit(size), F.floor(F.sqrt(u) * size) + 1).cast("long")
        return (rng.bits(seed, name, k) % size + 1).cast("long")
    if g == "hierarchical_code":
        digits = [int(x.get("digits", 1)) for x in p.get("levels", [{"digits": 4}])]
        return F.when(F.length((k + 1).cast("string")) >= sum(digits), (k + 1).cast("string")).otherwise(F.lpad((k + 1).cast("string"), sum(digits), "1")) if len(digits) == 1 else F.concat((k % 9 + 1).cast("string"), padded(k + 1, sum(digits) - digits[0]))
    if g in ("parent", "hierarchical_parent", "parent_code"):
        c = F.col(p.get("source", df.columns[-1])).cast("string")
        return F.when(F.length(c) > 1, F.substring(c, 1, 1))
    if g in ("level", "hierarchical_level"):
        return F.length(F.col(p.get("source", df.columns[-1])).cast("string"))
    return value(g, name, k, seed, p.get("unique", False), p.get("min", 0), p.get("max", 1000))


def template_checks(text: str) -> list[dict]:
    """A template's validations as custom_sql rules for the rule compiler."""
    return [{"name": v.get("message", v["rule"]), "type": "custom_sql", "columns": [], "config": {"expression": v["rule"]}} for v in (yaml.safe_load(text) or {}).get("validations", [])]
