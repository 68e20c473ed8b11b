"""Profiles: one row a column, from one fused aggregate; patterns, characteristics, schema hints and domains."""

from __future__ import annotations

import re
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Names and regular expressions of value patterns.
PATTERNS = {
    "email": r"^[\w\.-]+@[\w\.-]+\.\w+$",
    "phone": r"^[\+\d\s\-\(\)]{7,20}$",
    "date_iso": r"^\d{4}-\d{2}-\d{2}$",
    "date_us": r"^\d{2}/\d{2}/\d{4}$",
    "date_eu": r"^\d{2}\.\d{2}\.\d{4}$",
    "uuid": r"^[a-f0-9]{8}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{12}$",
    "ip_address": r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$",
    "url": r"^https?://[\w\.-]+",
    "currency_symbol": r"^[\$\€\£\¥][\d,\.]+$",
    "percentage": r"^[\d\.]+%$",
    "code_numeric": r"^\d{4,10}$",
    "code_alpha": r"^[A-Z]{2,5}$",
    "code_alphanumeric": r"^[A-Z0-9]{3,10}$",
}
#: Semantic types by column name; the first that fits counts.
SEMANTIC_TYPES = {
    "ID": r"(^id$|_id$|^id_|_key$|^key_)",
    "Date": r"(date|time|created|updated|timestamp)",
    "Amount": r"(amount|total|sum|price|cost|revenue|sales|value)",
    "Quantity": r"(qty|quantity|count|number)",
    "Percentage": r"(pct|percent|rate|ratio)",
    "Name": r"(name|description|title|label)",
    "Code": r"(code|sku)",
    "Boolean": r"(flag|is_|has_|can_)",
    "Email": r"(email|e_mail)",
    "Phone": r"(phone|tel|mobile)",
    "Address": r"(address|street|city|state|zip|postal|country)",
}
#: Target types of the two schema vocabularies.
TARGET_TYPES = {
    "powerbi": {"long": "Whole Number", "double": "Decimal Number", "string": "Text", "boolean": "True/False", "date": "Date", "timestamp": "Date/Time", "time": "Time"},
    "generic": {"long": "integer", "double": "decimal", "string": "string", "boolean": "boolean", "date": "date", "timestamp": "datetime"},
}


def is_number(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def _kind(t: T.DataType) -> str:
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "long"
    if isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "double"
    return {"timestamp_ntz": "timestamp"}.get(t.simpleString(), t.simpleString())


def stacked(df: DataFrame, measures: dict[str, dict[str, Column]], key: str = "column") -> DataFrame:
    """One aggregate over df, turned into a row for each name: measures[name][measure]."""
    names = list(measures)
    wanted = list(next(iter(measures.values())))
    one = df.agg(*(measures[n][m].alias(f"{i}:{m}") for i, n in enumerate(names) for m in wanted))
    rows = F.array(*(F.struct(F.lit(n).alias(key), *(F.col(f"`{i}:{m}`").alias(m) for m in wanted)) for i, n in enumerate(names)))
    return one.select(F.explode(rows).alias("r")).select("r.*")


def distinct_counts(df: DataFrame) -> DataFrame:
    """(column, unique_count), null counted as a value: one pass and one shuffle of (column, value) pairs, whatever the number of columns."""

    def text(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("")) if isinstance(f.dataType, T.AtomicType) else F.to_json(F.struct(c.alias("v")))

    pairs = df.select(F.explode(F.array(*(F.struct(F.lit(f.name).alias("column"), text(f).alias("value")) for f in df.schema.fields))).alias("p"))
    return pairs.select("p.*").groupBy("column", "value").agg(F.lit(1).alias("one")).groupBy("column").agg(F.count("*").alias("unique_count"))


def with_counts(rows: DataFrame, df: DataFrame) -> DataFrame:
    """rows (one a column) with unique_count; 0 for an empty table."""
    return rows.join(distinct_counts(df), "column", "left").fillna(0, ["unique_count"])


def profile(df: DataFrame) -> DataFrame:
    """column, dtype, row_count, null_count, unique_count (null is a value), min, max, mean, std (sample; numbers only), min and max as text."""
    null = F.lit(None)
    measures = {}
    for f in df.schema.fields:
        c, number = F.col(f"`{f.name}`"), is_number(f.dataType)
        measures[f.name] = {
            "dtype": F.lit(f.dataType.simpleString()),
            "row_count": F.count(F.lit(1)),
            "null_count": F.count_if(c.isNull()),
            "min": F.min(c).cast("string"),
            "max": F.max(c).cast("string"),
            "mean": F.avg(c.cast("double")) if number else null.cast("double"),
            "std": F.stddev_samp(c.cast("double")) if number else null.cast("double"),
        }
        measures[f.name]["dtype"] = F.max(measures[f.name]["dtype"])
        if not number:
            measures[f.name]["mean"] = measures[f.name]["std"] = F.max(null.cast("double"))
    return with_counts(stacked(df, measures), df).select("column", "dtype", "row_count", "null_count", "unique_count", "min", "max", "mean", "std")


def detect_patterns(df: DataFrame, least: float = 70.0, sample: int | None = None) -> DataFrame:
    """(column, pattern, match_percentage) of text columns where more than `least` percent of non-null values fit; of all values, or a sample."""
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not texts:
        return df.sparkSession.createDataFrame([], "column string, pattern string, match_percentage double")
    df = df.limit(sample) if sample else df
    pairs = {f"{c}:{p}": {"hit": F.count_if(F.col(f"`{c}`").rlike(f"(?i){r}")), "n": F.count(F.col(f"`{c}`"))} for c in texts for p, r in PATTERNS.items()}
    rows = stacked(df, pairs, "pair").withColumn("match_percentage", F.round(F.try_divide(F.col("hit") * 100.0, F.col("n")), 1))
    at = F.expr("length(pair) - instr(reverse(pair), ':')")
    return rows.filter(F.col("hit") * 100.0 > least * F.col("n")).select(F.expr("substring(pair, 1, length(pair) - instr(reverse(pair), ':'))").alias("column"), F.substring(F.col("pair"), at + 2, F.length("pair")).alias("pattern"), "match_percentage")


def numeric_characteristics(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, min, max, mean, has_negatives, all_integers, likely_id (all values set and distinct, and whole)."""
    columns = columns or [f.name for f in df.schema.fields if is_number(f.dataType)]
    measures = {}
    for name in columns:
        c = F.col(f"`{name}`").cast("double")
        measures[name] = {"min": F.min(c), "max": F.max(c), "mean": F.avg(c), "has_negatives": F.coalesce(F.bool_or(c < 0), F.lit(False)), "all_integers": F.coalesce(F.bool_and(c == F.floor(c)), F.lit(True)), "rows": F.count(F.lit(1)), "nulls": F.count_if(c.isNull())}
    return with_counts(stacked(df, measures), df.select(*columns)).select("column", "min", "max", "mean", "has_negatives", "all_integers", ((F.col("nulls") == 0) & F.col("all_integers") & (F.col("unique_count") == F.col("rows"))).alias("likely_id"))


def string_characteristics(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, min_length, max_length, avg_length, all_same_length, contains_digits, contains_letters, unique_ratio (of all rows)."""
    columns = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    measures = {}
    for name in columns:
        c = F.col(f"`{name}`")
        n = F.length(c)
        has = lambda r, c=c: F.coalesce(F.bool_or(c.rlike(r)), F.lit(False))
        measures[name] = {"min_length": F.min(n), "max_length": F.max(n), "avg_length": F.avg(n), "all_same_length": F.min(n) == F.max(n), "contains_digits": has(r"[0-9]"), "contains_letters": has(r"[a-zA-Z]"), "rows": F.count(F.lit(1))}
    return with_counts(stacked(df, measures), df.select(*columns)).withColumn("unique_ratio", F.try_divide(F.col("unique_count").cast("double"), F.col("rows"))).drop("rows", "unique_count")


def semantic_type(name: str) -> str:
    return next((k for k, r in SEMANTIC_TYPES.items() if re.search(r, name.lower())), "Unknown")


def infer_schema(df: DataFrame, target: str = "powerbi") -> DataFrame:
    """name, source_type, target_type, nullable, unique, semantic_type, optimization (a narrower whole-number type, where all values fit)."""
    known = TARGET_TYPES[target]
    other = "Text" if target == "powerbi" else "string"
    rows = profile(df)
    text = lambda make: F.create_map(*(x for f in df.schema.fields for x in (F.lit(f.name), F.lit(make(f)))))[F.col("column")]
    whole = text(lambda f: _kind(f.dataType) == "long")
    low, high = F.col("min").try_cast("double"), F.col("max").try_cast("double")
    narrow = F.when(whole & (low >= 0) & (high <= 255), F.lit("Could use UInt8")).when(whole & (low >= -128) & (high <= 127), F.lit("Could use Int8"))
    return rows.select(
        F.col("column").alias("name"),
        F.col("dtype").alias("source_type"),
        text(lambda f: known.get(_kind(f.dataType), other)).alias("target_type"),
        (F.col("null_count") > 0).alias("nullable"),
        (F.col("unique_count") == F.col("row_count")).alias("unique"),
        text(lambda f: semantic_type(f.name)).alias("semantic_type"),
        narrow.alias("optimization"),
    )


def schema_recommendations(df: DataFrame) -> list[str]:
    """Advice from the profile: mostly null, one value only, or a key candidate."""
    out = []
    for r in profile(df).collect():  # a row a column
        share = 100.0 * r.null_count / r.row_count if r.row_count else 0.0
        if share > 50:
            out.append(f"Column '{r.column}': {share:.1f}% of values are missing")
        if r.unique_count == 1:
            out.append(f"Column '{r.column}' holds a single value")
        if r.unique_count == r.row_count and r.row_count > 10:
            out.append(f"Column '{r.column}' is unique and could be the primary key")
    return out


# ---- domains by column names --------------------------------------------------------------------------------------------

#: Words, patterns, subtypes, rules and tables of the business domains.
DOMAINS = {
    "financial": {
        "words": ("debit", "credit", "balance", "account", "ledger", "journal", "fiscal", "period", "gl", "revenue", "expense", "asset", "liability", "equity", "profit", "loss", "budget", "actual", "variance", "trial_balance", "coa", "chart_of_accounts"),
        "patterns": [r"debit|credit", r"account.*code", r"gl.*type", r"fiscal.*year", r"journal.*entry", r"balance.*sheet", r"income.*statement", r"posting.*period", r"currency"],
        "subtypes": {
            "balance_sheet": ["asset", "liability", "equity"],
            "income_statement": ["revenue", "expense", "profit", "loss"],
            "trial_balance": ["debit", "credit", "balance"],
            "general_ledger": ["journal", "entry", "posting"],
            "chart_of_accounts": ["account_code", "account_name", "account_type"],
        },
        "rules": [("balance_check", "Debit = Credit per period"), ("referential", "Account codes exist in CoA"), ("not_null", "Amount columns should not be null")],
        "tables": ["dim_account", "dim_period", "dim_entity", "fact_gl_transactions"],
    },
    "sales": {
        "words": ("order", "customer", "product", "sale", "quantity", "price", "discount", "invoice", "ship", "payment", "channel", "region", "territory", "rep", "commission", "return", "refund"),
        "patterns": [r"order.*id", r"customer.*id", r"product.*id", r"unit.*price", r"line.*total", r"ship.*date", r"order.*date"],
        "subtypes": {"orders": ["order", "line_item", "quantity"], "customers": ["customer", "segment", "region"], "products": ["product", "category", "price"]},
        "rules": [("referential", "Customer IDs exist in customer master"), ("range", "Prices should be positive"), ("not_null", "Order date should not be null")],
        "tables": ["dim_customer", "dim_product", "dim_date", "fact_sales"],
    },
    "inventory": {
        "words": ("stock", "warehouse", "inventory", "bin", "location", "sku", "reorder", "safety", "lead_time", "movement", "receipt", "issue", "transfer", "adjustment", "lot", "serial"),
        "patterns": [r"stock.*level", r"warehouse.*id", r"bin.*location", r"reorder.*point", r"safety.*stock"],
        "subtypes": {"stock_levels": ["quantity", "location", "sku"], "movements": ["movement", "receipt", "issue"], "warehouses": ["warehouse", "location", "capacity"]},
        "rules": [("range", "Stock levels should be non-negative"), ("referential", "SKUs exist in product master")],
        "tables": ["dim_product", "dim_warehouse", "dim_date", "fact_inventory"],
    },
    "hr": {
        "words": ("employee", "salary", "department", "position", "hire", "termination", "performance", "leave", "attendance", "payroll", "benefit", "bonus", "manager", "headcount"),
        "patterns": [r"employee.*id", r"hire.*date", r"department.*id", r"salary", r"bonus", r"performance.*rating"],
        "subtypes": {"employees": ["employee", "name", "hire_date"], "departments": ["department", "manager"], "payroll": ["salary", "bonus", "deduction"]},
        "rules": [("referential", "Department IDs exist in department master"), ("range", "Salary should be positive")],
        "tables": ["dim_employee", "dim_department", "dim_date", "fact_payroll"],
    },
}


def domain_signs() -> list[tuple[str, str, str, str | None, int]]:
    """(domain, kind, pattern, subtype, points) for every word, pattern and subtype word of the domains.

    A word's point is for each column that has one of them; a pattern's two are for the table."""
    out = []
    for name, d in DOMAINS.items():
        out.append((name, "column", "|".join(map(re.escape, d["words"])), None, 1))
        out += [(name, "table", p, None, 2) for p in d["patterns"]]
        out += [(name, "subtype", re.escape(w), s, 1) for s, words in d["subtypes"].items() for w in words]
    return out


def detect_domain(columns: list[str]) -> list[dict]:
    """For each domain, best first: score, confidence (its share of all scores), the subtype most of whose words occur, matched columns, rules, tables."""
    points: Counter[str] = Counter()
    fits: dict[str, Counter[str]] = {name: Counter() for name in DOMAINS}
    matched: dict[str, list[str]] = {name: [] for name in DOMAINS}
    for domain, kind, pattern, subtype, worth in domain_signs():
        hits = [c.lower() for c in columns if re.search(pattern, c.lower())]
        if kind == "subtype":
            fits[domain][subtype] += worth * bool(hits)
        else:
            points[domain] += worth * (len(hits) if kind == "column" else bool(hits))
        if kind == "column":
            matched[domain] = hits
    total = sum(points.values())
    best = {name: max(fits[name].items(), key=lambda x: x[1]) for name in DOMAINS}
    rows = [
        {
            "domain": name,
            "score": points[name],
            "confidence": round(points[name] / total, 2) if total else 0.0,
            "subtype": best[name][0] if best[name][1] else None,
            "matched_columns": matched[name],
            "validation_rules": [{"type": t, "description": x} for t, x in d["rules"]],
            "recommended_tables": d["tables"],
        }
        for name, d in DOMAINS.items()
    ]
    return sorted(rows, key=lambda r: -r["score"])


def domain_frame(df: DataFrame) -> DataFrame:
    rows = [(d["domain"], d["score"], d["confidence"], d["subtype"]) for d in detect_domain(df.columns)]
    return df.sparkSession.createDataFrame(rows, "domain string, score int, confidence double, subtype string")


def narrowed(df: DataFrame, fact_keys: bool = True, keep_precision: bool = False) -> tuple[DataFrame, list[dict]]:
    """Smallest whole-number types that hold all values, float for double (unless keep_precision), int for keys of facts; and what was done.

    Text columns with under half as many distinct values as rows are reported as categories (files dictionary-encode them)."""
    rows = {r.column: r for r in profile(df).collect()}  # a row a column
    sizes = (("tinyint", -128, 127), ("smallint", -32_768, 32_767), ("int", -(2**31), 2**31 - 1))
    out, log = [], []
    for f in df.schema.fields:
        r, c = rows[f.name], F.col(f"`{f.name}`")
        to = None
        if _kind(f.dataType) == "long" and r.min is not None:
            to = next((n for n, a, b in sizes if a <= int(r.min) and int(r.max) <= b), None)
            to = "int" if fact_keys and to and re.search(r"(_id|_key)$", f.name.lower()) else to
        elif isinstance(f.dataType, T.DoubleType) and not keep_precision:
            to = "float"
        elif isinstance(f.dataType, T.StringType) and r.row_count and r.unique_count < 0.5 * r.row_count:
            log.append({"column": f.name, "optimization": "category", "range": None})
        if to and to != f.dataType.simpleString():
            log.append({"column": f.name, "optimization": f"{f.dataType.simpleString()} -> {to}", "range": f"{r.min}..{r.max}"})
            c = c.cast(to).alias(f.name)
        out.append(c)
    return df.select(*out), log


def measure_texts(fact: str, columns: list[str]) -> list[dict]:
    """Measure expressions for amounts and quantities of a fact table, and a row count."""
    sums = [{"name": f"Total {c.replace('_', ' ').title()}", "expression": f"SUM('{fact}'[{c}])"} for c in columns if semantic_type(c) in ("Amount", "Quantity")]
    means = [{"name": f"Average {c.replace('_', ' ').title()}", "expression": f"AVERAGE('{fact}'[{c}])"} for c in columns if semantic_type(c) == "Amount"]
    return [*sums, *means, {"name": "Row Count", "expression": f"COUNTROWS('{fact}')"}]


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
