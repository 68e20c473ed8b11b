"""Relationships between tables: value overlap of all column pairs by one self-join on values, name similarity, cardinality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.functions.similarity import name_similarity
from brindle.operators.profile import union_all


def _class(t: T.DataType) -> str:
    return "number" if isinstance(t, T.NumericType) else t.simpleString()


def column_values(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, column, class, value, copies): distinct non-null values of all columns; numbers compare as doubles."""

    def one(name: str, df: DataFrame) -> DataFrame:
        items = [
            F.struct(F.lit(name).alias("table"), F.lit(f.name).alias("column"), F.lit(_class(f.dataType)).alias("class"), (F.col(f"`{f.name}`").cast("double") if isinstance(f.dataType, T.NumericType) else F.col(f"`{f.name}`")).cast("string").alias("value"))
            for f in df.schema.fields
            if isinstance(f.dataType, T.AtomicType)
        ]
        return df.select(F.explode(F.array(*items)).alias("i")).select("i.*").filter("value IS NOT NULL")

    return union_all([one(n, df) for n, df in tables.items()]).groupBy("table", "column", "class", "value").agg(F.count("*").alias("copies"))


def overlaps(tables: dict[str, DataFrame], least_distinct: int = 3) -> DataFrame:
    """Pairs of columns of different tables with their distinct counts, shared values and whether each side is unique.

    Values first collapse to the list of columns that hold them (at most one entry a column), so a pair costs a row only for
    combinations of columns that share a value, not for rows."""
    values = column_values(tables)
    sizes = values.groupBy("table", "column").agg(F.count("*").alias("distinct"), F.max("copies").alias("most"))
    where = values.groupBy("class", "value").agg(F.array_sort(F.collect_set(F.struct("table", "column"))).alias("at")).filter("size(at) > 1")
    shapes = where.groupBy("class", "at").agg(F.count("*").alias("shared"))  # few distinct lists of columns
    pairs = shapes.select("shared", F.explode("at").alias("a"), "at").select("shared", "a", F.explode("at").alias("b")).filter("a.table < b.table")
    pairs = pairs.groupBy("a", "b").agg(F.sum("shared").alias("shared"))
    for x in "ab":
        pairs = pairs.join(sizes.select(F.struct("table", "column").alias(x), F.col("distinct").alias(f"distinct_{x}"), (F.col("most") == 1).alias(f"unique_{x}")), x)
    pairs = pairs.filter((F.col("distinct_a") >= least_distinct) & (F.col("distinct_b") >= least_distinct))
    return pairs.select(
        F.col("a.table").alias("source_table"),
        F.col("a.column").alias("source_column"),
        F.col("b.table").alias("target_table"),
        F.col("b.column").alias("target_column"),
        "distinct_a",
        "distinct_b",
        "shared",
        (F.col("shared") / F.least("distinct_a", "distinct_b")).alias("overlap_ratio"),
        F.concat(F.when(F.col("unique_a"), "1").otherwise("N"), F.lit(":"), F.when(F.col("unique_b"), "1").otherwise("N")).alias("relationship_type"),
    )


def find_relationships(tables: dict[str, DataFrame], threshold: float = 0.3, top: int = 50) -> DataFrame:
    """The likeliest relationships: names (over 0.8 similar +0.3, over 0.5 +0.15) and overlap (over 0.9 +0.7, 0.5 +0.5, 0.2 +0.3, 0.05 +0.15), at most 1."""
    names = list(tables)
    pairs = [(a, x, b, y) for i, a in enumerate(names) for b in names[i + 1 :] for x in tables[a].columns for y in tables[b].columns]
    weight = lambda s: 0.30 if s > 0.8 else 0.15 if s > 0.5 else 0.0
    scored = [(*sorted(((a, x), (b, y)))[0], *sorted(((a, x), (b, y)))[1], weight(name_similarity(x, y))) for a, x, b, y in pairs]
    spark = next(iter(tables.values())).sparkSession
    named = spark.createDataFrame(scored, "source_table string, source_column string, target_table string, target_column string, name_score double")
    r = F.col("overlap_ratio")
    value = F.when(r > 0.9, 0.7).when(r > 0.5, 0.5).when(r > 0.2, 0.3).when(r > 0.05, 0.15).otherwise(0.0)
    found = overlaps(tables).join(F.broadcast(named), ["source_table", "source_column", "target_table", "target_column"])  # a row a pair of columns
    found = found.withColumn("confidence", F.round(F.least(F.lit(1.0), value + F.col("name_score")), 2)).filter(F.col("confidence") >= threshold)
    order = [F.desc("confidence"), "source_table", "source_column", "target_table", "target_column"]
    return found.select("source_table", "source_column", "target_table", "target_column", F.round("overlap_ratio", 4).alias("overlap_ratio"), "relationship_type", "confidence").orderBy(*order).limit(top)


def suggest_star_schema(tables: dict[str, DataFrame]) -> list[dict]:
    """Tables by rows (most first), then by how unique their values are; the first half (n // 2 + 1) are facts."""
    from brindle.operators.profile import distinct_counts

    rows = []
    for name, df in tables.items():
        n = df.count()
        unique = distinct_counts(df).agg(F.avg("unique_count")).first()[0] or 0.0
        rows.append({"table": name, "rows": n, "unique_ratio": unique / n if n else 0.0})
    rows.sort(key=lambda r: (-r["rows"], r["unique_ratio"]))
    for i, r in enumerate(rows):
        r["role"] = "fact" if i < len(rows) // 2 + 1 else "dimension"
    return rows


def key_relationships(tables: dict[str, DataFrame]) -> list[dict]:
    """Columns of one name that end in _id or _key in two tables, with cardinality by uniqueness."""
    from brindle.operators.profile import distinct_counts

    keys = {n: [c for c in df.columns if c.lower().endswith(("_id", "_key"))] for n, df in tables.items()}
    unique: dict[tuple[str, str], bool] = {}
    for n, df in tables.items():
        if keys[n]:
            rows = df.count()
            unique |= {(n, r.column): r.unique_count == rows for r in distinct_counts(df.select(*keys[n])).collect()}  # a row a key
    side = lambda n, c: "1" if unique[n, c] else "N"
    names = list(tables)
    return [
        {"from_table": a, "from_column": c, "to_table": b, "to_column": c, "cardinality": f"{side(a, c)}:{side(b, c)}"}
        for i, a in enumerate(names)
        for b in names[i + 1 :]
        for c in keys[a]
        if c in keys[b]
    ]
