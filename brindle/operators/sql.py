"""SQL over one table or a context, updates and deletes as rewrites, and SQL text builders."""

from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.operators import filters

DEFAULT_LIMIT, MAX_LIMIT = 1000, 200_000


def run_sql(spark: SparkSession, text: str, tables: dict[str, DataFrame], limit: int | None = None) -> DataFrame:
    """SQL that sees each table under its name.  The names live for this statement only, so calls don't meet."""
    views = {name: f"v_{uuid.uuid4().hex}" for name in tables}
    for name, view in views.items():
        tables[name].createOrReplaceTempView(view)
    try:
        out = spark.sql(_renamed(text, views))
    finally:
        for view in views.values():
            spark.catalog.dropTempView(view)
    return out if limit is None else out.limit(limit)


def _renamed(text: str, views: dict[str, str]) -> str:
    """The statement inside WITH names AS (SELECT * FROM view): user text stays as it is."""
    ctes = ", ".join(f"`{name}` AS (SELECT * FROM {view})" for name, view in views.items())
    head = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", text, re.IGNORECASE)
    if head:
        return f"WITH {head[1] or ''}{ctes}, {text[head.end():]}"
    return f"WITH {ctes} {text}"


def query(spark: SparkSession, df: DataFrame, text: str, limit: int | None = DEFAULT_LIMIT) -> DataFrame:
    """SQL over one table named data; a limit of at most MAX_LIMIT applies to the result (None: no limit, for exports)."""
    return run_sql(spark, text, {"data": df}, None if limit is None else min(limit, MAX_LIMIT))


def _value(v, as_expression: bool) -> Column:
    return F.expr(v) if as_expression else F.lit(v)


def update(df: DataFrame, values: dict, where: dict | str, expressions: Sequence[str] = ()) -> DataFrame:
    """Set columns where an equality map or SQL text holds; columns named in expressions get SQL text instead of a literal."""
    cond = F.expr(where) if isinstance(where, str) else filters.equals(where)
    types = dict(df.dtypes)
    return df.withColumns({c: F.when(cond, _value(v, c in expressions)).otherwise(F.col(f"`{c}`")).cast(types[c]) if c in types else F.when(cond, _value(v, c in expressions)) for c, v in values.items()})


def delete(df: DataFrame, where: dict | str, strict_sql: bool = False) -> DataFrame:
    """Rows where the condition doesn't hold; with strict_sql, rows where it is unknown go too."""
    cond = F.expr(where) if isinstance(where, str) else filters.equals(where)
    return df.filter(~cond if strict_sql else ~F.coalesce(cond, F.lit(False)))


def affected(df: DataFrame, where: dict | str) -> int:
    return df.filter(F.expr(where) if isinstance(where, str) else filters.equals(where)).count()


def dry_run(df: DataFrame, where: dict | str, rows: int = 100) -> DataFrame:
    """Up to `rows` rows that a change would touch."""
    return df.filter(F.expr(where) if isinstance(where, str) else filters.equals(where)).limit(rows)


def transform_column(df: DataFrame, column: str, kind: str, config: dict | None = None) -> DataFrame:
    """upper, lower, trim, round, abs, cast, replace, extract or custom_sql on one column; others leave it.  The column moves last."""
    p, c = config or {}, F.col(f"`{column}`")
    made = {
        "upper": lambda: F.upper(c),
        "lower": lambda: F.lower(c),
        "trim": lambda: F.trim(c),
        "round": lambda: F.round(c, p.get("decimals", 2)),
        "abs": lambda: F.abs(c),
        "cast": lambda: c.cast(p.get("type", "string")),
        "replace": lambda: F.replace(c, F.lit(p.get("old", "")), F.lit(p.get("new", ""))),
        "extract": lambda: F.regexp_extract(c, p.get("pattern", ".*"), 0),
        "custom_sql": lambda: F.expr(p["expression"]),
    }.get(kind, lambda: c)()
    return df.select(*(F.col(f"`{x}`") for x in df.columns if x != column), made.alias(column))


def add_column(df: DataFrame, column: str, expression: str) -> DataFrame:
    return df.withColumn(column, F.expr(expression))


# ---- text builders ---------------------------------------------------------------------------------------------------


def literal(v) -> str:
    """A value as SQL text, quotes doubled."""
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v).upper()
    return str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"


def _where(where: dict | str | None) -> str:
    if not where:
        return ""
    return " WHERE " + (where if isinstance(where, str) else " AND ".join(f"{c} IS NULL" if v is None else f"{c} = {literal(v)}" for c, v in where.items()))


def select_text(table: str, columns: Sequence[str] = ("*",), where=None, group_by: Sequence[str] = (), order_by: Sequence[str] = (), limit: int | None = None) -> str:
    tail = (f" GROUP BY {', '.join(group_by)}" if group_by else "") + (f" ORDER BY {', '.join(order_by)}" if order_by else "") + (f" LIMIT {limit}" if limit is not None else "")
    return f"SELECT {', '.join(columns)} FROM {table}{_where(where)}{tail}"


def insert_text(table: str, row: dict) -> str:
    return f"INSERT INTO {table} ({', '.join(row)}) VALUES ({', '.join(map(literal, row.values()))})"


def update_text(table: str, values: dict, where=None) -> str:
    return f"UPDATE {table} SET {', '.join(f'{c} = {literal(v)}' for c, v in values.items())}{_where(where)}"


def delete_text(table: str, where=None) -> str:
    return f"DELETE FROM {table}{_where(where)}"


def join_text(left: str, right: str, on: str, how: str = "INNER", columns: Sequence[str] = ("*",)) -> str:
    return f"SELECT {', '.join(columns)} FROM {left} {how.upper()} JOIN {right} ON {on}"


def aggregate_text(table: str, group_by: Sequence[str], aggregations: list[dict], where=None) -> str:
    made = [f"{a['function'].upper()}({a['column']}) AS {a.get('alias') or a['column'] + '_' + a['function']}" for a in aggregations]
    return select_text(table, [*group_by, *made], where, group_by)


def union_text(statements: Sequence[str], keep_all: bool = False) -> str:
    return (" UNION ALL " if keep_all else " UNION ").join(statements)


def case_text(conditions: list[dict], otherwise=None, alias: str | None = None) -> str:
    whens = " ".join(f"WHEN {c['when']} THEN {literal(c['then'])}" for c in conditions)
    return f"CASE {whens} ELSE {literal(otherwise)} END" + (f" AS {alias}" if alias else "")


def build(spec: dict) -> str:
    """Text from {type: select|insert|update|delete|join|aggregate|union, and that builder's arguments}."""
    makers = {"select": select_text, "insert": insert_text, "update": update_text, "delete": delete_text, "join": join_text, "aggregate": aggregate_text, "union": union_text}
    args = dict(spec)
    return makers[args.pop("type")](**args)
