"""The transform pipeline: an ordered list of steps folded into one lazy plan."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.operators import filters, relational

#: Names of types in cast steps; others mean string.
TYPES = {"int": "bigint", "integer": "bigint", "float": "double", "decimal": "double", "string": "string", "str": "string", "bool": "boolean", "boolean": "boolean", "date": "date", "datetime": "timestamp"}


def cast_columns(df: DataFrame, casts: dict[str, str], strict: bool = True) -> DataFrame:
    to = {c: TYPES.get(str(t).lower(), "string") for c, t in casts.items()}
    return df.withColumns({c: F.col(f"`{c}`").cast(t) if strict else F.col(f"`{c}`").try_cast(t) for c, t in to.items()})


def _named(p: dict, *names: str, default=None):
    return next((p[n] for n in names if p.get(n) is not None), default)


def _list(x) -> list:
    return [] if x is None else [x] if isinstance(x, str) else list(x)


def _rename(df: DataFrame, p: dict) -> DataFrame:
    names = _named(p, "mapping", "columns", "renames")
    return df.withColumnsRenamed(names if isinstance(names, dict) else {_named(p, "old_name", "from", "column"): _named(p, "new_name", "to", "name")})


def _drop(df: DataFrame, p: dict) -> DataFrame:
    names = _list(_named(p, "columns", "column"))
    missing = set(names) - set(df.columns)
    if missing:
        raise ValueError(f"no such columns: {sorted(missing)}")
    return df.drop(*names)


STEPS = {
    "filter": lambda df, p: filters.filter_rows(df, _named(p, "conditions", default=[p] if "operator" in p else [])),
    "select": lambda df, p: df.select(*(F.col(f"`{c}`") for c in _list(_named(p, "columns", "column", "cols")))),
    "rename": _rename,
    "cast": lambda df, p: cast_columns(df, _named(p, "casts", default={p.get("column"): _named(p, "dtype", "to")})),
    "aggregate": lambda df, p: relational.aggregate(df, p["group_by"], p["aggregations"], p.get("order_by")),
    "sort": lambda df, p: relational.sort(df, _named(p, "columns", "by", "column"), p.get("descending", False)),
    "fill_null": lambda df, p: relational.fill_nulls(df, p["column"], p.get("strategy", "literal"), p.get("value"), p.get("order_by")),
    "add_literal": lambda df, p: df.withColumn(p["name"], F.lit(_named(p, "value", "expression"))),
    "add_column": lambda df, p: df.withColumn(p["name"], F.expr(p["expression"])),
    "drop_columns": _drop,
    "drop_nulls": lambda df, p: relational.drop_nulls(df, _list(_named(p, "columns", "column"))),
    "unique": lambda df, p: relational.unique(df, _list(_named(p, "columns", "subset")), p.get("keep", "any"), p.get("order_by")),
    "limit": lambda df, p: df.limit(int(_named(p, "n", "limit", default=1000))),
}
ALIASES = {"rename_column": "rename", "rename_columns": "rename", "fill_nulls": "fill_null", "drop_column": "drop_columns", "group_by": "aggregate"}


def normalise(step: dict | str) -> tuple[str, dict] | None:
    """Kind and parameters of a step (JSON text too); None if it isn't one."""
    if isinstance(step, str):
        try:
            step = json.loads(step)
        except ValueError:
            return None
    if not isinstance(step, dict):
        return None
    kind = str(_named(step, "type", "operation", "op", default="")).strip().lower()
    params = {k: v for k, v in step.items() if k not in ("type", "operation", "config")} | (step.get("config") or {})
    kind = ALIASES.get(kind, kind)
    return (kind, params) if kind in STEPS else None


def transform(df: DataFrame, steps: list) -> tuple[DataFrame, list[dict]]:
    """The resulting plan, and a line for each step; what isn't a step is noted and skipped."""
    log: list[dict] = []

    def apply(df: DataFrame, step) -> DataFrame:
        known = normalise(step)
        log.append({"step": len(log) + 1, "type": known[0] if known else None, "applied": bool(known)})
        return STEPS[known[0]](df, known[1]) if known else df

    return reduce(apply, steps, df), log
