"""Predicates: condition lists, equality maps and CASE builders, compiled to Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPERATORS = ("==", "!=", ">", ">=", "<", "<=", "in", "not_in", "contains", "is_null", "is_not_null")


def condition(column: str, operator: str, value=None) -> Column:
    """One condition; contains is a regular expression search.  An unknown operator is an error."""
    c = F.col(f"`{column}`")
    plain = {"==": lambda: c == value, "!=": lambda: c != value, ">": lambda: c > value, ">=": lambda: c >= value, "<": lambda: c < value, "<=": lambda: c <= value}
    if operator in plain:
        return plain[operator]()
    if operator == "in":
        return c.isin(*value)
    if operator == "not_in":
        return ~c.isin(*value)
    if operator == "contains":
        return c.rlike(value)
    if operator == "is_null":
        return c.isNull()
    if operator == "is_not_null":
        return c.isNotNull()
    raise ValueError(f"unknown operator {operator!r}; there are {', '.join(OPERATORS)}")


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def filter_rows(df: DataFrame, conditions: list[dict]) -> DataFrame:
    """Rows that fulfil all conditions {column, operator, value}."""
    return df.filter(all_of([condition(c["column"], c["operator"], c.get("value")) for c in conditions]))


def equals(where: dict) -> Column:
    """AND of column = value; None matches null; an empty map is true."""
    return all_of([F.col(f"`{c}`").isNull() if v is None else F.col(f"`{c}`") == F.lit(v) for c, v in where.items()])


def case_when(conditions: list[dict], otherwise=None) -> Column:
    """conditions: {when: SQL text, then: literal}; the first that holds decides."""
    out = None
    for c in conditions:
        out = F.when(F.expr(c["when"]), F.lit(c["then"])) if out is None else out.when(F.expr(c["when"]), F.lit(c["then"]))
    return F.lit(otherwise) if out is None else out.otherwise(F.lit(otherwise))
