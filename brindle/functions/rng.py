"""Counter-based random numbers: functions of seed, stream and row key, so neither partitions nor retries change them.

DuckDB computes the same values, which gives samplers and generators a value oracle (see `sql_*`).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0


def _text(seed: int, stream: str, key: Column) -> Column:
    return F.concat(F.lit(f"{seed}:{stream}:"), key.cast("string"))


def bits(seed: int, stream: str, key: Column) -> Column:
    """32 random bits as a long."""
    return F.conv(F.substring(F.md5(_text(seed, stream, key)), 1, 8), 16, 10).cast("long")


def uniform(seed: int, stream: str, key: Column) -> Column:
    return bits(seed, stream, key) / F.lit(TWO_32)


def normal(seed: int, stream: str, key: Column) -> Column:
    u = (bits(seed, f"{stream}.a", key) + 1) / F.lit(TWO_32 + 1)
    return F.sqrt(F.lit(-2.0) * F.ln(u)) * F.cos(F.lit(6.283185307179586) * uniform(seed, f"{stream}.b", key))


def order_key(seed: int, key: Column) -> Column:
    """Sorting by this shuffles."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def pick(seed: int, stream: str, key: Column, values: list) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (bits(seed, stream, key) % len(values)).cast("int") + 1)


def weighted(u: Column, values: list, weights: list[float]) -> Column:
    """The value whose share of cumulative weight holds u."""
    total, at = sum(weights), 0.0
    out = None
    for value, weight in list(zip(values, weights, strict=True))[:-1]:
        at += weight / total
        out = F.when(u < at, F.lit(value)) if out is None else out.when(u < at, F.lit(value))
    return F.lit(values[-1]) if out is None else out.otherwise(F.lit(values[-1]))


def sql_bits(seed: int, stream: str, key: str) -> str:
    return f"CAST('0x' || substr(md5('{seed}:{stream}:' || CAST({key} AS VARCHAR)), 1, 8) AS BIGINT)"


def sql_uniform(seed: int, stream: str, key: str) -> str:
    return f"({sql_bits(seed, stream, key)} / 4294967296.0::DOUBLE)"


def sql_normal(seed: int, stream: str, key: str) -> str:
    u = f"(({sql_bits(seed, stream + '.a', key)} + 1) / 4294967297.0::DOUBLE)"
    return f"(sqrt(-2.0::DOUBLE * ln({u})) * cos(6.283185307179586::DOUBLE * {sql_uniform(seed, stream + '.b', key)}))"


def sql_pick(seed: int, stream: str, key: str, values: list) -> str:
    listed = ", ".join(f"'{v}'" if isinstance(v, str) else repr(v) for v in values)
    return f"([{listed}])[CAST({sql_bits(seed, stream, key)} % {len(values)} AS INTEGER) + 1]"


def sql_weighted(u: str, values: list, weights: list[float]) -> str:
    total, at, out = sum(weights), 0.0, ""
    text = lambda v: f"'{v}'" if isinstance(v, str) else repr(v)
    for value, weight in list(zip(values, weights, strict=True))[:-1]:
        at += weight / total
        out += f" WHEN {u} < {at!r}::DOUBLE THEN {text(value)}"
    return f"CASE{out} ELSE {text(values[-1])} END" if out else text(values[-1])
