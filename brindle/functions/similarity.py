"""String similarity: the Indel ratio (2 * longest common subsequence over both lengths, 0 to 100) and that of column names."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def indel_ratio(a: str, b: str) -> float:
    """100 for equal strings; bit-parallel longest common subsequence."""
    if not a and not b:
        return 100.0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & where.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return 200.0 * (len(a) - row.bit_count()) / (len(a) + len(b))


def indel_ratio_column(a: Column, b: Column) -> Column:
    """The ratio of two text columns; null where either is null."""

    def ratios(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else indel_ratio(p, q) for p, q in zip(x, y, strict=True)], dtype="float64")

    return F.pandas_udf(ratios, "double")(a, b)


#: Endings that two names may share.
NAME_ENDINGS = ("id", "key", "code", "name", "date")


def name_similarity(a: str, b: str) -> float:
    """1 equal, 0.8 one inside the other, 0.9 equal before a common ending, else the share of common letters."""
    x, y = (s.lower().translate({ord("_"): None, ord("-"): None}) for s in (a, b))
    if x == y:
        return 1.0
    if x in y or y in x:
        return 0.8
    if any(x.endswith(e) and y.endswith(e) and x.removesuffix(e) == y.removesuffix(e) for e in NAME_ENDINGS):
        return 0.9
    return len({*x} & {*y}) / max(len({*x}), len({*y}), 1)
