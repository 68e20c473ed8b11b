"""Samplers by inverse distribution functions of a uniform column; integers stay integers."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from brindle.functions import rng


def uniform_between(u: Column, low: float, high: float) -> Column:
    return F.lit(float(low)) + u * F.lit(float(high - low))


def exponential(u: Column, scale: float) -> Column:
    return F.lit(-float(scale)) * F.ln(F.lit(1.0) - u)


def lognormal(z: Column, mu: float, sigma: float) -> Column:
    return F.exp(F.lit(float(mu)) + F.lit(float(sigma)) * z)


def pareto(u: Column, alpha: float, scale: float = 1.0) -> Column:
    return F.pow(F.lit(1.0) - u, F.lit(-1.0 / alpha)) * F.lit(float(scale))


def clip(c: Column, low: float | None, high: float | None) -> Column:
    c = F.greatest(c, F.lit(float(low))) if low is not None else c
    return F.least(c, F.lit(float(high))) if high is not None else c


def discrete(u: Column, masses: list[float]) -> Column:
    """The smallest k whose cumulative mass exceeds u; what is left goes to the last."""
    return rng.weighted(u, list(range(len(masses))), masses).cast("long")


def poisson(u: Column, rate: float) -> Column:
    """Inverse of the Poisson distribution; small rates only, by a chain of its masses (rate + 12 deviations)."""
    if rate <= 0:
        return F.lit(0).cast("long")
    top = int(rate + 12 * math.sqrt(rate) + 12)
    return discrete(u, [math.exp(k * math.log(rate) - rate - math.lgamma(k + 1)) for k in range(top)])


def binomial(u: Column, n: int, p: float) -> Column:
    if p <= 0 or p >= 1:
        return F.lit(n if p >= 1 else 0).cast("long")
    mass = lambda k: math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p))
    return discrete(u, [mass(k) for k in range(n + 1)])


def beta(u: Column, a: float, b: float, steps: int = 2048) -> Column:
    """Inverse of the beta distribution by interpolating in a table of its integral (an Arrow function)."""

    def inverse(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import numpy as np

        mid = (np.arange(steps) + 0.5) / steps
        mass = mid ** (a - 1) * (1 - mid) ** (b - 1)
        total = np.concatenate([[0.0], np.cumsum(mass)])
        for s in batches:
            yield pd.Series(np.interp(s.to_numpy() * total[-1], total, np.arange(steps + 1) / steps))

    return F.pandas_udf(inverse, "double")(u)


def sample(kind: str, seed: int, stream: str, key: Column, **p) -> Column:
    """One of uniform, normal, lognormal, exponential, poisson, binomial, pareto, beta, weighted_choice, sequential, cyclic."""
    u = rng.uniform(seed, stream, key)
    if kind == "uniform":
        return uniform_between(u, p.get("low", 0), p.get("high", 1))
    if kind == "normal":
        return F.lit(float(p.get("mean", 0))) + F.lit(float(p.get("std", 1))) * rng.normal(seed, stream, key)
    if kind == "lognormal":
        return lognormal(rng.normal(seed, stream, key), p.get("mean", 0), p.get("sigma", 1))
    if kind == "exponential":
        return exponential(u, p.get("scale", 1))
    if kind == "poisson":
        return poisson(u, p.get("lam", 1))
    if kind == "binomial":
        return binomial(u, p.get("n", 10), p.get("p", 0.5))
    if kind == "pareto":
        return pareto(u, p.get("alpha", 2), p.get("scale", 1))
    if kind == "beta":
        return beta(u, p.get("a", 2), p.get("b", 5))
    if kind == "weighted_choice":
        return rng.weighted(u, p["values"], p.get("weights") or [1.0] * len(p["values"]))
    if kind == "sequential":
        return F.lit(p.get("start", 1)) + key * F.lit(p.get("step", 1))
    if kind == "cyclic":
        return F.element_at(F.array(*map(F.lit, p["values"])), (key % len(p["values"])).cast("int") + 1)
    raise ValueError(f"unknown distribution {kind!r}")
