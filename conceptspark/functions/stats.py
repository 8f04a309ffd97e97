"""Distribution helpers. The Python functions only ever see rows that are already aggregated."""

from __future__ import annotations

import math
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

TABLED_DF = 120


def t_cdf(t: float, df: int) -> float:
    """Student t distribution function for an integer number of degrees of freedom (finite series)."""
    theta = math.atan2(t, math.sqrt(df))
    c2 = math.cos(theta) ** 2
    if df % 2:
        term, total = math.cos(theta), 0.0
        for k in range(1, (df - 1) // 2 + 1):
            total += term
            term *= c2 * 2 * k / (2 * k + 1)
        return 0.5 + (theta + math.sin(theta) * total) / math.pi
    term, total = 1.0, 0.0
    for k in range(1, df // 2 + 1):
        total += term
        term *= c2 * (2 * k - 1) / (2 * k)
    return 0.5 + 0.5 * math.sin(theta) * total


@cache
def t_quantile_975(df: int) -> float:
    low, high = 0.0, 20.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if t_cdf(middle, df) < 0.975 else (low, middle)
    return (low + high) / 2


def t_975(df: Column) -> Column:
    """Quantile column: tabled up to 120 degrees of freedom, expansion around the normal beyond."""
    table = F.create_map(*[x for d in range(1, TABLED_DF + 1) for x in (F.lit(d), F.lit(t_quantile_975(d)))])
    z = 1.959963984540054
    tail = F.lit(z) + (z**3 + z) / (4 * df) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * df * df)
    return F.when(df <= TABLED_DF, table[df.cast("int")]).otherwise(tail)


def chi2_tail(x: float, df: int) -> float:
    """P(chi-square with integer ``df`` > x) by its finite series."""
    if x <= 0:
        return 1.0
    half = x / 2
    if df % 2 == 0:
        term, total = 1.0, 1.0
        for k in range(1, df // 2):
            term *= half / k
            total += term
        return math.exp(-half) * total
    total = math.erfc(math.sqrt(half))
    term = math.sqrt(half) / math.gamma(1.5)
    for k in range(1, (df - 1) // 2 + 1):
        total += term * math.exp(-half)
        term *= half / (k + 0.5)
    return total


def binomial_two_sided(b: int, c: int) -> float:
    """Exact two-sided sign test; terms shrink from the middle out, so the sum stops when they vanish."""
    n, low = b + c, min(b, c)
    if n == 0:
        return 1.0
    log_term = math.lgamma(n + 1) - math.lgamma(low + 1) - math.lgamma(n - low + 1) - n * math.log(2)
    term = total = math.exp(log_term)
    k = low
    while k > 0 and term > total * 1e-18:
        term *= k / (n - k + 1)
        total += term
        k -= 1
    return min(1.0, 2 * total)


@F.pandas_udf(DoubleType())
def chi2_p(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([chi2_tail(a, int(d)) if a == a else None for a, d in zip(x, df)], dtype="float64")


@F.pandas_udf(DoubleType())
def normal_two_sided_p(z: pd.Series) -> pd.Series:
    return z.map(lambda v: min(1.0, math.erfc(v / math.sqrt(2)))).astype("float64")


@cache
def u_tails(a: int, b: int) -> tuple[int, ...]:
    """Numbers of arrangements of ``a`` and ``b`` values without ties whose U is at least 0, 1, …, a·b.

    Arrangements with U = u are the partitions of u into at most ``a`` parts of at most ``b``: the coefficients of
    prod (1 - q^(b+i)) / (1 - q^i), i = 1 … a, worked out in whole numbers of any size.
    """
    a, b = min(a, b), max(a, b)
    size = a * b + 1
    ways = np.zeros(size, dtype=object)
    ways[0] = 1
    for i in range(1, a + 1):
        if b + i < size:
            ways[b + i :] = ways[b + i :] - ways[: size - b - i]
        for start in range(min(i, size)):
            ways[start::i] = np.cumsum(ways[start::i])
    return tuple(np.cumsum(ways[::-1])[::-1])


def exact_u_two_sided(u: float, a: int, b: int) -> float:
    """Twice the chance that U is at least as far from its middle on the larger side, at most 1."""
    tails = u_tails(a, b)
    return min(1.0, 2 * int(tails[math.ceil(max(u, a * b - u))]) / int(tails[0]))


@F.pandas_udf(DoubleType())
def exact_u_p(u: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([exact_u_two_sided(x, int(m), int(n)) for x, m, n in zip(u, a, b)], dtype="float64")


@F.pandas_udf(DoubleType())
def mcnemar_p(b: pd.Series, c: pd.Series) -> pd.Series:
    return pd.Series([binomial_two_sided(int(x), int(y)) for x, y in zip(b, c)], dtype="float64")
