"""p-values of the drift tests (small per-feature helpers; scipy is not available).

Both run as column expressions or Arrow-batched pandas UDFs over the per-feature statistics
table (one row per feature), never over data rows.
"""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ks_pvalue(d: Column, n1: Column, n2: Column, terms: int = 100) -> Column:
    """Asymptotic two-sided p-value of the two-sample KS statistic: Kolmogorov's series
    Q(l) = 2 sum_k (-1)^(k-1) exp(-2 k^2 l^2) at l = D sqrt(n1 n2 / (n1 + n2)), clipped to [0, 1]."""
    lam = d * F.sqrt(F.try_divide(n1 * n2, n1 + n2))
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0),
        lambda acc, k: acc + F.pow(F.lit(-1.0), k - 1) * F.exp(-2.0 * k * k * lam * lam))
    p = F.when(lam < 1e-3, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 2.0 * series)))
    return F.when(d.isNotNull(), p)


EXACT_ROWS = 10_000            # rows of the larger side up to which the KS p-value is exact


def ks_outside(d: float, m: int, n: int) -> float:
    """Chance that two samples of ``m`` and ``n`` rows from one continuous distribution have a KS statistic of ``d`` or
    more: the share of lattice paths from (0, 0) to (m, n) that touch |i / m - j / n| >= d.

    A path is a random walk that steps along i with the chance (rows of the first sample left) / (rows left).  What
    leaves the band is summed up as it leaves, so that small chances keep their digits."""
    if min(m, n) < 1:
        return float("nan")
    reach = round(d * m * n)                                    # |i n - j m| is a whole number
    if reach <= 0:
        return 1.0
    inside, outside = np.zeros(m + 1), 0.0
    inside[0] = 1.0
    for k in range(m + n):                                      # all paths have taken k steps; i of them along the first
        low, high = max(0, k - n), min(m, k)
        i = np.arange(low, high + 1)
        up = inside[low:high + 1] * (m - i) / (m + n - k)
        stay = inside[low:high + 1] - up
        nxt = np.zeros(m + 2)
        nxt[low:high + 1] += stay
        nxt[low + 1:high + 2] += up
        i = np.arange(max(0, k + 1 - n), min(m, k + 1) + 1)
        gone = i[np.abs(i * n - (k + 1 - i) * m) >= reach]
        outside += float(nxt[gone].sum())
        nxt[gone] = 0.0
        inside = nxt[:m + 1]
    return min(1.0, outside)


@F.pandas_udf(T.DoubleType())
def ks_exact(d: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
    """Exact p-values over per-feature rows; null where a side has more than ``EXACT_ROWS`` rows."""
    return pd.Series([ks_outside(float(x), int(a), int(b)) if pd.notna(x) and pd.notna(a) and pd.notna(b) and max(a, b) <= EXACT_ROWS else None
                      for x, a, b in zip(d, n1, n2)], dtype="float64")


def _gammaincc(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x): series below a + 1, continued fraction above,
    each until its terms no longer count (their number grows with the square root of a)."""
    if x is None or a is None or math.isnan(x) or x < 0 or a <= 0:
        return float("nan")
    if x == 0:
        return 1.0
    gln = math.lgamma(a)
    if x < a + 1:
        ap, total, delta = a, 1.0 / a, 1.0 / a
        while abs(delta) >= abs(total) * 1e-16:
            ap += 1
            delta *= x / ap
            total += delta
        return max(0.0, 1.0 - total * math.exp(-x + a * math.log(x) - gln))
    tiny = 1e-300
    b = x + 1 - a
    c = 1 / tiny
    d = 1 / b
    h, i, delta = d, 0, 0.0
    while abs(delta - 1) >= 1e-15:
        i += 1
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = tiny if abs(d) < tiny else d
        c = b + an / c
        c = tiny if abs(c) < tiny else c
        d = 1 / d
        delta = d * c
        h *= delta
    return math.exp(-x + a * math.log(x) - gln) * h


@F.pandas_udf(T.DoubleType())
def chi2_sf(stat: pd.Series, dof: pd.Series) -> pd.Series:
    """Survival function of the chi-square distribution, Q(dof / 2, stat / 2)."""
    return pd.Series([_gammaincc(float(k) / 2.0, float(s) / 2.0) if pd.notna(s) and pd.notna(k) and k > 0
                      else float("nan") for s, k in zip(stat, dof)], dtype="float64")
