"""p-values of the test statistics as Arrow UDFs.

They run on result rows (one per test), never on input rows.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from autostat.functions.normal import upper_tail_array

_TINY = 1e-300


def _lgamma(x: np.ndarray) -> np.ndarray:
    return np.array([math.lgamma(v) if v > 0 else math.nan for v in np.ravel(x)]).reshape(np.shape(x))


def _continued_fraction(terms, start: np.ndarray, steps: int = 500) -> np.ndarray:
    """Modified Lentz evaluation of start + n1/(d1 + n2/(d2 + ...)); terms(i) gives (n_i, d_i)."""
    value = np.where(np.abs(start) < _TINY, _TINY, start)
    c, d = value.copy(), np.zeros_like(value)
    with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
        for i in range(1, steps):
            num, den = terms(i)
            d = den + num * d
            d = 1.0 / np.where(np.abs(d) < _TINY, _TINY, d)
            c = den + num / c
            c = np.where(np.abs(c) < _TINY, _TINY, c)
            value = value * c * d
            if np.all(np.abs(c * d - 1.0) < 1e-15):
                break
    return value


def beta_ratio(x, a, b) -> np.ndarray:
    """Regularised incomplete beta I_x(a, b)."""
    x, a, b = (np.atleast_1d(v).astype(float) for v in np.broadcast_arrays(x, a, b))
    x = np.clip(x, 0.0, 1.0)
    flip = x > (a + 1.0) / (a + b + 2.0)
    x, a, b = np.where(flip, 1 - x, x), np.where(flip, b, a), np.where(flip, a, b)

    def terms(i):
        if i == 1:
            return np.ones_like(x), np.ones_like(x)
        m = (i - 1) // 2
        if (i - 1) % 2:
            return -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)), np.ones_like(x)
        return m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), np.ones_like(x)

    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(_lgamma(a + b) - _lgamma(a) - _lgamma(b) + a * np.log(x) + b * np.log1p(-x)) / a
    front = np.where((x <= 0) | (x >= 1), 0.0, front)
    part = np.where(x >= 1, 1.0, front * _continued_fraction(terms, np.zeros_like(x)))
    return np.where(flip, 1.0 - part, part)


def gamma_upper(a, x) -> np.ndarray:
    """Regularised upper incomplete gamma Q(a, x)."""
    a, x = (np.atleast_1d(v).astype(float) for v in np.broadcast_arrays(a, x))
    safe = np.maximum(x, _TINY)
    front = np.exp(-safe + a * np.log(safe) - _lgamma(a))
    term = 1.0 / a
    series = term.copy()
    for i in range(1, 2000):
        term = term * safe / (a + i)
        series = series + term
        if np.all(term <= series * 1e-16):
            break

    def terms(i):
        if i == 1:
            return np.ones_like(x), safe + 1 - a
        return -(i - 1) * (i - 1 - a), safe + 2 * i - 1 - a

    fraction = _continued_fraction(terms, np.zeros_like(x))
    return np.where(x <= 0, 1.0, np.where(safe < a + 1, 1.0 - front * series, front * fraction))


def t_two_sided(t, dof) -> np.ndarray:
    t, dof = np.asarray(t, dtype=float), np.asarray(dof, dtype=float)
    return beta_ratio(dof / (dof + t * t), dof / 2.0, 0.5)


def f_upper(f, dof1, dof2) -> np.ndarray:
    f, dof1, dof2 = (np.asarray(v, dtype=float) for v in (f, dof1, dof2))
    return beta_ratio(dof2 / (dof2 + dof1 * f), dof2 / 2.0, dof1 / 2.0)


def chi2_upper(x, dof) -> np.ndarray:
    return gamma_upper(np.asarray(dof, dtype=float) / 2.0, np.asarray(x, dtype=float) / 2.0)


def studentized_range_upper(q: float, k: int, dof: float) -> float:
    """P(Q > q) for k means: quadrature over the range of k normals and over the scale."""
    if not q > 0:
        return 1.0
    if math.isinf(q):
        return 0.0
    nodes, weights = np.polynomial.legendre.leggauss(96)
    z, wz = 8.0 * nodes, 8.0 * weights
    below = 1.0 - upper_tail_array(z)
    bell = np.exp(-0.5 * z * z) / math.sqrt(2 * math.pi)
    spread = 10.0 / math.sqrt(2.0 * dof)
    low, high = max(1e-8, 1.0 - spread), 1.0 + spread + 2.0 / dof
    s = 0.5 * (high - low) * nodes + 0.5 * (high + low)
    log_scale = (
        0.5 * dof * math.log(dof) - math.lgamma(dof / 2) - (dof / 2 - 1) * math.log(2)
        + (dof - 1) * np.log(s) - 0.5 * dof * s * s
    )
    gap = below[None, :] - (1.0 - upper_tail_array(z[None, :] - q * s[:, None]))
    inside = k * np.sum(wz * bell * np.clip(gap, 0, 1) ** (k - 1), axis=1)
    total = float(np.sum(0.5 * (high - low) * weights * np.exp(log_scale) * np.clip(inside, 0, 1)))
    return min(1.0, max(0.0, 1.0 - total))


@lru_cache(maxsize=None)
def _period_numerator(parts: int) -> tuple[int, list[int]]:
    """(L, A) with 1/((1-q)(1-q)(1-q^2)...(1-q^parts)) = A(q)/(1-q^L)^(parts+1), L the common multiple of 1..parts."""
    period = math.lcm(*range(1, parts + 1))
    numerator = [1]
    for step in (1, *range(1, parts + 1)):
        # Times 1 + q^step + ... + q^(L-step): a running sum with stride `step` and window L.
        out = numerator + [0] * (period - step)
        for i in range(step, len(out)):
            out[i] += out[i - step]
        numerator = [v - (out[i - period] if i >= period else 0) for i, v in enumerate(out)]
    return period, numerator


def _partitions_up_to(total: int, parts: int) -> int:
    """Number of partitions of 0, 1, ..., total into parts no larger than `parts`."""
    if total < 0:
        return 0
    period, numerator = _period_numerator(parts)
    terms = range(total % period, min(total, len(numerator) - 1) + 1, period)
    return sum(numerator[r] * math.comb((total - r) // period + parts, parts) for r in terms)


def exact_rank_sum_two_sided(u: float, n1: int, n2: int) -> float:
    """Exact two-sided Mann-Whitney p (no ties), in integers; the work depends on the smaller group only.

    The number of samples with U <= c is a coefficient sum of the Gaussian binomial: each of the 2^small
    terms of its numerator shifts a partition count, which is a short sum of binomials.
    """
    small, large = min(n1, n2), max(n1, n2)
    least = math.floor(min(u, n1 * n2 - u))
    shifts = {0: 1}
    for i in range(large + 1, large + small + 1):
        for at, sign in list(shifts.items()):
            shifts[at + i] = shifts.get(at + i, 0) - sign
    ways = sum(sign * _partitions_up_to(least - at, small) for at, sign in shifts.items())
    return min(1.0, 2 * ways / math.comb(n1 + n2, small))


def exact_signed_rank_two_sided(t: float, n: int) -> float:
    """Exact two-sided Wilcoxon signed-rank p (no ties, no zeros)."""
    ways = np.zeros(n * (n + 1) // 2 + 1)
    ways[0] = 1.0
    for i in range(1, n + 1):
        ways[i:] += ways[:-i].copy()
    return float(min(1.0, 2.0 * ways[: math.floor(t) + 1].sum() / ways.sum()))


def _clean(values) -> pd.Series:
    out = np.asarray(values, dtype=float)
    return pd.Series(np.where(np.isfinite(out), out, np.nan))


@F.pandas_udf(DoubleType())
def t_p(t: pd.Series, dof: pd.Series) -> pd.Series:
    return _clean(t_two_sided(t, dof)) if len(t) else t


@F.pandas_udf(DoubleType())
def f_p(f: pd.Series, dof1: pd.Series, dof2: pd.Series) -> pd.Series:
    return _clean(f_upper(f, dof1, dof2)) if len(f) else f


@F.pandas_udf(DoubleType())
def chi2_p(x: pd.Series, dof: pd.Series) -> pd.Series:
    return _clean(chi2_upper(x, dof)) if len(x) else x


@F.pandas_udf(DoubleType())
def studentized_range_p(q: pd.Series, k: pd.Series, dof: pd.Series) -> pd.Series:
    rows = zip(q, k, dof, strict=True)
    return pd.Series([np.nan if pd.isna(a) else studentized_range_upper(a, int(b), c) for a, b, c in rows], dtype=float)


@F.pandas_udf(DoubleType())
def rank_sum_exact_p(u: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
    rows = zip(u, n1, n2, strict=True)
    return pd.Series([np.nan if pd.isna(a) else exact_rank_sum_two_sided(a, int(b), int(c)) for a, b, c in rows], dtype=float)


@F.pandas_udf(DoubleType())
def signed_rank_exact_p(t: pd.Series, n: pd.Series) -> pd.Series:
    rows = zip(t, n, strict=True)
    return pd.Series([np.nan if pd.isna(a) else exact_signed_rank_two_sided(a, int(b)) for a, b in rows], dtype=float)
