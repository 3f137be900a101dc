"""Stationarity tests, differencing degree, ARMA and VAR models with 5-step forecasts, for many series at once.

Spark computes lag products, end values and moment matrices; Python only solves the small
systems those leave, one result row per series.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from autostat.functions.columns import join_on, own_keys, restore_keys
from autostat.functions.normal import polynomial, upper_tail_array
from autostat.operators.gram import gram, matrix
from autostat.operators.order import attach
from autostat.operators.series import (
    MAX_DIFFERENCES, Series, centred, chunked, end_values, lag_products, ordered_by, place, squared_partial_sums,
)
from autostat.sources.checkpoints import cut_lineage

SHORTEST, STEPS, LEVEL = 10, 5, 0.05
SERIES_TABLES = ("stationarity_log", "model", "coefficients", "forecast", "history")
# Up to this length all lag products are taken in the first pass: no bandwidth can need more.
SHORT_SERIES = 200

# Unit-root p-value surface with a constant (MacKinnon 1994), high order first, and its limits.
UNIT_ROOT_SMALL = (0.038269, 1.4412, 2.1659)
UNIT_ROOT_LARGE = (-0.010368, -0.12745, 0.93202, 1.7339)
UNIT_ROOT_LOW, UNIT_ROOT_SPLIT, UNIT_ROOT_HIGH = -18.83, -1.61, 2.74
# Critical values of the level-stationarity statistic (Kwiatkowski et al. 1992).
KPSS_POINTS = ((0.347, 0.10), (0.463, 0.05), (0.574, 0.025), (0.739, 0.01))


def most_lags(n: Column) -> Column:
    """Longest lag of the unit-root regression for a series of n values."""
    n = n.cast("double")
    return F.least(F.ceil(12.0 * F.pow(n / 100.0, F.lit(0.25))), F.floor(n / 2) - 2)


def widest_lags(n: int) -> int:
    return max(1, min(math.ceil(12.0 * (n / 100.0) ** 0.25), n // 2 - 2))


def unit_root_p(stat: float) -> float:
    if stat > UNIT_ROOT_HIGH:
        return 1.0
    if stat < UNIT_ROOT_LOW:
        return 0.0
    fit = UNIT_ROOT_SMALL if stat <= UNIT_ROOT_SPLIT else UNIT_ROOT_LARGE
    return float(upper_tail_array(np.array([-polynomial(fit, stat)]))[0])


def kpss_p(stat: Column) -> Column:
    """Interpolated between the table points, within [0.01, 0.10]."""
    out = F.when(stat <= KPSS_POINTS[0][0], KPSS_POINTS[0][1])
    for (x0, p0), (x1, p1) in zip(KPSS_POINTS, KPSS_POINTS[1:], strict=False):
        out = out.when(stat <= x1, p0 + (stat - x0) / (x1 - x0) * (p1 - p0))
    return out.otherwise(KPSS_POINTS[-1][1])


def lagged_levels(products: np.ndarray, head: np.ndarray, tail: np.ndarray, n: int, m: int) -> np.ndarray:
    """Moment matrix of (1, e(t), e(t-1), .., e(t-m)) over t = m+1..n, from whole-series lag products.

    A product sum over the shifted range is the whole-series sum less a few end terms.
    """
    out = np.empty((m + 2, m + 2))
    out[0, 0] = n - m
    for i in range(m + 1):
        out[0, i + 1] = out[i + 1, 0] = -head[: m - i].sum() - (tail[-i:].sum() if i else 0.0)
        for j in range(i, m + 1):
            h = j - i
            first = head[h : m - i] @ head[: max(m - i - h, 0)]
            last = tail[-i:] @ tail[-i - h : len(tail) - h] if i else 0.0
            out[i + 1, j + 1] = out[j + 1, i + 1] = products[h] - first - last
    return out


def _solve(moments: np.ndarray, x: Sequence[int], y: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Least squares from a moment matrix: coefficients, inverse, residual sum of squares."""
    part = moments[np.ix_(x, x)]
    size = np.sqrt(np.diag(part))
    size[size == 0] = 1.0
    inverse = np.linalg.inv(part / np.outer(size, size)) / np.outer(size, size)
    beta = inverse @ moments[x, y]
    return beta, inverse, max(float(moments[y, y] - beta @ moments[x, y]), 0.0)


def unit_root_moments(level: tuple, step: tuple, n: int, p: int) -> np.ndarray:
    """Moment matrix of (1, e(t-1), f(t-1), .., f(t-p), f(t)) over t = p+2..n; f is the difference of e less its mean.

    `level` is (products, head, tail) of e, `step` the same of f and its mean. Sums of differences come from the lag
    products of the differenced series, never from differences of the levels' large sums; sums of level times
    difference from e(s) de(s) = (e(s)^2 - e(s-1)^2 + de(s)^2) / 2, which telescopes to end values.
    """
    (products, head, tail), (*steps, mean) = level, step
    f = lagged_levels(*steps, n - 1, p)
    rows, sums = f[0, 0], f[0, 1:]
    raw = f[1:, 1:] + mean * (sums[:, None] + sums) + rows * mean * mean
    out = np.empty((p + 3, p + 3))
    order = [*range(1, p + 1), 0]  # f(t-1), .., f(t-p), f(t)
    out[2:, 2:] = f[1:, 1:][np.ix_(order, order)]
    out[0, 2:] = out[2:, 0] = sums[order]
    out[0, 0] = rows
    out[0, 1] = out[1, 0] = -head[:p].sum() - tail[-1]
    out[1, 1] = products[0] - head[:p] @ head[:p] - tail[-1] ** 2
    for at, j in enumerate(order, 2):
        last, first = tail[-1 - j], head[p - j]
        ends = (last - first) * (last + first)
        crossed = (ends - raw[0, 0]) / 2 if j == 0 else (ends + raw[j, j]) / 2 + raw[1:j, j].sum()
        out[1, at] = out[at, 1] = crossed - mean * out[0, 1]
    return out


def unit_root(level: tuple, step: tuple, n: int, longest: int) -> tuple[float, int]:
    """t-ratio of the augmented Dickey-Fuller regression with a constant; lag by AIC on the common sample."""
    full = unit_root_moments(level, step, n, longest)
    rows, best = n - longest - 1, (math.inf, 0)
    for p in range(longest + 1):
        rss = _solve(full, list(range(p + 2)), longest + 2)[2]
        if rows <= p + 2:
            break
        score = rows * math.log(max(rss, 1e-300) / rows) + 2 * (p + 2)
        if score < best[0]:
            best = (score, p)
    p = best[1]
    beta, inverse, rss = _solve(unit_root_moments(level, step, n, p), list(range(p + 2)), p + 2)
    error = rss / (n - p - 1 - (p + 2))
    return float(beta[1] / math.sqrt(error * inverse[1, 1])), p


def _with_unit_root(stats: DataFrame) -> DataFrame:
    """Add adf_stat, adf_lag, adf_p to every row of `Stationarity.stats`."""
    names = stats.columns
    fields = T.StructType([*stats.schema.fields, *T.StructType.fromDDL("adf_stat double, adf_lag int, adf_p double").fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for row in batch.itertuples(index=False):
                result = (np.nan, None, 1.0)
                try:
                    level = tuple(np.asarray(v, float) for v in (row.products, row.head, row.tail))
                    step = tuple(np.asarray(v, float) for v in (row.step_products, row.step_head, row.step_tail, row.step_mean))
                    stat, lag = unit_root(level, step, int(row.n), int(row.longest))
                    if math.isfinite(stat):
                        result = (stat, lag, unit_root_p(stat))
                except (np.linalg.LinAlgError, ZeroDivisionError, ValueError, IndexError, TypeError):
                    pass  # a constant or too short series has no unit-root statistic: not stationary
                found.append(result)
            more = pd.DataFrame(found, columns=["adf_stat", "adf_lag", "adf_p"], index=batch.index)
            more["adf_lag"] = more["adf_lag"].astype("Int32")
            yield pd.concat([batch[names], more], axis=1)

    return stats.mapInPandas(run, fields)


def _auto_bandwidth() -> Column:
    """Bandwidth of the long-run variance (Hobijn et al. 1998) from products[h] / n."""
    n = F.col("n").cast("double")
    span = F.floor(F.pow(n, F.lit(2.0 / 9.0))).cast("int")
    lags = F.sequence(F.lit(1), F.greatest(span, F.lit(1)))
    term = lambda i: F.col("products")[i] / (n / 2)
    s0 = F.aggregate(lags, F.col("products")[0] / n, lambda a, i: a + term(i))
    s1 = F.aggregate(lags, F.lit(0.0), lambda a, i: a + i * term(i))
    s = F.try_divide(s1, s0)
    width = F.floor(1.1447 * F.pow(s * s, F.lit(1.0 / 3.0)) * F.pow(n, F.lit(1.0 / 3.0)))
    return F.least(F.coalesce(width, F.lit(0)), F.col("n") - 1).cast("int")


class Stationarity:
    """Lag products of a placed series and its differences, and the tests read off them."""

    def __init__(self, series: Series, column: str):
        self.series, self.column, self.keys = series, column, series.keys
        self.at = [*self.keys, "d"]
        # The longest series bounds every window; the row count is such a bound.
        rows = series.layout.rows
        if self.keys and rows > SHORT_SERIES:
            rows = series.frame.agg(F.max("pos")).first()[0] or 1
        self.complete = rows <= SHORT_SERIES
        self.widest = rows if self.complete else widest_lags(rows) + 1
        self.rows = centred(series, column, self.widest + 1)
        longest = F.greatest(most_lags(F.col("n")), F.lit(0))
        most = F.col("n") if self.complete else longest + 1
        products = lag_products(self.rows, self.keys, most, self.widest)
        ends = end_values(self.rows, self.keys, longest + 2).withColumn("longest", longest.cast("int"))
        walks = squared_partial_sums(self.rows.where(F.col("d") <= MAX_DIFFERENCES), self.keys)
        # One row per series and degree: all tests and the first autoregression start from here.
        every = cut_lineage(join_on(join_on(ends, products, self.at), walks, self.at, "left"))
        step = every.select(*self.keys, (F.col("d") - 1).alias("d"), F.col("m").alias("step_mean"),
                            *[F.col(c).alias(f"step_{c}") for c in ("products", "head", "tail")])
        self.stats = join_on(every.where(F.col("d") <= MAX_DIFFERENCES), step, self.at, "left")

    def _long_run(self) -> DataFrame:
        """`stats` with the bandwidth and the long-run variance it gives."""
        known = self.stats.withColumn("bandwidth", _auto_bandwidth()).withColumn("wide", F.col("products"))
        top = (0, 0)
        if not self.complete:
            top = known.agg(F.max(F.col("bandwidth") - F.size("products") + 1), F.max("bandwidth")).first()
        if (top[0] or 0) > 0:
            # Some series needs lags beyond the first pass: one more pass, wide enough for all.
            wide = int(top[1])
            rows = centred(self.series, self.column, wide)
            need = known.select(*self.at, F.col("n").alias("w"), "bandwidth")
            rows = attach(rows, need, self.at, self.series.layout, "w", ["bandwidth"]).where(F.col("bandwidth").isNotNull())
            products = lag_products(rows, self.keys, F.col("bandwidth"), wide)
            known = join_on(known.drop("wide"), products.withColumnRenamed("products", "wide"), self.at)
        w = F.col("bandwidth")
        lags = F.when(w > 0, F.sequence(F.lit(1), F.greatest(w, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        lr = F.aggregate(lags, F.col("wide")[0], lambda a, i: a + 2 * F.col("wide")[i] * (1 - i / (w + 1.0))) / F.col("n")
        return known.withColumn("lr", lr).drop("wide")

    def tests(self) -> DataFrame:
        """One row per series and degree 0, 1, 2: both statistics, p-values and the verdict."""
        n = F.col("n").cast("double")
        both = _with_unit_root(self._long_run())
        both = both.withColumn("kpss_stat", F.try_divide(F.col("walk") / (n * n), F.col("lr")))
        p = F.when(F.col("kpss_stat").isNull(), 0.0).otherwise(kpss_p(F.col("kpss_stat")))
        both = both.withColumn("kpss_p", p)
        verdict = (F.col("adf_p") < LEVEL) & (F.col("kpss_p") >= LEVEL)
        adf = F.when(~F.isnan("adf_stat"), F.col("adf_stat")).alias("adf_stat")
        return both.select(
            *self.at, "n", adf, "adf_lag", "adf_p", "kpss_stat", F.col("bandwidth").alias("kpss_lag"), "kpss_p",
            verdict.alias("is_stationary"),
        )


def degree_of(tests: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, degree): first stationary degree, else 2."""
    first = F.min(F.when(F.col("is_stationary"), F.col("d")))
    return tests.groupBy(*keys).agg(F.coalesce(first, F.lit(MAX_DIFFERENCES)).alias("degree"))


def stationarity_log(tests: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The degrees tried until one is stationary, with a label each."""
    log = join_on(tests, degree_of(tests, keys), keys).where(F.col("d") <= F.col("degree"))
    label = F.when(F.col("is_stationary"), "stationary").otherwise("not stationary (unit root)")
    return log.withColumn("label", label).drop("degree")


# --- ARMA by two regressions (Hannan & Rissanen 1982) ---

ORDERS = [(p, q) for p in range(3) for q in range(3)]
ARMA_FIELDS = "p int, q int, n_used long, aic double, bic double, sigma2 double, terms array<struct<term:string,coefficient:double,p_value:double>>, forecast array<double>"


def long_order(n: Column) -> Column:
    """Order of the first, long autoregression."""
    n = n.cast("double")
    rule = F.ceil(F.pow(F.log(n), F.lit(1.5)))
    return F.greatest(F.lit(1), F.least(rule, F.floor(n / 4), most_lags(n) + 1)).cast("int")


def _long_autoregression(stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, d, weights, shift, size): residual weights (1, -phi1, ..), constant and length of the long autoregression."""
    fields = T.StructType([*[stats.schema[k] for k in [*keys, "d"]], *T.StructType.fromDDL("weights array<double>, shift double, size long").fields])
    width, names = len(keys) + 1, fields.fieldNames()

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                m = int(row.order)
                levels = lagged_levels(*(np.asarray(v, float) for v in (row.products, row.head, row.tail)), int(row.n), m)
                # The pseudo-inverse gives zero weights to a constant series.
                x = [0, *range(2, m + 2)]
                beta = np.linalg.pinv(levels[np.ix_(x, x)]) @ levels[x, 1]
                out.append((*row[:width], [1.0, *(-beta[1:])], float(beta[0]), int(row.n)))
            yield pd.DataFrame(out, columns=names)

    return stats.select(*keys, "d", "n", "products", "head", "tail", "order").mapInPandas(run, fields)


def _arma_fit(moments: np.ndarray, p: int, q: int, constant: bool):
    """Second regression on p lags of z and q lags of the residuals; columns are (1, z, z1, z2, r1, r2)."""
    x = ([0] if constant else []) + [2 + i for i in range(p)] + [4 + i for i in range(q)]
    n = moments[0, 0]
    if not x:
        return np.zeros(0), np.zeros((0, 0)), float(moments[1, 1]) / n, x
    beta, inverse, rss = _solve(moments, x, 1)
    return beta, inverse, rss / n, x


def _arma_rows(n: int, means, cov, d: int, tail_z, tail_r, levels) -> list[tuple]:
    full = np.empty((6, 6))
    means = np.asarray(means, float)
    full[0, 0], full[0, 1:] = n, n * means
    full[1:, 0] = full[0, 1:]
    full[1:, 1:] = matrix(cov, 5) * (n - 1) + n * np.outer(means, means)
    out = []
    for p, q in ORDERS:
        try:
            beta, inverse, sigma2, x = _arma_fit(full, p, q, d == 0)
        except np.linalg.LinAlgError:
            continue
        sigma2 = max(sigma2, 1e-300)
        count = len(x) + 1
        loglik = -0.5 * n * (math.log(2 * math.pi * sigma2) + 1)
        se = np.sqrt(np.diag(inverse) * sigma2) if len(x) else np.zeros(0)
        with np.errstate(divide="ignore", invalid="ignore"):
            ps = 2 * upper_tail_array(np.abs(beta / se)) if len(x) else se
        ar, ma = np.zeros(2), np.zeros(2)
        first = 1 if d == 0 else 0
        ar[:p], ma[:q] = beta[first : first + p], beta[first + p :]
        constant = beta[0] if d == 0 else 0.0
        names = (["const"] if d == 0 else []) + [f"ar.L{i + 1}" for i in range(p)] + [f"ma.L{i + 1}" for i in range(q)]
        values = list(beta)
        if d == 0 and abs(1 - ar.sum()) > 1e-12:
            values[0] = constant / (1 - ar.sum())  # reported as the level of the process
        terms = [(a, float(b), float(c)) for a, b, c in zip(names, values, ps, strict=True)]
        terms.append(("sigma2", float(sigma2), None))
        z, r, path, last = list(tail_z), list(tail_r), [], list(levels)
        for _ in range(STEPS):
            nxt = constant + ar[0] * z[-1] + ar[1] * z[-2] + ma[0] * r[-1] + ma[1] * r[-2]
            z, r = [z[-1], nxt], [r[-1], 0.0]
            level = nxt if d == 0 else nxt + last[-1] if d == 1 else nxt + 2 * last[-1] - last[-2]
            last = [last[-1], level]
            path.append(float(level))
        out.append((p, q, n, -2 * loglik + 2 * count, -2 * loglik + count * math.log(n), float(sigma2), terms, path))
    return out


def arma(stationarity: Stationarity, degrees: DataFrame) -> DataFrame:
    """All nine (p, q) orders of every series at its differencing degree; lowest AIC is `best`."""
    s, keys = stationarity, stationarity.keys
    stats = join_on(s.stats, degrees, keys).where(F.col("d") == F.col("degree")).drop("degree")
    weights = _long_autoregression(stats.withColumn("order", long_order(F.col("n"))), keys)
    rows = attach(s.rows, weights, s.at, s.series.layout, "size", ["weights", "shift"]).where(F.col("weights").isNotNull())
    back = ordered_by(keys, "d")
    recent = F.reverse(F.collect_list("e").over(back.rowsBetween(-s.widest, 0)))
    rows = rows.withColumn("recent", recent)
    products = F.zip_with(F.slice("recent", 1, F.size("weights")), F.col("weights"), lambda a, b: a * b)
    residual = F.when(
        F.size("recent") >= F.size("weights"), F.aggregate(products, F.lit(0.0), lambda a, x: a + x) - F.col("shift")
    )
    rows = rows.withColumn("r", residual).drop("recent", "weights")
    lagged = rows.withColumns(
        {"z1": F.lag("z").over(back), "z2": F.lag("z", 2).over(back), "r1": F.lag("r").over(back), "r2": F.lag("r", 2).over(back)}
    ).where("own")
    at = [*s.at]
    # Moments and the last two values (original level, z, residual) in one pass.
    last = F.array_sort(F.collect_list(F.when(F.col("pos") > F.col("n") - 2, F.struct("pos", "z", "r", "level"))))
    base = gram(lagged, ["z", "z1", "z2", "r1", "r2"], at, [last.alias("t")])
    ends = [F.col(f"t.{c}").alias(f"last_{c}") for c in ("z", "r", "level")]
    base = base.select(*at, "n", "means", "cov", *ends)
    fields = T.StructType([*[base.schema[k] for k in at], *T.StructType.fromDDL(ARMA_FIELDS).fields])
    width, names, d_at = len(at), fields.fieldNames(), len(keys)

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                found = _arma_rows(int(row.n), row.means, row.cov, int(row[d_at]), row.last_z, row.last_r, row.last_level)
                out += [(*row[:width], *f) for f in found]
            yield pd.DataFrame(out, columns=names)

    fitted = base.mapInPandas(run, fields)
    best = F.row_number().over(Window.partitionBy(*keys).orderBy("aic", "p", "q")) == 1
    return fitted.withColumn("best", best)


# --- Vector autoregression ---

VAR_FIELDS = "lags int, n_used long, aic double, bic double, terms array<struct<equation:string,term:string,coefficient:double>>, forecast array<double>"


def _var_rows(n: int, means, cov, columns: Sequence[str], longest: int, d: int, last, history) -> list[tuple]:
    k = len(columns)
    size = k * (longest + 1)
    means = np.asarray(means, float)
    full = np.empty((size + 1, size + 1))
    full[0, 0], full[0, 1:] = n, n * means
    full[1:, 0] = full[0, 1:]
    full[1:, 1:] = matrix(cov, size) * (n - 1) + n * np.outer(means, means)
    y = list(range(1, k + 1))
    best = None
    for lags in range(1, longest + 1):
        x = [0, *range(k + 1, k + 1 + k * lags)]
        try:
            beta = np.linalg.solve(full[np.ix_(x, x)], full[np.ix_(x, y)])
        except np.linalg.LinAlgError:
            continue
        residual = full[np.ix_(y, y)] - beta.T @ full[np.ix_(x, y)]
        sign, logdet = np.linalg.slogdet(residual / n)
        if sign <= 0 or n <= len(x):
            continue
        free = k * len(x)
        aic, bic = logdet + 2 * free / n, logdet + math.log(n) * free / n
        if best is None or aic < best[0]:
            best = (aic, bic, lags, beta)
    if best is None:
        return []
    aic, bic, lags, beta = best
    names = ["const", *[f"L{i + 1}.{c}" for i in range(lags) for c in columns]]
    terms = [(columns[j], names[i], float(beta[i, j])) for j in range(k) for i in range(len(names))]
    past, path, level = [np.asarray(v, float) for v in history], [], list(last)
    for _ in range(STEPS):
        row = np.concatenate([[1.0], *[past[-1 - i] for i in range(lags)]])
        past.append(row @ beta)
        nxt = past[-1][0]
        value = nxt if d == 0 else nxt + level[-1] if d == 1 else nxt + 2 * level[-1] - level[-2]
        level = [level[-1], value]
        path.append(float(value))
    return [(lags, n, float(aic), float(bic), terms, path)]


def var(series: Series, degrees: DataFrame) -> DataFrame:
    """Vector autoregression of all value columns at the first column's degree; 1..3 lags by AIC."""
    keys, columns, longest = series.keys, series.values, 3
    order = ordered_by(keys)
    sized = series.frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    shape = join_on(sized, degrees, keys)
    rows = attach(chunked(series, longest + MAX_DIFFERENCES), shape, keys, series.layout, "n", ["n", "degree"])
    level = {}
    for c in columns:
        one, two = F.lag(c).over(order), F.lag(c, 2).over(order)
        level[f"__{c}"] = (
            F.when(F.col("degree") == 0, F.col(c)).when(F.col("degree") == 1, F.col(c) - one).otherwise(F.col(c) - 2 * one + two)
        )
    rows = rows.withColumns(level)
    lagged = {f"__{c}_{i}": F.lag(f"__{c}", i).over(order) for i in range(1, longest + 1) for c in columns}
    rows = rows.withColumns(lagged).where("own")
    usable = F.least(F.lit(longest), F.floor((F.col("n") - F.col("degree")) / 5)).cast("int")
    named = [*[f"__{c}" for c in columns], *[f"__{c}_{i}" for i in range(1, longest + 1) for c in columns]]
    # Moments and the last rows in one pass.
    now = F.struct("pos", F.array(*[f"__{c}" for c in columns]).alias("v"), F.col(columns[0]).alias("y"))
    last = F.array_sort(F.collect_list(F.when(F.col("pos") > F.col("n") - longest, now)))
    base = gram(rows, named, keys, [last.alias("t"), F.max("degree").alias("d"), F.max(usable).alias("usable")])
    base = base.where("usable >= 1").select(
        *keys, "n", "means", "cov", "d", "usable", F.transform("t", lambda x: x["v"]).alias("history"),
        F.transform("t", lambda x: x["y"]).alias("last"),
    )
    fields = T.StructType([*[base.schema[k] for k in keys], base.schema["d"], *T.StructType.fromDDL(VAR_FIELDS).fields])
    width, names = len(keys), fields.fieldNames()

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                size = len(columns) * (int(row.usable) + 1)
                whole = matrix(row.cov, len(columns) * (longest + 1))
                part = whole[:size, :size][np.triu_indices(size)]
                found = _var_rows(int(row.n), row.means[:size], part, columns, int(row.usable), int(row.d), row.last, row.history)
                out += [(*row[:width], row.d, *f) for f in found]
            yield pd.DataFrame(out, columns=names)

    return base.mapInPandas(run, fields)


def forecast_rows(models: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, step 1..5, value)."""
    long = models.select(*keys, F.posexplode("forecast").alias("step", "value"))
    return long.withColumn("step", (F.col("step") + 1).cast("int"))


def history_and_forecast(series: Series, column: str, forecast: DataFrame) -> DataFrame:
    """(keys, pos, value, kind): the plotted series with its continuation."""
    history = series.frame.select(*series.keys, "pos", F.col(column).alias("value"), F.lit("history").alias("kind"))
    ends = series.frame.groupBy(*series.keys).agg(F.max("pos").alias("n"))
    future = join_on(forecast, ends, series.keys).select(
        *series.keys, (F.col("n") + F.col("step")).alias("pos"), "value", F.lit("forecast").alias("kind")
    )
    return history.unionByName(future)


def analyze_series(
    df: DataFrame, time: str, y: str, xs: Sequence[str] = (), keys: Sequence[str] = ()
) -> dict[str, DataFrame]:
    """Stationarity log, model, coefficients, forecast and plot data; series below 10 values are left out."""
    df, names = own_keys(df, keys)
    tables = _analyze_series(df, time, y, xs, [names.get(k, k) for k in keys])
    return {name: restore_keys(table, names) for name, table in tables.items()}


def _analyze_series(
    df: DataFrame, time: str, y: str, xs: Sequence[str], keys: Sequence[str]
) -> dict[str, DataFrame]:
    keys, columns = list(keys), list(dict.fromkeys([y, *xs]))
    placed = place(df, time, columns, keys)
    # Read by every later step: stored once instead of being ordered again.
    series = Series(cut_lineage(placed.frame), keys, columns, placed.layout)
    if keys:
        sizes = series.frame.groupBy(*keys).agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= SHORTEST)
        sizes = sizes.withColumn("long_enough", F.lit(True))
        kept = attach(series.frame, sizes, keys, series.layout, "size", ["long_enough"]).where("long_enough").drop("long_enough")
        series = Series(kept, keys, columns, series.layout)
    elif series.layout.rows < SHORTEST:
        raise ValueError(f"a time series needs at least {SHORTEST} rows")
    work = Stationarity(Series(series.frame.select(*keys, "pos", y), keys, [y], series.layout), y)
    tests = work.tests()
    degrees = degree_of(tests, keys)
    if xs:
        best = cut_lineage(var(series, degrees))
        model = best.select(*keys, F.lit("VAR (Vector Autoregression)").alias("model"), "d", "lags", "n_used", "aic", "bic")
        terms = best.select(*keys, F.inline("terms"))
    else:
        best = cut_lineage(arma(work, degrees).where("best"))
        model = best.select(*keys, F.lit("ARIMA").alias("model"), "p", "d", "q", "n_used", "aic", "bic", "sigma2")
        terms = best.select(*keys, F.inline("terms"))
    forecast = forecast_rows(best, keys)
    return {
        "stationarity_log": stationarity_log(tests, keys), "model": model, "coefficients": terms, "forecast": forecast,
        "history": history_and_forecast(series, y, forecast),
    }
