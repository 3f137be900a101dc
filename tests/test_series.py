"""Time series against direct NumPy computations, whole and in chunks."""

import datetime
import math

import numpy as np
import pandas as pd
import pytest

from autostat.operators import series as sr
from autostat.operators import timeseries as ts


def walk(n=160, seed=3):
    return np.cumsum(np.random.default_rng(seed).normal(size=n)) * 3 + 50


def ar1(n=160, seed=4, phi=0.6):
    e = np.random.default_rng(seed).normal(size=n)
    y = np.zeros(n)
    for i in range(1, n):
        y[i] = phi * y[i - 1] + e[i]
    return y + 20


def frame(spark, columns: dict):
    n = len(next(iter(columns.values())))
    days = [datetime.date(2020, 1, 1) + datetime.timedelta(days=i) for i in range(n)]
    pdf = pd.DataFrame({"day": days, **columns}).sample(frac=1, random_state=1)
    return spark.createDataFrame(pdf)


def direct_adf(x):
    """Dickey-Fuller regression written out with a design matrix."""
    n = len(x)
    longest = min(math.ceil(12 * (n / 100) ** 0.25), n // 2 - 2)
    dx = np.diff(x)

    def fit(p, start):
        rows = range(start, n)
        design = np.array([[1.0, x[t - 1], *[dx[t - 1 - i] for i in range(1, p + 1)]] for t in rows])
        target = np.array([dx[t - 1] for t in rows])
        beta, *_ = np.linalg.lstsq(design, target, rcond=None)
        res = target - design @ beta
        return design, beta, float(res @ res)

    scores = []
    for p in range(longest + 1):
        design, _, rss = fit(p, longest + 1)
        scores.append((len(design) * math.log(rss / len(design)) + 2 * design.shape[1], p))
    p = min(scores)[1]
    design, beta, rss = fit(p, p + 1)
    error = rss / (len(design) - design.shape[1])
    return beta[1] / math.sqrt(error * np.linalg.inv(design.T @ design)[1, 1]), p


def direct_kpss(x):
    n, e = len(x), x - x.mean()
    gamma = lambda h: e[h:] @ e[: n - h]
    s0, s1 = gamma(0) / n, 0.0
    for h in range(1, int(n ** (2 / 9)) + 1):
        s0 += gamma(h) / (n / 2)
        s1 += h * gamma(h) / (n / 2)
    width = min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1)
    lr = (gamma(0) + 2 * sum(gamma(h) * (1 - h / (width + 1)) for h in range(1, width + 1))) / n
    return (np.cumsum(e) @ np.cumsum(e)) / n**2 / lr, width


def trend_adf(x, longest):
    """The same regression by QR of a centred design: nested fits from one factor."""
    dx, e = np.diff(x), x - x.mean()
    f = dx - dx.mean()

    def design(p):
        t = np.arange(p + 1, len(x))
        return np.column_stack([np.ones(len(t)), e[t - 1] / np.abs(e).max(), *[f[t - 1 - i] for i in range(1, p + 1)], f[t - 1]])

    r = np.linalg.qr(design(longest), mode="r")[:, -1]
    n = len(x) - longest - 1
    p = min((n * math.log((r[q + 2 :] @ r[q + 2 :]) / n) + 2 * (q + 2), q) for q in range(longest + 1))[1]
    m = design(p)
    beta, *_ = np.linalg.lstsq(m[:, :-1], m[:, -1], rcond=None)
    res = m[:, -1] - m[:, :-1] @ beta
    return beta[1] / math.sqrt(res @ res / (len(m) - p - 2) * np.linalg.inv(m[:, :-1].T @ m[:, :-1])[1, 1]), p


@pytest.mark.parametrize("buckets", [None, "30000"])
def test_steep_trend_keeps_its_digits(spark, buckets):
    n = 200_000
    y = 100.0 * np.arange(n) + np.random.default_rng(8).normal(size=n)
    table = spark.createDataFrame(pd.DataFrame({"t": np.arange(n), "y": y})).repartition(8)
    if buckets:
        spark.conf.set("spark.autostat.bucketRows", buckets)
    try:
        row = ts.Stationarity(sr.place(table, "t", ["y"]), "y").tests().where("d = 0").first()
    finally:
        spark.conf.unset("spark.autostat.bucketRows")
    stat, lag = trend_adf(y, ts.widest_lags(n))
    assert row["adf_lag"] == lag and row["adf_stat"] == pytest.approx(stat, rel=1e-6)


@pytest.mark.parametrize("block", [16, 1 << 18])
def test_lag_products_by_transform(monkeypatch, block):
    monkeypatch.setattr(sr, "BLOCK", block)
    e = np.random.default_rng(9).normal(size=700)
    own = np.where(np.arange(700) >= 90, e, 0)
    for most in (0, 5, 256, 300, 2000):
        want = [own[h:] @ e[: 700 - h] for h in range(min(most, 699) + 1)]
        assert sr.shifted_products(own, e, most) == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("buckets", [None, "30"])
@pytest.mark.parametrize("make", [walk, ar1])
def test_stationarity_matches_direct(spark, make, buckets):
    y = make()
    if buckets:
        spark.conf.set("spark.autostat.bucketRows", buckets)
    try:
        got = ts.Stationarity(sr.place(frame(spark, {"y": y}), "day", ["y"]), "y").tests().toPandas().set_index("d")
    finally:
        spark.conf.unset("spark.autostat.bucketRows")
    for d in (0, 1, 2):
        x = np.diff(y, n=d)
        stat, lag = direct_adf(x)
        assert got.loc[d, "n"] == len(x)
        assert got.loc[d, "adf_lag"] == lag
        assert got.loc[d, "adf_stat"] == pytest.approx(stat, rel=1e-6)
        stat, width = direct_kpss(x)
        assert got.loc[d, "kpss_lag"] == width
        assert got.loc[d, "kpss_stat"] == pytest.approx(stat, rel=1e-8)


def test_many_lags_make_shorter_chunks(spark, monkeypatch):
    y = ar1(200)
    placed = sr.place(frame(spark, {"y": y}), "day", ["y"])
    monkeypatch.setattr(sr, "LAG_CELLS", 600)
    assert sr.chunked(placed, 12).select("chunk").distinct().count() > 3
    got = ts.Stationarity(placed, "y").tests().where("d = 0").first()
    assert got.adf_stat == pytest.approx(direct_adf(y)[0], rel=1e-6)
    assert got.kpss_stat == pytest.approx(direct_kpss(y)[0], rel=1e-8)


def test_degree_of_walk_and_stationary(spark):
    for y, want in ((walk(), 1), (ar1(), 0)):
        tests = ts.Stationarity(sr.place(frame(spark, {"y": y}), "day", ["y"]), "y").tests()
        assert ts.degree_of(tests, []).first()[0] == want
        assert ts.stationarity_log(tests).count() == want + 1


@pytest.mark.parametrize("buckets", [None, "25"])
def test_positions_and_differences(spark, buckets):
    y = walk(120)
    if buckets:
        spark.conf.set("spark.autostat.bucketRows", buckets)
    try:
        s = sr.place(frame(spark, {"y": y}), "day", ["y"])
        placed = s.frame.orderBy("pos").toPandas()
        twice = sr.differences(s, "y", 2).orderBy("pos").toPandas()
        week = sr.seasonal_difference(s, "y", 7).orderBy("pos").toPandas()
    finally:
        spark.conf.unset("spark.autostat.bucketRows")
    assert list(placed.pos) == list(range(1, 121)) and np.allclose(placed.y, y)
    assert np.allclose(twice.y, np.diff(y, n=2)) and list(twice.pos) == list(range(3, 121))
    assert np.allclose(week.y, y[7:] - y[:-7])


@pytest.mark.parametrize("buckets", [None, "40"])
def test_arma_matches_direct_regressions(spark, buckets):
    y = ar1(200, phi=0.7)
    if buckets:
        spark.conf.set("spark.autostat.bucketRows", buckets)
    try:
        work = ts.Stationarity(sr.place(frame(spark, {"y": y}), "day", ["y"]), "y")
        got = ts.arma(work, ts.degree_of(work.tests(), [])).toPandas().set_index(["p", "q"])
    finally:
        spark.conf.unset("spark.autostat.bucketRows")
    n = len(y)
    m = min(math.ceil(math.log(n) ** 1.5), n // 4, math.ceil(12 * (n / 100) ** 0.25) + 1)
    e = y - y.mean()
    lags = np.array([[1.0, *e[t - m : t][::-1]] for t in range(m, n)])
    beta = np.linalg.lstsq(lags, e[m:], rcond=None)[0]
    r = np.full(n, np.nan)
    r[m:] = e[m:] - lags @ beta
    rows = range(m + 2, n)
    for p in range(3):
        for q in range(3):
            design = np.array([[1.0, *[y[t - i] for i in range(1, p + 1)], *[r[t - i] for i in range(1, q + 1)]] for t in rows])
            target = y[m + 2 :]
            b = np.linalg.lstsq(design, target, rcond=None)[0]
            rss = float(((target - design @ b) ** 2).sum())
            k = len(rows)
            aic = k * (math.log(2 * math.pi * rss / k) + 1) + 2 * (p + q + 2)
            assert got.loc[(p, q), "n_used"] == k
            assert got.loc[(p, q), "aic"] == pytest.approx(aic, rel=1e-6)
            z, last = [y[-1], y[-2]], [r[-1], r[-2]]
            want = []
            for _ in range(5):
                nxt = b[0] + sum(b[1 + i] * z[i] for i in range(p)) + sum(b[1 + p + i] * last[i] for i in range(q))
                z, last = [nxt, z[0]], [0.0, last[0]]
                want.append(nxt)
            assert np.allclose(got.loc[(p, q), "forecast"], want, rtol=1e-5)
    assert got.best.sum() == 1 and got.loc[got.best].index[0] == got.aic.idxmin()


@pytest.mark.parametrize("buckets", [None, "50"])
def test_var_matches_direct(spark, buckets):
    rng = np.random.default_rng(8)
    y, x = np.zeros(150), np.zeros(150)
    for i in range(1, 150):
        y[i] = 0.5 * y[i - 1] + 0.3 * x[i - 1] + rng.normal()
        x[i] = 0.4 * x[i - 1] + rng.normal()
    if buckets:
        spark.conf.set("spark.autostat.bucketRows", buckets)
    try:
        s = sr.place(frame(spark, {"y": y, "x": x}), "day", ["y", "x"])
        got = ts.var(s, spark.createDataFrame([(0,)], "degree int")).first()
    finally:
        spark.conf.unset("spark.autostat.bucketRows")
    data, best = np.column_stack([y, x]), None
    for lags in (1, 2, 3):
        design = np.array([[1.0, *np.concatenate([data[t - i] for i in range(1, lags + 1)])] for t in range(3, 150)])
        b = np.linalg.lstsq(design, data[3:], rcond=None)[0]
        res = data[3:] - design @ b
        aic = np.linalg.slogdet(res.T @ res / len(design))[1] + 2 * 2 * design.shape[1] / len(design)
        if best is None or aic < best[0]:
            best = (aic, lags, b)
    assert got.lags == best[1] and got.aic == pytest.approx(best[0], rel=1e-8)
    coefficients = {(t.equation, t.term): t.coefficient for t in got.terms}
    assert coefficients[("y", "L1.x")] == pytest.approx(best[2][2, 0], rel=1e-7)
    past, want = list(data), []
    for _ in range(5):
        past.append(np.concatenate([[1.0], *[past[-1 - i] for i in range(best[1])]]) @ best[2])
        want.append(past[-1][0])
    assert np.allclose(got.forecast, want)


def test_forecasts_return_to_the_original_scale(spark):
    out = ts.analyze_series(frame(spark, {"y": walk(80, seed=11) + 1000}), "day", "y")
    steps = out["forecast"].orderBy("step").toPandas()
    assert list(steps.step) == [1, 2, 3, 4, 5]
    assert steps.value.between(900, 1100).all()
    history = out["history"].toPandas()
    assert (history.kind == "forecast").sum() == 5 and history.pos.max() == 85


def test_short_series_is_refused(spark):
    with pytest.raises(ValueError, match="at least 10"):
        ts.analyze_series(frame(spark, {"y": walk(9)}), "day", "y")


def test_many_series_equal_each_alone(spark):
    parts = {"a": walk(60, 1), "b": ar1(45, 2), "short": walk(6, 3)}
    pdf = pd.concat(
        pd.DataFrame({"k": k, "t": np.arange(len(v)), "y": v}) for k, v in parts.items()
    )
    both = ts.analyze_series(spark.createDataFrame(pdf), "t", "y", (), ["k"])["forecast"].toPandas()
    assert set(both.k) == {"a", "b"}
    for k in ("a", "b"):
        alone = ts.analyze_series(spark.createDataFrame(pdf[pdf.k == k][["t", "y"]]), "t", "y")["forecast"].toPandas()
        assert np.allclose(both[both.k == k].sort_values("step").value, alone.sort_values("step").value)


def test_constant_series_is_not_stationary(spark):
    tests = ts.Stationarity(sr.place(frame(spark, {"y": np.full(40, 5.0)}), "day", ["y"]), "y").tests()
    assert tests.where("is_stationary").count() == 0


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_shared_timestamps_are_cut_too(spark, keys):
    """A third of all rows at one time: positions follow (time, value), and no bucket holds them all."""
    rng = np.random.default_rng(1)
    n = 1500
    t = np.where(rng.random(n) < 0.34, 700, rng.integers(0, 1500, n))
    pdf = pd.DataFrame({"k": np.where(rng.random(n) < 0.6, "a", "b"), "t": t, "y": np.round(rng.normal(size=n), 4)})
    spark.conf.set("spark.autostat.bucketRows", "60")
    try:
        s = sr.place(spark.createDataFrame(pdf), "t", ["y"], keys)
        got = s.frame.toPandas()
        rows = spark.createDataFrame(pdf).selectExpr("k", "double(t) as __t", "y", "1 as __one")
        ties = sr._tied_times(rows, "y", s.layout)
        assert 700.0 in ties.points
        cut = sr.spread(rows, "__t", keys, s.layout.isolating(ties.points), "__one", ties).groupBy(*keys, "__bucket").count()
        assert cut.agg({"count": "max"}).first()[0] < 200
    finally:
        spark.conf.unset("spark.autostat.bucketRows")
    want = pdf.sort_values([*keys, "t", "y"])
    want["pos"] = (want.groupby(keys).cumcount() if keys else np.arange(n)) + 1
    assert np.allclose(got.sort_values([*keys, "pos"]).y, want.sort_values([*keys, "pos"]).y)
    assert list(got.sort_values([*keys, "pos"]).pos) == list(want.sort_values([*keys, "pos"]).pos)


def test_long_series_is_cut_below_a_sorting_bucket(spark):
    """A quarter of a million rows fit one sorting bucket, but are more than one task may hold in lags and differences."""
    s = sr.place(spark.range(250_000).selectExpr("249999 - id AS t", "CAST(id % 7 AS DOUBLE) AS y"), "t", ["y"])
    assert not s.layout.single and s.layout.buckets >= 3
    chunks = sr.chunked(s, 12).selectExpr("*", "IF(own, 1, 0) AS one").groupBy("chunk").agg({"one": "sum", "pos": "max"}).collect()
    assert len(chunks) >= 3 and max(r["sum(one)"] for r in chunks) <= 100_000 and max(r["max(pos)"] for r in chunks) == 250_000
    assert s.frame.where("y != (250000 - pos) % 7").count() == 0
