"""Robust spread, outliers, duplicates, effect labels and smoothing on small and bucketed data."""

import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from autostat.operators import cleaning, compare, outliers, smoothing
from autostat.operators import series as ordered
from autostat.operators.describe import group_moments
from autostat.plans.spec import AnalysisSpec
from autostat.sources import tables

RNG = np.random.default_rng(21)


@pytest.fixture(params=["40", "4000000"])
def buckets(request, spark):
    spark.conf.set("spark.autostat.bucketRows", request.param)
    yield
    spark.conf.unset("spark.autostat.bucketRows")


def mad(x):
    return float(np.median(np.abs(x - np.median(x))))


def test_median_deviation(spark, buckets):
    data = {"skewed": RNG.exponential(1, 301) ** 3, "ties": RNG.integers(0, 4, 200).astype(float), "one": np.array([5.0]), "two": np.array([1.0, 4.0]),
            "three": np.array([1.0, 2.0, 9.0]), "still": np.full(120, 2.5), "even": RNG.normal(size=90), "hot": np.r_[np.zeros(140), RNG.normal(size=139)]}
    df = spark.createDataFrame([(k, float(v)) for k, x in data.items() for v in x] + [("none", None), ("even", None)], "k string, v double")
    found = {r["k"]: r for r in outliers.median_deviation(df, "v", ["k"]).collect()}
    assert set(found) == set(data)
    for k, x in data.items():
        assert (found[k]["n"], found[k]["median"], found[k]["mad"]) == pytest.approx((len(x), float(np.median(x)), mad(x)))
    x = np.concatenate(list(data.values()))
    assert outliers.median_deviation(df, "v").first()["mad"] == pytest.approx(mad(x))


def test_scores_and_limits(spark, buckets):
    x = np.r_[RNG.normal(size=150), 40.0, -55.0]
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)] + [("b", 900, 1.0), ("b", 901, 1.0), ("a", 902, None)], "k string, n int, v double")
    robust = {r["n"]: r for r in outliers.robust_scores(df, "v", ["k"]).collect()}
    assert {i for i, r in robust.items() if r["is_outlier"]} >= {150, 151} and len(robust) == 155
    assert robust[150]["score"] == pytest.approx(0.6745 * (40 - np.median(x)) / mad(x))
    assert robust[900]["score"] is None and not robust[900]["is_outlier"] and not robust[902]["is_outlier"]
    plain = {r["n"]: r["score"] for r in outliers.z_scores(df, "v", ["k"]).collect()}
    assert plain[151] == pytest.approx((-55 - x.mean()) / x.std(ddof=1))
    pulled = outliers.winsorized(df, "v", ["k"], 0.1, 0.9)
    assert pulled.columns == df.columns
    got = {r["n"]: r["v"] for r in pulled.collect()}
    low, high = np.quantile(x, [0.1, 0.9])
    assert all(got[i] == pytest.approx(min(max(v, low), high)) for i, v in enumerate(x)) and got[902] is None and got[900] == 1
    logs = [r["v"] for r in outliers.logged(df.where("n in (150, 151, 902)"), ["v"]).orderBy("n").collect()]
    assert logs[0] == pytest.approx(np.log(40)) and logs[1:] == [None, None]


def test_duplicates(spark):
    df = spark.createDataFrame([(1, "a", 3.0), (1, "a", 3.0), (1, "b", 2.0), (2, None, 5.0), (2, None, 5.0), (None, "c", 1.0), (None, "d", 0.5)], "k int, s string, v double")
    assert cleaning.drop_duplicates(df).frame.count() == 5
    one = cleaning.drop_duplicates(df, ["k"], ["v"])
    assert one.frame.columns == df.columns
    assert sorted(one.frame.collect(), key=str) == sorted([(1, "b", 2.0), (2, None, 5.0), (None, "d", 0.5)], key=str)
    log = one.log_frame().first()
    assert (log["action"], log["n_rows"], log["percent"]) == ("drop", 4, 57.14)
    assert cleaning.drop_duplicates(df.where("k = 9")).log_frame().first()["action"] == "none"


def test_mean_imputation(spark):
    df = spark.createDataFrame([(float(i) if i % 3 else None,) for i in range(30)], "v double")
    values = [r[0] for r in cleaning.fill_missing(df, ["v"], {"v": "numerical"}, centre="mean").frame.collect()]
    assert values[0] == pytest.approx(np.mean([i for i in range(30) if i % 3])) and None not in values
    with pytest.raises(ValueError):
        cleaning.fill_missing(df, ["v"], {"v": "numerical"}, centre="mode")


def test_effects(spark):
    rows = [(g, float(v)) for g, m in (("a", 0), ("b", 0.1), ("c", 3)) for v in RNG.normal(m, 1, 40)]
    of_groups = group_moments(spark.createDataFrame(rows, "g string, y double"), "y", "g")
    eta, omega = (compare.with_effect_label(compare.anova(of_groups, "g", effect=e)).first() for e in ("Eta-squared", "Omega-squared"))
    assert 0 < omega["effect_size"] < eta["effect_size"] and omega["effect_label"] == eta["effect_label"] == "large"
    same = group_moments(spark.createDataFrame([(g, v) for g in "ab" for v in (1.0, 2.0, 3.0, 4.0, 5.0)], "g string, y double"), "y", "g")
    none = compare.with_effect_label(compare.anova(same, "g", effect="Omega-squared")).first()
    assert (none["effect_size"], none["effect_label"]) == (0, "negligible")
    other = spark.createDataFrame([("R", 0.9)], "effect_name string, effect_size double")
    assert compare.with_effect_label(other).first()["effect_label"] is None


def smooth(y, alpha):
    levels, s, sse = [], y[0], 0.0
    for v in y:
        sse, s = sse + (v - s) ** 2, s + alpha * (v - s)
        levels.append(s)
    return levels, sse


@pytest.mark.parametrize("rows", ["7", "1000000"])
def test_smoothing(spark, rows):
    data = {"walk": np.cumsum(RNG.normal(size=150)) + 1e6, "noise": RNG.normal(size=80), "one": np.array([3.0]), "still": np.full(20, 4.0)}
    day = datetime.date(2021, 1, 1)
    frame = pd.DataFrame([(k, day + datetime.timedelta(days=i), v) for k, x in data.items() for i, v in enumerate(x)], columns=["k", "day", "y"])
    spark.conf.set("spark.autostat.bucketRows", rows)
    try:
        series = ordered.place(spark.createDataFrame(frame.sample(frac=1, random_state=2)), "day", ["y"], ["k"])
        fits = smoothing.smoothing_fits(series, "y")
        every = fits.collect()
        levels = smoothing.smoothed(series, "y", fits).orderBy("k", "pos").collect()
        later = smoothing.smoothing_forecast(fits, ["k"]).collect()
    finally:
        spark.conf.unset("spark.autostat.bucketRows")
    assert len(every) == 4 * len(smoothing.ALPHAS) and len(later) == 20
    for k, x in data.items():
        errors = {a: smooth(x, a)[1] for a in smoothing.ALPHAS}
        for r in every:
            if r["k"] == k:
                assert r["sse"] == pytest.approx(errors[r["alpha"]], rel=1e-4, abs=1e-6)
        best = [r for r in every if r["k"] == k and r["best"]]
        assert len(best) == 1 and (len(x) < 30 or best[0]["alpha"] == min(errors, key=errors.get))
        want = smooth(x, best[0]["alpha"])[0]
        mine = [r for r in levels if r["k"] == k]
        assert [r["level"] for r in mine] == pytest.approx(want) and [r["expected"] for r in mine] == pytest.approx([x[0], *want[:-1]])
        assert {r["value"] for r in later if r["k"] == k} == {best[0]["level"]}


def test_request_is_stored(spark, tmp_path):
    spec = AnalysisSpec("y", "compare", group="g", keys=("a", "b"))
    tables.write_results({"t": spark.range(2)}, str(tmp_path), "r1", request=spec)
    stored = {r["parameter"]: r["value"] for r in spark.read.parquet(f"{tmp_path}/run_parameters").where(F.col("run_id") == "r1").collect()}
    assert stored["keys"] == "a, b" and stored["alpha"] == "0.05" and stored["mediator"] is None
