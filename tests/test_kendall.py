"""Kendall's tau-b against counting every pair of rows."""

import itertools
import math

import numpy as np
import pytest

from autostat.operators import kendall as k
from autostat.operators.correlate import correlation_summary

RNG = np.random.default_rng(11)


def brute(x, y):
    s = sum(np.sign(a[0] - b[0]) * np.sign(a[1] - b[1]) for a, b in itertools.combinations(zip(x, y, strict=True), 2))
    n, (t, u) = len(x), (np.unique(v, return_counts=True)[1].astype(float) for v in (x, y))
    two, three, five = (lambda c: (c * (c - 1)).sum()), (lambda c: (c * (c - 1) * (c - 2)).sum()), (lambda c: (c * (c - 1) * (2 * c + 5)).sum())
    size = math.sqrt((n * (n - 1) - two(t)) * (n * (n - 1) - two(u))) / 2
    spread = (n * (n - 1) * (2 * n + 5) - five(t) - five(u)) / 18 + two(t) * two(u) / (2 * n * (n - 1))
    spread += three(t) * three(u) / (9 * n * (n - 1) * (n - 2))
    return s / size, math.erfc(abs(s) / math.sqrt(spread) / math.sqrt(2))


@pytest.mark.parametrize("distinct", [1, 2, 7, 400])
def test_discordant_pairs_of_one_task(distinct):
    x, y, w = RNG.integers(0, distinct, 150), RNG.normal(size=150).round(1 if distinct < 400 else 8), RNG.integers(1, 5, 150)
    want = sum(w[i] * w[j] for i in range(150) for j in range(150) if x[i] < x[j] and y[i] > y[j])
    assert k.discordant(x, y, w) == want
    assert k.discordant(np.empty(0), np.empty(0), np.empty(0)) == 0


@pytest.mark.parametrize("bucket", ["40", "4000000"])
def test_tau_in_buckets_and_segments(spark, bucket):
    n = 500
    y = RNG.normal(size=n)
    half = np.where(RNG.random(n) < 0.5, 3.0, RNG.normal(size=n))  # one value in half of all rows
    data = {"smooth": y + RNG.normal(size=n), "hot": half + 0.2 * y, "coarse": (y + RNG.normal(size=n)).round(), "still": np.ones(n)}
    data["hot"][::2] = 3.0
    seg = np.where(np.arange(n) < 440, "big", "small")
    rows = [(str(s), float(v), *[float(data[c][i]) for c in data]) for i, (s, v) in enumerate(zip(seg, y, strict=True))]
    df = spark.createDataFrame([*rows, ("big", None, 1.0, 1.0, 1.0, 1.0)], ["g", "y", *data])
    spark.conf.set("spark.autostat.bucketRows", bucket)
    try:
        keyed = k.kendall(df, "y", [*data], ["g"]).collect()
        whole = k.kendall(df, "y", [*data, "absent"]).collect()
    finally:
        spark.conf.unset("spark.autostat.bucketRows")
    assert len(keyed) == 8 and len(whole) == 4
    for r in [*keyed, *whole]:
        of = seg == r["g"] if "g" in r else np.ones(n, bool)
        if r["variable"] == "still":
            assert (r["r"], r["p_value"]) == (0, 1)
        else:
            assert (r["r"], r["p_value"]) == pytest.approx(brute(data[r["variable"]][of], y[of]), rel=1e-6, abs=1e-12)


def test_in_the_other_tables_form(spark):
    df = spark.createDataFrame([(float(i), float(i * i), float(-i)) for i in range(20)], "y double, a double, b double")
    rows = k.kendall(df, "y", ["a", "b"])
    assert [(r["r"], r["direction"]) for r in rows.orderBy("position").collect()] == [(1, "positive"), (-1, "negative")]
    assert correlation_summary(rows).first()["is_significant"]
    assert k.kendall(df.where("y < 0"), "y", ["a"]).count() == 0
