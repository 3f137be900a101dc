"""All pairs of groups from one ordering, against counting every pair of rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from autostat.operators import compare, pairs

RNG = np.random.default_rng(5)


def brute(x, y):
    u = sum((a > y).sum() + 0.5 * (a == y).sum() for a in x)
    values, n = np.unique(np.r_[x, y], return_counts=True)
    ties, size = float((n.astype(float) ** 3 - n).sum()), len(x) + len(y)
    sd = np.sqrt(len(x) * len(y) / 12 * ((size + 1) - ties / (size * (size - 1))))
    return u, (max(u, len(x) * len(y) - u) - len(x) * len(y) / 2 - 0.5) / sd


@pytest.mark.parametrize("cells", [1 << 20, 3])
def test_walk(monkeypatch, cells):
    monkeypatch.setattr(pairs, "CELLS", cells)
    group, value, count = RNG.integers(0, 4, 60), RNG.integers(0, 9, 60).astype(float), RNG.integers(1, 4, 60)
    above, cross = pairs.walked(group, value, count, 4, 0.5)
    of = [np.repeat(value[group == g], count[group == g]) for g in range(4)]
    for a in range(4):
        for b in range(4):
            if a != b:
                assert above[a, b] == brute(of[a], of[b])[0]
                n = [[(of[g] == v).sum() for v in range(9)] for g in (a, b)]
                assert cross[a, b] == sum(x * x * y for x, y in zip(*n, strict=True))


@pytest.mark.parametrize("bucket", ["40", "4000000"])
def test_pairwise_in_buckets_and_segments(spark, bucket):
    sizes = {("x", "a"): 90, ("x", "b"): 50, ("x", "c"): 33, ("y", "a"): 7, ("y", "b"): 12, (None, "a"): 60, (None, "c"): 70}
    data = {at: RNG.integers(0, 25, n) + len(at[1]) * 2.0 for at, n in sizes.items()}
    rows = [(s, g, float(v)) for (s, g), values in data.items() for v in values] + [("x", None, 1.0), ("x", "a", None)]
    df = spark.createDataFrame(rows, "s string, g string, y double")
    spark.conf.set("spark.autostat.bucketRows", bucket)
    try:
        found = {(r["s"], r["group1"], r["group2"]): r for r in compare.pairwise_mann_whitney(df, "y", "g", ["s"]).collect()}
        alone = compare.pairwise_mann_whitney(df.where("s = 'x'"), "y", "g").collect()
        plan = compare.pairwise_mann_whitney(df, "y", "g", ["s"])._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.autostat.bucketRows")
    assert len(found) == 5 and len(alone) == 3
    for (s, a, b), r in found.items():
        u, z = brute(data[s, a], data[s, b])
        assert (r["statistic"], r["z"]) == pytest.approx((u, z))
    assert all(r["statistic"] == found["x", r["group1"], r["group2"]]["statistic"] for r in alone)
    assert "explode(array(group1" not in plan  # no row is copied to the pairs of its group


def test_apart_and_many_groups(spark):
    """Groups that share no value, and pairs whose second group is always larger."""
    rows = spark.range(600).select((F.col("id") % 30).cast("string").alias("g"), (F.col("id") % 30 * 100 + F.col("id") / 30).alias("y"))
    found = {(int(r["group1"]), int(r["group2"])): r["statistic"] for r in compare.pairwise_mann_whitney(rows, "y", "g").collect()}
    assert len(found) == 435 and all(u == (0 if a < b else 400) for (a, b), u in found.items())
