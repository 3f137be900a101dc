"""Ordered counts: same numbers whatever the buckets, the partitions and the skew."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from autostat.operators import compare, correlate, order
from autostat.operators.correlate import spearman
from autostat.operators.describe import describe, group_moments
from autostat.operators.normality import normality
from autostat.operators.order import CUT_POINTS, attach, midrank, ordered_counts, plan_layout, quantiles


def skewed(spark, n=3000):
    """A third of all rows in one key and in one value; NULL keys form a segment of their own."""
    rng = np.random.default_rng(5)
    key = np.where(rng.random(n) < 0.34, "hot", rng.choice(list("abcdefgh"), n))
    value = np.where(rng.random(n) < 0.34, 7.0, np.round(rng.exponential(10, n), 1))
    df = pd.DataFrame({"k": key, "v": value, "w": np.round(rng.normal(size=n), 2) + value / 20})
    df.loc[::97, "k"] = None
    return df, spark.createDataFrame(df).withColumn("k", F.when(F.col("k") != "NaN", F.col("k")))


def test_lookup_of_many_large_segments(spark, small_buckets, monkeypatch):
    _, df = skewed(spark)
    few = sorted(map(tuple, ordered_counts(df, "v", ["k"], ["w"]).collect()), key=str)
    monkeypatch.setattr(order, "LARGE_SEGMENTS", 0)
    many = ordered_counts(df, "v", ["k"], ["w"])
    assert sorted(map(tuple, many.collect()), key=str) == few


@pytest.mark.parametrize("buckets", [None, 40, 700])
@pytest.mark.parametrize("parts", [1, 16])
def test_midranks_match_pandas(spark, buckets, parts):
    pdf, df = skewed(spark)
    if buckets:
        spark.conf.set("spark.autostat.bucketRows", str(buckets))
    try:
        got = ordered_counts(df.repartition(parts), "v", ["k"]).select("k", "v", "cnt", midrank().alias("rk"), "total").toPandas()
    finally:
        spark.conf.unset("spark.autostat.bucketRows")
    pdf["rk"] = pdf.groupby("k", dropna=False)["v"].rank()
    want = pdf.groupby(["k", "v"], dropna=False).agg(cnt=("v", "size"), rk=("rk", "first")).reset_index()
    both = got.merge(want, on=["k", "v"], how="outer")
    assert len(both) == len(want) == len(got)
    assert (both.cnt_x == both.cnt_y).all() and np.allclose(both.rk_x, both.rk_y)
    sizes = pdf.groupby("k", dropna=False).size()
    assert (got.groupby("k", dropna=False).cnt.sum() == sizes).all()


def test_quantiles_match_pandas(spark, small_buckets):
    pdf, df = skewed(spark)
    got = quantiles(df, "v", {"q1": 0.25, "q2": 0.5, "q3": 0.9}, ["k"]).toPandas().set_index("k")
    want = pdf.groupby("k", dropna=False)["v"].quantile([0.25, 0.5, 0.9]).unstack()
    for name, p in (("q1", 0.25), ("q2", 0.5), ("q3", 0.9)):
        assert np.allclose(got[name].sort_index(), want[p].sort_index())


@pytest.mark.parametrize("shape", ["F.col('id') * 1.7", "F.pow(F.lit(1.01), F.col('id') / 2)", "F.exp(F.col('id') / 40.0)"])
def test_large_layout_cuts_again(spark, shape):
    """More buckets than one pass has cut points, also for a long tail."""
    df = spark.range(0, 5000).select("id", eval(shape).alias("v"))
    spark.conf.set("spark.autostat.bucketRows", "2")
    try:
        layout = plan_layout(df, "v")
        assert layout.buckets > CUT_POINTS
        got = ordered_counts(df.drop("id"), "v", layout=layout)
        assert [r["upto"] for r in got.orderBy("v").collect()] == list(range(1, 5001))
        sizes = layout.assign(df, "v", "b").groupBy("b").count()
        assert sizes.agg(F.max("count")).first()[0] <= 4
    finally:
        spark.conf.unset("spark.autostat.bucketRows")


def test_attach_parts_served_rows(spark):
    left = spark.range(9000).select(F.when(F.col("id") < 4000, 0).otherwise(F.col("id") % 500 + 1).alias("k"), F.lit("same").alias("v"))
    left = left.withColumn("k", F.when(F.col("k") == 7, None).otherwise(F.col("k")))
    right = left.groupBy("k").agg(F.count("*").alias("n")).where("k is null or k <> 9").withColumn("z", F.coalesce(F.col("k") * 2, F.lit(-1)))
    spark.conf.set("spark.autostat.bucketRows", "40")
    try:
        out = attach(left, right, ["k"], plan_layout(left.withColumn("x", F.lit(1.0)), "x"), "n", ["z"])
        rows = out.groupBy("k", "z").count().collect()
    finally:
        spark.conf.unset("spark.autostat.bucketRows")
    assert sum(r["count"] for r in rows) == 9000 and len(rows) == 501
    assert all(r["z"] == (None if r["k"] == 9 else -1 if r["k"] is None else 2 * r["k"]) for r in rows)


def test_describe_matches_pandas(spark, small_buckets):
    pdf, df = skewed(spark)
    got = describe(df, ["v", "w", "absent"], ["k"]).toPandas()
    for (k, c), row in got.set_index(["k", "column"]).iterrows():
        x = pdf[pdf.k.isna() if k is None or k != k else pdf.k == k][c]
        assert row["count"] == len(x)
        want = [x.mean(), x.median(), x.mode().iloc[0], x.std(), x.var(), x.max() - x.min(), x.min(), x.max()]
        assert np.allclose(list(row[["mean", "median", "mode", "std", "variance", "range", "min", "max"]]), want)


@pytest.mark.parametrize("buckets", ["1000000", "60"])
def test_spearman_matches_pandas(spark, buckets):
    pdf, df = skewed(spark)
    spark.conf.set("spark.autostat.bucketRows", buckets)
    try:
        got = spearman(df, "w", ["v"], ["k"]).toPandas().set_index("k")
    finally:
        spark.conf.unset("spark.autostat.bucketRows")
    for k, row in got.iterrows():
        x = pdf[pdf.k.isna() if k is None or k != k else pdf.k == k]
        assert row.r == pytest.approx(x.v.rank().corr(x.w.rank()), abs=1e-9)


@pytest.mark.parametrize("looked_up", [100_000, 30, 0])
def test_spearman_orders_the_outcome_once(spark, monkeypatch, looked_up):
    """Predictors of few and many values, missing cells of their own, ties: one stored row per outcome value, not per pair."""
    rng = np.random.default_rng(12)
    n = 900
    y = np.where(rng.random(n) < 0.2, 7.0, rng.integers(0, 150, n))
    pdf = pd.DataFrame({
        "k": rng.choice(["a", "b", None], n, p=[0.8, 0.15, 0.05]), "y": y, "few": rng.integers(0, 5, n) + (y > 90),
        "many": np.round(rng.normal(size=n) - y / 60, 2), "same": 1.0, "none": np.nan,
    })
    pdf.loc[rng.random(n) < 0.3, "few"] = np.nan
    pdf.loc[rng.random(n) < 0.2, "many"] = np.nan
    pdf.loc[rng.random(n) < 0.1, "y"] = np.nan
    stored, cut = [], correlate.cut_lineage
    monkeypatch.setattr(correlate, "cut_lineage", lambda df: stored.append(cut(df)) or stored[-1])
    monkeypatch.setattr(correlate, "LOOKUP_VALUES", looked_up, raising=False)
    schema = ", ".join(["k string", *[f"{c} double" for c in pdf.columns[1:]]])
    rows = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), schema)
    spark.conf.set("spark.autostat.bucketRows", "40")
    try:
        xs = ["few", "many", "same", "none"]
        alone = {r.variable: r for r in spearman(rows, "y", xs).collect()}
        keyed = spearman(rows, "y", xs, ["k"]).collect()
    finally:
        spark.conf.unset("spark.autostat.bucketRows")

    def check(row, part):
        both = part[["y", row.variable]].dropna()
        r = both.y.rank().corr(both[row.variable].rank()) if row.variable != "same" else 0.0
        assert row.n == len(both) and row.r == pytest.approx(r, abs=1e-12)

    assert set(alone) == {"few", "many", "same"} and len(keyed) == 9
    for row in alone.values():
        check(row, pdf)
    for row in keyed:
        check(row, pdf[pdf.k.isna() if row.k is None else pdf.k == row.k])
    of_y, of_x = pdf.drop_duplicates(["k", "y"]), pdf.melt(["k"], ["few", "many", "same"]).drop_duplicates()
    assert max(df.count() for df in stored) <= max(len(of_y), len(of_x))


def test_rank_sum_invariants(spark, orders):
    ordered = ordered_counts(orders, "o_totalprice", (), ["o_orderstatus"])
    sums = compare.rank_sums(ordered, "o_orderstatus").toPandas()
    n = sums.n.sum()
    assert sums.rank_sum.sum() == pytest.approx(n * (n + 1) / 2)


def test_segment_equals_filter(spark, orders, small_buckets):
    keyed = normality(orders, "o_totalprice", ["o_orderpriority"]).where("o_orderpriority = '1-URGENT'").first()
    alone = normality(orders.where("o_orderpriority = '1-URGENT'"), "o_totalprice").first()
    assert keyed.statistic == pytest.approx(alone.statistic, abs=1e-12)
    assert keyed.p_value == pytest.approx(alone.p_value, rel=1e-9)


def test_sums_of_squares_add_up(spark, orders):
    s = compare.sums_of_squares(group_moments(orders, "o_totalprice", "o_orderstatus")).first()
    total = orders.agg(F.var_samp("o_totalprice") * (F.count("*") - 1)).first()[0]
    assert s.between + s.within == pytest.approx(total, rel=1e-12)


def test_bucket_plan_reads_the_data_once(spark, orders, small_buckets):
    frame = ordered_counts(orders, "o_totalprice")
    frame.collect()
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan or "Reused" in plan
    assert "CartesianProduct" not in plan
