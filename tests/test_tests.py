"""Hypothesis tests, regressions and routing: direct computations, invariants and guards."""

from itertools import combinations
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from autostat.functions import tails
from autostat.operators import compare, correlate, mediate, regress
from autostat.operators.describe import group_moments
from autostat.operators.gram import correlation_matrix
from autostat.operators.instrument import instrument
from autostat.operators.normality import normality
from autostat.plans.analysis import analyze
from autostat.plans.routing import Comparison, auto_test
from autostat.plans.spec import AnalysisSpec, suggest_goal

RNG = np.random.default_rng(17)


def groups(spark, **samples):
    rows = [(g, i, float(v)) for g, vs in samples.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "g string, i int, y double")


def test_normality_routes_by_size_and_shape(spark):
    small, large = RNG.normal(size=20), RNG.normal(size=400)
    df = groups(spark, small=small, large=large, skewed=RNG.exponential(1, 400) ** 2, tiny=[1, 2, 3])
    got = {r.g: r for r in normality(df, "y", ["g"]).collect()}
    assert set(got) == {"small", "large", "skewed"}
    assert got["small"].test_name == "Shapiro-Wilk" and got["large"].test_name.startswith("Kolmogorov")
    assert got["large"].is_normal and not got["skewed"].is_normal


def test_shapiro_published_example(spark):
    # The example of Shapiro & Wilk (1965), W = 0.79, p below 0.01.
    x = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    row = normality(spark.createDataFrame([(float(v),) for v in x], "y double"), "y").first()
    assert row.statistic == pytest.approx(0.79, abs=5e-3) and row.p_value < 0.01


def test_constant_outcome(spark):
    df = spark.createDataFrame([("a", 1.0)] * 40 + [("b", 1.0)] * 10, "g string, y double")
    got = {r.g: r for r in normality(df, "y", ["g"]).collect()}
    assert not got["a"].is_normal and got["b"].statistic == 1.0


def test_exact_mann_whitney_on_small_groups(spark):
    df = groups(spark, a=[1.1, 2.2, 3.3, 4.4, 9.9], b=[5.5, 6.6, 7.7, 8.8, 10.1, 11.2])
    c = Comparison(df, AnalysisSpec("y", "compare", group="g").validated())
    row = compare.mann_whitney(c.facts, c.facts, "__group").first()
    assert row.method == "exact" and row.statistic == 4.0
    assert row.p_value == pytest.approx(tails.exact_rank_sum_two_sided(4.0, 5, 6))
    assert row.higher_group == "b"


@pytest.mark.parametrize(("n1", "n2"), [(1, 1), (2, 5), (5, 6), (8, 8), (6, 3), (3, 9)])
def test_exact_tail_counts_every_sample(n1, n2):
    us = [sum(c) - n1 * (n1 - 1) // 2 for c in combinations(range(n1 + n2), n1)]
    for u in range(n1 * n2 + 1):
        want = 2 * sum(v >= max(u, n1 * n2 - u) for v in us) / len(us)
        assert tails.exact_rank_sum_two_sided(u, n1, n2) == pytest.approx(min(1.0, want), abs=1e-13)


def test_exact_tail_of_a_long_group_nears_the_normal():
    for n2 in (10**5, 10**9):
        sd = (8 * n2 * (n2 + 9) / 12) ** 0.5
        for z in (0.5, 1.0, 2.0):
            exact = tails.exact_rank_sum_two_sided(float(round(4 * n2 - z * sd)), 8, n2)
            assert exact == pytest.approx(2 * (1 - NormalDist().cdf(z)), abs=0.01)


def test_groups_without_variance(spark):
    def rows(test, **samples):
        return test(group_moments(groups(spark, **samples), "y", "g"), "g").collect()

    apart, same = {"a": [0.1] * 5, "b": [0.2] * 7}, {"a": [0.1] * 5, "b": [0.1] * 7, "c": [0.1] * 6}
    t = rows(compare.welch_t, **apart)[0]
    assert t.statistic == float("-inf") and t.p_value == 0 and t.is_significant and t.decision == "H1 accepted"
    t = rows(compare.welch_t, a=same["a"], b=same["b"])[0]
    assert t.p_value is None and not t.is_significant and t.decision == "H0 retained"
    f = rows(compare.anova, **apart, c=[0.3] * 5)[0]
    assert f.statistic == float("inf") and f.p_value == 0 and f.effect_size == 1 and f.is_significant
    f = rows(compare.anova, **same)[0]
    assert f.p_value is None and f.effect_size == 0 and f.decision == "H0 retained"
    assert [r.is_significant for r in rows(compare.tukey_hsd, **apart, c=[0.3] * 5)] == [True] * 3
    assert [r.is_significant for r in rows(compare.tukey_hsd, **same)] == [False] * 3


def test_u_statistics_add_up(spark):
    a, b = RNG.normal(size=60).round(1), RNG.normal(0.4, 1, size=45).round(1)
    u = compare.pairwise_mann_whitney(groups(spark, a=a, b=b), "y", "g").first().statistic
    v = compare.pairwise_mann_whitney(groups(spark, b=a, a=b), "y", "g").first().statistic
    assert u + v == pytest.approx(60 * 45)
    assert u == pytest.approx(sum((x > b).sum() + 0.5 * (x == b).sum() for x in a))


def test_paired_needs_both_measurements(spark):
    rows = [(i, g, float(i + (3 if g == "post" else 0) + (i % 3))) for i in range(30) for g in ("pre", "post")]
    df = spark.createDataFrame([*rows, (99, "pre", 5.0)], "who int, g string, y double")
    pairs = compare.pair_rows(df, "y", "g", "who")
    assert pairs.count() == 30
    row = compare.signed_rank(pairs).first()
    assert row.method == "normal approximation" and row.higher_group == "post"  # ties: no exact table
    few = compare.pair_rows(df.where("who < 12").withColumn("y", F.col("y") + F.when(F.col("g") == "pre", F.col("who") * 0.1).otherwise(0)), "y", "g", "who")
    assert compare.signed_rank(few).first().method == "exact"
    assert compare.paired_t(pairs).first().is_significant


def test_tukey_flags_the_shifted_group(spark):
    df = groups(spark, a=RNG.normal(0, 1, 50), b=RNG.normal(0, 1, 60), c=RNG.normal(2, 1, 40))
    rows = {(r.group1, r.group2): r for r in compare.tukey_hsd(group_moments(df, "y", "g"), "g").collect()}
    assert rows[("a", "c")].is_significant and rows[("b", "c")].is_significant
    assert rows[("a", "c")].mean_diff < 0 and 0 <= rows[("a", "b")].p_corrected <= 1


def test_post_hoc_follows_the_significant_test(spark, small_buckets):
    skew = RNG.exponential(1, 60) ** 2
    df = groups(spark, a=skew, b=skew * 1.01 + 0.001, c=skew + 6)
    spec = AnalysisSpec("y", "compare", group="g")
    c = Comparison(df, spec.validated())
    assert c.result.first().test == "Kruskal-Wallis Test"
    hoc = {(r.group1, r.group2): r for r in c.post_hoc().collect()}
    assert hoc[("a", "c")].is_significant and not hoc[("a", "b")].is_significant
    keyed = df.withColumn("k", F.lit("one"))
    c2 = Comparison(keyed, AnalysisSpec("y", "compare", group="g", keys=("k",)).validated())
    hoc2 = {(r.group1, r.group2): r for r in c2.post_hoc().collect()}
    assert {k: v.p_corrected for k, v in hoc.items()} == pytest.approx({k: v.p_corrected for k, v in hoc2.items()})


def test_correlation_takes_the_route_of_each_segment(spark):
    """A normal and a skewed segment side by side give what each gives alone."""
    values = {"n": RNG.normal(0, 1, 60), "s": RNG.exponential(1, 60) ** 2}
    rows = [(k, float(v), float(v * v + i)) for k, vs in values.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "k string, y double, x double")
    got = {r.k: r for r in auto_test(df, AnalysisSpec("y", "correlate", xs=("x",), keys=("k",))).collect()}
    assert set(got) == {"n", "s"} and not got["s"].is_parametric
    for k, r in got.items():
        method = correlate.pearson if r.is_parametric else correlate.spearman
        assert r.statistic == pytest.approx(method(df.where(F.col("k") == k), "y", ["x"]).first().r)


def test_leaf_choice(spark):
    n = 80
    base = RNG.normal(size=n)
    normal2 = groups(spark, a=base, b=RNG.normal(0.1, 1, n))
    normal3 = groups(spark, a=base, b=RNG.normal(0, 1, n), c=RNG.normal(0, 1, n))
    skew = RNG.exponential(1, n) ** 3
    cases = [
        (normal2, {}, "Independent Samples T-Test"), (normal3, {}, "One-Way ANOVA"),
        (groups(spark, a=skew, b=skew * 2), {}, "Mann-Whitney U Test"),
        (groups(spark, a=skew, b=skew * 2, c=skew), {}, "Kruskal-Wallis Test"),
        (normal2, {"paired": True, "pair_key": "i"}, "Paired Samples T-Test"),
        (groups(spark, a=skew, b=skew * 2), {"paired": True, "pair_key": "i"}, "Wilcoxon Signed-Rank Test"),
    ]
    for df, more, want in cases:
        assert auto_test(df, AnalysisSpec("y", "compare", group="g", **more)).first().test == want


def test_guards(spark):
    with pytest.raises(ValueError, match="fewer than 2"):
        auto_test(groups(spark, a=range(9)), AnalysisSpec("y", "compare", group="g"))
    with pytest.raises(ValueError, match="below 5 rows: b"):
        auto_test(groups(spark, a=range(9), b=[1, 2]), AnalysisSpec("y", "compare", group="g"))
    for bad in ({"goal": "compare"}, {"goal": "influence"}, {"goal": "mediate", "xs": ("x",)}, {"goal": "nonsense"}, {"goal": "compare", "group": "g", "paired": True}):
        with pytest.raises(ValueError):
            AnalysisSpec("y", **bad).validated()


def test_goal_names_and_hint(spark, lineitem):
    assert AnalysisSpec("y", "komparasi", group="g").validated().goal == "compare"
    assert AnalysisSpec("y", "Asosiatif", xs=("x",)).validated().goal == "influence"
    assert suggest_goal(lineitem, "l_tax", ["l_returnflag"]) == "compare"
    assert suggest_goal(lineitem, "l_tax", ["l_quantity"]) == "correlate"


def regression_frame(n=300):
    x1, x2 = RNG.normal(size=n), RNG.normal(size=n)
    return pd.DataFrame({"x1": x1, "x2": x2, "x3": x1 + 0.01 * RNG.normal(size=n), "y": 3 + 2 * x1 - x2 + RNG.normal(size=n)})


def test_regression_matches_least_squares(spark):
    pdf = regression_frame()
    got = regress.regression(spark.createDataFrame(pdf), "y", ["x1", "x2"]).orderBy("position").collect()
    design = np.column_stack([np.ones(len(pdf)), pdf.x1, pdf.x2])
    beta, *_ = np.linalg.lstsq(design, pdf.y, rcond=None)
    res = pdf.y - design @ beta
    error = float(res @ res) / (len(pdf) - 3)
    se = np.sqrt(error * np.diag(np.linalg.inv(design.T @ design)))
    assert np.allclose([r.coefficient for r in got], beta) and np.allclose([r.std_err for r in got], se)
    assert got[0].r_squared == pytest.approx(1 - float(res @ res) / ((pdf.y - pdf.y.mean()) ** 2).sum())


def test_dependent_predictors_take_the_smallest_solution(spark):
    pdf = regression_frame().assign(twice=lambda d: d.x2 * 2 + 1, k="a")
    rows = pd.concat([pdf, pdf.assign(k="b", twice=lambda d: d.x1**2)])
    got = regress.regression(spark.createDataFrame(rows), "y", ["x1", "x2", "twice"], ["k"], vif_limit=None).orderBy("k", "position").collect()
    design = np.column_stack([np.ones(len(pdf)), pdf.x1, pdf.x2, pdf.twice])
    inverse = np.linalg.pinv(design, rcond=1e-10)
    beta = inverse @ pdf.y.to_numpy()
    res = pdf.y - design @ beta
    se = np.sqrt(float(res @ res) / (len(pdf) - 3) * np.diag(inverse @ inverse.T))
    assert np.allclose([r.coefficient for r in got[:4]], beta) and np.allclose([r.std_err for r in got[:4]], se)
    assert [r.n_predictors for r in got] == [2] * 4 + [3] * 4


def test_collinear_predictor_is_dropped(spark):
    pdf = regression_frame().assign(flat=1.0, twice=lambda d: d.x2 * 2)
    df = spark.createDataFrame(pdf)
    log = regress.vif_log(df, "y", ["x1", "x2", "x3", "flat", "twice"]).collect()
    gone = [r.variable for r in log if r.eliminated]
    assert gone[0] == "flat" and {"x2", "twice"} & set(gone) and {"x1", "x3"} & set(gone) and len(gone) == 3
    assert all(r.vif >= 1 for r in log if r.variable != "flat")
    assert [r.vif for r in log if r.variable == "twice"][0] == 999.0
    fit = regress.fit_summary(regress.regression(df, "y", ["x1", "x2", "x3", "flat", "twice"])).first()
    assert fit.n_predictors == 2


def test_simple_regression_invariants(spark):
    df = spark.createDataFrame(regression_frame())
    rows = regress.regression(df, "y", ["x1"]).orderBy("position").collect()
    r = correlate.pearson(df, "y", ["x1"]).first()
    assert rows[1].f_statistic == pytest.approx(rows[1].t ** 2)
    assert rows[1].r_squared == pytest.approx(r.r**2) and rows[1].p_value == pytest.approx(r.p_value, abs=1e-12)
    assert rows[0].model == "Simple Linear Regression"


def test_mediation_adds_up(spark):
    df = spark.createDataFrame(regression_frame())
    m = mediate.mediation(df, "y", "x1", "x2").first()
    assert m.c == pytest.approx(m.c_prime + m.a * m.b)
    two = {r.term: r for r in regress.regression(df, "y", ["x1", "x2"], vif_limit=None).collect()}
    assert m.b == pytest.approx(two["x2"].coefficient) and m.se_b == pytest.approx(two["x2"].std_err)
    assert m.c_prime == pytest.approx(two["x1"].coefficient) and m.se_c_prime == pytest.approx(two["x1"].std_err)
    assert m.p_b == pytest.approx(two["x2"].p_value, abs=1e-12)


def test_degenerate_correlation(spark):
    df = spark.createDataFrame([(1.0, float(i), float(-i)) for i in range(8)], "flat double, y double, minus double")
    got = {r.variable: r for r in correlate.pearson(df, "y", ["flat", "minus", "absent"]).collect()}
    assert got["flat"].r == 0.0 and got["flat"].p_value == 1.0 and not got["flat"].is_significant
    assert got["minus"].r == pytest.approx(-1.0) and got["minus"].p_value < 1e-10 and "absent" not in got
    assert {r.variable: r.r for r in correlate.spearman(df, "y", ["flat", "minus"]).collect()} == pytest.approx({"flat": 0.0, "minus": -1.0})
    assert correlation_matrix(df, ["y", "minus"]).where("row <> col").first().r == pytest.approx(-1.0)


def test_instrument_of_equal_items(spark):
    base = RNG.normal(size=50)
    df = spark.createDataFrame(pd.DataFrame({f"i{j}": base + 0.1 * RNG.normal(size=50) for j in range(3)}))
    rows = instrument(df, ["i0", "i1", "i2"]).collect()
    assert all(r.is_valid and r.is_reliable for r in rows) and rows[0].cronbach_alpha > 0.95
    with pytest.raises(ValueError):
        instrument(df, ["i0"])


def test_odd_column_names(spark):
    df = groups(spark, a=RNG.normal(size=30), b=RNG.normal(1, 1, 30)).select(
        F.col("y").alias("total"), F.col("g").alias("label"), (F.col("i") % 2).alias("k")
    )
    spec = AnalysisSpec("total", "compare", group="label", keys=("k",))
    assert auto_test(df, spec).count() == 2
    assert Comparison(df, spec.validated()).summary.columns == ["k", "label", "n", "mean", "median"]
    assert normality(df, "total", ["k"]).count() == 2


def test_analyze_every_goal(spark, lineitem, events):
    li = lineitem.select("l_quantity", "l_extendedprice", "l_discount", "l_returnflag")
    out = analyze(li, AnalysisSpec("l_extendedprice", "compare", group="l_returnflag"))
    assert {"cleaning_log", "describe", "normality", "test_result", "group_summary", "post_hoc", "box_stats"} <= set(out)
    out = analyze(li, AnalysisSpec("l_extendedprice", "pengaruh", xs=("l_quantity", "l_discount"), source="questionnaire"))
    assert out["instrument"].count() == 2 and out["coefficients"].count() == 3 and out["test_result"].count() == 1
    out = analyze(li, AnalysisSpec("l_extendedprice", "correlate", xs=("l_quantity", "l_discount")))
    assert out["correlation"].count() == 2 and out["correlation_matrix"].count() == 9
    out = analyze(li, AnalysisSpec("l_extendedprice", "mediate", xs=("l_quantity",), mediator="l_discount"))
    assert out["paths"].count() == 5
    day = events.groupBy(F.to_date("ts").alias("day")).agg(F.sum("value").alias("y"))
    out = analyze(day, AnalysisSpec("y", "influence", xs=("day",)))
    assert out["forecast"].count() == 5 and out["model"].first().model == "ARIMA"
