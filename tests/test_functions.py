"""Distribution tails against published table values."""

import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from autostat.functions import normal, tails
from autostat.functions.columns import direction, strength
from autostat.operators.normality import shapiro_weights
from autostat.operators.timeseries import unit_root_p

# Two-sided 5 % critical values of t, upper 5 % of chi-squared, F and the studentized range.
T_TABLE = {1: 12.706, 2: 4.303, 5: 2.571, 10: 2.228, 30: 2.042, 120: 1.980}
CHI2_TABLE = {1: 3.841, 2: 5.991, 4: 9.488, 10: 18.307}
F_TABLE = {(1, 10): 4.965, (2, 10): 4.103, (6, 17): 2.699, (4, 60): 2.525}
Q_TABLE = {(3, 10): 3.877, (5, 20): 4.232, (4, 60): 3.737, (10, 120): 4.560}


@pytest.mark.parametrize("dof,t", T_TABLE.items())
def test_t(dof, t):
    assert tails.t_two_sided(t, dof)[0] == pytest.approx(0.05, abs=1e-4)


@pytest.mark.parametrize("dof,x", CHI2_TABLE.items())
def test_chi2(dof, x):
    assert tails.chi2_upper(x, dof)[0] == pytest.approx(0.05, abs=1e-4)


@pytest.mark.parametrize("dofs,f", F_TABLE.items())
def test_f(dofs, f):
    assert tails.f_upper(f, *dofs)[0] == pytest.approx(0.05, abs=1e-4)


@pytest.mark.parametrize("shape,q", Q_TABLE.items())
def test_studentized_range(shape, q):
    assert tails.studentized_range_upper(q, *shape) == pytest.approx(0.05, abs=2e-4)


def test_normal_columns(spark):
    zs = [-8.0, -3.1, -1.0, 0.0, 0.3, 1.96, 5.0, 7.5, 30.0]
    df = spark.createDataFrame([(z,) for z in zs], "z double")
    for z, up, two in df.select("z", normal.upper_tail("z"), normal.two_sided("z")).collect():
        assert up == pytest.approx(0.5 * math.erfc(z / math.sqrt(2)), rel=1e-9, abs=1e-15)
        assert two == pytest.approx(math.erfc(abs(z) / math.sqrt(2)), rel=1e-9, abs=1e-15)
    assert np.allclose(normal.upper_tail_array(np.array(zs)), [0.5 * math.erfc(z / math.sqrt(2)) for z in zs], atol=1e-15)


def test_normal_quantile(spark):
    ps = [1e-15, 1e-6, 0.01, 0.3, 0.5, 0.8, 0.999]
    df = spark.createDataFrame([(p,) for p in ps], "p double")
    for p, z in df.select("p", normal.quantile("p")).collect():
        assert z == pytest.approx(statistics.NormalDist().inv_cdf(p), abs=1e-12)


def test_exact_rank_sum_counts_all_orders():
    from itertools import combinations

    n1, n2 = 3, 4
    us = [sum(c) - n1 * (n1 + 1) / 2 for c in combinations(range(1, n1 + n2 + 1), n1)]
    for u in set(us):
        top = max(u, n1 * n2 - u)
        want = min(1.0, 2 * sum(v >= top for v in us) / len(us))
        assert tails.exact_rank_sum_two_sided(u, n1, n2) == pytest.approx(want)


def test_exact_signed_rank_counts_all_signs():
    from itertools import product

    n = 6
    plus = [sum(r for r, s in zip(range(1, n + 1), signs, strict=True) if s) for signs in product((0, 1), repeat=n)]
    for t in range(0, 11):
        want = min(1.0, 2 * sum(p <= t for p in plus) / len(plus))
        assert tails.exact_signed_rank_two_sided(t, n) == pytest.approx(want)


def test_shapiro_weights_are_antisymmetric_unit():
    for n in range(5, 30):
        w = np.array(shapiro_weights(n))
        assert np.allclose(w, -w[::-1])
        assert w @ w == pytest.approx(1.0, abs=1e-6)


def test_unit_root_critical_values():
    # Asymptotic 1, 5 and 10 % points of the constant case.
    for stat, p in ((-3.43, 0.01), (-2.86, 0.05), (-2.57, 0.10)):
        assert unit_root_p(stat) == pytest.approx(p, abs=2e-3)


def test_labels(spark):
    df = spark.createDataFrame([(0.1,), (-0.3,), (0.5,), (-0.7,), (0.9,), (0.0,)], "r double")
    got = df.select(strength(F.col("r")), direction(F.col("r"))).collect()
    assert [g[0] for g in got] == ["very weak", "weak", "moderate", "strong", "very strong", "very weak"]
    assert [g[1] for g in got] == ["positive", "negative", "positive", "negative", "positive", "negative"]
