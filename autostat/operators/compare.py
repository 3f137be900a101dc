"""Comparison tests between the groups of one column, for one table or many segments.

Group 1 and 2 are the group labels in ascending order. t and F tests need one
aggregation; rank tests need the ordered counts and one aggregation more.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from autostat.functions import normal
from autostat.functions.columns import by_segment, decision, join_on, numeric_frame, own_keys, ratio
from autostat.functions.tails import chi2_p, f_p, rank_sum_exact_p, signed_rank_exact_p, studentized_range_p, t_p
from autostat.operators.describe import group_moments
from autostat.operators.order import midrank, ordered_counts, plan_layout, quantile_at
from autostat.operators.pairs import group_pairs, pair_counts

SMALLEST_GROUP = 5
# Where the exact distributions replace the normal approximation.
EXACT_SMALLER_GROUP, EXACT_PAIRS = 8, 50
SMALLEST_P = 1e-15


def _two(name: str, label: str) -> list[Column]:
    return [F.min_by(name, label).alias(f"{name}1"), F.max_by(name, label).alias(f"{name}2")]


def group_guard(summary: DataFrame, group: str, keys: Sequence[str] = ()) -> DataFrame:
    """Groups per segment and why it cannot be tested: fewer than 2 groups, or a group below 5 rows."""
    smallest = F.min(F.struct("n", group))
    return summary.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_groups"), smallest.alias("s")).select(
        *keys, "n_groups", F.col("s.n").alias("smallest_n"),
        F.when(F.col("n_groups") < 2, "fewer than 2 groups")
        .when(F.col("s.n") < SMALLEST_GROUP, F.concat(F.lit("group below 5 rows: "), F.col(f"s.{group}").cast("string")))
        .otherwise("ok").alias("status"),
    )


def pooled_effect(n1: Column, n2: Column, m1: Column, m2: Column, v1: Column, v2: Column) -> Column:
    """Cohen's d of two independent groups, 0 when undefined."""
    pooled = F.sqrt(ratio((n1 - 1) * v1 + (n2 - 1) * v2, n1 + n2 - 2))
    return F.coalesce(ratio(m1 - m2, pooled), F.lit(0.0))


def with_rank_effect(df: DataFrame, n: Column) -> DataFrame:
    """Add `effect_size` r = |z| / sqrt(n), z being the normal quantile of p_value / 2."""
    p = F.col("p_value")
    half = F.when(p == 0, SMALLEST_P / 2).when(p < 1, p / 2).otherwise(0.5)
    r = F.abs(normal.quantile("__half")) / F.sqrt(n.cast("double"))
    return df.withColumn("__half", half).withColumn("effect_size", r)


def _finish(df: DataFrame, keys: Sequence[str], test: str, parametric: bool, effect: str, alpha: float) -> DataFrame:
    # No p-value (nothing differs and nothing varies): not significant.
    significant = F.coalesce(F.col("p_value") < alpha, F.lit(False))
    return df.select(
        *keys, F.lit(test).alias("test"), F.lit(parametric).alias("is_parametric"),
        F.col("statistic").cast("double").alias("statistic"),
        F.col("df1").cast("double").alias("df1"), F.col("df2").cast("double").alias("df2"),
        "p_value", significant.alias("is_significant"),
        F.lit(effect).alias("effect_name"), F.col("effect_size").cast("double").alias("effect_size"),
        F.col("higher_group").cast("string").alias("higher_group"), F.col("method").alias("method"),
        decision(significant).alias("decision"),
    )


def _same_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A second input of a `by_segment` operator, with its keys under the same internal names."""
    return own_keys(df, [k.removeprefix("__seg_") for k in keys if k not in df.columns])[0]


def _higher(a: str, b: str) -> Column:
    return F.when(F.col(a) > F.col(b), F.col("label1")).otherwise(F.col("label2"))


# Where an effect counts as small, medium and large (Cohen 1988), by the name results give it.
EFFECT_SIZES = {
    "Cohen's d": (0.2, 0.5, 0.8), "r (Z/sqrt(N))": (0.1, 0.3, 0.5), "Eta-squared": (0.01, 0.06, 0.14),
    "Omega-squared": (0.01, 0.06, 0.14), "Epsilon-squared": (0.01, 0.06, 0.14),
}


def with_effect_label(results: DataFrame) -> DataFrame:
    """Add `effect_label` (negligible, small, medium, large) to test results; NULL for effects without such limits."""
    label = F.lit(None).cast("string")
    for name, (small, medium, large) in EFFECT_SIZES.items():
        size = F.round(F.abs("effect_size"), 12)
        of_name = F.when(size >= large, "large").when(size >= medium, "medium").when(size >= small, "small").otherwise("negligible")
        label = F.when((F.col("effect_name") == name) & F.col("effect_size").isNotNull(), of_name).otherwise(label)
    return results.withColumn("effect_label", label)


def against_spread(size: Column, spread: Column) -> Column:
    """size / spread; infinite when something differs and nothing varies, NULL when neither does."""
    return F.when((spread == 0) & (size != 0), F.signum(size) * float("inf")).otherwise(ratio(size, spread))


@by_segment
def welch_t(summary: DataFrame, group: str, keys: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """Unequal-variance t-test of two independent groups, from `group_moments`.

    Two constant groups have one degree of freedom and an infinite statistic (none when they are equal).
    """
    two = summary.withColumn("label", F.col(group)).groupBy(*keys).agg(
        *_two("label", group), *_two("n", group), *_two("mean", group), *_two("variance", group),
        F.count(F.lit(1)).alias("k"),
    ).where("k = 2")
    e1, e2 = F.col("variance1") / F.col("n1"), F.col("variance2") / F.col("n2")
    dof = ratio((e1 + e2) * (e1 + e2), e1 * e1 / F.greatest(F.col("n1") - 1, F.lit(1)) + e2 * e2 / F.greatest(F.col("n2") - 1, F.lit(1)))
    out = two.select(
        "*", against_spread(F.col("mean1") - F.col("mean2"), F.sqrt(e1 + e2)).alias("statistic"),
        F.coalesce(dof, F.lit(1.0)).alias("df1"),
        F.lit(None).cast("double").alias("df2"), _higher("mean1", "mean2").alias("higher_group"),
        F.lit("t distribution").alias("method"),
        pooled_effect(*[F.col(c) for c in ("n1", "n2", "mean1", "mean2", "variance1", "variance2")]).alias("effect_size"),
    ).withColumn("p_value", t_p("statistic", "df1"))
    return _finish(out, keys, "Independent Samples T-Test", True, "Cohen's d", alpha)


def pair_rows(df: DataFrame, y: str, group: str, pair_key: str, keys: Sequence[str] = ()) -> DataFrame:
    """One row per subject measured in both groups (y1, y2 by ascending label). One shuffle, no self-join."""
    at = [*keys, pair_key]
    rows = numeric_frame(df, [y], [*at, group]).where(F.col(y).isNotNull() & F.col(group).isNotNull())
    both = rows.groupBy(*at).agg(
        F.count(F.lit(1)).alias("k"), F.min(group).alias("label1"), F.max(group).alias("label2"),
        F.min_by(y, group).alias("y1"), F.max_by(y, group).alias("y2"),
    )
    complete = (F.col("k") == 2) & (F.col("label1") < F.col("label2"))
    return both.where(complete).select(*at, "label1", "label2", "y1", "y2", (F.col("y1") - F.col("y2")).alias("diff"))


@by_segment
def paired_t(pairs: DataFrame, keys: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    agg = pairs.groupBy(*keys).agg(
        F.count("diff").alias("n"), F.avg("diff").alias("m"), F.coalesce(F.stddev_samp("diff"), F.lit(0.0)).alias("s"),
        F.avg("y1").alias("mean1"), F.avg("y2").alias("mean2"), F.min("label1").alias("label1"), F.max("label2").alias("label2"),
    ).where("n >= 2")
    out = agg.select(
        "*",
        against_spread(F.col("m") * F.sqrt(F.col("n").cast("double")), F.col("s")).alias("statistic"),
        (F.col("n") - 1).alias("df1"), F.lit(None).cast("double").alias("df2"),
        F.coalesce(ratio(F.col("m"), F.col("s")), F.lit(0.0)).alias("effect_size"),
        _higher("mean1", "mean2").alias("higher_group"), F.lit("t distribution").alias("method"),
    ).withColumn("p_value", t_p("statistic", F.col("df1").cast("double")))
    return _finish(out, keys, "Paired Samples T-Test", True, "Cohen's d", alpha)


@by_segment
def signed_rank(pairs: DataFrame, keys: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """Wilcoxon signed-rank test; zero differences are dropped before ranking."""
    sized = pairs.withColumn("__size", F.abs("diff")).withColumn("__up", F.col("diff") > 0)
    ordered = ordered_counts(sized.where(F.col("__size") > 0), "__size", keys, ["__up"])
    ranks = ordered.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(F.col("__up"), F.col("cnt") * midrank())), F.lit(0.0)).alias("plus"),
        F.sum(F.col("cnt") * (F.col("tied").cast("double") * F.col("tied") - 1)).alias("ties"),
        F.max("total").alias("n"),
    )
    middle = pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("pairs"), F.min("label1").alias("label1"), F.max("label2").alias("label2")
    )
    long = pairs.unpivot([*keys], ["y1", "y2"], "side", "value")
    medians = ordered_counts(long, "value", [*keys, "side"]).groupBy(*keys, "side").agg(quantile_at("value", 0.5).alias("m"))
    medians = medians.groupBy(*keys).agg(F.min_by("m", "side").alias("median1"), F.max_by("m", "side").alias("median2"))
    n = F.col("n").cast("double")
    total = n * (n + 1) / 2
    least = F.least(F.col("plus"), total - F.col("plus"))
    spread = n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48
    exact = (F.col("n") <= EXACT_PAIRS) & (F.col("ties") == 0) & (F.col("n") == F.col("pairs"))
    joined = join_on(join_on(ranks, middle, keys), medians, keys)
    p = F.when(exact, signed_rank_exact_p(F.when(exact, F.col("statistic")), F.when(exact, F.col("n")))).otherwise(
        normal.two_sided("z")
    )
    out = joined.withColumn("statistic", least).withColumn("z", ratio(F.col("statistic") - total / 2, F.sqrt(spread)))
    out = with_rank_effect(out.withColumn("p_value", p), F.col("pairs") * 2)
    out = out.select(
        "*", F.lit(None).alias("df1"), F.lit(None).alias("df2"),
        _higher("median1", "median2").alias("higher_group"),
        F.when(exact, "exact").otherwise("normal approximation").alias("method"),
    )
    return _finish(out, keys, "Wilcoxon Signed-Rank Test", False, "r (Z/sqrt(N))", alpha)


def rank_sums(ordered: DataFrame, group: str, keys: Sequence[str] = ()) -> DataFrame:
    """n, rank sum and tie term per segment and group."""
    return ordered.groupBy(*keys, group).agg(
        F.sum("cnt").alias("n"), F.sum(F.col("cnt") * midrank()).alias("rank_sum"),
        F.sum(F.col("cnt") * (F.col("tied").cast("double") * F.col("tied") - 1)).alias("ties"),
    )


def _with_u(df: DataFrame) -> DataFrame:
    """Add U of group 1 (`statistic`), `z`, two-sided `p_value` and `method` from n1, n2, r1 (rank sum of group 1), ties."""
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n, u = n1 + n2, F.col("statistic")
    sd = F.sqrt(n1 * n2 / 12 * ((n + 1) - ratio(F.col("ties"), n * (n - 1))))
    df = df.withColumn("statistic", F.col("r1") - n1 * (n1 + 1) / 2)
    df = df.withColumn("z", ratio(F.greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5, sd))
    exact = (F.least(n1, n2) <= EXACT_SMALLER_GROUP) & (F.col("ties") == 0)
    table = rank_sum_exact_p(F.when(exact, u), F.when(exact, F.col("n1")), F.when(exact, F.col("n2")))
    return df.withColumns(
        {
            "p_value": F.when(exact, table).otherwise(F.least(normal.upper_tail("z") * 2, F.lit(1.0))),
            "method": F.when(exact, "exact").otherwise("normal approximation"),
        }
    )


@by_segment
def mann_whitney(sums: DataFrame, medians: DataFrame, group: str, keys: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """Two-sided test of two independent groups from `rank_sums`; `medians` names the higher group."""
    two = sums.withColumn("label", F.col(group)).groupBy(*keys).agg(
        *_two("label", group), *_two("n", group), F.min_by("rank_sum", group).alias("r1"),
        F.sum("ties").alias("ties"), F.count(F.lit(1)).alias("k"),
    ).where("k = 2")
    middle = _same_keys(medians, keys).groupBy(*keys).agg(*_two("median", group))
    out = with_rank_effect(_with_u(join_on(two, middle, keys)), F.col("n1") + F.col("n2"))
    out = out.select(
        "*", F.lit(None).alias("df1"), F.lit(None).alias("df2"),
        _higher("median1", "median2").alias("higher_group"),
    )
    return _finish(out, keys, "Mann-Whitney U Test", False, "r (Z/sqrt(N))", alpha)


def sums_of_squares(summary: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Between and within sums of squares from group moments: no second scan of the data."""
    n, whole = F.col("n"), Window.partitionBy(*keys)
    grand = F.sum(n * F.col("mean")).over(whole) / F.sum(n).over(whole)
    off = F.col("mean") - F.col("__grand")
    return summary.withColumn("__grand", grand).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("k"), F.sum(n).alias("total"), F.max("__grand").alias("grand"),
        F.sum((n - 1) * F.col("variance")).alias("within"),
        # Equal means differ from their rounded grand mean in the last digit.
        F.when(F.min("mean") == F.max("mean"), 0.0).otherwise(F.sum(n * off * off)).alias("between"),
    )


@by_segment
def anova(
    summary: DataFrame, group: str, keys: Sequence[str] = (), alpha: float = 0.05, effect: str = "Eta-squared"
) -> DataFrame:
    """One-way ANOVA with eta-squared, or with omega-squared, which allows for chance (and is 0 where chance explains more)."""
    if effect not in ("Eta-squared", "Omega-squared"):
        raise ValueError(f"unknown effect '{effect}'; use Eta-squared or Omega-squared")
    squares = sums_of_squares(summary, keys)
    top = summary.groupBy(*keys).agg(F.max_by(F.col(group), F.col("mean")).alias("higher_group"))
    df1, df2 = F.col("k") - 1, F.col("total") - F.col("k")
    everything, error = F.col("between") + F.col("within"), ratio(F.col("within"), df2)
    size = ratio(F.col("between"), everything)
    if effect == "Omega-squared":
        size = F.greatest(ratio(F.col("between") - df1 * error, everything + error), F.lit(0.0))
    out = join_on(squares.where("k >= 2"), top, keys).select(
        "*", df1.cast("double").alias("df1"), df2.cast("double").alias("df2"),
        against_spread(ratio(F.col("between"), df1), ratio(F.col("within"), df2)).alias("statistic"),
        F.coalesce(size, F.lit(0.0)).alias("effect_size"),
        F.lit("F distribution").alias("method"),
    ).withColumn("p_value", f_p("statistic", "df1", "df2"))
    return _finish(out, keys, "One-Way ANOVA", True, effect, alpha)


@by_segment
def kruskal(sums: DataFrame, medians: DataFrame, group: str, keys: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """Tie-corrected Kruskal-Wallis H with epsilon-squared."""
    agg = sums.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("k"), F.sum("n").cast("double").alias("total"), F.sum("ties").alias("ties"),
        F.sum(F.col("rank_sum") * F.col("rank_sum") / F.col("n")).alias("q"),
    ).where("k >= 2")
    top = _same_keys(medians, keys).groupBy(*keys).agg(F.max_by(F.col(group), F.col("median")).alias("higher_group"))
    n = F.col("total")
    h = ratio(ratio(F.lit(12.0), n * (n + 1)) * F.col("q") - 3 * (n + 1), 1 - ratio(F.col("ties"), n * n * n - n))
    out = join_on(agg, top, keys).withColumn("statistic", h).withColumn("df1", (F.col("k") - 1).cast("double"))
    out = out.select(
        "*", F.lit(None).alias("df2"), chi2_p("statistic", "df1").alias("p_value"),
        F.coalesce(ratio(F.col("statistic") * (n + 1), n * n - 1), F.lit(0.0)).alias("effect_size"),
        F.lit("chi-squared distribution").alias("method"),
    )
    return _finish(out, keys, "Kruskal-Wallis Test", False, "Epsilon-squared", alpha)


@by_segment
def tukey_hsd(summary: DataFrame, group: str, keys: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """Tukey-Kramer comparison of all group pairs from group moments; mean_diff is group 1 minus group 2."""
    squares = sums_of_squares(summary, keys)
    pairs = join_on(group_pairs(summary, group, ["n", "mean"], keys), squares, keys)
    error = ratio(F.col("within"), F.col("total") - F.col("k"))
    q = against_spread(
        F.abs(F.col("mean1") - F.col("mean2")), F.sqrt(error / 2 * (F.lit(1.0) / F.col("n1") + F.lit(1.0) / F.col("n2")))
    )
    scored = pairs.withColumn("q", q).withColumn(
        "p_corrected", studentized_range_p("q", "k", (F.col("total") - F.col("k")).cast("double"))
    )
    return scored.select(
        *keys, F.col("group1").cast("string").alias("group1"), F.col("group2").cast("string").alias("group2"),
        (F.col("mean1") - F.col("mean2")).alias("mean_diff"), F.col("q").alias("statistic"), "p_corrected",
        F.coalesce(F.col("p_corrected") < alpha, F.lit(False)).alias("is_significant"),
    )


@by_segment
def pairwise_mann_whitney(
    df: DataFrame, y: str, group: str, keys: Sequence[str] = (), alpha: float = 0.05, summary: DataFrame | None = None
) -> DataFrame:
    """Mann-Whitney of every group pair with Bonferroni correction, all pairs from one ordering of the values.

    Equal values collapse first; the collapsed rows are walked once, whatever the number of groups (see `pairs`).
    """
    at = [*keys, group]
    rows = numeric_frame(df, [y], at).where(F.col(y).isNotNull() & F.col(group).isNotNull())
    summary = group_moments(df, y, group, keys) if summary is None else _same_keys(summary, keys)
    collapsed = rows.groupBy(*at, y).agg(F.count(F.lit(1)).alias("cnt"))
    counts = pair_counts(collapsed, y, group, keys, plan_layout(rows, y))
    cubes = F.sum(F.col("cnt") * (F.col("cnt").cast("double") * F.col("cnt") - 1)).alias("cubes")
    own = collapsed.groupBy(*at).agg(cubes)
    pairs = group_pairs(join_on(summary, own, at), group, ["n", "mean", "cubes"], keys)
    found = join_on(pairs, counts, [*keys, "group1", "group2"], "left")
    n1 = F.col("n1").cast("double")
    found = found.withColumns({
        "r1": F.coalesce("u", F.lit(0.0)) + n1 * (n1 + 1) / 2,
        "ties": F.col("cubes1") + F.col("cubes2") + 3 * F.coalesce("cross", F.lit(0.0)),
    })
    m = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("m"))
    scored = _with_u(join_on(found, m, keys))
    corrected = F.least(F.col("p_value") * F.col("m"), F.lit(1.0))
    return scored.select(
        *keys, F.col("group1").cast("string").alias("group1"), F.col("group2").cast("string").alias("group2"),
        (F.col("mean1") - F.col("mean2")).alias("mean_diff"), "statistic", "z", corrected.alias("p_corrected"),
        (corrected < alpha).alias("is_significant"),
    )
