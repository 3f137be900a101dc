"""Choose and run the test: normality of the outcome gates parametric and rank tests, per segment."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from autostat.functions.columns import decision, join_on, number, own_keys, restore_keys
from autostat.operators import compare as cmp
from autostat.operators.correlate import both_methods, correlation_summary, pearson, spearman
from autostat.operators.describe import group_moments
from autostat.operators.mediate import mediation
from autostat.operators.normality import normality, normality_of
from autostat.operators.order import Layout, attach, ordered_counts, plan_layout, quantile_at
from autostat.operators.regress import fit_summary, regression
from autostat.plans.spec import AnalysisSpec
from autostat.sources.checkpoints import cut_lineage

TEST_COLUMNS = [
    "test", "is_parametric", "statistic", "df1", "df2", "p_value", "is_significant", "effect_name", "effect_size",
    "higher_group", "method", "decision",
]



NORMALITY_COLUMNS = ["column", "test_name", "n", "statistic", "p_value", "is_normal"]


class Comparison:
    """One comparison: the data are ordered and aggregated once into `facts`, every table is read off it."""

    def __init__(self, df: DataFrame, spec: AnalysisSpec, at_most: int | None = None):
        self.at_most = at_most
        # Working names, so that the table's own column names cannot meet ours.
        self.label, self.group_name = spec.y, spec.group
        df, self.names = own_keys(df, spec.keys)
        self.keys = [self.names.get(k, k) for k in spec.keys]
        extra = {"__pair": F.col(spec.pair_key)} if spec.paired else {}
        frame = df.withColumns({"__y": number(df, spec.y), "__group": F.col(spec.group), **extra})
        frame = frame.select(*self.keys, "__group", "__y", *extra)
        self.rows = frame.where(F.col("__y").isNotNull() & F.col("__group").isNotNull())
        self.spec = replace(spec, y="__y", group="__group", pair_key="__pair" if spec.paired else None, keys=tuple(self.keys))

    @cached_property
    def layout(self) -> Layout:
        return plan_layout(self.rows, self.spec.y, self.at_most)

    @cached_property
    def facts(self) -> DataFrame:
        """(keys, group): n, mean, variance, median, rank_sum, ties, and the segment's normality (`seg_*`).

        One job. The ordered values of a segment serve both its ranks and its normality test.
        """
        spec, keys, y, group = self.spec, self.keys, self.spec.y, self.spec.group
        at = [*keys, group]
        layout = self.layout
        ordered = ordered_counts(self.rows, y, keys, [group], layout)
        by_group = group_moments(self.rows, y, group, keys)
        # The segment's moments follow from its groups' moments: no scan of their own.
        n, spread = F.col("total"), F.col("within") + F.col("between")
        stats = cmp.sums_of_squares(by_group, keys).select(
            *keys, n.alias("__n"), F.col("grand").alias("__m"), spread.alias("__ss"),
            F.sqrt(F.try_divide(spread, n - 1)).alias("__s"),
        )
        normal = normality_of(ordered, stats, layout, y, keys, spec.small_n, spec.normality_alpha).select(*keys, *[F.col(c).alias(f"seg_{c}") for c in NORMALITY_COLUMNS])
        ranks = cmp.rank_sums(ordered, group, keys).drop("n")
        middle = ordered_counts(self.rows, y, at, (), layout).groupBy(*at).agg(quantile_at(y, 0.5).alias("median"))
        facts = join_on(join_on(by_group, ranks, at), middle, at)
        return cut_lineage(join_on(facts, normal, keys, "left"))

    @property
    def summary(self) -> DataFrame:
        out = self.facts.select(*self.keys, "__group", "n", "mean", "median")
        return restore_keys(out, {**self.names, self.group_name: "__group"})

    def normality(self) -> DataFrame:
        columns = [F.lit(self.label).alias("column"), *[F.col(f"seg_{c}").alias(c) for c in NORMALITY_COLUMNS[1:]]]
        out = self.facts.where(F.col("seg_n").isNotNull()).select(*self.keys, *columns).distinct()
        return restore_keys(out, self.names)

    def leaf(self, groups: int, normal: bool) -> DataFrame:
        """The test for 2 or more than 2 groups and a normal or other outcome."""
        spec, keys, group = self.spec, self.keys, self.spec.group
        if groups > 2:
            if normal:
                return cmp.anova(self.facts, group, keys, spec.alpha)
            return cmp.kruskal(self.facts, self.facts, group, keys, spec.alpha)
        if spec.paired:
            pairs = cmp.pair_rows(self.rows, spec.y, group, spec.pair_key, keys)
            return (cmp.paired_t if normal else cmp.signed_rank)(pairs, keys, spec.alpha)
        if normal:
            return cmp.welch_t(self.facts, group, keys, spec.alpha)
        return cmp.mann_whitney(self.facts, self.facts, group, keys, spec.alpha)

    def gate(self) -> DataFrame:
        """One row per segment: status, number of groups, normality of the outcome."""
        guard = cmp.group_guard(self.facts, self.spec.group, self.keys)
        normal = self.facts.groupBy(*self.keys).agg(
            F.max("seg_p_value").alias("normality_p"), F.bool_or("seg_is_normal").alias("is_normal")
        )
        return join_on(guard, normal, self.keys)

    @cached_property
    def result(self) -> DataFrame:
        """One row per segment: status, normality and the test the rules choose."""
        return restore_keys(self._result, self.names)

    @cached_property
    def _result(self) -> DataFrame:
        keys, gate = self.keys, self.gate()
        if not keys:
            # A single table: look at the one-row gate and plan only the chosen test.
            row = gate.first()
            if row is None or row["status"] != "ok":
                raise ValueError(row["status"] if row else "no rows to compare")
            chosen = self.leaf(row["n_groups"], bool(row["is_normal"]))
            return chosen.select(
                F.lit(row["n_groups"]).alias("n_groups"), F.lit(row["normality_p"]).alias("normality_p"),
                F.lit(row["is_normal"]).alias("is_normal"), F.lit("ok").alias("status"), *TEST_COLUMNS,
            )
        parts = [
            self.leaf(k, normal).select(*keys, F.lit(k).cast("long").alias("slot"), F.lit(normal).alias("branch"), *TEST_COLUMNS)
            for k in (2, 3) for normal in (True, False)
        ]
        tests = reduce(DataFrame.unionByName, parts)
        gate = gate.withColumn("slot", F.least(F.col("n_groups"), F.lit(3)))
        gate = gate.withColumn("branch", F.when(F.col("status") == "ok", F.coalesce("is_normal", F.lit(False))))
        joined = join_on(gate, tests, [*keys, "slot", "branch"], "left")
        return joined.select(*keys, "n_groups", "normality_p", "is_normal", "status", *TEST_COLUMNS)

    def post_hoc(self) -> DataFrame:
        """Pairwise comparisons of the segments whose test over more than 2 groups is significant."""
        return restore_keys(self._post_hoc(), self.names)

    def _post_hoc(self) -> DataFrame:
        spec, keys, group = self.spec, self.keys, self.spec.group
        wanted = self._result.where(F.col("is_significant") & (F.col("n_groups") > 2)).select(*keys, "is_parametric")
        if not keys:
            row = wanted.first()
            if row is None:
                return cmp.tukey_hsd(self.facts.where(F.lit(False)), group, (), spec.alpha).drop("statistic")
            if row["is_parametric"]:
                return cmp.tukey_hsd(self.facts, group, (), spec.alpha).drop("statistic")
            return cmp.pairwise_mann_whitney(self.rows, spec.y, group, (), spec.alpha, self.facts).drop("statistic", "z")
        tukey = join_on(cmp.tukey_hsd(self.facts, group, keys, spec.alpha), wanted.where("is_parametric"), keys)
        # Rows of other segments are left out before any is copied to its pairs.
        by_rank = wanted.where(~F.col("is_parametric")).select(*keys, F.lit(True).alias("__wanted"))
        facts = join_on(self.facts, by_rank, keys)
        sizes = facts.groupBy(*keys).agg(F.sum("n").alias("__size"), F.bool_or("__wanted").alias("__wanted"))
        rows = attach(self.rows, sizes, keys, self.layout, "__size", ["__wanted"]).where("__wanted").drop("__wanted")
        ranks = cmp.pairwise_mann_whitney(rows, spec.y, group, keys, spec.alpha, facts.drop("__wanted"))
        return tukey.drop("statistic", "is_parametric").unionByName(ranks.drop("statistic", "z"))


def _row(df: DataFrame, keys: Sequence[str], **columns) -> DataFrame:
    empty = {c: F.lit(None) for c in TEST_COLUMNS}
    types = {
        "test": "string", "is_parametric": "boolean", "is_significant": "boolean", "effect_name": "string",
        "higher_group": "string", "method": "string", "decision": "string",
    }
    values = {**empty, **columns}
    return df.select(*keys, *[values[c].cast(types.get(c, "double")).alias(c) for c in TEST_COLUMNS])


def auto_test(df: DataFrame, spec: AnalysisSpec, at_most: int | None = None) -> DataFrame:
    """One test row per segment for any goal (time series excepted), chosen by the routing rules."""
    spec, keys = spec.validated(), list(spec.keys)
    if spec.goal == "compare":
        return Comparison(df, spec, at_most).result
    if spec.goal == "influence":
        fit = fit_summary(regression(df, spec.y, spec.xs, keys, spec.alpha, spec.vif_limit), keys)
        return _row(
            fit, keys, test=F.col("model"), is_parametric=F.lit(True), statistic=F.col("f_statistic"),
            df1=F.col("n_predictors"), df2=F.col("n") - F.col("n_predictors") - 1, p_value=F.col("p_value"),
            is_significant=F.col("is_significant"), effect_name=F.lit("R-squared"), effect_size=F.col("r_squared"),
            decision=decision(F.col("is_significant")),
        )
    if spec.goal == "correlate":
        summary = correlation_summary(correlation(df, spec), keys)
        return _row(
            summary, keys, test=F.col("test"), is_parametric=F.col("test") == "Pearson Correlation", statistic=F.col("r"),
            p_value=F.col("p_value"), is_significant=F.col("is_significant"), effect_name=F.lit("r"),
            effect_size=F.col("r"), decision=decision(F.col("is_significant")),
        )
    wide = mediation(df, spec.y, spec.xs[0], spec.mediator, keys, spec.alpha)
    return _row(
        wide, keys, test=F.lit("Path Analysis (Simple Mediation)"), is_parametric=F.lit(True), statistic=F.col("sobel_z"),
        p_value=F.col("sobel_p"), is_significant=F.col("is_significant"), effect_name=F.lit("indirect effect"),
        effect_size=F.col("indirect"), decision=decision(F.col("is_significant")),
    )


def correlation(df: DataFrame, spec: AnalysisSpec, gate: DataFrame | None = None) -> DataFrame:
    """Correlation table of every segment with the method its outcome's normality asks for."""
    keys = list(spec.keys)
    gate = normality(df, spec.y, keys, spec.small_n, spec.normality_alpha) if gate is None else gate
    if keys:
        return both_methods(df, spec.y, spec.xs, gate, keys, spec.alpha)
    row = gate.select("is_normal").first()
    if row is None:
        raise ValueError("too few rows for a normality test")
    method = pearson if row[0] else spearman
    return method(df, spec.y, spec.xs, keys, spec.alpha)
