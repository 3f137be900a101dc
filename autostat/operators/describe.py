"""Descriptive statistics and group summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from autostat.functions.columns import by_segment, join_on, melt, numeric_frame
from autostat.operators.order import mode_of, ordered_counts, plan_layout, quantile_at


@by_segment
def describe(
    df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), at_most: int | None = None
) -> DataFrame:
    """One row per segment and column: count, mean, median, mode, std, variance, range, min, max.

    Unknown columns are skipped, as are columns without a number.
    """
    known = [c for c in dict.fromkeys(columns) if c in df.columns]
    long = melt(df, known, keys)
    at = [*keys, "column"]
    moments = long.groupBy(*at).agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"),
        F.coalesce(F.var_samp("value"), F.lit(0.0)).alias("variance"),
        (F.max("value") - F.min("value")).alias("range"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    layout = plan_layout(long, "value", at_most and at_most * len(known))
    ordered = ordered_counts(long, "value", at, (), layout)
    middle = ordered.groupBy(*at).agg(quantile_at("value", 0.5).alias("median"), mode_of("value").alias("mode"))
    both = join_on(moments, middle, at)
    return both.select(*at, "count", "mean", "median", "mode", "std", "variance", "range", "min", "max")


@by_segment
def group_moments(df: DataFrame, y: str, group: str, keys: Sequence[str] = ()) -> DataFrame:
    """n, mean and sample variance per segment and group: all the t and F tests need.

    The mean of equal values is that value, free of the rounding of a sum."""
    at = [*keys, group]
    rows = numeric_frame(df, [y], at).where(F.col(y).isNotNull() & F.col(group).isNotNull())
    mean = F.when(F.min(y) == F.max(y), F.min(y)).otherwise(F.avg(y))
    return rows.groupBy(*at).agg(
        F.count(y).alias("n"), mean.alias("mean"), F.coalesce(F.var_samp(y), F.lit(0.0)).alias("variance")
    )


@by_segment
def group_summary(df: DataFrame, y: str, group: str, keys: Sequence[str] = ()) -> DataFrame:
    """n, mean and median per segment and group, one pass per statistic over all groups."""
    at = [*keys, group]
    rows = numeric_frame(df, [y], at).where(F.col(group).isNotNull()).withColumnRenamed(y, "__y")
    middle = ordered_counts(rows, "__y", at).groupBy(*at).agg(quantile_at("__y", 0.5).alias("median"))
    return join_on(group_moments(df, y, group, keys), middle, at).select(*at, "n", "mean", "median")
