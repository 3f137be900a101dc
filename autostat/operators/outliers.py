"""Robust spread, outlier flags, winsorising and logarithms, for one table or many segments.

The median absolute deviation is selected on the folded order, without sorting |x - m| as a whole. With n values, the
order statistics x(i) and x(j), i = floor((n-1)/4) and j = i + ceil((n-1)/2), enclose the median m; the middle distances
from m lie between the smaller and the larger of m - x(i) and x(j) - m. Smaller distances are only counted; the values
between the two limits are the only ones ordered again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from autostat.functions.columns import by_segment, join_on, number, numeric_frame, ratio
from autostat.operators.order import attach, ordered_counts, plan_layout, quantile_at
from autostat.sources.checkpoints import cut_lineage

# The deviation of a normal sample in units of its standard deviation, and the usual limits.
MAD_UNIT = 0.6745
MAD_LIMIT, Z_LIMIT = 3.5, 3.0


def _at(index: Column, value: str) -> Column:
    """Aggregate over `ordered_counts` rows: the value at a place, counted from 0."""
    return F.max(F.when((F.col("upto") - F.col("tied") <= index) & (index < F.col("upto")), F.col(value)))


@by_segment
def median_deviation(df: DataFrame, column: str, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, n, median, mad) of every segment; segments without values are absent."""
    rows = numeric_frame(df, [column], keys).where(F.col(column).isNotNull())
    layout = plan_layout(rows, column)
    ordered = cut_lineage(ordered_counts(rows, column, keys, (), layout))
    n = F.col("total")
    first = F.floor((n - 1) / 4)
    middle = ordered.groupBy(*keys).agg(
        F.max("total").alias("n"), quantile_at(column, 0.5).alias("median"),
        _at(first, column).alias("__low"), _at(first + F.ceil((n - 1) / 2), column).alias("__high"),
    )
    left, right = F.col("median") - F.col("__low"), F.col("__high") - F.col("median")
    middle = cut_lineage(middle.select(*keys, "n", "median", F.least(left, right).alias("__near"), F.greatest(left, right).alias("__far")))
    folded = attach(ordered.select(*keys, column, "cnt"), middle, keys, layout, "n", ["median", "__near", "__far"])
    distance = F.abs(F.col(column) - F.col("median"))
    folded = folded.select(*keys, "cnt", distance.alias("__d"), "__near", "__far")
    closer = folded.where("__d < __near").groupBy(*keys).agg(F.sum("cnt").alias("__closer"))
    between = folded.where("__d >= __near AND __d <= __far")
    places = ordered_counts(between.select(*keys, "__d", "cnt"), "__d", keys, (), plan_layout(between, "__d"), weight="cnt")
    start = join_on(middle.select(*keys, "n"), closer, keys, "left").fillna(0, ["__closer"])
    found = attach(places, start, keys, layout, "n", ["n", "__closer"])
    spot = (F.col("n") - 1) / 2
    pick = lambda f: _at(f(spot) - F.col("__closer"), "__d")
    mad = found.groupBy(*keys).agg(((pick(F.floor) + pick(F.ceil)) / 2).alias("mad"))
    return join_on(middle.select(*keys, "n", "median"), mad, keys)


def _segment_moments(df: DataFrame, column: str, keys: Sequence[str]) -> DataFrame:
    value = number(df, column)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__n"), F.avg(value).alias("__centre"), F.stddev_samp(value).alias("__scale")
    )


def _scored(df: DataFrame, column: str, keys: Sequence[str], of_segment: DataFrame, limit: float) -> DataFrame:
    """`df` with `score` = (x - centre) / scale and `is_outlier`; without spread nothing is an outlier."""
    layout = plan_layout(numeric_frame(df, [column], keys), column)
    rows = attach(df, of_segment, keys, layout, "__n", ["__centre", "__scale"])
    score = ratio(number(rows, column) - F.col("__centre"), F.col("__scale"))
    rows = rows.withColumn("score", score).drop("__centre", "__scale")
    return rows.withColumn("is_outlier", F.coalesce(F.abs("score") > limit, F.lit(False)))


def robust_scores(df: DataFrame, column: str, keys: Sequence[str] = (), limit: float = MAD_LIMIT) -> DataFrame:
    """`score` 0.6745 (x - median) / MAD of every row, and whether its size is above `limit`."""
    spread = median_deviation(df, column, keys)
    of_segment = spread.select(
        *keys, F.col("n").alias("__n"), F.col("median").alias("__centre"), (F.col("mad") / MAD_UNIT).alias("__scale")
    )
    return _scored(df, column, keys, of_segment, limit)


def z_scores(df: DataFrame, column: str, keys: Sequence[str] = (), limit: float = Z_LIMIT) -> DataFrame:
    """`score` (x - mean) / standard deviation of every row, and whether its size is above `limit`."""
    return _scored(df, column, keys, _segment_moments(df, column, keys), limit)


def winsorized(df: DataFrame, column: str, keys: Sequence[str] = (), low: float = 0.05, high: float = 0.95) -> DataFrame:
    """`df` with `column` pulled in to its segment's quantiles `low` and `high`; missing values stay missing."""
    rows = numeric_frame(df, [column], keys).where(F.col(column).isNotNull())
    layout = plan_layout(rows, column)
    ordered = ordered_counts(rows, column, keys, (), layout)
    limits = ordered.groupBy(*keys).agg(
        F.max("total").alias("__n"), quantile_at(column, low).alias("__low"), quantile_at(column, high).alias("__high")
    )
    found = attach(df, limits, keys, layout, "__n", ["__low", "__high"])
    value = number(found, column)
    inside = F.when(value.isNotNull(), F.greatest(F.least(value, F.col("__high")), F.col("__low")))
    return found.withColumn(column, inside).select(*df.columns)


def logged(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Natural logarithms of the columns; values that have none become missing."""
    return df.withColumns({c: F.when(number(df, c) > 0, F.ln(number(df, c))) for c in columns})
