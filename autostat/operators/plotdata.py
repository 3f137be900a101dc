"""The numbers under the charts, as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from autostat.functions.columns import by_segment, numeric_frame, ratio
from autostat.operators.order import ordered_counts, plan_layout, quantile_at

FENCE = 1.5


@by_segment
def box_stats(
    df: DataFrame, y: str, group: str, keys: Sequence[str] = (), at_most: int | None = None
) -> DataFrame:
    """Per group: n, quartiles, whisker ends (furthest points within 1.5 IQR), number of fliers."""
    at = [*keys, group]
    rows = numeric_frame(df, [y], at).where(F.col(group).isNotNull()).withColumnRenamed(y, "__y")
    y = "__y"
    ordered = ordered_counts(rows, y, at, (), plan_layout(rows, y, at_most))
    box = ordered.groupBy(*at).agg(
        F.max("total").alias("n"), quantile_at(y, 0.25).alias("q1"), quantile_at(y, 0.5).alias("median"), quantile_at(y, 0.75).alias("q3"),
    )
    # The furthest points inside the fences come from a second aggregate over the raw rows against one
    # box row per group; groups are few, so Spark broadcasts the boxes.
    fence = box.select(
        *[F.col(c).alias(f"__{c}") for c in at], "n", "q1", "median", "q3",
        (F.col("q1") - FENCE * (F.col("q3") - F.col("q1"))).alias("low"),
        (F.col("q3") + FENCE * (F.col("q3") - F.col("q1"))).alias("high"),
    )
    on = None
    for c in at:
        same = ordered[c].eqNullSafe(fence[f"__{c}"])
        on = same if on is None else on & same
    inside = F.col(y).between(F.col("low"), F.col("high"))
    return (
        ordered.join(fence, on)
        .groupBy(*at)
        .agg(
            F.max("n").alias("n"), F.max("q1").alias("q1"), F.max("median").alias("median"), F.max("q3").alias("q3"),
            F.min(F.when(inside, F.col(y))).alias("whisker_low"), F.max(F.when(inside, F.col(y))).alias("whisker_high"),
            F.coalesce(F.sum(F.when(~inside, F.col("cnt"))), F.lit(0)).alias("n_fliers"),
        )
    )


@by_segment
def trend_line(df: DataFrame, y: str, x: str, keys: Sequence[str] = ()) -> DataFrame:
    """Slope and intercept of Y on X with the range the line is drawn over."""
    rows = numeric_frame(df, [x, y], keys).dropna(how="any", subset=[x, y])
    slope = ratio(F.covar_samp(x, y), F.var_samp(x))
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), slope.alias("slope"), (F.avg(y) - slope * F.avg(x)).alias("intercept"),
        F.min(x).alias("x_min"), F.max(x).alias("x_max"),
    )


def scatter_grid(df: DataFrame, y: str, x: str, bins: int = 100) -> DataFrame:
    """Every complete row of a scatter chart, counted in a grid of `bins` by `bins` cells between the extremes."""
    rows = numeric_frame(df, [x, y]).dropna(how="any")
    ends = rows.agg(F.min(x), F.max(x), F.min(y), F.max(y)).first()

    def cell(c: str, low: float | None, high: float | None) -> Column:
        if low is None or low == high:
            return F.lit(0).cast("long")
        at = F.floor((F.col(c) - F.lit(low)) / (F.lit(high) - F.lit(low)) * bins)
        return F.least(at, F.lit(bins - 1)).cast("long")

    cells = rows.select(cell(x, *ends[:2]).alias("x_bin"), cell(y, *ends[2:]).alias("y_bin"))
    return cells.groupBy("x_bin", "y_bin").agg(F.count("*").alias("n"))
