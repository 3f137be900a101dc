"""Normality of a numeric column per segment: Shapiro-Wilk below 30 rows, Lilliefors from 30 on."""

from __future__ import annotations

import statistics
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from autostat.functions import normal
from autostat.functions.columns import by_segment, numeric_frame, ratio
from autostat.operators.order import Layout, attach, ordered_counts, plan_layout

SMALLEST, SMALL_LIMIT, NORMALITY_ALPHA = 5, 30, 0.05

# Polynomials of the Shapiro-Wilk weights and p-value (Royston 1995, AS R94), low order first.
FIRST_WEIGHT = (0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056)
SECOND_WEIGHT = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
SMALL_GAMMA = (-2.273, 0.459)
SMALL_MEAN = (0.544, -0.39978, 0.025054, -6.714e-4)
SMALL_LOG_SD = (1.3822, -0.77857, 0.062767, -0.0020322)
LARGE_MEAN = (-1.5861, -0.31082, -0.083751, 0.0038915)
LARGE_LOG_SD = (-0.4803, -0.082676, 0.0030302)

# Lilliefors p below 0.1 (Dallal & Wilkinson 1986) and above (Stephens 1974), high order first.
TAIL_FIT = (-7.01256, 2.78019, 2.99587, -0.122119, 0.974598, 1.67997)
UPPER_FITS = (
    (0.5, (81.218052, -138.55152, 80.709644, -19.828315, 2.76773)),
    (0.9, (-32.355711, 94.029866, -97.490286, 40.662806, -4.901232)),
    (1.31, (2.423045, -12.234627, 23.186922, -19.558097, 6.198765)),
)


def shapiro_weights(n: int) -> list[float]:
    """Weights of the n ordered observations (n >= 4), smallest first."""
    inverse = statistics.NormalDist().inv_cdf
    scores = [inverse((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)]
    size = sum(s * s for s in scores)
    root = n**-0.5
    last = normal.polynomial(FIRST_WEIGHT[::-1], root) + scores[-1] / size**0.5
    weights = [0.0] * n
    weights[-1], weights[0] = last, -last
    if n > 5:
        second = normal.polynomial(SECOND_WEIGHT[::-1], root) + scores[-2] / size**0.5
        weights[-2], weights[1] = second, -second
        scale = ((size - 2 * scores[-1] ** 2 - 2 * scores[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)) ** 0.5
        inner = range(2, n - 2)
    else:
        scale = ((size - 2 * scores[-1] ** 2) / (1 - 2 * last**2)) ** 0.5
        inner = range(1, n - 1)
    for i in inner:
        weights[i] = scores[i] / scale
    return weights


def _weight_table(spark: SparkSession, limit: int) -> DataFrame:
    """(total, up to i, running sum of the weights): under limit**2/2 rows."""
    rows = []
    for n in range(SMALLEST, limit):
        running = 0.0
        rows.append((n, 0, 0.0))
        for i, w in enumerate(shapiro_weights(n), start=1):
            running += w
            rows.append((n, i, running))
    return spark.createDataFrame(rows, "wn long, wi long, running double")


def _with_p(df: DataFrame, small_limit: int) -> DataFrame:
    """Add `p_value` from the columns n, w (Shapiro-Wilk), d (Lilliefors) and flat."""
    poly = normal.polynomial_sql
    low, gamma, size = "ln(greatest(1 - w, 1e-19D))", f"({SMALL_GAMMA[1]!r}D * n + {SMALL_GAMMA[0]!r}D)", "ln(double(n))"
    small = f"(-ln(greatest({gamma} - {low}, 1e-300D)) - {poly(SMALL_MEAN[::-1], 'n')}) / exp({poly(SMALL_LOG_SD[::-1], 'n')})"
    large = f"({low} - {poly(LARGE_MEAN[::-1], size)}) / exp({poly(LARGE_LOG_SD[::-1], size)})"
    a, shift, b, c, e, f = TAIL_FIT
    k = "((sqrt(double(n)) - 0.01D + 0.85D / sqrt(double(n))) * d)"
    upper = " ".join(f"WHEN {k} <= {limit!r}D THEN {poly(fit, k)}" for limit, fit in UPPER_FITS)
    staged = df.withColumns(
        {
            "zw": F.expr(f"CASE WHEN n <= 11 THEN {small} ELSE {large} END"),
            "dist": F.expr("CASE WHEN n > 100 THEN d * pow(n / 100D, 0.49D) ELSE d END"),
            "size": F.expr("least(double(n), 100D)"),
        }
    )
    staged = staged.withColumns(
        {
            "pw": F.when(F.expr(f"n <= 11 AND {low} >= {gamma}"), 1e-99).otherwise(normal.upper_tail("zw")),
            "tail": F.expr(
                f"exp({a!r}D * dist * dist * (size + {shift!r}D) + {b!r}D * dist * sqrt(size + {shift!r}D) "
                f"+ {c!r}D + {e!r}D / sqrt(size) + {f!r}D / size)"
            ),
        }
    )
    lilliefors = F.expr(f"CASE WHEN tail <= 0.1D THEN tail WHEN {k} <= 0.302D THEN 1D {upper} ELSE 0D END")
    small_n = F.col("n") < small_limit
    p = F.when(F.col("flat"), F.when(small_n, 1.0).otherwise(0.0)).when(small_n, F.col("pw")).otherwise(lilliefors)
    return staged.withColumn("p_value", p)


def moments(df: DataFrame, column: str, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(column).alias("__n"), F.avg(column).alias("__m"),
        F.stddev_samp(column).alias("__s"), (F.var_samp(column) * (F.count(column) - 1)).alias("__ss"),
    )


def normality_of(
    ordered: DataFrame, stats: DataFrame, layout: Layout, column: str, keys: Sequence[str],
    small_limit: int = SMALL_LIMIT, alpha: float = NORMALITY_ALPHA,
) -> DataFrame:
    """`normality` on an existing `ordered_counts` frame (shared with the rank tests) and `moments`."""
    at = attach(ordered, stats, keys, layout, "__n", ["__n", "__m", "__s", "__ss"])
    weights = F.broadcast(_weight_table(ordered.sparkSession, small_limit))
    low, high = weights.select("wn", "wi", F.col("running").alias("w0")), weights.select(
        F.col("wn").alias("vn"), F.col("wi").alias("vi"), F.col("running").alias("w1")
    )
    at = at.join(F.broadcast(low), (F.col("total") == F.col("wn")) & (F.col("upto") - F.col("tied") == F.col("wi")), "left")
    at = at.join(F.broadcast(high), (F.col("total") == F.col("vn")) & (F.col("upto") == F.col("vi")), "left")
    # Separate projections keep the long polynomial from being generated once per use.
    at = at.withColumn("__z", ratio(F.col(column) - F.col("__m"), F.col("__s")))
    at = at.withColumn("__f", normal.cumulative("__z"))
    gap = F.greatest(
        F.col("upto") / F.col("total") - F.col("__f"), F.col("__f") - (F.col("upto") - F.col("tied")) / F.col("total"),
        F.lit(0.0),
    )
    share = F.col("cnt") / F.col("tied")
    agg = at.groupBy(*keys).agg(
        F.max("__n").alias("n"), F.max("__ss").alias("ss"), F.max("__s").alias("s"),
        F.max(gap).alias("d"), F.sum(share * F.col(column) * (F.col("w1") - F.col("w0"))).alias("b"),
    )
    n = F.col("n")
    flat = F.coalesce(F.col("s"), F.lit(0.0)) == 0
    w = F.when(flat, 1.0).otherwise(F.least(ratio(F.col("b") * F.col("b"), F.col("ss")), F.lit(1.0)))
    small = n < small_limit
    scored = _with_p(agg.where(n >= SMALLEST).withColumn("flat", flat).withColumn("w", w), small_limit)
    small = n < small_limit
    known = scored.select(
        *keys, F.lit(column).alias("column"),
        F.when(small, "Shapiro-Wilk").otherwise("Kolmogorov-Smirnov (Lilliefors)").alias("test_name"),
        n, F.when(small, F.col("w")).otherwise(F.col("d")).alias("statistic"), "p_value",
    )
    return known.withColumn("is_normal", F.coalesce(F.col("p_value"), F.lit(0.0)) >= alpha)


@by_segment
def normality(
    df: DataFrame, column: str, keys: Sequence[str] = (),
    small_limit: int = SMALL_LIMIT, alpha: float = NORMALITY_ALPHA, at_most: int | None = None,
) -> DataFrame:
    """One row per segment with at least 5 numbers: test, n, statistic, p-value, is_normal."""
    rows = numeric_frame(df, [column], keys).withColumnRenamed(column, "__y")
    layout = plan_layout(rows, "__y", at_most)
    ordered = ordered_counts(rows, "__y", keys, (), layout)
    found = normality_of(ordered, moments(rows, "__y", keys), layout, "__y", keys, small_limit, alpha)
    return found.withColumn("column", F.lit(column))
