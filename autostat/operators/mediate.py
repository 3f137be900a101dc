"""Simple mediation X -> M -> Y with the Sobel test; moderation as an interaction term."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from autostat.functions import normal
from autostat.functions.columns import by_segment, number, ratio
from autostat.functions.tails import t_p
from autostat.operators.gram import cell, gram
from autostat.operators.regress import regression


def _not_negative(c: Column) -> Column:
    return F.greatest(c, F.lit(0.0))


@by_segment
def mediation(df: DataFrame, y: str, x: str, m: str, keys: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """One row per segment: paths a, b, c', c, the indirect effect, Sobel z and the mediation type.

    Three regressions as closed forms of one covariance matrix, all in generated code.
    """
    base = gram(df, [x, m, y], keys).where("n > 3")
    xx, xm, xy = cell(3, 0, 0), cell(3, 0, 1), cell(3, 0, 2)
    mm, my, yy = cell(3, 1, 1), cell(3, 1, 2), cell(3, 2, 2)
    n = F.col("n").cast("double")
    step = base.select(
        *keys, "n", xx.alias("xx"), xm.alias("xm"), xy.alias("xy"), mm.alias("mm"), my.alias("my"), yy.alias("yy"),
        ratio(xm, xx).alias("a"), ratio(xy, xx).alias("c"),
        # Variance of M left by X, and covariance with Y left by X.
        _not_negative(mm - ratio(xm * xm, xx)).alias("m_left"), (my - ratio(xm * xy, xx)).alias("my_left"),
        _not_negative(yy - ratio(xy * xy, xx)).alias("y_left"),
    )
    b = ratio(F.col("my_left"), F.col("m_left"))
    step = step.withColumn("b", b).withColumn("c_prime", F.col("c") - F.col("a") * F.col("b"))
    rest = _not_negative(F.col("y_left") - F.col("b") * F.col("my_left")) * (n - 1) / (n - 3)
    # Standard errors: residual variance over the predictor's own remaining variance.
    x_left = F.col("xx") - ratio(F.col("xm") * F.col("xm"), F.col("mm"))
    step = step.withColumns(
        {
            "se_a": F.sqrt(ratio(F.col("m_left") / (n - 2), F.col("xx"))),
            "se_b": F.sqrt(ratio(rest / (n - 1), F.col("m_left"))),
            "se_c_prime": F.sqrt(ratio(rest / (n - 1), x_left)),
            "se_c": F.sqrt(ratio(F.col("y_left") / (n - 2), F.col("xx"))),
            "indirect": F.col("a") * F.col("b"),
        }
    )
    for path, lost in (("a", 2), ("b", 3), ("c_prime", 3), ("c", 2)):
        step = step.withColumn(f"t_{path}", ratio(F.col(path), F.col(f"se_{path}")))
        step = step.withColumn(f"p_{path}", t_p(F.col(f"t_{path}"), n - lost))
    down = F.sqrt(
        F.col("b") * F.col("b") * F.col("se_a") * F.col("se_a") + F.col("a") * F.col("a") * F.col("se_b") * F.col("se_b")
    )
    step = step.withColumn("sobel_z", F.coalesce(ratio(F.col("indirect"), down), F.lit(0.0)))
    step = step.withColumn("sobel_p", normal.two_sided("sobel_z"))
    direct = F.coalesce(F.col("p_c_prime") < alpha, F.lit(False))
    kind = F.when(F.col("sobel_p") >= alpha, "none").when(direct, "partial").otherwise("full")
    wanted = [f"{s}{p}" for p in ("a", "b", "c_prime", "c") for s in ("", "se_", "t_", "p_")]
    return step.select(
        *keys, "n", *wanted, "indirect", "sobel_z", "sobel_p",
        (F.col("sobel_p") < alpha).alias("is_significant"), kind.alias("mediation_type"),
    )


def mediation_paths(wide: DataFrame, keys: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """Long form: one row per path, the numbers under a path diagram."""
    rows = [
        F.struct(
            F.lit(label).alias("path"), F.col(p).alias("coefficient"), F.col(f"se_{p}").alias("std_err"),
            F.col(f"t_{p}").alias("statistic"), F.col(f"p_{p}").alias("p_value"), (F.col(f"p_{p}") < alpha).alias("is_significant"),
        )
        for label, p in (("a", "a"), ("b", "b"), ("c_prime", "c_prime"), ("c", "c"))
    ]
    rows.append(
        F.struct(
            F.lit("indirect").alias("path"), F.col("indirect").alias("coefficient"), F.lit(None).cast("double").alias("std_err"),
            F.col("sobel_z").alias("statistic"), F.col("sobel_p").alias("p_value"), F.col("is_significant").alias("is_significant"),
        )
    )
    return wide.select(*keys, "n", "mediation_type", F.inline(F.array(*rows)))


def moderation(df: DataFrame, y: str, x: str, m: str, keys: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """Coefficient table of Y on X, M and X*M; the last term carries the moderation."""
    product = f"{x}*{m}"
    rows = df.select(*keys, y, x, m, (number(df, x) * number(df, m)).alias(product))
    return regression(rows, y, [x, m, product], keys, alpha, vif_limit=None)
