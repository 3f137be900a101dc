"""Questionnaire instruments: Cronbach's alpha and corrected item-total correlations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from autostat.functions.columns import by_segment, ratio
from autostat.functions.tails import t_p
from autostat.operators.gram import cell, gram

# Thresholds of a reliable instrument and of a valid item.
RELIABLE, VALID = 0.6, 0.3
SMALLEST = 5


@by_segment
def instrument(df: DataFrame, items: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """One row per item: r with the sum of the others, validity, and the instrument's alpha. One scan."""
    if len(items) < 2:
        raise ValueError("an instrument needs at least 2 items")
    k = len(items)
    # Per item its variance and its covariance with the sum of all items; the total variance is their sum.
    shared = [reduce(lambda a, b: a + b, [cell(k, i, j) for j in range(k)]) for i in range(k)]
    base = gram(df, items, keys).where(F.col("n") >= SMALLEST).select(
        *keys, "n", F.array(*[cell(k, i, i) for i in range(k)]).alias("own"), F.array(*shared).alias("shared")
    )
    add = lambda a, x: a + x
    base = base.withColumns(
        {"total": F.aggregate("shared", F.lit(0.0), add), "single": F.aggregate("own", F.lit(0.0), add)}
    )
    alpha = F.when(F.col("total") == 0, 0.0).otherwise((1 - ratio(F.col("single"), F.col("total"))) * (k / (k - 1)))
    rows = []
    for i, item in enumerate(items):
        own, with_all = F.col("own")[i], F.col("shared")[i]
        others = F.col("total") - 2 * with_all + own
        r = ratio(with_all - own, F.sqrt(F.greatest(own * others, F.lit(0.0))))
        rows.append(F.struct(F.lit(i).alias("position"), F.lit(item).alias("item"), r.alias("raw")))
    flat = base.select(*keys, "n", alpha.alias("cronbach_alpha"), F.inline(F.array(*rows)))
    dof = (F.col("n") - 2).cast("double")
    t = F.when(F.abs("raw") >= 1, F.lit(1e150)).otherwise(F.col("raw") * F.sqrt(dof / (1 - F.col("raw") * F.col("raw"))))
    scored = flat.withColumn("p_value", F.when(F.col("raw").isNull(), 1.0).otherwise(t_p(t, dof)))
    r = F.coalesce(F.col("raw"), F.lit(0.0))
    return scored.select(
        *keys, "position", "item", r.alias("r"), "p_value", (r >= VALID).alias("is_valid"),
        F.when(r >= VALID, "valid").otherwise("invalid").alias("item_label"), "cronbach_alpha",
        (F.col("cronbach_alpha") >= RELIABLE).alias("is_reliable"),
        F.when(F.col("cronbach_alpha") >= RELIABLE, "reliable").otherwise("unreliable").alias("instrument_label"), "n",
    )
