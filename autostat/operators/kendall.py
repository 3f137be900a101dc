"""Kendall's tau-b of each predictor with the outcome, from a distributed count of discordant pairs.

Equal (x, y) collapse to one weighted row first. A large segment is cut into buckets of x and buckets of y; a pair of
rows with x1 < x2 and y1 > y2 then falls into exactly one of three cases:

* the same x bucket: counted inside that bucket;
* different x buckets, the same y bucket: counted inside the y bucket, where only the x bucket still matters, so rows
  collapse to (x bucket, y);
* different buckets in both: counted on the two-dimensional histogram of buckets, which is a smaller table of weighted
  points and is treated the same way again while it is too large for one task.

A value of x that fills a bucket by itself has no discordant pairs inside it and is never gathered.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from autostat.functions import normal
from autostat.functions.columns import by_segment, direction, join_on, numeric_frame, ratio, strength
from autostat.operators.order import Layout, bucketed, plan_layout
from autostat.sources.checkpoints import cut_lineage


def discordant(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """Total weight of pairs with x1 < x2 and y1 > y2.

    Rows in order of (x, y) are parted by one bit of y's rank after the other, highest first, keeping their order: two
    rows that agree in all higher bits are discordant if the earlier one has the bit and the later one has not.
    """
    order = np.lexsort((y, x))
    rank = np.unique(y, return_inverse=True)[1][order]
    weight, total = weight[order].astype(float), 0.0
    for b in range(int(rank.max(initial=0)).bit_length() - 1, -1, -1):
        bit, part = (rank >> b) & 1, rank >> (b + 1)
        starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        sizes = np.diff(np.r_[starts, len(rank)])
        before = lambda v, starts=starts, sizes=sizes: (lambda c: c - np.repeat(c[starts], sizes))(np.cumsum(v) - v)
        total += float((weight * (1 - bit)) @ before(weight * bit))
        ones = before(bit)
        zeros = np.repeat(sizes - np.add.reduceat(bit, starts), sizes)
        place = np.repeat(starts, sizes) + np.where(bit == 1, zeros + ones, before(1 - bit))
        moved_rank, moved_weight = np.empty_like(rank), np.empty_like(weight)
        moved_rank[place], moved_weight[place] = rank, weight
        rank, weight = moved_rank, moved_weight
    return total


def _inside(points: DataFrame, keys: Sequence[str], at: Sequence[str], x: str, y: str) -> DataFrame:
    """(keys, discordant): pairs within each group of `at`."""
    fields = T.StructType([*[points.schema[k] for k in keys], T.StructField("discordant", T.DoubleType())])

    def run(part: pa.Table) -> pa.Table:
        count = discordant(*(part[c].to_numpy() for c in (x, y, "cnt")))
        return pa.Table.from_arrays([*[part[k].combine_chunks()[:1] for k in keys], pa.array([count])], fields.fieldNames())

    return points.select(*dict.fromkeys([*keys, *at, x, y, "cnt"])).groupBy(*at).applyInArrow(run, fields)


def _apart(points: DataFrame, x: str, layout: Layout) -> Layout:
    """The layout with values of x that fill a bucket on their own cut out (at most rows / limit of them)."""
    hot = points.groupBy(x).agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > layout.limit).select(x).collect()
    return layout.isolating(sorted(r[0] for r in hot)) if hot else layout


def discordant_pairs(points: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, discordant) of weighted points (keys, x, y, cnt), one row for each distinct (keys, x, y)."""
    keys = list(keys)
    found, level, before = None, points, None
    add = lambda more: more if found is None else found.unionByName(more)
    while True:
        layout = plan_layout(level, "x")
        # The histogram has at most (rows / limit)^2 cells: it shrinks as long as there are fewer rows than limit^2.
        if layout.single or (before is not None and 2 * layout.rows > before):
            whole = level if keys else level.withColumn("__whole", F.lit(0))
            found = add(_inside(whole, keys, keys or ["__whole"], "x", "y"))
            break
        before = layout.rows
        by_x = bucketed(level, "x", keys, _apart(level, "x", layout)).withColumnRenamed("__bucket", "__xb")
        both = cut_lineage(bucketed(by_x, "y", keys, plan_layout(level, "y")).withColumnRenamed("__bucket", "__yb"))
        # Buckets with one value of x have no such pairs: their rows stay where they are.
        several = both.groupBy(*keys, "__xb").agg(F.min("x").alias("a"), F.max("x").alias("b")).where("a < b")
        found = add(_inside(join_on(both, several.select(*keys, "__xb"), [*keys, "__xb"], "left_semi"), keys, [*keys, "__xb"], "x", "y"))
        cut = both.where("__xb >= 0")
        same_y = cut.groupBy(*keys, "__yb", "__xb", "y").agg(F.sum("cnt").alias("cnt"))
        found = found.unionByName(_inside(same_y, keys, [*keys, "__yb"], "__xb", "y"))
        cells = cut.groupBy(*keys, F.col("__xb").cast("double").alias("x"), F.col("__yb").cast("double").alias("y"))
        level = cut_lineage(cells.agg(F.sum("cnt").alias("cnt")))
    return found.groupBy(*keys).agg(F.sum("discordant").alias("discordant"))


def _ties(points: DataFrame, seg: Sequence[str], of: Sequence[str], out: str) -> DataFrame:
    """Sums over tied groups that the statistic and its variance need."""
    t = F.col("t")
    tied = points.groupBy(*seg, *of).agg(F.sum("cnt").cast("double").alias("t"))
    return tied.groupBy(*seg).agg(
        F.sum(t * (t - 1)).alias(f"{out}2"), F.sum(t * (t - 1) * (t - 2)).alias(f"{out}3"),
        F.sum(t * (t - 1) * (2 * t + 5)).alias(f"{out}v"),
    )


def tau(n: Column) -> tuple[Column, Column]:
    """tau-b and its normal score, from the sums of `_ties` and `discordant`."""
    s = (n * (n - 1) - F.col("x2") - F.col("y2") + F.col("xy2")) / 2 - 2 * F.col("discordant")
    size = F.sqrt((n * (n - 1) - F.col("x2")) * (n * (n - 1) - F.col("y2"))) / 2
    spread = (
        (n * (n - 1) * (2 * n + 5) - F.col("xv") - F.col("yv")) / 18 + ratio(F.col("x2") * F.col("y2"), 2 * n * (n - 1))
        + F.coalesce(ratio(F.col("x3") * F.col("y3"), 9 * n * (n - 1) * (n - 2)), F.lit(0.0))
    )
    return ratio(s, size), ratio(s, F.sqrt(spread))


@by_segment
def kendall(df: DataFrame, y: str, xs: Sequence[str], keys: Sequence[str] = (), alpha: float = 0.05) -> DataFrame:
    """Rank correlation by concordance, one row per predictor: the columns of the other correlation tables.

    Complete pairs only. The p-value is the normal approximation with its correction for ties; a constant predictor or
    outcome has r = 0 and p = 1."""
    known = [x for x in dict.fromkeys(xs) if x in df.columns]
    rows = numeric_frame(df, list(dict.fromkeys([y, *known])), keys)
    cells = [F.struct(F.lit(i).alias("position"), F.lit(x).alias("variable"), F.col(x).alias("x"), F.col(y).alias("y"))
             for i, x in enumerate(known)]
    seg = [*keys, "position", "variable"]
    pairs = rows.select(*keys, F.inline(F.array(*cells))).where(F.col("x").isNotNull() & F.col("y").isNotNull())
    points = cut_lineage(pairs.groupBy(*seg, "x", "y").agg(F.count(F.lit(1)).alias("cnt")))
    found = points.groupBy(*seg).agg(F.sum("cnt").alias("n"))
    for of, out in ((["x"], "x"), (["y"], "y"), (["x", "y"], "xy")):
        found = join_on(found, _ties(points, seg, of, out), seg)
    found = join_on(found, discordant_pairs(points, seg), seg)
    r, z = tau(F.col("n").cast("double"))
    found = found.withColumns({"r": F.coalesce(r, F.lit(0.0)), "z": F.coalesce(z, F.lit(0.0))})
    found = found.withColumn("p_value", F.when(F.col("z") == 0, 1.0).otherwise(normal.two_sided("z")))
    return found.select(
        *keys, "position", "variable", F.lit("Kendall Rank Correlation").alias("method"), "n", "r", "p_value",
        (F.col("p_value") < alpha).alias("is_significant"), strength(F.col("r")).alias("strength"), direction(F.col("r")).alias("direction"),
    )
