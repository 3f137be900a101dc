"""Order statistics without a one-task sort.

Every rank, quantile, mode and distribution-distance in this package starts
from `ordered_counts`: ties collapse in a partial aggregation, a large segment
is cut into value buckets, each bucket is ordered on its own and the bucket
totals give the offsets. No task ever orders more than one bucket.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from autostat.functions.columns import join_on

BUCKET_ROWS_CONF = "spark.autostat.bucketRows"
DEFAULT_BUCKET_ROWS = 4_000_000
# Bounds of the layout: cut points of a pass, rows looked at to place them, and large segments that may be broadcast.
CUT_POINTS = 1024
CUT_ROWS = 1_000_000
# Rows of a bucket looked at to cut it again.
CUT_ROWS_INSIDE = 1000
LARGE_SEGMENTS = 10_000
# Parts of a segment in the lookup of more large segments than that.
LOOKUP_SALTS = 64


def bucket_rows(df: DataFrame) -> int:
    """Rows one task may order at once (session setting)."""
    return int(df.sparkSession.conf.get(BUCKET_ROWS_CONF, str(DEFAULT_BUCKET_ROWS)))


@dataclass(frozen=True)
class Layout:
    """Where the value axis is cut; a pure function of the value, so recomputed tasks agree."""

    rows: int
    limit: int
    cuts: tuple[float, ...] = ()

    @property
    def single(self) -> bool:
        return self.rows <= self.limit

    @property
    def buckets(self) -> int:
        return max(1, len(self.cuts))

    def isolating(self, points: Sequence[float]) -> Layout:
        """The same layout with each of `points` alone in its bucket."""
        inner = set(self.cuts[1:-1])
        for x in points:
            inner |= {x, math.nextafter(x, math.inf)}
        cuts = sorted(inner)
        low, high = min(cuts[0], *self.cuts[:1], *points) - 1, max(cuts[-1], *self.cuts[-1:], *points) + 1
        return replace(self, cuts=(low, *cuts, high))

    def assign(self, df: DataFrame, value: str, out: str) -> DataFrame:
        """Add the bucket number."""
        if len(self.cuts) < 3:
            return df.withColumn(out, F.lit(0).cast("long"))
        edges = [float("-inf"), *self.cuts[1:-1], float("inf")]
        cut = Bucketizer(splits=edges, inputCol=value, outputCol="__coarse").transform(df)
        return cut.withColumn(out, F.col("__coarse").cast("long")).drop("__coarse")


def plan_layout(df: DataFrame, value: str, at_most: int | None = None, limit: int | None = None) -> Layout:
    """Count the rows; cut points (literals from a quantile sketch) only when one bucket is too few.

    A caller that already knows an upper bound on the rows passes it and may save the count. `limit` is the rows of a
    bucket, by default the session's.
    """
    limit = limit or bucket_rows(df)
    if at_most is not None and at_most <= limit:
        return Layout(at_most, limit)
    rows = df.select(F.count(value)).first()[0]
    if rows <= limit:
        return Layout(rows, limit)
    cores = df.sparkSession.sparkContext.defaultParallelism
    wanted = min(CUT_POINTS, max(-(-rows // limit), cores))
    probs = [i / wanted for i in range(wanted + 1)]
    # As in a range shuffle, a look at some rows is enough to place the cuts (it keeps the sketches of many
    # tasks small). They only decide which task orders a row; every row is counted, whatever the cuts.
    share = min(1.0, CUT_ROWS / rows)
    seen = df.select(value) if share == 1.0 else df.select(value).sample(fraction=share, seed=11)
    cuts = seen.select(F.percentile_approx(value, probs, 20 * CUT_POINTS)).first()[0] or []
    layout = Layout(rows, limit, tuple(sorted(set(cuts))))
    parts = -(-rows // (limit * CUT_POINTS))
    return layout if parts == 1 else _finer(df, value, layout, parts)


def _finer(df: DataFrame, value: str, layout: Layout, parts: int) -> Layout:
    """A second pass cuts every bucket at quantiles of its own, so that also a long tail is spread: rows / limit cuts."""
    share = min(1.0, CUT_ROWS_INSIDE / layout.limit)
    seen = df.select(value) if share == 1.0 else df.select(value).sample(fraction=share, seed=12)
    probs = [i / parts for i in range(1, parts)]
    inner = layout.assign(seen.where(F.col(value).isNotNull()), value, "__bucket").groupBy("__bucket")
    found = inner.agg(F.percentile_approx(value, probs, 20 * parts).alias("cuts")).collect()
    more = {x for r in found for x in r["cuts"]}
    return replace(layout, cuts=tuple(sorted({*layout.cuts, *more})))


@dataclass(frozen=True)
class Ties:
    """Single values of the ordered column that fill more than a bucket; their rows are cut by a second column."""

    points: tuple[float, ...]
    column: str
    layout: Layout

    def assign(self, df: DataFrame, value: str, out: str) -> DataFrame:
        inner = self.layout.assign(df, self.column, "__inner")
        tied = F.col(value).isin(list(self.points))
        number = F.col(out) * self.layout.buckets + F.when(tied, F.col("__inner")).otherwise(0)
        return inner.withColumn(out, number).drop("__inner")


def bucketed(
    df: DataFrame, value: str, keys: Sequence[str], layout: Layout, ties: Ties | None = None, flag: bool = False
) -> DataFrame:
    """Add `__bucket`, the value bucket of a row in a large segment; segments that fit in one bucket stay whole
    (bucket -1). With `flag`, also `__large`: whether the segment is cut (NULL if not)."""
    keys = list(keys)
    if layout.single:
        out = df.withColumn("__bucket", F.lit(-1).cast("long"))
        return out.withColumn("__large", F.lit(None).cast("boolean")) if flag else out
    if keys:
        large = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > layout.limit)
        large = large.select(*keys, F.lit(True).alias("__large"))
        if layout.rows // layout.limit <= LARGE_SEGMENTS:
            df = join_on(df, F.broadcast(large), keys, "left")
        else:
            # Too many may be large for a broadcast: look them up by segment and part of its values.
            salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(LOOKUP_SALTS - 1).cast("long")))
            salted = df.withColumn("__salt", F.pmod(F.xxhash64(value), F.lit(LOOKUP_SALTS)).cast("long"))
            df = join_on(salted, large.withColumn("__salt", salts), [*keys, "__salt"], "left").drop("__salt")
    else:
        df = df.withColumn("__large", F.lit(True))
    df = layout.assign(df, value, "__bucket")
    if ties:
        df = ties.assign(df, value, "__bucket")
    if keys:
        df = df.withColumn("__bucket", F.when(F.col("__large"), F.col("__bucket")).otherwise(-1))
    return df if flag else df.drop("__large")


def spread(
    df: DataFrame, value: str, keys: Sequence[str], layout: Layout, weight: str, ties: Ties | None = None
) -> DataFrame:
    """Add `__bucket` and `__before`, `__all`: weight in earlier buckets, and in the whole segment.

    Segments that fit in one bucket stay whole (bucket -1, NULL totals: the caller's
    window sees all of them), so many small segments pay no extra shuffle.
    """
    keys = list(keys)
    df = bucketed(df, value, keys, layout, ties, flag=True)
    # Filter on the broadcast flag, not on the bucket: a bucket filter would be pushed below the
    # shuffle of `df` and stop Spark from reusing it for both branches.
    split = df.where("__large") if keys else df
    inside = split.groupBy(*keys, "__bucket").agg(F.sum(weight).alias("__inside"))
    df = df.drop("__large")
    earlier = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = inside.select(
        *keys, "__bucket",
        F.coalesce(F.sum("__inside").over(earlier), F.lit(0)).alias("__before"),
        F.sum("__inside").over(Window.partitionBy(*keys)).alias("__all"),
    )
    return join_on(df, offsets, [*keys, "__bucket"], "left")


def ordered_counts(
    df: DataFrame, value: str, keys: Sequence[str] = (), group: Sequence[str] = (),
    layout: Layout | None = None, weight: str | None = None,
) -> DataFrame:
    """One row per (keys, group, value): `cnt` rows, and over the whole segment
    `tied` rows equal to the value, `upto` rows <= value, `total` rows.
    With `weight`, an input row stands for that many equal rows."""
    keys, group = list(keys), list(group)
    base = df.where(F.col(value).isNotNull()).select(*keys, *group, value, *([weight] if weight else []))
    layout = layout or plan_layout(base, value)
    counts = base.groupBy(*keys, *group, value).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("cnt"))
    if layout.single:
        part, before, everything = keys, F.lit(0), F.sum("cnt").over(Window.partitionBy(*keys))
    else:
        counts = spread(counts, value, keys, layout, "cnt")
        part, before = [*keys, "__bucket"], F.coalesce(F.col("__before"), F.lit(0))
        everything = F.col("__all")
        if keys:
            everything = F.coalesce(everything, F.sum("cnt").over(Window.partitionBy(*part)))
    running = Window.partitionBy(*part).orderBy(value).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    tied = F.sum("cnt").over(Window.partitionBy(*part, value)) if group else F.col("cnt")
    return counts.select(
        *keys, *group, value, "cnt",
        tied.alias("tied"),
        (before + F.sum("cnt").over(running)).alias("upto"),
        everything.alias("total"),
    )


def midrank() -> Column:
    """Tie-averaged rank of a value within its segment, from `ordered_counts` columns."""
    return F.col("upto") - (F.col("tied") - 1) / 2


def quantile_at(value: str, p: float) -> Column:
    """Aggregate over `ordered_counts` rows: the p-quantile by linear interpolation."""
    spot = (F.col("total") - 1) * F.lit(float(p))
    low, high = F.floor(spot), F.ceil(spot)

    def at(index: Column) -> Column:
        return F.max(F.when((F.col("upto") - F.col("tied") <= index) & (index < F.col("upto")), F.col(value)))

    return at(low) + (at(high) - at(low)) * F.max(spot - low)


def mode_of(value: str) -> Column:
    """Aggregate over `ordered_counts` rows: smallest most-frequent value."""
    return -F.max(F.struct(F.col("tied").alias("n"), (-F.col(value)).alias("v")))["v"]


def quantiles(df: DataFrame, value: str, probs: dict[str, float], keys: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles per segment; `probs` maps output names to probabilities."""
    counts = ordered_counts(df, value, keys)
    return counts.groupBy(*keys).agg(*[quantile_at(value, p).alias(name) for name, p in probs.items()])


def attach(
    left: DataFrame, right: DataFrame, keys: Sequence[str], layout: Layout, weight: str, columns: Sequence[str]
) -> DataFrame:
    """Left-join `columns` of `right`, which has one row per key tuple and in `weight` its number of left rows.

    A key tuple holding more than a thousandth of the laid-out rows is looked up in a broadcast (such tuples
    number 1000 per row kind at most); only the others are shuffled, so no hot key can fill one task.
    """
    keys = list(keys)
    if layout.single or not keys:
        return join_on(left, right.select(*keys, *columns), keys, "left")
    plain = right.select(*keys, *columns, (F.col(weight) * 1000 > layout.rows).alias("__hot"))
    hot, cold = F.broadcast(plain.where("__hot").drop("__hot")), plain.where(~F.col("__hot")).drop("__hot")
    served = join_on(left, hot, keys)
    rest = join_on(join_on(left, hot.select(*keys), keys, "left_anti"), cold, keys, "left")
    return served.select(*left.columns, *columns).unionByName(rest.select(*left.columns, *columns))
