"""Ordered series at scale: positions, differences, lags and lag products.

A series longer than one bucket is cut into chunks of consecutive positions. Each chunk also
receives the few rows before it (its halo), so lag windows run per chunk and no task ever holds
a whole long series. Lag products are inner products of a chunk with itself, shifted; the sums of
all chunks are added. Other sums over a series are partial aggregates.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from autostat.functions.columns import number, require_columns
from autostat.operators.order import Layout, Ties, attach, bucket_rows, plan_layout, spread

MAX_DIFFERENCES = 2
# Rows of a series one task may place or look back over: a row is held in several orders and four differences at once.
SERIES_ROWS = 100_000
# Lagged cells one task may look at.
LAG_CELLS = 50_000_000
# More lags than this are taken by fast Fourier transforms of blocks of so many rows.
DIRECT_LAGS, BLOCK = 256, 1 << 18


@dataclass
class Series:
    """Rows (keys, pos, values) with pos = 1..n inside each series, and the layout they were cut by."""

    frame: DataFrame
    keys: list[str]
    values: list[str]
    layout: Layout


def time_axis(df: DataFrame, time: str) -> Column:
    """The order column as a number: microseconds, days, or the number itself; NULL rows have no place."""
    kind = df.schema[time].dataType
    if isinstance(kind, T.DateType):
        return F.unix_date(time).cast("double")
    if isinstance(kind, T.NumericType):
        return number(df, time)
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(time).cast("double")
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(F.col(time).cast("timestamp")).cast("double")
    return F.unix_micros(F.try_to_timestamp(F.col(time).cast("string"))).cast("double")


def series_rows(df: DataFrame) -> int:
    """Rows of one bucket or chunk of a series (no more than the session's bucket)."""
    return min(bucket_rows(df), SERIES_ROWS)


def _tied_times(rows: DataFrame, value: str, layout: Layout) -> Ties | None:
    """Times that more rows share than one task should order (at most rows / limit of them), cut by `value`."""
    found = rows.groupBy("__t").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > layout.limit).select("__t").collect()
    points = tuple(sorted(r[0] for r in found))
    if not points:
        return None
    return Ties(points, value, plan_layout(rows.where(F.col("__t").isin(list(points))), value, limit=layout.limit))


def place(df: DataFrame, time: str, values: Sequence[str], keys: Sequence[str] = ()) -> Series:
    """Number the rows of each series by time (equal times by value); incomplete rows are left out."""
    keys, values = list(keys), list(values)
    require_columns(df, [*keys, time, *values])
    rows = df.select(*keys, time_axis(df, time).alias("__t"), *[number(df, c).alias(c) for c in values])
    rows = rows.dropna(how="any", subset=["__t", *values])
    layout = plan_layout(rows, "__t", limit=series_rows(rows))
    if layout.single:
        order = Window.partitionBy(*keys).orderBy("__t", *values)
        placed = rows.withColumn("pos", F.row_number().over(order).cast("long"))
    else:
        ties = _tied_times(rows, values[0], layout)
        by_time = layout.isolating(ties.points) if ties else layout
        cut = spread(rows.withColumn("__one", F.lit(1)), "__t", keys, by_time, "__one", ties)
        order = Window.partitionBy(*keys, "__bucket").orderBy("__t", *values)
        placed = cut.withColumn("pos", F.coalesce(F.col("__before"), F.lit(0)) + F.row_number().over(order))
    return Series(placed.select(*keys, "pos", *values), keys, values, layout)


def chunked(series: Series, halo: int) -> DataFrame:
    """Add `chunk` and `own`: rows near the end of a chunk are repeated, not own, in the next one."""
    # Long halos mean many lags per row: shorter chunks keep the work of one task bounded.
    size = max(halo, min(series_rows(series.frame), LAG_CELLS // (halo + 1)))
    frame = series.frame
    if series.layout.rows <= size:
        return frame.withColumns({"chunk": F.lit(0).cast("long"), "own": F.lit(True)})
    number_ = F.floor((F.col("pos") - 1) / size)
    near_end = (F.col("pos") - 1) % size >= size - halo
    here = F.struct(number_.alias("chunk"), F.lit(True).alias("own"))
    after = F.struct((number_ + 1).alias("chunk"), F.lit(False).alias("own"))
    copies = F.when(near_end, F.array(here, after)).otherwise(F.array(here))
    return frame.select("*", F.inline(copies))


def ordered_by(keys: Sequence[str], *more: str):
    return Window.partitionBy(*keys, *more, "chunk").orderBy("pos")


def differences(series: Series, column: str, degree: int = 1) -> DataFrame:
    """First difference applied `degree` times: (keys, pos, value)."""
    rows = chunked(series, degree)
    for _ in range(degree):
        rows = rows.withColumn(column, F.col(column) - F.lag(column).over(ordered_by(series.keys)))
    return rows.where(F.col("own") & F.col(column).isNotNull()).select(*series.keys, "pos", column)


def seasonal_difference(series: Series, column: str, gap: int) -> DataFrame:
    """Value minus the value `gap` places earlier."""
    rows = chunked(series, gap).withColumn(column, F.col(column) - F.lag(column, gap).over(ordered_by(series.keys)))
    return rows.where(F.col("own") & F.col(column).isNotNull()).select(*series.keys, "pos", column)


def differenced(series: Series, column: str, halo: int) -> DataFrame:
    """Long form (keys, d, chunk, pos, own, level, z): the series and its differences at once, up to one more than the
    tests look at, which gives the moments of the last one's steps.

    `pos` counts within the differenced series. One shuffle for all degrees.
    """
    order = ordered_by(series.keys)
    rows = chunked(series, halo + MAX_DIFFERENCES + 1).withColumnRenamed(column, "z0")
    rows = rows.withColumns({f"l{i}": F.lag("z0", i).over(order) for i in range(1, MAX_DIFFERENCES + 2)})
    l0, l1, l2, l3 = F.col("z0"), F.col("l1"), F.col("l2"), F.col("l3")
    rows = rows.select(
        *series.keys, "chunk", "pos", "own", "z0",
        (l0 - l1).alias("z1"), (l0 - 2 * l1 + l2).alias("z2"), (l0 - 3 * l1 + 3 * l2 - l3).alias("z3"),
    )
    degrees = [F.struct(F.lit(d).alias("d"), F.col(f"z{d}").alias("z")) for d in range(MAX_DIFFERENCES + 2)]
    level = F.col("z0").alias("level")
    long = rows.select(*series.keys, "chunk", "pos", "own", level, F.inline(F.array(*degrees))).where(F.col("z").isNotNull())
    return long.withColumn("pos", F.col("pos") - F.col("d"))


def centred(series: Series, column: str, halo: int) -> DataFrame:
    """`differenced` with n, the mean m and e = z - m attached."""
    long = differenced(series, column, halo)
    at = [*series.keys, "d"]
    means = long.where("own").groupBy(*at).agg(F.count(F.lit(1)).alias("n"), F.avg("z").alias("m"))
    return attach(long, means, at, series.layout, "n", ["n", "m"]).withColumn("e", F.col("z") - F.col("m"))


def shifted_products(own: np.ndarray, e: np.ndarray, most: int) -> np.ndarray:
    """Sums over t of own(t) e(t-h) for h = 0..most, as far as there are values."""
    most = min(most, len(e) - 1)
    if most <= DIRECT_LAGS:
        return np.array([own[h:] @ e[: len(e) - h] for h in range(most + 1)])
    out = np.zeros(most + 1)
    for a in range(0, len(e), BLOCK):
        lead = min(a, most)
        past, now = e[a - lead : a + BLOCK], own[a : a + BLOCK]
        size = 1 << (len(past) + len(now) - 1).bit_length()
        both = np.fft.irfft(np.fft.rfft(now, size) * np.conj(np.fft.rfft(past, size)), size)
        h = np.arange(min(most + 1, lead + len(now)))
        out[h] += both[(h - lead) % size]
    return out


def lag_products(rows: DataFrame, keys: Sequence[str], most: Column, widest: int) -> DataFrame:
    """(keys, d, products): products[h] = sum of e(t) e(t-h) for h = 0..most (per series, at most `widest`)."""
    at = [*keys, "d"]
    fields = T.StructType([*[rows.schema[c] for c in at], *T.StructType.fromDDL("h int, s double").fields])

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by("pos")
        e = part["e"].to_numpy()
        sums = shifted_products(np.where(part["own"].to_numpy(), e, 0.0), e, min(part["most"][0].as_py(), widest))
        keyed = [pa.array([part[c][0].as_py()] * len(sums), part.schema.field(c).type) for c in at]
        return pa.Table.from_arrays([*keyed, pa.array(np.arange(len(sums), dtype=np.int32)), pa.array(sums)], fields.fieldNames())

    chunks = rows.select(*at, "chunk", "pos", "own", "e", most.cast("long").alias("most")).groupBy(*at, "chunk")
    sums = chunks.applyInArrow(run, fields).groupBy(*at, "h").agg(F.sum("s").alias("s"))
    # At most widest + 1 sums per series.
    ordered = F.array_sort(F.collect_list(F.struct("h", "s")))
    return sums.groupBy(*at).agg(F.transform(ordered, lambda x: x["s"]).alias("products"))


def end_values(rows: DataFrame, keys: Sequence[str], count: Column) -> DataFrame:
    """(keys, d, n, m, head, tail): the first and last `count` centred values of each series, in order."""
    near = rows.where(F.col("own") & ((F.col("pos") <= count) | (F.col("pos") > F.col("n") - count)))
    pick = lambda side: F.transform(
        F.array_sort(F.collect_list(F.when(side, F.struct("pos", "e")))), lambda x: x["e"]
    )
    return near.groupBy(*keys, "d").agg(
        F.max("n").alias("n"), F.max("m").alias("m"),
        pick(F.col("pos") <= count).alias("head"), pick(F.col("pos") > F.col("n") - count).alias("tail"),
    )


def squared_partial_sums(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, d, walk): sum of the squared running sums of e.

    Running sums are taken per chunk; the earlier chunks' total O enters as n O^2 + 2 O sum(c) + sum(c^2).
    """
    at = [*keys, "d"]
    own = rows.where("own")
    c = F.sum("e").over(ordered_by(keys, "d").rowsBetween(Window.unboundedPreceding, 0))
    per_chunk = own.withColumn("c", c).groupBy(*at, "chunk").agg(
        F.count(F.lit(1)).alias("k"), F.sum("e").alias("total"), F.sum("c").alias("c1"), F.sum(F.col("c") * F.col("c")).alias("c2"),
    )
    earlier = Window.partitionBy(*at).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("total").over(earlier), F.lit(0.0))
    o = F.col("o")
    return per_chunk.withColumn("o", offset).groupBy(*at).agg(
        F.sum(F.col("k") * o * o + 2 * o * F.col("c1") + F.col("c2")).alias("walk")
    )
