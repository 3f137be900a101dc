"""Simple exponential smoothing of many or very long series by a prefix scan.

The level after a value y is s -> (1 - alpha) s + alpha y, an affine map of the level before. A chunk of a series is the
composition of its values' maps, again s -> a s + b, and the sum of its squared one-step errors is a quadratic
p - 2 q s + r s^2 of the level it starts from. So one pass reduces every chunk to five numbers for every alpha, the few
chunks of a series are composed in order, and a second pass applies the starting levels. Results do not depend on the
chunks. The first level is the first value.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from autostat.functions.columns import join_on
from autostat.operators.series import Series, chunked
from autostat.sources.checkpoints import cut_lineage

ALPHAS = tuple(round(0.05 * i, 2) for i in range(1, 20))
STEPS = 5


def levels_from_zero(y: np.ndarray, alpha: float) -> np.ndarray:
    """Levels after each value when the level before the first is 0, by doubling the reach of the sums."""
    out, reach, keep = alpha * y, 1, 1.0 - alpha
    while reach < len(y) and keep > 0:
        out[reach:] += keep * out[:-reach]
        reach, keep = 2 * reach, keep * keep
    return out


def decay(n: int, alpha: float) -> np.ndarray:
    """What is left of the starting level after 0 .. n values."""
    return (1.0 - alpha) ** np.arange(n + 1, dtype=float)


def _chunks(series: Series, column: str) -> DataFrame:
    return chunked(series, 0).select(*series.keys, "chunk", "pos", F.col(column).alias("y"))


def _reduced(chunks: DataFrame, keys: Sequence[str], alphas: Sequence[float]) -> DataFrame:
    """(keys, chunk, alpha, n, first, a, b, p, q, r) of every chunk."""
    names = "alpha double, n long, first double, a double, b double, p double, q double, r double"
    fields = T.StructType([*[chunks.schema[k] for k in [*keys, "chunk"]], *T.StructType.fromDDL(names).fields])

    def run(part: pa.Table) -> pa.Table:
        y = part.sort_by("pos")["y"].to_numpy()
        rows = []
        for alpha in alphas:
            level, left = levels_from_zero(y.copy(), alpha), decay(len(y), alpha)
            error = y - np.r_[0.0, level[:-1]]
            rows.append((alpha, len(y), y[0], left[-1], level[-1], error @ error, error @ left[:-1], left[:-1] @ left[:-1]))
        keyed = [pa.array([part[k][0].as_py()] * len(rows), part.schema.field(k).type) for k in [*keys, "chunk"]]
        values = [pa.array(c) for c in zip(*rows, strict=True)]
        return pa.Table.from_arrays([*keyed, *values], fields.fieldNames())

    return chunks.groupBy(*keys, "chunk").applyInArrow(run, fields)


def _composed(reduced: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, alpha, n, sse, level, starts): chunks composed in order; `starts` are the levels chunks begin from."""
    names = "alpha double, n long, sse double, level double, starts array<double>"
    fields = T.StructType([*[reduced.schema[k] for k in keys], *T.StructType.fromDDL(names).fields])

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by("chunk")
        first, a, b, p, q, r = (part[c].to_numpy() for c in ("first", "a", "b", "p", "q", "r"))
        s, starts, sse = first[0], [], 0.0
        for i in range(len(a)):
            starts.append(s)
            sse += p[i] - 2 * q[i] * s + r[i] * s * s
            s = a[i] * s + b[i]
        keyed = [pa.array([part[k][0].as_py()], part.schema.field(k).type) for k in [*keys, "alpha"]]
        values = [pa.array([int(part["n"].to_numpy().sum())]), pa.array([sse]), pa.array([s]), pa.array([starts], pa.list_(pa.float64()))]
        return pa.Table.from_arrays([*keyed, *values], fields.fieldNames())

    return reduced.groupBy(*keys, "alpha").applyInArrow(run, fields)


def smoothing_fits(series: Series, column: str, alphas: Sequence[float] = ALPHAS) -> DataFrame:
    """(keys, alpha, n, sse, level, starts, best) for every alpha; the smallest squared error is `best` (ties: the smaller
    alpha). `level` is the last one, and so the forecast of every later value."""
    keys = series.keys
    fits = cut_lineage(_composed(_reduced(_chunks(series, column), keys, alphas), keys))
    least = fits.groupBy(*keys).agg(F.min(F.struct("sse", "alpha"))["alpha"].alias("__alpha"))
    return join_on(fits, least, keys).withColumn("best", F.col("alpha") == F.col("__alpha")).drop("__alpha")


def smoothed(series: Series, column: str, fits: DataFrame) -> DataFrame:
    """(keys, pos, value, expected, level): each value with its one-step forecast and the level after it, at the best alpha."""
    keys = series.keys
    chunks = _chunks(series, column)
    chosen = fits.where("best").select(*keys, "alpha", F.posexplode("starts").alias("chunk", "start"))
    chosen = chosen.withColumn("chunk", F.col("chunk").cast("long"))
    names = "pos long, value double, expected double, level double"
    fields = T.StructType([*[chunks.schema[k] for k in keys], *T.StructType.fromDDL(names).fields])

    def run(values: pa.Table, start: pa.Table) -> pa.Table:
        values = values.sort_by("pos")
        y, alpha, s = values["y"].to_numpy(), start["alpha"][0].as_py(), start["start"][0].as_py()
        level = levels_from_zero(y.copy(), alpha) + decay(len(y), alpha)[1:] * s
        columns = [*[values[k] for k in keys], values["pos"], values["y"], pa.array(np.r_[s, level[:-1]]), pa.array(level)]
        return pa.Table.from_arrays(columns, fields.fieldNames())

    at = [*keys, "chunk"]
    return chunks.groupBy(*at).cogroup(chosen.groupBy(*at)).applyInArrow(run, fields)


def smoothing_forecast(fits: DataFrame, keys: Sequence[str] = (), steps: int = STEPS) -> DataFrame:
    """(keys, step, value): the last level, `steps` times."""
    best = fits.where("best")
    return best.select(*keys, F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("step"), F.col("level").alias("value"))
