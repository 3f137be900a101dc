"""Linear regression with elimination of collinear predictors, per segment.

The data are read once for the moment matrix; elimination rounds and the fit
work on sub-matrices of that one row per segment, in tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from autostat.functions.columns import by_segment, direction
from autostat.functions.tails import f_upper, t_two_sided
from autostat.operators.gram import gram, matrix

VIF_LIMIT = 10.0
# Fixed value: inflation reported for a predictor that the others determine exactly.
VIF_PERFECT = 999.0
_SINGULAR = 1e-12

FIT_FIELDS = (
    "term string, position int, coefficient double, std_err double, t double, p_value double, "
    "n long, r_squared double, adj_r_squared double, f_statistic double, f_p_value double, n_predictors int"
)
VIF_FIELDS = "round int, variable string, vif double, eliminated boolean"


def inflation(cov: np.ndarray, active: Sequence[int]) -> np.ndarray:
    """Variance inflation of each active predictor (diagonal of the inverse correlation matrix)."""
    sub = cov[np.ix_(active, active)]
    sd = np.sqrt(np.diag(sub))
    corr = sub / np.outer(sd, sd)
    values, vectors = np.linalg.eigh(corr)
    if values[0] > _SINGULAR:
        return (vectors**2 / values).sum(axis=1)
    # Predictors that take part in an exact dependency get the fixed value.
    bound = (vectors[:, values <= _SINGULAR] ** 2).sum(axis=1) > _SINGULAR
    kept = values > _SINGULAR
    return np.where(bound, VIF_PERFECT, (vectors[:, kept] ** 2 / values[kept]).sum(axis=1))


def eliminate(cov: np.ndarray, limit: float) -> tuple[list[int], list[tuple[int, int, float, bool]]]:
    """Predictors kept (column 0 is the outcome) and the log (round, column, vif, eliminated).

    A constant predictor goes first (round 0, no vif)."""
    active = [i for i in range(1, len(cov)) if cov[i, i] > 0]
    log = [(0, i, np.nan, True) for i in range(1, len(cov)) if not cov[i, i] > 0]
    step = 1
    while len(active) > 1:
        vif = inflation(cov, active)
        worst = int(np.argmax(vif)) if vif.max() > limit else -1
        log += [(step, c, float(v), at == worst) for at, (c, v) in enumerate(zip(active, vif, strict=True))]
        if worst < 0:
            break
        active.pop(worst)
        step += 1
    return active, log


def _inverse(sub: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Inverse of a covariance matrix, generalised where predictors depend on each other, and the dependencies (columns)."""
    sd = np.sqrt(np.diag(sub))
    values, vectors = np.linalg.eigh(sub / np.outer(sd, sd))
    kept = values > _SINGULAR
    if kept.all():
        return np.linalg.inv(sub), np.empty((len(sub), 0))
    scaled = vectors[:, kept] / sd[:, None]
    return (scaled / values[kept]) @ scaled.T, vectors[:, ~kept] / sd[:, None]


def _fit_rows(n: int, means: np.ndarray, cov: np.ndarray, active: list[int], names: Sequence[str]) -> list[tuple]:
    """Least squares; of the many solutions with dependent predictors the one with the smallest coefficients."""
    inverse, dependent = _inverse(cov[np.ix_(active, active)])
    slope = inverse @ cov[active, 0]
    rank = len(active) - dependent.shape[1]
    total = cov[0, 0] * (n - 1)
    explained = float(slope @ cov[active, 0]) * (n - 1)
    dof = n - rank - 1
    residual = max(total - explained, 0.0)
    error = residual / dof if dof > 0 else np.nan
    center = means[active]
    coefficient = np.append(means[0] - slope @ center, slope)
    scatter = inverse / (n - 1)
    toward = scatter @ center
    spread = np.block([[np.array([[1.0 / n + center @ toward]]), -toward[None, :]], [-toward[:, None], scatter]])
    if dependent.size:
        # Directions (constant first) that change no fitted value are projected out.
        free, _ = np.linalg.qr(np.vstack([-center @ dependent, dependent]))
        onto = np.eye(len(coefficient)) - free @ free.T
        coefficient, spread = onto @ coefficient, onto @ spread @ onto
    with np.errstate(divide="ignore", invalid="ignore"):
        se = np.sqrt(error * np.diag(spread))
        t = coefficient / se
        f = (explained / rank) / error
    finite = np.isfinite(t) & (dof > 0)
    p = np.where(finite, t_two_sided(np.where(finite, t, 0.0), max(dof, 1)), np.nan)
    f_p = float(f_upper(f, rank, dof)[0]) if dof > 0 and np.isfinite(f) else 0.0
    r2 = 1 - residual / total if total > 0 else np.nan
    adjusted = 1 - (1 - r2) * (n - 1) / dof if dof > 0 else np.nan
    terms = ["const", *[names[i] for i in active]]
    return [
        (terms[i], i, coefficient[i], se[i], t[i], p[i], n, r2, adjusted, f, f_p, rank) for i in range(len(terms))
    ]


def _per_segment(base: DataFrame, keys: Sequence[str], fields: str, columns: Sequence[str], rows_of) -> DataFrame:
    """Narrow map over the moment rows; `rows_of(n, means, cov)` gives the output rows of one segment."""
    key_fields = [base.schema[k] for k in keys]
    schema = T.StructType([*key_fields, *T.StructType.fromDDL(fields).fields])
    k, names, keys = len(columns), schema.fieldNames(), list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                found = rows_of(int(row.n), np.asarray(row.means, dtype=float), matrix(row.cov, k))
                out += [(*row[: len(keys)], *r) for r in found]
            yield pd.DataFrame(out, columns=names)

    return base.select(*keys, "n", "means", "cov").mapInPandas(run, schema)


@by_segment
def regression(
    df: DataFrame, y: str, xs: Sequence[str], keys: Sequence[str] = (),
    alpha: float = 0.05, vif_limit: float | None = VIF_LIMIT,
) -> DataFrame:
    """Coefficient table of Y on the predictors that survive the VIF rule (None: keep all), with the fit repeated."""
    known = [x for x in dict.fromkeys(xs) if x in df.columns and x != y]
    if not known:
        raise ValueError("no valid predictor")
    columns = [y, *known]

    def rows_of(n, means, cov):
        limit = np.inf if vif_limit is None else vif_limit
        active = eliminate(cov, limit)[0]
        return _fit_rows(n, means, cov, active, columns) if active and n > len(active) + 1 else []

    table = _per_segment(gram(df, columns, keys), keys, FIT_FIELDS, columns, rows_of)
    significant = F.col("p_value") < alpha
    return table.withColumns(
        {
            "is_significant": F.coalesce(significant, F.lit(False)),
            "direction": F.when(F.col("term") != "const", direction(F.col("coefficient"))),
            "model": F.when(F.col("n_predictors") == 1, "Simple Linear Regression").otherwise("Multiple Linear Regression"),
            "is_model_significant": F.col("f_p_value") < alpha,
            "explained_pct": F.col("r_squared") * 100,
        }
    )


COEFFICIENT_COLUMNS = ["term", "position", "coefficient", "std_err", "t", "p_value", "is_significant", "direction"]


def coefficients(table: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return table.select(*keys, *COEFFICIENT_COLUMNS)


def fit_summary(table: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return table.where(F.col("term") == "const").select(
        *keys, "model", "n", "n_predictors", "r_squared", "adj_r_squared", "f_statistic", F.col("f_p_value").alias("p_value"),
        F.col("is_model_significant").alias("is_significant"), "explained_pct",
    )


@by_segment
def vif_log(
    df: DataFrame, y: str, xs: Sequence[str], keys: Sequence[str] = (), vif_limit: float = VIF_LIMIT
) -> DataFrame:
    """Inflation of every predictor in every elimination round."""
    known = [x for x in dict.fromkeys(xs) if x in df.columns and x != y]
    columns = [y, *known]

    def rows_of(n, means, cov):
        return [(step, columns[c], v, bool(gone)) for step, c, v, gone in eliminate(cov, vif_limit)[1]]

    return _per_segment(gram(df, columns, keys), keys, VIF_FIELDS, columns, rows_of)
