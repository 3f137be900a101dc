"""One scan of moments per segment: means and the covariance matrix of a column list.

Correlation, regression, collinearity, mediation and reliability are all read off this one row.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from autostat.functions.columns import by_segment, number, numeric_frame, ratio


def gram(
    df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), extra: Sequence[Column] = ()
) -> DataFrame:
    """(keys, n, means, cov): cov is the upper triangle by rows; rows with a missing cell are left out.

    `extra` aggregates ride along in the same pass over the complete rows.
    """
    if extra:
        rows = df.withColumns({c: number(df, c) for c in columns})
    else:
        rows = numeric_frame(df, columns, keys)
    rows = rows.dropna(how="any", subset=list(columns))
    means = F.array(*[F.avg(c) for c in columns])
    cov = F.array(*[F.covar_samp(a, b) for i, a in enumerate(columns) for b in columns[i:]])
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__rows"), means.alias("means"), cov.alias("cov"), *extra)
    return out.withColumnRenamed("__rows", "n").where("n >= 2")


def cell(k: int, i: int, j: int) -> Column:
    """Covariance of columns i and j of a k-column `gram` row."""
    i, j = min(i, j), max(i, j)
    return F.col("cov")[i * k - i * (i - 1) // 2 + (j - i)]


def correlation_cell(k: int, i: int, j: int) -> Column:
    return ratio(cell(k, i, j), F.sqrt(cell(k, i, i) * cell(k, j, j)))


def matrix(cov: Sequence[float], k: int) -> np.ndarray:
    """Symmetric k x k matrix from the upper triangle."""
    out = np.zeros((k, k))
    out[np.triu_indices(k)] = cov
    return out + np.triu(out, 1).T


@by_segment
def correlation_matrix(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Long form (row, col, r) of the Pearson matrix."""
    k = len(columns)
    cells = [
        F.struct(
            F.lit(a).alias("row"), F.lit(b).alias("col"),
            (F.lit(1.0) if i == j else correlation_cell(k, i, j)).alias("r"),
        )
        for i, a in enumerate(columns) for j, b in enumerate(columns)
    ]
    return gram(df, columns, keys).select(*keys, F.inline(F.array(*cells)))
