"""Data-set profile: row counts, column types, time structure."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from autostat.functions.columns import number

MIN_ROWS = 5
# Words that mark a time column, and the share of cells that must parse.
TIME_WORDS = ("date", "time", "year", "month", "day", "tanggal", "tahun", "bulan", "hari", "timestamp")
TIME_SHARE = 0.8


def column_type(kind: T.DataType) -> str:
    """Two logical types: numbers (booleans are labels, not numbers) and everything else."""
    return "numerical" if isinstance(kind, T.NumericType) else "categorical"


def is_time_type(kind: T.DataType) -> bool:
    return isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType))


def has_time_name(name: str, substring: bool = False) -> bool:
    """A time word among the name's parts (`order_date`, `o_orderdate`), or anywhere with `substring`."""
    low = name.lower()
    if substring:
        return any(w in low for w in TIME_WORDS)
    parts = [p for p in re.split(r"[^a-z]+", low) if p]
    return any(p == w or (p.endswith(w) and w in ("date", "timestamp")) for p in parts for w in TIME_WORDS)


def reads_as_time(df: DataFrame, name: str) -> Column:
    """True where the cell is a date: typed, parseable text, or a number that can be a year."""
    kind = df.schema[name].dataType
    if is_time_type(kind):
        return F.col(name).isNotNull()
    if isinstance(kind, T.NumericType):
        year = number(df, name)
        return F.coalesce(year.between(1000, 3000) & (year == F.floor(year)), F.lit(False))
    if isinstance(kind, T.StringType):
        return F.try_to_timestamp(F.col(name)).isNotNull()
    return F.lit(False)


def detect_structure(
    df: DataFrame, columns: Sequence[str] | None = None, substring: bool = False
) -> tuple[str, str | None]:
    """('time_series', column) or ('cross_sectional', None), from at most one aggregate job."""
    names = list(columns or df.columns)
    named = [c for c in names if has_time_name(c, substring)]
    if named:
        shares = df.select(*[F.avg(reads_as_time(df, c).cast("double")).alias(f"s{i}") for i, c in enumerate(named)]).first()
        for i, c in enumerate(named):
            if (shares[i] or 0.0) > TIME_SHARE:
                return "time_series", c
    typed = [c for c in names if is_time_type(df.schema[c].dataType)]
    return ("time_series", typed[0]) if typed else ("cross_sectional", None)


def profile(df: DataFrame, substring: bool = False) -> DataFrame:
    """One row per column: position, logical type, rows, missing cells, share of dates. One scan."""
    stats = []
    for i, c in enumerate(df.columns):
        missing = F.col(c).isNull()
        if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
            missing = missing | F.isnan(c)
        candidate = has_time_name(c, substring) or is_time_type(df.schema[c].dataType)
        share = F.avg(reads_as_time(df, c).cast("double")) if candidate else F.lit(0.0)
        stats.append(
            F.struct(
                F.lit(i).alias("position"),
                F.lit(c).alias("column"),
                F.lit(column_type(df.schema[c].dataType)).alias("type"),
                F.count(F.lit(1)).alias("n_rows"),
                F.count_if(missing).alias("n_null"),
                (share > TIME_SHARE).alias("is_time"),
            )
        )
    return df.agg(F.array(*stats).alias("c")).select(F.inline("c"))


def enough_rows(df: DataFrame, least: int = MIN_ROWS) -> bool:
    """Reads no more than `least` rows."""
    return df.limit(least).count() >= least
