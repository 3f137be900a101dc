"""Cleaning rules: type conversion, missing values, outliers.

Every decision is an aggregate of one or all columns; the frame itself is only
narrowed by literals, so the filters reach the scan and nothing is persisted.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from autostat.functions.columns import is_numeric, melt, number, require_columns
from autostat.operators.order import ordered_counts, plan_layout, quantile_at

# Share of unreadable cells that keeps a column text, share of missing cells
# below which rows are dropped, and the fence of the outlier rule.
TEXT_SHARE = 0.2
DROP_PERCENT = 5.0
FENCE = 1.5

LOG_SCHEMA = (
    "step string, column string, action string, n_rows long, percent double, "
    "lower double, upper double, imputed_value string"
)


@dataclass
class Cleaned:
    """A cleaned frame and what was done to it. `late` holds log rows that cost a job, run when the log is read."""

    frame: DataFrame
    types: dict[str, str]
    log: list[Row] = field(default_factory=list)
    late: DataFrame | None = None
    # Rows of the input, an upper bound for everything derived from it.
    rows: int | None = None
    missing: list[Row] | None = None

    def log_frame(self) -> DataFrame:
        known = self.frame.sparkSession.createDataFrame(self.log, LOG_SCHEMA)
        return known if self.late is None else known.unionByName(self.late)


def log_row(step, column, action, n_rows=None, percent=None, lower=None, upper=None, imputed_value=None) -> Row:
    return Row(
        step=step, column=column, action=action, n_rows=n_rows, percent=percent, lower=lower, upper=upper,
        imputed_value=imputed_value,
    )


def convert_types(df: DataFrame, columns: Sequence[str], keep_typed: Sequence[str] = ()) -> Cleaned:
    """Text columns losing fewer than 20 % of all rows become DOUBLE; other columns become text.

    Columns in `keep_typed` (time columns) are left as they are.
    """
    require_columns(df, columns)
    text = {c for c in columns if isinstance(df.schema[c].dataType, T.StringType) and c not in keep_typed}
    # One scan: for every column the missing cells if read as a number, and if kept as it is.
    counts = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(columns):
        as_is = F.col(c).isNull() | (F.col(c) == "nan") if c in text else F.col(c).isNull()
        counts += [
            F.count_if(number(df, c).isNull() if c in text or is_numeric(df, c) else F.lit(False)).alias(f"number{i}"),
            F.count_if(as_is).alias(f"plain{i}"),
        ]
    seen = df.select(*counts).first()
    n, types, log, cast, missing = seen["n"], {}, [], {}, []
    for i, c in enumerate(columns):
        as_number, plain = seen[f"number{i}"], seen[f"plain{i}"]
        if c in keep_typed:
            types[c], gone = "time", plain
        elif is_numeric(df, c):
            types[c], gone = "numerical", as_number
            cast[c] = number(df, c)
        elif c in text and as_number - plain < TEXT_SHARE * n:
            types[c], gone = "numerical", as_number
            cast[c] = number(df, c)
            log.append(log_row("types", c, "converted to number", 0))
        else:
            types[c], gone = "categorical", plain
            cast[c] = F.nullif(F.col(c).cast("string"), F.lit("nan"))
        missing.append(missing_row(c, gone, n))
    return Cleaned(df.withColumns(cast) if cast else df, types, log, None, n, missing)


def missing_row(column: str, n_missing: int, n: int) -> Row:
    share = 100.0 * n_missing / n if n else 0.0
    rule = "none" if n_missing == 0 else "drop" if share < DROP_PERCENT else "impute"
    return Row(column=column, n_missing=n_missing, percent=round(share, 2), strategy=rule)


def missing_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing cells per column, share in percent and the rule that applies. One scan."""
    rows = []
    for i, c in enumerate(columns):
        n = F.count_if(F.col(c).isNull())
        share = F.try_divide(n * F.lit(100.0), F.count(F.lit(1)))
        rule = F.when(n == 0, "none").when(share < DROP_PERCENT, "drop").otherwise("impute")
        rows.append(
            F.struct(
                F.lit(i).alias("position"), F.lit(c).alias("column"), n.alias("n_missing"),
                F.round(share, 2).alias("percent"), rule.alias("strategy"),
            )
        )
    return df.agg(F.array(*rows).alias("c")).select(F.inline("c"))


def drop_sparse_missing(df: DataFrame, columns: Sequence[str], report: Sequence[Row] | None = None) -> DataFrame:
    """Drop the rows with a missing cell in a column that misses fewer than 5 %."""
    report = missing_report(df, columns).collect() if report is None else report
    few = [r["column"] for r in report if r["strategy"] == "drop"]
    return df.dropna(subset=few) if few else df


def median_values(df: DataFrame, columns: Sequence[str], at_most: int | None = None) -> dict[str, float]:
    """Medians of several columns in one job; a column without a number has none."""
    long = melt(df, columns)
    layout = plan_layout(long, "value", at_most and at_most * len(columns))
    ordered = ordered_counts(long, "value", ["column"], (), layout)
    return dict(ordered.groupBy("column").agg(quantile_at("value", 0.5)).collect())


def mean_values(df: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Means of several columns in one job; a column without a number has none."""
    row = df.select(*[F.avg(number(df, c)).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    return {c: row[i] for i, c in enumerate(columns) if row[i] is not None}


def mode_value(df: DataFrame, column: str) -> str | None:
    """Smallest most-frequent label: counts are combined per task, then one best row is kept."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    row = counts.orderBy(F.col("n").desc(), F.col(column)).select(column).first()
    return row[0] if row else None


def fill_missing(
    df: DataFrame, columns: Sequence[str], types: dict[str, str], report: Sequence[Row] | None = None,
    at_most: int | None = None, centre: str = "median",
) -> Cleaned:
    """Rows are dropped first, then columns missing 5 % or more are filled: `centre` (median or mean) or mode."""
    if centre not in ("median", "mean"):
        raise ValueError(f"unknown centre '{centre}'; use median or mean")
    report = missing_report(df, columns).collect() if report is None else report
    log = []
    kept = drop_sparse_missing(df, columns, report)
    for r in report:
        if r["strategy"] == "drop":
            log.append(log_row("missing", r["column"], "drop", r["n_missing"], r["percent"]))
    many = {r["column"]: r["percent"] for r in report if r["strategy"] == "impute"}
    fills: dict[str, object] = {}
    if many:
        left = kept.select(*[F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(many)]).first()
        open_ = [c for i, c in enumerate(many) if left[i]]
        numeric = [c for c in open_ if types[c] == "numerical"]
        centres = {}
        if numeric:
            centres = median_values(kept, numeric, at_most) if centre == "median" else mean_values(kept, numeric)
        source = kept
        for i, (c, percent) in enumerate(many.items()):
            if types[c] == "time":
                kept = kept.dropna(subset=[c])
                log.append(log_row("missing", c, "drop", left[i], percent))
                continue
            if c in numeric:
                fills[c] = centres.get(c, 0.0)
            elif c in open_:
                found = mode_value(source, c)
                fills[c] = "Unknown" if found is None else found
            log.append(log_row("missing", c, "impute", left[i], percent, imputed_value=str(fills[c]) if c in fills else None))
    return Cleaned(kept.fillna(fills) if fills else kept, types, log)


def drop_duplicates(df: DataFrame, columns: Sequence[str] = (), keep_by: Sequence[str] = ()) -> Cleaned:
    """One row of each that agree in `columns` (in all columns if none are given; missing cells are equal).

    The row with the smallest `keep_by` stays, then the smallest in the other columns, so the result does not depend on
    the order of the input. Repeated rows are combined before they are shuffled."""
    require_columns(df, [*columns, *keep_by])
    if not columns:
        kept = df.distinct()
    else:
        rest = [c for c in df.columns if c not in columns]
        order = [*keep_by, *[c for c in rest if c not in keep_by]]
        best = F.min(F.struct(*[F.col(c).alias(f"v{i}") for i, c in enumerate(order)])) if rest else F.count(F.lit(1))
        one = df.groupBy(*columns).agg(best.alias("__best"))
        picked = {c: F.col(f"__best.v{order.index(c)}").alias(c) for c in rest}
        kept = one.select(*[picked.get(c, F.col(c)) for c in df.columns])
    both = df.agg(F.count(F.lit(1)).alias("n")).join(kept.agg(F.count(F.lit(1)).alias("k")))
    none = F.lit(None).cast("double")
    late = both.select(
        F.lit("duplicates").alias("step"), F.lit(", ".join(columns) or "all columns").alias("column"),
        F.when(F.col("n") > F.col("k"), "drop").otherwise("none").alias("action"), (F.col("n") - F.col("k")).alias("n_rows"),
        F.round(F.try_divide(100.0 * (F.col("n") - F.col("k")), F.col("n")), 2).alias("percent"), none.alias("lower"),
        none.alias("upper"), F.lit(None).cast("string").alias("imputed_value"),
    )
    return Cleaned(kept, {}, [], late)


def iqr_bounds(df: DataFrame, column: str, at_most: int | None = None) -> tuple[float, float] | None:
    """Fences of one column, None when fewer than 4 rows."""
    values = df.select(F.col(column).alias("__y"))
    row = (
        ordered_counts(values, "__y", layout=plan_layout(values, "__y", at_most))
        .agg(quantile_at("__y", 0.25).alias("q1"), quantile_at("__y", 0.75).alias("q3"), F.max("total").alias("n"))
        .first()
    )
    if row is None or row["n"] is None or row["n"] < 4:
        return None
    width = row["q3"] - row["q1"]
    return row["q1"] - FENCE * width, row["q3"] + FENCE * width


def iqr_filter(
    df: DataFrame, columns: Sequence[str], simultaneous: bool = False, at_most: int | None = None
) -> Cleaned:
    """Keep rows inside the fences. Columns are taken in order, each on the rows left by the
    earlier ones; `simultaneous` takes every fence from the unfiltered rows instead."""
    kept, bounds = df, {}
    for c in columns:
        limits = iqr_bounds(df if simultaneous else kept, c, at_most)
        if limits:
            bounds[c] = limits
            inside = F.col(c).between(*[F.lit(v) for v in limits])
            kept = kept.where(inside | F.col(c).isNull()) if df.schema[c].nullable else kept.where(inside)
    return Cleaned(kept, {c: "numerical" for c in columns}, [], _outlier_log(df, bounds) if bounds else None)


def _outlier_log(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Rows removed at each step, counted in one scan of the unfiltered frame."""
    alive, rows = F.lit(True), []
    for c, (low, high) in bounds.items():
        out = F.coalesce((F.col(c) < low) | (F.col(c) > high), F.lit(False))
        n = F.count_if(alive & out)
        alive = alive & ~out
        rows.append(
            F.struct(
                F.lit("outliers").alias("step"), F.lit(c).alias("column"),
                F.when(n > 0, "filter").otherwise("none").alias("action"), n.alias("n_rows"),
                F.lit(None).cast("double").alias("percent"), F.when(n > 0, round(low, 4)).alias("lower"),
                F.when(n > 0, round(high, 4)).alias("upper"), F.lit(None).cast("string").alias("imputed_value"),
            )
        )
    return df.agg(F.array(*rows).alias("r")).select(F.inline("r"))


def clean(
    df: DataFrame,
    columns: Sequence[str],
    keep_typed: Sequence[str] = (),
    never_filter: Sequence[str] = (),
    filter_outliers: bool = True,
    carry: Sequence[str] = (),
) -> Cleaned:
    """Types, then missing values, then outliers; the log lists every action in order.

    `carry` columns (segment and subject keys) are kept as they are.
    """
    typed = convert_types(df.select(*columns, *carry), columns, keep_typed)
    n = typed.rows
    filled = fill_missing(typed.frame, columns, typed.types, typed.missing, n)
    numeric = [c for c in columns if typed.types[c] == "numerical" and c not in never_filter]
    log = typed.log + filled.log
    if not (filter_outliers and numeric):
        return Cleaned(filled.frame, typed.types, log, None, n)
    within = iqr_filter(filled.frame, numeric, at_most=n)
    return Cleaned(within.frame, typed.types, log, within.late, n)
