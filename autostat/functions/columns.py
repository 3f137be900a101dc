"""Small Column helpers: numeric coercion, guarded arithmetic, segment keys, labels."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Sequence
from functools import reduce, wraps

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Text cells read as missing (the usual CSV markers).
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def require_columns(df: DataFrame, names: Sequence[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"column(s) not found: {', '.join(missing)}")


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.NumericType)


def number(df: DataFrame, name: str) -> Column:
    """`name` as DOUBLE; text that is no number and NaN both become NULL."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        value = F.col(name).cast("double")
    else:
        value = F.col(name).cast("string").try_cast("double")
    return F.when(~F.isnan(value), value)


def numeric_frame(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Project to `keep` plus `columns` coerced to DOUBLE."""
    require_columns(df, [*keep, *columns])
    return df.select(*keep, *[number(df, c).alias(c) for c in columns])


def melt(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = (), name: str = "column") -> DataFrame:
    """Long form (keep, name, value): one scan serves every column."""
    wide = numeric_frame(df, columns, keep)
    return wide.unpivot(list(keep), list(columns), name, "value").where(F.col("value").isNotNull())


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL when b is zero (plain division fails in ANSI mode)."""
    return F.try_divide(a, b)


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Null-safe equi-join on `keys`; with no keys `right` holds one row and is attached to all rows."""
    if not keys:
        return left.join(F.broadcast(right), how=how, on=F.lit(True))
    renamed = right.select(*[F.col(c).alias(f"__{c}") if c in keys else F.col(c) for c in right.columns])
    on = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"__{k}"]) for k in keys])
    return left.join(renamed, on, how).drop(*[f"__{k}" for k in keys])


def restore_keys(out: DataFrame, names: dict[str, str]) -> DataFrame:
    """Give renamed segment keys (`names`: original -> internal) their names back."""
    taken = [k for k in names if k in out.columns]
    if taken:
        raise ValueError(f"segment column(s) named like a result column, rename first: {', '.join(taken)}")
    return out.withColumnsRenamed({v: k for k, v in names.items()})


def own_keys(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, dict[str, str]]:
    """Copy segment keys to internal names, so that no key can meet a working column of the same name."""
    names = {k: f"__seg_{k}" for k in keys if not k.startswith("__seg_")}
    return (df.withColumns({v: F.col(k) for k, v in names.items()}) if names else df), names


def by_segment(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Run an operator on internally named segment keys."""
    signature = inspect.signature(fn)

    @wraps(fn)
    def run(*args, **kwargs):
        bound = signature.bind(*args, **kwargs)
        bound.apply_defaults()
        first, keys = next(iter(bound.arguments)), list(bound.arguments["keys"])
        require_columns(bound.arguments[first], keys)
        bound.arguments[first], names = own_keys(bound.arguments[first], keys)
        bound.arguments["keys"] = [names.get(k, k) for k in keys]
        return restore_keys(fn(*bound.args, **bound.kwargs), names)

    return run


def strength(r: Column) -> Column:
    # Cut points of the strength labels. Rounding makes the label of a value on a cut point
    # independent of the order in which partial sums were added.
    size = F.round(F.abs(r), 12)
    return (
        F.when(size < 0.2, "very weak").when(size < 0.4, "weak").when(size < 0.6, "moderate")
        .when(size < 0.8, "strong").otherwise("very strong")
    )


def direction(coefficient: Column) -> Column:
    return F.when(coefficient > 0, "positive").otherwise("negative")


def decision(significant: Column) -> Column:
    return F.when(significant.isNull(), F.lit(None)).when(significant, "H1 accepted").otherwise("H0 retained")
