"""The whole analysis of one table: clean, describe, check, test; every result a tidy table."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import cache as cached
from functools import partial

from pyspark.sql import DataFrame

from autostat.operators import cleaning
from autostat.operators.describe import describe
from autostat.operators.gram import correlation_matrix
from autostat.operators.instrument import instrument
from autostat.operators.mediate import mediation, mediation_paths
from autostat.operators.normality import normality
from autostat.operators.plotdata import box_stats, trend_line
from autostat.operators.profile import MIN_ROWS, enough_rows
from autostat.operators.regress import coefficients, fit_summary, regression, vif_log
from autostat.operators.timeseries import SERIES_TABLES, analyze_series
from autostat.plans.routing import Comparison, auto_test, correlation
from autostat.plans.spec import AnalysisSpec
from autostat.sources.checkpoints import cut_lineage


def prepare(df: DataFrame, spec: AnalysisSpec) -> cleaning.Cleaned:
    """Cleaned target columns. Cleaning decisions are taken once for the whole table.

    Group and time columns are never outlier-filtered, and a time series keeps all its rows,
    unless `strict_reference` asks for the literal rules.
    """
    columns = spec.target_columns()
    timed = [spec.time_col] if spec.time_col else []
    labels = [spec.group] if spec.group else []
    carry = [*spec.keys, *([spec.pair_key] if spec.paired and spec.pair_key else [])]
    never = [] if spec.strict_reference else [*timed, *labels]
    outliers = spec.filter_outliers and (spec.strict_reference or not timed)
    return cleaning.clean(df, columns, timed, never, outliers, [c for c in carry if c not in columns])


class Tables(Mapping):
    """Named result tables, each planned when it is first asked for."""

    def __init__(self, makers: dict[str, Callable[[], DataFrame]]):
        self._makers, self._made = makers, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._makers[name]()
        return self._made[name]

    def __iter__(self):
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)


def analyze(df: DataFrame, spec: AnalysisSpec) -> Mapping[str, DataFrame]:
    """Run an analysis. Cleaning decisions are taken here; every result table is planned on first use."""
    spec = spec.resolve(df)
    if not enough_rows(df):
        raise ValueError(f"at least {MIN_ROWS} rows are needed")
    cleaned = prepare(df, spec)
    rows, n, keys = cleaned.frame, cleaned.rows, list(spec.keys)
    if not enough_rows(rows):
        raise ValueError(f"fewer than {MIN_ROWS} rows are left after cleaning")
    out: dict[str, Callable[[], DataFrame]] = {"cleaning_log": cleaned.log_frame}
    if spec.time_col:
        series = cached(lambda: analyze_series(rows, spec.time_col, spec.y, spec.xs, keys))
        for name in SERIES_TABLES:
            out[name] = partial(lambda name: series()[name], name)
        return Tables(out)
    if spec.source == "questionnaire" and len(spec.xs) >= 2:
        out["instrument"] = lambda: instrument(rows, spec.xs, keys)
    described = list(dict.fromkeys([spec.y, *spec.xs, *([spec.mediator] if spec.mediator else [])]))
    out["describe"] = lambda: describe(rows, described, keys, n)
    if spec.goal == "compare":
        parts = Comparison(rows, spec, n)
        out |= {
            "normality": parts.normality, "test_result": lambda: parts.result, "group_summary": lambda: parts.summary,
            "post_hoc": parts.post_hoc, "box_stats": lambda: box_stats(rows, spec.y, spec.group, keys, n),
        }
        return Tables(out)
    gate = cached(lambda: cut_lineage(normality(rows, spec.y, keys, spec.small_n, spec.normality_alpha, n)))
    out["normality"] = gate
    if spec.goal == "influence":
        table = cached(lambda: cut_lineage(regression(rows, spec.y, spec.xs, keys, spec.alpha, spec.vif_limit)))
        out |= {
            "coefficients": lambda: coefficients(table(), keys), "fit": lambda: fit_summary(table(), keys),
            "vif_log": lambda: vif_log(rows, spec.y, spec.xs, keys, spec.vif_limit),
            "trend_line": lambda: trend_line(rows, spec.y, spec.xs[0], keys),
        }
    elif spec.goal == "correlate":
        out["correlation"] = lambda: correlation(rows, spec, gate())
        out["correlation_matrix"] = lambda: correlation_matrix(rows, list(dict.fromkeys([spec.y, *spec.xs])), keys)
    else:
        wide = cached(lambda: cut_lineage(mediation(rows, spec.y, spec.xs[0], spec.mediator, keys, spec.alpha)))
        out |= {"mediation": wide, "paths": lambda: mediation_paths(wide(), keys, spec.alpha)}
    out["test_result"] = lambda: auto_test(rows, spec, n)
    return Tables(out)
