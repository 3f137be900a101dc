"""What to analyse: columns, goal, thresholds."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from autostat.functions.columns import require_columns
from autostat.operators.profile import detect_structure

# Names a goal may be given by, the older type names last.
GOALS = {
    "compare": "compare", "komparasi": "compare", "Komparatif": "compare",
    "influence": "influence", "pengaruh": "influence", "Asosiatif": "influence",
    "correlate": "correlate", "korelasi": "correlate",
    "mediate": "mediate", "mediasi_moderasi": "mediate",
}


@dataclass(frozen=True)
class AnalysisSpec:
    """One analysis request; `keys` runs it for every segment at once."""

    y: str
    goal: str = "influence"
    xs: Sequence[str] = ()
    group: str | None = None
    mediator: str | None = None
    time_col: str | None = None
    paired: bool = False
    pair_key: str | None = None
    source: str = "observation"
    keys: Sequence[str] = field(default_factory=tuple)
    alpha: float = 0.05
    normality_alpha: float = 0.05
    small_n: int = 30
    vif_limit: float = 10.0
    filter_outliers: bool = True
    whole_table_structure: bool = False
    strict_reference: bool = False

    def validated(self) -> AnalysisSpec:
        """Canonical goal, or ValueError when a required part is missing. Runs no job."""
        if not self.y:
            raise ValueError("an outcome column is required")
        if self.goal not in GOALS:
            raise ValueError(f"unknown goal '{self.goal}'; use compare, influence, correlate or mediate")
        spec = replace(self, goal=GOALS[self.goal], xs=tuple(dict.fromkeys(self.xs)), keys=tuple(self.keys))
        if spec.time_col:
            return spec
        if spec.goal == "compare" and not spec.group:
            raise ValueError("compare needs a group column")
        if spec.goal == "compare" and spec.paired and not spec.pair_key:
            raise ValueError("a paired comparison needs the column that identifies the subject (pair_key)")
        if spec.goal != "compare" and not spec.xs:
            raise ValueError(f"{spec.goal} needs at least one predictor")
        if spec.goal == "mediate" and not spec.mediator:
            raise ValueError("mediate needs a mediator column")
        return spec

    def target_columns(self) -> list[str]:
        """Columns the analysis reads, in order, without repeats (segment and pair keys apart)."""
        names = [self.y]
        if self.time_col:
            names += [*self.xs, self.time_col]
        elif self.goal == "compare":
            names.append(self.group)
        else:
            names += self.xs
            if self.goal == "mediate":
                names.append(self.mediator)
        return list(dict.fromkeys(names))

    def resolve(self, df: DataFrame) -> AnalysisSpec:
        """Validate against the table; a time structure sends `influence` to the time-series path."""
        goal = GOALS.get(self.goal, self.goal)
        spec = replace(self, goal=goal)
        if goal == "influence" and not spec.time_col:
            inside = df.columns if spec.whole_table_structure else [c for c in spec.target_columns() if c in df.columns]
            structure, found = detect_structure(df, inside, substring=spec.strict_reference)
            if structure == "time_series" and found != spec.y:
                xs = tuple(x for x in spec.xs if x != found)
                spec = replace(spec, time_col=found, xs=xs)
        spec = spec.validated()
        extra = [spec.pair_key] if spec.paired and spec.pair_key else []
        require_columns(df, [*spec.keys, *extra, *spec.target_columns()])
        return spec


def suggest_goal(df: DataFrame, y: str, others: Sequence[str]) -> str:
    """Hint only: labels suggest compare, one number correlate, several influence."""
    kinds = [isinstance(df.schema[c].dataType, T.NumericType) for c in others]
    if not all(kinds):
        return "compare"
    return "correlate" if len(kinds) == 1 else "influence"
