"""fit(): one call that chooses how to fit."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.models import named
from ..operators.fit import FitResult, curve_fit
from ..operators.hybrid import hybrid_fit
from ..operators.precision import analyse, choose, tolerance
from ..operators.normal import LOCAL_ROWS
from ..operators.search import cma_es, method, multi_start
from .planner import plan

WORKFLOWS = ("auto", "auto_global", "hpc")
GOALS = ("fast", "balanced", "quality", "robust")


def fit(df: DataFrame, model, x, y: str, workflow: str = "auto", goal: str | None = None, bounds=None, **options) -> FitResult:
    """auto: one local fit. auto_global: a search inside bounds, its method by their widths. hpc: the hybrid
    fit, whose state can be kept and resumed. A goal sets tolerances by the number of rows; "robust" also
    the loss by the share of outliers."""
    if workflow not in WORKFLOWS:
        raise ValueError(f"unknown workflow: {workflow}; one of {WORKFLOWS}")
    if goal is not None and goal not in GOALS:
        raise ValueError(f"unknown goal: {goal}; one of {GOALS}")
    model = named(model)
    if workflow == "auto_global":
        if bounds is None:
            raise ValueError("a global search needs bounds")
        search = {"cma_es": cma_es, "multi_start": multi_start}[method(*bounds)]
        return search(df, model, x, y, bounds, **options)
    if workflow == "hpc":
        return hybrid_fit(df, model, x, y, bounds=bounds, **options)
    if goal == "robust":
        first = x if isinstance(x, str) else list(x)[0]
        options = choose(analyse(df, first, y, len(model.params))) | options
    elif goal is not None:
        t = tolerance(df.count(), goal)
        options = {"ftol": t, "xtol": t, "gtol": t} | options
    if workflow == "auto" and "local_rows" not in options and len(model.params) > 12:  # many parameters: rows may be few and still too large
        options["local_rows"] = LOCAL_ROWS if plan(df.count(), len(model.params), variables=len(model.variables)) == "local" else 0
    return curve_fit(df, model, x, y, bounds=bounds, **options)
