"""Models given as numpy functions, for what a formula cannot say. Rows pass through Arrow, so formulas are faster."""

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from .models import Model


@dataclass(frozen=True)
class Numeric:
    """f(*variables, *params) and, if given, jac(*variables, *params) of shape (rows, params); else forward differences."""

    name: str
    f: Callable
    params: tuple
    variables: tuple = ("x",)
    jac: Callable | None = None
    start: Callable | None = None
    bounds: dict | None = None
    step: float = 1e-8
    expr = None
    linear = False

    limits = Model.limits

    def _call(self, g: Callable, theta, v: dict) -> np.ndarray:
        with np.errstate(all="ignore"):
            return np.asarray(g(*(v[x] for x in self.variables), *theta), float)

    def values(self, theta, v: dict) -> np.ndarray:
        return np.broadcast_to(self._call(self.f, theta, v), np.shape(v[self.variables[0]]))

    def jacobian(self, theta, v: dict) -> np.ndarray:
        if self.jac is not None:
            return self._call(self.jac, theta, v)
        base, cols = self.values(theta, v), []
        for i, t in enumerate(theta):
            moved = np.array(theta, float)
            moved[i] += self.step * max(1.0, abs(t))
            cols.append((self.values(moved, v) - base) / (moved[i] - t))
        return np.stack(cols, 1)

    def _inputs(self, columns: dict):
        return F.struct(*(F.col(columns[x]).cast("double").alias(x) for x in self.variables))

    def column(self, theta, columns: dict):
        theta = [float(t) for t in theta]

        @F.pandas_udf("double")
        def value(s: pd.DataFrame) -> pd.Series:
            return pd.Series(np.array(self.values(theta, {x: s[x].to_numpy(float) for x in self.variables})))

        return value(self._inputs(columns))

    def slopes(self, theta, columns: dict) -> list:
        theta = [float(t) for t in theta]

        @F.pandas_udf("array<double>")
        def value(s: pd.DataFrame) -> pd.Series:
            return pd.Series(list(self.jacobian(theta, {x: s[x].to_numpy(float) for x in self.variables})))

        j = value(self._inputs(columns))
        return [j[i] for i in range(len(self.params))]
