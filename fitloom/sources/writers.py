"""Results as JSON, CSV rows or standard output."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame


def clean(x):
    """Numbers that JSON has no form for become null."""
    if isinstance(x, dict):
        return {str(k): clean(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [clean(v) for v in x]
    if hasattr(x, "tolist"):
        return clean(x.tolist())
    return None if isinstance(x, float) and not math.isfinite(x) else x


def document(result, metadata: dict | None = None) -> dict:
    o = result.outcome
    return clean(
        {
            "popt": result.popt,
            "params": result.params,
            "uncertainties": result.stderr,
            "pcov": result.pcov,
            "statistics": result.stats(),
            "convergence": {"success": o.success, "message": o.message, "status": o.status, "nfev": o.nfev, "nit": o.nit, "optimality": o.optimality},
            "metadata": metadata or {},
        }
    )


def rows(result, metadata: dict | None = None) -> DataFrame:
    """name, value, uncertainty, type: parameter, statistic, convergence or metadata."""
    d = document(result, metadata)
    out = [(p, repr(v), d["uncertainties"][p], "parameter") for p, v in d["params"].items()]
    out += [(k, None if v is None else repr(v), None, "statistic") for k, v in d["statistics"].items()]
    out += [(k, str(v), None, "convergence") for k, v in d["convergence"].items()]
    out += [(k, str(v), None, "metadata") for k, v in d["metadata"].items()]
    return result.points.sparkSession.createDataFrame(out, "name string, value string, uncertainty double, type string")


def export(result, path: str | None, format: str = "json", metadata: dict | None = None, stdout: bool = False) -> None:
    """json or csv below path, through Spark's writers; stdout prints the JSON."""
    text = json.dumps(document(result, metadata))
    if path:
        if format == "csv":
            rows(result, metadata).coalesce(1).write.mode("overwrite").csv(path, header=True)
        else:
            spark = result.points.sparkSession
            spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    if stdout:
        print(text)
