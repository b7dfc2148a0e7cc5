"""YAML jobs: load, fit, export. A batch of jobs with one model becomes one fit per dataset."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.models import formula, named
from ..operators.fit import FitResult, curve_fit
from ..operators.grouped import fit_by_key
from ..operators.precision import choose, analyse
from ..operators.search import cma_es, method, multi_start
from ..operators import normal
from ..sources import readers, writers
from . import planner


def parsed(job) -> dict:
    """A dict, or YAML text."""
    if isinstance(job, dict):
        return job
    import yaml

    return yaml.safe_load(job)


def table(spark: SparkSession, data: dict) -> tuple:
    """(points, predictors, response, sigma). With a z column, x and y predict z."""
    cols = data.get("columns") or {"x": 0, "y": 1}
    options = {k: v for k, v in (data.get(data.get("format") or readers.detect(data["input_file"])) or {}).items() if not k.endswith("_key")}
    df = readers.load(spark, data["input_file"], {k: v for k, v in cols.items() if v is not None}, data.get("format"), **options)
    x, y = (["x", "y"], "z") if cols.get("z") is not None else (["x"], "y")
    return df, x, y, "sigma" if cols.get("sigma") is not None else None


def model_of(spec: dict, variables: tuple):
    if spec.get("formula"):
        return formula(spec["formula"], variables=variables)
    return named(spec["name"], spec.get("degree"))


def run_workflow(spark: SparkSession, job) -> FitResult:
    """Keys: metadata, data, model, fitting, validation, export."""
    job = parsed(job)
    df, x, y, sigma = table(spark, job["data"])
    model = model_of(job["model"], tuple(x))
    rules = job.get("validation") or job["data"].get("validation") or {}
    n = df.count()
    if n < rules.get("min_points", 2):
        raise ValueError(f"{n} points, at least {rules.get('min_points', 2)} are needed")
    f = dict(job.get("fitting") or {})
    search, bounds = f.pop("search", None), f.pop("bounds", None)
    f.setdefault("nan_policy", "raise" if rules.get("require_finite", True) else "omit")
    if f.pop("auto", False):
        f |= choose(analyse(df, x[0], y, len(model.params)))
    known = {"p0", "loss", "f_scale", "absolute_sigma", "nan_policy", "ftol", "xtol", "gtol", "max_nfev", "solver", "log", "stability", "multistart", "fallback"}
    if unknown := set(f) - known:
        raise ValueError(f"unknown fitting keys: {sorted(unknown)}")
    f["local_rows"] = normal.LOCAL_ROWS if planner.plan(n, len(model.params), variables=len(x)) == "local" else 0
    if search:
        how = {"multi_start": multi_start, "cma_es": cma_es, "auto": {"multi_start": multi_start, "cma_es": cma_es}[method(*bounds)]}[search]
        result = how(df, model, x, y, bounds, sigma=sigma, nan_policy=f["nan_policy"], local_rows=f["local_rows"])
    else:
        result = curve_fit(df, model, x, y, sigma=sigma, bounds=bounds, order="ord" if "ord" in df.columns else None, **f)
    out = job.get("export") or {}
    writers.export(result, out.get("results_file"), out.get("format", "json"), job.get("metadata"), out.get("stdout", False))
    return result


def run_batch(spark: SparkSession, jobs: list, p0) -> DataFrame:
    """Jobs that share a model and columns: their points are one table, fitted per dataset_id in one job."""
    jobs = [parsed(j) for j in jobs]
    parts = []
    for i, j in enumerate(jobs):
        df, x, y, sigma = table(spark, j["data"])
        parts.append(df.select(F.lit((j.get("metadata") or {}).get("dataset_id", str(i))).alias("dataset_id"), *x, y, *([sigma] if sigma else [])))
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.unionByName(p)
    return fit_by_key(all_, model_of(jobs[0]["model"], tuple(x)), x, y, ["dataset_id"], p0, sigma=sigma)


def batch_summary(fits: DataFrame) -> dict:
    """total, succeeded, failed and errors (message: how often) of run_batch(), from one aggregate by error."""
    rows = fits.groupBy("success", "error").agg(F.count("*").alias("n")).collect()
    good = sum(r.n for r in rows if r.success)
    total = sum(r.n for r in rows)
    return {"total": total, "succeeded": good, "failed": total - good, "errors": {r.error or "not converged": r.n for r in rows if not r.success}}
