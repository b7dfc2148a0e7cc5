"""Command line: python -m fitloom fit job.yaml | batch a.yaml b.yaml --p0 1 2 | info."""

from __future__ import annotations

import argparse
import json
import sys


def main(argv: list | None = None) -> int:
    parser = argparse.ArgumentParser(prog="fitloom", description="Curve fits on Spark.")
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("fit", help="run one YAML job")
    one.add_argument("job")
    one.add_argument("-o", "--output", help="in place of the job's results file")
    one.add_argument("--stdout", action="store_true", help="print the result as JSON")
    many = commands.add_parser("batch", help="run YAML jobs that share a model as one job per dataset")
    many.add_argument("jobs", nargs="+")
    many.add_argument("--p0", nargs="+", type=float, required=True)
    many.add_argument("-s", "--summary", help="file for the summary")
    commands.add_parser("info", help="versions, models and settings")
    args = parser.parse_args(argv)

    from pyspark.sql import SparkSession

    from .functions.models import MODELS
    from .operators.guard import failed_message
    from .plans.workflow import batch_summary, parsed, run_batch, run_workflow

    spark = SparkSession.builder.appName("fitloom").getOrCreate()
    if args.command == "info":
        print(json.dumps({"spark": spark.version, "master": spark.sparkContext.master, "models": sorted(MODELS)}))
        return 0
    try:
        if args.command == "fit":
            with open(args.job) as f:
                job = parsed(f.read())
            out = dict(job.get("export") or {})
            if args.output:
                out["results_file"] = args.output
            out["stdout"] = args.stdout or out.get("stdout", False)
            run_workflow(spark, {**job, "export": out})
            return 0
        jobs = []
        for path in args.jobs:
            with open(path) as f:
                jobs.append(f.read())
        told = batch_summary(run_batch(spark, jobs, args.p0))
        text = json.dumps(told)
        if args.summary:
            with open(args.summary, "w") as f:
                f.write(text)
        print(text)
        return 1 if told["failed"] else 0
    except (ValueError, OSError) as e:
        print(json.dumps({"error": str(e), **failed_message(e)}), file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
