"""Batch job: spark-submit ... tablelens/plans/batch.py INPUT [options]. Exit code 2: unreadable input, 1: failed."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from tablelens.config import AnalysisConfig
from tablelens.functions.staging import temporary_copies
from tablelens.plans.jobs import AnalysisResult, analyze_path
from tablelens.sources.tidy import LoadError


def build_parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tablelens", description="Analyse a table and write the report tables.")
    p.add_argument("input", help="delimited text, workbook, parquet, json or orc")
    p.add_argument("--target", "-t", help="column to predict")
    p.add_argument("--type", dest="analysis_type", default="auto", choices=["auto", "regression", "classification", "eda"])
    p.add_argument("--sheet", help="sheet of a workbook")
    p.add_argument("--key", nargs="*", default=[], help="columns that identify a row")
    p.add_argument("--exclude", nargs="*", default=[], help="columns to leave out")
    p.add_argument("--out", "-o", help="folder for the report tables")
    p.add_argument("--title", default=AnalysisConfig.report_title)
    p.add_argument("--author", default="")
    p.add_argument("--org", default="")
    p.add_argument("--cv", type=int, default=5, help="folds")
    p.add_argument("--max-models", type=int, default=8)
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--quiet", action="store_true", help="print nothing but errors")
    return p


def print_result(result: AnalysisResult) -> None:
    print(f"analysis: {result.task}")
    if result.modeling:
        print(f"model: {result.modeling.best_name}")
        for r in result.modeling.metrics.collect():
            print(f"  {r['metric']}: {'-' if r['value'] is None else format(r['value'], ',.4f')}")
        for r in result.modeling.importance.limit(5).collect():
            print(f"  driver {r['feature']}: {r['importance_pct']:.1f}%")
    if result.report_path:
        print(f"report: {result.report_path}")
    for message in result.messages:
        print(f"note: {message}")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = build_parser().parse_args(argv)
    config = AnalysisConfig(
        analysis_type=args.analysis_type, target=args.target, exclude_columns=tuple(args.exclude),
        key_columns=tuple(args.key), cv_folds=args.cv, max_models=args.max_models, random_state=args.seed,
        report_title=args.title, author=args.author, organization=args.org)
    spark = spark or SparkSession.builder.appName("tablelens").getOrCreate()
    try:
        with temporary_copies(spark):
            result = analyze_path(spark, args.input, config, sheet_name=args.sheet, output=args.out)
            if not args.quiet:
                print_result(result)
    except LoadError as exc:
        print(f"error: {exc}", file=sys.stderr)
        return 2
    except Exception as exc:
        print(f"error: the analysis failed: {exc}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
