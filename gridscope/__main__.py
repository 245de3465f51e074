"""python -m gridscope analyze FILE... [--mode ...] [--output json|csv] [--out-path PATH] [--bulk] [--with-original-description JSON]"""

from __future__ import annotations

import argparse
import csv
import io
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from gridscope.plans.analyze import Options, analyze_files
from gridscope.plans.report import bulk_documents, bulk_rows, descriptions, json_documents, report_rows


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="gridscope")
    commands = parser.add_subparsers(dest="command")
    run = commands.add_parser("analyze")
    run.add_argument("file", nargs="+")
    run.add_argument("--mode", choices=["lite", "standard", "thorough"], default="standard")
    run.add_argument("--output", choices=["json", "csv"], default="json")
    run.add_argument("--out-path")
    run.add_argument("--bulk", action="store_true", help="report the files as one batch, too")
    run.add_argument("--with-original-description", metavar="JSON", help="add the rules' original texts from this file to CSV rows")
    args = parser.parse_args(argv)
    if args.command is None:
        parser.print_help()
        return 1
    spark = SparkSession.builder.appName("gridscope").getOrCreate()
    analysis = analyze_files(spark, args.file, Options(mode=args.mode))
    errors = analysis.workbooks.errors.collect()  # of the files named on the command line
    for e in errors:
        print(f"{e.name}: {e.error}", file=sys.stderr)
    if args.output == "json":
        text = "\n".join(r.json for r in (bulk_documents if args.bulk else json_documents)(analysis).collect())
    else:
        original = descriptions(spark, args.with_original_description) if args.with_original_description else None
        rows, out = bulk_rows(analysis) if args.bulk else report_rows(analysis, original), io.StringIO()
        writer = csv.writer(out)
        writer.writerow(rows.columns)
        writer.writerows(rows.collect())
        text = out.getvalue()
    if args.out_path:
        Path(args.out_path).write_text(text, encoding="utf-8")
    else:
        print(text)
    return 2 if errors else 0


if __name__ == "__main__":
    sys.exit(main())
