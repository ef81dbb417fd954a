"""Command-line jobs for spark-submit (or ``python -m caseload.cli`` locally).

  anonymize --input DIR --output DIR     route the four exports by file name (S2), read them (S1),
                                         drop PII / bucket occupation / derive birth year (P1-P4),
                                         refuse to write if PII remains (P2), write the tables (S4);
                                         where malformed rows are goes to ``errors`` (file, reason, columns)
  build     --input DIR --output DIR     four tables → scored, numbered case table (Parquet)
  report    --cases DIR --output DIR     needs report, priority list and per-family plans as CSV (S5);
            [--filter JSON]              optionally over a filtered caseload (predicate spec, F8);
                                         --cases DIR,DIR reads a caseload with appended rows
  intake    --responses DIR --cases DIR  parse, score and number responses after the stored cases (T1);
            --output DIR [--stream]      a batch table, or a stream's tables

The session comes from the cluster (``getOrCreate``); checkpoints go to its
``spark.checkpoint.dir``. Paths may be on any Hadoop file system.
"""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession

from caseload.operators import intake as intake_rows
from caseload.operators import partials, planning, reports, search
from caseload.operators.cases import REGISTRATION_COLUMNS, build_cases
from caseload.operators.scoring import number_cases, score
from caseload.operators.privacy import route_files
from caseload.session import drop_table, materialize
from caseload.sources import tables, typed_csv
from caseload.streaming.intake_stream import RESPONSE_SCHEMA, parts_path, start_stream


def list_files(spark: SparkSession, directory: str, suffix: str = ".csv") -> list[str]:
    """Files directly under ``directory`` with ``suffix`` (Hadoop FileSystem listing, so any scheme works)."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(directory)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(str(st.getPath()) for st in fs.listStatus(path)
                  if str(st.getPath().getName()).lower().endswith(suffix))


def anonymize(spark: SparkSession, input_dir: str, output_dir: str, fmt: str = "parquet") -> None:
    raw, errors = typed_csv.scan_tables(spark, route_files(list_files(spark, input_dir)))
    tables.write_tables(tables.anonymize_tables(raw), output_dir, fmt)
    errors.drop("record").write.mode("overwrite").parquet(os.path.join(output_dir, "errors"))  # records may name people


def build(spark: SparkSession, input_dir: str, output_dir: str, fmt: str = "parquet",
          partition_by: list[str] | None = None) -> None:
    """Write the case table; ``partition_by`` (e.g. governorate) lets equality filters prune directories."""
    cases = number_cases(score(build_cases(tables.load_case_tables(spark, input_dir, fmt))), tie=REGISTRATION_COLUMNS)
    tables.write_cases(cases, output_dir, partition_by)


def report(spark: SparkSession, cases_dir: str, output_dir: str, spec: dict | None = None) -> None:
    cases = search.where(tables.load_caseload(spark, cases_dir.split(",")), spec)
    needs = planning.needs_report(cases)
    outputs = {
        "aggregate_needs": (needs["aggregate_needs"], None),  # already in urgency / count / item order
        "food_quantities": (needs["ration_totals"], ["item_pos"]),
        "medical_supplies": (needs["medical_supplies"], ["item_pos"]),
        "budget": (needs["financial_totals"], ["line_pos"]),
        "priority_list": (reports.priority_order(cases), None),
        "ration_packs": (planning.ration_packs(cases), ["family_num"]),
        "financial_needs": (planning.family_costs(cases), ["family_num"]),
    }
    for name, (df, order) in outputs.items():
        small = name not in ("priority_list", "ration_packs", "financial_needs")
        tables.export_csv(df, os.path.join(output_dir, name), order_by=order, single_file=small)
    tables.export_json(needs["aggregate_needs"], os.path.join(output_dir, "needs_json"))
    needs["table"].unpersist()


def intake(spark: SparkSession, responses: str, cases_dir: str, output_dir: str, stream: bool = False) -> None:
    """Add model responses (intake_id, response) as cases numbered after the stored ones.

    Of a batch only the new rows are written, to ``output_dir``; ``cases_dir,output_dir`` then names the whole
    caseload. A stream keeps its tables there (``table``, ``quarantine``) and ends with the reports over both.
    """
    cases = tables.load_caseload(spark, cases_dir.split(","))
    if stream:
        last = cases.agg({"family_num": "max"}).first()[0] or 0
        start_stream(spark, responses, os.path.join(output_dir, "table"), os.path.join(output_dir, "quarantine"),
                     os.path.join(output_dir, "checkpoint"), start_number=last, caseload=cases).awaitTermination()
        parts = parts_path(os.path.join(output_dir, "table"))
        tables.export_csv(partials.needs_report(spark, parts), os.path.join(output_dir, "needs_report"),
                          order_by=["section", "pos", "item"], single_file=True)
        tables.export_csv(partials.headline(spark, parts), os.path.join(output_dir, "headline"), single_file=True)
        return
    parsed = intake_rows.parse_responses(spark.read.schema(RESPONSE_SCHEMA).parquet(responses))
    new = materialize(intake_rows.score_intake(intake_rows.first_records(parsed)))
    intake_rows.rows_to_append(cases, new).write.mode("overwrite").parquet(output_dir)
    drop_table(new)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="caseload")
    sub = parser.add_subparsers(dest="command", required=True)
    a = sub.add_parser("anonymize")
    a.add_argument("--input", required=True)
    a.add_argument("--output", required=True)
    a.add_argument("--format", default="parquet")
    b = sub.add_parser("build")
    b.add_argument("--input", required=True)
    b.add_argument("--output", required=True)
    b.add_argument("--format", default="parquet")
    b.add_argument("--partition-by", default=None, help="comma-separated columns, e.g. governorate")
    r = sub.add_parser("report")
    r.add_argument("--cases", required=True)
    r.add_argument("--output", required=True)
    r.add_argument("--filter", default=None, help='predicate spec, e.g. {"col": "is_homeless", "op": "is_true"}')
    i = sub.add_parser("intake")
    i.add_argument("--responses", required=True)
    i.add_argument("--cases", required=True)
    i.add_argument("--output", required=True)
    i.add_argument("--stream", action="store_true")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName(f"caseload-{args.command}").getOrCreate()
    if args.command == "anonymize":
        anonymize(spark, args.input, args.output, args.format)
    elif args.command == "build":
        build(spark, args.input, args.output, args.format,
              args.partition_by.split(",") if args.partition_by else None)
    elif args.command == "intake":
        intake(spark, args.responses, args.cases, args.output, args.stream)
    else:
        report(spark, args.cases, args.output, json.loads(args.filter) if args.filter else None)
    return 0


if __name__ == "__main__":
    sys.exit(main())
