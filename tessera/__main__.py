"""``python -m tessera``: version, doctor, validate, adapt, test-adapter, ingest, query, evaluate.

Reports are lines of JSON, one a row and none left out. Exit codes: 0 fine, 1
something failed, 2 wrong usage.
"""

from __future__ import annotations

import argparse
import json
import sys
import tempfile
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "0.2.0"


def told(rows: DataFrame, section: str) -> int:
    """Print all rows, a JSON object each; how many there were. The driver holds a partition at a time."""
    n = 0
    for r in rows.toLocalIterator():
        print(json.dumps({"section": section} | r.asDict(recursive=True), ensure_ascii=False, default=str))
        n += 1
    return n


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tessera")
    commands = top.add_subparsers(dest="command", required=True)
    commands.add_parser("version")
    for name in ("doctor", "validate", "adapt", "ingest", "evaluate", "test-adapter"):
        p = commands.add_parser(name)
        p.add_argument("--corpus-root")
        p.add_argument("--adapter")
        if name == "adapt":
            p.add_argument("--output")
        if name in ("ingest", "evaluate"):
            p.add_argument("--store", required=name == "ingest")
        if name == "ingest":
            p.add_argument("--dry-run", action="store_true")
            p.add_argument("--rebuild", action="store_true")
        if name == "evaluate":
            p.add_argument("battery")
            p.add_argument("--runs", type=int, default=1)
            p.add_argument("--traces")
        if name == "test-adapter":
            p.add_argument("manifest")
            p.add_argument("--keep")
    p = commands.add_parser("query")
    p.add_argument("question", nargs="+")
    p.add_argument("--store", required=True)
    p.add_argument("--debug", action="store_true")
    p.add_argument("--allow-stale", action="store_true")
    for name in ("record", "status", "tag", "value-path"):
        p.add_argument(f"--{name}", action="append", default=[])
    return top


def query(spark: SparkSession, args: argparse.Namespace) -> int:
    from tessera.operators.retrieval import Filters
    from tessera.plans.engine import Engine
    from tessera.store.generation import Store

    try:
        filters = Filters.build(args.record, args.status, args.tag, args.value_path)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
    store = Store(spark, args.store)
    asked = spark.createDataFrame(list(enumerate(args.question)), "query_id int, question string")
    with store.reading():
        rows = Engine(spark, store).ask(asked, filters, allow_stale=args.allow_stale).orderBy("query_id")
        told(rows if args.debug else rows.drop("trace"), "answer")
        return int(not rows.where("state = 'failed'").isEmpty())


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "version":
        print(VERSION)
        return 0
    from tessera.operators import doctor, validate
    from tessera.plans import evaluation
    from tessera.plans.ingest import ingest
    from tessera.sources import adapters, conformance, files
    from tessera.sources.frontmatter import record_files
    from tessera.sources.markdown import listing
    from tessera.sources.walk import survey
    from tessera.store.generation import Store

    spark = SparkSession.builder.getOrCreate()
    if args.command == "query":
        return query(spark, args)
    config = (files.find_config(".") or (None, {}))[1]
    root = files.setting("corpus_root", args.corpus_root, config, ".")
    adapter = adapters.load(files.setting("adapter", args.adapter, config, "spec-folders"))
    if args.command == "doctor":
        docs, skips = survey(spark, root)
        told(doctor.heading_frequency(docs).orderBy(F.desc("file_count"), "heading"), "heading_frequency")
        told(doctor.heading_sets(docs).orderBy(F.desc("file_count")), "heading_sets")
        told(doctor.skip_summary(skips).orderBy("position"), "skips")
        return 0
    if args.command == "test-adapter":
        report = conformance.run_cases(spark, adapter, conformance.read_cases(args.manifest), args.keep).cache()
        told(report, "check")
        return int(not report.where(~F.col("passed")).isEmpty())
    entries = evaluation.entries(spark, adapter, root)
    if args.command == "adapt":
        told(adapter.adapt(spark, root).select("folder", "record_id", "skip_reason").orderBy("folder"), "source")
        if out := files.setting("output", args.output, config):
            record_files(entries.select("record.*")).write.mode("overwrite").parquet(out)
        return 0
    if args.command == "validate":
        found = validate.validate(entries.select("record.*"), listing(spark, root), None)
        told(found.orderBy("id", "field"), "violation")
        return int(not found.where("severity = 'error'").isEmpty())
    now = datetime.now(UTC).isoformat()
    if args.command == "ingest":
        store = Store(spark, args.store)
        with store.writing():
            report = ingest(spark, store, entries, now=now, rebuild=args.rebuild, dry_run=args.dry_run)
        told(report.orderBy("record_id"), "record")
        told(report.groupBy("action", "failure_code").count(), "total")
        return int(not report.where("action = 'failed'").isEmpty())
    with tempfile.TemporaryDirectory(prefix="tessera-evaluate-") as own:
        store = Store(spark, args.store or f"{own}/store")
        with store.writing():
            ingest(spark, store, entries, now=now, rebuild=True)
        rates, lost = evaluation.battery_report(spark, store, files.read_battery(spark, args.battery), args.runs, traces=args.traces)
        wrong = told(lost, "unsatisfiable")
        told(rates.orderBy("query_id"), "rate")
        return int(bool(wrong) or not rates.where("passed < runs").isEmpty())


if __name__ == "__main__":
    sys.exit(main())
