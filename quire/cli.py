"""extract, info and version on the command line."""

from __future__ import annotations

import argparse
import json
import os
import sys
import time

from pyspark.sql import SparkSession

from quire import __version__
from quire.operators import triage
from quire.plans import pipeline
from quire.sources import sinks

SUFFIX = {"markdown": "md", "plain": "txt", "json": "json"}


def session() -> SparkSession:
    return SparkSession.builder.appName("quire").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def run_extract(a: argparse.Namespace, spark: SparkSession) -> int:
    if not os.path.exists(a.path):
        print(f"no such file or folder: {a.path}", file=sys.stderr)
        return 1
    began = time.time()
    made = pipeline.extract(spark, a.path, output_format="plain" if a.format == "json" else a.format, password=a.password, strip_headers=a.strip_headers, confidence_threshold=a.threshold)
    if not made.pages.take(1):
        for r in made.failures.collect():
            print(f"{r['path']}: {r['message']}", file=sys.stderr)
        return 1
    folder = a.output or (a.path if os.path.isdir(a.path) else os.path.dirname(os.path.abspath(a.path)))
    texts = made.json(time.time() - began).withColumnRenamed("json", "text") if a.format == "json" else made.texts
    written = sinks.write_documents(texts, folder, SUFFIX[a.format]).collect()
    total = sinks.summary(made.scores, made.failures).first().asDict()
    if a.format == "json" and os.path.isdir(a.path):
        with open(os.path.join(folder, "_batch_summary.json"), "w", encoding="utf-8") as f:
            json.dump(total | {"elapsed": round(time.time() - began, 2)}, f, ensure_ascii=False, indent=2)
    if not a.quiet:
        print(sinks.report(made.scores, triage.tally(made.pages)))
        for r in written:
            print(f"{r['path']}{' (overwritten)' if r['overwritten'] else ''}")
    return 0


def run_info(a: argparse.Namespace, spark: SparkSession) -> int:
    rows = [r.asDict() for r in pipeline.info(spark, a.path, password=a.password).orderBy("doc_id").collect()] if os.path.exists(a.path) else []
    print(json.dumps(rows, ensure_ascii=False, indent=2) if a.json else "\n".join(f"{r['doc_id']}: {r['page_count']} page(s), native {r['text_native']}, scanned {r['ocr_needed']}, mixed {r['hybrid']}" for r in rows))
    return 0 if rows else 1


def run_version(a: argparse.Namespace, spark: SparkSession | None = None) -> int:
    print(f"quire {__version__}")
    if a.verbose:
        import pyarrow
        import pyspark

        print(f"python {sys.version.split()[0]}\npyspark {pyspark.__version__}\npyarrow {pyarrow.__version__}")
    return 0


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="quire")
    sub = p.add_subparsers(dest="command", required=True)
    e = sub.add_parser("extract")
    e.add_argument("path")
    e.add_argument("-f", "--format", choices=tuple(SUFFIX), default="plain")
    e.add_argument("-o", "--output")
    e.add_argument("-p", "--password")
    e.add_argument("--strip-headers", action="store_true")
    e.add_argument("--threshold", type=float, default=0.0)
    e.add_argument("-q", "--quiet", action="store_true")
    i = sub.add_parser("info")
    i.add_argument("path")
    i.add_argument("-p", "--password")
    i.add_argument("--json", action="store_true")
    v = sub.add_parser("version")
    v.add_argument("-v", "--verbose", action="store_true")
    a = p.parse_args(argv)
    if a.command == "version":
        return run_version(a)
    return {"extract": run_extract, "info": run_info}[a.command](a, spark or session())


if __name__ == "__main__":
    sys.exit(main())
