"""Command line of the package.

    list                                        names of all queries
    doctor                                      versions and settings
    run QUERY --tables DIR [--out DIR]          a query over a folder of Parquet tables
    validate-snapshot ROOT [--id ID]            a published version's unique keys
    build-index TEXTS --out DIR                 chunk, embed and write (article_id, text) rows
    compare-quality OLD NEW --sources TABLE     the release guard over two article tables

Exit code 0: done; 1: it failed, or a check or gate did not pass; 2: refused (unknown query, missing table).
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.arrow import hashing_embedder
from .operators import reports, retrieval
from .plans import catalog
from .sources import store

MODEL, DIMENSIONS = "hashing-384", 384


def _arguments() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="sievewright")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of all queries")
    commands.add_parser("doctor", help="versions and settings")
    run = commands.add_parser("run", help="run a query over a folder of Parquet tables")
    run.add_argument("query")
    run.add_argument("--tables", required=True)
    run.add_argument("--out")
    run.add_argument("--format", default="parquet", choices=("parquet", "json", "csv", "orc"))
    check = commands.add_parser("validate-snapshot", help="check a published version's unique keys")
    check.add_argument("root")
    check.add_argument("--id", help="the version; the current one by default")
    index = commands.add_parser("build-index", help="chunk and embed texts, write an index")
    index.add_argument("texts")
    index.add_argument("--out", required=True)
    index.add_argument("--snapshot", default="unnamed")
    compare = commands.add_parser("compare-quality", help="the release guard between two article tables")
    compare.add_argument("old")
    compare.add_argument("new")
    compare.add_argument("--sources", required=True)
    compare.add_argument("--at", required=True, help="the time that ages count from")
    return parser


def _run(spark: SparkSession, args) -> int:
    rows = catalog.QUERIES[args.query](spark, args.tables)
    if args.out:
        rows.write.format(args.format).mode("errorifexists").save(args.out)
    else:
        rows.show(20, truncate=80)
    return 0


def _validate(spark: SparkSession, args) -> int:
    found = {name: store.load(spark, args.root, name, args.id) for name in store.UNIQUE if store.has(spark, args.root, name, args.id)}
    if not found:
        raise FileNotFoundError(f"no collection of this version in {args.root}")
    store.check(found)
    print(" ".join(f"{name}={rows.count()}" for name, rows in found.items()))
    return 0


def _index(spark: SparkSession, args) -> int:
    chunks = retrieval.chunk_paragraphs(spark.read.parquet(args.texts))
    store.write_index(store.build_index(chunks, hashing_embedder(DIMENSIONS)), args.out, args.snapshot, MODEL, DIMENSIONS, retrieval.CHUNKING)
    print(f"{store.load_index(spark, args.out, MODEL, DIMENSIONS, retrieval.CHUNKING).count()} chunks")
    return 0


def _compare(spark: SparkSession, args) -> int:
    old, new, sources = (spark.read.parquet(p) for p in (args.old, args.new, args.sources))
    at = F.lit(args.at).cast("timestamp")
    guard = reports.release_guard(reports.audit(old, sources, at), reports.audit(new, sources, at), old, new).first()
    print(f"gate {guard.gate}: {guard.new_rows} new rows, {guard.lost_ready} lost ready ones, {guard.required_ready} ready ones required")
    return 0 if guard.gate == "pass" else 1


COMMANDS = {"run": _run, "validate-snapshot": _validate, "build-index": _index, "compare-quality": _compare}


def main(argv: list[str] | None = None) -> int:
    args = _arguments().parse_args(argv)
    if args.command == "list":
        print("\n".join(catalog.QUERIES))
        return 0
    if args.command == "run" and args.query not in catalog.QUERIES:
        print(f"unknown query: {args.query}", file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("sievewright").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.command == "doctor":
        print(f"Spark {spark.version}, {len(catalog.QUERIES)} queries, {len(catalog.SQL)} with SQL, checkpoint folder {spark.conf.get('spark.checkpoint.dir', '') or 'unset'}")
        return 0
    try:
        return COMMANDS[args.command](spark, args)
    except Exception as error:  # the exit code tells
        print(str(error).split("\n")[0], file=sys.stderr)
        return 2 if "PATH_NOT_FOUND" in str(error) or isinstance(error, FileNotFoundError) else 1


if __name__ == "__main__":
    sys.exit(main())
