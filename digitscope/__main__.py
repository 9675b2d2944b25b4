"""Command line: ``python -m digitscope process|preview|analyze`` (or through spark-submit)."""

from __future__ import annotations

import argparse
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from digitscope.operators.bounds import count_up_to
from digitscope.operators.sampling import sample
from digitscope.plans.extract import backfill_numbers, build_numbers, extract_articles
from digitscope.plans.preview import preview_digits, preview_totals
from digitscope.plans.report import analyze
from digitscope.session import get_session
from digitscope.sources.index import read_index
from digitscope.sources.pages import read_pages
from digitscope.sources.sinks import write_counts_json
from digitscope.sources.tables import read_numbers, read_split


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="digitscope", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)

    process = commands.add_parser("process", help="extract the numbers of a page dump")
    process.add_argument("--dump", required=True)
    process.add_argument("--index")
    process.add_argument("--output", required=True)
    process.add_argument("--ledger", help="folder of finished units; a run that has one continues where the last one stopped")
    process.add_argument("--rejected", action="store_true", help="with a ledger: keep rejected pages with their reasons, as partitions beside the numbers")
    process.add_argument("--summary", help="folder for the digit counts as JSON")
    size = process.add_mutually_exclusive_group()
    size.add_argument("--sample-rate", type=float)
    size.add_argument("--sample-count", type=int)
    process.add_argument("--sample-seed", type=int, default=42)
    process.add_argument("--consecutive", action="store_true")

    look = commands.add_parser("preview", help="totals and digits of the first articles")
    look.add_argument("--dump", required=True)
    look.add_argument("--index", required=True)
    look.add_argument("--count", type=int, default=1000)

    report = commands.add_parser("analyze", help="write the report tables of a numbers table")
    report.add_argument("--data", required=True)
    report.add_argument("--output", required=True)
    return parser


def main(argv: list[str] | None = None) -> int:
    """Run a command; an input that does not exist gives a message and status 1."""
    args = _parser().parse_args(argv)
    try:
        return _run(args)
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        print(f"no such input: {(problem.getMessageParameters() or {}).get('path', problem)}", file=sys.stderr)
        return 1


def _run(args: argparse.Namespace) -> int:
    spark = get_session()
    if args.command == "process":
        chosen = (args.index, args.sample_rate, args.sample_count, args.sample_seed, args.consecutive)
        if args.ledger:
            entries = backfill_numbers(spark, args.dump, args.output, args.ledger, *chosen, rejected=args.rejected)
            totals = entries.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("articles", "numbers", "rejected")]).first().asDict()
        else:
            totals = build_numbers(spark, args.dump, args.output, *chosen)
        print(", ".join(f"{name}: {n}" for name, n in totals.items()))
        if args.summary:
            split = args.ledger and args.rejected
            write_counts_json(read_split(spark, args.output)[0] if split else read_numbers(spark, args.output), args.summary)
    elif args.command == "preview":
        entries = read_index(spark, args.index)
        ids = sample(entries, count=count_up_to(entries, args.count), consecutive=True).select("article_id")
        numbers = extract_articles(read_pages(spark, args.dump, main_only=True, ids=ids)).persist()
        preview_totals(numbers).show()
        preview_digits(numbers).show()
    else:
        analyze(spark, args.data, args.output).show(truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
