"""Command line: ``python -m isoframe.cli {extract,short,long,iso} ...``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from isoframe.operators import isoforms, report
from isoframe.plans import commands, inputs

VERSION = "0.1.0"


def percentage(text: str) -> float:
    value = float(text)
    if not 0 < value <= 100:
        raise argparse.ArgumentTypeError("must be over 0 and at most 100")
    return value


def count(text: str) -> int:
    value = int(text)
    if value < 0:
        raise argparse.ArgumentTypeError("must not be negative")
    return value


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="isoframe", description="Alternative splicing from junctions and reads.")
    top.add_argument("-v", "--version", action="version", version=VERSION)
    commands_ = top.add_subparsers(dest="command", required=True)
    e = commands_.add_parser("extract", help="count junctions of alignments")
    e.add_argument("-i", "--input", action="append", required=True)
    e.add_argument("-o", "--output", required=True)
    e.add_argument("-c", "--count", type=count, default=0)
    for name, default in (("short", None), ("long", 0)):
        p = commands_.add_parser(name, help=f"events of {name} reads")
        p.add_argument("input", nargs="+")
        p.add_argument("-r", "--reference", required=True)
        p.add_argument("-o", "--output", required=True)
        p.add_argument("-b", "--bam")
        p.add_argument("--psi-table", action="store_true")
        p.add_argument("--count-table", action="store_true")
        p.add_argument("-c", "--count", type=count, default=default)
        p.add_argument("--overall-count", type=count)
        p.add_argument("-e", "--error", type=count, default=3)
        p.add_argument("-p", "--process", type=count, default=0, help="local threads; 0 leaves them to Spark")
        p.add_argument("--overlap-exon-intron", type=percentage, default=90.0)
        if name == "long":
            p.add_argument("--overlap-ref-reads", type=percentage, default=90.0)
    i = commands_.add_parser("iso", help="unique isoforms of long reads")
    i.add_argument("input", nargs="+")
    i.add_argument("-o", "--output", required=True)
    i.add_argument("-e", "--error", type=count, default=3)
    return top


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    if args.command == "extract":
        report.write_junctions(commands.extract(spark, args.input, args.count), args.output)
    elif args.command == "iso":
        report.write_gtf(isoforms.to_gtf(commands.iso(spark, args.input, args.error)), args.output)
    else:
        options = {"min_count": args.count, "overall": args.overall_count, "error": args.error, "percent": args.overlap_exon_intron, "bam": args.bam}
        if args.command == "short":
            report.write_events(commands.short(spark, args.input, args.reference, **options), args.output)
        else:
            found = commands.long(spark, args.input, args.reference, read_percent=args.overlap_ref_reads, **options)
            commands.long_lines(found).write.mode("overwrite").text(args.output)
        if args.psi_table or args.count_table:
            least = args.count if args.count is not None else (1 if args.overall_count else 3)
            commands.write_tables(inputs.junctions(spark, args.input), args.output, args.count_table, args.psi_table, least)


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    builder = SparkSession.builder.appName("isoframe")
    if getattr(args, "process", 0):
        builder = builder.master(f"local[{args.process}]")
    run(builder.getOrCreate(), args)


if __name__ == "__main__":
    main()
