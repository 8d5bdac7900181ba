"""Command line: add, rm, scan, status, ls, pack, export."""

from __future__ import annotations

import argparse
import os
import sys
from typing import TYPE_CHECKING

from .catalogue import Catalogue
from .errors import LumendexError
from .functions.paths import human_size

if TYPE_CHECKING:
    from pyspark.sql import Column, DataFrame


def default_catalogue() -> str:
    """Where the catalogue lies unless said otherwise."""
    return os.path.join(os.environ.get("HOME", "."), ".lumendex", "catalogue")


def parser() -> argparse.ArgumentParser:
    """The command line's arguments."""
    p = argparse.ArgumentParser(prog="lumendex", description="Media catalogue and duplicate resolution on Spark")
    p.add_argument("--catalog", default=default_catalogue(), help="folder of the catalogue")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("add", help="register a folder").add_argument("path")
    sub.add_parser("rm", help="unregister a folder and drop its photos").add_argument("path")
    sub.add_parser("scan", help="read all sources and resolve duplicates")
    sub.add_parser("status", help="totals and sources")
    ls = sub.add_parser("ls", help="files, or duplicate groups")
    ls.add_argument("--dupes", action="store_true")
    ls.add_argument("id", nargs="?", type=int)
    sub.add_parser("pack", help="copy the best originals into an archive").add_argument("path", nargs="?")
    export = sub.add_parser("export", help="convert the best photos to HEIC by date")
    export.add_argument("path")
    export.add_argument("--quality", type=int, default=85, choices=range(101), metavar="0-100")
    return p


def table(df: DataFrame) -> None:
    """Print every row of `df` as a table, one partition at a time in the driver."""
    from pyspark.sql import functions as F

    def cell(name: str) -> Column:
        text = F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("NULL"))
        for raw, shown in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
            text = F.replace(text, F.lit(raw), F.lit(shown))
        return text.alias(name)

    names = df.columns
    texts = df.select(*map(cell, names))
    most = texts.agg(*[F.max(F.length(f"`{n}`")).alias(n) for n in names]).first()
    widths = [max(len(n), w or 0) for n, w in zip(names, most, strict=True)]
    rule = "+" + "+".join("-" * w for w in widths) + "+"
    line = lambda row: print("|" + "|".join(v.ljust(w) for v, w in zip(row, widths, strict=True)) + "|")
    print(rule)
    line(names)
    print(rule)
    for row in texts.toLocalIterator():
        line(row)
    print(rule)


def run(catalogue: Catalogue, args: argparse.Namespace) -> None:
    """Carry out one command."""
    say = lambda event, data: print(f"  {event}: " + ", ".join(f"{k} {v}" for k, v in data.items()))
    if args.command == "add":
        print(f"added source {catalogue.add_source(args.path)}")
    elif args.command == "rm":
        print(f"removed {catalogue.remove_source(args.path)} photos")
    elif args.command == "scan":
        say("scanned", catalogue.scan(say))
    elif args.command == "status":
        from pyspark.sql import functions as F

        total = catalogue.status().withColumn("disk", human_size(F.col("disk_bytes"))).withColumn("savings", human_size(F.col("savings_bytes"))).first()
        for name in ("photos", "unique", "groups", "duplicates", "disk", "savings"):
            print(f"  {name:12} {total[name]}")
        print(f"  {'pack':12} {catalogue.get_pack_path() or 'not configured'}")
        table(catalogue.sources_report().orderBy("id"))
    elif args.command == "ls":
        shown = catalogue.files() if not args.dupes else catalogue.group_list() if args.id is None else catalogue.group(args.id)
        table(shown)
    elif args.command == "pack":
        if args.path:
            catalogue.set_pack_path(args.path)
        say("packed", catalogue.pack(say))
    elif args.command == "export":
        say("exported", catalogue.export(args.path, args.quality, progress=say))


def main(argv: list[str] | None = None) -> int:
    """Entry point; returns the exit status."""
    args = parser().parse_args(argv)
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("lumendex").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        run(Catalogue.open(spark, args.catalog if "://" in args.catalog else f"file://{os.path.abspath(args.catalog)}"), args)
    except LumendexError as e:
        print(f"error: {type(e).__name__}: {e}", file=sys.stderr)
        return 1
    return 0
