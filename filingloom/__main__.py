"""Runs registered queries from a shell: ``python -m filingloom list`` or ``python -m filingloom run QUERY DIR [--out DIR] [--force]``."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import SparkSession

from filingloom.plans import registry


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="filingloom", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("list", help="names of the queries, with what they do")
    run = sub.add_parser("run", help="runs queries over a folder of Parquet tables")
    run.add_argument("queries", nargs="+")
    run.add_argument("tables", help="folder of the tables")
    run.add_argument("--out", help="folder to write results to; without it twenty rows are shown")
    run.add_argument("--force", action="store_true", help="replaces results that are there; else they are skipped")
    run.add_argument("--master", default="local[*]")
    return p


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args, found = parser().parse_args(arguments), registry.queries()
    if args.command == "list":
        for name, query in sorted(found.items()):
            print(f"{name:24} {(query.__doc__ or '').splitlines()[0]}")
        return 0
    unknown = [q for q in args.queries if q not in found]
    if unknown:
        print(f"no such query: {', '.join(unknown)}")
        return 2
    spark = spark or SparkSession.builder.master(args.master).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    for name in args.queries:
        place = os.path.join(args.out, name) if args.out else None
        if place and os.path.exists(place) and not args.force:
            print(f"{name}: skipped, {place} is there")
            continue
        df = found[name](spark, args.tables)
        if place:
            df.write.mode("overwrite").parquet(place)
            print(f"{name}: written to {place}")
        else:
            df.show(20, truncate=60)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
