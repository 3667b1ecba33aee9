"""python -m gridloom list | run NAME FOLDER OUT | explain NAME FOLDER | load ARCHIVES ROOT"""

from __future__ import annotations

import argparse

from gridloom.plans import registry
from gridloom.session import build_session


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="gridloom", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list")
    run = commands.add_parser("run")
    run.add_argument("name")
    run.add_argument("folder")
    run.add_argument("out")
    explain = commands.add_parser("explain")
    explain.add_argument("name")
    explain.add_argument("folder")
    load = commands.add_parser("load")
    load.add_argument("archives")
    load.add_argument("root")
    args = parser.parse_args(argv)
    if args.command == "list":
        print(*sorted(registry.queries()), sep="\n")
        return 0
    spark = build_session("gridloom")
    if args.command == "run":
        registry.queries()[args.name](spark, args.folder).write.mode("overwrite").parquet(args.out)
    elif args.command == "explain":
        registry.queries()[args.name](spark, args.folder).explain("formatted")
    else:
        from gridloom.sources import warehouse

        warehouse.load(spark, args.archives, args.root).show(truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
