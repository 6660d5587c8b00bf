"""Command line: list the queries, show the SQL of one, or run it over a data folder.

    python -m graphloom list [prefix]
    python -m graphloom sql <query>
    python -m graphloom run <query> <folder> [--out <folder>] [--rows 20]
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from graphloom import plans


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    """Run one command; ``spark`` is the session to use, or one is made."""
    parser = argparse.ArgumentParser(prog="graphloom", description=__doc__.split("\n")[0])
    commands = parser.add_subparsers(dest="command", required=True)
    listed = commands.add_parser("list")
    listed.add_argument("prefix", nargs="?", default="")
    shown = commands.add_parser("sql")
    shown.add_argument("query", choices=sorted(plans.oracle_sql()), metavar="query")
    run = commands.add_parser("run")
    run.add_argument("query", choices=sorted(plans.queries()), metavar="query")
    run.add_argument("folder")
    run.add_argument("--out")
    run.add_argument("--rows", type=int, default=20)
    asked = parser.parse_args(args)
    if asked.command == "list":
        print("\n".join(sorted(k for k in plans.queries() if k.startswith(asked.prefix))))
    elif asked.command == "sql":
        print(plans.oracle_sql()[asked.query])
    else:
        found = plans.queries()[asked.query](spark or SparkSession.builder.getOrCreate(), asked.folder)
        if asked.out:
            found.write.parquet(asked.out)
        else:
            found.show(asked.rows, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
