"""python -m podium.cli list | run QUERY FOLDER [--out PATH] | strategy NAME FOLDER_OF_TASK_JSON --out PATH"""

from __future__ import annotations

import argparse


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="podium", description=__doc__)
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("list", help="names of all queries")
    run = sub.add_parser("run", help="run a query over a folder of tables")
    run.add_argument("query")
    run.add_argument("folder")
    run.add_argument("--out", help="write Parquet here instead of showing rows")
    strategy = sub.add_parser("strategy", help="derive task inputs by a named strategy")
    strategy.add_argument("name")
    strategy.add_argument("folder")
    strategy.add_argument("--out", required=True)
    args = parser.parse_args(argv)

    from .plans import catalog

    if args.command == "list":
        print("\n".join(sorted(catalog.queries())))
        return 0
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("podium").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.command == "run":
        df = catalog.queries()[args.query](spark, args.folder)
    else:
        from .operators import strategies
        from .operators.tasks import TASK

        df = strategies.apply(spark.read.schema(f"t {TASK}").json(args.folder).select("t.*"), args.name)
    df.write.mode("overwrite").parquet(args.out) if args.out else df.show(50, truncate=False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
