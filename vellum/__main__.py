"""python -m vellum: lists queries, runs one into a folder, or writes a settings file."""

import argparse

from pyspark.sql import SparkSession


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="vellum", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="names of all queries")
    run = commands.add_parser("run", help="run a query over a folder of tables")
    run.add_argument("query")
    run.add_argument("tables")
    run.add_argument("out")
    run.add_argument("--format", default="parquet", choices=["parquet", "json", "csv"])
    commands.add_parser("init-config", help="write a settings file").add_argument("out")
    given = parser.parse_args(args)
    from vellum.plans.queries import QUERIES
    from vellum.sources import writers

    if given.command == "list":
        print("\n".join(QUERIES))
        return
    spark = SparkSession.builder.getOrCreate()
    if given.command == "run":
        if given.query not in QUERIES:
            parser.error(f"unknown query: {given.query}")
        QUERIES[given.query](spark, given.tables).write.format(given.format).mode("overwrite").save(given.out)
    else:
        writers.write_file(spark, given.out, writers.default_settings())


if __name__ == "__main__":
    main()
