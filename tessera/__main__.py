"""Command line: inspect, stats, schema, validate, compare and convert.

    python -m tessera inspect data/events.parquet --rows 5
    python -m tessera convert in.csv out --from csv --to parquet
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from .operators.integrity import validate_table
from .operators.stats import report
from .plans.types import from_spark
from .sources import inspect
from .sources.table import Table, convert


def show(df, form: str) -> None:
    if form == "table":
        df.show(1000, truncate=False)
        return
    names = df.columns
    rows = df.toLocalIterator()
    if form == "csv":
        import csv

        out = csv.writer(sys.stdout)
        out.writerow(names)
        out.writerows([r[n] for n in names] for r in rows)
    else:
        for r in rows:
            print(json.dumps(r.asDict(recursive=True), default=str))


def main(args: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="tessera")
    parts = top.add_subparsers(dest="command", required=True)
    for name in ("inspect", "schema", "groups", "stats", "validate"):
        p = parts.add_parser(name)
        p.add_argument("path")
        p.add_argument("--kind", default="parquet", choices=("parquet", "csv", "json", "orc"))
        p.add_argument("--rows", type=int, default=10)
        p.add_argument("--position")
        p.add_argument("--size", type=int, default=100_000)
        p.add_argument("--output", default="table", choices=("table", "json", "csv"))
    p = parts.add_parser("compare")
    p.add_argument("old")
    p.add_argument("new")
    p.add_argument("--output", default="table", choices=("table", "json", "csv"))
    p = parts.add_parser("convert")
    p.add_argument("source")
    p.add_argument("target")
    p.add_argument("--from", dest="kind", default="parquet")
    p.add_argument("--to", default="parquet")
    p.add_argument("--every", type=int)
    p.add_argument("--position")
    a = top.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    if a.command == "convert":
        options = {"header": "true", "inferSchema": "true"} if a.kind == "csv" else {}
        convert(spark, a.source, a.kind, a.target, a.to, every=a.every, position=a.position, **options)
        return 0
    if a.command == "compare":
        old, new = (from_spark(spark.read.parquet(x).schema) for x in (a.old, a.new))
        show(inspect.compare_schemas(spark, old, new), a.output)
        return 0
    if a.command == "groups":
        show(inspect.file_row_groups(spark, a.path), a.output)
        return 0
    df = spark.read.options(header="true", inferSchema="true").format(a.kind).load(a.path)
    if a.command == "schema":
        print(inspect.extract_schema(df))
        return 0
    if a.command == "inspect":
        show((df.orderBy(a.position) if a.position else df).limit(a.rows), a.output)
        return 0
    if not a.position:
        top.error(f"{a.command} needs --position")
    table = Table(df, a.position, a.size)
    if a.command == "stats":
        show(report(table.statistics(), df.columns).orderBy("rg_id", "column_name"), a.output)
        return 0
    found = validate_table(table)
    show(found, a.output)
    return 0 if found.where("not ok").count() == 0 else 1


if __name__ == "__main__":
    sys.exit(main())
