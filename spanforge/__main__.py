"""Command line: `python -m spanforge validate PATTERN...` and `python -m spanforge inspect FOLDER`."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanforge.functions.vocabulary import one_hot
from spanforge.operators import corpus, multilabel, split
from spanforge.sources import packages


def inspection(spark: SparkSession, folder: str, seed: int = 13) -> DataFrame:
    """(section, part, name, n) of the annotation packages below a folder: what was loaded and skipped, and a split of it.

    Counts only; rows stay where they are.
    """
    rows = packages.load_examples(packages.read_packages(spark, folder))
    rows = rows.withColumns({"collection": F.lit("package"), "unknown": F.array().cast("array<string>")})
    rows = rows.withColumn("problem", F.coalesce("problem", F.when(F.col("text") == "", "empty_text")))
    merged = corpus.merged_examples(corpus.union_in_order(rows))
    report = corpus.load_report(rows, merged).select(F.lit("load").alias("section"), F.lit(None).cast("string").alias("part"), F.concat_ws(": ", "counter", "name").alias("name"), "n")
    parts = split.iterative_split(merged, seed).join(merged.select("collection", "example_id", one_hot(F.col("values")).alias("gold")), ["collection", "example_id"])
    summary = multilabel.split_summary(parts).select(F.lit("split").alias("section"), "part", F.concat_ws(": ", "kind", F.when(F.col("name") != "", F.col("name"))).alias("name"), "n")
    return report.unionByName(summary)


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="spanforge")
    commands = parser.add_subparsers(dest="command", required=True)
    check = commands.add_parser("validate", help="check files of records")
    check.add_argument("patterns", nargs="+")
    check.add_argument("--max-issues", type=int, default=20)
    look = commands.add_parser("inspect", help="count what annotation packages hold")
    look.add_argument("folder")
    look.add_argument("--seed", type=int, default=13)
    options = parser.parse_args(arguments)
    spark = spark or SparkSession.builder.appName("spanforge").getOrCreate()
    if options.command == "validate":
        lines, code = packages.validate(spark, options.patterns, options.max_issues)
        for r in lines.toLocalIterator():
            print(r.text)
        return code
    for r in inspection(spark, options.folder, options.seed).orderBy("section", "part", F.desc("n"), "name").toLocalIterator():
        print(json.dumps({k: v for k, v in r.asDict().items() if v is not None}, ensure_ascii=False))
    return 0


if __name__ == "__main__":
    sys.exit(main())
