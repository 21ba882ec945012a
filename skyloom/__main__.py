"""python -m skyloom VERB ...: regions, coverage, detect and report from the command line."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="skyloom")
    verbs = parser.add_subparsers(dest="verb", required=True)
    one = verbs.add_parser("regions", help="random regions off the galactic plane, as Parquet")
    one.add_argument("n", type=int)
    one.add_argument("out")
    one = verbs.add_parser("survey-status", help="coverage of the survey's pixels")
    one.add_argument("visited")
    one.add_argument("--nside", type=int, default=64)
    one = verbs.add_parser("detect", help="classes and verdicts of regions from catalog, cmd and points tables in a folder")
    one.add_argument("tables")
    one.add_argument("out")
    one.add_argument("--threshold", type=float, default=0.1)
    one = verbs.add_parser("report", help="a report page of findings")
    one.add_argument("findings")
    one.add_argument("folder")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("skyloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.verb == "regions":
        from skyloom.sources.survey import random_regions

        random_regions(spark, args.n).write.parquet(args.out)
    elif args.verb == "survey-status":
        from skyloom.sources.survey import coverage, survey_pixels

        coverage(survey_pixels(spark, args.nside), spark.read.parquet(args.visited)).show(truncate=False)
    elif args.verb == "detect":
        from skyloom.plans.detect import survey

        path = spark._jvm.org.apache.hadoop.fs.Path(args.tables)
        there = {s.getPath().getName() for s in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)}
        survey({t: spark.read.parquet(f"{args.tables}/{t}") for t in ("catalog", "cmd", "points") if t in there}, threshold=args.threshold).write.parquet(args.out)
    else:
        from skyloom.plans.report import Run, markdown

        findings = spark.read.parquet(args.findings)
        run = Run(spark, args.folder)
        run.json("findings.json", findings.orderBy(F.col("score").desc()))
        print(run.text("report.md", markdown(findings)))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
