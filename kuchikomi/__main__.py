"""Run one job: ``python -m kuchikomi JOB name=value ...`` (or the same through spark-submit)."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from kuchikomi.plans.jobs import JOBS
from kuchikomi.session import prepare


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="kuchikomi", description=__doc__)
    parser.add_argument("job", choices=sorted(JOBS), help="what to run")
    parser.add_argument("options", nargs="*", metavar="name=value", help="arguments of the job")
    parser.add_argument("--rows", type=int, default=40, help="report rows to show")
    given = parser.parse_args(arguments)
    options = dict(option.split("=", 1) for option in given.options)
    spark = prepare(SparkSession.builder.appName(f"kuchikomi {given.job}").getOrCreate())
    for name, report in JOBS[given.job](spark, **options).items():
        print(f"== {name}")
        report.show(given.rows, truncate=False)


if __name__ == "__main__":
    main()
