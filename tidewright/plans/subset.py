"""python -m tidewright.plans.subset IN OUT: a compact subset of a panel in Parquet, written as CSV or Parquet by OUT's suffix."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from tidewright.operators.clean import compact_subset
from tidewright.schema import numeric_columns
from tidewright.session import local_session
from tidewright.sources.panel import write_table


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="subset", description=__doc__)
    parser.add_argument("source")
    parser.add_argument("out")
    parser.add_argument("--target", default="ret")
    parser.add_argument("--id", default="permno")
    parser.add_argument("--month", default="month")
    parser.add_argument("--factors", type=int, default=10)
    parser.add_argument("--ids", type=int, default=20)
    parser.add_argument("--years", type=int, default=10)
    o = parser.parse_args(args)
    panel = (spark or local_session("subset")).read.parquet(o.source)
    factors = numeric_columns(panel, (o.id, o.month, o.target))
    write_table(compact_subset(panel, factors, o.target, o.factors, o.ids, o.years, o.month, o.id), o.out)


if __name__ == "__main__":
    main()
