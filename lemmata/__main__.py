"""``python -m lemmata QUERY TABLES OUT``: runs a registered query over a folder of tables and writes its rows as JSON lines."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from lemmata import registry
from lemmata.sources import snapshots


def main() -> None:
    parser = argparse.ArgumentParser(prog="lemmata", description=__doc__)
    parser.add_argument("query", choices=sorted(registry.queries()))
    parser.add_argument("tables")
    parser.add_argument("out")
    given = parser.parse_args()
    spark = SparkSession.builder.appName("lemmata").getOrCreate()
    snapshots.as_json(registry.queries()[given.query](spark, given.tables)).write.text(given.out)
    spark.stop()


if __name__ == "__main__":
    main()
