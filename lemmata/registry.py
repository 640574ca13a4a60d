"""All registered queries of the core library."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lemmata.plans import formal, generated, inputs, kernel, meaning, reasoning  # noqa: F401  (the others register their queries with the kernel)

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return dict(kernel.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(kernel.ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definition look-up end to end: front-end, definitions, scope-prefix join, resolution."""
    return generated.part_resolutions(spark, sf_dir)
