"""Bound symbols: the scopes of sums, products, limits, integrals and quantifiers as nested intervals, innermost first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_KEYS = ["file_id", "region", "text"]


def _met(rows: DataFrame) -> DataFrame:
    """Symbols in scopes that bind them, or that declare them; rows are those of the front-end."""
    uses = rows.filter("kind = 'symbol'").select(*_KEYS, F.col("start").alias("use"))
    scopes = rows.filter("kind = 'binder'").select(*_KEYS, "declared", "start", "end")
    return uses.join(scopes, _KEYS).filter((F.col("use") == F.col("declared")) | ((F.col("use") >= F.col("start")) & (F.col("use") < F.col("end"))))


def attributed(rows: DataFrame) -> DataFrame:
    """(file_id, region, symbol, use, declared, is_declaration): each bound use and the binder that owns it, the one declared last and, of those, the narrowest."""
    owner = F.max_by("declared", F.struct("declared", -(F.col("end") - F.col("start"))))
    best = _met(rows).groupBy("file_id", "region", F.col("text").alias("symbol"), "use").agg(owner.alias("declared"))
    return best.withColumn("is_declaration", F.col("use") == F.col("declared"))


def free_uses(rows: DataFrame) -> DataFrame:
    """The symbols of the front-end's rows that no binder owns."""
    bound = _met(rows).select("file_id", F.col("use").alias("start")).distinct()
    return rows.filter("kind = 'symbol'").join(bound, ["file_id", "start"], "left_anti").select(*rows.columns)
