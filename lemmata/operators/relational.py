"""Relational kernels: scope-prefix, containment, as-of and conflict joins, capped top-k, keyed selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lemmata.operators import graph


def visible_bindings(uses: DataFrame, bindings: DataFrame, keys: list[str], use_path: str, binding_path: str) -> DataFrame:
    """Bindings whose scope path is a prefix of a use's path.

    The prefixes of each use path are exploded, so the prefix test is a hash
    equi-join; an empty path is a prefix of every path.
    """
    prefixes = F.transform(F.sequence(F.lit(0), F.size(use_path)), lambda k: F.slice(F.col(use_path), F.lit(1), k))
    spread = uses.withColumn("_prefix", F.explode(prefixes))
    return spread.join(bindings.withColumnRenamed(binding_path, "_prefix"), [*keys, "_prefix"]).withColumnRenamed("_prefix", binding_path)


def tightest_container(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, start: str, end: str, point_id: str, rank: Column) -> DataFrame:
    """Per point the half-open interval that holds it and has the greatest ``rank``; points in none have nulls."""
    own = [c for c in intervals.columns if c not in keys]
    best = inside(points.select(*keys, at, point_id), intervals, keys, at, start, end).groupBy(point_id).agg(F.max_by(F.struct(*own), rank).alias("_best"))
    return points.join(graph.large(best), point_id, "left").select(*points.columns, *(F.col(f"_best.{c}").alias(c) for c in own))


def inside(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, start: str, end: str) -> DataFrame:
    """Points joined to the half-open intervals of their keys that hold them, by equality on bins.

    An interval lies in at most two bins of the least power of two that is as long as
    it; a point looks once into each width that occurs (at most 64), so neither long
    intervals nor many short ones multiply rows, and a key of many rows is spread over its bins.
    """
    bins = graph.large(intervals).filter(F.col(end) > F.col(start)).withColumn("_level", F.ceil(F.log2((F.col(end) - F.col(start)).cast("double"))).cast("int"))
    levels = sorted(r[0] for r in bins.select("_level").distinct().collect())  # widths, not rows: 64 at most
    shift = lambda c: F.call_function("shiftright", c, F.col("_level"))
    bins = bins.withColumn("_bin", F.explode(F.array_distinct(F.array(shift(F.col(start).cast("long")), shift(F.col(end).cast("long") - 1)))))
    looks = points.withColumn("_level", F.explode(F.array(*(F.lit(n) for n in levels)).cast("array<int>"))).withColumn("_bin", shift(F.col(at).cast("long")))
    return looks.join(bins, [*keys, "_level", "_bin"]).filter((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_level", "_bin")


def latest_before(events: DataFrame, keys: list[str], order: list[str], is_source: Column, value: Column) -> Column:
    """The value of the latest source row before each row of its key (null if none); one sort per key serves all rows."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.last(F.when(is_source, value), ignorenulls=True).over(w)


def capped(df: DataFrame, keys: list[str], order: list[Column], cap: int) -> DataFrame:
    """The first ``cap`` rows of each key by a total order, with ``truncated`` telling whether more existed."""
    w = Window.partitionBy(*keys)
    ranked = df.withColumn("rank", F.row_number().over(w.orderBy(*order))).withColumn("truncated", F.count(F.lit(1)).over(w) > cap)
    return ranked.filter(F.col("rank") <= cap)


def all_or_nothing(df: DataFrame, keys: list[str], cap: int) -> DataFrame:
    """All rows of keys with at most ``cap`` rows; a key with more gives none (its refusal is ``refused_keys``)."""
    return df.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).filter(F.col("_n") <= cap).drop("_n")


def refused_keys(df: DataFrame, keys: list[str], cap: int) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > cap)


def keep_best(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first by a total order."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")


def conflict_pairs(df: DataFrame, keys: list[str], id_col: str, value: str) -> DataFrame:
    """Pairs (first, second) of distinct values under one key, each value by its least id.

    Values are grouped first, so a key whose rows agree costs one row however
    many there are.
    """
    values = df.groupBy(*keys, value).agg(F.min(id_col).alias("id"))
    a = values.select(*keys, F.col(value).alias("first_value"), F.col("id").alias("first"))
    b = values.select(*keys, F.col(value).alias("second_value"), F.col("id").alias("second"))
    return a.join(b, keys).filter(F.col("first") < F.col("second"))


def dangling(child: DataFrame, parent: DataFrame, reference: str, key: str) -> DataFrame:
    """Rows whose reference is not null and names no parent."""
    return child.filter(F.col(reference).isNotNull()).join(parent.select(F.col(key).alias(reference)), reference, "left_anti")


def overlaps(intervals: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Intervals that begin before an earlier one of their key has ended."""
    w = Window.partitionBy(*keys).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    return intervals.withColumn("reach", F.max(end).over(w)).filter(F.col(start) < F.col("reach"))
