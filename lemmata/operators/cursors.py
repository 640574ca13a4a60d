"""Which range owns a cursor."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lemmata.operators import relational


def owners(cursors: DataFrame, ranges: DataFrame, keys: list[str], cursor: str, at: str, range_id: str, kind: str, start: str, end: str) -> DataFrame:
    """(cursor, range, priority) of the range that owns each cursor; a cursor in none, or at a tie between different selections, has no row.

    Priorities: inside an occurrence 0, at its end 1, inside a selection 2, at its end 3, at the end of an
    application 4.  Inside, the narrower range wins; at an end, the wider.
    """
    touched = relational.inside(cursors, ranges.withColumn("_stop", F.col(end) + 1), keys, at, start, "_stop")
    edge = F.col(at) == F.col(end)
    priority = (
        F.when((F.col(kind) == "occurrence") & ~edge, 0).when((F.col(kind) == "occurrence") & edge, 1)
        .when((F.col(kind) == "selection") & ~edge, 2).when((F.col(kind) == "selection") & edge, 3)
        .when((F.col(kind) == "application") & edge, 4)
    )
    width = F.when(edge, F.col(start) - F.col(end)).otherwise(F.col(end) - F.col(start))
    ranked = touched.withColumn("priority", priority).filter("priority is not null").withColumn("_width", width)
    w = Window.partitionBy(cursor)
    best = ranked.withColumn("_r", F.rank().over(w.orderBy("priority", "_width"))).filter("_r = 1")
    spans = best.groupBy(cursor, "priority").agg(F.count_distinct(start, end).alias("_spans"), F.min(range_id).alias(range_id))
    return spans.filter("priority < 2 or _spans = 1").select(cursor, range_id, "priority")
