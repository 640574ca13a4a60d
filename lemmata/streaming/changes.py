"""Change logs: last write wins behind version fences, in batch and as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def last_write_wins(log: DataFrame, key: str, version: Column) -> DataFrame:
    """The row of greatest version per key; partial aggregation, so a busy key costs a row per task."""
    own = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*own), version).alias("_last")).select(key, *(F.col(f"_last.{c}").alias(c) for c in own))


def fenced(log: DataFrame, key: str, version: str, order: list[str]) -> DataFrame:
    """Adds ``accepted``: a change is accepted if its version exceeds all that came before it for its key; late ones are ignored."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.max(version).over(w)
    return log.withColumn("accepted", before.isNull() | (F.col(version) > before))


def upsert(state: DataFrame, changes: DataFrame, key: str, version: str, removed: str) -> DataFrame:
    """State after a batch of changes: newer versions replace, ``removed`` ones drop out, older ones are ignored."""
    rows = state.withColumn(removed, F.lit(False)).select(*changes.columns).unionByName(changes)
    return last_write_wins(rows, key, F.struct(version, removed)).filter(~F.col(removed)).select(*state.columns)


def run_changes(changes: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Feeds each micro-batch of a change stream to ``apply`` (for example an ``upsert`` that writes a new version)."""
    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
