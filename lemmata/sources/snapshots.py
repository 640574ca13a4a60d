"""Projects as JSON: documents of a snapshot, changes to them, and results as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A line of a snapshot: one document with what identifies the snapshot.
DOCUMENT = "epoch long, inventoryVersion long, projectId string, mainFileId string, fileId string, path string, language string, content string, documentVersion long"
#: A line of a change log: one change of an envelope, in order.
CHANGE = "epoch long, inventoryVersion long, ordinal int, kind string, fileId string, path string, content string, documentVersion long"
_NAMES = {"inventoryVersion": "inventory_version", "projectId": "project_id", "mainFileId": "main_file_id", "fileId": "file_id", "documentVersion": "document_version"}


def _read(df: DataFrame, column: str, schema: str) -> DataFrame:
    parsed = df.withColumn("_doc", F.from_json(column, schema)).select("_doc.*", F.col(column).alias("line"))
    return parsed.withColumnsRenamed(_NAMES)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a snapshot's files as documents; a line that is no document has nulls and its ``line``."""
    return _read(spark.read.text(path), "value", DOCUMENT)


def snapshot(lines: DataFrame, column: str = "value") -> DataFrame:
    """Documents of a table of lines."""
    return _read(lines, column, DOCUMENT)


def changes(lines: DataFrame, column: str = "value") -> DataFrame:
    return _read(lines, column, CHANGE)


def snapshot_faults(documents: DataFrame) -> DataFrame:
    """(file_id, fault): unreadable lines, documents without a version, files or paths named twice, main files that are missing."""
    bad = documents.filter("file_id is null or path is null").select("file_id", F.lit("unreadable").alias("fault"))
    good = documents.filter("file_id is not null and path is not null")
    unversioned = good.filter("document_version is null or document_version < 0").select("file_id", F.lit("no-version").alias("fault"))
    twice = good.groupBy("project_id", "file_id").count().filter("count > 1").select("file_id", F.lit("duplicate-file").alias("fault"))
    paths = good.groupBy("project_id", "path").agg(F.min("file_id").alias("file_id"), F.count_distinct("file_id").alias("n")).filter("n > 1").select("file_id", F.lit("duplicate-path").alias("fault"))
    mains = good.filter("main_file_id is not null").select("project_id", "main_file_id").distinct()
    missing = mains.join(good.select("project_id", F.col("file_id").alias("main_file_id")).distinct(), ["project_id", "main_file_id"], "left_anti").select(F.col("main_file_id").alias("file_id"), F.lit("missing-main-file").alias("fault"))
    return bad.unionByName(unversioned).unionByName(twice).unionByName(paths).unionByName(missing)


def apply_changes(state: DataFrame, log: DataFrame, epoch: int) -> DataFrame:
    """(file_id, path, content, document_version) after a log of upserts, path changes and removals.

    Changes of another epoch are refused.  They apply in the order of inventory and
    ordinal: an upsert counts if its version exceeds all that came before since the file was last removed; a path
    change keeps the content and needs a file; a removal ends it.
    """
    order = F.struct("inventory_version", "ordinal")
    first = state.select(F.lit(-1).cast("long").alias("inventory_version"), F.lit(0).alias("ordinal"), F.lit("upsert").alias("kind"), "file_id", "path", "content", "document_version")
    rows = first.unionByName(log.filter(F.col("epoch") == epoch).select(*first.columns)).withColumn("_at", order)
    file = Window.partitionBy("file_id")
    rows = rows.withColumn("_gone", F.max(F.when(F.col("kind") == "remove", F.col("_at"))).over(file)).filter(F.col("_gone").isNull() | (F.col("_at") > F.col("_gone")))
    before = F.max(F.when(F.col("kind") == "upsert", F.col("document_version"))).over(file.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_before", before)
    kept = rows.filter(F.when(F.col("kind") == "upsert", F.col("_before").isNull() | (F.col("document_version") > F.col("_before"))).otherwise(F.col("_before").isNotNull()))
    upsert = F.col("kind") == "upsert"
    last = kept.groupBy("file_id").agg(F.max_by("path", "_at").alias("path"), F.max(F.when(upsert, F.struct("_at", "content", "document_version"))).alias("_u"))
    return last.select("file_id", "path", "_u.content", "_u.document_version")


def replaced(index: DataFrame, updates: DataFrame, key: str, reference: str, target: DataFrame, target_key: str) -> DataFrame:
    """The index with the rows of the updates' keys replaced, or as it was if any new row refers to nothing: all or none.

    Whether a reference dangles is the one thing that reaches the driver.
    """
    dangling = updates.filter(F.col(reference).isNotNull()).join(target.select(F.col(target_key).alias(reference)), reference, "left_anti")
    if dangling.limit(1).count():
        return index
    return index.join(updates.select(key).distinct(), key, "left_anti").unionByName(updates.select(*index.columns))


def refreshed(resolutions: DataFrame, again: DataFrame, affected: DataFrame, key: str) -> DataFrame:
    """Resolutions where only those of the affected keys are taken anew."""
    return resolutions.join(affected, key, "left_anti").unionByName(again.join(affected, key, "left_semi").select(*resolutions.columns))


def binding_key(components) -> F.Column:
    """The key under which bindings of one notation meet: its components (kind, text) as JSON."""
    return F.to_json(components)


def as_json(df: DataFrame, column: str = "value") -> DataFrame:
    """Each row as a JSON object, for a text sink or a caller."""
    return df.select(F.to_json(F.struct(*df.columns)).alias(column))
