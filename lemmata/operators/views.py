"""What is known at a cursor: the symbol, its meaning, its formula with laws and requirements, and diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lemmata.operators import definitions, graph, laws, parsed, relational
from lemmata.sources import syntax as front

#: Items of a view that are listed.
ITEMS = 16


def semantic_view(docs: DataFrame, cursors: DataFrame) -> DataFrame:
    """(cursor, symbol, status, description, concept, formula, laws, requirements, truncated) for cursors (cursor, file_id, at).

    A cursor in no symbol has nulls.  Requirements: a declaration for a symbol that is not established, one condition each that is
    not verified, sorted, at most ``ITEMS``.  The documents are parsed into stored rows
    once, and only files with a cursor are looked at.
    """
    some = docs.join(cursors.select("file_id").distinct(), "file_id", "left_semi")
    some = parsed.parsed(some)
    rows = front.syntax(some)
    symbols = rows.filter("kind = 'symbol'").select("file_id", F.col("start").alias("use"), (F.col("end") + 1).alias("stop"), F.col("text").alias("symbol"), "region")
    regions = rows.filter("kind = 'math'").select("file_id", "region", F.col("start").alias("formula"))
    inside = relational.inside(cursors, symbols, ["file_id"], "at", "use", "stop")
    order = Window.partitionBy("cursor").orderBy(F.col("stop") - F.col("use"), F.desc("use"))
    focus = inside.withColumn("_r", F.row_number().over(order)).filter("_r = 1").select("cursor", "file_id", "use", "symbol", "region").join(regions, ["file_id", "region"])
    known = definitions.definitions(some).select("file_id", F.col("anchor").alias("definition"), "description")
    roles = laws.declared_roles(some).select("file_id", F.col("anchor").alias("definition"), "concept").distinct()
    meaning = definitions.resolved_uses(some).select("file_id", "use", "status", "definition").join(known, ["file_id", "definition"], "left").join(roles, ["file_id", "definition"], "left")
    conditions = graph.stored(laws.condition_statuses(some))
    found = conditions.groupBy("file_id", F.col("at").alias("formula")).agg(F.array_sort(F.collect_set("law")).alias("laws"), F.array_sort(F.collect_set(F.when(F.col("status") != "verified", F.concat(F.lit("condition:"), "law", F.lit("/"), "kind")))).alias("_open"))
    out = focus.join(meaning, ["file_id", "use"], "left").join(found, ["file_id", "formula"], "left")
    needs = F.concat(F.when(F.col("status") != "established", F.array(F.concat(F.lit("declaration:"), "symbol"))).otherwise(F.array().cast("array<string>")), F.coalesce("_open", F.array().cast("array<string>")))
    out = out.withColumn("_needs", needs)
    view = out.select("cursor", "symbol", "status", "description", "concept", "formula", F.slice(F.coalesce("laws", F.array().cast("array<string>")), 1, ITEMS).alias("laws"), F.slice("_needs", 1, ITEMS).alias("requirements"), ((F.size("_needs") > ITEMS) | (F.coalesce(F.size("laws"), F.lit(0)) > ITEMS)).alias("truncated"))
    return cursors.select("cursor").join(view, "cursor", "left")
