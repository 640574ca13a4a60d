"""References of a definition and rename plans: complete sets or a stated refusal, never a part."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lemmata.operators import definitions, graph, relational
from lemmata.sources import syntax as front

#: Occurrences beyond which a rename or a reference list is refused as a whole.
FAN_OUT = 4096


def references(docs: DataFrame, cap: int = FAN_OUT) -> DataFrame:
    """(file_id, definition, symbol, use, is_declaration, refusal) of established symbols; an entity over the cap gives one refusal row."""
    found = definitions.resolved_uses(docs).filter("status = 'established'").select("file_id", "definition", "symbol", "use")
    sizes = found.groupBy("file_id", "definition").agg(F.count("*").alias("n"), F.min("symbol").alias("_symbol"))
    refused = sizes.filter(F.col("n") > cap).select("file_id", "definition", F.col("_symbol").alias("symbol"), F.lit(None).cast("int").alias("use"), F.lit(None).cast("boolean").alias("is_declaration"), F.lit("engine-limit").alias("refusal"))
    whole = found.join(sizes.filter(F.col("n") <= cap).select("file_id", "definition"), ["file_id", "definition"], "left_semi")
    return whole.select("file_id", "definition", "symbol", "use", (F.col("use") == F.col("definition")).alias("is_declaration"), F.lit(None).cast("string").alias("refusal")).unionByName(refused)


def _plain(c: Column) -> Column:
    return c.rlike(r"^\p{L}$")


def _control(c: Column) -> Column:
    return c.rlike(r"^\\\p{L}+$")


def _visible(a: Column, b: Column) -> Column:
    """One scope is a prefix of the other."""
    n = F.least(F.size(a), F.size(b))
    return F.slice(a, F.lit(1), n) == F.slice(b, F.lit(1), n)


def renames(docs: DataFrame, requests: DataFrame, cap: int = FAN_OUT) -> DataFrame:
    """(request, refusal, edits) for requests (request, file_id, at, new_name), ``at`` being where a use starts.

    Edits are sorted starts, or null with a refusal.  Refusals in order: the symbol is not established; the name is
    unchanged; too many occurrences; an occurrence that cannot be edited; an invalid name; capture by another use of
    the name, resolved or not, in a scope that sees, or is seen by, an occurrence.  Only files with a
    request are parsed, once, into a stored table.
    """
    some = docs.join(requests.select("file_id").distinct(), "file_id", "left_semi")
    uses = graph.stored(definitions.resolved_uses(some, with_scope=True))
    target = requests.join(uses.select("file_id", F.col("use").alias("at"), "status", "definition", "symbol"), ["file_id", "at"], "left")
    known = uses.filter("status = 'established'")
    entity = known.groupBy("file_id", "definition").agg(F.array_sort(F.collect_list("use")).alias("edits"), F.bool_and(_plain(F.col("symbol")) | _control(F.col("symbol"))).alias("editable"))
    plan = target.join(entity, ["file_id", "definition"], "left")
    own = target.select("request", "file_id", "definition", "new_name").join(known.select("file_id", "definition", F.col("scope").alias("_own")), ["file_id", "definition"]).distinct()
    other = uses.select("file_id", F.coalesce("definition", F.lit(-1)).alias("_other"), F.col("symbol").alias("new_name"), F.col("scope").alias("_there")).distinct()
    taken = own.join(other, ["file_id", "new_name"]).filter((F.col("_other") != F.col("definition")) & _visible(F.col("_own"), F.col("_there"))).select("request").distinct().withColumn("captures", F.lit(True))
    plan = plan.join(taken, "request", "left")
    name, same_family = F.col("new_name"), F.when(_plain(F.col("symbol")), _plain(F.col("new_name"))).otherwise(_control(F.col("new_name")))
    refusal = (
        F.when(F.coalesce("status", F.lit("unsupported")) != "established", F.coalesce("status", F.lit("unsupported")))
        .when(name == F.col("symbol"), "invalid-replacement")
        .when(F.size("edits") > cap, "engine-limit")
        .when(~F.col("editable"), "non-editable")
        .when(~F.coalesce(same_family, F.lit(False)), "invalid-replacement")
        .when(F.col("captures"), "capture")
    )
    return plan.withColumn("refusal", refusal).select("request", "refusal", F.when(F.col("refusal").isNull(), F.col("edits")).alias("edits"))


def selections(docs: DataFrame, cursors: DataFrame) -> DataFrame:
    """(cursor, rank, kind, start, end): the ranges of a document around each cursor (cursor, file_id, at), innermost first."""
    some = docs.join(cursors.select("file_id").distinct(), "file_id", "left_semi")
    ranges = graph.stored(front.syntax(some).select("file_id", "kind", "start", "end"))
    held = relational.inside(cursors, ranges, ["file_id"], "at", "start", "end")
    order = Window.partitionBy("cursor").orderBy(F.col("end") - F.col("start"), "start", "kind")
    return held.select("cursor", F.row_number().over(order).alias("rank"), "kind", "start", "end")
