"""Laws over the files of a project: what a file defines holds for formulas that come later in the order of the project."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lemmata.operators import graph, laws, parsed, project
from lemmata.sources import packs
from lemmata.sources import syntax as front


def roles_across(docs: DataFrame | front.Parsed, uses: DataFrame, parts: DataFrame, given: packs.Catalogue | None = None) -> DataFrame:
    """(main, file_id, at, symbol, concept): for uses (file_id, at, symbol) what the latest definition of the symbol before them says, in the order of each project.

    ``parts`` are the segments of the projects' files.  A definition counts from where it ends.  Uses and definitions in files without a place have none.
    """
    docs = parsed.parsed(docs)
    known = laws.declared_roles(docs, given).filter("concept is not null").join(docs.definitions.select("file_id", "symbol", "anchor", "available"), ["file_id", "symbol", "anchor"])
    facts = project.in_order(known.select(F.col("file_id").alias("file"), "symbol", "available", F.struct("concept").alias("fact")), parts, "available", "since")
    asked = project.in_order(uses.select(F.col("file_id").alias("file"), "at", "symbol"), parts, "at", "place").withColumn("use", F.struct("main", "file", "at", "symbol"))
    met = project.facts_across(asked, facts, ["main", "symbol"], "place", "since", "use", "fact")
    return met.select("use.main", F.col("use.file").alias("file_id"), "use.at", "use.symbol", "fact.concept")


def project_laws(docs: DataFrame | front.Parsed, mains: DataFrame, includes: DataFrame, given: packs.Catalogue | None = None) -> DataFrame:
    """(main, file_id, at, scope, law, support, form, guards, step, roles): laws of formulas, with what earlier files of the project define of symbols that the formula's own file does not.

    Rows: docs (file_id, content), mains (main), includes (file, offset, included).
    """
    docs, own = parsed.parsed(docs), laws.catalogue(docs, given)
    found = laws.matches(docs.trees, own)
    local = graph.stored(laws.agreed(laws.declared_roles(docs, own)))
    uses = graph.stored(laws.role_symbols(docs.trees, found).select("file_id", "at", "symbol").distinct())
    parts = graph.stored(project.segments(mains, includes))
    spoken = docs.definitions.select("file_id", "symbol").distinct()
    outer = roles_across(docs, uses.join(spoken, ["file_id", "symbol"], "left_anti"), parts, own)
    names = parts.select("main", F.col("file").alias("file_id")).distinct()
    near = uses.join(local, ["file_id", "symbol"]).join(names, "file_id").select("main", "file_id", "at", "symbol", "concept")
    # one project's view of a file is a file of its own here
    key = F.to_json(F.struct("main", F.col("file_id").alias("file")))
    both = graph.stored(near.unionByName(outer.select(*near.columns)))
    whole = docs.trees.join(names, "file_id").withColumn("_key", key).withColumn("file_id", F.col("_key")).drop("_key", "main")
    have = both.withColumn("_key", key).select(F.col("_key").alias("file_id"), "at", "symbol", "concept")
    out = laws.supported(whole, found, have, own)
    back = F.from_json("file_id", f"main {dict(mains.dtypes)['main']}, file string")
    return out.withColumn("_p", back).select("_p.main", F.col("_p.file").alias("file_id"), *[c for c in out.columns if c != "file_id"])
