"""Typed constraints over the formulas of a document: shapes, derived dimensions, comparisons.

Facts and formulas meet by one equi-join on the file; what a formula says is a
pure function of its text and those facts.  Unknown facts never conflict.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lemmata.functions import formulas, quantities, shapes, text
from lemmata.operators import definitions, graph, laws
from lemmata.sources import syntax as front

#: Rounds of propagation after which the result is reported as truncated.
ROUNDS = 8


def _mapped(df: DataFrame, names: list[str], row: Callable[..., list[tuple]], schema: str, kinds: list[pa.DataType]) -> DataFrame:
    """Rows that ``row`` gives for the values of the named columns, in Arrow batches."""
    out_names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [r for values in zip(*(b.column(c).to_pylist() for c in names)) for r in row(*values)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * len(kinds), kinds)], names=out_names)

    return graph.large(df.select(*names).mapInArrow(run, schema))


def _formulas(docs: DataFrame) -> DataFrame:
    return front.syntax(docs).filter("kind = 'math'").select("file_id", F.col("start").alias("at"), "text")


def declared_shapes(docs: DataFrame) -> DataFrame:
    """(file_id, symbol, anchor, scope, shape) of definitions whose description states a shape."""
    known = definitions.definitions(docs).withColumn("shape", text.shape(F.col("description")))
    return known.filter("shape.kind in ('scalar', 'vector', 'matrix')").select("file_id", "symbol", "anchor", "scope", "shape")


def shape_diagnostics(docs: DataFrame) -> DataFrame:
    """(file_id, code, at): products and sums of shapes that cannot fit, and redeclarations that differ from the latest before.

    A symbol that a file declares with differing shapes has no shape in its formulas.
    """
    known = declared_shapes(docs)
    facts = known.groupBy("file_id", "symbol").agg(F.min("shape").alias("shape"), F.max("shape").alias("_hi")).filter("shape = _hi")
    facts = facts.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("symbol", "shape"))).alias("facts"))

    def row(file_id, at, source, given):
        tree, faults = formulas.parse(source), set()
        if tree is None:
            return []
        have = {g["symbol"]: tuple(v for v in (g["shape"]["kind"], g["shape"]["rows"], g["shape"]["columns"]) if v is not None) for g in given}
        for one in tree[1:] if tree[0] == "system" else (tree,):
            shapes.shape(one, have, faults)
        return [(file_id, code, at) for code in sorted(faults)]

    found = _mapped(_formulas(docs).join(facts, "file_id"), ["file_id", "at", "text", "facts"], row, "file_id string, code string, at int", [pa.string(), pa.string(), pa.int32()])
    before = F.lag("shape").over(Window.partitionBy("file_id", "symbol", "scope").orderBy("anchor"))

    def differs(c: str):
        a, b = F.col(f"shape.{c}"), F.col(f"before.{c}")
        return a.rlike("^[0-9]+$") & b.rlike("^[0-9]+$") & (a != b)

    again = known.withColumn("before", before).filter("before is not null")
    again = again.filter((F.col("shape.kind") != F.col("before.kind")) | F.coalesce(differs("rows"), F.lit(False)) | F.coalesce(differs("columns"), F.lit(False)))
    return found.unionByName(again.select("file_id", F.lit("notation-shape-conflict").alias("code"), F.col("anchor").alias("at")))


def _said(tree: tuple, known: dict[str, dict]) -> dict[str, dict]:
    """Dimensions that a tree gives to its symbols of unknown dimension: across = and among the terms of a sum."""
    out: dict[str, dict] = {}
    for child in tree[1:]:
        if isinstance(child, tuple):
            out |= _said(child, known)
    if tree[0] in ("equals", "sum"):
        given = [d for c in tree[1:] if (d := formulas.dimension(c, known, set())) is not None]
        if given and all(d == given[0] for d in given):
            for child in tree[1:]:
                while child[0] == "negate":
                    child = child[1]
                if child[0] == "sym" and child[1] not in known:
                    out.setdefault(child[1], given[0])
    return out


def derived_dimensions(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(file_id, symbol, dimension, round, truncated): declared dimensions (round 0) and those that formulas imply.

    The first proof counts: the least round, and there the first formula.  Each
    round is stored; only whether a row was new reaches the driver.
    """
    dims = F.broadcast(quantities.kinds(docs.sparkSession))
    declared = laws.declared_quantities(docs).filter("kind is not null").groupBy("file_id", "symbol").agg(F.min("kind").alias("kind"), F.max("kind").alias("_hi")).filter("kind = _hi")
    facts = graph.stored(declared.join(dims, "kind").select("file_id", "symbol", "dimension", F.lit(0).alias("round")))
    maths = graph.stored(_formulas(docs).filter("text like '%=%' or text like '%+%' or text like '%-%'"))

    def row(file_id, at, source, given):
        tree = formulas.parse(source)
        have = {g["symbol"]: quantities.named_dimension(g["dimension"]) for g in given}
        return [(file_id, s, quantities.dimension_name(d), at) for s, d in sorted(_said(tree, have).items())] if tree else []

    found, latest, truncated = [facts], facts, False
    for n in range(1, rounds + 2):
        facts = found[0]
        for f in found[1:]:
            facts = facts.unionByName(f)
        # only files in which the round before found something
        known = facts.join(latest.select("file_id").distinct(), "file_id", "left_semi").groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("symbol", "dimension"))).alias("facts"))
        new = _mapped(maths.join(known, "file_id"), ["file_id", "at", "text", "facts"], row, "file_id string, symbol string, dimension string, at int", [pa.string(), pa.string(), pa.string(), pa.int32()])
        new = new.groupBy("file_id", "symbol").agg(F.min_by("dimension", F.struct("at", "dimension")).alias("dimension")).withColumn("round", F.lit(n))
        latest = graph.stored(new)
        if not latest.limit(1).count():
            break
        if n > rounds:
            truncated = True
            break
        found.append(latest)
    facts = found[0]
    for f in found[1:]:
        facts = facts.unionByName(f)
    return facts.withColumn("truncated", F.lit(truncated))


# The comparisons that cannot hold together with each comparison of the same sides.
EXCLUDES = {
    "equals": ("not-equals", "less-than", "greater-than"),
    "not-equals": ("equals",),
    "less-than": ("equals", "greater-than", "greater-or-equal"),
    "less-or-equal": ("greater-than",),
    "greater-than": ("equals", "less-than", "less-or-equal"),
    "greater-or-equal": ("less-than",),
}
_TURNED = {"less-than": "greater-than", "greater-than": "less-than", "less-or-equal": "greater-or-equal", "greater-or-equal": "less-or-equal"}


def comparisons(docs: DataFrame) -> DataFrame:
    """(file_id, at, relation, left, right, scope) of asserted comparisons, sides in the order of their keys."""

    def row(file_id, content):
        if not content:
            return []
        live, units, out = front.masked(content), front.utf16(content), []
        for r in front.parse(content):
            if r[0] != "math" or (tree := formulas.parse(r[4])) is None or not definitions.asserted(live, r[2], r[3]):
                continue
            for one in tree[1:] if tree[0] == "system" else (tree,):
                if one[0] in EXCLUDES:
                    relation, left, right = one[0], formulas.canonical(one[1]), formulas.canonical(one[2])
                    if left > right:
                        relation, left, right = _TURNED.get(relation, relation), right, left
                    out.append((file_id, units[r[2]], relation, left, right, r[5]))
        return out

    schema = "file_id string, at int, relation string, left string, right string, scope array<int>"
    return _mapped(graph.dealt(docs.select("file_id", "content")), ["file_id", "content"], row, schema, [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.list_(pa.int32())])


def _excluded(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a, b) for a, rest in EXCLUDES.items() for b in rest], "relation string, other string")


def comparison_conflicts(docs: DataFrame) -> DataFrame:
    """(file_id, code, left, right, first, second): comparisons of one scope, or of a scope and one inside it, that exclude each other.

    Rows are one per relation and scope before they meet, so a key joins at most six with six.
    """
    each = comparisons(docs).groupBy("file_id", "left", "right", "relation", "scope").agg(F.min("at").alias("at"))
    prefixes = F.transform(F.sequence(F.lit(0), F.size("scope")), lambda n: F.slice("scope", F.lit(1), n))
    inner = each.withColumn("seen", F.explode(prefixes)).join(F.broadcast(_excluded(docs.sparkSession)), "relation")
    inner = inner.select("file_id", "left", "right", F.col("other").alias("relation"), F.col("seen").alias("scope"), F.col("at").alias("inner_at"), F.col("relation").alias("inner_relation"))
    pairs = inner.join(each, ["file_id", "left", "right", "relation", "scope"])
    ends = F.array_sort(F.array(F.struct("at", "relation"), F.struct(F.col("inner_at").alias("at"), F.col("inner_relation").alias("relation"))))
    out = pairs.select("file_id", F.lit("constraint-comparison-conflict").alias("code"), "left", "right", ends[0]["at"].alias("first"), ends[1]["at"].alias("second"))
    return out.distinct()
