"""One constraint system over all predicates of entities: semi-naive rounds over the relations that formulas claim.

Facts are rows (entity, predicate, text, dim, shape) with one value for each entity and predicate; predicates are ``dimension``,
``shape``, ``unit``, ``role``, ``condition:…``, ``domain`` and ``codomain``.  Relations are rows (relation, kind, result, left, right, num,
den).  A round looks only at relations with a side that the round before found something for; what it finds is a stored table of
its own with the relation that proves it, and the first proof counts: the least round, and there the least relation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lemmata.functions import dimensions
from lemmata.operators import facts as rules
from lemmata.operators import graph

#: Rounds, and relations and predicates of a file that are looked at over all rounds; beyond either a file is truncated.
ROUNDS, WORK = 8, 200_000
DIM = "array<struct<base: string, num: bigint, den: bigint>>"
SHAPE = "struct<kind: string, rows: string, columns: string>"
# Kinds of relations whose sides share a dimension, a shape, a unit; and those that share everything.
SAME_DIMENSION = ("equal", "sum", "negate", "transpose")
SAME_SHAPE = ("equal", "sum", "negate")
SAME_UNIT = ("equal", "sum", "negate", "transpose")


def fact(predicate: Column | str, text: Column | None = None, dim: Column | None = None, shape: Column | None = None) -> list[Column]:
    """The columns of a fact beside its entity."""
    none = F.lit(None)
    spelt = text if text is not None else dimensions.dimension_text(dim) if dim is not None else shape_text(shape)
    return [(F.lit(predicate) if isinstance(predicate, str) else predicate).alias("predicate"), spelt.alias("text"), (none if dim is None else dim).cast(DIM).alias("dim"), (none if shape is None else shape).cast(SHAPE).alias("shape")]


def shape_text(c: Column) -> Column:
    """A shape such as ``matrix(2,3)``."""
    return F.concat(c["kind"], F.when(c["rows"].isNotNull(), F.concat(F.lit("("), F.concat_ws(",", c["rows"], c["columns"]), F.lit(")"))).otherwise(F.lit("")))


def _channel() -> Column:
    """Predicates that are looked at together: signatures of functions give shapes."""
    return F.when(F.col("predicate").isin("domain", "codomain"), "shape").otherwise(F.col("predicate"))


def _implied(have: DataFrame) -> DataFrame:
    """(relation, entity, predicate, text, dim, shape) that relations with their sides' values imply; ``have`` has a value of each side by name."""
    dim, shape, text = (lambda s: F.col(f"{s}.dim")), (lambda s: F.col(f"{s}.shape")), (lambda s: F.col(f"{s}.text"))
    kind, no = F.col("kind"), F.lit(None)
    sign = F.when(kind.isin("quotient", "derivative"), -1).otherwise(1)
    folded = F.when(kind.isin("product", "dot", "cross", "integral", "quotient", "derivative"), dimensions.combined(dim("_left"), dim("_right"), sign))
    up_dim = F.when(kind.isin(*SAME_DIMENSION), dim("_left")).when(kind == "power", dimensions.scaled(dim("_left"), F.col("num"), F.col("den"))).otherwise(folded)
    down_dim = F.when(kind.isin(*SAME_DIMENSION), dim("_result")).when((kind == "power") & (F.col("num") != 0), dimensions.scaled(dim("_result"), F.col("den"), F.col("num")))
    shaped = rules.shape_of(F.when(kind == "integral", "derivative").otherwise(kind), shape("_left"), shape("_right"))
    up_shape = F.when(kind.isin(*SAME_SHAPE) | (kind == "trajectory"), shape("_left")).when(kind == "application", shape("_codomain")).otherwise(shaped)
    turned = F.when(shape("_result")["kind"] == "matrix", F.struct(F.lit("matrix").alias("kind"), shape("_result")["columns"].alias("rows"), shape("_result")["rows"].alias("columns")))
    down_shape = F.when(kind.isin(*SAME_SHAPE), shape("_result")).when(kind == "transpose", turned)
    shared = (kind == "equal") | ((F.col("channel") == "unit") & kind.isin(*SAME_UNIT))
    made = []
    for target, known, d, s, t in (("result", "_result", up_dim, up_shape, text("_left")), ("left", "_left", down_dim, down_shape, text("_result")), ("right", "_right", no.cast(DIM), F.when(kind == "application", shape("_domain")), no.cast("string"))):
        d_ = F.when(F.col("channel") == "dimension", d.cast(DIM))
        s_ = F.when(F.col("channel") == "shape", s.cast(SHAPE))
        t_ = F.when(F.col("channel") == "dimension", dimensions.dimension_text(d_)).when(F.col("channel") == "shape", shape_text(s_)).when(shared, t)
        made.append(F.struct(F.col(target).alias("entity"), F.col(known).isNull().alias("new"), t_.alias("text"), d_.alias("dim"), s_.alias("shape")))
    rows = have.select("relation", F.col("channel").alias("predicate"), F.explode(F.array(*made)).alias("m"))
    return rows.filter("m.new and m.entity is not null and m.text is not null").select("relation", "m.entity", "predicate", "m.text", "m.dim", "m.shape")


def solved(facts: DataFrame, relations: DataFrame, rounds: int = ROUNDS, work: int = WORK) -> DataFrame:
    """(entity, predicate, text, dim, shape, round, proof, truncated): given facts (round 0, without proof) and those that relations imply.

    An entity is a struct with a ``file_id``; ``relation`` is one that orders relations.  A file is truncated if it would go on after
    ``rounds``, or if more than ``work`` of its relations and predicates have been looked at; what it has by then stands.
    """
    relations = graph.large(graph.stored(relations))
    columns = ["entity", "predicate", "text", "dim", "shape"]
    sides = graph.large(graph.stored(relations.select("relation", "kind", F.explode(F.array(*(F.struct(F.lit(c).alias("side"), F.col(c).alias("entity")) for c in ("result", "left", "right")))).alias("s")).filter("s.entity is not null").select("relation", "kind", "s.side", "s.entity")))
    latest = graph.stored(facts.groupBy("entity", "predicate").agg(*(F.min_by(c, "text").alias(c) for c in columns[2:])).withColumns({"round": F.lit(0), "proof": F.lit(None).cast(relations.schema["relation"].dataType)}))
    found, looked, over = [latest], [], None
    total = 0
    for n in range(1, rounds + 2):
        known = found[0]
        for f in found[1:]:
            known = known.unionByName(f)
        known = graph.large(known)
        touched = graph.stored(latest.select("entity", _channel().alias("channel")).join(sides.select("relation", "entity"), "entity").select("relation", "channel", F.col("entity.file_id").alias("file_id")).distinct())
        looked.append(touched)
        total += touched.count()
        if total > work:  # some file may have done its share
            sums = looked[0]
            for t in looked[1:]:
                sums = sums.unionByName(t)
            over = graph.stored(sums.groupBy("file_id").count().filter(F.col("count") > work).select("file_id"))
            touched = touched.join(over, "file_id", "left_anti")
        near = sides.join(touched.select("relation", "channel"), "relation").join(known.select("entity", _channel().alias("channel"), "predicate", F.struct("text", "dim", "shape").alias("value")), ["entity", "channel"])
        # a function gives its signature, not its shape, to its applications
        side = F.when((F.col("kind") == "application") & (F.col("side") == "left"), F.col("predicate")).otherwise(F.col("side"))
        of = lambda c: F.first(F.when(F.col("_side") == c, F.col("value")), ignorenulls=True).alias(f"_{c}")
        have = near.filter((F.col("predicate") == F.col("channel")) | (F.col("kind") == "application")).withColumn("_side", side).groupBy("relation", "channel").agg(*map(of, ("result", "left", "right", "domain", "codomain")))
        new = _implied(have.join(relations, "relation")).join(known.select("entity", "predicate"), ["entity", "predicate"], "left_anti")
        new = new.groupBy("entity", "predicate").agg(*(F.min_by(c, "relation").alias(c) for c in columns[2:]), F.min("relation").alias("proof")).withColumn("round", F.lit(n))
        latest = graph.stored(new.select(*columns, "round", "proof"))
        if not latest.limit(1).count():
            break
        if n > rounds:
            more = latest.select("entity.file_id").distinct()
            over = more if over is None else over.unionByName(more).distinct()
            break
        found.append(latest)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    if over is None:
        return out.withColumn("truncated", F.lit(False))
    flagged = over.withColumn("_over", F.lit(True))
    return out.withColumn("_f", F.col("entity.file_id")).join(flagged, F.col("_f") == flagged["file_id"], "left").select(*columns, "round", "proof", F.coalesce("_over", F.lit(False)).alias("truncated"))
