"""Typed facts of entities: what holds at a use, what equal entities share, what relations imply, which declarations clash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lemmata.functions import dimensions
from lemmata.operators import evidence, graph, relational

#: Facts of a symbol that are looked at, and rounds of propagation.
FACTS, ROUNDS = 8, 8
# Roles that may stand beside each other.
COMPATIBLE_ROLES = [("function", "operator"), ("function", "linear-operator"), ("function", "random-variable"), ("function", "distribution"), ("event", "set")]


def facts_at(uses: DataFrame, facts: DataFrame, keys: list[str], use: str, at: str, use_path: str, path: str, since: str, explicit: str, fact: str, cap: int = FACTS) -> DataFrame:
    """(use, rank, fact, truncated): the facts visible at each use, deepest scope first, then explicit ones, then the latest.

    Facts of the document itself (an empty path) are visible before their declaration, those of scopes only after it.
    """
    # of a scope's facts, explicit or not, only the last ones before a use can be listed: they are numbered, and looked up by number
    group, size = [*keys, "_path", "_explicit"], F.size("_path")
    own = facts.select(*keys, F.col(path).alias("_path"), F.coalesce(F.col(explicit).cast("int"), F.lit(-1)).alias("_explicit"), F.col(since).alias("_since"), F.col(fact).alias("_fact")).filter((size == 0) | F.col("_since").isNotNull())
    own = graph.stored(own.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(F.asc("_since"), F.desc("_fact")))))
    prefixes = F.transform(F.sequence(F.lit(0), F.size(use_path)), lambda k: F.slice(F.col(use_path), F.lit(1), k))
    looks = uses.select(*keys, F.col(use).alias("_use"), F.col(at).alias("_since"), F.explode(prefixes).alias("_path"))
    looks = looks.join(graph.small(own.groupBy(*group).agg(F.max("_n").alias("_last"))), [*keys, "_path"])
    steps = own.filter(size > 0).groupBy(*group, "_since").agg(F.max("_n").alias("_last")).withColumn("_use", F.lit(None).cast(looks.schema["_use"].dataType)).withColumn("_is_use", F.lit(False))
    line = steps.unionByName(looks.filter(size > 0).withColumns({"_last": F.lit(None).cast("int"), "_is_use": F.lit(True)}))
    before = Window.partitionBy(*group).orderBy("_since", "_is_use").rowsBetween(Window.unboundedPreceding, 0)
    later = line.withColumn("_last", F.max("_last").over(before)).filter("_is_use and _since is not null and _last is not null")
    found = looks.filter(size == 0).select(*group, "_use", "_last").unionByName(later.select(*group, "_use", "_last"))
    wanted = found.select(*group, "_use", F.explode(F.sequence(F.greatest(F.lit(1), F.col("_last") - cap), F.col("_last"))).alias("_n"))
    seen = wanted.join(graph.small(own), [*group, "_n"]).withColumnRenamed("_use", use)
    return relational.capped(seen, [use], [F.desc(size), F.desc("_explicit"), F.desc("_since"), F.asc("_fact")], cap).select(use, "rank", F.col("_fact").alias(fact), "truncated")


def claim_rows(claims: DataFrame, proofs: DataFrame, occurrences: DataFrame, proof: str, occurrence: str) -> DataFrame:
    """Claims with their evidence and the occurrence it comes from; claims without either have no row."""
    return claims.join(proofs, proof).join(occurrences, occurrence)


def transferred(facts: DataFrame, equal: DataFrame) -> DataFrame:
    """(entity, predicate, value, proof): facts (entity, predicate, value) and those of entities equal over any steps of (src, dst); ``proof`` is the least entity that has it."""
    labels = graph.component_labels(equal)
    named = facts.join(labels.withColumnRenamed("node", "entity"), "entity", "left").withColumn("label", F.coalesce("label", "entity"))
    shared = named.filter(evidence.transferable(F.col("predicate"))).groupBy("label", "predicate", "value").agg(F.min("entity").alias("proof"))
    members = labels.select(F.col("node").alias("entity"), "label")
    copied = members.join(shared, "label").select("entity", "predicate", "value", "proof")
    own = facts.select("entity", "predicate", "value", F.col("entity").alias("proof"))
    return copied.unionByName(own).groupBy("entity", "predicate", "value").agg(F.min("proof").alias("proof"))


def _fixpoint(facts: DataFrame, relations: DataFrame, value: str, up: Column, rounds: int) -> DataFrame:
    """(entity, value, round, truncated): given facts (round 0) and those that relations (relation, kind, result, left, right) imply.

    ``up`` is the result's value by kind, ``_left`` and ``_right``; an ``equal`` relation also gives its result's value to its left
    side.  The first proof counts: the least round, and there the first relation.  The sides of all relations are stored once, one row
    each; a round joins them with the facts, puts each relation together again and keeps those with a side found in
    the round before.  What it finds is a stored table of its own.
    """
    found = [graph.stored(facts.select("entity", value, F.lit(0).alias("round")))]
    latest, truncated = found[0], False
    whole = ["relation", "kind", "result", "left", "right"]
    side = F.explode(F.array(*(F.struct(F.lit(c).alias("side"), F.col(c).alias("entity")) for c in whole[2:])))
    named = graph.stored(relations.select(*whole))
    sides = graph.stored(named.select("relation", side.alias("_s")).select("relation", "_s.side", "_s.entity").filter("entity is not null"))
    of = lambda c: F.first(F.when(F.col("side") == c, F.col(value)), ignorenulls=True).alias(f"_{c}")
    for n in range(1, rounds + 2):
        known = found[0]
        for f in found[1:]:
            known = known.unionByName(f)
        touched = sides.join(latest.select("entity"), "entity").select("relation").distinct()
        have = sides.join(touched, "relation", "left_semi").join(known, "entity").groupBy("relation").agg(of("result"), of("left"), of("right")).join(named, "relation")
        forth = have.filter("_result is null").select("relation", F.col("result").alias("entity"), up.alias(value))
        back = have.filter("kind = 'equal' and _left is null").select("relation", F.col("left").alias("entity"), F.col("_result").alias(value))
        new = forth.unionByName(back).filter(F.col(value).isNotNull()).groupBy("entity").agg(F.min_by(value, "relation").alias(value)).withColumn("round", F.lit(n))
        latest = graph.stored(new)
        if not latest.limit(1).count():
            break
        if n > rounds:
            truncated = True
            break
        found.append(latest)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.withColumn("truncated", F.lit(truncated))


def propagated(facts: DataFrame, relations: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(entity, dimension, round, truncated): given dimensions, and those that relations imply.

    Kinds: ``equal`` (result and left, both ways; also terms of a sum, negation and transposition), ``product`` (also
    integrals and products of vectors), ``quotient`` (also derivatives).
    """
    sign = F.when(F.col("kind") == "quotient", -1).otherwise(1)
    up = F.when(F.col("kind") == "equal", F.col("_left")).when(F.col("kind").isin("product", "quotient"), dimensions.combined(F.col("_left"), F.col("_right"), sign))
    return _fixpoint(facts, relations, "dimension", up, rounds)


def propagated_shapes(facts: DataFrame, relations: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(entity, shape, round, truncated): given shapes, and those that relations imply; kinds are ``equal`` and those of ``shape_of``."""
    up = F.when(F.col("kind") == "equal", F.col("_left")).otherwise(shape_of(F.col("kind"), F.col("_left"), F.col("_right")))
    return _fixpoint(facts, relations, "shape", up, rounds)


def shape_of(kind: Column, left: Column, right: Column) -> Column:
    """The shape (kind, rows, columns) of an operation on known shapes; null where it has none.

    Products: a scalar leaves the other, matrix times vector is a vector, matrix times matrix a matrix; a quotient
    needs a scalar below; a dot product is a scalar; a cross product is its left vector; ``transpose`` swaps; ``negate`` and ``derivative`` keep.
    """
    shape = lambda k, r, c: F.struct(F.lit(k).alias("kind"), r.alias("rows"), c.alias("columns"))
    none = F.lit(None).cast("string")
    a, b = left["kind"], right["kind"]
    both_vectors = (a == "vector") & (b == "vector")
    product = F.when(a == "scalar", right).when(b == "scalar", left).when((a == "matrix") & (b == "vector"), shape("vector", left["rows"], none)).when((a == "matrix") & (b == "matrix"), shape("matrix", left["rows"], right["columns"]))
    return (
        F.when(kind == "product", product)
        .when((kind == "quotient") & (b == "scalar"), left)
        .when((kind == "dot") & both_vectors, shape("scalar", none, none))
        .when((kind == "cross") & both_vectors, left)
        .when((kind == "transpose") & (a == "matrix"), shape("matrix", left["columns"], left["rows"]))
        .when(kind.isin("negate", "derivative"), left)
    )


def application_facts(applications: DataFrame, signatures: DataFrame) -> DataFrame:
    """(relation, entity, shape): a function's codomain is its result's shape, its domain that of its one argument.

    Rows: applications (relation, function, argument, result), signatures (function, domain, codomain).
    """
    both = applications.join(signatures, "function")
    return both.select("relation", F.col("result").alias("entity"), F.col("codomain").alias("shape")).unionByName(both.select("relation", F.col("argument").alias("entity"), F.col("domain").alias("shape")))


def trajectory_derivatives(derivatives: DataFrame, applications: DataFrame, shapes: DataFrame) -> DataFrame:
    """(relation, entity, shape): the derivative of an application has the shape of the applied function (a two-hop join).

    Rows: derivatives (relation, operand, result), applications (result, function), shapes (function, shape).
    """
    via = applications.select(F.col("result").alias("operand"), "function")
    return derivatives.join(via, "operand").join(shapes, "function").select("relation", F.col("result").alias("entity"), "shape")


def role_conflicts(roles: DataFrame, keys: list[str], id_col: str, role: str, lineage: DataFrame) -> DataFrame:
    """Pairs of roles of one key that differ, are in no lineage (ancestor, descendant) either way, and are not of the compatible kinds."""
    spark = roles.sparkSession
    fits = spark.createDataFrame(COMPATIBLE_ROLES, "a string, b string").unionByName(lineage.select(F.col("ancestor").alias("a"), F.col("descendant").alias("b")))
    fits = fits.unionByName(fits.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    pairs = relational.conflict_pairs(roles, keys, id_col, role)
    return pairs.join(fits, (F.col("first_value") == F.col("a")) & (F.col("second_value") == F.col("b")), "left_anti")


def role_shape_conflict(role: Column, is_quantity: Column, shape: Column) -> Column:
    """Whether a role cannot have a known shape."""
    return (
        F.when(is_quantity, ~shape.isin("scalar", "vector"))
        .when(role.isin("event", "set"), True)
        .when(role.isin("operator", "linear-operator"), shape != "matrix")
        .when(role == "index", shape != "scalar")
        .otherwise(False)
    )
