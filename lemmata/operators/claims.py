"""What the formulas of documents claim: relations between expressions, the facts that these imply, and where they clash.

An entity is a subexpression of a file, named by its key; the same key in one file is the same entity.
Formulas in hedged, conditional or negated clauses claim nothing.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lemmata.functions import formulas, prose, quantities, text
from lemmata.operators import constraints, definitions, graph, laws, parsed, relational, solver
from lemmata.sources import syntax as front

#: Powers up to this one are products of their base, and so name the powers below them.
POWERS = 9
#: From this power on it is also claimed as a whole, so that its dimension does not take a round for each factor.
AT_ONCE = 4
_COMPARISONS = set(formulas.RELATIONS.values())


def tree_claims(tree: tuple) -> list[tuple[str, str, str, str | None]]:
    """(predicate, result, left, right) of a formula, parts before wholes; products and powers are folded from the left."""
    head, *children = tree
    if head in ("sym", "num"):
        return []
    name = formulas.canonical
    out = [c for child in children for c in tree_claims(child)]
    if head in _COMPARISONS:
        out.append((head, name(children[0]), name(children[1]), None))
    elif head == "sum":
        out += [("sum", name(tree), name(c), None) for c in children]
    elif head == "product":
        for k in range(2, len(children) + 1):
            left = children[0] if k == 2 else ("product", *children[: k - 1])
            out.append(("product", name(("product", *children[:k])), name(left), name(children[k - 1])))
    elif head == "power" and children[1][0] == "num" and children[1][1].isdigit() and 2 <= int(children[1][1]) <= POWERS:
        for k in range(2, int(children[1][1]) + 1):
            left = children[0] if k == 2 else ("power", children[0], ("num", str(k - 1)))
            out.append(("product", name(("power", children[0], ("num", str(k)))), name(left), name(children[0])))
        if int(children[1][1]) >= AT_ONCE:
            out.append(("power", name(tree), name(children[0]), name(children[1])))
    elif head == "power" and formulas.number(children[1]) is not None:
        out.append(("power", name(tree), name(children[0]), name(children[1])))
    elif head in ("quotient", "dot", "cross", "derivative"):
        out.append((head, name(tree), name(children[0]), name(children[1])))
        if head == "derivative" and children[0][0] == "apply":
            out.append(("trajectory", name(tree), name(children[0][1]), None))
    elif head in ("negate", "transpose"):
        out.append((head, name(tree), name(children[0]), None))
    elif head == "integral":
        out.append((head, name(tree), name(children[1]), name(children[0])))
    elif head == "apply":
        out.append(("application", name(tree), name(children[0]), name(children[1]) if len(children) == 2 else None))
    return out


def relation_claims(docs: DataFrame | front.Parsed) -> DataFrame:
    """(file_id, at, ordinal, predicate, result, left, right, num, den) of the asserted formulas of documents; num / den is the exponent of a power.

    A repeated claim of a file is listed once, where it stands first.
    """

    def row(file_id, at, part, source):
        out = []
        for k, claim in enumerate(tree_claims(laws.as_tuple(json.loads(source)))):
            power = formulas.number(formulas.from_canonical(claim[3])) if claim[0] == "power" else None
            out.append((file_id, at, (part << 20) + k, *claim, power.numerator if power is not None else None, power.denominator if power is not None else None))
        return out

    names = ["predicate", "result", "left", "right", "num", "den"]
    schema = "file_id string, at int, ordinal int, predicate string, result string, left string, right string, num long, den long"
    rows = constraints._mapped(laws.trees(docs).filter("asserted"), ["file_id", "at", "part", "tree"], row, schema, [pa.string(), pa.int32(), pa.int32(), *[pa.string()] * 4, pa.int64(), pa.int64()])
    first = rows.groupBy("file_id", *names).agg(F.min(F.struct("at", "ordinal")).alias("_first"))
    return first.select("file_id", "_first.at", "_first.ordinal", *names)


def _entity(name: str) -> Column:
    return F.when(F.col(name).isNotNull(), F.struct("file_id", F.col(name).alias("name")))


def _relations(claims: DataFrame) -> DataFrame:
    """The claims as relations of the solver; the left side of an integral is what is integrated, the right one its variable."""
    kind = F.when(F.col("predicate") == "equals", "equal").otherwise(F.col("predicate"))
    sides = (_entity(c).alias(c) for c in ("result", "left", "right"))
    wanted = ["equals", "sum", "negate", "transpose", "product", "dot", "cross", "integral", "quotient", "derivative", "power", "application", "trajectory"]
    return claims.filter(F.col("predicate").isin(wanted)).select(F.struct("file_id", "at", "ordinal").alias("relation"), kind.alias("kind"), *sides, "num", "den")


def _numbers(claims: DataFrame) -> DataFrame:
    """(entity): the numbers of the formulas but zero, of which nothing is known."""
    names = claims.select("file_id", F.explode(F.array("result", "left", "right")).alias("name")).filter(F.col("name").rlike("^[0-9.]+$") & (F.expr("try_cast(name as double)") != 0))
    return names.select(F.struct("file_id", "name").alias("entity")).distinct()


def _once(rows: DataFrame, value: str) -> DataFrame:
    """(entity, value) of symbols whose declarations in a file agree."""
    one = rows.groupBy("file_id", "symbol").agg(F.min(value).alias(value), F.max(value).alias("_hi")).filter(F.col(value) == F.col("_hi"))
    return one.select(F.struct("file_id", F.col("symbol").alias("name")).alias("entity"), value)


def declared_facts(docs: DataFrame | front.Parsed, claims: DataFrame) -> DataFrame:
    """(entity, predicate, text, dim, shape): what declarations and assumptions say of symbols, and what numbers are."""
    spark = docs.sparkSession
    rows = [(k, [(b, e, 1) for b, e in sorted(d.items())]) for k, d in quantities.KIND_DIMENSION.items()]
    dims = F.broadcast(spark.createDataFrame(rows, f"kind string, dimension {solver.DIM}"))
    said = laws.declared_quantities(docs)
    none = F.array().cast(solver.DIM)
    scalar = F.struct(F.lit("scalar").alias("kind"), F.lit(None).cast("string").alias("rows"), F.lit(None).cast("string").alias("columns"))
    numbers = graph.stored(_numbers(claims))
    roles = laws.agreed(laws.declared_roles(docs)).select(F.struct("file_id", F.col("symbol").alias("name")).alias("entity"), *solver.fact("role", F.col("concept")))
    conditions = prose.assumptions(docs).filter("kind in ('sign', 'regularity', 'structure', 'definiteness', 'algebraic-property') and value not like 'not-%'")
    conditions = conditions.select("file_id", F.explode("subjects").alias("name"), "value").select(F.struct("file_id", "name").alias("entity"), "value").select("entity", *solver.fact(F.concat(F.lit("condition:"), "value"), F.col("value"))).distinct()
    function = definitions.definitions(docs).select("file_id", "symbol", F.regexp_extract("description", r"\bfrom (?:the |an? )?(.+?) to (?:the |an? )?(.+)$", 1).alias("_from"), F.regexp_extract("description", r"\bfrom (?:the |an? )?(.+?) to (?:the |an? )?(.+)$", 2).alias("_to")).filter("_from <> ''")
    single = lambda c: text.shape(F.regexp_replace(F.regexp_replace(c, "matrices", "matrix"), r"(vector|scalar|tensor)s\b", "$1"))
    ends = [function.select("file_id", "symbol", single(F.col(c)).alias("shape")).filter("shape.kind is not null") for c in ("_from", "_to")]
    out = _once(said.filter("kind is not null"), "kind").join(dims, "kind").select("entity", *solver.fact("dimension", dim=F.col("dimension")))
    out = out.unionByName(numbers.select("entity", *solver.fact("dimension", dim=none))).unionByName(numbers.select("entity", *solver.fact("shape", shape=scalar)))
    out = out.unionByName(_once(said.filter("unit is not null"), "unit").select("entity", *solver.fact("unit", F.col("unit"))))
    out = out.unionByName(_once(constraints.declared_shapes(docs), "shape").select("entity", *solver.fact("shape", shape=F.col("shape"))))
    for name, rows_ in zip(("domain", "codomain"), ends):
        out = out.unionByName(_once(rows_, "shape").select("entity", *solver.fact(name, shape=F.col("shape"))))
    return out.unionByName(roles).unionByName(conditions)


def known_facts(docs: DataFrame | front.Parsed, claims: DataFrame, rounds: int = solver.ROUNDS, work: int = solver.WORK) -> DataFrame:
    """(entity, predicate, text, dim, shape, round, proof, truncated): declared facts and those that the claims imply, over all predicates at once."""
    return solver.solved(declared_facts(docs, claims), _relations(claims), rounds, work)


def derived_facts(docs: DataFrame | front.Parsed, rounds: int = solver.ROUNDS, predicates: tuple[str, ...] | None = ("dimension", "shape"), work: int = solver.WORK) -> DataFrame:
    """(file_id, symbol, predicate, value, round, proof_at, truncated): facts of symbols, declared (round 0) or implied by formulas, and where the formula that proves them stands.

    ``predicates`` None lists all: also units, roles, conditions, domains and codomains.
    """
    docs = parsed.parsed(docs)
    found = known_facts(docs, graph.stored(relation_claims(docs)), rounds, work)
    if predicates is not None:
        found = found.filter(F.col("predicate").isin(*predicates))
    symbols = found.filter(~F.col("entity.name").rlike(r"\(|^[0-9.]+$"))
    return symbols.select("entity.file_id", F.col("entity.name").alias("symbol"), "predicate", F.col("text").alias("value"), "round", F.col("proof.at").alias("proof_at"), "truncated")


def claim_conflicts(docs: DataFrame | front.Parsed, rounds: int = solver.ROUNDS) -> DataFrame:
    """(file_id, at, code): equations and sums whose two sides have facts, declared or implied, that cannot be equal.

    Extents conflict only where both are numbers; an unknown one fits all.
    """
    docs = parsed.parsed(docs)
    claims = graph.stored(relation_claims(docs))
    sides = claims.filter("predicate in ('equals', 'sum')").select("file_id", "at", "predicate", _entity("result").alias("result"), _entity("left").alias("left"))
    known = graph.large(graph.stored(known_facts(docs, claims, rounds).filter("predicate in ('dimension', 'shape')").select("entity", F.col("predicate").alias("what"), "text", "shape")))

    def met(what: str) -> DataFrame:
        some = known.filter(F.col("what") == what)
        a, b = (some.select(F.col("entity").alias(c), F.struct("text", "shape").alias(v)) for c, v in (("result", "a"), ("left", "b")))
        return sides.join(a, "result").join(b, "left")

    def differ(c: str) -> Column:
        a, b = F.col(f"a.shape.{c}"), F.col(f"b.shape.{c}")
        return F.coalesce(a.rlike("^[0-9]+$") & b.rlike("^[0-9]+$") & (a != b), F.lit(False))

    wrong_dims = met("dimension").filter("a.text <> b.text").select("file_id", "at", F.when(F.col("predicate") == "sum", "quantity-addition-dimension-mismatch").otherwise("quantity-assignment-dimension-mismatch").alias("code"))
    wrong_shapes = met("shape").filter((F.col("a.shape.kind") != F.col("b.shape.kind")) | differ("rows") | differ("columns")).select("file_id", "at", F.lit("constraint-shape-conflict").alias("code"))
    return wrong_dims.unionByName(wrong_shapes).distinct()


def declaration_conflicts(docs: DataFrame) -> DataFrame:
    """(file_id, symbol, first, second, code): declarations of a symbol in one scope whose quantities differ in dimension, each dimension by its first place."""
    spark = docs.sparkSession
    scopes = definitions.definitions(docs).select("file_id", "anchor", "scope")
    said = laws.declared_quantities(docs).filter("kind is not null").join(F.broadcast(quantities.kinds(spark)), "kind").join(scopes, ["file_id", "anchor"])
    pairs = relational.conflict_pairs(said, ["file_id", "symbol", "scope"], "anchor", "dimension")
    return pairs.select("file_id", "symbol", "first", "second", F.lit("quantity-declaration-dimension-conflict").alias("code"))


def diagnostics(docs: DataFrame) -> DataFrame:
    """(file_id, rank, at, code): all diagnostics of a file in the order of their places, each code once a place."""
    docs = parsed.parsed(docs)
    found = constraints.shape_diagnostics(docs).select("file_id", "at", "code")
    found = found.unionByName(claim_conflicts(docs)).unionByName(declaration_conflicts(docs).select("file_id", F.col("second").alias("at"), "code"))
    found = found.unionByName(laws.declared_quantities(docs).filter("code is not null").select("file_id", F.col("anchor").alias("at"), "code"))
    found = found.unionByName(constraints.comparison_conflicts(docs).select("file_id", F.col("second").alias("at"), "code"))
    order = Window.partitionBy("file_id").orderBy("at", "code")
    return found.distinct().withColumn("rank", F.row_number().over(order)).select("file_id", "rank", "at", "code")


# What each code of a diagnostic means.
EXPLANATIONS = {
    "constraint-shape-conflict": "The two sides have shapes that cannot be equal.",
    "constraint-product-shape-conflict": "The factors have shapes that cannot be multiplied.",
    "notation-shape-conflict": "The symbol was declared with another shape before.",
    "quantity-addition-dimension-mismatch": "The terms have different dimensions.",
    "quantity-assignment-dimension-mismatch": "The two sides have different dimensions.",
    "quantity-declaration-dimension-conflict": "The symbol was declared with another dimension before.",
    "quantity-unit-dimension-mismatch": "The unit does not measure the quantity.",
    "constraint-comparison-conflict": "The comparison cannot hold together with one before it.",
}


def explained(found: DataFrame) -> DataFrame:
    """Adds ``explanation`` to rows with a ``code``; null for a code that is not known."""
    rows = found.sparkSession.createDataFrame(list(EXPLANATIONS.items()), "code string, explanation string")
    return found.join(F.broadcast(rows), "code", "left")
