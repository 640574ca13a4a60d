"""Readings of formulas: laws found over several formulas, ranked interpretations, what they still need, and the flow between formulas."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lemmata.functions import formulas
from lemmata.operators import constraints, definitions, evidence, graph, laws, parsed, relational
from lemmata.sources import packs
from lemmata.sources import syntax as front

#: Steps from law to law, roles that one formula takes over, and requirements that are listed.
HOPS, ROLES, REQUIREMENTS = 2, 64, 16
#: Units that may stand between two formulas of one flow, and clauses.
REACH, CLAUSES = 320, 2


def chained(docs: DataFrame | front.Parsed, hops: int = HOPS, given: packs.Catalogue | None = None) -> DataFrame:
    """(file_id, at, scope, law, support, form, guards, step, roles, status, hop): laws of formulas, also by roles that laws of earlier formulas give.

    A recognised or verified law gives each plain symbol of its roles the role's concept in the formulas after it, unless the file
    declares the symbol; a symbol with two concepts has none.  Support is ``derived`` for what only such roles make typed,
    ``inferable`` where one role is still open.  Formulas are matched once; a hop handles those with a symbol that got a role.
    """
    docs, own = parsed.parsed(docs), laws.catalogue(docs, given)
    found = laws.matches(docs.trees, own)
    declared = graph.stored(laws.agreed(laws.declared_roles(docs, own)))
    done = graph.stored(laws.with_status(laws.supported(docs.trees, found, declared, own), docs, own).withColumn("hop", F.lit(0)))
    uses = laws.role_symbols(docs.trees, found).select("file_id", "at", "symbol").distinct()
    open_uses = graph.large(graph.stored(uses.join(graph.large(declared), ["file_id", "symbol"], "left_anti")))
    concept = graph.small(own.roles.filter("not variadic").select("law", "role", "concept"))
    for hop in range(1, hops + 1):
        new = done.filter((F.col("hop") == hop - 1) & F.col("status").isin("recognized", "verified")) if hop > 1 else done.filter("status in ('recognized', 'verified')")
        if not new.limit(1).count():
            break
        now = done.filter("status in ('recognized', 'verified')").select("file_id", F.col("at").alias("since"), "law", F.explode("roles").alias("_r"))
        now = now.select("file_id", "since", "law", F.col("_r.role").alias("role"), F.col("_r.symbol").alias("symbol")).join(concept, ["law", "role"])
        # the first place from which each concept of a symbol is known; a use has one if a single concept is known before it
        first = now.groupBy("file_id", "symbol", "concept").agg(F.min("since").alias("since"))
        ranked = first.withColumn("_n", F.row_number().over(Window.partitionBy("file_id", "symbol").orderBy("since", "concept"))).filter("_n <= 2")
        span = ranked.groupBy("file_id", "symbol").agg(F.min_by("concept", "_n").alias("concept"), F.min("since").alias("since"), F.max(F.when(F.col("_n") == 2, F.col("since"))).alias("until"))
        later = open_uses.join(span, ["file_id", "symbol"]).filter((F.col("since") < F.col("at")) & (F.col("until").isNull() | (F.col("at") <= F.col("until")))).select("file_id", "at", "symbol", "concept")
        later = graph.large(graph.stored(relational.capped(later, ["file_id", "at"], [F.asc("symbol")], ROLES).select("file_id", "at", "symbol", "concept")))
        places = later.select("file_id", "at").distinct()
        again = docs.trees.join(places, ["file_id", "at"], "left_semi")
        known = later.unionByName(uses.join(places, ["file_id", "at"], "left_semi").join(graph.large(declared), ["file_id", "symbol"]).select("file_id", "at", "symbol", "concept"))
        more = laws.supported(again, found, known, own).withColumn("support", F.when(F.col("support") == "typed", "derived").otherwise(F.col("support")))
        both = done.unionByName(laws.with_status(graph.stored(more), docs, own).withColumn("hop", F.lit(hop)))
        better = F.array_position(F.array(F.lit("typed"), F.lit("derived"), F.lit("inferable")), F.col("support"))
        done = graph.stored(relational.keep_best(both, ["file_id", "at", "law"], [better, F.asc("hop")]))
    return done


def interpretations(docs: DataFrame, cap: int = evidence.HYPOTHESES) -> DataFrame:
    """(file_id, at, rank, kind, label, support, truncated): the hypotheses of each formula, best first, at most ``cap``.

    Laws: ``contradicted`` where a condition is refuted, ``tentative`` while a role is open, ``explicit`` or ``derived`` for the only
    law that stands, ``supported`` for one of several or one whose conditions are open.  Structural readings are tentative.
    """
    docs = parsed.parsed(docs)
    found = chained(docs)
    stands = (F.col("support") != "inferable") & F.col("status").isin("recognized", "verified")
    alone = F.count_if(stands).over(Window.partitionBy("file_id", "at")) == 1
    tier = F.when(F.col("status") == "conflicting", "contradicted").when(F.col("support") == "inferable", "tentative").when(stands & alone, F.when(F.col("support") == "derived", "derived").otherwise("explicit")).otherwise("supported")
    ours = found.select("file_id", "at", F.lit("typed-law").alias("kind"), F.col("law").alias("label"), tier.alias("support"), F.lit(0).alias("start"), F.lit(0).alias("end"))

    def row(file_id, at, source):
        return [(file_id, at, "structural", f"{family}:{reading}", "tentative", a, b) for family, reading, a, b in formulas.candidates(source)[0]]

    schema = "file_id string, at int, kind string, label string, support string, start int, end int"
    shaped = constraints._mapped(constraints._formulas(docs), ["file_id", "at", "text"], row, schema, [pa.string(), pa.int32(), *[pa.string()] * 3, pa.int32(), pa.int32()])
    return evidence.hypotheses(ours.unionByName(shaped), ["file_id", "at"], "support", ["start", "end", "kind", "label"], cap).select("file_id", "at", "rank", "kind", "label", "support", "truncated")


def requirements(docs: DataFrame, cap: int = REQUIREMENTS) -> DataFrame:
    """(file_id, at, rank, requirement, truncated): what each formula lacks for an established reading, distinct, at most ``cap``.

    A role whose symbol is not declared, a condition that is not verified, a symbol without an established definition,
    and a choice where several laws stand.
    """
    docs = parsed.parsed(docs)
    found = graph.stored(laws.with_status(graph.stored(laws.recognitions(docs)), docs))
    known = laws.declared_roles(docs).filter("concept is not null").select("file_id", "symbol").distinct()
    roles = found.select("file_id", "at", "law", F.explode("roles").alias("_r")).select("file_id", "at", "law", F.col("_r.role").alias("role"), F.col("_r.symbol").alias("symbol"))
    out = roles.join(known, ["file_id", "symbol"], "left_anti").select("file_id", "at", F.concat("law", F.lit("/binding/"), "role").alias("requirement"))
    open_ = laws.condition_statuses(docs, found).filter("status <> 'verified'")
    out = out.unionByName(open_.select("file_id", "at", F.concat("law", F.lit("/condition/"), "kind").alias("requirement")))
    rows = front.syntax(docs)
    symbols = rows.filter("kind = 'symbol'").select("file_id", F.col("start").alias("use"), "region").join(rows.filter("kind = 'math'").select("file_id", F.col("start").alias("at"), "region"), ["file_id", "region"])
    loose = definitions.resolved_uses(docs).filter("status <> 'established'").join(symbols, ["file_id", "use"])
    out = out.unionByName(loose.select("file_id", "at", F.concat(F.lit("declaration/"), "symbol").alias("requirement")))
    several = found.filter("support = 'typed' and status in ('recognized', 'verified')").groupBy("file_id", "at").agg(F.count("*").alias("n")).filter("n > 1")
    out = out.unionByName(several.select("file_id", "at", F.lit("meaning/disambiguation").alias("requirement"))).distinct()
    return relational.capped(out, ["file_id", "at"], [F.asc("requirement")], cap).select("file_id", "at", "rank", "requirement", "truncated")


# Words between two formulas by which the later one follows from the earlier.
FLOWS = [
    ("consequence", re.compile(r"\b(?:therefore|thus|hence|so that|it follows that|which (?:gives|yields|implies)|giving|yielding|implies)\b", re.I)),
    ("substitution", re.compile(r"\b(?:substituting|inserting|replacing|plugging)\b", re.I)),
    ("restatement", re.compile(r"\b(?:that is|i\.e\.|equivalently|in other words|can be written as|rewritten as)\b", re.I)),
    ("output", re.compile(r"\b(?:produces?|outputs?|returns?|computes?)\b", re.I)),
]
_END = re.compile(r"[.!?;\n]")


def flows(docs: DataFrame) -> DataFrame:
    """(file_id, earlier, later, kind): neighbouring formulas that words between them join, at most ``REACH`` units and ``CLAUSES`` clause ends apart.

    Words in hedged, conditional or negated clauses join nothing.
    """

    def row(file_id, content):
        if not content:
            return []
        live, units, out = front.masked(content), front.utf16(content), []
        maths = [r for r in front.parse(content) if r[0] == "math"]
        for a, b in zip(maths, maths[1:]):
            between = live[a[3] : b[2]]
            if units[b[2]] - units[a[3]] > REACH or len(_END.findall(between)) > CLAUSES or not definitions.asserted(live, b[2], b[3]):
                continue
            kind = next((k for k, p in FLOWS if p.search(between)), None)
            if kind:
                out.append((file_id, units[a[2]], units[b[2]], kind))
        return out

    return constraints._mapped(docs, ["file_id", "content"], row, "file_id string, earlier int, later int, kind string", [pa.string(), pa.int32(), pa.int32(), pa.string()])


def output_descriptions(docs: DataFrame) -> DataFrame:
    """(file_id, producer, result, description): a formula, a verb of producing and words that describe the next formula's result.

    As in "The map $f$ produces the state vector. $y = f(x)$".
    """
    said = re.compile(r"^\s*,?\s*(?:produces?|outputs?|returns?|computes?)\s+(?:the |an? )?([A-Za-z][A-Za-z0-9 -]*?)\s*[.:,;]?\s*$", re.I)

    def row(file_id, content):
        if not content:
            return []
        live, units, out = front.masked(content), front.utf16(content), []
        maths = [r for r in front.parse(content) if r[0] == "math"]
        for a, b in zip(maths, maths[1:]):
            found = said.match(live[a[3] : b[2]])
            if found and units[b[2]] - units[a[3]] <= REACH and not re.search(r"\bor\b", found[1]) and definitions.asserted(live, a[2], a[3]):
                out.append((file_id, units[a[2]], units[b[2]], found[1]))
        return out

    return constraints._mapped(docs, ["file_id", "content"], row, "file_id string, producer int, result int, description string", [pa.string(), pa.int32(), pa.int32(), pa.string()])
