"""Formulas of documents: canonical keys, dimension diagnostics, and laws with the support of their roles and conditions.

Laws are the rows of a catalogue of packs (``sources.packs``), to which a caller may add.  Formulas and forms of laws meet by an
equality join on the shape of their tops; a form of an equal key is unified with the formula, which gives rows of (role, expression);
whether these play the roles is decided by joins with what the file declares and with the ancestors of concepts, and conditions by
joins with the assumptions whose place and subjects fit.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lemmata.functions import formulas, quantities, text
from lemmata.functions import prose as said_
from lemmata.operators import decisions, definitions, graph, parsed, relational
from lemmata.sources import packs
from lemmata.sources import syntax as front

#: A law with one undeclared role is inferable if at least so many are declared.
PROVED = 2
#: Bindings of one form and formula that are looked at.
UNIFICATIONS = 64
#: UTF-16 units from an assumption to the formula behind it, and to one right before it.
BEHIND, BEFORE = 640, 16
#: Values of assumptions that verify a condition of each kind; other kinds need evidence that prose does not give.
VERIFIES = {
    "differentiable": ("differentiable",),
    "uniform": ("uniform",),
    "positive": ("positive", "strictly-positive"),
    "nonzero": ("nonzero", "positive", "strictly-positive"),
    "same-context": ("same-context", "common-probability-space"),
    "assumption": ("ideal", "idealized", "steady-state", "small-signal", "time-invariant"),
    "operator-property": ("symmetric", "invertible", "positive-definite", "positive-semidefinite"),
    "sign-convention": ("passive", "stated"),
}
#: Values that refute a condition, beside the denial of one that verifies it.
REFUTES = {"same-context": ("different-context",), "sign-convention": ("opposed",), "positive": ("negative-definite",)}
#: Denials that refute nothing: what is not positive may still differ from zero.
_OPEN = {("nonzero", "not-positive"), ("nonzero", "not-strictly-positive")}


def catalogue(docs: DataFrame | front.Parsed, given: packs.Catalogue | None = None) -> packs.Catalogue:
    return given or packs.builtin_catalogue(docs.sparkSession)


def declared_quantities(docs: DataFrame | front.Parsed) -> DataFrame:
    """(file_id, symbol, anchor, description, kind, unit, code) of each definition."""
    known = definitions.definitions(docs).select("file_id", "symbol", "anchor", "description")
    return known.join(quantities.said(known, "description"), "description", "left").select("file_id", "symbol", "anchor", "description", "kind", "unit", "code")


def declared_roles(docs: DataFrame | front.Parsed, given: packs.Catalogue | None = None) -> DataFrame:
    """(file_id, symbol, anchor, concept): what each definition says its symbol is, by the longest term.

    Of several concepts with that term, one that is an ancestor of another gives way; if more than one is left, nothing is said.  A
    description that is only a word about the notation (a symbol, variable, value …) names no concept.
    """
    own = catalogue(docs, given)
    known = definitions.definitions(docs).select("file_id", "symbol", "anchor", "description")
    terms = graph.small(own.terms)
    # what a description says is found once, however many definitions share it
    found = text.contained_terms(known.select("description").distinct(), "description", F.col("description"), own.terms.select("term").distinct(), "term").join(terms, "term")
    longest = found.groupBy("description").agg(F.max(F.length("term")).alias("n"), F.collect_set(F.struct(F.length("term").alias("n"), "concept")).alias("all"))
    best = longest.select("description", F.explode(F.filter("all", lambda e: e["n"] == F.col("n"))).alias("e")).select("description", F.col("e.concept").alias("concept"))
    above = best.join(graph.small(own.lineage), "concept", "left").groupBy("description").agg(F.collect_set("concept").alias("some"), F.collect_list(F.struct("concept", "ancestors")).alias("lines"))
    lowest = F.filter("some", lambda c: ~F.exists("lines", lambda e: (e["concept"] != c) & F.array_contains(e["ancestors"], c)))
    clear = above.select("description", F.when(F.size(lowest) == 1, F.get(lowest, 0)).alias("concept"))
    return known.join(graph.small(graph.stored(clear)), "description", "left").select("file_id", "symbol", "anchor", "concept")


def agreed(declared: DataFrame) -> DataFrame:
    """(file_id, symbol, concept) of symbols that a file declares with one concept only."""
    one = declared.filter("concept is not null").groupBy("file_id", "symbol").agg(F.min("concept").alias("concept"), F.max("concept").alias("_hi"))
    return one.filter("concept = _hi").drop("_hi")


def trees(docs: DataFrame | front.Parsed) -> DataFrame:
    """(file_id, at, part, canonical, scope, tree, keys, asserted) of the formulas of documents."""
    return parsed.parsed(docs).trees


def _balance(tree: list) -> list[dict[str, list]]:
    """The terms of a sum of at least three that is zero."""
    total = tree[1] if tree[2] == ["num", "0"] else tree[2]
    return [{f"term-{i}": c[1] if c[0] == "negate" else c for i, c in enumerate(total[1:])}]


def as_tuple(tree):
    """A tree read from JSON."""
    return tuple(as_tuple(c) for c in tree) if isinstance(tree, list) else tree


def matches(trees_: DataFrame, own: packs.Catalogue) -> DataFrame:
    """(tree, law, form, guards, step, binding, size, role, symbol, plain, symbols): what the forms of laws bind to their roles in each distinct formula, stored.

    At most ``UNIFICATIONS`` bindings of a form and a formula are looked at.
    """
    each = graph.dealt(trees_.groupBy("tree").agg(F.first("keys").alias("keys")))
    keyed = each.select("tree", F.explode("keys").alias("key")).join(graph.small(own.forms), "key")
    names = ["tree", "law", "form", "guards", "step", "binding", "size", "role", "symbol", "plain", "symbols"]
    kinds = [pa.string(), pa.string(), pa.int32(), pa.list_(pa.string()), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.list_(pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple] = {}
        for b in batches:
            out = []
            for *head, template in zip(*(b.column(c).to_pylist() for c in (*names[:5], "template"))):
                source = head[0]
                if source not in known:
                    if len(known) > 4096:
                        known.clear()
                    known[source] = as_tuple(json.loads(source))
                tree = known[source]
                if template == '["balance"]':
                    found = _balance(json.loads(source))
                    found = [{r: as_tuple(t) for r, t in f.items()} for f in found]
                else:
                    found = formulas.unify(as_tuple(json.loads(template)), tree, {})[:UNIFICATIONS]
                for n, bound in enumerate(found):
                    out += [(*head, n, len(bound), r, formulas.canonical(t), t[0] == "sym", formulas.symbols(t)) for r, t in bound.items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * len(names), kinds)], names=names)

    schema = "tree string, law string, form int, guards array<string>, step string, binding int, size int, role string, symbol string, plain boolean, symbols array<string>"
    return graph.stored(keyed.select(*names[:5], "template").mapInArrow(run, schema))


def role_symbols(trees_: DataFrame, found: DataFrame) -> DataFrame:
    """The formulas, a row for each of their symbols that may play a role by the matches."""
    return trees_.join(graph.small(graph.stored(found.filter("plain").select("tree", "symbol").distinct())), "tree")


def supported(trees_: DataFrame, found: DataFrame, given: DataFrame, own: packs.Catalogue) -> DataFrame:
    """(file_id, at, scope, law, support, form, guards, step, roles) of the formulas whose matches the given concepts support.

    ``given`` has (file_id, symbol, concept), and may have (at) where a concept holds for one formula only.  A concept plays a role if
    the role's concept is among its ancestors.  ``typed``: all roles are played; ``inferable``: all but one, which nothing is known of, and
    at least ``PROVED``.  A law is listed once a formula: the typed before the inferable, then by form.  What a formula and the concepts
    of its symbols support is worked out once, however many places have the same.
    """
    uses = role_symbols(trees_, found).join(graph.large(given), [c for c in ("file_id", "at") if c in given.columns] + ["symbol"])
    met = uses.groupBy("file_id", "at", "part").agg(F.first("scope").alias("scope"), F.first("tree").alias("tree"), F.array_sort(F.collect_list(F.struct("symbol", "concept"))).alias("_known"))
    met = graph.large(graph.stored(met))
    roles = own.roles.select(F.col("law").alias("_law"), F.when(F.col("variadic"), F.lit(None)).otherwise(F.col("role")).alias("_role"), F.col("concept").alias("_wanted"), "variadic")
    rows = met.select("tree", "_known").distinct().join(graph.small(found), "tree")
    rows = rows.join(graph.small(roles), (F.col("law") == F.col("_law")) & (F.col("_role").isNull() | (F.col("_role") == F.col("role"))))
    said = F.when(F.col("plain"), F.filter("_known", lambda e: e["symbol"] == F.col("symbol")))
    rows = rows.withColumn("_said", F.explode_outer(said)).withColumn("concept", F.col("_said.concept")).join(graph.small(own.lineage), "concept", "left")
    fits = F.coalesce(F.array_contains(F.coalesce("ancestors", F.array("concept")), F.col("_wanted")), F.lit(False))
    one = rows.groupBy("tree", "_known", "law", "form", "binding").agg(
        F.first("guards").alias("guards"), F.first("step").alias("step"), F.first("size").alias("size"), F.bool_or("variadic").alias("variadic"),
        F.count_if(fits).alias("proved"), F.count_if(F.col("concept").isNotNull() & ~fits).alias("wrong"),
        F.array_sort(F.collect_list(F.struct("role", "symbol", "symbols"))).alias("roles"),
    )
    support = F.when(F.col("proved") == F.col("size"), "typed").when(~F.col("variadic") & (F.col("proved") >= PROVED) & (F.col("proved") == F.col("size") - 1), "inferable")
    one = one.filter("wrong = 0").withColumn("support", support).filter("support is not null")
    cases = graph.stored(relational.keep_best(one, ["tree", "_known", "law"], [F.desc("support"), F.asc("form"), F.asc("binding")]).drop("proved", "wrong", "size", "variadic"))
    best = relational.keep_best(met.join(graph.small(cases), ["tree", "_known"]), ["file_id", "at", "law"], [F.desc("support"), F.asc("form"), F.asc("part"), F.asc("binding")])
    return best.select("file_id", "at", "scope", "law", "support", "form", "guards", "step", "roles")


def recognitions(docs: DataFrame | front.Parsed, given: packs.Catalogue | None = None) -> DataFrame:
    """(file_id, at, scope, law, support, form, guards, step, roles) of formulas by what their file declares; ``roles`` has (role, symbol, symbols)."""
    docs, own = parsed.parsed(docs), catalogue(docs, given)
    return supported(docs.trees, matches(docs.trees, own), agreed(declared_roles(docs, own)), own)


def _meanings(spark) -> DataFrame:
    says = {(kind, v, True) for kind, vs in VERIFIES.items() for v in vs} | {(kind, f"not-{v}", False) for kind, vs in VERIFIES.items() for v in vs if (kind, f"not-{v}") not in _OPEN} | {(kind, v, False) for kind, vs in REFUTES.items() for v in vs}
    return F.broadcast(spark.createDataFrame(sorted(says), "kind string, value string, supports boolean"))


def evidence(docs: front.Parsed) -> DataFrame:
    """(file_id, kind, supports, since, until, subjects, scope): assumptions, each with the places of formulas it counts for, and signs that formulas state.

    An assumption whose clause holds formulas counts for these alone; another for formulas that follow it within ``BEHIND`` units or
    stand right before it.
    """
    said = said_.assumptions(docs).select("file_id", "start", "end", "value", "subjects", "scope", "targets")
    free = said.filter(F.size("targets") == 0).select("file_id", "value", (F.col("start") - BEFORE).alias("since"), (F.col("end") + BEHIND + 1).alias("until"), "subjects", "scope")
    bound = said.select("file_id", "value", F.explode("targets").alias("since"), "subjects", "scope").select("file_id", "value", "since", (F.col("since") + 1).alias("until"), F.array().cast("array<string>").alias("subjects"), "scope")
    sign = F.regexp_extract("canonical", r"^(greater-than|not-equals)\(([^(),]+),0\)$", 1)
    stated = docs.trees.filter("asserted").withColumn("_sign", sign).filter("_sign <> ''")
    stated = stated.select("file_id", F.when(F.col("_sign") == "greater-than", "positive").otherwise("nonzero").alias("value"), (F.col("at") - BEFORE).alias("since"), (F.col("at") + BEHIND + 1).alias("until"), F.array(F.regexp_extract("canonical", r"\(([^(),]+),0\)$", 1)).alias("subjects"), "scope")
    return free.unionByName(bound).unionByName(stated).join(_meanings(docs.sparkSession), "value").select("file_id", "kind", "supports", "since", "until", "subjects", "scope")


def conditions_of(found: DataFrame, own: packs.Catalogue) -> DataFrame:
    """(file_id, at, scope, law, condition, kind, subjects): the conditions of recognised laws over the symbols they bind, and what their form must not divide by."""
    wanted = found.join(graph.small(own.conditions.withColumnRenamed("subjects", "_roles")), "law").select("file_id", "at", "scope", "law", "condition", "kind", "_roles", "roles")
    guards = found.select("file_id", "at", "scope", "law", F.explode("guards").alias("_g"), "roles").select("file_id", "at", "scope", "law", F.concat(F.lit("nonzero-"), "_g").alias("condition"), F.lit("nonzero").alias("kind"), F.array("_g").alias("_roles"), "roles")
    both = wanted.unionByName(guards)
    # a differentiable condition speaks of its function, the first subject; the terms of a balance are all subjects
    meant = F.when(F.col("kind") == "differentiable", F.slice("_roles", 1, 1)).otherwise(F.col("_roles"))
    own_roles = F.filter("roles", lambda r: F.array_contains(F.col("_meant"), r["role"]) | r["role"].startswith("term-"))
    symbols = F.array_sort(F.array_distinct(F.flatten(F.transform(own_roles, lambda r: r["symbols"]))))
    return both.withColumn("_meant", meant).select("file_id", "at", "scope", "law", "condition", "kind", symbols.alias("subjects"))


def condition_statuses(docs: DataFrame | front.Parsed, laws_found: DataFrame | None = None, given: packs.Catalogue | None = None) -> DataFrame:
    """(file_id, at, law, condition, kind, status) of the conditions of recognised laws, or of those given (as ``recognitions`` lists them).

    Evidence counts where its place fits, its scope is seen, and it names no symbols or all that the condition speaks of.
    Membership of domains holds where all subjects are declared to be something.
    """
    docs, own = parsed.parsed(docs), catalogue(docs, given)
    found = graph.stored(conditions_of(recognitions(docs, own) if laws_found is None else laws_found, own))
    said = evidence(docs).withColumnsRenamed({"subjects": "_said", "scope": "_seen"})
    near = relational.inside(found, said, ["file_id", "kind"], "at", "since", "until")
    fits = (F.size("_said") == 0) | (F.size(F.array_except("subjects", "_said")) == 0)
    near = near.filter(fits & (F.slice("scope", F.lit(1), F.size("_seen")) == F.col("_seen")))
    votes = near.groupBy("file_id", "at", "law", "condition").agg(F.bool_or("supports").alias("_yes"), F.bool_or(~F.col("supports")).alias("_no"))
    known = agreed(declared_roles(docs, own)).select("file_id", F.col("symbol").alias("_symbol"), F.lit(1).alias("_known"))
    members = found.filter("kind = 'domain-membership'").select("file_id", "at", "law", "condition", F.explode("subjects").alias("_symbol")).join(known, ["file_id", "_symbol"], "left")
    members = members.groupBy("file_id", "at", "law", "condition").agg((F.count("*") == F.count("_known")).alias("_member"))
    out = found.join(votes, ["file_id", "at", "law", "condition"], "left").join(members, ["file_id", "at", "law", "condition"], "left")
    yes = F.coalesce("_yes", F.lit(False)) | F.coalesce("_member", F.lit(False))
    status = decisions.condition_status(F.size("subjects"), F.coalesce("_no", F.lit(False)), yes)
    return out.select("file_id", "at", "law", "condition", "kind", status.alias("status"))


def law_statuses(docs: DataFrame | front.Parsed, laws_found: DataFrame | None = None, given: packs.Catalogue | None = None) -> DataFrame:
    """(file_id, at, law, status) of recognised laws, or of those given, from the statuses of their conditions."""
    return condition_statuses(docs, laws_found, given).groupBy("file_id", "at", "law").agg(F.collect_list("status").alias("_s")).select("file_id", "at", "law", decisions.law_status(F.col("_s")).alias("status"))


def with_status(found: DataFrame, docs: DataFrame | front.Parsed, given: packs.Catalogue | None = None) -> DataFrame:
    """Recognised laws with their status; one without conditions is recognised."""
    return found.join(law_statuses(docs, found, given), ["file_id", "at", "law"], "left").withColumn("status", F.coalesce("status", F.lit("recognized")))


def formula_facts(docs: DataFrame | front.Parsed) -> DataFrame:
    """(file_id, at, what, value, support, step) of every math region: its key or that it cannot be parsed, diagnostics, laws.

    A symbol with two kinds of quantity in a file has none.  ``step`` tells by which form a law was recognised: ``stated``, or an equivalent one.
    """
    docs = parsed.parsed(docs)
    maths = front.syntax(docs).filter("kind = 'math'").select("file_id", F.col("start").alias("at"), "text")
    kinds_of = declared_quantities(docs).filter("kind is not null").groupBy("file_id", "symbol").agg(F.min("kind").alias("kind"), F.max("kind").alias("_hi")).filter("kind = _hi")
    symbols = front.syntax(docs).filter("kind = 'symbol'").select("file_id", "region", F.col("text").alias("symbol")).distinct()
    regions = front.syntax(docs).filter("kind = 'math'").select("file_id", "region", F.col("start").alias("at"))
    own = symbols.join(kinds_of, ["file_id", "symbol"]).join(regions, ["file_id", "region"]).groupBy("file_id", "at").agg(F.collect_list(F.struct("symbol", "kind")).alias("known"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for f, a, t, d in zip(*(b.column(c).to_pylist() for c in ("file_id", "at", "text", "known"))):
                tree = formulas.parse(t)
                if tree is None:
                    out.append((f, a, "unparsed", None, None))
                    continue
                out.append((f, a, "canonical", formulas.canonical(tree), None))
                faults: set[str] = set()
                known = {e["symbol"]: quantities.KIND_DIMENSION[e["kind"]] for e in d or []}
                for one in tree[1:] if tree[0] == "system" else (tree,):
                    formulas.dimension(one, known, faults)
                out += [(f, a, "diagnostic", code, None) for code in sorted(faults)]
            kinds_ = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 5, kinds_)], names=["file_id", "at", "what", "value", "support"])

    facts = maths.join(own, ["file_id", "at"], "left").select("file_id", "at", "text", "known").mapInArrow(run, "file_id string, at int, what string, value string, support string")
    facts = facts.withColumn("step", F.lit(None).cast("string"))
    return facts.unionByName(recognitions(docs).select("file_id", "at", F.lit("law").alias("what"), F.col("law").alias("value"), "support", "step"))


def has_role(roles: Column, role: str) -> Column:
    """The symbol that plays a role."""
    return F.get(F.filter(roles, lambda r: r["role"] == role), 0)["symbol"]
