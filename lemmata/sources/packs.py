"""Packs: declarative concepts, quantities and laws as JSON, which a user may add to; reading, validation, compilation to rows, and a report for authors.

A pack is one JSON text with the fields of ``FIELDS``.  Concepts are named ``namespace:id``; parents lie in the pack itself,
bridges lead to concepts of packs it depends on.  ``compiled`` turns packs into the rows that recognition joins: forms of laws by
dispatch key, roles, conditions, terms of concepts and their ancestors.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lemmata.functions import formulas
from lemmata.operators import graph, project

#: The version of the layout, and bytes of a pack's text.
SCHEMA_VERSION, LARGEST = 13, 256 << 10
_EXPONENTS = "array<struct<base: string, numerator: int, denominator: int>>"
PACK = f"""schemaVersion int, packId string, packVersion string, packKind string, namespace string, title string, description string,
  dependencies array<struct<packId: string, versionMajor: int, requiredCapabilities: array<string>>>, capabilities struct<provides: array<string>, requires: array<string>>,
  concepts array<struct<id: string, conceptKind: string, title: string, description: string, aliases: array<string>, parents: array<string>, references: array<string>>>,
  conceptBridges array<struct<id: string, source: string, target: string>>,
  quantityKinds array<struct<id: string, title: string, description: string, aliases: array<string>, dimension: {_EXPONENTS}, defaultUnit: string, references: array<string>>>,
  units array<struct<id: string, symbol: string, aliases: array<string>, dimension: {_EXPONENTS}, scale: struct<numerator: bigint, denominator: bigint>, offset: struct<numerator: bigint, denominator: bigint>, references: array<string>>>,
  laws array<struct<id: string, title: string, description: string, canonicalRelation: string, archetype: struct<id: string, slots: map<string, string>>, representations: array<string>,
    roles: array<struct<id: string, concept: string, description: string, shape: string, quantity: string, variadic: boolean, sourceProjection: string>>,
    conditions: array<struct<id: string, kind: string, subjects: array<string>, label: string, operatorProperty: string, evidencePhrases: array<string>>>, activationPhrases: array<string>, references: array<string>>>,
  activationRules array<struct<id: string, topic: string, phrases: array<string>, references: array<string>>>, roles array<string>, operators array<string>, references array<string>"""
#: The fields of a pack, and of the entries of its lists.
FIELDS = {
    "": "schemaVersion packId packVersion packKind namespace title description dependencies capabilities concepts conceptBridges quantityKinds units laws activationRules roles operators references",
    "dependencies": "packId versionMajor requiredCapabilities",
    "concepts": "id conceptKind title description aliases parents references",
    "conceptBridges": "id source target",
    "quantityKinds": "id title description aliases dimension defaultUnit references",
    "units": "id symbol aliases dimension scale offset references",
    "laws": "id title description canonicalRelation archetype representations roles conditions activationPhrases references",
    "activationRules": "id topic phrases references",
}
# Relations of law archetypes by their slots.
ARCHETYPES = {
    "binary-product": "{result} = {left-factor} {right-factor}",
    "ternary-product": "{result} = {first-factor} {second-factor} {third-factor}",
    "reciprocal": "{result} = 1 / {denominator}",
    "negative-gradient-transport": "{flux} = -{coefficient} \\nabla {field}",
    "ternary-product-ratio": "{result} = {first-factor} {second-factor} {third-factor} / {denominator}",
}
# The fewest and most subjects of a condition of each kind.
ARITY = {"assumption": (1, 99), "differentiable": (2, 2), "domain-membership": (1, 99), "maps-between": (3, 3), "operator-property": (1, 1), "positive": (1, 99), "rank-compatible": (2, 2), "same-context": (2, 99), "shape-compatible": (2, 99), "sign-convention": (1, 99), "uniform": (1, 99)}


def read_packs(spark: SparkSession, path: str) -> DataFrame:
    """The JSON files of a folder, one pack each, as (text, pack)."""
    return packs(spark.read.text(path, wholetext=True), "value")


def packs(texts: DataFrame, column: str) -> DataFrame:
    return texts.select(F.col(column).alias("text"), F.from_json(column, PACK).alias("pack"))


def builtin(spark: SparkSession) -> DataFrame:
    """The packs of this library as (text, pack)."""
    folder = Path(__file__).resolve().parents[1] / "packs"
    texts = [(f.read_text("utf-8"),) for f in sorted(folder.glob("*.json"))]
    return packs(spark.createDataFrame(texts, "value string"), "value")


def _listed(packs_: DataFrame, field: str) -> DataFrame:
    """(pack, namespace, x) for the entries of a list."""
    return packs_.filter("pack.packId is not null").select(F.col("pack.packId").alias("pack"), F.col("pack.namespace").alias("namespace"), F.explode(f"pack.{field}").alias("x"))


def _named(name: Column) -> Column:
    return F.concat(F.col("namespace"), F.lit(":"), name)


def concepts(packs_: DataFrame) -> DataFrame:
    """(pack, namespace, concept, kind, parents, terms): concepts and quantity kinds."""
    own = _listed(packs_, "concepts").select("pack", "namespace", _named(F.col("x.id")).alias("concept"), F.col("x.conceptKind").alias("kind"), F.coalesce("x.parents", F.array().cast("array<string>")).alias("parents"), F.concat(F.array("x.id", "x.title"), F.coalesce("x.aliases", F.array().cast("array<string>"))).alias("terms"))
    kinds = _listed(packs_, "quantityKinds").select("pack", "namespace", _named(F.col("x.id")).alias("concept"), F.lit("quantity").alias("kind"), F.array().cast("array<string>").alias("parents"), F.concat(F.array("x.id", "x.title"), F.coalesce("x.aliases", F.array().cast("array<string>"))).alias("terms"))
    return own.unionByName(kinds)


def concept_edges(packs_: DataFrame) -> DataFrame:
    """(src, dst): a concept and its parent, or what a bridge leads to."""
    up = concepts(packs_).select(F.col("concept").alias("src"), F.explode("parents").alias("dst"))
    return up.unionByName(_listed(packs_, "conceptBridges").select(F.col("x.source").alias("src"), F.col("x.target").alias("dst"))).distinct()


def laws(packs_: DataFrame) -> DataFrame:
    """(pack, law, relation, representations, archetype, slots, roles, conditions): an archetype's relation with its slots filled, else the stated one."""
    spark = packs_.sparkSession
    forms = F.broadcast(spark.createDataFrame(list(ARCHETYPES.items()), "archetype string, form string"))
    rows = _listed(packs_, "laws").select("pack", "namespace", F.col("x.id").alias("law"), F.col("x.canonicalRelation").alias("stated"), F.col("x.representations").alias("representations"), F.col("x.archetype.id").alias("archetype"), F.col("x.archetype.slots").alias("slots"), F.col("x.roles").alias("roles"), F.col("x.conditions").alias("conditions")).join(forms, "archetype", "left")
    filled = F.aggregate(F.map_entries("slots"), F.col("form"), lambda text, e: F.replace(text, F.concat(F.lit("{"), e["key"], F.lit("}")), e["value"]))
    return rows.withColumn("relation", F.coalesce(filled, "stated")).select("pack", "namespace", "law", "relation", "representations", "archetype", "slots", "roles", "conditions")


def faults(packs_: DataFrame) -> DataFrame:
    """(pack, fault, detail) of a catalogue of packs, each fault once: texts, fields, versions, ids, dependencies, capabilities, concepts, bridges, laws, units."""
    name = F.coalesce("pack.packId", F.lit("?"))
    out: list[DataFrame] = []

    def add(df: DataFrame, fault: str, detail: Column, pack: Column | None = None) -> None:
        out.append(df.select((F.col("pack") if pack is None else pack).alias("pack"), F.lit(fault).alias("fault"), detail.cast("string").alias("detail")))

    add(packs_.filter(F.octet_length("text") > LARGEST), "too-large", F.octet_length("text"), name)
    add(packs_.filter("pack.packId is null"), "unreadable", F.substring("text", 1, 40), F.lit("?"))
    known = packs_.filter("pack.packId is not null")
    for field, allowed in FIELDS.items():
        where = known if not field else known.select("pack", F.explode(F.from_json(F.get_json_object("text", f"$.{field}"), "array<map<string,string>>")).alias("_entry"))
        keys = F.json_object_keys("text") if not field else F.map_keys("_entry")
        found = where.select(name.alias("pack"), F.explode(keys).alias("key")).filter(~F.col("key").isin(allowed.split()))
        add(found, "unknown-field", F.concat(F.lit(f"{field}." if field else ""), "key"))
    whole = known.select(name.alias("pack"), "pack.*")
    add(whole.filter(F.coalesce("schemaVersion", F.lit(0)) != SCHEMA_VERSION), "unsupported-schema", F.col("schemaVersion"))
    add(whole.filter(~F.coalesce(F.col("packVersion").rlike(r"^[0-9]+\.[0-9]+\.[0-9]+$"), F.lit(False))), "wrong-version", F.col("packVersion"))
    add(whole.filter(~F.coalesce(F.col("packKind").isin("capability", "field", "application"), F.lit(False))), "wrong-kind", F.col("packKind"))
    for field in ("title", "description", "namespace"):
        add(whole.filter(F.trim(F.coalesce(field, F.lit(""))) == ""), "missing-text", F.lit(field))
    add(whole.filter(F.coalesce(F.size("references"), F.lit(0)) < 1), "missing-text", F.lit("references"))
    add(whole.groupBy("pack").count().filter("count > 1"), "duplicate-pack", F.col("count"))
    shared = whole.groupBy("namespace").agg(F.collect_set("pack").alias("_all")).filter(F.size("_all") > 1)
    add(shared.select("namespace", F.explode("_all").alias("pack")), "duplicate-namespace", F.col("namespace"))
    for field in ("concepts", "quantityKinds", "units", "laws", "conceptBridges", "activationRules"):
        add(_listed(known, field).groupBy("pack", F.col("x.id").alias("id")).count().filter("count > 1"), "duplicate-id", F.concat(F.lit(f"{field}/"), "id"))

    needs = _listed(known, "dependencies").select("pack", F.col("x.packId").alias("needed"), F.col("x.versionMajor").alias("major"), F.coalesce("x.requiredCapabilities", F.array().cast("array<string>")).alias("wanted"))
    target = whole.select(F.col("pack").alias("needed"), F.split("packVersion", r"\.")[0].cast("int").alias("_major"), F.coalesce("capabilities.provides", F.array().cast("array<string>")).alias("_gives")).distinct()
    add(needs.join(target, "needed", "left_anti"), "unknown-dependency", F.col("needed"))
    met = needs.join(target, "needed")
    add(met.filter("major <> _major"), "wrong-major", F.col("needed"))
    add(met.select("pack", F.explode(F.array_except("wanted", "_gives")).alias("capability")), "missing-capability", F.col("capability"))
    asked = needs.groupBy("pack").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("wanted")))).alias("_asked"))
    empty = F.array().cast("array<string>")
    stated = whole.join(asked, "pack", "left").filter(F.array_sort(F.array_distinct(F.coalesce("capabilities.requires", empty))) != F.coalesce("_asked", empty))
    add(stated, "wrong-requires", F.array_join(F.coalesce("capabilities.requires", empty), ","))
    add(project.on_cycles(needs.select(F.col("pack").alias("src"), F.col("needed").alias("dst"))), "cyclic-dependency", F.lit(None), F.col("node"))

    own = concepts(known)
    owners = own.groupBy("concept").agg(F.min("pack").alias("_owner"), F.min("kind").alias("_kind"))
    up = own.select("pack", "namespace", F.explode("parents").alias("parent"))
    add(up.join(owners.select(F.col("concept").alias("parent")), "parent", "left_anti"), "unknown-parent", F.col("parent"))
    add(up.filter(~F.col("parent").startswith(F.concat("namespace", F.lit(":")))), "foreign-parent", F.col("parent"))
    add(project.on_cycles(concept_edges(known)), "cyclic-concept", F.col("node"), F.split("node", ":")[0])
    linked = needs.select("pack", F.col("needed").alias("_owner")).unionByName(whole.select("pack", F.col("pack").alias("_owner"))).distinct()
    bridges = _listed(known, "conceptBridges").select("pack", F.col("x.id").alias("id"), F.col("x.source").alias("source"), F.col("x.target").alias("target"))
    ends = bridges.join(owners.select(F.col("concept").alias("source"), F.col("_owner").alias("_from"), F.col("_kind").alias("_a")), "source", "left").join(owners.select(F.col("concept").alias("target"), "_owner", F.col("_kind").alias("_b")), "target", "left")
    add(ends.filter("_from is null"), "unknown-concept", F.col("source"))
    add(ends.filter("_owner is null"), "unknown-concept", F.col("target"))
    add(ends.filter("_from <> pack"), "foreign-bridge", F.col("id"))
    add(ends.filter("_owner is not null and _owner <> pack").join(linked, ["pack", "_owner"], "left_anti"), "undeclared-dependency", F.col("target"))
    add(ends.filter("_a <> _b"), "unlike-concepts", F.col("id"))

    every = laws(known)
    roles = every.select("pack", "law", F.explode("roles").alias("r"))
    meant = roles.select("pack", "law", F.explode(F.array_compact(F.array("r.concept", "r.quantity"))).alias("concept")).join(owners, "concept", "left")
    add(meant.filter("_owner is null"), "unknown-concept", F.concat_ws("/", "law", "concept"))
    add(meant.filter("_owner is not null").join(linked, ["pack", "_owner"], "left_anti"), "undeclared-dependency", F.concat_ws("/", "law", "concept"))
    add(roles.groupBy("pack", "law", F.col("r.id").alias("id")).count().filter("count > 1"), "duplicate-id", F.concat_ws("/", "law", "id"))
    asks = every.select("pack", "law", F.transform("roles", lambda r: r["id"]).alias("_ids"), F.explode("conditions").alias("c"))
    arity = F.broadcast(packs_.sparkSession.createDataFrame([(k, a, b) for k, (a, b) in ARITY.items()], "_k string, _least int, _most int"))
    asks = asks.join(arity, asks["c.kind"] == arity["_k"], "left")
    add(asks.filter("_k is null"), "wrong-condition", F.concat_ws("/", "law", "c.id"))
    add(asks.filter("_k is not null and not size(c.subjects) between _least and _most"), "wrong-arity", F.concat_ws("/", "law", "c.id"))
    add(asks.filter(F.size(F.array_except("c.subjects", "_ids")) > 0), "unknown-subject", F.concat_ws("/", "law", "c.id"))
    add(every.filter("relation is null"), "missing-relation", F.col("law"))
    slots = {k: sorted(part.split("}")[0] for part in form.split("{")[1:]) for k, form in ARCHETYPES.items()}
    wanted = F.broadcast(packs_.sparkSession.createDataFrame(list(slots.items()), "archetype string, wanted array<string>"))
    bound = every.filter("archetype is not null").join(wanted, "archetype", "left")
    fits = (F.array_sort(F.map_keys("slots")) == F.col("wanted")) & (F.array_sort(F.map_values("slots")) == F.array_sort(F.transform("roles", lambda r: r["id"])))
    add(bound.filter(~F.coalesce(fits, F.lit(False))), "wrong-slots", F.col("law"))

    units = _listed(known, "units").select(_named(F.col("x.id")).alias("unit"), F.array_sort("x.dimension").alias("_u"))
    measured = _listed(known, "quantityKinds").filter("x.defaultUnit is not null").select("pack", F.col("x.id").alias("id"), F.col("x.defaultUnit").alias("unit"), F.array_sort("x.dimension").alias("_d")).join(units, "unit", "left")
    add(measured.filter("_u is null"), "unknown-unit", F.concat_ws("/", "id", "unit"))
    add(measured.filter("_u <> _d"), "unlike-unit", F.concat_ws("/", "id", "unit"))
    all_ = out[0]
    for part in out[1:]:
        all_ = all_.unionByName(part)
    return all_.distinct()


def collisions(packs_: DataFrame) -> DataFrame:
    """(relation, laws): relations that several laws state, role names set aside by their order of appearance, for authors."""
    words = F.array_distinct(F.regexp_extract_all("relation", F.lit("[a-z]+(?:-[a-z]+)*"), 0))
    shaped = F.aggregate(F.arrays_zip(F.transform(words, lambda w: w).alias("w"), F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1))).alias("i")), F.concat(F.lit(" "), F.col("relation"), F.lit(" ")), lambda t, e: F.when(e["w"].isNull(), t).otherwise(F.replace(t, F.concat(F.lit(" "), e["w"], F.lit(" ")), F.concat(F.lit(" #"), e["i"].cast("string"), F.lit(" ")))))
    keyed = laws(packs_).withColumn("form", F.trim(shaped))
    return keyed.groupBy(F.col("form").alias("relation")).agg(F.array_sort(F.collect_set(F.concat_ws(":", "pack", "law"))).alias("laws")).filter(F.size("laws") > 1)


@dataclass
class Catalogue:
    """Packs as the rows that recognition joins."""

    forms: DataFrame  # key, law, form, template (JSON), guards, step, truncated
    roles: DataFrame  # law, role, concept, shape, variadic
    conditions: DataFrame  # law, condition, kind, subjects
    terms: DataFrame  # concept, term
    lineage: DataFrame  # concept, ancestors (itself included)


def top_key(tree: list | tuple) -> str:
    """The head of a template and that of its first part that is an expression (* if none is)."""
    return f"{tree[0]}:{next((c[0] for c in tree[1:] if isinstance(c, (list, tuple)) and c[0] not in ('role', 'lit', 'sym', 'num')), '*')}"


#: The key of laws whose sum of any number of terms is zero.
BALANCE = "balance"


def law_forms(relations: list[str], roles: list[dict]) -> tuple[list[tuple[str, str, list[str], str]], bool]:
    """(key, template as JSON, guards, step) of a law's forms and whether there were more; relations that cannot be read give none."""
    names, scalars = {r["id"] for r in roles}, {r["id"] for r in roles if r["shape"] == "scalar"}
    if any(r["variadic"] for r in roles):
        return [(BALANCE, json.dumps(["balance"]), [], "stated")], False
    out, seen, more = [], set(), False
    for k, relation in enumerate(relations):
        if (tree := formulas.parse(relation, words=True)) is None:
            continue
        forms, cut = formulas.guarded_forms(formulas.with_roles(tree, names), scalars)
        more |= cut
        for form, guards, step in forms:
            if form not in seen:
                seen.add(form)
                out.append((top_key(form), json.dumps(form), list(guards), step if k == 0 else f"representation-{step}"))
    return out[: formulas.FORMS], more or len(out) > formulas.FORMS


def compiled(packs_: DataFrame) -> Catalogue:
    """The rows of a catalogue of packs, stored; a law is named ``namespace:id``."""
    every = laws(packs_).withColumn("law", _named(F.col("law")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for law, relation, more, roles in zip(*(b.column(c).to_pylist() for c in ("law", "relation", "representations", "roles"))):
                forms, cut = law_forms([r for r in [relation, *(more or [])] if r], roles or [])
                out += [(key, law, i, template, guards, step, cut) for i, (key, template, guards, step) in enumerate(forms)]
            kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 7, kinds)], names=["key", "law", "form", "template", "guards", "step", "truncated"])

    forms = every.select("law", "relation", "representations", F.transform("roles", lambda r: F.struct(r["id"].alias("id"), r["shape"].alias("shape"), F.coalesce(r["variadic"], F.lit(False)).alias("variadic"))).alias("roles"))
    forms = forms.mapInArrow(run, "key string, law string, form int, template string, guards array<string>, step string, truncated boolean")
    roles = every.select("law", F.explode("roles").alias("r")).select("law", F.col("r.id").alias("role"), F.col("r.concept").alias("concept"), F.col("r.shape").alias("shape"), F.coalesce("r.variadic", F.lit(False)).alias("variadic"))
    conditions = every.select("law", F.explode("conditions").alias("c")).select("law", F.col("c.id").alias("condition"), F.col("c.kind").alias("kind"), F.col("c.subjects").alias("subjects"))
    own = concepts(packs_)
    words = F.trim(F.regexp_replace(F.lower("t"), "[^a-z0-9]+", " "))
    terms = own.select("concept", F.explode("terms").alias("t")).select("concept", words.alias("term")).filter("term <> ''").distinct()
    start = own.select("concept", F.col("concept").alias("node")).distinct()
    lineage = graph.closure_of(start, concept_edges(packs_)).groupBy("concept").agg(F.array_sort(F.collect_set("node")).alias("ancestors"))
    return Catalogue(*(graph.stored(t) for t in (forms, roles, conditions, terms, lineage)))


_BUILTIN: dict[str, Catalogue] = {}


def builtin_catalogue(spark: SparkSession) -> Catalogue:
    """The library's own packs, compiled once an application."""
    key = spark.sparkContext.applicationId
    if key not in _BUILTIN:
        _BUILTIN[key] = compiled(builtin(spark))
    return _BUILTIN[key]
