"""Binders, packs of a caller, guarded forms, subjects of assumptions, signatures: present, missing and conflicting evidence."""

import json

import pytest

from lemmata.functions import formulas
from lemmata.operators import binders, claims, definitions, laws, navigation, parsed
from lemmata.sources import packs
from lemmata.sources import syntax as front

SCHEMA = "file_id string, content string"


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


@pytest.mark.parametrize(
    "source, key",
    [
        ("\\int_0^1 x dx", "integral(x,x,0,1)"),
        ("\\int x^2 \\, dx + c", "sum(integral(x,power(x,2)),c)"),
        ("\\int_t v", "integral(t,v)"),
        ("\\int \\int x dx dy", "integral(y,integral(x,x))"),
        ("a \\Rightarrow b \\land c", "implies(a,and(b,c))"),
        ("x \\in \\mathbb{R}", "member-of(x,\\mathbb{R})"),
        ("x' = \\|y\\|", "equals(x',norm(y))"),
        ("d = v t", "equals(d,product(v,t))"),
    ],
)
def test_integrals_and_connectives(source, key):
    assert formulas.canonical(formulas.parse(source)) == key


def test_applied_symbols_are_functions_and_others_factors():
    assert formulas.canonical(formulas.parse("f(x) + g(x)", applied=frozenset("f"))) == "sum(apply(f,x),product(g,x))"


def test_guarded_forms_divide_by_scalars_only():
    def forms(relation, roles, scalars):
        tree = formulas.with_roles(formulas.parse(relation, words=True), set(roles))
        return {(str(t), g) for t, g, _ in formulas.guarded_forms(tree, set(scalars))[0]}

    vector = forms("force = mass acceleration", ["force", "mass", "acceleration"], ["mass"])
    assert {g for _, g in vector} == {(), ("mass",)}  # never divided by the acceleration
    scalar = forms("voltage = resistance current", ["voltage", "resistance", "current"], ["voltage", "resistance", "current"])
    assert {g for _, g in scalar} == {(), ("resistance",), ("current",)}
    assert all(g == () for _, g in forms("force = mass acceleration", ["force", "mass", "acceleration"], []))
    many = " ".join(f"r{chr(97 + i)}" for i in range(4))
    tree = formulas.with_roles(formulas.parse(f"x = {many}", words=True), {"x", *many.split()})
    found, more = formulas.guarded_forms(tree, {"x", *many.split()})
    assert len(found) <= formulas.FORMS and isinstance(more, bool)


def test_binders_own_their_uses_and_no_others(spark):
    docs = spark.createDataFrame([("a", "See $\\sum_{i} (i + \\sum_{i} i) + i$. Let $i$ denote current."), ("b", "$\\int_0^1 f(x) dx + x$"), ("c", "$\\sum x$"), ("d", None), ("e", "")], SCHEMA)
    at = front.syntax(docs)
    assert rows(binders.attributed(at).filter("symbol in ('i', 'x')"), "file_id", "use", "declared") == [("a", 11, 11), ("a", 15, 11), ("a", 25, 25), ("a", 28, 25), ("b", 12, 16), ("b", 16, 16)]
    assert [r[1] for r in rows(binders.free_uses(at).filter("text = 'i'"), "file_id", "start")] == [33, 42]
    assert rows(definitions.hygiene(docs), "file_id", "code", "at") == [("a", "used-before-explicit-definition", 33)]
    assert rows(navigation.references(spark.createDataFrame([("a", "Let $i$ denote current. See $\\sum_{i} i + i$.")], SCHEMA)), "use") == [(42,), (5,)]


def test_coordinated_definitions(spark):
    docs = spark.createDataFrame([("a", "Let $a$ denote mass and $b$ denote time."), ("b", "Let $a$ denote mass and $b$."), ("c", "Let $a$ denote bread and butter. Use $b$.")], SCHEMA)
    assert rows(definitions.definitions(docs), "file_id", "symbol", "description") == [("a", "a", "mass"), ("a", "b", "time"), ("b", "a", "mass"), ("c", "a", "bread and butter")]


LAW = "Let $F$ denote force. Let $m$ denote mass. Let $a$ denote acceleration. "


def test_assumptions_count_for_their_subjects_and_formulas(spark):
    docs = spark.createDataFrame(
        [
            ("all", LAW + "All share a common frame. Then $F = m a$."),
            ("own", LAW + "Let $F$, $m$ and $a$ share a common frame. Then $F = m a$."),
            ("other", LAW + "Let $g$ and $h$ share a common frame. Then $F = m a$."),
            ("part", LAW + "Let $F$ and $m$ share a common frame. Then $F = m a$."),
            ("target", LAW + "In a common frame $x = y$. Then $F = m a$."),
            ("inside", LAW + "In a common frame $F = m a$."),
            ("no", LAW + "They share no common frame. Then $F = m a$."),
            ("far", LAW + "All share a common frame. " + "x" * 700 + ". Then $F = m a$."),
        ],
        SCHEMA,
    )
    got = dict(rows(laws.law_statuses(docs), "file_id", "status"))
    assert got == {"all": "verified", "own": "verified", "other": "condition-missing", "part": "condition-missing", "target": "condition-missing", "inside": "verified", "no": "conflicting", "far": "condition-missing"}


def test_a_quotient_needs_its_guard(spark):
    frame = LAW + "All share a common frame. "
    docs = spark.createDataFrame([("open", frame + "Then $a = F/m$."), ("said", frame + "Assume $m$ is nonzero. Then $a = F/m$."), ("sign", frame + "We have $m > 0$. Then $a = F/m$."), ("other", frame + "Assume $F$ is nonzero. Then $a = F/m$."), ("none", frame + "Then $m = F/a$.")], SCHEMA)
    assert rows(laws.law_statuses(docs).filter("law like '%newton%'"), "file_id", "status") == [("open", "condition-missing"), ("other", "condition-missing"), ("said", "verified"), ("sign", "verified")]


def _pack(**more):
    base = {"schemaVersion": 13, "packId": "p", "packVersion": "1.0.0", "packKind": "field", "namespace": "p", "title": "t", "description": "d", "capabilities": {"provides": [], "requires": []}, "references": [{"id": "r"}]}
    return json.dumps(base | more)


def _read(spark, tmp_path, *texts):
    for i, t in enumerate(texts):
        (tmp_path / f"p{i}.json").write_text(t)
    return packs.read_packs(spark, str(tmp_path))


def test_packs_are_read_whole_and_validated(spark, tmp_path):
    good = _pack(concepts=[{"id": "a", "conceptKind": "k", "title": "a", "description": "a", "references": ["r"]}])
    assert packs.faults(_read(spark, tmp_path, good.replace(", ", ",\n"))).count() == 0
    bad = _pack(packId="q", namespace="p", packVersion="1", title=" ", concepts=[{"id": "a", "parents": ["p:a"]}, {"id": "a", "other": 1}], units=[], quantityKinds=[{"id": "z", "dimension": [], "defaultUnit": "p:none"}])
    found = rows(packs.faults(_read(spark, tmp_path, good, bad, "{")), "pack", "fault")
    assert {("q", "wrong-version"), ("q", "missing-text"), ("q", "duplicate-id"), ("q", "unknown-field"), ("q", "unknown-unit"), ("p", "cyclic-concept"), ("?", "unreadable"), ("p", "duplicate-namespace")} <= set(found)
    assert packs.faults(packs.builtin(spark)).count() == 0


def test_a_callers_law_is_recognised_by_lineage(spark, tmp_path):
    concept = lambda i, *parents: {"id": i, "conceptKind": "k", "title": i, "description": i, "parents": list(parents), "references": ["r"]}
    role = lambda i, c: {"id": i, "concept": c, "description": i, "shape": "scalar"}
    law = {"id": "l", "title": "l", "description": "l", "canonicalRelation": "yield-value = soil-value water-value", "roles": [role("yield-value", "p:crop"), role("soil-value", "p:soil"), role("water-value", "p:water")], "references": ["r"]}
    own = _read(spark, tmp_path, _pack(concepts=[concept("crop"), concept("wheat", "p:crop"), concept("soil"), concept("water")], laws=[law]))
    known = packs.compiled(packs.builtin(spark).unionByName(own))
    text = "Let $y$ denote {}. Let $s$ denote soil. Let $w$ denote water. Then ${}$."
    docs = spark.createDataFrame([("a", text.format("wheat", "y = s w")), ("b", text.format("crop", "s = y/w")), ("c", text.format("mass", "y = s w")), ("d", text.format("wheat", "w s = y"))], SCHEMA)
    found = laws.recognitions(docs, known)
    assert rows(found, "file_id", "law", "support") == [("a", "p:l", "typed"), ("b", "p:l", "typed"), ("d", "p:l", "typed")]
    assert rows(laws.with_status(found, docs, known), "file_id", "status") == [("a", "recognized"), ("b", "condition-missing"), ("d", "recognized")]
    assert laws.recognitions(docs).count() == 0  # the library's own packs know nothing of it


def test_parsed_documents_serve_all_operators(spark):
    docs = spark.createDataFrame([("a", LAW + "All share a common frame. Then $F = m a$."), ("b", None), ("c", "")], SCHEMA)
    once = parsed.parsed(docs)
    assert parsed.parsed(once) is once
    for f in (definitions.definitions, definitions.hygiene, laws.law_statuses, claims.relation_claims, laws.formula_facts):
        assert sorted(map(str, f(docs).collect())) == sorted(map(str, f(once).collect()))


def test_work_is_bounded_by_file(spark):
    docs = spark.createDataFrame([("a", "Let $x$ denote length. " + " ".join(f"Then $y_{i} = x$." for i in range(9))), ("b", "Let $x$ denote length. Then $y = x$.")], SCHEMA)
    got = {(r.file_id, r.truncated) for r in claims.derived_facts(docs, work=8).collect()}
    assert got == {("a", True), ("b", False)}
    assert {r.truncated for r in claims.derived_facts(docs).collect()} == {False}


def test_domains_by_scope_denial_and_law(spark):
    from lemmata.operators import domains

    law = "Let $V$ denote voltage. Let $R$ denote resistance. Let $I$ denote current. With the passive sign convention, $V = R I$. "
    docs = spark.createDataFrame([("a", "# Circuits\nWe use fluid mechanics. $x = 1$.\n# Next\n$y = 2$."), ("b", "This is not fluid mechanics. About fluid mechanics: $x = 1$."), ("c", law + "Then $x = 1$."), ("d", None), ("e", "")], SCHEMA)
    got = rows(domains.activations(docs).filter("at > 60 or file_id in ('a', 'b')"), "file_id", "pack", "support")
    assert got == [("a", "circuits", "supported"), ("a", "fluid-mechanics", "tentative"), ("c", "circuits", "explicit"), ("c", "circuits", "supported")]
    assert {(r.truncated, r.rank) for r in domains.activations(docs, cap=1).filter("file_id = 'a'").collect()} == {(True, 1)}


def test_facts_tell_by_which_form_a_law_was_recognised(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry

    docs = spark.createDataFrame([("a", LAW + "Then $F = m a$."), ("b", LAW + "Then $a = F/m$.")], SCHEMA)
    assert rows(laws.formula_facts(docs).filter("what = 'law'"), "file_id", "support", "step") == [("a", "typed", "stated"), ("b", "typed", "factor-isolation")]
    # force = mass acceleration, acceleration = force / mass, velocity = momentum / mass, each with both signs
    keys = [(5 + 12 * 2 + 144 * 4), (4 + 12 * 5 + 144 * 2), (3 + 12 * 10 + 144 * 2)]
    spark.createDataFrame([(k + 1728 * s, s) for k in keys for s in (0, 1)], "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    names = ["file_id", "what", "value", "support"]
    con = duckdb.connect()
    con.execute(f"create view part as select * from '{tmp_path}/part.parquet/*.parquet'")
    want = con.sql(entry.oracle_sql()["part_formulas"]).project(", ".join(names)).fetchall()
    assert rows(entry.queries()["part_formulas"](spark, str(tmp_path)), *names) == sorted(want, key=str)
