"""Claims of formulas, facts that they imply and readings, on small documents."""

from lemmata.functions import formulas
from lemmata.operators import claims, readings

SCHEMA = "file_id string, content string"


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def test_products_and_powers_fold_from_the_left():
    assert claims.tree_claims(formulas.parse("a b c")) == [("product", "product(a,b)", "a", "b"), ("product", "product(a,b,c)", "product(a,b)", "c")]
    assert claims.tree_claims(formulas.parse("x^3")) == [("product", "power(x,2)", "x", "x"), ("product", "power(x,3)", "power(x,2)", "x")]
    assert claims.tree_claims(formulas.parse("x")) == []


def test_facts_go_through_powers_sums_and_transposition(spark):
    text = "Let $l$ denote length. Then $V = l^3$. Let $A$ denote a 2 by 3 matrix. Then $B = A^T$. If so, $q = l$."
    docs = spark.createDataFrame([("a", text), ("a2", None), ("a3", ""), ("a4", "No formula.")], SCHEMA)
    got = rows(claims.derived_facts(docs), "symbol", "predicate", "value", "truncated")
    assert got == [("A", "shape", "matrix(2,3)", False), ("B", "shape", "matrix(3,2)", False), ("V", "dimension", "length:3/1", False), ("l", "dimension", "length:1/1", False)]


def test_rounds_are_bounded_and_reported(spark):
    chain = " ".join(f"Then $x_{k + 1} = x_{k}$." for k in range(5))
    docs = spark.createDataFrame([("a", "Let $x_0$ denote length. " + chain)], SCHEMA)
    got = rows(claims.derived_facts(docs, rounds=2), "symbol", "round", "truncated")
    assert got == [("x_0", 0, True), ("x_1", 1, True), ("x_2", 2, True)]


def test_zero_fits_everything_and_other_numbers_are_plain(spark):
    docs = spark.createDataFrame([("a", "Let $s$ denote length. Then $s = 0$."), ("b", "Let $s$ denote length. Then $s = 2$."), ("c", "Let $s$ denote length. Perhaps $s = 2$.")], SCHEMA)
    assert rows(claims.claim_conflicts(docs), "file_id", "code") == [("b", "quantity-assignment-dimension-mismatch")]


def test_repeated_claims_count_once_and_empty_tables_give_nothing(spark):
    docs = spark.createDataFrame([("a", "Here $x = y$. Again $x = y$.")], SCHEMA)
    assert rows(claims.relation_claims(docs), "at", "predicate", "result", "left") == [(5, "equals", "x", "y")]
    none = docs.limit(0)
    for f in (claims.relation_claims, claims.derived_facts, claims.claim_conflicts, claims.diagnostics, readings.chained, readings.interpretations, readings.requirements, readings.flows, readings.output_descriptions):
        assert f(none).count() == 0


def test_a_role_of_a_law_types_a_later_formula_only(spark):
    said = "Let $m$ denote mass. Let $a$ denote acceleration. Let $v$ denote velocity. Let $P$ denote power. Assume a common frame for all. "
    docs = spark.createDataFrame([("after", said + r"Then $F = m a$. Then $P = F \cdot v$."), ("before", said + r"Then $P = F \cdot v$. Then $F = m a$.")], SCHEMA)
    got = [(f, law.split(":")[1], s, h) for f, law, s, h in rows(readings.chained(docs), "file_id", "law", "support", "hop")]
    assert ("after", "mechanical-power", "derived", 1) in got and ("before", "mechanical-power", "inferable", 0) in got


def test_flows_need_words_and_nearness(spark):
    far = "We have $a = b$, hence " + "x" * 400 + " $c = d$."
    docs = spark.createDataFrame([("a", "We have $a = b$, thus $c = d$."), ("b", "We have $a = b$ and $c = d$."), ("c", far), ("d", "Not so. $a = b$; thus it is not $c = d$.")], SCHEMA)
    assert rows(readings.flows(docs), "file_id", "kind") == [("a", "consequence")]
