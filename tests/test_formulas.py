"""Formulas: precedence, canonical keys, dimensions and matching of single expressions."""

import pytest

from lemmata.functions import formulas, quantities


@pytest.mark.parametrize(
    "source, key",
    [
        ("a+b c", "sum(a,product(b,c))"),
        ("a=b=c", "system(equals(a,b),equals(a,c))"),
        ("a<b\\le c", "system(less-than(a,b),less-or-equal(b,c))"),
        ("-x^2", "negate(power(x,2))"),
        ("A^T x", "product(transpose(A),x)"),
        ("\\frac{\\partial u}{\\partial t}", "derivative(u,t)"),
        ("\\dot{x} = A x + B u", "equals(derivative(x,t),sum(product(A,x),product(B,u)))"),
        ("A \\cap B \\cup C", "union(intersection(A,B),C)"),
        ("\\sqrt{x}", "power(x,quotient(1,2))"),
        ("\\left(a+b\\right) c", "product(sum(a,b),c)"),
        ("a/b/c", "quotient(quotient(a,b),c)"),
        ("x_{12} y", "product(x_{12},y)"),
    ],
)
def test_canonical(source, key):
    assert formulas.canonical(formulas.parse(source)) == key


@pytest.mark.parametrize("source", [None, "", "a = (", "a +", ")", "\\frac{d y}{x}", "((((" * 5000])
def test_outside_the_grammar_is_unknown(source):
    assert formulas.parse(source) is None


def test_dimensions():
    faults = set()
    known = {s: quantities.KIND_DIMENSION[k] for s, k in {"v": "velocity", "t": "duration", "x": "length", "m": "mass"}.items()}
    assert formulas.dimension(formulas.parse("v t"), known, faults) == {"length": 1}
    assert formulas.dimension(formulas.parse("\\frac{d x}{d t}"), known, faults) == known["v"]
    assert formulas.dimension(formulas.parse("v = x/t"), known, faults) == known["v"] and not faults
    assert formulas.dimension(formulas.parse("v = q/t"), known, faults) == known["v"] and not faults  # unknown is no conflict
    formulas.dimension(formulas.parse("v = m/t"), known, faults)
    assert faults == {"quantity-assignment-dimension-mismatch"}


def test_unification():
    law = formulas.parse("power = force \\cdot velocity", words=True)
    assert {tuple(sorted((k, v[1]) for k, v in b.items())) for b in formulas.unify(law, formulas.parse("v \\cdot F = P"), {})} == {
        (("force", "F"), ("power", "P"), ("velocity", "v")),
        (("force", "v"), ("power", "P"), ("velocity", "F")),
    }
    product = formulas.parse("net-force = mass acceleration", words=True)
    assert len(formulas.unify(product, formulas.parse("F = m a"), {})) == 1  # products keep their order
    assert formulas.unify(product, formulas.parse("F = -m a"), {}) == []
