"""Shapes, shared definitions, implied dimensions and comparisons: present, missing and conflicting evidence."""

import pytest

from lemmata.functions import formulas, shapes
from lemmata.operators import constraints, definitions, navigation

KNOWN = {"A": ("matrix", "2", "3"), "B": ("matrix", "n", "m"), "x": ("vector", "3"), "y": ("vector", "4"), "s": ("scalar",)}


@pytest.mark.parametrize(
    "source, shape, faults",
    [
        ("A x", ("vector", "2"), set()),
        ("A y", None, {shapes.PRODUCT}),
        ("A^T A", ("matrix", "3", "3"), set()),
        ("s A x", ("vector", "2"), set()),
        ("B x", ("vector", "n"), set()),  # a named extent conflicts with nothing
        ("A q", None, set()),
        ("A + 0", ("matrix", "2", "3"), set()),
        ("A + s", None, {shapes.SUM}),
        ("x = y", None, {shapes.SUM}),
        ("x \\cdot y", ("scalar",), set()),
        ("A / s", ("matrix", "2", "3"), set()),
        ("s / A", None, set()),
    ],
)
def test_shapes(source, shape, faults):
    found = set()
    assert shapes.shape(formulas.parse(source), KNOWN, found) == shape and found == faults


@pytest.mark.parametrize(
    "lead, text, n, want",
    [
        ("let", " denote mass and time", 2, ["mass", "time"]),
        ("", " denote mass, time, and charge respectively", 3, ["mass", "time", "charge"]),
        ("", " denote mass", 2, None),
        ("let", " denote mass, time and charge", 2, None),
        ("let", " be vectors whose norm is one", 2, ["vectors", "vectors"]),
        ("we write", " for mass and time in that order", 2, ["mass", "time"]),
        ("suppose", " denote mass and time", 2, None),
    ],
)
def test_shared_descriptions(lead, text, n, want):
    assert definitions.shared_descriptions(lead, text, n) == want


def _docs(spark, *texts):
    return spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "file_id string, content string")


def test_rounds_are_bounded_and_reported(spark):
    docs = _docs(spark, "Let $a$ denote length. Then $d = c$, $c = b$ and $b = a$.", None, "")
    full = {(r.symbol, r.round, r.truncated) for r in constraints.derived_dimensions(docs).collect()}
    assert full == {("a", 0, False), ("b", 1, False), ("c", 2, False), ("d", 3, False)}
    cut = {(r.symbol, r.truncated) for r in constraints.derived_dimensions(docs, rounds=2).collect()}
    assert cut == {("a", True), ("b", True), ("c", True)}


def test_nothing_declared_gives_nothing(spark):
    docs = _docs(spark, "Then $v = x/t$.", "", None)
    assert constraints.derived_dimensions(docs).count() == 0
    assert constraints.shape_diagnostics(docs).count() == 0
    assert constraints.comparison_conflicts(docs).count() == 0


def test_inner_scope_sees_the_outer_comparison(spark):
    docs = _docs(spark, "Take $k < n$.\n# One\nTake $n < k$.", "Take $k < n$ and $n > k$.", "It is not so that $k = n$. Take $k < n$.")
    assert [(r.file_id, r.left, r.right) for r in constraints.comparison_conflicts(docs).collect()] == [("d0", "k", "n")]


def test_selection_outside_all_ranges(spark):
    cursors = spark.createDataFrame([(1, "d0", 0), (2, "none", 0)], "cursor int, file_id string, at int")
    assert navigation.selections(_docs(spark, "Take $k$."), cursors).count() == 0
