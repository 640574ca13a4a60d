"""Shapes of expressions: ("scalar",), ("vector", n) or ("matrix", rows, columns); None is unknown.

Extents are integers or names as strings, '?' where unknown.  Two extents only
conflict if both are integers and differ.
"""

from __future__ import annotations

PRODUCT, SUM = "constraint-product-shape-conflict", "constraint-shape-conflict"
SCALAR = ("scalar",)


def extents_conflict(a: str, b: str) -> bool:
    return a.isdigit() and b.isdigit() and a != b


def conflict(a: tuple, b: tuple) -> bool:
    """Whether two known shapes cannot be the same."""
    return a[0] != b[0] or len(a) != len(b) or any(extents_conflict(x, y) for x, y in zip(a[1:], b[1:]))


def product(a: tuple | None, b: tuple | None, faults: set[str]) -> tuple | None:
    if a is None or b is None:
        return None
    if a == SCALAR or b == SCALAR:
        return b if a == SCALAR else a
    if a[0] != "matrix" or b[0] not in ("matrix", "vector"):
        return None
    if extents_conflict(a[2], b[1]):
        faults.add(PRODUCT)
        return None
    return ("vector", a[1]) if b[0] == "vector" else ("matrix", a[1], b[2])


def shape(tree: tuple, known: dict[str, tuple], faults: set[str]) -> tuple | None:
    """The shape of a tree by those of its symbols; codes of conflicts are added to ``faults``."""
    head, *children = tree
    if head == "sym":
        return known.get(tree[1])
    if head == "num":
        return SCALAR if float(tree[1]) else None  # zero fits every shape
    parts = [shape(c, known, faults) for c in children]
    if head == "product":
        out = parts[0]
        for p in parts[1:]:
            out = product(out, p, faults)
        return out
    if head == "dot":
        return SCALAR if all(p is not None and p[0] == "vector" for p in parts) else None
    if head == "cross":
        return parts[0] if all(p is not None and p[0] == "vector" for p in parts) else None
    if head == "quotient":
        return parts[0] if parts[1] == SCALAR else None
    if head in ("negate", "derivative"):
        return parts[0]
    if head == "transpose":
        return ("matrix", parts[0][2], parts[0][1]) if parts[0] and parts[0][0] == "matrix" else None
    if head == "power":
        return SCALAR if parts[0] == SCALAR else None
    if head in ("sum", "equals"):
        given = [p for p in parts if p is not None]
        if any(conflict(given[0], p) for p in given[1:]):
            faults.add(SUM)
            return None
        return given[0] if given else None
    return None
