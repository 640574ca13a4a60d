"""Formulas: a small precedence parser, canonical keys, dimensions and law matching of one expression.

A tree is a tuple (head, *children); leaves are ("sym", name) and ("num", text).
Text outside the grammar gives None: nothing is known about it.
"""

from __future__ import annotations

import re
from fractions import Fraction
from itertools import permutations

# Relations by spelling.
RELATIONS = {"=": "equals", ":=": "equals", "<": "less-than", ">": "greater-than", "\\le": "less-or-equal", "\\leq": "less-or-equal", "\\ge": "greater-or-equal", "\\geq": "greater-or-equal", "\\ne": "not-equals", "\\neq": "not-equals", "\\approx": "approximately-equals", "\\in": "member-of", "\\subset": "proper-subset", "\\subseteq": "subset"}
# Logical connectives, which bind weaker than relations; implications weaker than conjunctions.
IMPLIES = {"\\Rightarrow": "implies", "\\implies": "implies", "\\Longrightarrow": "implies", "\\Leftrightarrow": "iff", "\\iff": "iff", "\\Longleftrightarrow": "iff"}
JOINS = {"\\land": "and", "\\wedge": "and", "\\lor": "or", "\\vee": "or"}
CONNECTIVES = ("implies", "iff", "and", "or")
_TIMES = {"\\cdot": "dot", "\\times": "cross", "*": "product", "/": "quotient"}
_SETS = {"\\cap": "intersection", "\\cup": "union"}
_BOUND = {"\\sum": "bound-sum", "\\prod": "bound-product", "\\int": "integral", "\\lim": "limit"}
_OPEN = {"(": ")", "{": "}", "[": "]"}
_SKIP = re.compile(r"\\(?:left|right|quad|qquad|displaystyle|,|;|!|:)(?![A-Za-z])|\s+|~")
_NAME = r"(?:[A-Za-z]|\\[A-Za-z]+)(?:_(?:\{[^{}]*\}|[A-Za-z0-9]))?"
_SET_NAME = r"\\math(?:bb|cal)\{[A-Za-z]+\}"
_TOKEN = re.compile(rf":=|\d+(?:\.\d+)?|{_SET_NAME}|\\\||\\[lr]Vert(?![A-Za-z])|{_NAME}'*|.")
_WORD = re.compile(r"\\[A-Za-z]+|\d+|[a-z]+(?:-[a-z]+)*|.")
_NORMS = {"\\|": "\\|", "\\lVert": "\\rVert"}
_STOP = {")", "}", "]", "+", "-", ",", "\\rVert", "\\|", *RELATIONS, *_SETS, *IMPLIES, *JOINS}


class _Parser:
    def __init__(self, source: str, words: bool, applied: frozenset[str] = frozenset()):
        source = _SKIP.sub(" ", source)
        self.tokens = [t for t in (_WORD if words else _TOKEN).findall(source) if t.strip()]
        self.applied = applied  # symbols of functions, which a bracket behind applies
        self.at = 0
        self.integrals = 0  # that still wait for their differential

    def peek(self) -> str | None:
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def take(self) -> str:
        if self.at == len(self.tokens):
            raise ValueError("the formula ends early")
        self.at += 1
        return self.tokens[self.at - 1]

    def expect(self, token: str) -> None:
        if self.take() != token:
            raise ValueError(f"{token} is missing")

    def statement(self) -> tuple:
        left = self.joined()
        while self.peek() in IMPLIES:
            left = (IMPLIES[self.take()], left, self.joined())
        return left

    def joined(self) -> tuple:
        left = self.relation()
        while self.peek() in JOINS:
            kind, right = JOINS[self.take()], self.relation()
            left = (*left, right) if left[0] == kind else (kind, left, right)
        return left

    def relation(self) -> tuple:
        sides, ops = [self.sets()], []
        while self.peek() in RELATIONS:
            ops.append(RELATIONS[self.take()])
            sides.append(self.sets())
        if not ops:
            return sides[0]
        share = set(ops) == {"equals"}  # a = b = c compares all with a
        pairs = [(op, sides[0] if share else sides[i], sides[i + 1]) for i, op in enumerate(ops)]
        return pairs[0] if len(pairs) == 1 else ("system", *pairs)

    def sets(self) -> tuple:
        left = self.sum()
        while self.peek() in _SETS:
            left = (_SETS[self.take()], left, self.sum())
        return left

    def sum(self) -> tuple:
        terms = [self.product()]
        while self.peek() in ("+", "-"):
            terms.append(("negate", self.product()) if self.take() == "-" else self.product())
        return terms[0] if len(terms) == 1 else ("sum", *terms)

    def product(self) -> tuple:
        left = self.prefix()
        while (token := self.peek()) is not None and token not in _STOP and not self.differential_ahead():
            kind = _TIMES.get(token, "product")
            if token in _TIMES:
                self.take()
            right = self.prefix()
            left = (*left, right) if kind == left[0] == "product" else (kind, left, right)
        return left

    def differential_ahead(self) -> bool:
        """Whether an integral's ``d x`` comes next."""
        after = self.tokens[self.at + 1 : self.at + 2]
        return bool(self.integrals and self.peek() == "d" and after and re.fullmatch(rf"{_NAME}'*", after[0]))

    def prefix(self) -> tuple:
        if self.peek() == "-":
            self.take()
            return ("negate", self.prefix())
        if self.peek() == "+":
            self.take()
            return self.prefix()
        base = self.atom()
        while self.peek() == "^":
            self.take()
            raised = self.braced() if self.peek() == "{" else self.atom()
            base = ("transpose", base) if raised in (("sym", "T"), ("sym", "\\top")) else ("power", base, raised)
        return base

    def braced(self) -> tuple:
        self.expect("{")
        inside = self.sum()
        self.expect("}")
        return inside

    def atom(self) -> tuple:
        token = self.take()
        if token in _OPEN:
            waiting, self.integrals = self.integrals, 0
            inside = [self.sum()]
            while self.peek() == ",":
                self.take()
                inside.append(self.sum())
            self.expect(_OPEN[token])
            self.integrals = waiting
            return inside[0] if len(inside) == 1 else ("tuple", *inside)
        if token[0].isdigit():
            return ("num", token)
        if token in ("\\frac", "\\dfrac", "\\tfrac"):
            return self.fraction()
        if token in _NORMS:
            inside = self.sum()
            self.expect(_NORMS[token])
            return ("norm", inside)
        if token == "\\sqrt":
            return ("power", self.braced(), ("quotient", ("num", "1"), ("num", "2")))
        if token in ("\\dot", "\\ddot"):
            inner = ("derivative", self.braced(), ("sym", "t"))
            return inner if token == "\\dot" else ("derivative", inner, ("sym", "t"))
        if token in ("\\mathbf", "\\mathrm", "\\vec", "\\boldsymbol"):
            return self.braced()
        if token == "\\nabla":
            return self.nabla()
        if token == "\\operatorname":
            return self.operator()
        if token.split("_")[0] in _BOUND:
            return self.bound(token)
        if token in self.applied and self.peek() == "(":
            inside = self.atom()
            return ("apply", ("sym", token), *(inside[1:] if inside[0] == "tuple" else (inside,)))
        if token[0] == "\\" and len(token) > 1 or token[0].isalpha():
            return ("sym", token)
        raise ValueError(f"{token} starts nothing")

    def nabla(self) -> tuple:
        if self.peek() == "^":
            self.take()
            if (self.braced() if self.peek() == "{" else self.atom()) != ("num", "2"):
                raise ValueError("a power of nabla other than 2")
            return ("laplacian", self.prefix())
        if self.peek() in ("\\cdot", "\\times"):
            return ("divergence" if self.take() == "\\cdot" else "curl", self.prefix())
        return ("gradient", self.prefix())

    def operator(self) -> tuple:
        self.expect("{")
        name = ""
        while self.peek() != "}":
            name += self.take()
        self.take()
        inside = self.prefix()
        return ("divergence", inside) if name == "div" else ("apply", ("sym", f"\\{name}"), *(inside[1:] if inside[0] == "tuple" else (inside,)))

    def bound(self, token: str) -> tuple:
        """A sum, product, integral or limit: its variable (if one is named) and what it binds."""
        head, _, below = token.partition("_")
        above = ""
        while self.peek() in ("_", "^"):
            mark = self.take()
            text = self.enclosed()
            below, above = (text, above) if mark == "_" else (below, text)
        name = re.match(r"\{?\s*(\\?[A-Za-z]+)", below)
        if head != "\\int":
            return (_BOUND[head], ("sym", name[1]) if name else ("num", "0"), self.product())
        self.integrals += 1
        body = ("num", "1") if self.differential_ahead() else self.product()
        self.integrals -= 1
        if not (self.peek() == "d" and self.at + 1 < len(self.tokens)):  # no differential: over the subscript
            return ("integral", ("sym", name[1]) if name else ("num", "0"), body)
        self.take()
        variable = ("sym", self.take())
        limits = [parse(t[1:-1] if t.startswith("{") else t) for t in (below, above) if t]
        if None in limits:
            raise ValueError("limits that cannot be read")
        return ("integral", variable, body, *limits)

    def enclosed(self) -> str:
        if self.peek() != "{":
            return self.take()
        depth, out = 0, ""
        while True:
            out += (token := self.take())
            depth += (token == "{") - (token == "}")
            if not depth:
                return out

    def fraction(self) -> tuple:
        top, bottom = self.differential(), self.differential()
        if top[0] and bottom[0]:
            order, by = 1, bottom[1]
            if by[0] == "power" and by[2][0] == "num" and by[2][1].isdigit():
                order, by = int(by[2][1]), by[1]
            if top[2] != order:
                raise ValueError("a derivative of two orders")
            out = top[1]
            for _ in range(order):
                out = ("derivative", out, by)
            return out
        if top[0] or bottom[0]:
            raise ValueError("half a derivative")
        return ("quotient", top[1], bottom[1])

    def differential(self) -> tuple[bool, tuple, int]:
        """Whether braces hold a differential, their content without its sign, and the sign's power."""
        self.expect("{")
        sign = self.peek() in ("d", "\\partial") and self.tokens[self.at + 1 : self.at + 2] != ["}"]
        order = 1
        if sign:
            self.take()
            if self.peek() == "^":
                self.take()
                power = self.braced() if self.peek() == "{" else self.atom()
                if power[0] != "num" or not power[1].isdigit() or not 1 <= int(power[1]) <= 9:
                    raise ValueError("a derivative without an order")
                order = int(power[1])
        inside = self.sum()
        self.expect("}")
        return sign, inside, order


def parse(source: str | None, words: bool = False, applied: frozenset[str] = frozenset()) -> tuple | None:
    """The tree of a formula; with ``words``, identifiers are hyphened words as in templates.

    A symbol of ``applied`` is a function of what stands in brackets behind it; others are its factors.
    """
    if not source:
        return None
    if not words and ("\\\\" in source or "&" in source):
        return _rows(source, applied)
    parser = _Parser(source, words, applied)
    try:
        tree = parser.statement()
    except (ValueError, RecursionError):
        return None
    return tree if parser.at == len(parser.tokens) else None


_ENVIRONMENT = re.compile(r"\s*\\begin\{(aligned|split|gathered|cases|matrix|pmatrix|bmatrix|vmatrix)\}(.*)\\end\{\1\}\s*", re.S)


def _rows(source: str, applied: frozenset[str] = frozenset()) -> tuple | None:
    """Rows of an environment: equations as a system (a row that begins with a relation goes on from the left side before), cases, or a matrix."""
    found = _ENVIRONMENT.fullmatch(source)
    kind, body = (found[1], found[2]) if found else ("aligned", source)
    rows = [[c.strip() for c in r.split("&")] for r in body.split("\\\\") if r.strip()]
    if kind == "cases" or kind.endswith("matrix"):
        if kind.endswith("matrix") and len({len(r) for r in rows}) > 1:
            return None
        cells = [parse(c, applied=applied) for r in rows for c in (r[:1] if kind == "cases" else r)]
        head = ("cases",) if kind == "cases" else ("matrix", ("num", str(len(rows))))
        return None if not cells or None in cells else (*head, *cells)
    out, left = [], None
    for r in rows:
        text = " ".join(c for c in r if c).rstrip(",.")
        first = next((t for t in sorted(RELATIONS, key=len, reverse=True) if text.startswith(t)), None)
        tree = parse(f"{left} {text}" if first and left else text, applied=applied)
        if tree is None:
            return None
        out += tree[1:] if tree[0] == "system" else (tree,)
        if not first and (m := re.match(r"(.*?)\s*(?:=|<|>|\\le|\\ge)", text)):
            left = m[1]
    return out[0] if len(out) == 1 else ("system", *out) if out else None


def canonical(tree: tuple) -> str:
    """A stable key such as ``equals(F,product(m,a))``."""
    return tree[1] if tree[0] in ("sym", "num") else f"{tree[0]}({','.join(canonical(c) for c in tree[1:])})"


def from_canonical(key: str) -> tuple:
    """The tree of a key of numbers, such as ``negate(quotient(1,2))``."""
    head, _, rest = key.partition("(")
    if not rest:
        return ("num", key)
    parts, depth, last = [], 0, 0
    for i, c in enumerate(rest[:-1]):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            parts.append(rest[last:i])
            last = i + 1
    return (head, *(from_canonical(p) for p in (*parts, rest[last:-1])))


def number(tree: tuple) -> Fraction | None:
    """The value of a tree of numbers."""
    if tree[0] == "num":
        return Fraction(tree[1])
    if tree[0] == "negate" and (n := number(tree[1])) is not None:
        return -n
    if tree[0] == "quotient" and None not in (parts := (number(tree[1]), number(tree[2]))) and parts[1]:
        return parts[0] / parts[1]
    return None


def _merged(a: dict | None, b: dict | None, sign: int) -> dict | None:
    if a is None or b is None:
        return None
    out = {k: Fraction(a.get(k, 0)) + sign * Fraction(b.get(k, 0)) for k in a.keys() | b.keys()}
    return {k: v for k, v in out.items() if v}


def dimension(tree: tuple, known: dict[str, dict], faults: set[str]) -> dict | None:
    """The dimension of a tree by those of its symbols, None if unknown; codes of mismatches are added to ``faults``."""
    head, *children = tree
    if head == "sym":
        return known.get(tree[1])
    if head == "num":
        return None if not Fraction(tree[1]) else {}
    parts = [dimension(c, known, faults) for c in children]
    if head in ("product", "dot", "cross"):
        out: dict | None = {}
        for p in parts:
            out = _merged(out, p, 1)
        return out
    if head in ("quotient", "derivative"):
        return _merged(parts[0], parts[1], -1)
    if head == "power":
        n = number(children[1])
        return None if parts[0] is None or n is None else {k: v * n for k, v in parts[0].items() if v * n}
    if head in ("negate", "transpose"):
        return parts[0]
    if head in ("sum", "equals", "less-than", "greater-than", "less-or-equal", "greater-or-equal"):
        given = [p for p in parts if p is not None]
        if any(p != given[0] for p in given[1:]):
            faults.add("quantity-addition-dimension-mismatch" if head == "sum" else "quantity-assignment-dimension-mismatch")
            return None
        return given[0] if given else None
    return None


def unify(template: tuple, tree: tuple, bound: dict[str, tuple]) -> list[dict[str, tuple]]:
    """All bindings of a template's roles (or words) to subtrees; = and sums commute, products keep their order."""
    if template[0] == "lit":
        return [bound] if tree == ("sym", template[1]) else []
    if template[0] == "role" or template[0] == "sym" and "\\" not in template[1]:
        if template[1] in bound:
            return [bound] if bound[template[1]] == tree else []
        return [] if tree[0] in ("negate", "num") else [bound | {template[1]: tree}]
    if template[0] in ("sym", "num"):
        return [bound] if template == tree else []
    if template[0] != tree[0] or len(template) != len(tree):
        return []
    commutes = template[0] in ("equals", "sum", "dot", "intersection", "union")

    def rest(wanted: tuple, have: tuple, b: dict) -> list[dict]:
        if not wanted:
            return [b]
        choices = range(len(have)) if commutes else range(1)
        return [out for i in choices for got in unify(wanted[0], have[i], b) for out in rest(wanted[1:], have[:i] + have[i + 1 :], got)]

    return rest(template[1:], tree[1:], bound)


def with_roles(tree: tuple, roles: set[str]) -> tuple:
    """A template whose words that name roles stand for anything; other words are commands of that name, or letters."""
    if tree[0] == "sym":
        return ("role", tree[1]) if tree[1] in roles else ("lit", tree[1] if len(tree[1].lstrip("\\")) == 1 or tree[1][0] == "\\" else f"\\{tree[1]}")
    return (tree[0], *(with_roles(c, roles) if isinstance(c, tuple) else c for c in tree[1:]))


def scalar_orders(tree: tuple, scalars: set[str], most: int = 4) -> list[tuple]:
    """The template with the factors of its products in every order, where all of at most ``most`` factors are scalar roles."""
    if tree[0] in ("role", "lit", "sym", "num"):
        return [tree]
    children: list[tuple] = [()]
    for c in tree[1:]:
        children = [(*done, x) for done in children for x in scalar_orders(c, scalars, most)]
    if tree[0] == "product" and len(tree) - 1 <= most and all(c[0] == "role" and c[1] in scalars for c in tree[1:]):
        return [(tree[0], *p) for p in permutations(tree[1:])]
    return [(tree[0], *c) for c in children]


#: Forms of a law that are tried.
FORMS = 64


def _one(parts: tuple) -> tuple:
    return parts[0] if len(parts) == 1 else ("product", *parts)


def guarded_forms(relation: tuple, scalars: set[str]) -> tuple[list[tuple[tuple, tuple[str, ...], str]], bool]:
    """(template, roles that must not be zero, step) of the equivalent forms of a law, the stated one first, at most ``FORMS``; and whether there were more.

    Factors of scalar roles commute; a product of two with a scalar among them may be written with a dot; a factor is isolated by
    dividing by others that are all scalar roles; ``x = 1 / y`` gives ``y = 1 / x``, and ``x = y / z`` gives ``y = x z`` and, between
    scalars, ``z = y / x``.
    """
    scalar = lambda t: t[0] == "role" and t[1] in scalars
    found: list[tuple[tuple, tuple[str, ...], str]] = [(relation, (), "stated")]
    if relation[0] == "equals":
        for left, right in ((relation[1], relation[2]), (relation[2], relation[1])):
            if right[0] == "product":
                for i, factor in enumerate(right[1:], 1):
                    rest = right[1:i] + right[i + 1 :]
                    if all(map(scalar, rest)) and factor[0] == "role":
                        found.append((("equals", factor, ("quotient", left, _one(rest))), tuple(r[1] for r in rest), "factor-isolation"))
            if right[0] == "quotient" and scalar(right[2]):
                below = right[2]
                if right[1] == ("num", "1"):
                    if scalar(left):
                        found.append((("equals", below, ("quotient", ("num", "1"), left)), (left[1],), "reciprocal"))
                elif left[0] == "role":
                    found.append((("equals", right[1], ("product", left, below)), (below[1],), "cleared-quotient"))
                    if scalar(left):
                        found.append((("equals", below, ("quotient", right[1], left)), (left[1],), "factor-isolation"))
    out, seen = [], set()
    for tree, guards, step in found:
        for order in _dotted(tree, scalar):
            for form in scalar_orders(order, scalars):
                if form not in seen:
                    seen.add(form)
                    out.append((form, guards, step if form == tree else step if step != "stated" else "scalar-permutation"))
    return out[:FORMS], len(out) > FORMS


def _dotted(tree: tuple, scalar) -> list[tuple]:
    """The tree, and with each product of two, one of them a scalar, written with a dot instead."""
    if tree[0] in ("role", "lit", "sym", "num"):
        return [tree]
    children: list[tuple] = [()]
    for c in tree[1:]:
        children = [(*done, x) for done in children for x in _dotted(c, scalar)]
    out = [(tree[0], *c) for c in children]
    if tree[0] == "product" and len(tree) == 3 and any(map(scalar, tree[1:])):
        out += [("dot", *c[1:]) for c in list(out)]
    return out


def symbols(tree: tuple) -> list[str]:
    """The symbols of a tree, sorted."""
    if tree[0] == "sym":
        return [tree[1]]
    return [] if tree[0] == "num" else sorted({x for c in tree[1:] for x in symbols(c)})


def nodes(tree: tuple, parent: int | None = None, start: int = 0) -> list[tuple]:
    """(node, parent, ordinal, head, text, canonical) rows of a tree in preorder."""
    out = [(start, parent, 0, tree[0], tree[1] if tree[0] in ("sym", "num") else None, canonical(tree))]
    if tree[0] in ("sym", "num"):
        return out
    for k, child in enumerate(tree[1:]):
        below = nodes(child, start, start + len(out))
        out += [(below[0][0], start, k, *below[0][3:]), *below[1:]]
    return out


_BINDER = re.compile(r"\\(sum|prod|int|lim|forall|exists)(?![A-Za-z])")
_PIECE = re.compile(r"\\[A-Za-z]+|\\.|[A-Za-z]|\S")
_LETTER = re.compile(r"[A-Za-z]|\\[A-Za-z]+")
_ENDS = {"+", "-", ",", *RELATIONS, *_SETS, *IMPLIES, *JOINS}


def _group_end(source: str, at: int) -> int:
    """Where the group or piece that begins at a place ends."""
    depth = 0
    for m in _PIECE.finditer(source, at):
        depth += (m[0] in _OPEN) - (m[0] in _OPEN.values())
        if depth <= 0:
            return m.end()
    return len(source)


def _span_end(source: str, at: int, stops: set[str]) -> int:
    """The end of a span that runs to the first of ``stops`` outside brackets, to the bracket around it, or to the end; a sign at its front is part of it."""
    depth, last = 0, at
    for m in _PIECE.finditer(source, at):
        if m[0] in _OPEN.values():
            depth -= 1
            if depth < 0:
                return last
        elif depth == 0 and m[0] in stops and last > at:
            return last
        depth += m[0] in _OPEN
        last = m.end()
    return len(source)


def binders(source: str) -> list[tuple[str, str, int, int, int]]:
    """(binder, symbol, declaration, start, end): what each binder binds, where it is declared, and its scope, from the declaration on.

    A sum, product or limit binds the first letter of its subscript through the term behind it, an integral the letter of its
    differential from its sign on (or else that of its subscript), a quantifier the letter behind it to the end of its group.
    """
    out = []
    for m in _BINDER.finditer(source):
        at, letter = m.end(), None
        if m[1] in ("forall", "exists"):
            if letter := _LETTER.match(source, at + len(source[at:]) - len(source[at:].lstrip())):
                out.append((m[1], letter[0], letter.start(), letter.start(), _span_end(source, letter.end(), set())))
            continue
        while (mark := re.compile(r"\s*([_^])\s*").match(source, at)) is not None:
            at = _group_end(source, mark.end())
            if mark[1] == "_":
                letter = letter or _LETTER.match(source, next((k for k in range(mark.end(), at) if source[k] not in "{ "), at), at)
        if m[1] == "int":
            end = _span_end(source, at, {"=", ","})
            depth, inner = 0, 0
            for d in _PIECE.finditer(source, at, end):
                depth += (d[0] in _OPEN) - (d[0] in _OPEN.values())
                inner += d[0] == "\\int"
                own = _LETTER.match(source, d.end() + len(source[d.end() :]) - len(source[d.end() :].lstrip())) if d[0] == "d" and not depth else None
                if own and inner:  # an inner integral's
                    inner -= 1
                elif own:
                    out.append(("int", own[0], own.start(), m.start(), own.end()))
                    break
            else:
                if letter:
                    out.append(("int", letter[0], letter.start(), letter.start(), _span_end(source, at, _ENDS)))
        elif letter:
            out.append((m[1], letter[0], letter.start(), letter.start(), _span_end(source, at, _ENDS)))
    return out


# Families of notation that has more than one reading, by how they are written.
_FAMILIES = [
    ("application", re.compile(r"(?<![A-Za-z\\])[A-Za-z]\s*\((?=[^()]*\))"), ("application", "product")),
    ("decoration", re.compile(r"\\(?:hat|bar|tilde|vec|dot|ddot|overline)(?![A-Za-z])"), ("decorated-symbol", "operation")),
    ("style", re.compile(r"\\(?:mathbf|mathrm|mathcal|mathbb|boldsymbol)(?![A-Za-z])"), ("styled-symbol", "plain-symbol")),
    ("script", re.compile(r"(?<=[A-Za-z}])[_^](?:\{[^{}]*\}|[A-Za-z0-9*'])"), ("index", "power")),
    ("bracketed", re.compile(r"\|[^|]+\||\\\|[^|]+\\\||\[[^\[\]]*\]"), ("norm", "grouping")),
    ("operator", re.compile(r"\\operatorname(?![A-Za-z])"), ("operator", "symbol")),
    ("binder", re.compile(r"\\(?:sum|prod|int|lim|forall|exists)(?![A-Za-z])"), ("binder", "operator")),
    ("differential", re.compile(r"\\(?:partial|nabla)(?![A-Za-z])|(?<![A-Za-z\\])d(?=\s*[A-Za-z](?![A-Za-z]))"), ("differential", "symbol")),
]
#: Structural candidates of a formula that are listed.
CANDIDATES = 16


def candidates(source: str) -> tuple[list[tuple[str, str, int, int]], bool]:
    """(family, reading, start, end) of notation with several readings, in order of place, at most ``CANDIDATES``; and whether there were more."""
    found = sorted((m.start(), k, m.end(), f, readings) for k, (f, pattern, readings) in enumerate(_FAMILIES) for m in pattern.finditer(source))
    rows = [(f, r, a, b) for a, _, b, f, readings in found for r in readings]
    return rows[:CANDIDATES], len(rows) > CANDIDATES
