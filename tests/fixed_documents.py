"""Operators over inlined documents with literal golden results; plain tests, as they read no table."""

from __future__ import annotations

from pyspark.sql import functions as F

from lemmata.functions import dimensions, quantities, text
from lemmata.operators import constraints, definitions, laws, navigation

# (file, text); our own documents
DOCS = [
    ("a.md", "Let $z$ denote displacement. Inspect $z$."),
    ("b.md", "Inspect $z$."),
    ("c.tex", "\\begin{comment}\nLet $z$ denote displacement.\n\\end{comment}\nInspect $z$."),
    ("d.md", "Use $q$ first. Let $q$ denote charge."),
    ("e.md", "Let $k$ denote stiffness."),
    ("f.md", "Let $m$ perhaps denote mass. Then $m$."),
    ("g.md", "# One\nLet $x$ denote mass. Use $x$.\n# Two\nLet $x$ denote time. Use $x$."),
    ("h.md", "🙂. Let $w$ be work. See $w$."),
    ("i.md", "The symbol matters. $v$ does not denote velocity. Read $v$."),
]


def _docs(spark):
    return spark.createDataFrame(DOCS, "file_id string, content string")


def definition_lookup(spark, sf_dir):
    """Where the symbol of each use is defined, or why it is not."""
    return definitions.resolved_uses(_docs(spark))


def definition_rows(spark, sf_dir):
    """Asserted definitions with their descriptions."""
    return definitions.definitions(_docs(spark)).select("file_id", "symbol", "anchor", "description", "construction", F.size("scope").alias("depth"))


def hygiene_hints(spark, sf_dir):
    """Definition hygiene: used before, or never used."""
    return definitions.hygiene(_docs(spark))


DESCRIPTIONS = [
    (1, "the kinetic energy of the body"),
    (2, "the mass in seconds"),
    (3, "a wave speed measured in m/s"),
    (4, "pressure along the velocity vector"),
    (5, "the mass and the area"),
    (6, "the colour"),
    (7, "charge in motion"),
    (8, "cross-sectional area of the duct"),
]

# Our own documents: a typed law, a mismatch, an inferable law, a sum of unlike terms, nothing declared.
FORMULA_DOCS = [
    ("law.md", "Let $F$ denote force. Let $m$ denote mass. Let $a$ denote acceleration. Then $F = m a$."),
    ("bad.md", "Let $v$ denote velocity. Let $m$ denote mass. Let $t$ denote time. Then $v = m/t$."),
    ("open.md", "Let $P$ denote power. Let $v$ denote velocity. Then $P = F \\cdot v$."),
    ("sum.md", "Let $m$ denote mass. Let $t$ denote time. Then $m + t$ and $x^2 + 1 \\le \\frac{d y}{d x}$."),
    ("none.md", "Then $f = 1/T$ and $a = ($."),
]


def quantity_descriptions(spark, sf_dir):
    """Quantity kinds and units that descriptions state."""
    return quantities.described(spark.createDataFrame(DESCRIPTIONS, "id int, description string"), "id", "description")


def unit_catalog(spark, sf_dir):
    """Units whose dimension some quantity kind has, with the number of such kinds."""
    return quantities.units(spark).join(quantities.kinds(spark), "dimension").groupBy("unit", "dimension").agg(F.count("*").alias("kinds"))


def formula_facts(spark, sf_dir):
    """Canonical keys, dimension diagnostics and recognised laws of formulas with an operator."""
    docs = spark.createDataFrame(FORMULA_DOCS, "file_id string, content string")
    return laws.formula_facts(docs).filter("what <> 'canonical' or instr(value, '(') > 0").select("file_id", "what", "value", "support")


# (request, file, where the use starts, new name)
RENAMES = [(1, "a.md", 38, "y"), (2, "a.md", 38, "z"), (3, "b.md", 9, "y"), (4, "a.md", 5, "two"), (5, "j.md", 52, "p"), (6, "j.md", 52, "r"), (7, "g.md", 32, "y"), (8, "a.md", 7, "y")]
CAPTURE_DOC = ("j.md", "Let $n$ denote count. Let $p$ denote pressure. Use $n$ and $p$.")


def symbol_references(spark, sf_dir):
    """All uses of each established definition."""
    return navigation.references(_docs(spark)).select("file_id", "definition", "symbol", "use", "is_declaration", "refusal")


def rename_plans(spark, sf_dir):
    """Edits of a rename, or why it is refused."""
    docs = _docs(spark).unionByName(spark.createDataFrame([CAPTURE_DOC], "file_id string, content string"))
    requests = spark.createDataFrame(RENAMES, "request int, file_id string, at int, new_name string")
    return navigation.renames(docs, requests).select("request", "refusal", F.array_join(F.transform("edits", lambda e: e.cast("string")), " ").alias("edits"))


# Our own documents: shapes that fit, that do not, and a redeclaration; comparisons; implied dimensions; lists and tables.
CONSTRAINT_DOCS = [
    ("fits.md", "Let $A$ denote a 2 by 3 matrix. Let $x$ denote a 3-dimensional vector. Then $y = A x$."),
    ("clash.md", "Let $A$ denote a 2 by 3 matrix. Let $x$ denote a 4-dimensional vector. Then $y = A x$."),
    ("sum.md", "Let $A$ denote a 2 by 3 matrix. Let $s$ denote a scalar. Then $A + s$, and $0 + A$."),
    ("again.md", "Let $v$ denote a 3-dimensional vector. Let $v$ denote a 4-dimensional vector."),
    ("order.md", "Take $k < n$. Later $n \\le k$ and $k = n$."),
    ("even.md", "Take $k < n$. Even with $k = n$ it holds."),
    ("parts.md", "# One\nTake $k < n$.\n# Two\nTake $k > n$."),
    ("chain.md", "Let $x$ denote length. Let $t$ denote duration. Then $v = x/t$, $a = v/t$ and $b = a + c$."),
    ("list.md", "Let $m$, $t$ and $q$ denote mass, time and charge respectively. Let $u$ and $w$ be speeds that vary. Let $g$ and $h$ denote force."),
    ("bad.md", "Let $m$ and $t$ denote mass, time and charge. Perhaps $a$ and $b$ denote mass and time respectively."),
    ("table.md", "| symbol | meaning |\n| --- | --- |\n| $N$ | sample count |\n| $r_1$ | inner radius |\n"),
]


def _constraint_docs(spark, *names):
    return spark.createDataFrame([d for d in CONSTRAINT_DOCS if d[0].split(".")[0] in names], "file_id string, content string")


def shape_conflicts(spark, sf_dir):
    """Shapes that cannot fit, in products, sums and redeclarations."""
    return constraints.shape_diagnostics(_constraint_docs(spark, "fits", "clash", "sum", "again"))


def comparison_conflicts(spark, sf_dir):
    """Asserted comparisons that exclude each other; concessive ones and those of sibling sections do not."""
    return constraints.comparison_conflicts(_constraint_docs(spark, "order", "even", "parts"))


def derived_dimensions(spark, sf_dir):
    """Dimensions that formulas imply, over rounds."""
    return constraints.derived_dimensions(_constraint_docs(spark, "chain"))


def listed_definitions(spark, sf_dir):
    """Definitions of several symbols at once, and of notation tables."""
    return definitions.definitions(_constraint_docs(spark, "list", "bad", "table")).select("file_id", "symbol", "description", "construction")


def selection_ranges(spark, sf_dir):
    """Nested ranges around cursors, innermost first."""
    cursors = spark.createDataFrame([(1, "a.md", 5), (2, "a.md", 0), (3, "h.md", 8), (4, "g.md", 2)], "cursor int, file_id string, at int")
    return navigation.selections(_docs(spark), cursors)


_DIMS = {"force": [("length", 1, 1), ("mass", 1, 1), ("time", -2, 1)], "velocity": [("length", 1, 1), ("time", -1, 1)], "root": [("length", 1, 2)], "none": []}


def dimension_algebra(spark, sf_dir):
    """Products and quotients of dimensions with rational exponents (the twin is a literal golden result)."""
    kind = "array<struct<base:string,num:bigint,den:bigint>>"
    pairs = [("force", "velocity"), ("velocity", "force"), ("root", "root"), ("velocity", "velocity"), ("force", "none"), ("root", "velocity")]
    rows = spark.createDataFrame([(a, b, _DIMS[a], _DIMS[b]) for a, b in pairs], f"a string, b string, l {kind}, r {kind}")
    return rows.select("a", "b", dimensions.dimension_text(dimensions.combined(F.col("l"), F.col("r"), 1)).alias("product"), dimensions.dimension_text(dimensions.combined(F.col("l"), F.col("r"), -1)).alias("quotient"))


_SHAPES = [("a 3 by 4 matrix", "matrix", "3", "4"), ("an n-dimensional state vector", "vector", "n", None), ("a three by n matrix", "matrix", "3", "n"), ("square matrix of size n", "matrix", "n", "n"), ("weight matrix", "matrix", "?", "?"), ("a vector", "vector", "?", None), ("a scalar gain", "scalar", None, None), ("the mass", None, None, None)]


def shape_descriptions(spark, sf_dir):
    """Shapes stated by descriptions (the twin is a literal golden result)."""
    return spark.createDataFrame([(s[0],) for s in _SHAPES], "description string").select("description", text.shape(F.col("description")).alias("s")).select("description", "s.*")


QUERIES = {f.__name__: f for f in (definition_lookup, definition_rows, hygiene_hints, quantity_descriptions, unit_catalog, formula_facts, symbol_references, rename_plans, shape_conflicts, comparison_conflicts, derived_dimensions, listed_definitions, selection_ranges)}
ORACLES = {
    "definition_lookup": """select * from (values ('a.md', 5, 'z', 'established', 5), ('a.md', 38, 'z', 'established', 5), ('b.md', 9, 'z', 'unsupported', null), ('c.tex', 68, 'z', 'unsupported', null),
        ('d.md', 5, 'q', 'unsupported', null), ('d.md', 20, 'q', 'established', 20), ('e.md', 5, 'k', 'established', 5), ('f.md', 5, 'm', 'unsupported', null), ('f.md', 35, 'm', 'unsupported', null),
        ('g.md', 11, 'x', 'established', 11), ('g.md', 32, 'x', 'established', 11), ('g.md', 47, 'x', 'established', 47), ('g.md', 68, 'x', 'established', 47),
        ('h.md', 9, 'w', 'established', 9), ('h.md', 26, 'w', 'established', 9), ('i.md', 21, 'v', 'unsupported', null), ('i.md', 56, 'v', 'unsupported', null)) v(file_id, use, symbol, status, definition)""",
    "definition_rows": """select * from (values ('a.md', 'z', 5, 'displacement', 'let/denote', 0), ('d.md', 'q', 20, 'charge', 'let/denote', 0), ('e.md', 'k', 5, 'stiffness', 'let/denote', 0), ('g.md', 'x', 11, 'mass', 'let/denote', 1), ('g.md', 'x', 47, 'time', 'let/denote', 1), ('h.md', 'w', 9, 'work', 'let/be', 0)) v(file_id, symbol, anchor, description, construction, depth)""",
    "hygiene_hints": """select * from (values ('d.md', 'used-before-explicit-definition', 'q', 5), ('e.md', 'defined-but-unused', 'k', 5)) v(file_id, code, symbol, "at")""",
    "quantity_descriptions": """select id::int as id, kind, unit, code from (values (1, 'energy', null, null), (2, 'mass', 'second', 'quantity-unit-dimension-mismatch'), (3, 'velocity', 'metre-per-second', null), (4, 'pressure', null, null),
        (5, null, null, null), (6, null, null, null), (7, 'electric-charge', null, null), (8, 'area', null, null)) v(id, kind, unit, code)""",
    "unit_catalog": """select unit, dimension, kinds::bigint as kinds from (values ('metre', 'length:1/1', 1), ('second', 'time:1/1', 1), ('kilogram', 'mass:1/1', 1), ('ampere', 'electric-current:1/1', 1), ('kelvin', 'thermodynamic-temperature:1/1', 1),
        ('metre-per-second', 'length:1/1 time:-1/1', 1), ('metre-per-second-squared', 'length:1/1 time:-2/1', 1), ('newton', 'length:1/1 mass:1/1 time:-2/1', 1), ('volt', 'electric-current:-1/1 length:2/1 mass:1/1 time:-3/1', 1),
        ('ohm', 'electric-current:-2/1 length:2/1 mass:1/1 time:-3/1', 1), ('hertz', 'time:-1/1', 1)) v(unit, dimension, kinds)""",
    "formula_facts": """select * from (values ('law.md', 'canonical', 'equals(F,product(m,a))', null), ('law.md', 'law', 'classical-mechanics:newton-second-law', 'typed'),
        ('bad.md', 'canonical', 'equals(v,quotient(m,t))', null), ('bad.md', 'diagnostic', 'quantity-assignment-dimension-mismatch', null),
        ('open.md', 'canonical', 'equals(P,dot(F,v))', null), ('open.md', 'law', 'classical-mechanics:mechanical-power', 'inferable'),
        ('sum.md', 'canonical', 'sum(m,t)', null), ('sum.md', 'diagnostic', 'quantity-addition-dimension-mismatch', null), ('sum.md', 'canonical', 'less-or-equal(sum(power(x,2),1),derivative(y,x))', null),
        ('none.md', 'canonical', 'equals(f,quotient(1,T))', null), ('none.md', 'unparsed', null, null)) v(file_id, what, value, support)""",
    "symbol_references": """select *, use = definition as is_declaration, null as refusal from (values ('a.md', 5, 'z', 5), ('a.md', 5, 'z', 38), ('d.md', 20, 'q', 20), ('e.md', 5, 'k', 5), ('g.md', 11, 'x', 11), ('g.md', 11, 'x', 32),
        ('g.md', 47, 'x', 47), ('g.md', 47, 'x', 68), ('h.md', 9, 'w', 9), ('h.md', 9, 'w', 26)) v(file_id, definition, symbol, use)""",
    "rename_plans": """select * from (values (1, null, '5 38'), (2, 'invalid-replacement', null), (3, 'unsupported', null), (4, 'invalid-replacement', null), (5, 'capture', null), (6, null, '5 52'), (7, null, '11 32'), (8, 'unsupported', null)) v(request, refusal, edits)""",
    "shape_conflicts": """select * from (values ('clash.md', 'constraint-product-shape-conflict', 76), ('sum.md', 'constraint-shape-conflict', 62), ('again.md', 'notation-shape-conflict', 44)) v(file_id, code, "at")""",
    "comparison_conflicts": """select file_id, 'constraint-comparison-conflict' as code, l as "left", r as "right", a as first, b as second from (values ('order.md', 'k', 'n', 5, 20), ('order.md', 'k', 'n', 5, 34)) v(file_id, l, r, a, b)""",
    "derived_dimensions": """select file_id, symbol, dimension, round, false as truncated from (values ('chain.md', 'x', 'length:1/1', 0), ('chain.md', 't', 'time:1/1', 0), ('chain.md', 'v', 'length:1/1 time:-1/1', 1),
        ('chain.md', 'a', 'length:1/1 time:-2/1', 2), ('chain.md', 'b', 'length:1/1 time:-2/1', 3), ('chain.md', 'c', 'length:1/1 time:-2/1', 3)) v(file_id, symbol, dimension, round)""",
    "listed_definitions": """select * from (values ('list.md', 'm', 'mass', 'shared/list'), ('list.md', 't', 'time', 'shared/list'), ('list.md', 'q', 'charge', 'shared/list'), ('list.md', 'u', 'speeds', 'shared/list'), ('list.md', 'w', 'speeds', 'shared/list'),
        ('list.md', 'g', 'force', 'shared/list'), ('list.md', 'h', 'force', 'shared/list'), ('table.md', 'N', 'sample count', 'table/row'), ('table.md', 'r_1', 'inner radius', 'table/row')) v(file_id, symbol, description, construction)""",
    "selection_ranges": """select cursor, rank, kind, s as start, e as "end" from (values (1, 1, 'symbol', 5, 6), (1, 2, 'math', 4, 7), (3, 1, 'math', 8, 11), (4, 1, 'heading', 0, 5)) v(cursor, rank, kind, s, e)""",
}
QUERIES['dimension_algebra'], ORACLES['dimension_algebra'] = dimension_algebra, """select * from (values ('force', 'velocity', 'length:2/1 mass:1/1 time:-3/1', 'mass:1/1 time:-1/1'), ('velocity', 'force', 'length:2/1 mass:1/1 time:-3/1', 'mass:-1/1 time:1/1'), ('root', 'root', 'length:1/1', ''), ('velocity', 'velocity', 'length:2/1 time:-2/1', ''), ('force', 'none', 'length:1/1 mass:1/1 time:-2/1', 'length:1/1 mass:1/1 time:-2/1'), ('root', 'velocity', 'length:3/2 time:-1/1', 'length:-1/2 time:1/1')) v(a, b, product, quotient)"""
QUERIES['shape_descriptions'], ORACLES['shape_descriptions'] = shape_descriptions, "select * from (values " + ", ".join("(" + ", ".join("null" if v is None else f"'{v}'" for v in s) + ")" for s in _SHAPES) + ") v(description, kind, \"rows\", columns)"
