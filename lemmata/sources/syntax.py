"""Front-end: Markdown/LaTeX documents to rows of math regions, symbols, headings and prose.

One Arrow-batched pass per document gives all child rows; positions are
half-open ranges in UTF-16 code units.  LaTeX comments, ``comment`` environments
and Markdown code fences are inactive.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lemmata.functions.formulas import binders
from lemmata.operators import graph

SCHEMA = "file_id string, kind string, ordinal int, start int, end int, text string, scope array<int>, region int, declared int"
_INACTIVE = re.compile(r"(?<!\\)%[^\n]*|\\begin\{comment\}.*?\\end\{comment\}|^```.*?^```[^\n]*", re.S | re.M)
_MATH = re.compile(r"(?<!\\)\$\$(.+?)(?<!\\)\$\$|(?<!\\)\$([^$\n]+?)(?<!\\)\$|\\\[(.+?)\\\]|\\\((.+?)\\\)|\\begin\{(equation|align|gather)\*?\}(.+?)\\end\{\5\*?\}", re.S)
_HEADING = re.compile(r"^(#{1,6})[ \t]+([^\n]+)$|\\(section|subsection|subsubsection)\*?\{([^}]*)\}", re.M)
_SYMBOL = re.compile(r"\\[A-Za-z]+|[A-Za-z](?:_(?:\{[^{}]*\}|[A-Za-z0-9]))?")
# Commands that are notation rather than symbols.
NOTATION = {"frac", "sum", "int", "prod", "sqrt", "left", "right", "cdot", "times", "in", "le", "ge", "leq", "geq", "ne", "neq", "to", "mathbf", "mathrm", "mathcal", "text", "label", "quad", "dot", "ddot", "hat", "bar", "vec", "partial", "nabla", "infty", "begin", "end", "approx", "int", "lim", "forall", "exists", "land", "lor", "wedge", "vee", "Rightarrow", "implies", "iff", "Leftrightarrow", "mathbb", "lVert", "rVert"}
_LEVEL = {"section": 1, "subsection": 2, "subsubsection": 3}


def utf16(text: str) -> list[int]:
    """The UTF-16 offset of each code point, and of the end."""
    if text.isascii():
        return list(range(len(text) + 1))
    out, at = [], 0
    for c in text:
        out.append(at)
        at += 2 if ord(c) > 0xFFFF else 1
    return [*out, at]


def masked(text: str) -> str:
    """The text with inactive parts blanked at equal length."""
    return _INACTIVE.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def parse(text: str) -> list[tuple]:
    """(kind, ordinal, start, end, text, scope, region, declared) rows of a document, in code points.

    A binder's row has the scope it binds its symbol in, and where it declares it.
    """
    live = masked(text)
    rows, path, scopes = [], [], [(0, [])]
    for k, m in enumerate(_HEADING.finditer(live)):
        level = len(m[1]) if m[1] else _LEVEL[m[3]]
        path = [*path[: level - 1], *([0] * (level - 1 - len(path)))] + [k + 1]
        scopes.append((m.start(), list(path)))
        rows.append(("heading", k, m.start(), m.end(), (m[2] or m[4] or "").strip(), list(path), None, None))
    starts = [s for s, _ in scopes]

    def scope(at: int) -> list[int]:
        return scopes[bisect_right(starts, at) - 1][1]

    n = 0
    for k, m in enumerate(_MATH.finditer(live)):
        group = next(g for g in (1, 2, 3, 4, 6) if m[g] is not None)
        rows.append(("math", k, m.start(), m.end(), m[group].strip(), scope(m.start()), k, None))
        inside = m.start(group)
        for b, (_, name, declared, a, z) in enumerate(binders(m[group])):
            rows.append(("binder", b, inside + a, inside + z, name, scope(m.start()), k, inside + declared))
        for s in _SYMBOL.finditer(m[group]):
            if s[0][0] == "\\" and s[0][1:] in NOTATION:
                continue
            rows.append(("symbol", n, m.start(group) + s.start(), m.start(group) + s.end(), s[0], scope(m.start()), k, None))
            n += 1
    return rows


@dataclass
class Parsed:
    """Documents with what one pass over them gave, as stored rows; operators that take documents take this as well."""

    docs: DataFrame
    syntax: DataFrame
    definitions: DataFrame
    assumptions: DataFrame
    trees: DataFrame

    @property
    def sparkSession(self) -> SparkSession:
        return self.docs.sparkSession

    def select(self, *columns) -> DataFrame:
        return self.docs.select(*columns)


def syntax(docs: DataFrame | Parsed) -> DataFrame:
    """Child rows of documents (file_id, content); null content gives none."""
    if isinstance(docs, Parsed):
        return docs.syntax

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for file_id, content in zip(batch.column("file_id").to_pylist(), batch.column("content").to_pylist()):
                if content:
                    out += [(file_id, *r) for r in in_units(parse(content), utf16(content))]
            kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.int32()), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 9, kinds)], names=["file_id", "kind", "ordinal", "start", "end", "text", "scope", "region", "declared"])

    return graph.large(graph.dealt(docs.select("file_id", "content")).mapInArrow(run, SCHEMA))


def in_units(rows: list[tuple], units: list[int]) -> list[tuple]:
    """Rows of ``parse`` with their places in UTF-16 units."""
    return [(k, o, units[a], units[b], t, s, r, None if d is None else units[d]) for k, o, a, b, t, s, r, d in rows]
