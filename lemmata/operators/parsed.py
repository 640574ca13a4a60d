"""One pass over documents, whose rows serve all operators of a call."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lemmata.functions import formulas, prose
from lemmata.operators import definitions, graph
from lemmata.sources import syntax as front
from lemmata.sources.packs import BALANCE

_INTS, _STRINGS = pa.list_(pa.int32()), pa.list_(pa.string())
COLUMNS = [
    ("what", "string", pa.string()), ("file_id", "string", pa.string()), ("kind", "string", pa.string()), ("ordinal", "int", pa.int32()), ("start", "int", pa.int32()), ("end", "int", pa.int32()), ("text", "string", pa.string()), ("scope", "array<int>", _INTS),
    ("region", "int", pa.int32()), ("declared", "int", pa.int32()), ("note", "string", pa.string()), ("names", "array<string>", _STRINGS), ("places", "array<int>", _INTS), ("flag", "boolean", pa.bool_()),
]


def formula_keys(tree: tuple) -> list[str]:
    """The dispatch keys of laws that a formula may be."""
    heads = {"*", *(c[0] for c in tree[1:] if isinstance(c, tuple))}
    keys = {f"{tree[0]}:{h}" for h in heads}
    if tree[0] == "equals" and ("num", "0") in tree[1:] and any(c[0] == "sum" and len(c) > 3 for c in tree[1:]):
        keys.add(BALANCE)
    return sorted(keys)


#: Descriptions of symbols that a bracket behind them applies.
_FUNCTION = re.compile(r"\b(?:function|map|mapping|operator|trajectory)\b(?! value)", re.I)


def tree_rows(rows: list[tuple], live: str, units: list[int], applied: frozenset[str] = frozenset()) -> list[tuple]:
    """(at, part, canonical, scope, tree, keys, asserted) of the formulas of a document's rows; a system has several parts."""
    out = []
    for r in rows:
        if r[0] != "math" or (tree := formulas.parse(r[4], applied=applied)) is None:
            continue
        said = definitions.asserted(live, r[2], r[3])
        for part, one in enumerate(tree[1:] if tree[0] == "system" else (tree,)):
            out.append((units[r[2]], part, formulas.canonical(one), r[5], json.dumps(one), formula_keys(one), said))
    return out


def _rows(file_id: str, content: str) -> Iterator[tuple]:
    live, units = front.masked(content), front.utf16(content)
    rows = front.parse(content)
    for k, o, a, b, t, s, r, d in front.in_units(rows, units):
        yield "syntax", file_id, k, o, a, b, t, s, r, d, None, None, None, None
    known = definitions.of_document(content, rows)
    applied = frozenset(d[0] for d in known if _FUNCTION.search(d[5]))
    for symbol, anchor, available, start, end, said, construction, scope in known:
        yield "definition", file_id, construction, anchor, start, end, symbol, scope, None, available, said, None, None, None
    for start, end, kind, value, scope, more, subjects, targets in prose.of_document(content, rows):
        yield "assumption", file_id, kind, None, start, end, value, scope, None, None, None, subjects, targets, more
    for at, part, canonical, scope, tree, keys, said in tree_rows(rows, live, units, applied):
        yield "tree", file_id, None, part, at, None, canonical, scope, None, None, tree, keys, None, said


def parsed(docs: DataFrame | front.Parsed) -> front.Parsed:
    """Documents (file_id, content) with their syntax, definitions, assumptions and formulas, parsed once and stored."""
    if isinstance(docs, front.Parsed):
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [row for f, c in zip(b.column("file_id").to_pylist(), b.column("content").to_pylist()) if c for row in _rows(f, c)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, _, k) in zip(zip(*out) if out else [()] * len(COLUMNS), COLUMNS)], names=[n for n, _, _ in COLUMNS])

    docs = docs.select("file_id", "content")
    rows = graph.large(graph.stored(graph.dealt(docs).mapInArrow(run, ", ".join(f"{n} {s}" for n, s, _ in COLUMNS))))
    of = lambda what: rows.filter(F.col("what") == what)
    return front.Parsed(
        docs,
        of("syntax").select("file_id", "kind", "ordinal", "start", "end", "text", "scope", "region", "declared"),
        of("definition").select("file_id", F.col("text").alias("symbol"), F.col("ordinal").alias("anchor"), F.col("declared").alias("available"), "start", "end", F.col("note").alias("description"), F.col("kind").alias("construction"), "scope"),
        of("assumption").select("file_id", "start", "end", "kind", F.col("text").alias("value"), "scope", F.col("flag").alias("truncated"), F.col("names").alias("subjects"), F.col("places").alias("targets")),
        of("tree").select("file_id", F.col("start").alias("at"), F.col("ordinal").alias("part"), F.col("text").alias("canonical"), "scope", F.col("note").alias("tree"), F.col("names").alias("keys"), F.col("flag").alias("asserted")),
    )
