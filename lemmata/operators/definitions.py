"""Definitions in prose, their resolution for each symbol use, navigation and hygiene.

A definition sets one symbol in math beside a link and a description.  Clauses
that are hedged, conditional, quoted from a citation or negated define nothing.
Missing evidence leaves a use unresolved; it is never an error.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lemmata.operators import binders, decisions, graph, relational
from lemmata.sources import syntax as front

# Leads, the links that may follow the symbol after each, and whether the description ends at a comma.
SPECS = [
    (("let", "where", "take", "given", "suppose", "assume", "subject to"), ("denotes", "denote", "stands for", "stand for", "to be", "be", "is", "are", "as", "represents", "represent", "mean"), False),
    (("we write",), ("for",), False),
    (("define", "set"), ("as", "equal to"), False),
    (("denote by", "call"), ("",), False),
    (("we use",), ("to represent", "to denote", "for"), False),
    (("here", "throughout", "with", "given", "suppose", "assume", "subject to"), ("denoting", "denotes", "denote", "designates", "designate", "represents", "representing", "represent", "is", "be"), True),
    (
        ("", "the symbol", "the notation", "symbol", "notation"),
        ("means", "mean", "stands for", "stand for", "refers to", "will denote", "shall be", "designates", "designate", "denotes", "denote", "represents", "represent", "is defined as", "is the", "is", "are"),
        False,
    ),
]
#: Descriptions that stand before the symbol: constructions by name, tried in this order where no link follows.
_NOUNS = r"([a-z]+(?:[ -][a-z]+){0,5})"
_BEFORE = [
    ("passive", re.compile(rf"^(?:the |an? )?{_NOUNS} (?:is|are) (?:denoted|represented) by$", re.I)),
    ("quantified", re.compile(rf"\bfor (?:every|each|all|any) {_NOUNS}$", re.I)),
    ("parenthetical", re.compile(rf"\b(?:the|an?) {_NOUNS} \($", re.I)),
    ("role-first", re.compile(rf"^(?:the|an?) {_NOUNS}$", re.I)),
    ("apposition", re.compile(rf", (?:the|an?) {_NOUNS},?$", re.I)),
]
_HEDGED = re.compile(r"\b(?:might|may|perhaps|possibly|apparently|could|would)\b|\b(?:seems|appears) to\b|^(?:if|when|provided|assuming|even|were|had|imagine|according to)\b|\bas reported\b", re.I)
_NEGATED = re.compile(r"\b(?:not|never|cannot|no longer)\b", re.I)
LONGEST = 120
SCHEMA = "file_id string, symbol string, anchor int, available int, start int, end int, description string, construction string, scope array<int>"


_ROW = re.compile(r"^\|[ \t]*\$[^$|\n]+\$[ \t]*\|[ \t]*([^|\n]*[^|\s])[ \t]*\|", re.M)
_BETWEEN = re.compile(r"\s*(?:,|,?\s*and)\s*")
_PLAIN = re.compile(r"[A-Za-z0-9 '-]+")
_JOINED = re.compile(r",?\s+and\s*$", re.I)
_RELATIVE = re.compile(r"\s+(?:who|that|which|whose)\b.*", re.S | re.I)
# Verbs by which several symbols are defined at once after each lead.
SHARED = {"let": r"(?:denote|represent|mean|stand for)", "we write": "for", "denote by": "", "": r"(?:denote|represent|mean|stand for)"}
_ALIGNED = re.compile(r",?\s*(?:respectively|in that order)$", re.I)


def asserted(live: str, start: int, end: int) -> bool:
    """Whether the clause around a region is neither hedged, conditional nor negated."""
    head = max((live.rfind(c, 0, start) for c in ".!?;\n"), default=-1) + 1
    stop = re.search(r"[.!?;\n]", live[end:])
    before, after = live[head:start].strip(), live[end : end + stop.start() if stop else len(live)]
    return not (_HEDGED.search(before) or _HEDGED.search(after) or _NEGATED.search(before) or _NEGATED.search(after))


def doubted(clause: str) -> bool:
    """Whether a clause is hedged, conditional or negated."""
    return bool(_HEDGED.search(clause.strip()) or _NEGATED.search(clause))


def shared_descriptions(lead: str, text: str, n: int) -> list[str] | None:
    """The descriptions of n symbols between a lead and a text such as "denote mass and time respectively"; None if they cannot be dealt out."""
    verb = SHARED.get(lead)
    found = re.match(rf"\s+{verb}\s+(.+)" if verb else r"\s+(.+)", text, re.S | re.I) if verb is not None else None
    if found:
        what = found[1].strip(" ,:")
        bare = _ALIGNED.sub("", what)
        if bare != what or (lead in ("let", "we write") and re.search(r",|\band\b", bare)):
            each = [p.strip() for p in re.split(r",\s*(?:and\s+)?|\s+and\s+", bare)]
            return each if len(each) == n and all(each) else None
    if lead == "let" and (found := re.match(r"\s+(?:as|denote|represent|mean|stand for|to be|be|are)\s+(.+)", text, re.S | re.I)):
        what = _RELATIVE.sub("", found[1].strip(" ,:"))
        return [what] * n if _PLAIN.fullmatch(what) else None
    return None


def of_document(content: str, rows: list[tuple] | None = None) -> list[tuple]:
    """(symbol, anchor, available, start, end, description, construction, scope) in UTF-16 units."""
    live, units = front.masked(content), front.utf16(content)
    rows = front.parse(content) if rows is None else rows
    maths = [r for r in rows if r[0] == "math"]
    symbols = {}
    for r in rows:
        if r[0] == "symbol":
            symbols.setdefault(r[6], []).append(r)
    out: list[tuple] = []
    listed: set[int] = set()  # symbols that follow another one of a list
    carried: dict[int, str] = {}  # the lead that a coordinated next definition shares
    for row in _ROW.finditer(live):
        m = next((m for m in maths if row.start() <= m[2] < row.end()), None)
        own = symbols.get(m[6], []) if m else []
        if len(own) == 1 and own[0][4] == m[4] and len(row[1].encode()) <= LONGEST and "=" not in row[1] and "$" not in row[1]:
            out.append((own[0][4], units[own[0][2]], units[row.end()], units[row.start()], units[row.end()], row[1].strip(), "table/row", m[5]))
    for i, m in enumerate(maths):
        if i in listed:
            continue
        own = symbols.get(m[6], [])
        last = i
        while last + 1 < len(maths) and _BETWEEN.fullmatch(live[maths[last][3] : maths[last + 1][2]]):
            last += 1
        if last > i:
            listed |= set(range(i + 1, last + 1))
            group = [symbols.get(g[6], []) for g in maths[i : last + 1]]
            begin = max((live.rfind(c, 0, m[2]) for c in ".!?;\n"), default=-1) + 1
            stop = maths[last + 1][2] if last + 1 < len(maths) else len(live)
            tail = re.split(r"[.;\n]", live[maths[last][3] : min(stop, maths[last][3] + 240)])[0]
            whole = all(len(g) == 1 and g[0][4] == r[4] for g, r in zip(group, maths[i : last + 1]))
            each = shared_descriptions(live[begin : m[2]].strip().rsplit(",", 1)[-1].strip().lower(), tail, len(group)) if whole and asserted(live, m[2], maths[last][3]) else None
            done = maths[last][3] + len(tail)
            first = begin + len(live[begin:]) - len(live[begin:].lstrip())
            for g, what in zip(group, each or ()):
                if len(what.encode()) <= LONGEST and "=" not in what:
                    out.append((g[0][4], units[g[0][2]], units[done], units[first], units[done], what, "shared/list", m[5]))
            continue
        if len(own) != 1 or own[0][4] != m[4]:
            continue
        head = max((live.rfind(c, 0, m[2]) for c in ".!?;\n"), default=-1) + 1
        lead = live[head : m[2]].strip().rsplit(",", 1)[-1].strip().lower()
        stop = maths[i + 1][2] if i + 1 < len(maths) else len(live)
        after = live[m[3] : min(stop, m[3] + 240)]
        clause_end = re.search(r"[.;\n]", after)
        text = after[: clause_end.start()] if clause_end else after
        lead = carried.get(i, lead)
        joined = _JOINED.search(text)
        if joined and not clause_end and i + 1 < len(maths) and maths[i + 1][2] == m[3] + len(text):
            # "let x denote a and y denote b": the description ends at the conjunction, the next symbol has the same lead
            text = text[: joined.start()]
            follows = re.split(r"[.;\n]", live[maths[i + 1][3] : maths[i + 1][3] + 240])[0]
            if _linked(lead, follows):
                carried[i + 1] = lead
        if _HEDGED.search(live[head : m[2]].strip()) or _HEDGED.search(text) or _NEGATED.search(text) or _NEGATED.search(lead):
            continue
        if text.startswith(",") or text.lstrip().lower().startswith("and "):
            continue
        before = live[head : m[2]].strip()
        if lead == "" and before and i not in carried:
            lead = None  # only a comma stands there
        found = _linked(lead, text) or _preceding(before, live[m[3] : m[3] + 1])
        if found:
            what, construction = found
            at = own[0]
            out.append((at[4], units[at[2]], units[m[3] + len(text)], units[head + len(live[head:]) - len(live[head:].lstrip())], units[m[3] + len(text)], what, construction, m[5]))
    return out


def _linked(lead: str | None, text: str) -> tuple[str, str] | None:
    """Description and construction by the first specification of a lead whose longest link begins the text."""
    for leads, links, stop_at_comma in SPECS:
        if lead not in leads:
            continue
        for link in sorted(links, key=len, reverse=True):
            found = re.match(rf"\s+{re.escape(link)}(?:\s+(.*)|$)" if link else r"\s+(.*)", text, re.S | re.I)
            if not found:
                continue
            what = (found[1] or "").split(",")[0] if stop_at_comma else found[1] or ""
            what = what.strip(" ,:")
            if what and len(what.encode()) <= LONGEST and "=" not in what:
                return what, f"{lead or 'direct'}/{link}"
            break
    return None


def _preceding(before: str, behind: str) -> tuple[str, str] | None:
    for name, pattern in _BEFORE:
        found = pattern.search(before)
        if found and (name != "parenthetical" or behind == ")") and len(found[1].encode()) <= LONGEST:
            return found[1], name
    return None


def definitions(docs: DataFrame | front.Parsed) -> DataFrame:
    """Asserted definitions of documents (file_id, content)."""
    if isinstance(docs, front.Parsed):
        return docs.definitions

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(f, *d) for f, c in zip(batch.column("file_id").to_pylist(), batch.column("content").to_pylist()) if c for d in of_document(c)]
            kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.int32())]
            names = ["file_id", "symbol", "anchor", "available", "start", "end", "description", "construction", "scope"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 9, kinds)], names=names)

    return graph.large(graph.dealt(docs.select("file_id", "content")).mapInArrow(run, SCHEMA))


def resolved_uses(docs: DataFrame, with_scope: bool = False) -> DataFrame:
    """Per free symbol use: status and, if established, where its definition is (file_id, use, symbol, status, definition), and its scope."""
    uses = binders.free_uses(front.syntax(docs)).select("file_id", F.col("text").alias("symbol"), F.col("start").alias("use"), F.col("scope").alias("use_scope"))
    bound = definitions(docs).select("file_id", "symbol", "anchor", "available", "scope")
    seen = relational.visible_bindings(uses, bound, ["file_id", "symbol"], "use_scope", "scope")
    seen = seen.filter((F.col("available") <= F.col("use")) | (F.col("anchor") == F.col("use"))).withColumn("at", F.struct("file_id", "use"))
    status = decisions.resolve(seen, "at", "anchor", F.lit(True), F.size("scope"), F.col("available"), F.lit(True))
    named = status.select(F.col("at.file_id").alias("file_id"), F.col("at.use").alias("use"), "status", F.col("entity").alias("definition"))
    return uses.select("file_id", "use", "symbol", *([F.col("use_scope").alias("scope")] if with_scope else [])).join(named, ["file_id", "use"], "left").withColumn("status", F.coalesce("status", F.lit("unsupported")))


def hygiene(docs: DataFrame) -> DataFrame:
    """Hints (file_id, code, symbol, at) for symbols with exactly one definition: a use before it, or none at all."""
    once = definitions(docs).groupBy("file_id", "symbol").agg(F.count("*").alias("n"), F.min("anchor").alias("anchor"), F.min("scope").alias("scope"), F.min("construction").alias("_by")).filter("n = 1 and _by not like 'table/%'")
    uses = binders.free_uses(front.syntax(docs)).select("file_id", F.col("text").alias("symbol"), "start", F.col("scope").alias("use_scope"))
    near = once.join(uses, ["file_id", "symbol"], "left").filter(F.col("start").isNull() | (F.slice("use_scope", F.lit(1), F.size("scope")) == F.col("scope")))
    seen = near.groupBy("file_id", "symbol", "anchor").agg(F.min(F.when(F.col("start") < F.col("anchor"), F.col("start"))).alias("before"), F.count_if(F.col("start") != F.col("anchor")).alias("others"))
    early = seen.filter("before is not null").select("file_id", F.lit("used-before-explicit-definition").alias("code"), "symbol", F.col("before").alias("at"))
    return early.unionByName(seen.filter("others = 0").select("file_id", F.lit("defined-but-unused").alias("code"), "symbol", F.col("anchor").alias("at")))
