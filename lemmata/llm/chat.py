r"""Chat formatting by schema fingerprint.

A record is a JSON object in one of several layouts.  The set of its nested
field paths (list elements as ``[]``) is hashed to a fingerprint, which selects a
declarative mapping to canonical turns (role, text).  A record whose fingerprint
is unknown gets the mapping whose paths it holds, most paths first.  A text at ``system`` that the
mapping leaves out is the first turn, and of content that is a list of parts the
texts are joined by \\n (other parts stay as JSON).  A record that fits none gives one row
with the mapping and the role ``unknown`` and the record as its text.

The template marks each turn and escapes control strings inside texts (and
roles) by a backslash, so ``parse`` gives back what was formatted.

Null records give no turn; null roles and texts count as empty.  Turns are
ordered by (turn, role, text) within a conversation, so ties are stable and
repeated rows stay.  Each turn is formatted on its own; only the digests of a
conversation are taken in order, in one pass that holds one turn at a time.  An empty table gives no rows, a very
long text is one turn in memory, and columns other than those named are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from lemmata.llm import arrays
from lemmata.llm.storage import partitions

#: Declarative mappings: list (or None), then (role path or constant, text path) per turn.  A role starting with "=" is constant.
LAYOUTS: dict[str, dict] = {
    "messages": {"list": "messages", "turns": [("role", "content")]},
    "from_value": {"list": "conversations", "turns": [("from", "value")]},
    "turn": {"list": None, "turns": [("role", "text")]},
    "prompt_completion": {"list": None, "turns": [("=user", "prompt"), ("=assistant", "completion")]},
    "prompt_response": {"list": None, "turns": [("=user", "prompt"), ("=assistant", "response")]},
    "instruction_output": {"list": None, "turns": [("=user", "instruction"), ("=assistant", "output")]},
    "instruction_input_output": {"list": None, "turns": [("=user", "instruction+input"), ("=assistant", "output")]},
    "system_prompt_completion": {"list": None, "turns": [("=system", "system"), ("=user", "prompt"), ("=assistant", "completion")]},
}
#: Other names of the canonical roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def paths(value, at: str = "") -> set[str]:
    """The nested field paths of a JSON value."""
    if isinstance(value, dict):
        return set().union(*(paths(v, f"{at}.{k}" if at else k) for k, v in value.items())) if value else ({at} if at else set())
    if isinstance(value, list):
        return set().union({f"{at}[]"} if not value else set(), *(paths(v, f"{at}[]") for v in value))
    return {at}


def fingerprint(field_paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(field_paths)).encode()).hexdigest()[:16]


def layout_paths(layout: dict) -> set[str]:
    head = f"{layout['list']}[]." if layout["list"] else ""
    names = [p for role, text in layout["turns"] for p in ([] if role[0] == "=" else [role]) + text.split("+")]
    return {head + n for n in names}


KNOWN = {fingerprint(layout_paths(v)): k for k, v in LAYOUTS.items()}


def mapping_of(record) -> tuple[str, str]:
    """(fingerprint, mapping) of a record."""
    own = paths(record)
    print_ = fingerprint(own)
    if print_ in KNOWN:
        return print_, KNOWN[print_]
    held = lambda p: p in own or any(q.startswith(f"{p}[]") for q in own)  # noqa: E731  # a text, or a list of its parts
    fit = [(len(p), k) for k, v in LAYOUTS.items() if all(map(held, p := layout_paths(v)))]
    return print_, max(fit, key=lambda x: (x[0], x[1]))[1] if fit else "unknown"


def _text(v) -> str:
    if isinstance(v, list) and any(isinstance(p, dict) and isinstance(p.get("text"), str) for p in v):
        return "\n".join(p["text"] if isinstance(p, dict) and isinstance(p.get("text"), str) and p.keys() <= {"type", "text"} else _text(p) for p in v)
    return "" if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False, sort_keys=True)


def turns_of(record, mapping: str) -> list[tuple[str, str]]:
    """Canonical turns of a record under a mapping."""
    if mapping == "unknown":
        return []
    layout = LAYOUTS[mapping]
    out = [("system", _text(record["system"]))] if record.get("system") is not None and ("=system", "system") not in layout["turns"] else []
    for item in (record.get(layout["list"]) or []) if layout["list"] else [record]:
        if not isinstance(item, dict):
            continue
        for role, text in layout["turns"]:
            name = role[1:] if role[0] == "=" else _text(item.get(role))
            parts = [_text(item.get(p)) for p in text.split("+")]
            out.append((ROLES.get(name, name), "\n".join(p for p in parts if p) if len(parts) > 1 else parts[0]))
    return out


#: Opening and closing marks of the roles; other roles are named in the mark.
MARKS = {"user": ("[INST] ", " [/INST]"), "system": ("[SYS] ", " [/SYS]"), "assistant": ("[OUT] ", " </s>")}
_CONTROL = re.compile(r"\\|\[(?=/?(?:INST|SYS|OUT|ROLE))|<(?=/s>)")
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"\[(?:(INST|SYS|OUT)|ROLE ((?:[^\\\]]|\\.)*))\] ((?:[^\\\[<]|\\.|\[(?!/(?:INST|SYS|ROLE)\])|<(?!/s>))*) (?:\[/(?:INST|SYS|ROLE)\]|</s>)", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The marked turn, and where its text begins and ends in it."""
    if role in MARKS:
        a, b = MARKS[role]
    else:
        a, b = f"[ROLE {escape(role).replace(']', chr(92) + ']')}] ", " [/ROLE]"
    body = escape(text)
    return a + body + b, len(a), len(a) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text; ``ValueError`` if it isn't one."""
    names = {"INST": "user", "SYS": "system", "OUT": "assistant"}
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((names[m[1]] if m[1] else unescape(m[2]), unescape(m[3])))
        at = m.end()
    return out


def canonical_turns(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", record_col: str = "record") -> DataFrame:
    """(id, turn, part, role, text, fingerprint, mapping): a row per canonical turn of each JSON record; invalid JSON counts as unknown."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in arrays.slices(batch, record_col):
                rows: list[tuple] = []
                for i, r in enumerate(arrays.column(b, record_col).to_pylist()):
                    try:
                        record = json.loads(r) if r is not None else None
                    except ValueError:
                        record = None
                    print_, mapping = mapping_of(record) if isinstance(record, dict) else (None, "unknown")
                    turns = [("unknown", r)] if mapping == "unknown" and r is not None else turns_of(record, mapping)
                    rows += [(i, k, role, text, print_, mapping) for k, (role, text) in enumerate(turns)]
                at, part, role, text, print_, mapping = zip(*rows) if rows else ((),) * 6
                at = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [arrays.column(b, id_col).take(at), arrays.column(b, turn_col).take(at), pa.array(part, pa.int32()), *(pa.array(c, pa.string()) for c in (role, text, print_, mapping))],
                    names=[id_col, turn_col, "part", "role", "text", "fingerprint", "mapping"],
                )

    kinds = dict(df.dtypes)
    return df.select(id_col, turn_col, record_col).mapInArrow(run, f"`{id_col}` {kinds[id_col]}, `{turn_col}` {kinds[turn_col]}, part int, role string, text string, fingerprint string, mapping string")


def format_turns(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Adds ``formatted`` to canonical turns, and the half-open span of the escaped text that bears loss (assistant turns; else null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [format_turn(r or "", t or "") for r, t in zip(arrays.column(batch, "role").to_pylist(), arrays.column(batch, "text").to_pylist())]
            loss = [r == "assistant" for r in arrays.column(batch, "role").to_pylist()]
            more = [pa.array([o[0] for o in out], pa.string()), pa.array([o[1] if x else None for o, x in zip(out, loss)], pa.int32()), pa.array([o[2] if x else None for o, x in zip(out, loss)], pa.int32())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "formatted", "loss_begin", "loss_end"])

    schema = StructType([*turns.schema.fields, StructField("formatted", StringType()), StructField("loss_begin", IntegerType()), StructField("loss_end", IntegerType())])
    return turns.mapInArrow(run, schema)


def conversation_digests(formatted: DataFrame, id_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """Per conversation, read back from the formatted turns: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, open_ = None, None, False
        names = [id_col, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

        def done(rows):
            kinds = [id_kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            cols = zip(*rows) if rows else [()] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

        def row():
            return (key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

        id_kind = pa.int64()
        for batch in batches:
            rows, id_kind = [], arrays.column(batch, id_col).type
            for i, f, a, b in zip(*(arrays.column(batch, c).to_pylist() for c in (id_col, "formatted", "loss_begin", "loss_end"))):
                if not open_ or i != key:
                    if open_:
                        rows.append(row())
                    key, open_, state = i, True, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse(f):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                if a is not None:
                    loss = unescape(f[a:b])
                    state[2] += len(loss)
                    state[3].update(loss.encode("utf-8", "surrogatepass"))
                state[4] += len(f)
            yield done(rows)
        if open_:
            yield done([row()])

    kind = dict(formatted.dtypes)[id_col]
    n = partitions(formatted.sparkSession)
    rows = formatted.repartition(n, id_col).sortWithinPartitions(id_col, turn_col, "part", "role", "text").select(id_col, "formatted", "loss_begin", "loss_end")
    return rows.mapInArrow(run, f"`{id_col}` {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def chat_digests(records: DataFrame, id_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    return conversation_digests(format_turns(canonical_turns(records, id_col, turn_col), id_col), id_col, turn_col)


def turn_records(conversations: DataFrame) -> DataFrame:
    """Rows of turns as JSON records in the ``turn`` layout."""
    body = F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return conversations.select("conv_id", "turn", F.to_json(body).alias("record"))
