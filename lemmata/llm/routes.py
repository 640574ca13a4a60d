"""Questions about very many keys, asked and answered in blocks.

A source (a batch of documents) asks about its distinct 64-bit keys, each with a
load; all loads of a key meet in one task, which answers each key, and the
answers come back to every source in the order of its keys.  Keys are cut into
buckets by their top bits, one block per (source, bucket), so a key of a third of all
documents costs one entry per source.  A source makes at most ``2 ** FAN_BITS``
blocks; where more buckets are due, the blocks of ``CREW`` sources for a bucket are
merged and split further, level by level, so the number of blocks grows with the
input; answers return the same way.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lemmata.llm.sharing import CREW, FAN_BITS, expand, get_sorted, lean, put_sorted, squeeze
from lemmata.llm.storage import stored

BLOCKS = "bucket long, source long, keys binary, load binary"
#: The owner of a key that no source counts.
NOBODY = np.int64(2**63 - 1)
ANSWERS = "source long, bucket long, answer binary"


def put(*columns: np.ndarray) -> bytes:
    """Arrays as compressed byte planes, with their types and lengths in front."""
    head = np.array([len(columns), *(v for c in columns for v in (ord(c.dtype.char), len(c)))], "<i8")
    planes = [np.ascontiguousarray(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.itemsize).T).tobytes() for c in columns]
    return squeeze(head.tobytes() + b"".join(planes))


def get(data: bytes) -> list[np.ndarray]:
    raw = expand(data)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    head = np.frombuffer(raw, "<i8", 2 * n, 8).tolist()
    at, out = 8 * (2 * n + 1), []
    for kind, size in zip(head[::2], head[1::2]):
        dtype = np.dtype(chr(kind))
        planes = np.frombuffer(raw, np.uint8, size * dtype.itemsize, at).reshape(dtype.itemsize, size)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(dtype))
        at += size * dtype.itemsize
    return out


@dataclass
class Load:
    """For each key a count, a mark, the smallest source that counts it, and numbered cells with counts (those of a key in order of their number)."""

    count: np.ndarray
    mark: np.ndarray
    owner: np.ndarray
    cells: np.ndarray  # how many of each key
    cell: np.ndarray
    times: np.ndarray

    def put(self, a: int, b: int, ends: np.ndarray) -> bytes:
        x, y = (int(ends[a - 1]) if a else 0), (int(ends[b - 1]) if b else 0)
        return put(self.count[a:b].astype("q"), self.mark[a:b].astype("B"), self.owner[a:b].astype("q"), self.cells[a:b].astype("i"), self.cell[x:y].astype("H"), self.times[x:y].astype("q"))


def merged(keys: list[np.ndarray], loads: list[Load]) -> tuple[np.ndarray, Load, np.ndarray]:
    """The distinct keys, their joint loads, and the place of each key of each part among them."""
    distinct, order, first = _sorted(np.concatenate(keys))
    group = np.empty(len(order), np.int64)
    group[order] = np.repeat(np.arange(len(first)), np.diff(first, append=len(order)))
    count, owner, mark = (np.concatenate(c)[order] for c in zip(*((v.count, v.owner, v.mark) for v in loads)))
    wide = np.int64(1 << 16)
    at = np.repeat(group, np.concatenate([v.cells for v in loads])) * wide + np.concatenate([v.cell for v in loads])
    used, place, begin = _sorted(at)
    cells = np.bincount(used // wide, minlength=len(distinct)).astype(np.int32)
    times = np.concatenate([v.times for v in loads])[place].astype(np.int64)
    if len(first):
        count, owner, mark = np.add.reduceat(count.astype(np.int64), first), np.minimum.reduceat(owner, first), mark[first].astype(np.uint8)
    return distinct, Load(count, mark, owner, cells, (used % wide).astype(np.uint16), np.add.reduceat(times, begin) if len(begin) else times), group


def _sorted(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values, the order that sorts them all, and where each begins in it; runs that are sorted already are merged."""
    order = np.argsort(values, kind="stable")
    values = values[order]
    first = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else order
    return values[first], order, first


def _blocks(keys: np.ndarray, load: Load, source: int, path: int, used: int, step: int) -> pa.Table:
    """Blocks of sorted distinct keys that agree in their first ``used`` bits (``path``), by the next ``step`` bits."""
    top = ((keys << np.uint64(used)) >> np.uint64(64 - step)).astype(np.int64)
    found, at = np.unique(top, return_index=True)
    spans = list(zip(at.tolist(), np.append(at[1:], len(keys)).tolist()))
    ends = np.cumsum(load.cells, dtype=np.int64)
    return pa.table(
        [
            pa.array((path << step) + found, pa.int64()),
            pa.array(np.full(len(found), source), pa.int64()),
            pa.array([put_sorted(keys[a:b]) for a, b in spans], pa.binary()),
            pa.array([load.put(a, b, ends) for a, b in spans], pa.binary()),
        ],
        names=["bucket", "source", "keys", "load"],
    )


def steps_of(bits: int, fan_bits: int = FAN_BITS) -> list[int]:
    """The bits that each level takes of ``bits``."""
    levels = max(1, -(-bits // fan_bits))
    return [bits // levels + (k < bits % levels) for k in range(levels)]


def first_blocks(keys: np.ndarray, load: Load, source: int, steps: list[int]) -> pa.Table:
    """The blocks of a source, whose keys are sorted and distinct."""
    return _blocks(keys, load, source, 0, 0, steps[0])


def _met(table: pa.Table) -> tuple[np.ndarray, Load, list[np.ndarray]]:
    """The distinct keys of some blocks, their joint loads, and for each block the places of its keys."""
    keys = [get_sorted(k) for k in table.column("keys").to_pylist()]
    distinct, load, group = merged(keys, [Load(*get(v)) for v in table.column("load").to_pylist()])
    return distinct, load, np.split(group, np.cumsum([len(k) for k in keys])[:-1])


def _replies(table: pa.Table, places: list[np.ndarray], answer: tuple[np.ndarray, ...]) -> pa.Table:
    return pa.table([table.column("source"), table.column("bucket"), pa.array([put(*(c[p] for c in answer)) for p in places], pa.binary())], names=["source", "bucket", "answer"])


def answered(blocks: DataFrame, steps: list[int], answer: Callable[[np.ndarray, Load], tuple[np.ndarray, ...]]) -> DataFrame:
    """(source, bucket, answer) for each block; ``answer`` gives arrays over a task's distinct keys."""

    def level(blocks: DataFrame, depth: int) -> DataFrame:
        if depth == len(steps):

            def top(table: pa.Table) -> pa.Table:
                distinct, load, places = _met(table)
                return _replies(table, places, answer(distinct, load))

            return blocks.groupBy("bucket").applyInArrow(lean(top), ANSWERS)
        blocks = stored(blocks.withColumn("crew", F.floor(F.col("source") / CREW).cast("long")), "blocks")
        done, step = sum(steps[:depth]), steps[depth]

        def merge(table: pa.Table) -> pa.Table:
            distinct, load, _ = _met(table)
            return _blocks(distinct, load, table.column("crew")[0].as_py(), table.column("bucket")[0].as_py(), done, step)

        def spread(table: pa.Table, answers: pa.Table) -> pa.Table:
            _, _, places = _met(table)
            return _replies(table, places, joined(answers, "child"))

        answers = level(blocks.groupBy("bucket", "crew").applyInArrow(lean(merge), BLOCKS), depth + 1)
        answers = answers.select(F.shiftright("bucket", step).alias("bucket"), F.col("source").alias("crew"), F.col("bucket").alias("child"), "answer")
        return blocks.groupBy("bucket", "crew").cogroup(answers.groupBy("bucket", "crew")).applyInArrow(lean(spread), ANSWERS)

    return level(blocks, 1)


def joined(answers: pa.Table, by: str = "bucket") -> tuple[np.ndarray, ...]:
    """The answers to all blocks of a source, in the order of its keys."""
    parts = [get(v) for _, v in sorted(zip(answers.column(by).to_pylist(), answers.column("answer").to_pylist()))]
    return tuple(np.concatenate(c) for c in zip(*parts))
