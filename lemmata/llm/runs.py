"""Periodic runs of words, found on the harmonic grid by common extensions.

Words are maximal runs of bytes other than space and \\x09-\\x0D.  A run is a
stretch of words that its smallest period p explains (words p apart agree), that
is at least ``max(MIN_WORDS, REPEATS * p)`` long, and that no neighbouring word
extends.  As it is at least two periods long, it covers two neighbouring points
jp and (j+1)p of the grid of p, so for each period p the longest common extension
of jp and (j+1)p, forwards and backwards, gives its ends.  Extensions are answered
in constant time: the suffix array of the words (prefix doubling from pairs of
document and word, so documents share nothing), its array of common prefixes,
and range minima over that; the same over the reversed words for backwards.  A
pair of grid points with different words has an extension of nothing and is left
out before the look-up; the run is found from its other pairs.  A stretch found
under a multiple of its period has the same ends, so the smallest period is kept.

Each row is judged alone.  Null and empty texts have no words and no runs, an
empty table gives no rows, equal rows get equal results, columns other than id
and text are not read, and ids of any type that casts to string do (a null id
counts as the empty string where an id is hashed).  A text is never cut: a very
long one is a slice of its own, whose task holds about a hundred bytes a word and
each level of its range minima, but pairs are made a bounded number at a time.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lemmata.llm import arrays

#: Fewest words of a run, and fewest periods.
MIN_WORDS, REPEATS = 24, 3
#: Text bytes of a slice, and grid pairs made at a time.
SLICE_BYTES, PAIRS = 1 << 20, 1 << 20


class Extensions:
    """Longest common extensions to the right of places in a sequence of codes of several rows, none across rows."""

    def __init__(self, codes: np.ndarray, rows: np.ndarray):
        n = len(codes)
        self.n = n
        levels = self._ranks(codes, rows)
        rank = levels[-1]
        self.rank = rank
        suffixes = np.empty(n, np.int32)
        suffixes[rank] = np.arange(n, dtype=np.int32)
        a, b = suffixes[:-1].copy(), suffixes[1:].copy()
        common = np.zeros(max(n - 1, 0), np.int32)
        live = np.flatnonzero(levels[0][a] == levels[0][b])
        for k in range(len(levels) - 2, -1, -1):  # equal ranks of level k share 2^k codes
            inside = live[np.maximum(a[live], b[live]) < n]
            same = inside[levels[k][a[inside]] == levels[k][b[inside]]]
            common[same] += 1 << k
            a[same] += 1 << k
            b[same] += 1 << k
        self.minima = [common]
        width = 1
        while 2 * width <= len(common):
            last = self.minima[-1]
            self.minima.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    @staticmethod
    def _ranks(codes: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
        """The place of each suffix's group when suffixes are sorted by their first 1, 2, 4, ... codes, until all differ; only groups of several are sorted again."""
        n = len(codes)
        order = np.lexsort((codes, rows)).astype(np.int32)
        new = np.ones(n, bool)
        new[1:] = (codes[order[1:]] != codes[order[:-1]]) | (rows[order[1:]] != rows[order[:-1]])
        rank = np.empty(n, np.int32)
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        levels = [rank]
        ends = np.append(rows[1:] != rows[:-1], True) if n else np.zeros(0, bool)
        left = (np.append(np.flatnonzero(ends), n)[np.searchsorted(np.flatnonzero(ends), np.arange(n))] - np.arange(n) + 1).astype(np.int32)  # codes to the row's end
        alone = np.append(new, True)
        at = np.flatnonzero(~(alone[:-1] & alone[1:]))  # places of groups of several
        step = 1
        while len(at):
            who = order[at]
            after = np.where(left[who] > step, rank[np.minimum(who + step, n - 1)].astype(np.int64), -1)
            # a suffix that ends first comes first; one row has one of each length
            key = rank[who].astype(np.int64) * (n + 1) + after + 1
            by = np.argsort(key, kind="stable")
            who, key = who[by], key[by]
            order[at] = who
            new = np.ones(len(at), bool)
            new[1:] = key[1:] != key[:-1]
            rank = rank.copy()
            rank[who] = at[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
            levels.append(rank)
            alone = np.append(new, True)
            at = at[~(alone[:-1] & alone[1:])]
            step *= 2
        return levels if len(levels) > 1 or not n else [*levels, levels[-1]]

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The number of equal codes from places a and b (a != b) on."""
        x, y = self.rank[a], self.rank[b]
        lo, hi = np.minimum(x, y), np.maximum(x, y)  # minimum of common[lo:hi]
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        out = np.empty(len(lo), np.int32)
        for k in np.unique(level).tolist():
            at = np.flatnonzero(level == k)
            table = self.minima[k]
            out[at] = np.minimum(table[lo[at]], table[hi[at] - (1 << k)])
        return out


def _grid(sizes: np.ndarray, first: np.ndarray, repeats: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, jp, (j+1)p) of all rows, in parts of about ``PAIRS``."""
    most = sizes // repeats
    period_rows = np.repeat(np.arange(len(sizes)), most)
    ends = np.cumsum(most)
    periods = np.arange(len(period_rows)) - np.repeat(ends - most, most) + 1
    pairs = (sizes[period_rows] - 1) // periods
    total = np.cumsum(pairs)
    start = 0
    while start < len(pairs):
        before = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, before + PAIRS, "right")))
        p, k = periods[start:stop], pairs[start:stop]
        of = np.repeat(np.arange(stop - start), k)
        j = np.arange(len(of)) - np.repeat(np.cumsum(k) - k, k)
        row = period_rows[start:stop][of]
        left = first[row] + j * p[of]
        yield row, left, left + p[of]
        start = stop


def find_runs(codes: np.ndarray, first: np.ndarray, min_words: int = MIN_WORDS, repeats: int = REPEATS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, length, period) of all runs of rows of codes, which lie at ``first[i]:first[i + 1]``, by row, start and period."""
    if repeats < 2:
        raise ValueError("a run has at least two periods")
    sizes = np.diff(first)
    none = np.zeros(0, np.int64)
    if not (sizes >= min_words).any():
        return none, none, none, none
    rows = np.repeat(np.arange(len(sizes)), sizes)
    forward = backward = None
    n = len(codes)
    found = []
    for row, a, b in _grid(np.where(sizes >= min_words, sizes, 0), first[:-1], repeats):
        same = np.flatnonzero(codes[a] == codes[b])
        if not len(same):
            continue
        if forward is None:
            forward, backward = Extensions(codes, rows), Extensions(codes[::-1].copy(), rows[::-1].copy())
        row, a, b = row[same], a[same], b[same]
        start, end = a - backward(n - 1 - a, n - 1 - b) + 1, b + forward(a, b)
        enough = end - start >= np.maximum(min_words, repeats * (b - a))
        if enough.any():
            found.append(np.unique(np.stack([row, start, end, b - a])[:, enough], axis=1))
    if not found:
        return none, none, none, none
    row, start, end, period = np.concatenate(found, axis=1)
    order = np.lexsort((period, end, start))  # starts count over all rows
    row, start, end, period = row[order], start[order], end[order], period[order]
    new = np.ones(len(row), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    row, start, end, period = row[new], start[new], end[new], period[new]
    order = np.lexsort((period, start))
    row, start, end, period = row[order], start[order], end[order], period[order]
    return row, start - first[row], end - start, period


def looped(ids: list[str], first: np.ndarray) -> np.ndarray:
    """Which word stands at each place after the loops that a tenth of the rows get by a hash of their ids."""
    index = np.arange(first[-1])
    for i, name in enumerate(ids):
        h = zlib.crc32(name.encode())
        n = int(first[i + 1] - first[i])
        if h % 10 or not n:
            continue
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        index[first[i] + a : first[i + 1]] = first[i] + a + np.arange(n - a) % p
    return index


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Exact codes of all words, the first word of each row, and the words with a space behind each."""
    data, off = arrays.raw(texts)
    begin, end = arrays.words(data, off)
    size = end - begin
    out = np.full(int(size.sum()) + len(size), 32, np.uint8)
    ends = np.cumsum(size + 1)
    place = np.ones(len(out), bool)
    place[ends - 1] = False
    out[place] = data[~arrays.SPACE[data]]
    spaced = arrays.from_raw(out, np.concatenate([[0], ends]))
    codes = spaced.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int32) if len(spaced) else np.zeros(0, np.int32)
    return codes, np.searchsorted(begin, off), spaced


def _best(runs: list[tuple[int, int, int]]) -> tuple[int, int, int]:
    return max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]))


def run_rows(ids: list[str], texts: pa.Array, loops: Callable[[list[str], np.ndarray], np.ndarray] | None, min_words: int, repeats: int) -> dict[str, list]:
    """The columns of ``periodic_runs`` of some rows."""
    codes, first, spaced = _words(texts)
    index = loops(ids, first) if loops else np.arange(len(codes))
    row, start, length, period = find_runs(codes[index], first, min_words, repeats)
    mark = np.zeros(len(codes) + 1, np.int32)
    at = first[row] + start
    np.add.at(mark, at + period, 1)
    np.add.at(mark, at + length, -1)
    keep = np.flatnonzero(np.cumsum(mark[:-1]) == 0)
    body, ends = arrays.raw(spaced.take(pa.array(index[keep]))) if len(keep) else (np.zeros(0, np.uint8), np.zeros(1, np.int64))
    view = memoryview(np.ascontiguousarray(body))
    kept = np.searchsorted(keep, first)
    spans = np.searchsorted(row, np.arange(len(ids) + 1)).tolist()
    triples = list(zip(start.tolist(), length.tolist(), period.tolist()))
    out: dict[str, list] = {k: [] for k in ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")}
    for i in range(len(ids)):
        runs = triples[spans[i] : spans[i + 1]]
        s, n, p = _best(runs) if runs else (None, None, None)
        a, b = int(ends[kept[i]]), int(ends[kept[i + 1]])
        values = len(runs), s, n, p, 1000 * n // p if runs else None, hashlib.sha256("".join(f"{x},{y},{z}\n" for x, y, z in runs).encode()).hexdigest(), hashlib.sha256(view[a : max(a, b - 1)]).hexdigest()
        for k, v in zip(out, values):
            out[k].append(v)
    return out


def periodic_runs(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, repeats: int = REPEATS, loops: Callable[[list[str], np.ndarray], np.ndarray] | None = None
) -> DataFrame:
    """A row per row of df: the number of its runs, the one of largest exponent, and digests of all runs and of the text with each run collapsed to its first period.

    ``loops(ids, first)`` may say which word stands at each place instead of the text's own (it gives places among the words of the same row).
    """
    columns = {"n_runs": "long", "start": "long", "length": "long", "period": "long", "exponent_milli": "long", "runs_sha256": "string", "collapsed_sha256": "string"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in arrays.slices(batch, text_col, SLICE_BYTES):
                ids = arrays.column(part, id_col)
                names = [x or "" for x in ids.cast(pa.string()).to_pylist()]
                got = run_rows(names, arrays.text_of(part, text_col), loops, min_words, repeats)
                kinds = [pa.int64() if k == "long" else pa.string() for k in columns.values()]
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(got[c], t) for c, t in zip(columns, kinds))], names=[id_col, *columns])

    kind = dict(df.dtypes)[id_col]
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, " + ", ".join(f"{c} {t}" for c, t in columns.items()))


def collapsed_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, repeats: int = REPEATS) -> DataFrame:
    """df with each run of its texts collapsed to the run's first period; texts without runs, null ones included, stay as they are, others have single spaces between words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in arrays.slices(batch, text_col, SLICE_BYTES):
                codes, first, spaced = _words(arrays.text_of(part, text_col))
                row, start, length, period = find_runs(codes, first, min_words, repeats)
                texts = arrays.column(part, text_col).to_pylist()
                for i in np.unique(row).tolist():
                    gone = np.zeros(first[i + 1] - first[i], bool)
                    for k in np.flatnonzero(row == i).tolist():
                        gone[start[k] + period[k] : start[k] + length[k]] = True
                    texts[i] = b"".join(spaced.take(pa.array(first[i] + np.flatnonzero(~gone))).to_pylist())[:-1].decode()
                at = part.schema.get_field_index(text_col)
                yield part.set_column(at, part.schema.field(at), pa.array(texts, part.schema.field(at).type))

    return df.mapInArrow(run, df.schema)
