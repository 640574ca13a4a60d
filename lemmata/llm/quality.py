"""Quality rules by repetition coverage.

Words are maximal runs of bytes other than space and \\x09-\\x0D; lines are split
at \\n.  For several n-gram lengths, rolling hashes of word codes find the windows
that occur twice or more in a text; the characters of the words they cover,
first occurrence included, are measured against all characters in words.

Null text counts as empty: no words, ``base_failed`` true, ``kept`` false.  Ties
and repeated rows do not matter, as each row is judged alone.  An empty table gives no rows.  A very long
text is a slice of its own.  Other columns are not read, or kept as they are with ``keep_columns``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from lemmata.llm import arrays

#: n-gram length -> largest share (percent) of characters inside repeated n-grams.
LIMITS = {5: 15, 6: 14, 7: 13, 8: 12, 9: 11, 10: 10}
#: Largest share (percent) of characters in lines that repeat an earlier line.
LINE_LIMIT = 20
#: Text bytes that are measured at a time.
SLICE_BYTES = 1 << 20
#: Fewest words, and the largest share (percent) of words in repeated 3-word windows.
MIN_WORDS, REPEAT_WORDS = 50, 50

_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def measure(texts: pa.Array, limits: dict[int, int] = LIMITS) -> dict[str, np.ndarray]:
    """The measures of each text as arrays."""
    data, off = arrays.raw(texts)
    rows = len(texts)
    begin, end = arrays.words(data, off)
    at = arrays.row_of(begin, off)
    first = np.searchsorted(begin, off)  # of each row's words
    letters = (data & 0xC0) != 0x80
    points = np.concatenate([[0], np.cumsum(letters, dtype=np.int64)])
    width = points[end] - points[begin]
    chars = _sums(width, first)
    codes = arrays.hash_spans(data, begin, end)

    line_end = np.flatnonzero(data == 10)
    bounds = np.unique(np.concatenate([off, line_end + 1, line_end]))
    a, b = bounds[:-1], bounds[1:]
    is_line = data[a] != 10 if len(a) else np.zeros(0, bool)  # a line break is a piece of its own
    a, b = a[is_line], b[is_line]
    has_word = np.searchsorted(begin, b) > np.searchsorted(begin, a)
    a, b = a[has_word], b[has_word]
    line_row = arrays.row_of(a, off)
    with np.errstate(over="ignore"):
        again = arrays.earlier(arrays.mix(arrays.hash_spans(data, a, b) ^ (line_row.astype(np.uint64) << np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)))
    line_chars = points[b] - points[a]

    def covered(n: int) -> np.ndarray:
        """Which words lie in an n-word window that occurs at least twice in its text."""
        h = arrays.grams(codes, n)
        mark = np.zeros(len(codes) + 1, np.int32)
        if len(h):
            inside = np.flatnonzero(at[: len(h)] == at[n - 1 :])
            with np.errstate(over="ignore"):
                keys = arrays.mix(h[inside] + at[inside].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
            hit = inside[arrays.repeated(keys)]
            np.add.at(mark, hit, 1)
            np.add.at(mark, hit + n, -1)
        return np.cumsum(mark[:-1]) > 0

    out = {
        "n_words": np.diff(first),
        "word_chars": chars,
        "n_symbols": _sums(_SYMBOL[data], off),
        "n_dup_lines": np.bincount(line_row[again], minlength=rows),
        "n_repeat_words": _sums(covered(3), first),
        "dup_line_chars": np.bincount(line_row[again], line_chars[again], minlength=rows).astype(np.int64),
        "line_chars": np.bincount(line_row, line_chars, minlength=rows).astype(np.int64),
    }
    for n in limits:
        out[f"dup_{n}gram_chars"] = _sums(np.where(covered(n), width, 0), first)
    return out


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: dict[int, int] = LIMITS, line_limit: int = LINE_LIMIT, min_words: int = MIN_WORDS, repeat_words: int = REPEAT_WORDS, keep_columns: bool = False) -> DataFrame:
    """Measures and verdict of every row; with ``keep_columns`` the input's rows that are kept, unchanged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in arrays.slices(batch, text_col, SLICE_BYTES):
                m = measure(arrays.text_of(part, text_col), limits)
                failed = (m["n_words"] < min_words) | (100 * m["n_repeat_words"] > repeat_words * m["n_words"])
                kept = ~failed & (100 * m["dup_line_chars"] <= line_limit * m["line_chars"])
                for n, most in limits.items():
                    kept &= 100 * m[f"dup_{n}gram_chars"] <= most * m["word_chars"]
                if keep_columns:
                    yield part.filter(pa.array(kept))
                    continue
                m |= {"base_failed": failed, "kept": kept}
                yield pa.RecordBatch.from_arrays([arrays.column(part, id_col), *(pa.array(m[c]) for c in columns)], names=[id_col, *columns])
            arrays.trim()

    measures = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    columns = [*measures, "base_failed", "kept", "dup_line_chars", *(f"dup_{n}gram_chars" for n in limits)]
    if keep_columns:
        return df.mapInArrow(run, df.schema)
    kind = dict(df.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, " + ", ".join(f"{c} {'boolean' if c in ('base_failed', 'kept') else 'long'}" for c in columns)
    return df.select(id_col, text_col).mapInArrow(run, schema)
