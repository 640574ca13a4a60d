"""Shingle sets of texts as sorted hash arrays.

Words are maximal runs of bytes other than space and \\x09-\\x0D after A-Z were
lower-cased; a text's set holds the hashes of its distinct ``width``-word
shingles, or of its whole word sequence if it has fewer words, and is empty
without words.  Hashes have 64 bits, so sets are exact up to a chance collision.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from lemmata.llm import arrays

WIDTH = 5


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """All sets in a row (each sorted, distinct) and the offsets at which rows begin and end."""
    data, off = arrays.raw(texts)
    data = arrays.LOWER[data]
    begin, end = arrays.words(data, off)
    codes = arrays.hash_spans(data, begin, end)
    first = np.searchsorted(begin, off)
    sizes = np.diff(first)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    keys, at = [], []
    full = arrays.grams(codes, width)
    if len(full):
        inside = np.flatnonzero(rows[: len(full)] == rows[width - 1 :])
        keys.append(arrays.mix(full[inside]))
        at.append(rows[inside])
    for n in range(1, width):  # texts of fewer words
        short = np.flatnonzero(sizes == n)
        if len(short):
            h = arrays.grams(codes, n)
            keys.append(arrays.mix(h[first[short]]))
            at.append(short)
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(len(sizes) + 1, np.int64)
    keys, at = np.concatenate(keys), np.concatenate(at)
    if len(at) and (np.diff(at) < 0).any():
        order = np.argsort(at, kind="stable")
        keys, at = keys[order], at[order]
    ends = np.searchsorted(at, np.arange(len(sizes) + 1)).tolist()
    for a, b in zip(ends[:-1], ends[1:]):
        keys[a:b].sort()
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (at[1:] != at[:-1])
    keys, at = keys[new], at[new]
    return keys, np.searchsorted(at, np.arange(len(sizes) + 1))
