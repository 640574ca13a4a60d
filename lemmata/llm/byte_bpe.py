"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are cut at safe boundaries: in front of a white-space run that
follows a non-space character, no match of the split pattern can go on, so the
pieces encode independently.  Each distinct piece of a slice is encoded once;
ids and raw bytes of the documents are then gathered by Arrow's ``take``.  A text without
white space is one piece.

Null and empty texts give no ids.  Repeated rows and ids are kept as they come.  An empty table gives no rows, a very
long text is a slice of its own, and columns other than id and text are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from lemmata.llm import arrays

#: Distinct pieces a Python worker remembers; affects speed only.
CACHE_ENTRIES = 400_000
#: White space beyond ASCII: no cut stands right behind it.
WIDE_SPACE = "[\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_WIDE = re.compile(b"|".join(chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


class Codec:
    """A rank file, its split pattern, and the pieces seen so far."""

    def __init__(self, rank_file: str, pattern: str):
        import tiktoken

        with open(rank_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.token_array = pa.array(self.tokens, pa.large_binary())
        self.decimals = pa.array([b" %d" % i for i in range(len(self.tokens))], pa.large_binary())
        self.cache: dict[bytes, np.ndarray] = {}

    def piece(self, piece: bytes) -> np.ndarray:
        ids = self.cache.get(piece)
        if ids is None:
            ids = np.array(self.encoding.encode_ordinary(piece.decode()), np.int32)
            if len(self.cache) >= CACHE_ENTRIES:
                self.cache.clear()
            if len(piece) <= 64:
                self.cache[piece] = ids
        return ids

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row and the offsets at which rows begin and end."""
        data, offsets = arrays.raw(texts)
        cut = np.zeros(len(data) + 1, bool)
        if len(data):
            space = arrays.SPACE[data]
            cut[1:-1] = space[1:] & ~space[:-1]
            wide = pc.match_substring_regex(texts, WIDE_SPACE).to_numpy(zero_copy_only=False)
            for row in np.flatnonzero(wide).tolist():  # a run that begins with wider white space goes on
                for m in _WIDE.finditer(data[offsets[row] : offsets[row + 1]].tobytes()):
                    cut[offsets[row] + m.end()] = False
        cut[offsets] = True
        bounds = np.flatnonzero(cut)
        if len(bounds) < 2:
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        pieces = arrays.from_raw(data, bounds).dictionary_encode()
        known = [self.piece(p) for p in pieces.dictionary.to_pylist()]
        sizes = np.array([len(k) for k in known], np.int64)
        lists = pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]), np.concatenate(known))
        codes = pieces.indices.to_numpy()
        ids = lists.take(pieces.indices).flatten().to_numpy()
        ends = np.concatenate([[0], np.cumsum(sizes[codes])])
        return ids, ends[np.searchsorted(bounds, offsets)]


@lru_cache(4)
def codec(rank_file: str, pattern: str) -> Codec:
    return Codec(rank_file, pattern)


def encode(df: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of every row; null text: no ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(rank_file, pattern)
        for batch in batches:
            for part in arrays.slices(batch, text_col):
                ids, off = tool.encode(arrays.text_of(part, text_col))
                yield pa.RecordBatch.from_arrays([arrays.column(part, id_col), pa.ListArray.from_arrays(off.astype(np.int32), ids)], names=[id_col, "ids"])

    kind = dict(df.dtypes)[id_col]
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def decode(df: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded binary) of every row: the raw bytes of the ids, valid UTF-8 or not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(rank_file, pattern)
        for batch in batches:
            out = [b"".join([tool.tokens[i] for i in ids or []]) for ids in arrays.column(batch, ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([arrays.column(batch, id_col), pa.array(out, pa.binary())], names=[id_col, "decoded"])

    kind = dict(df.dtypes)[id_col]
    return df.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, decoded binary")


def round_trip(df: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes every row in one pass: (id, n_tokens, ids_sha256, decoded_sha256)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(rank_file, pattern)
        for batch in batches:
            for part in arrays.slices(batch, text_col):
                ids, off = tool.encode(arrays.text_of(part, text_col))
                taken = pa.array(ids)
                dec, dec_off = arrays.raw(tool.decimals.take(taken))
                txt, txt_off = arrays.raw(tool.token_array.take(taken))
                a, b = dec_off[off], txt_off[off]
                sha = lambda x: hashlib.sha256(x).hexdigest()
                yield pa.RecordBatch.from_arrays(
                    [
                        arrays.column(part, id_col),
                        pa.array(np.diff(off)),
                        pa.array([sha(dec[i + 1 : j]) for i, j in zip(a[:-1], a[1:])], pa.string()),
                        pa.array([sha(txt[i:j]) for i, j in zip(b[:-1], b[1:])], pa.string()),
                    ],
                    names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    kind = dict(df.dtypes)[id_col]
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
