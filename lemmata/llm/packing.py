"""Packing along a space-filling curve.

The hashed words of a document give a vector by signed random projection to four
dimensions; its Hilbert key orders the corpus so that neighbours are alike.
Documents are range-partitioned by key, each range is one stream of tokens, and
the stream is cut into sequences of ``LENGTH``.  What is left at the end of a
range is cut into powers of two, so no sequence needs padding.

Equal documents have equal keys; the low bits of a key are a hash of the id,
which spreads a large group of copies over ranges.  Range bounds come from the
keys of about ``BOUND_ROWS`` rows (or four per range, if more) chosen by a hash of the id; they decide how
even ranges are, and nothing else.

Null text counts as empty: such a document is its end token alone.  Rows of equal
id are packed one by one.  An empty table gives no pieces.  A very long text is a slice of its own and goes on over
as many sequences as it takes; columns other than id and text are not read.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lemmata.llm import arrays
from lemmata.llm.storage import partitions

LENGTH, END_ID, BOUND_ROWS = 2048, 1, 20_000
#: Text bytes of a range, where the session's number of partitions gives larger ones.
RANGE_BYTES = 1 << 30
DIMS, DIM_BITS = 4, 10
#: Distinct words a Python worker remembers; affects speed only.
CACHE_ENTRIES = 400_000
_MARK = "<|startoftext|>"
#: Stems that are one word of the split pattern and stay as they are when normalised.
_SMALL = "^[a-z\u00df-\u00f6\u00f8-\u00ff]+$"
#: How byte-level tokenizers write a byte (given as the code point of its number): printable ones stay, others follow from 256 on.
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_LEVEL = {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - _PRINTED))}


class WordTokenizer:
    """A tokenizer file whose white space is dropped, applied word by word.

    Words between ASCII white space encode independently.  Closing ASCII
    punctuation after a letter is a token group of its own, so it is split off;
    each distinct stem is encoded once.  A stem of small Latin letters alone is one
    word to the split pattern and is not changed by normalising, so such stems go
    through the same merges without either, and their end is the
    token with the word-end suffix.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tool = Tokenizer.from_file(path)
        self.mark = self.tool.token_to_id(_MARK)
        self.narrow = np.uint16 if self.tool.get_vocab_size() <= 1 << 16 else np.uint32
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        suffix = spec["model"].get("end_of_word_suffix")
        steps = json.dumps(spec.get("pre_tokenizer"))
        self.merges = None
        if spec["model"]["type"] == "BPE" and suffix and "ByteLevel" in steps and r"[\\p{L}]+|" in steps:
            bare = {**spec, "normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "post_processor": None, "added_tokens": []}
            self.merges = Tokenizer.from_str(json.dumps(bare))
            self.ends = np.zeros(self.tool.get_vocab_size(), bool)
            for token, i in self.merges.get_vocab().items():
                self.ends[i] = token.endswith(suffix)
        self._forget()

    def _forget(self) -> None:
        """Stems seen so far: a number each, and all their ids in a row."""
        self.known: dict[str, int] = {}
        self.ids, self.sizes = [], []

    def _encode(self, stems: list[str]) -> None:
        small = pc.match_substring_regex(pa.array(stems, pa.large_string()), _SMALL).to_pylist() if self.merges else [False] * len(stems)
        words = [s for s, x in zip(stems, small) if x]
        for a in range(0, len(words), 1 << 14):
            some = words[a : a + (1 << 14)]
            lines = [" ".join(s if s.isascii() else s.encode().decode("latin-1").translate(_BYTE_LEVEL) for s in some[i : i + 256]) for i in range(0, len(some), 256)]
            ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.merges.encode_batch_fast(lines, add_special_tokens=False)])
            end = np.flatnonzero(self.ends[ids])
            if len(end) != len(some):
                raise ValueError("a stem is not one word")
            self._add(some, ids, np.diff(end, prepend=-1))
        plain = [s for s, x in zip(stems, small) if not x and "<|" not in s]
        for s in stems:
            if "<|" in s:
                ids = np.array(self.tool.encode(s, add_special_tokens=False).ids, np.uint32)
                self._add([s], ids, np.array([len(ids)]))
        groups = [plain[i : i + 256] for i in range(0, len(plain), 256)]
        for a in range(0, len(groups), 64):
            some = groups[a : a + 64]
            for g, e in zip(some, self.tool.encode_batch_fast([_MARK.join(g) for g in some], add_special_tokens=False)):
                ids = np.array(e.ids, np.uint32)
                cut = np.flatnonzero(ids == self.mark)
                if len(cut) != len(g) - 1:
                    raise ValueError("a stem holds the mark")
                self._add(g, ids[ids != self.mark], np.diff(np.concatenate([[-1], cut, [len(ids)]])) - 1)

    def _add(self, stems: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        n = len(self.known)
        self.known.update(zip(stems, range(n, n + len(stems))))
        self.ids.append(ids.astype(self.narrow))
        self.sizes.append(sizes)

    def _numbers(self, stems: list[str]) -> np.ndarray:
        missing = [s for s in stems if s not in self.known]
        if missing and len(self.known) + len(missing) > CACHE_ENTRIES:
            self._forget()
            missing = stems
        if missing:
            self._encode(missing)
            self.ids, self.sizes = [np.concatenate(self.ids)], [np.concatenate(self.sizes)]
        return np.fromiter(map(self.known.__getitem__, stems), np.int64, len(stems))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row and the offsets of rows, without end tokens."""
        lists = pc.ascii_split_whitespace(texts)
        coded = pc.ascii_lower(lists.flatten()).dictionary_encode()
        unique = coded.dictionary
        if not len(unique):
            return np.zeros(0, self.narrow), np.zeros(len(texts) + 1, np.int64)
        stem = pc.ascii_rtrim(unique, ".,;:!?")
        stem = pc.if_else(pc.match_substring_regex(stem, r"\p{L}$"), stem, unique)
        data, off = arrays.raw(unique)
        left = off[1:] - off[:-1] - pc.binary_length(stem).to_numpy()  # bytes of the closing punctuation
        tail = np.where(left == 1, data[np.maximum(off[1:] - 1, 0)] if len(data) else 0, 0).astype(np.int64)
        more: dict[bytes, int] = {}
        for i in np.flatnonzero(left > 1).tolist():
            tail[i] = 256 + more.setdefault(data[off[i + 1] - left[i] : off[i + 1]].tobytes(), len(more))
        ends = [b"" if b not in b".,;:!?" else bytes([b]) for b in range(256)] + list(more)
        ends = [self.tool.encode(t.decode(), add_special_tokens=False).ids if t else [] for t in ends]
        stems = stem.dictionary_encode()
        number = self._numbers(stems.dictionary.to_pylist())[stems.indices.to_numpy()]
        sizes = np.concatenate([self.sizes[0], [len(e) for e in ends]]).astype(np.int64)
        flat = np.concatenate([self.ids[0], np.array([x for e in ends for x in e], self.narrow)])
        table = pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]), flat)
        both = np.stack([number, len(self.sizes[0]) + tail], 1).reshape(-1)  # a distinct word is a stem and its punctuation
        word_sizes = sizes[both].reshape(-1, 2).sum(1)
        words = pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(word_sizes)]), table.take(pa.array(both)).flatten())
        ids = words.take(coded.indices).flatten().to_numpy()
        total = np.concatenate([[0], np.cumsum(word_sizes[coded.indices.to_numpy()])])
        offsets = lists.offsets.to_numpy().astype(np.int64)
        return ids, total[offsets - offsets[0]]


@lru_cache(2)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of each row of unsigned coordinates below 2^bits (transpose form, by exchange and inversion)."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[-1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros(len(t), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def curve_keys(texts: pa.Array) -> np.ndarray:
    """The Hilbert key (DIMS * DIM_BITS bits) of each text's projected word vector."""
    data, off = arrays.raw(texts)
    begin, end = arrays.words(data, off)
    first = np.searchsorted(begin, off)
    codes = arrays.hash_spans(data, begin, end)
    n = np.maximum(np.diff(first), 1)
    points = np.zeros((len(texts), DIMS), np.int64)
    for d in range(DIMS):
        sign = ((codes >> np.uint64(7 + 13 * d)) & np.uint64(1)).astype(np.int64) * 2 - 1
        total = np.concatenate([[0], np.cumsum(sign)])
        z = (total[first[1:]] - total[first[:-1]]) / np.sqrt(n) / 2
        points[:, d] = np.clip((np.arctan(z) / np.pi + 0.5) * (1 << DIM_BITS), 0, (1 << DIM_BITS) - 1)
    return hilbert(points, DIM_BITS)


def _keyed(texts: pa.Array, salt: np.ndarray) -> np.ndarray:
    """Curve key above 22 bits of a hash of the id, so that equal texts still spread."""
    return (curve_keys(texts) << 22) | (salt & ((1 << 22) - 1))


def _labels(spark, n: int) -> list[int]:
    """For each partition 0..n-1 an integer that hash partitioning sends there."""
    found: dict[int, int] = {}
    size = 16 * n
    while len(found) < n:
        found = dict(map(tuple, spark.range(size).groupBy(F.expr(f"pmod(hash(cast(id as int)), {n})").alias("p")).agg(F.min("id").cast("int").alias("v")).collect()))
        size *= 2
    return [found[p] for p in range(n)]


def pack(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """A row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and its ids)."""
    spark = df.sparkSession
    count, size = df.agg(F.count("*"), F.sum(F.octet_length(text_col))).first()
    n = max(partitions(spark), -(-(size or 0) // RANGE_BYTES))
    rows = df.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"), F.xxhash64(id_col).alias("salt"))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in arrays.slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([pa.array(_keyed(arrays.text_of(part, "text"), arrays.column(part, "salt").to_numpy()))], names=["key"])

    every = max(1, count // max(BOUND_ROWS, 4 * n))
    sample = np.sort(np.array([r[0] for r in rows.filter(F.expr(f"pmod(salt, {every}) = 0")).mapInArrow(keys, "key long").collect()], np.int64))
    bounds = np.unique(sample[np.linspace(0, len(sample), n + 1).astype(int)[1:-1]]) if len(sample) else sample
    labels = np.array(_labels(spark, n), np.int32)

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = tokenizer(tokenizer_path)
        for batch in batches:
            arrays.trim()
            for part in arrays.slices(batch, "text"):
                texts = arrays.text_of(part, "text")
                key = _keyed(texts, arrays.column(part, "salt").to_numpy())
                ids, off = tool.encode(texts)
                narrow = tool.narrow
                packed = arrays.from_raw(np.ascontiguousarray(ids).view(np.uint8), off * narrow().itemsize, pa.binary())
                range_ = np.searchsorted(bounds, key, "right")
                yield pa.RecordBatch.from_arrays([pa.array(labels[range_]), pa.array(range_), pa.array(key), arrays.column(part, "doc"), packed, pa.array(np.full(len(key), narrow().itemsize, np.int32))], names=["label", "range", "key", "doc", "ids", "width"])

    kind = dict(df.dtypes)[id_col]
    dealt = rows.mapInArrow(tokens, f"label int, range long, key long, doc {kind}, ids binary, width int").repartition(n, "label").sortWithinPartitions("range", "key", "doc", "ids")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cuts each range's stream; holds the pieces of at most one open sequence."""
        range_, number, at, open_ = None, 0, 0, []
        names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])]
        id_kind = pa.int64()

        def rest() -> list[tuple]:
            """The open pieces, dealt to sequences whose lengths are the powers of two in ``at``."""
            nonlocal number
            out, sizes = [], [1 << b for b in range(at.bit_length() - 1, -1, -1) if at >> b & 1]
            room, offset = (sizes.pop(0), 0) if sizes else (0, 0)
            for doc, start, ids, total in open_:
                while len(ids):
                    if not room:
                        number, room, offset = number + 1, sizes.pop(0), 0
                    k = min(room, len(ids))
                    out.append((doc, start, ids[:k], total, (range_ << 32) | number, offset))
                    ids, start, room, offset = ids[k:], start + k, room - k, offset + k
            return out

        def table(rows: list[tuple]) -> pa.RecordBatch:
            docs, starts, ids, totals, seqs, offs = zip(*rows) if rows else ((),) * 6
            cols = [pa.array(docs, id_kind), pa.array(starts, pa.int64()), pa.array([len(i) for i in ids], pa.int64()), pa.array([zlib.crc32(i.astype("<u4").tobytes()) for i in ids], pa.int64()), pa.array(totals, pa.int64()), pa.array(seqs, pa.int64()), pa.array(offs, pa.int64())]
            return pa.RecordBatch.from_arrays(cols + ([pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32()))] if with_ids else []), names=names)

        for batch in batches:
            out, id_kind = [], arrays.column(batch, "doc").type
            for r, doc, body, width in zip(*(arrays.column(batch, c).to_pylist() for c in ("range", "doc", "ids", "width"))):
                if r != range_:
                    if open_:
                        out += rest()
                    range_, number, at, open_ = r, 0, 0, []
                ids = np.append(np.frombuffer(body, np.uint16 if width == 2 else np.uint32), end_id).astype(np.uint32)
                start, total = 0, len(ids)
                while start < total:
                    k = min(length - at, total - start)
                    open_.append((doc, start, ids[start : start + k], total))
                    start, at = start + k, at + k
                    if at == length:
                        offset = 0
                        for d, s, i, t in open_:
                            out.append((d, s, i, t, (range_ << 32) | number, offset))
                            offset += len(i)
                        number, at, open_ = number + 1, 0, []
            yield table(out)
        if open_:
            yield table(rest())

    schema = f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids array<int>" if with_ids else "")
    return dealt.select("range", "doc", "ids", "width").mapInArrow(fill, schema)
