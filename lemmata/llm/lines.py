"""Line dedup by repeated passages of whole lines.

A text is split at \\n.  A passage is at least ``MIN_LINES`` lines with words (lines of
white space between them belong to it) of at least ``MIN_BYTES`` bytes, with a break for
each line.  Of a passage that occurs again anywhere in the corpus, the first occurrence
(smallest id, then position) stays, but for lines that another passage already
repeats from before it, and the others are removed, after their bytes were compared.  A passage
does not repeat itself where it overlaps its first occurrence, so of a line said five
times in a row two stay.

Every repeated passage is covered by its shortest parts that are passages: from each line the
shortest forwards, and the shortest backwards.  These windows depend on
their own bytes alone, so neither a passage's length nor its neighbours
decide what is found.

Only window hashes are grouped first; a filter of fixed size over those that repeat
decides which windows leave their task as text, and these are grouped by their
bytes with partial aggregation, so a window that a third of
all documents share costs one row per task.  When the windows meet their first
occurrence, those whose hash makes up more than one of ``HOT`` of all windows (fewer than that many, so
the list is bounded) are spread over ``SALTS`` keys by a hash of the id.  Null text counts as empty and has
no passage to remove; an empty table gives no rows, other columns keep their values whatever their names.  A null id counts as larger than any other; rows of equal id (or none) are told
apart by a digest of their text, and rows equal in both do not repeat each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lemmata.llm import arrays
from lemmata.llm.storage import fresh, stored

#: Fewest lines with words and fewest bytes of a removable passage.
MIN_LINES, MIN_BYTES = 2, 40
#: Bits of the fixed-size filter over repeated window hashes, as a power of two.
BLOOM_BITS = 23
#: A hash is hot if it has more than one of so many windows; keys over which a hot one is spread.
HOT, SALTS = 4096, 64


def lines_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end (with the line break) and row of each line."""
    starts = np.unique(np.concatenate([off[:-1][np.diff(off) > 0], np.flatnonzero(data == 10) + 1]))
    starts = starts[starts < len(data)]
    return starts, np.append(starts[1:], len(data)), arrays.row_of(starts, off)


def windows(data: np.ndarray, off: np.ndarray, min_lines: int = MIN_LINES, min_bytes: int = MIN_BYTES) -> tuple[np.ndarray, ...]:
    """Begin, end (without the last break), row, first and last line in that row, and hash of each shortest passage."""
    starts, ends, row = lines_of(data, off)
    ends = ends - (data[ends - 1] == 10) if len(starts) else ends[:0]
    words = np.concatenate([[0], np.cumsum(~arrays.SPACE[data])])
    line = np.flatnonzero(words[ends] > words[starts])
    a, b, r = starts[line], ends[line], row[line]
    i = np.arange(len(line))
    ahead = np.maximum(i + min_lines - 1, np.searchsorted(b, a + min_bytes - 1))
    back = np.minimum(i - min_lines + 1, np.searchsorted(a, b - min_bytes + 1, "right") - 1)
    pairs = np.concatenate([np.stack([i, ahead], 1), np.stack([back, i], 1)])
    pairs = pairs[(pairs[:, 0] >= 0) & (pairs[:, 1] < len(line))]
    pairs = pairs[r[pairs[:, 0]] == r[pairs[:, 1]]]
    i, j = np.divmod(np.unique(pairs[:, 0] * len(line) + pairs[:, 1]), max(len(line), 1))
    top = np.searchsorted(row, r[i])
    return a[i], b[j], r[i], line[i] - top, line[j] - top, arrays.hash_spans(data, a[i], b[j])


def _sha(text: bytes) -> bytes:
    return hashlib.sha256(text).digest()[:16]


def repeated_chunks(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, sha, at, to): the first and last line of the windows to remove, in the text of that id and digest (16 bytes)."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in arrays.slices(batch, text_col):
                h, n = np.unique(windows(*arrays.raw(arrays.text_of(part, text_col)))[-1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

    kind = dict(df.dtypes)[id_col]
    rows = df.select(id_col, text_col)
    again = stored(rows.mapInArrow(hashes, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1"), "windows")
    total = again.agg(F.sum("n")).first()[0] or 0
    hot = np.array([r[0] for r in again.filter(F.col("n") * HOT > total).select("h").collect()], np.int64)
    bloom = rows.sparkSession.sparkContext.broadcast(_bloom(again))
    rows = df.select(id_col, text_col, F.pmod(F.xxhash64(id_col), F.lit(SALTS)).cast("int").alias(salted := fresh(df, "salt")[0]))

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in arrays.slices(batch, text_col):
                data, off = arrays.raw(arrays.text_of(part, text_col))
                a, b, row, at, to, h = windows(data, off)
                maybe = np.ones(len(h), bool)
                for k in range(2):
                    slot = _slots(h, k)
                    maybe &= (bloom.value[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) == 1
                keep = np.flatnonzero(maybe)
                ids = arrays.column(part, id_col).take(pa.array(row[keep]))
                sums = {r: _sha(data[off[r] : off[r + 1]].tobytes()) for r in np.unique(row[keep]).tolist()}
                found = [pa.array([sums[r] for r in row[keep].tolist()], pa.binary()), pa.array(at[keep], pa.int32()), pa.array(to[keep], pa.int32()), pa.array(h[keep].view(np.int64))]
                salt = np.where(np.isin(h[keep].view(np.int64), hot), arrays.column(part, salted).to_numpy()[row[keep]], 0).astype(np.int32)
                yield pa.RecordBatch.from_arrays([ids, *found, pa.array([data[i:j].tobytes() for i, j in zip(a[keep], b[keep])], pa.binary()), pa.array(salt)], names=["doc", "sha", "at", "to", "h", "body", "salt"])

    found = rows.mapInArrow(bodies, f"doc {kind}, sha binary, at int, to int, h long, body binary, salt int")
    place = F.struct(F.col("doc").isNull().alias("no"), "doc", "sha", "at", "to")
    first = found.groupBy("h", "body").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1").select("h", "body", "first")
    here = F.col("doc").eqNullSafe(F.col("first.doc")) & (F.col("sha") == F.col("first.sha"))
    salts = F.when(F.array_contains(F.lit(hot.tolist()).cast("array<bigint>"), F.col("h")), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    gone = found.join(first.withColumn("salt", F.explode(salts)), ["h", "body", "salt"]).filter(~here | (F.col("at") > F.col("first.to")))
    return gone.select(F.col("doc").alias(id_col), "sha", "at", "to")


def _slots(h: np.ndarray, k: int) -> np.ndarray:
    return ((arrays.mix(h) >> np.uint64(64 - BLOOM_BITS) if k else h >> np.uint64(64 - BLOOM_BITS))).astype(np.int64)


def _bloom(keys: DataFrame) -> np.ndarray:
    """A filter of fixed size over the hashes; when it fills up it lets more through, and the join decides."""

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << (BLOOM_BITS - 6), np.uint64)
        for batch in batches:
            h = arrays.column(batch, "h").to_numpy().view(np.uint64)
            for k in range(2):
                slot = _slots(h, k)
                np.bitwise_or.at(table, slot >> 6, np.uint64(1) << (slot & 63).astype(np.uint64))
        used = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(table[used].view(np.int64))], names=["word", "bits"])

    found = keys.mapInArrow(slots, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    table = np.zeros(1 << (BLOOM_BITS - 6), np.uint64)
    table[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).view(np.uint64)
    return table


def drop_repeated_chunks(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", measures: bool = False) -> DataFrame:
    """The rows with repeated passages taken out of their texts (an input null stays null); with ``measures`` also n_lines, n_removed_lines and n_removed_bytes, in place of columns of these names."""
    span = F.shiftleft(F.col("at").cast("long"), 32) + F.col("to")
    doc, sha, marked, digest = fresh(df, "doc", "sha", "gone", "digest")
    gone = repeated_chunks(df, id_col, text_col).groupBy(F.col(id_col).alias(doc), F.col("sha").alias(sha)).agg(F.collect_set(span).alias(marked))
    added = ["n_lines", "n_removed_lines", "n_removed_bytes"] if measures else []
    own = [c for c in df.columns if c.lower() not in added]
    rows = df.withColumn(digest, F.unhex(F.substring(F.sha2(F.encode(F.col(text_col), "UTF-8"), 256), 1, 32)))
    joined = rows.join(gone, F.col(id_col).eqNullSafe(F.col(doc)) & (F.col(digest) == F.col(sha)), "left").select(*own, marked)
    names = [*own, *added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in arrays.slices(batch, text_col):
                texts = arrays.text_of(part, text_col)
                marks = arrays.column(part, marked)
                rows = np.flatnonzero(marks.is_valid().to_numpy(zero_copy_only=False))
                data, off = arrays.raw(texts)
                a, b, row = lines_of(data, off)
                n_lines = np.bincount(row, minlength=len(texts))
                lost_lines, lost_bytes = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
                col = arrays.column(part, text_col)
                if len(rows):
                    out = col.to_pylist()
                    for r, gone_ in zip(rows.tolist(), marks.filter(marks.is_valid()).to_pylist()):
                        k0, k1 = np.searchsorted(row, [r, r + 1])
                        at, to = np.divmod(np.array(gone_, np.int64), 1 << 32)
                        mark = np.zeros(k1 - k0 + 1, np.int64)
                        np.add.at(mark, at, 1)
                        np.add.at(mark, to + 1, -1)
                        keep = np.cumsum(mark[:-1]) == 0
                        out[r] = b"".join(data[x:y].tobytes() for x, y in zip(a[k0:k1][keep], b[k0:k1][keep])).decode()
                        lost_lines[r], lost_bytes[r] = (~keep).sum(), (b - a)[k0:k1][~keep].sum()
                    col = pa.array(out, col.type)
                cols = [col if n == text_col else arrays.column(part, n) for n in own]
                yield pa.RecordBatch.from_arrays(cols + ([pa.array(n_lines), pa.array(lost_lines), pa.array(lost_bytes)] if measures else []), names=names)

    schema = StructType([df.schema[c] for c in own] + [StructField(n, LongType()) for n in names[len(own) :]])
    return joined.mapInArrow(run, schema)
