"""How many documents share each of very many keys, without a row per key.

Documents are dealt to batches by a hash of their id.  A batch's distinct keys
are cut to ``32 + log2(buckets)`` bits, split by their top bits into buckets, and
shipped as one compressed block per (batch, bucket), so a key that a third of
all documents hold costs one entry per batch.  A bucket's task adds up the
counts and sends back one byte per key, in the order the batch sent them: 0 for
a key of one document, else ``1 + floor(4 log2(count))``.

A batch sends at most ``2 ** FAN_BITS`` blocks.  Where a table needs more buckets,
the blocks of ``CREW`` batches for one bucket are merged first, and the merged
keys are split further, level by level, so the number of blocks grows with
the input and not with its square; the answers go back the same way.

Two keys that agree in their kept bits are counted together.  That can only make
a key look shared or frequent, which costs work later and changes no result.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lemmata.llm import arrays
from lemmata.llm.storage import partitions, stored

#: Text bytes of a batch, and about how many text bytes a bucket's keys come from.
BATCH_BYTES, BUCKET_BYTES = 3 << 20, 6 << 20
#: Most blocks of a source at one level, as a power of two, and the number of sources merged between levels.
FAN_BITS, CREW = 12, 64


def share_class(count: np.ndarray) -> np.ndarray:
    return np.where(count > 1, 1 + np.floor(4 * np.log2(np.maximum(count, 2))), 0).astype(np.uint8)


def lean(f: Callable) -> Callable:
    """f, after whose calls a worker gives freed memory back to the system, as it lives on beside the JVM between groups."""

    def run(*args):
        out = f(*args)
        arrays.trim()
        return out

    run.__signature__ = inspect.signature(f)
    return run


def squeeze(data: bytes, level: int = 1) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=level).compress(data)


def expand(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(data)


def put_planes(*columns: np.ndarray) -> bytes:
    """Columns of 32-bit values of equal length, as compressed byte planes."""
    return squeeze(np.ascontiguousarray(np.stack(columns).astype("<i4")[..., None].view(np.uint8).swapaxes(1, 2)).tobytes(), 3)


def get_planes(data: bytes, columns: int) -> np.ndarray:
    planes = np.frombuffer(expand(data), np.uint8).reshape(columns, 4, -1)
    return np.ascontiguousarray(planes.swapaxes(1, 2)).view("<i4")[..., 0]


def put_sorted(values: np.ndarray) -> bytes:
    """Sorted 64-bit values as compressed byte planes of their differences (planes of zeros take no room)."""
    delta = np.diff(values.astype(np.uint64), prepend=np.uint64(0))
    wide = 8 if len(delta) and int(delta.max()) >> 32 else 4
    return bytes([wide]) + squeeze(np.ascontiguousarray(delta.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :wide].T).tobytes())


def get_sorted(data: bytes) -> np.ndarray:
    wide = data[0]
    planes = np.frombuffer(expand(data[1:]), np.uint8).reshape(wide, -1)
    delta = np.ascontiguousarray(planes.T).view(f"<u{wide}").reshape(-1)
    return np.cumsum(delta, dtype=np.uint64)


def batched(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, int]:
    """(doc, text, batch), the same with compressed texts to be dealt out, and the number of buckets (a power of two) that suit the size of the table."""
    n = partitions(df.sparkSession)
    total = df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    batches = max(2 * n, -(-total // BATCH_BYTES))
    buckets = 1 << max(4, (max(n, total // BUCKET_BYTES) - 1).bit_length())
    rows = df.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    rows = rows.withColumn("batch", F.pmod(F.xxhash64("doc"), F.lit(batches)).cast("int"))

    def pack(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_:
            body = [squeeze(t.encode()) if t is not None else None for t in arrays.column(b, "text").to_pylist()]
            yield pa.RecordBatch.from_arrays([arrays.column(b, "doc"), pa.array(body, pa.binary()), arrays.column(b, "batch")], names=["doc", "packed", "batch"])

    return rows, rows.mapInArrow(pack, f"doc {dict(rows.dtypes)['doc']}, packed binary, batch int"), buckets


def cut(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The kept bits of 64-bit keys."""
    return keys >> np.uint64(32 - (buckets.bit_length() - 1))


BLOCKS = "bucket int, batch int, keys binary, counts binary"
CLASSES = "batch int, bucket int, classes binary"


def _split(keys: np.ndarray, counts: np.ndarray, source: int, path: int, rest: int, step: int) -> pa.Table:
    """Blocks of sorted distinct keys of ``32 + rest`` bits by their top ``step`` bits, under the buckets that begin with ``path``."""
    low = np.uint64(32 + rest - step)
    top = (keys >> low).astype(np.int64)
    used, at = np.unique(top, return_index=True)
    ends = np.append(at[1:], len(keys)).tolist()
    keys = keys & ((np.uint64(1) << low) - np.uint64(1))
    spans = list(zip(at.tolist(), ends))
    return pa.table(
        [
            pa.array((path << step) + used, pa.int32()),
            pa.array(np.full(len(used), source), pa.int32()),
            pa.array([put_sorted(keys[a:b]) for a, b in spans], pa.binary()),
            pa.array([put_planes(counts[a:b]) for a, b in spans], pa.binary()),
        ],
        names=["bucket", "batch", "keys", "counts"],
    )


def _merged(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """The keys of each block, all distinct keys in order, the place of each key of each block among them, and their counts."""
    keys = [get_sorted(k) for k in table.column("keys").to_pylist()]
    counts = np.concatenate([get_planes(c, 1)[0] for c in table.column("counts").to_pylist()])
    distinct, group = np.unique(np.concatenate(keys), return_inverse=True)
    return keys, distinct, group, np.bincount(group, counts, len(distinct)).astype(np.int64)


def _answered(table: pa.Table, keys: list[np.ndarray], classes: np.ndarray) -> pa.Table:
    ends = np.cumsum([len(k) for k in keys])
    body = [squeeze(classes[e - len(k) : e].tobytes()) for k, e in zip(keys, ends)]
    return pa.table({"batch": table.column("batch"), "bucket": table.column("bucket"), "classes": pa.array(body, pa.binary())})


def _classes(table: pa.Table) -> pa.Table:
    keys, _, group, total = _merged(table)
    return _answered(table, keys, share_class(total)[group])


def _counted(blocks: DataFrame, rest: int, fan_bits: int) -> DataFrame:
    """(batch, bucket, classes) for each block, whose keys have ``32 + rest`` bits."""
    if rest <= 0:
        return blocks.groupBy("bucket").applyInArrow(lean(_classes), CLASSES)
    step = min(rest, fan_bits)
    blocks = stored(blocks.withColumn("crew", F.floor(F.col("batch") / CREW).cast("int")), "blocks")

    def merge(table: pa.Table) -> pa.Table:
        _, distinct, _, total = _merged(table)
        return _split(distinct, np.minimum(total, 2**31 - 1), table.column("crew")[0].as_py(), table.column("bucket")[0].as_py(), rest, step)

    def spread(table: pa.Table, answers: pa.Table) -> pa.Table:
        keys, _, group, _ = _merged(table)
        parts_ = sorted(zip(answers.column("child").to_pylist(), answers.column("classes").to_pylist()))
        return _answered(table, keys, np.concatenate([np.frombuffer(expand(c), np.uint8) for _, c in parts_])[group])

    answers = _counted(blocks.groupBy("bucket", "crew").applyInArrow(lean(merge), BLOCKS), rest - step, fan_bits)
    answers = answers.select(F.shiftright("bucket", step).alias("bucket"), F.col("batch").alias("crew"), F.col("bucket").alias("child"), "classes")
    return blocks.groupBy("bucket", "crew").cogroup(answers.groupBy("bucket", "crew")).applyInArrow(lean(spread), CLASSES)


def shared_classes(docs: DataFrame, keys_of: Callable[[pa.Table], np.ndarray], buckets: int, fan_bits: int = FAN_BITS) -> DataFrame:
    """(batch, bucket, classes) for the blocks of each batch; ``keys_of`` gives a batch's 64-bit keys, a key once per document that holds it."""
    bits = buckets.bit_length() - 1
    levels = max(1, -(-bits // fan_bits))
    step = -(-bits // levels)

    def blocks(table: pa.Table) -> pa.Table:
        keys, counts = np.unique(cut(keys_of(table), buckets), return_counts=True)
        return _split(keys, counts, table.column("batch")[0].as_py(), 0, bits, step)

    return _counted(docs.groupBy("batch").applyInArrow(lean(blocks), BLOCKS), bits - step, step)


def class_of(keys: np.ndarray, answers: pa.Table, buckets: int) -> np.ndarray:
    """The class of each of a batch's 64-bit keys, by the answers to its blocks."""
    small = cut(keys, buckets)
    _, inverse = np.unique(small, return_inverse=True)
    by_bucket = sorted(zip(answers.column("bucket").to_pylist(), answers.column("classes").to_pylist()))
    classes = np.concatenate([np.frombuffer(expand(c), np.uint8) for _, c in by_bucket]) if by_bucket else np.zeros(0, np.uint8)
    return classes[inverse]


def parts(table: pa.Table, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices (doc, text) of a batch's rows."""
    text = pa.array([expand(t).decode() if t is not None else None for t in table.column("packed").to_pylist()], pa.large_string())
    docs = table.column("doc").combine_chunks()
    docs = docs.chunk(0) if isinstance(docs, pa.ChunkedArray) else docs
    yield from arrays.slices(pa.RecordBatch.from_arrays([docs, text], names=["doc", "text"]), "text", limit)
