"""Importance resampling towards a target: hashed n-gram features, Gumbel noise, exact top-k by radix selection.

A text's features are all its runs of 1 to ``ngrams`` consecutive words, each
hashed (CRC-32 of its UTF-8 bytes) into one of ``buckets``.  Counts of both
corpora per bucket, arrays of fixed size, give each bucket a gain in thousandths
of the log ratio of target to source; a document's weight is the floored mean of
its features' gains, and its score adds Gumbel noise from a hash of its id, so
the largest scores are a sample without replacement by weight.

The k-th largest key is found exactly by selection on its digits: rows are
counted by the highest digit (at most ``2 ** DIGIT`` counts reach the driver),
the digit in which the k-th lies is kept, and the next one is counted among the
rows that agree so far.  A key is (score, id, row), so ties of score go to the smaller id
and rows of equal id still have an order.  Only the rows above the k-th are
range-sorted, and their ranks are their places in their range plus the sizes of
the ranges before.

Null and empty texts have no features, weight 0, and are drawn only if
``min_words`` is 0.  A null id counts as the empty string where it is hashed, and as the
largest in ties.  Repeated rows are drawn one by one.  An empty table gives no rows, an empty target
counts nothing; columns other than id and text are not read.  A very long text
is a slice of its own in its task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lemmata.llm import arrays
from lemmata.llm.storage import fresh, stored

BUCKETS, NGRAMS = 10_000, 2
#: Bits of a digit of the selection.
DIGIT = 16

_WORD = np.full(256, 32, np.uint8)
_WORD[48:58] = np.arange(48, 58)
_WORD[97:123] = np.arange(97, 123)
_WORD[65:91] = np.arange(97, 123)
_WORD[128:] = np.arange(128, 256)


@lru_cache(1)
def _crc_bytes() -> np.ndarray:
    """The CRC-32 register after one byte, for each low byte of the register."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(0xEDB88320), table >> np.uint32(1))
    return table


def _apply(map_: np.ndarray, values: np.ndarray) -> np.ndarray:
    """A linear map of registers, given for each value of each of their four bytes."""
    return map_[0][values & 255] ^ map_[1][values >> 8 & 255] ^ map_[2][values >> 16 & 255] ^ map_[3][values >> 24]


@lru_cache(1)
def _crc_shifts() -> list[np.ndarray]:
    """How 2^k zero bytes change the register, as linear maps."""
    one = _crc_bytes()
    place = (np.arange(256, dtype=np.uint32)[None] << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
    maps = [one[place & 255] ^ (place >> np.uint32(8))]
    for _ in range(30):
        maps.append(_apply(maps[-1], maps[-1]))
    return maps


def crc_words(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The CRC-32 of each span of bytes."""
    table = _crc_bytes()
    size = end - begin
    order = np.argsort(-size, kind="stable")
    register = np.full(len(size), 0xFFFFFFFF, np.uint32)
    first, size = begin[order], size[order]
    live = len(size)
    for k in range(int(size[0]) if live else 0):
        live = int(np.searchsorted(-size, -k, "left"))
        r = register[:live]
        register[:live] = table[(r ^ data[first[:live] + k]) & 255] ^ (r >> np.uint32(8))
    out = np.empty(len(size), np.uint32)
    out[order] = ~register
    return out


def crc_joined(left: np.ndarray, right: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The CRC-32 of two strings joined by a space, from theirs and the second one's number of bytes."""
    space = _crc_bytes()[(~left ^ np.uint32(32)) & 255] ^ (~left >> np.uint32(8))
    out, maps = ~space, _crc_shifts()
    for k in range(int(size.max()).bit_length() if len(size) else 0):
        at = np.flatnonzero(size >> k & 1)
        out[at] = _apply(maps[k], out[at])
    return out ^ right


def features(texts: pa.Array, buckets: int = BUCKETS, ngrams: int = NGRAMS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bucket of each feature, the row of each feature, and the number of words of each row."""
    data, off = arrays.raw(texts)
    data = _WORD[data]
    begin, end = arrays.words(data, off)
    size = end - begin
    row = arrays.row_of(begin, off)
    # each distinct word once
    hashes = arrays.hash_spans(data, begin, end)
    _, at, of = np.unique(hashes, return_index=True, return_inverse=True)
    crc = crc_words(data, begin[at], end[at])[of] if len(at) else np.zeros(0, np.uint32)
    found, rows, last, length = [crc], [row], crc, size
    for n in range(2, ngrams + 1):
        inside = np.flatnonzero(row[n - 1 :] == row[: len(row) - n + 1])
        # an n-gram is its first word before the (n-1)-gram that starts at its second
        joined = crc_joined(crc[inside], last[1:][inside] if n == 2 else last[inside + 1], length[inside + 1])
        found.append(joined)
        rows.append(row[inside])
        full, sizes = np.zeros(len(row), np.uint32), np.zeros(len(row), np.int64)
        full[inside], sizes[inside] = joined, size[inside] + 1 + length[inside + 1]
        last, length = full, sizes
    return (np.concatenate(found) % buckets).astype(np.int64), np.concatenate(rows), np.diff(np.searchsorted(begin, off))


def bucket_counts(df: DataFrame, text_col: str = "text", buckets: int = BUCKETS, ngrams: int = NGRAMS) -> np.ndarray:
    """How many features of all texts lie in each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in arrays.slices(batch, text_col):
                total += np.bincount(features(arrays.text_of(part, text_col), buckets, ngrams)[0], minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets)), pa.array(total)], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    table = df.select(text_col).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out[table.column(0).to_numpy()] = table.column(1).to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the smoothed log ratio of target to source per bucket, floored."""
    s, t = source.astype(np.float64), target.astype(np.float64)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + len(s)) / ((s + 1) * (t.sum() + len(t))))).astype(np.int64)


def noise(ids: list[str], seed: int) -> np.ndarray:
    """Gumbel noise in thousandths, floored, from a hash of each id."""
    h = np.array([int(hashlib.sha256(f"{seed}:{x}".encode()).hexdigest()[:8], 16) for x in ids], np.float64)
    return np.floor(-1000 * np.log(-np.log((h + 0.5) / 4294967296))).astype(np.int64)


def scores(df: DataFrame, gain: np.ndarray, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", ngrams: int = NGRAMS) -> DataFrame:
    """(id, n_features, weight, score, n_words) of every row."""
    shared = df.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared.value
        for batch in batches:
            for part in arrays.slices(batch, text_col):
                bucket, row, words = features(arrays.text_of(part, text_col), len(g), ngrams)
                n = np.bincount(row, minlength=part.num_rows)
                total = np.zeros(part.num_rows, np.int64)
                np.add.at(total, row, g[bucket])
                weight = np.where(n > 0, total // np.maximum(n, 1), 0)
                ids = arrays.column(part, id_col)
                score = weight + noise([x or "" for x in ids.cast(pa.string()).to_pylist()], seed)
                yield pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(weight), pa.array(score), pa.array(words)], names=[id_col, "n_features", "weight", "score", "n_words"])

    kind = dict(df.dtypes)[id_col]
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_features long, weight long, score long, n_words long")


def kth_key(rows: DataFrame, keys: list[str], k: int) -> tuple[int, ...] | None:
    """The k-th smallest tuple of long columns (1 is the smallest), by counting digit after digit; None without that many rows."""
    if k < 1:
        return None
    found: list[int] = []
    agree = F.lit(True)
    for name in keys:
        # order as unsigned: the sign bit flipped
        value, prefix = F.col(name).bitwiseXOR(F.lit(-(2**63))), 0
        low, high = rows.filter(agree).agg(F.min(name), F.max(name)).first()
        if low is None:
            return None
        low, high = low + 2**63, high + 2**63
        shift = 64
        while shift and (low >> shift - DIGIT) == (high >> shift - DIGIT):  # all rows agree in these digits
            shift -= DIGIT
            prefix = low >> shift
        within = agree
        while shift:
            shift -= DIGIT
            digit = F.shiftrightunsigned(value, shift).bitwiseAND(F.lit(2**DIGIT - 1))
            counts = sorted(rows.filter(within).groupBy(digit.alias("digit")).count().collect())
            for d, n in counts:
                if k <= n:
                    break
                k -= n
            else:
                return None
            prefix = prefix << DIGIT | d
            within = within & (digit == d)
        found.append(prefix - 2**63)
        agree = agree & (F.col(name) == found[-1])
    return tuple(found) if k <= rows.filter(agree).count() else None


def _at_most(keys: list[str], bound: tuple[int, ...]) -> Column:
    """Whether a row's tuple of keys is at most the bound."""
    out = F.col(keys[-1]) <= bound[-1]
    for name, b in zip(reversed(keys[:-1]), reversed(bound[:-1])):
        out = (F.col(name) < b) | ((F.col(name) == b) & out)
    return out


def drawn(rows: DataFrame, score: str, id_col: str, eligible: Column, percent: int) -> DataFrame:
    """rows with a ``rank`` (1 is first) for the floor(percent / 100) of the eligible ones of highest score, ties to the smaller id; null for others.

    Ids are integers; null ids come last.
    """
    if dict(rows.dtypes)[id_col] not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{id_col} must be an integer")
    plain = rows.columns
    *keys, may, part, place, before = fresh(rows, "down", "none", "id", "row", "may", "part", "place", "before")
    made = [-F.col(score), F.col(id_col).isNull().cast("long"), F.coalesce(F.col(id_col).cast("long"), F.lit(0)), F.monotonically_increasing_id()]
    rows = stored(rows.select(*plain, *(v.alias(k) for k, v in zip(keys, made)), eligible.alias(may)), "scores")
    k = percent * rows.filter(may).count() // 100
    bound = kth_key(rows.filter(may), keys, k)
    if bound is None:
        return rows.select(*plain, F.lit(None).cast("long").alias("rank"))
    chosen = F.col(may) & _at_most(keys, bound)
    placed = stored(rows.filter(chosen).orderBy(*keys).select(*plain, F.spark_partition_id().alias(part), F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1)).alias(place)), "drawn")
    sizes = sorted(placed.groupBy(part).count().collect())  # one number for each range
    starts = np.concatenate([[0], np.cumsum([n for _, n in sizes])]).tolist()
    offsets = placed.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(sizes, starts)], f"`{part}` int, `{before}` long")
    ranked = placed.join(F.broadcast(offsets), part).select(*plain, (F.col(before) + F.col(place) + 1).alias("rank"))
    return ranked.unionByName(rows.filter(~chosen).select(*plain, F.lit(None).cast("long").alias("rank")))


def resample(
    df: DataFrame, target: DataFrame, percent: int = 25, min_words: int = 20, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", buckets: int = BUCKETS, ngrams: int = NGRAMS
) -> DataFrame:
    """(id, n_features, weight, score, n_words, rank) of every row; ranked are the rows drawn towards the target."""
    gain = gains(bucket_counts(df, text_col, buckets, ngrams), bucket_counts(target, target_col, buckets, ngrams))
    return drawn(scores(df, gain, seed, id_col, text_col, ngrams), "score", id_col, F.col("n_words") >= min_words, percent)
