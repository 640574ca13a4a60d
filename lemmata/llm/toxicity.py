"""Toxic passages: maximum-scoring segments over token log-odds.

Token weights are log-odds of the labelled classes under an informative
Dirichlet prior, shrunk smoothly where they are uncertain and held in a table of fixed size (tokens are hashed into
``2 ** BITS`` buckets, and so are their beginnings; the strongest counts).  A linear-time scan finds all maximal-scoring segments of
a text; the Karlin-Altschul scale, solved from the clean class, and the constant
factor of the statistic, counted on clean rows, turn their
scores into excesses over what chance gives in a text of that length.  The logarithm of one plus their
sum is calibrated to the label's frequency on the training rows, each of which is
scored by weights learned without its own fold.  ``fold_losses`` compares settings by those scores, so by training rows alone.

At most ``FIT_ROWS`` labelled training rows fit the weights (those of lowest
``xxhash64(id)``); scores cover every row.  Null and empty texts have no segment
and get the score of no evidence.  Without both classes among the labels, each
score is the smoothed share of toxic labels.  Labels other than 0 and 1 do not count, the
largest of an id does; rows equal in text get equal scores, an empty table gives no rows, and columns other than
id and text are not read.  A very long text is one slice of its task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lemmata.llm import arrays

#: Size of the weight table, bound of the fitting sample.
BITS, FIT_ROWS = 19, 60_000
#: Scaled score from which segments of clean rows are counted for the statistic's constant.
TAIL = 2.0


@dataclass(frozen=True)
class Settings:
    """Log-odds of |z| = sure count a quarter, of larger ones more; each token costs drift; bytes of the beginnings of tokens that count as features of their own; strength of the prior."""

    sure: float = 2.0
    drift: float = 0.1
    stems: tuple[int, ...] = ()
    prior: float = 30_000.0


#: The settings that were compared by ``fold_losses`` over training rows; the default is the best of them there.
GRID = [Settings(sure, drift, stems, prior) for stems in ((), (4, 5, 6)) for sure in (2.0, 5.0) for drift in (0.02, 0.05, 0.1) for prior in (3_000.0, 30_000.0)]
CHOSEN = Settings()
#: Folds of the training rows, bins of the calibration for each unit of the logarithm, and units (far beyond any text).
FOLDS, STEPS, UNITS = 4, 20, 40

_LETTERS = np.full(256, 32, np.uint8)
_LETTERS[48:58] = np.arange(48, 58)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[65:91] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)


@dataclass
class Model:
    weights: np.ndarray
    scale: float
    slope: float
    offset: float
    constant: float = 1.0
    settings: Settings = CHOSEN


def tokens(texts: pa.Array, stems: tuple[int, ...] = CHOSEN.stems) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each token (runs of letters and digits, ASCII lower-cased) and of its beginnings, and the offsets of rows.

    The first row holds the whole tokens' buckets; the others those of their
    first bytes, so that a stem is known under endings that were never seen.
    """
    data, off = arrays.raw(texts)
    clean = _LETTERS[data]
    begin, end = arrays.words(clean, off)
    hashes = [arrays.hash_spans(clean, begin, end)]
    for n in stems:
        hashes.append(np.where(end - begin > n, arrays.mix(arrays.hash_spans(clean, begin, np.minimum(end, begin + n)) + np.uint64(n)), hashes[0]))
    return (np.stack(hashes) >> np.uint64(64 - BITS)).astype(np.int64), np.searchsorted(begin, off)


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (begin, end, score > 0) of a sequence, by a linear-time scan."""
    total = np.concatenate([[0.0], np.cumsum(scores)])
    up = np.flatnonzero(scores > 0)
    if not len(up):
        return []
    gap = np.flatnonzero(np.diff(up) > 1)
    begins, ends = up[np.concatenate([[0], gap + 1])], up[np.concatenate([gap, [len(up) - 1]])] + 1
    found: list[list] = []  # begin, end, sum before, sum through, nearest entry with a smaller sum before
    for b, e, left, right in zip(begins.tolist(), ends.tolist(), total[begins].tolist(), total[ends].tolist()):
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= left:
                j = found[j][4]
            if j < 0 or found[j][3] >= right:
                found.append([b, e, left, right, j])
                break
            b, left = found[j][0], found[j][2]
            del found[j:]
    return [(b, e, right - left) for b, e, left, right, _ in found]


def excess(texts: pa.Array, model: Model) -> tuple[np.ndarray, list[list[tuple[int, int, float]]]]:
    """Logarithm of one plus the summed excess of each text's segments over chance, and the significant segments (token positions)."""
    buckets, first = tokens(texts, model.settings.stems)
    scores = model.weights[buckets].max(axis=0)
    out, spans = np.zeros(len(texts)), []
    for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
        keep = []
        chance = np.log(max(model.constant * (b - a), 1))
        for x, y, s in segments(scores[a:b]):
            if (more := model.scale * s - chance) > 0:
                keep.append((x, y, s))
                out[i] += more
        spans.append(keep)
    return np.log1p(out), spans


def tail(texts: pa.Array, model: Model) -> tuple[int, int]:
    """The number of segments of a scaled score of at least ``TAIL``, and of tokens."""
    buckets, first = tokens(texts, model.settings.stems)
    scores = model.weights[buckets].max(axis=0)
    return sum(model.scale * s >= TAIL for a, b in zip(first[:-1].tolist(), first[1:].tolist()) for _, _, s in segments(scores[a:b])), int(first[-1])


def _weights(n0: np.ndarray, n1: np.ndarray, own: Settings) -> np.ndarray:
    prior = own.prior * (n0 + n1) / max(n0.sum() + n1.sum(), 1) + 0.01
    a1, a0 = n1 + prior, n0 + prior
    t1, t0 = a1.sum(), a0.sum()
    odds = np.log(a1 / (t1 - a1)) - np.log(a0 / (t0 - a0))
    z2 = odds * odds / (1 / a1 + 1 / a0)
    return odds * (z2 / (z2 + own.sure * own.sure)) ** 2 - own.drift


def _scale(weights: np.ndarray, n0: np.ndarray) -> float:
    """The positive root of sum p exp(scale * weight) = 1 over the clean class."""
    p = n0 + 1e-3
    p = p / p.sum()
    if not (weights > 0).any() or (p * weights).sum() >= 0:
        return 1.0
    low, high = 0.0, 1.0
    mean = lambda x: (p * np.exp(np.minimum(x * weights, 500))).sum()
    while mean(high) < 1 and high < 64:
        low, high = high, high * 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if mean(mid) < 1 else (low, mid)
    return high


def _logistic(x: np.ndarray, n0: np.ndarray, n1: np.ndarray) -> tuple[float, float]:
    """Slope >= 0 and offset of a lightly penalised logistic curve over binned counts."""
    a, b = 0.5, np.log((n1.sum() + 1) / (n0.sum() + 1))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        w = (n0 + n1) * p * (1 - p)
        g = np.array([((n1 - (n0 + n1) * p) * x).sum() - 0.1 * a, (n1 - (n0 + n1) * p).sum()])
        h = np.array([[(w * x * x).sum() + 0.1, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-6]])
        step = np.clip(np.linalg.solve(h, g), -1, 1)
        a, b = max(a + step[0], 0.0), b + step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def fit(df: DataFrame, labels: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", settings: Settings = CHOSEN) -> Model:
    """Weights and calibration from the labelled rows for which ``train`` (over the id) holds."""
    return _fitted(df, labels, train, id_col, text_col, label_col, settings)[0]


def fold_losses(df: DataFrame, labels: DataFrame, train: Column, grid: list[Settings] = GRID, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> list[tuple[float, Settings]]:
    """The mean log loss of each setting over the training rows, each scored without its own fold, the best first."""
    return sorted(((_fitted(df, labels, train, id_col, text_col, label_col, s)[1], s) for s in grid), key=lambda v: v[0])


def _fitted(df: DataFrame, labels: DataFrame, train: Column, id_col: str, text_col: str, label_col: str, settings: Settings) -> tuple[Model, float]:
    sample = labels.filter(train & F.col(label_col).isin(0, 1)).groupBy(id_col).agg(F.max(label_col).cast("long").alias("_label"))
    sample = sample.orderBy(F.xxhash64(id_col), id_col).limit(FIT_ROWS)
    rows = df.filter(train).select(id_col, text_col).join(F.broadcast(sample), id_col)
    rows = rows.select(text_col, "_label", F.pmod(F.xxhash64(F.lit("fold"), id_col), F.lit(FOLDS)).cast("int").alias("_fold"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, FOLDS << BITS), np.int32)
        for batch in batches:
            for part in arrays.slices(batch, text_col):
                buckets, first = tokens(arrays.text_of(part, text_col), settings.stems)
                label = np.repeat(arrays.column(part, "_label").to_numpy(), np.diff(first))
                buckets = buckets + (np.repeat(arrays.column(part, "_fold").to_numpy(), np.diff(first)).astype(np.int64) << BITS)
                for k in (0, 1):
                    own = buckets[:, label == k]
                    more = own[1:][own[1:] != own[0]]  # a short token is its own beginning and counts once
                    place, n = np.unique(np.concatenate([own[0], more]), return_counts=True)
                    sums[k, place] += n.astype(np.int32)
        used = np.flatnonzero(sums.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(sums[0, used]), pa.array(sums[1, used])], names=["bucket", "n0", "n1"])

    # at most FOLDS * 2^BITS rows of three 32-bit numbers, added up batch by batch
    by_fold = np.zeros((2, FOLDS << BITS), np.int32)
    table = rows.mapInArrow(count, "bucket int, n0 int, n1 int").groupBy("bucket").agg(F.sum("n0").cast("int").alias("n0"), F.sum("n1").cast("int").alias("n1")).toArrow()
    for batch in table.to_batches():
        by_fold[:, batch.column(0).to_numpy()] = [batch.column(1).to_numpy(), batch.column(2).to_numpy()]
    del table
    arrays.trim()
    by_fold = by_fold.reshape(2, FOLDS, 1 << BITS)
    n0, n1 = by_fold.sum(1, dtype=np.float64)
    if not n0.sum() or not n1.sum():
        return Model(np.full(1 << BITS, -settings.drift), 1.0, 0.0, float(np.log((n1.sum() + 1) / (n0.sum() + n1.sum() + 20))), 1.0, settings), float("inf")
    weights = _weights(n0, n1, settings)
    without = []
    for f in range(FOLDS):
        m0, m1 = n0 - by_fold[0, f], n1 - by_fold[1, f]
        w = _weights(m0, m1, settings)
        without.append(Model(w.astype(np.float32), _scale(w, m0), 1.0, 0.0, 1.0, settings))
    counting = df.sparkSession.sparkContext.broadcast(without)

    def tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, length = 0, 0
        for batch in batches:
            for part in arrays.slices(batch, text_col):
                texts, label, fold = arrays.text_of(part, text_col), arrays.column(part, "_label").to_numpy(), arrays.column(part, "_fold").to_numpy()
                for f in np.unique(fold).tolist():
                    more = tail(texts.take(pa.array(np.flatnonzero((fold == f) & (label == 0)))), counting.value[f])
                    found, length = found + more[0], length + more[1]
        yield pa.RecordBatch.from_arrays([pa.array([found]), pa.array([length])], names=["found", "length"])

    found, length = rows.mapInArrow(tails, "found long, length long").agg(F.sum("found"), F.sum("length")).first()
    constant = float(((found or 0) + 1) * np.exp(TAIL) / ((length or 0) + 1))
    without = [replace(m, constant=constant) for m in without]
    apart = df.sparkSession.sparkContext.broadcast(without)

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, STEPS * UNITS), np.int64)
        for batch in batches:
            for part in arrays.slices(batch, text_col):
                texts, label = arrays.text_of(part, text_col), arrays.column(part, "_label").to_numpy()
                fold = arrays.column(part, "_fold").to_numpy()
                for f in np.unique(fold).tolist():
                    own = np.flatnonzero(fold == f)
                    x, _ = excess(texts.take(pa.array(own)), apart.value[f])
                    np.add.at(sums, (label[own], np.ceil(x * STEPS).astype(np.int64)), 1)
        used = np.flatnonzero(sums.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(sums[0, used]), pa.array(sums[1, used])], names=["bin", "n0", "n1"])

    table = rows.mapInArrow(bins, "bin long, n0 long, n1 long").groupBy("bin").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).toPandas()
    x = np.maximum(table["bin"].to_numpy() - 0.5, 0) / STEPS  # bin 0 is no evidence at all
    slope, offset = _logistic(x, table["n0"].to_numpy(float), table["n1"].to_numpy(float))
    p = 1 / (1 + np.exp(-np.clip(slope * x + offset, -30, 30)))
    loss = -(table["n1"] * np.log(p) + table["n0"] * np.log(1 - p)).sum() / (table["n0"] + table["n1"]).sum()
    return Model(weights.astype(np.float32), _scale(weights, n0), slope, offset, constant, settings), float(loss)


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, n_segments, top_score, top_begin, top_end) of every row; positions count tokens."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for part in arrays.slices(batch, text_col):
                x, spans = excess(arrays.text_of(part, text_col), m)
                p = 1 / (1 + np.exp(-np.clip(m.slope * x + m.offset, -30, 30)))
                top = [max(s, key=lambda v: (v[2], -v[0])) if s else (None, None, None) for s in spans]
                yield pa.RecordBatch.from_arrays(
                    [arrays.column(part, id_col), pa.array(p), pa.array([len(s) for s in spans], pa.int32()), *(pa.array([t[k] for t in top], kind) for k, kind in ((2, pa.float64()), (0, pa.int64()), (1, pa.int64())))],
                    names=[id_col, "score", "n_segments", "top_score", "top_begin", "top_end"],
                )

    kind = dict(df.dtypes)[id_col]
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double, n_segments int, top_score double, top_begin long, top_end long")
