"""Class-based language model: exchange clustering of words, class transitions, word emissions.

Words are maximal runs of bytes other than space and \\x09-\\x0D after A-Z were
lower-cased; every text ends with an end token.  Each word of the training rows
belongs to one of ``CLASSES`` classes, the end token to one of its own.  Exchange
rounds move words to the class that raises the log likelihood of class bigrams
most: a word's counts of classes to its left and right, summed over all training
rows, are held against the counts of all pairs of classes, a table of fixed
size, with the word taken out of its own class.  Words of one round move at once, which is what a cluster can do, and
so that two classes do not swap for ever, a half of the words (by a hash) stays in each of the last two rounds;
pairs of a word with itself count as if its neighbour stayed.

A token's probability is a mixture of ``P(class | class before) P(token | class)`` and
``P(token)``.  Tokens without training counts are one symbol; each class and the
whole give it the share of their tokens that were seen once (Good-Turing), so
over the training tokens and that symbol the probabilities add up to one.

Texts are coded once, as places in their batch's sorted words, and stay in
batches; in each round a batch asks for the classes of its words and tells their counts
(``routes``), so what is shuffled are a batch's distinct words, not its tokens, and a
word that is a third of all tokens is one entry per batch.  The driver sees class pairs only.
Words are told by 64-bit hashes, so counts are exact up to a chance collision.

Null and empty texts are their end token alone; without training rows each token is the unknown
symbol with probability 1.  Repeated rows count each; an empty table gives no rows; a null id
takes no part in training where ``train`` is null; columns other than id and text are not read.  A
very long text is a batch of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lemmata.llm import arrays, routes
from lemmata.llm.routes import Load
from lemmata.llm.sharing import FAN_BITS, get_sorted, lean, put_sorted
from lemmata.llm.storage import partitions, removed, stored

#: Word classes, rounds of exchange, weight of the class path in the mixture, strength of the prior of class transitions.
CLASSES, ROUNDS, PATH, PRIOR = 64, 5, 0.95, 20.0
#: Text bytes of a batch, and about how many text bytes a bucket's words come from.
BATCH_BYTES, BUCKET_BYTES = 8 << 20, 6 << 20
#: Counts of a cell below this one are worked out once for all cells of equal number and count.
ALIKE = 256
#: Text bytes that are hashed at a time.
HASHED_BYTES = 1 << 20


@dataclass
class Model:
    """Counts of class pairs (row: class before; the last two classes are the end token and words that are not known), and what follows from them."""

    pairs: np.ndarray
    once: np.ndarray
    n_words: int

    def __post_init__(self) -> None:
        pairs = self.pairs.astype(np.float64)
        into = pairs.sum(0)
        total = max(into.sum(), 1.0)
        share = into / total
        self.unknown = (self.once.sum() + 0.5) / (total + 1)
        self.fresh = np.where(into > 0, (self.once + self.unknown) / (into + 1), 0.0)
        self.fresh[-2] = 0.0  # the end token is known
        self.into = into
        step = (pairs + PRIOR * share) / (pairs.sum(1, keepdims=True) + PRIOR)
        # after an unknown word: as after the words seen once
        step[-1] = self.once @ step / self.once.sum() if self.once.sum() else share
        self.step = step
        self.step_fresh = step @ self.fresh


def coded_batches(df: DataFrame, train: Column, id_col: str, text_col: str) -> DataFrame:
    """A row per batch: its ids, their numbers of tokens and whether they train, its distinct words in order, and all tokens as places among them (the end token behind the last)."""
    kind = dict(df.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in arrays.slices(batch, "text", BATCH_BYTES):
                hashes, counts = [], []
                for some in arrays.slices(part, "text", HASHED_BYTES):
                    data, off = arrays.raw(arrays.text_of(some, "text"))
                    data = arrays.LOWER[data]
                    begin, end = arrays.words(data, off)
                    hashes.append(arrays.hash_spans(data, begin, end))
                    counts.append(np.diff(np.searchsorted(begin, off)))
                del data, begin, end
                words, at = np.unique(np.concatenate(hashes), return_inverse=True)
                sizes = np.concatenate(counts)
                tokens = np.full(len(at) + len(sizes), len(words), np.int32)
                place = np.arange(len(at)) + np.repeat(np.arange(len(sizes)), sizes)
                tokens[place] = at
                rows = routes.put(sizes.astype("i"), np.asarray(arrays.column(part, "train").to_numpy(zero_copy_only=False), bool).astype("B"))
                ids = arrays.column(part, "doc")
                listed = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
                yield pa.RecordBatch.from_arrays([pa.array([number]), listed, *(pa.array([v], pa.binary()) for v in (rows, put_sorted(words), routes.put(tokens)))], names=["batch", "ids", "rows", "words", "tokens"])
                number += 1
            arrays.trim()

    rows = df.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    return rows.mapInArrow(run, f"batch long, ids array<{kind}>, rows binary, words binary, tokens binary")


class Batch:
    """A coded batch in memory."""

    def __init__(self, table: pa.Table):
        self.number = table.column("batch")[0].as_py()
        self.ids = table.column("ids").combine_chunks()
        sizes, self.train = routes.get(table.column("rows")[0].as_py())
        self.sizes = sizes.astype(np.int64) + 1
        self.words = get_sorted(table.column("words")[0].as_py())
        (self.tokens,) = routes.get(table.column("tokens")[0].as_py())
        self.training = np.repeat(self.train.astype(bool), self.sizes)
        self.before = np.concatenate([[len(self.words)], self.tokens[:-1]]) if len(self.tokens) else self.tokens
        if len(self.sizes):
            self.before[np.cumsum(self.sizes)[:-1]] = len(self.words)


def first_class(words: np.ndarray, classes: int) -> np.ndarray:
    return (arrays.mix(words) % np.uint64(classes)).astype(np.uint8)


def _asked(batch: Batch, mark: np.ndarray, classes: int, steps: list[int]) -> pa.Table:
    """What a batch tells of its words, and its counts of class pairs."""
    k, n = classes + 2, len(batch.words)
    a, b = batch.before[batch.training], batch.tokens[batch.training]
    of = np.append(mark.astype(np.int64), classes)
    pairs = np.bincount(of[a] * k + of[b], minlength=k * k)
    wide = np.int64(2 * k)
    right, left = a < n, b < n
    asked = np.concatenate([a[right] * wide + of[b[right]], b[left] * wide + k + of[a[left]]])
    used, times = np.unique(asked.astype(np.int32) if n * wide < 1 << 31 else asked, return_counts=True)
    cells = np.bincount(used // wide, minlength=n).astype(np.int32)
    count = np.bincount(b[left], minlength=n).astype(np.int64)
    load = Load(count, mark, np.where(count > 0, batch.number, routes.NOBODY), cells, (used % wide).astype(np.uint16), times.astype(np.int64))
    out = routes.first_blocks(batch.words, load, batch.number, steps)
    own = pa.table([pa.array([-1], pa.int64()), pa.array([batch.number], pa.int64()), pa.array([None], pa.binary()), pa.array([routes.put(pairs)], pa.binary())], names=out.column_names)
    return pa.concat_tables([out, own])


def _raised(n: np.ndarray, x: np.ndarray) -> np.ndarray:
    """(n + x) log(n + x) - n log n, elementwise."""
    n = np.maximum(n, 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        return x * np.log(np.maximum(n + x, 1e-30)) + np.where(n > 0, n * np.log1p(x / n), 0)


def exchange(words: np.ndarray, load: Load, pairs: np.ndarray, classes: int, half: int | None = None, chunk: int = 1 << 13) -> np.ndarray:
    """The class of each word after one round: the one that raises the likelihood most, for all words or one half of them."""
    k = classes + 2
    pairs = pairs.astype(np.float32)
    out_of, into = pairs.sum(1)[:classes], pairs.sum(0)[:classes]
    table = np.concatenate([pairs[:classes].T, pairs[:, :classes]])  # a row per cell: counts of that class with each class
    # cells that agree in number and count are worked out once, but for the class that their word is in
    kind = np.where(load.times < ALIKE, load.cell.astype(np.int64) * ALIKE + load.times, -1)
    used = np.unique(kind)
    alike = _raised(table[used // ALIKE], (used % ALIKE).astype(np.float32)[:, None])
    kind = np.where(kind < 0, -1, np.searchsorted(used, kind))
    best = load.mark.copy()
    ends = np.cumsum(load.cells, dtype=np.int64)
    movers = load.count > 0
    if half is not None:
        movers &= arrays.mix(words ^ np.uint64(0x5BD1E995)) & np.uint64(1) == half
    start = 0
    while start < len(words):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + chunk, "right")))
        at = start + np.flatnonzero(movers[start:stop])
        start = stop
        if not len(at):
            continue
        size = load.cells[at].astype(np.int64)
        of = np.repeat(np.arange(len(at)), size)
        cell = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(ends[at] - size, size)
        x = load.times[cell].astype(np.float32)
        mine, rows = load.mark[at].astype(np.int64), np.arange(len(at))
        # counts of the word with each class after and before it; all is held against the pairs without the word
        near, after = load.cell[cell].astype(np.int64) % k, load.cell[cell] < k
        own = np.flatnonzero(near < classes)
        sides = np.zeros((2, len(at), classes), np.float32)
        sides[(~after[own]).astype(np.int64), of[own], near[own]] = x[own]
        home = near == mine[of]
        n = table[load.cell[cell], mine[of]] - x
        more = alike[kind[cell]]
        full = np.flatnonzero(home | (kind[cell] < 0))
        more[np.arange(len(of)), mine[of]] = _raised(n, x)
        n = table[load.cell[cell[full]]]
        n[np.arange(len(full)), mine[of[full]]] -= x[full]
        back = np.flatnonzero(home[full])
        n[back] -= sides[after[full[back]].astype(np.int64), of[full[back]]]
        more[full] = _raised(n, x[full, None])
        # pairs within a class get both sides of the word in one cell
        more[own, near[own]] = 0
        both = sides.sum(0)
        inside = np.repeat(np.diagonal(pairs)[None, :classes], len(at), 0)
        inside[rows, mine] -= both[rows, mine]
        gain = np.add.reduceat(more, np.cumsum(size) - size, axis=0) + _raised(inside, both)
        whole = load.count[at].astype(np.float32)[:, None]
        for margin in (out_of, into):
            m = np.repeat(margin[None], len(at), 0)
            m[rows, mine] -= whole[:, 0]
            gain -= _raised(m, whole)
        to = gain.argmax(1)
        better = gain[rows, to] > gain[rows, mine] + 1e-3
        best[at[better]] = to[better]
    return best


def _summed(tables: DataFrame, column: str, size: int) -> np.ndarray:
    """The sum of the packed arrays of ``size`` numbers, added up task by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for v in arrays.column(batch, column).to_pylist():
                total += routes.get(v)[0]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], names=["cell", "n"])

    out = np.zeros(size, np.int64)
    table = tables.select(column).mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out[table.column(0).to_numpy()] = table.column(1).to_numpy()
    return out


def with_answers(coded: DataFrame, answers: DataFrame, f, schema: str) -> DataFrame:
    """f(batch, answers to its words) for each batch."""

    def run(table: pa.Table, told: pa.Table) -> pa.Table:
        batch = Batch(table)
        return f(batch, routes.joined(told) if told.num_rows else tuple(np.zeros(0, np.int64) for _ in range(3)))

    return coded.groupBy("batch").cogroup(answers.withColumnRenamed("source", "batch").groupBy("batch")).applyInArrow(lean(run), schema)


def fit(coded: DataFrame, buckets: int, classes: int = CLASSES, rounds: int = ROUNDS, fan_bits: int = FAN_BITS) -> tuple[DataFrame, Model]:
    """The class and training count of each batch's words, as answers to its blocks, and the model."""
    if not 1 <= classes <= 250 or rounds < 1:
        raise ValueError("classes must lie in 1..250, rounds be at least 1")
    k = classes + 2
    steps = routes.steps_of(buckets.bit_length() - 1, fan_bits)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for i in range(rows.num_rows):
                batch = Batch(pa.Table.from_batches([rows.slice(i, 1)]))
                yield from _asked(batch, first_class(batch.words, classes), classes, steps).combine_chunks().to_batches()
            arrays.trim()

    def again(batch: Batch, told: tuple[np.ndarray, ...]) -> pa.Table:
        return _asked(batch, told[0], classes, steps)

    answers = None
    for turn in range(rounds):
        asked = stored(coded.mapInArrow(first, routes.BLOCKS) if answers is None else with_answers(coded, answers, again, routes.BLOCKS), "asked")
        pairs = _summed(asked.filter("bucket < 0"), "load", k * k).reshape(k, k)

        def answer(words: np.ndarray, load: Load, pairs: np.ndarray = pairs, turn: int = turn) -> tuple[np.ndarray, ...]:
            mark = exchange(words, load, pairs, classes, turn % 2 if turn >= rounds - 2 else None)
            return (mark, load.count, load.owner) if turn == rounds - 1 else (mark,)

        before, answers = answers, stored(routes.answered(asked.filter("bucket >= 0"), steps, answer), "answers")
        removed(asked, before)

    def counted(batch: Batch, told: tuple[np.ndarray, ...]) -> pa.Table:
        mark, count, owner = told
        n = len(batch.words)
        of = np.append(np.where(count > 0, mark, classes + 1), classes)
        a, b = batch.before[batch.training], batch.tokens[batch.training]
        pairs = np.bincount(of[a] * k + of[b], minlength=k * k)
        mine = owner == batch.number
        once = np.bincount(of[:n][mine & (count == 1)], minlength=k)
        return pa.table({"sums": pa.array([routes.put(np.concatenate([pairs, once, [np.count_nonzero(mine)]]).astype("q"))], pa.binary())})

    sums = _summed(with_answers(coded, answers, counted, "sums binary"), "sums", k * k + k + 1)
    return answers, Model(sums[: k * k].reshape(k, k), sums[k * k : -1].astype(np.float64), int(sums[-1]))


def scores(coded: DataFrame, answers: DataFrame, model: Model, id_col: str, kind: str) -> DataFrame:
    """(id, train, n_tokens, n_known, train_tokens, base_score, score) of every row."""
    k = len(model.pairs)
    total, ends = int(model.pairs.sum()), int(model.pairs[:, -2].sum())
    known = model.n_words + (ends > 0)

    def run(batch: Batch, told: tuple[np.ndarray, ...]) -> pa.Table:
        mark, count, _ = told
        n = len(batch.words)
        count = np.append(count, ends)
        of = np.append(np.where(count[:n] > 0, mark, k - 1), k - 2)
        a, b = batch.before, batch.tokens
        c = count[b]
        base = np.log10((c + 0.1) / (total + 0.1 * (known + 1)))
        if total:
            emit = np.where(count > 0, (1 - model.fresh[of]) * count / np.maximum(model.into[of], 1), 0)
            alone = np.where(c > 0, (1 - model.unknown) * c / total, model.unknown)
            path = np.where(c > 0, model.step[of[a], of[b]] * emit[b], model.step_fresh[of[a]])
            p = np.log10(PATH * path + (1 - PATH) * alone)
        else:
            p = np.zeros(len(b))
        at = np.cumsum(batch.sizes) - batch.sizes
        sums = [np.add.reduceat(v, at) if len(at) else v for v in ((c > 0).astype(np.int64), base, p)]
        ids = batch.ids.chunk(0).flatten() if isinstance(batch.ids, pa.ChunkedArray) else batch.ids.flatten()
        columns = [ids, pa.array(batch.train.astype(bool)), pa.array(batch.sizes), pa.array(sums[0]), pa.array(np.full(len(ids), total)), pa.array(sums[1]), pa.array(sums[2])]
        return pa.table(columns, names=[id_col, "train", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return with_answers(coded, answers, run, f"`{id_col}` {kind}, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def class_scores(df: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", classes: int = CLASSES, rounds: int = ROUNDS, fan_bits: int = FAN_BITS) -> DataFrame:
    """The log10 probability of every row's text by the model learned from the rows for which ``train`` (over the id) holds, and by add-0.1 unigrams."""
    n = partitions(df.sparkSession)
    total = df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    buckets = 1 << max(4, (max(n, total // BUCKET_BYTES) - 1).bit_length())
    coded = coded_batches(df, train, id_col, text_col).repartition(n, "batch").persist(StorageLevel.DISK_ONLY)
    answers, model = fit(coded, buckets, classes, rounds, fan_bits)
    out = stored(scores(coded, answers, model, id_col, dict(df.dtypes)[id_col]), "lm_scores")
    coded.unpersist()
    removed(answers)
    return out
