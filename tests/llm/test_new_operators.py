"""Periodic runs, class language model and importance resampling against brute force and on odd input."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

SPACES = r"[^\x20\x09-\x0D]+"


def _runs(words, least=24, repeats=3):
    n, out = len(words), {}
    for p in range(1, n // repeats + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j + p - i >= max(least, repeats * p) and j > i:
                out.setdefault((i, j + p), p)
            i = j + 1
    return sorted((s, e - s, p) for (s, e), p in out.items())


def test_runs_of_small_alphabets():
    from lemmata.llm import runs

    rng = random.Random(1)
    for _ in range(120):
        docs = []
        for _ in range(rng.randint(1, 5)):
            words = []
            while len(words) < rng.randint(0, 150):
                unit = [rng.randint(0, 2) for _ in range(rng.randint(1, 6))]
                words += (unit * rng.randint(1, 20))[: rng.randint(1, 60)] if rng.random() < 0.5 else [rng.randint(0, 3) for _ in range(rng.randint(1, 10))]
            docs.append(words)
        least, repeats = rng.choice([(24, 3), (4, 2), (6, 3)])
        first = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
        got = list(zip(*(x.tolist() for x in runs.find_runs(np.array([x for d in docs for x in d], np.int32), first, least, repeats))))
        assert got == [(i, *r) for i, d in enumerate(docs) for r in _runs(d, least, repeats)]
    with pytest.raises(ValueError):
        runs.find_runs(np.zeros(30, np.int32), np.array([0, 30]), 24, 1)


def test_runs_of_a_very_long_text(monkeypatch):
    """More grid pairs than are made at a time, and more text than a slice."""
    from lemmata.llm import runs

    monkeypatch.setattr(runs, "PAIRS", 5000)
    words = [f"w{i % 997}" for i in range(20_000)] + ["x", "y"] * 300 + [f"v{i}" for i in range(5000)]
    got = runs.run_rows(["1"], pa.array([" ".join(words)], pa.large_string()), None, 24, 3)
    assert (got["n_runs"], got["start"], got["length"], got["period"]) == ([2], [20_000], [600], [2])
    assert got["runs_sha256"] == [hashlib.sha256(b"0,20000,997\n20000,600,2\n").hexdigest()]


def test_runs_of_odd_rows(spark):
    from lemmata.llm.runs import collapsed_texts, periodic_runs

    loop = "a\tb \n" * 15
    rows = [(1, None, 7), (2, "", 7), (None, loop, 7), (4, loop, 7), (4, loop + "ü ü", 7), (5, " \n\t ", 7), (6, "one two", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_runs int")
    out = periodic_runs(df).collect()
    empty = hashlib.sha256(b"").hexdigest()
    by = {(r["doc_id"], r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"], r["collapsed_sha256"]) for r in out}
    ab = hashlib.sha256(b"a b").hexdigest()
    assert len(out) == 7 and by == {
        (1, 0, None, None, None, None, empty), (2, 0, None, None, None, None, empty), (5, 0, None, None, None, None, empty),
        (None, 1, 0, 30, 2, 15000, ab), (4, 1, 0, 30, 2, 15000, ab), (4, 1, 0, 30, 2, 15000, hashlib.sha256("a b ü ü".encode()).hexdigest()),
        (6, 0, None, None, None, None, hashlib.sha256(b"one two").hexdigest()),
    }
    assert periodic_runs(df.limit(0)).count() == 0
    texts = Counter((r["doc_id"], r["text"], r["n_runs"]) for r in collapsed_texts(df).collect())
    assert texts == Counter([(1, None, 7), (2, "", 7), (None, "a b", 7), (4, "a b", 7), (4, "a b ü ü", 7), (5, " \n\t ", 7), (6, "one two", 7)])


def _lm_table(spark, n=80):
    rng = random.Random(3)
    kinds = [[f"d{i}" for i in range(6)], [f"n{i}" for i in range(9)], [f"v{i}" for i in range(7)]]
    rows = []
    for i in range(n):
        rows.append((i, " ".join(rng.choice(kinds[k % 3]) for k in range(rng.randint(3, 60))) + (f" rare{i}" if i % 7 == 0 else "")))
    rows += [(n, None), (n + 1, ""), (None, "d0 n0 V0"), (3, rows[3][1])]
    return spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double"), rows


def test_class_lm_counts_and_probabilities(spark):
    from lemmata.llm.class_lm import class_scores

    df, rows = _lm_table(spark)
    train = F.col("doc_id") % 5 != 0
    got = class_scores(df, train, classes=4, rounds=6).collect()
    tokens = [(i, re.findall(SPACES, re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None]) for i, t in rows]
    counts = Counter(w for i, ws in tokens if i is not None and i % 5 for w in ws)
    total, known = sum(counts.values()), len(counts)
    want = Counter()
    for i, ws in tokens:
        want[i, i is not None and i % 5 != 0, len(ws), sum(counts[w] > 0 for w in ws), total, round(sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (known + 1))) for w in ws), 6)] += 1
    assert want == Counter((r["doc_id"], r["train"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got)
    held = [r for r in got if not r["train"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)  # classes of words that follow each other are found
    assert all(r["score"] < 0 for r in got)


def test_class_lm_adds_up_to_one(spark):
    """All tokens and the unknown symbol after one word, by texts of two tokens: P(w, end) summed over the model's words."""
    from lemmata.llm.class_lm import class_scores

    words = ["a", "b", "c", "d", "e", "f"]
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(words) for _ in range(12))) for i in range(30)]
    seen = sorted({w for _, t in rows for w in t.split()})
    probes = [(100, "")] + [(100 + k, w) for k, w in enumerate([*seen, "unknown"], 1)] + [(1000 + 10 * k + j, f"{w} {v}") for k, w in enumerate([*seen, "unknown"]) for j, v in enumerate([*seen, "unknown"])]
    df = spark.createDataFrame(rows + probes, "doc_id long, text string")
    p = {r["doc_id"]: 10 ** r["score"] for r in class_scores(df, F.col("doc_id") < 100, classes=3, rounds=4).collect()}
    # the first token: P(end) + sum over w of P(w) = 1, where P(w) = P(w, end) / P(end | w); P(end | w) = 1 - sum over v of P(v | w)
    # with x[w] = P(end | w): P(w v end) = P(w) P(v | w) x[v]; solve from sum over v of P(w v end) / x[v] + P(w end) = P(w)
    names = [*seen, "unknown"]
    one = np.array([p[100 + k] for k in range(1, len(names) + 1)])
    two = np.array([[p[1000 + 10 * k + j] for j in range(len(names))] for k in range(len(names))])
    x = np.full(len(names), 0.1)
    for _ in range(2000):  # x[w] = P(w end) / P(w), where P(w) = P(w end) + sum over v P(w v end) / x[v]
        x = one / (one + (two / x).sum(1))
    assert math.isclose(p[100] + (one / x).sum(), 1, abs_tol=1e-6)


def test_class_lm_levels_and_odd_tables(spark):
    from lemmata.llm.class_lm import class_scores

    df, _ = _lm_table(spark, 30)
    train = F.col("doc_id") % 5 != 0
    rows = lambda d: sorted(((r["doc_id"] is None, r["doc_id"], r["n_tokens"], round(r["score"], 9)) for r in d.collect()), key=str)
    assert rows(class_scores(df, train, classes=4, rounds=2)) == rows(class_scores(df, train, classes=4, rounds=2, fan_bits=2))
    assert class_scores(df.limit(0), train).count() == 0
    none = class_scores(df, F.lit(False), classes=4, rounds=1).collect()
    assert {(r["score"], r["base_score"], r["n_known"], r["train_tokens"]) for r in none} == {(0.0, 0.0, 0, 0)}
    with pytest.raises(ValueError):
        class_scores(df, train, classes=0)


def test_exchange_takes_the_best_class():
    """The chosen class raises the likelihood of all class pairs most, by counting them anew (no word follows itself)."""
    from lemmata.llm import class_lm
    from lemmata.llm.routes import Load

    rng = np.random.default_rng(2)
    v, classes = 12, 3
    k = classes + 2
    text = [int(rng.integers(v))]
    while len(text) < 400:
        w = int(rng.integers(v))
        if w != text[-1]:
            text.append(w)
    words = np.sort(rng.integers(0, 2**63, v, dtype=np.uint64))
    mark = np.array([i % classes for i in range(v)], np.uint8)

    def pairs_of(mark):
        of = np.append(mark, classes)
        seq = [v, *text, v]
        out = np.zeros((k, k), np.int64)
        for a, b in zip(seq, seq[1:]):
            out[of[a], of[b]] += 1
        return out

    def likelihood(pairs):
        f = lambda x: (x * np.log(np.maximum(x, 1))).sum()
        return f(pairs) - f(pairs.sum(0)) - f(pairs.sum(1))

    of = np.append(mark, classes)
    cells = Counter()
    seq = [v, *text, v]
    for a, b in zip(seq, seq[1:]):
        if a < v:
            cells[a, int(of[b])] += 1
        if b < v:
            cells[b, k + int(of[a])] += 1
    keys = sorted(cells)
    load = Load(np.bincount(text, minlength=v), mark, np.zeros(v, np.int64), np.bincount([a for a, _ in keys], minlength=v).astype(np.int32), np.array([c for _, c in keys], np.uint16), np.array([cells[x] for x in keys]))
    got = class_lm.exchange(words, load, pairs_of(mark), classes)
    for w in range(v):
        options = []
        for c in range(classes):
            moved = mark.copy()
            moved[w] = c
            options.append(likelihood(pairs_of(moved)))
        assert options[got[w]] > max(options) - 1e-2


def _features(text, n=2):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


@pytest.mark.parametrize("n", [1, 2, 3])
def test_feature_buckets(n):
    from lemmata.llm import importance

    texts = ["Hello, wörld 12ab x", "", "a  b c d e f", "ÉCOLE " + "y" * 70 + " z " + "q" * 300, "one", "İ ÀB\x00c"]
    bucket, row, words = importance.features(pa.array(texts, pa.large_string()), 10_000, n)
    want = sorted((i, zlib.crc32(f.encode()) % 10_000) for i, t in enumerate(texts) for f in _features(t, n)[1])
    assert sorted(zip(row.tolist(), bucket.tolist())) == want
    assert words.tolist() == [len(_features(t)[0]) for t in texts]


def test_resampling_with_ties_and_odd_rows(spark):
    from lemmata.llm.importance import resample

    long = "alpha beta gamma delta " * 6
    rows = [(i, long + f" w{i % 3}") for i in range(40)] + [(7, long + " w1")] * 3 + [(None, long), (None, long), (50, None), (51, ""), (52, "short")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, rank int")
    target = spark.createDataFrame([("beta gamma w1",), (None,)], "text string")
    got = resample(df, target).collect()
    assert len(got) == len(rows)
    able = [r for r in got if r["n_words"] >= 20]
    k = 25 * len(able) // 100
    order = sorted(able, key=lambda r: (-r["score"], r["doc_id"] is None, r["doc_id"] or 0))
    ranked = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, k + 1))
    assert [(r["score"], r["doc_id"]) for r in ranked] == [(r["score"], r["doc_id"]) for r in order[:k]]
    assert {r["weight"] for r in got if not r["n_features"]} == {0}
    assert resample(df.limit(0), target).count() == 0
    assert resample(df, target.limit(0)).count() == len(rows)
    with pytest.raises(TypeError):
        resample(df.withColumn("doc_id", F.col("doc_id").cast("string")), target)


def test_kth_key_of_wide_values(spark):
    from lemmata.llm.importance import kth_key

    rng = random.Random(9)
    rows = [(rng.choice([-(2**63), 2**63 - 1, 0, -1, 5, 2**40 + rng.randint(0, 3)]), rng.randint(-3, 3), i) for i in range(200)]
    df = spark.createDataFrame(rows, "a long, b long, c long")
    order = sorted(rows)
    for k in (1, 2, 50, 133, 200):
        assert kth_key(df, ["a", "b", "c"], k) == order[k - 1]
    assert kth_key(df, ["a"], 201) is None and kth_key(df, ["a"], 0) is None and kth_key(df.limit(0), ["a"], 1) is None


def test_line_measures_take_the_place_of_columns_of_their_names(spark):
    from lemmata.llm.lines import drop_repeated_chunks

    df = spark.createDataFrame([(1, "a\nb", "x"), (2, None, "y")], "doc_id long, text string, N_LINES string")
    out = drop_repeated_chunks(df, measures=True)
    assert out.columns == ["doc_id", "text", "n_lines", "n_removed_lines", "n_removed_bytes"]
    assert sorted((r["doc_id"], r["n_lines"]) for r in out.collect()) == [(1, 2), (2, 0)]
    assert drop_repeated_chunks(df).columns == df.columns
