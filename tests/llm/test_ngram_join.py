"""The similarity join against all pairs."""

import re

import numpy as np
import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    sets = {}
    for i, (doc, text) in enumerate(rows):
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    low = {}
    for i in sets:
        low[find(i)] = min(low.get(find(i), rows[i][0]), rows[i][0])
    return sorted((rows[i][0], len(sets[i]), low[find(i)]) for i in sets)


def corpus(seed, n_base=12, copies=14):
    rng = np.random.default_rng(seed)
    words = np.array([f"w{k}" for k in range(300)])
    passage = rng.choice(words, 40).tolist()
    texts = []
    for _ in range(n_base):
        base = rng.choice(words, int(rng.integers(8, 160))).tolist()
        for _ in range(int(rng.integers(1, copies))):
            t = list(base)
            for _ in range(int(rng.integers(0, 5))):
                t[int(rng.integers(len(t)))] = f"x{rng.integers(10**6)}"
            if rng.random() < 0.3:
                t = t[: int(len(t) * rng.uniform(0.7, 1))]
            if rng.random() < 0.3:
                t += passage
            texts.append(" ".join(t) if rng.random() < 0.8 else "  ".join(t).upper())
    texts += [None, "", " \n", "one", "One", "two words", "two words", "a b c d", "a b c d e", "a b c d e f"]
    ids = rng.permutation(len(texts) * 3)[: len(texts)].tolist()
    return list(zip(map(int, ids), texts))


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed, monkeypatch):
    from lemmata.llm import ngram_join

    monkeypatch.setattr(ngram_join, "BLOCK_SETS", 9)
    rows = corpus(seed)
    df = spark.createDataFrame([(t, d, "x", 1) for d, t in rows], "text string, doc_id long, node string, n int").repartition(3)
    got = sorted(tuple(r) for r in ngram_join.ngram_join(df).collect())
    assert got == brute(rows)


def test_edge_tables(spark):
    from lemmata.llm.ngram_join import ngram_join

    none = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join(none).count() == 0
    rows = [(1, "a b c d e f g"), (1, "a b c d e f g"), (None, "a b c d e f g"), (None, "z"), (5, None)]
    got = sorted((tuple(r) for r in ngram_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(1, 3, 1), (1, 3, 1), (None, 3, 1), (None, 1, None), (5, 0, 5)], key=str)


def test_components_of_chains(spark):
    from lemmata.llm.components import components

    edges = [(i, i + 1) for i in range(40)] + [(i + 60, 59) for i in range(10)]
    got = dict(tuple(r) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, **{i: 59 for i in range(59, 70)}}
