"""Repeated bytes against a dictionary of all 50-byte strings."""

import hashlib

import numpy as np
import pytest


def brute(rows, length=50):
    first = {}
    for doc, text in rows:
        b = (text or "").encode()
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            first[s] = min(first.get(s, doc), doc)
    out = []
    for doc, text in rows:
        b = (text or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < doc:
                gone[i : i + length] = [True] * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus(seed):
    rng = np.random.default_rng(seed)
    letters = list("abcdé ñ\n")
    word = lambda n: "".join(rng.choice(letters, n))
    shared = [word(int(n)) for n in rng.integers(30, 160, 6)]
    texts = []
    for _ in range(60):
        t = ""
        for _ in range(int(rng.integers(0, 6))):
            t += word(int(rng.integers(0, 60))) if rng.random() < 0.5 else shared[int(rng.integers(6))][int(rng.integers(0, 20)) :]
        texts.append(t)
    texts += [None, "", "x" * 49, "x" * 49, "y" * 50, "y" * 50, "z" * 400, "z" * 120, texts[3], texts[4] + "q", texts[5], "k" * 51 + "é" * 60]
    ids = rng.permutation(500)[: len(texts)].tolist()
    return list(zip(map(int, ids), texts))


@pytest.mark.parametrize("seed,hot", [(1, 20_000), (2, 2)])
def test_equals_brute_force(spark, seed, hot):
    from lemmata.llm.suffixes import repeated_bytes

    rows = corpus(seed)
    df = spark.createDataFrame([(t, d, "x", 0) for d, t in rows], "text string, doc_id long, body string, kind int").repartition(3)
    got = sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeated_bytes(df, hot=hot).collect())
    assert got == brute(rows)


def test_edge_tables(spark):
    from lemmata.llm.suffixes import repeated_bytes

    assert repeated_bytes(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    text = "a passage of more than fifty bytes that all of these rows hold in full"
    rows = [(4, text), (4, text), (None, text), (None, text), (9, text + "!"), (2, None)]
    got = sorted(((r["doc_id"], r["n_removed"]) for r in repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    n = len(text)
    assert got == sorted([(4, 0), (4, 0), (None, n), (None, n), (9, n), (2, 0)], key=str)


def test_anchors_are_shared_by_equal_strings():
    from lemmata.llm.suffixes import GRAM, anchors

    rng = np.random.default_rng(0)
    data = rng.integers(97, 100, 4000).astype(np.uint8)
    off = np.array([0, 10, 60, 60, 1500, 4000])
    at, _ = anchors(data, off)
    for a, b in zip(off[:-1], off[1:]):
        for s in range(a, b - 49):
            assert ((at >= s) & (at <= s + 50 - GRAM)).any()


def test_refine_blocks():
    from lemmata.llm.suffixes import refine

    rng = np.random.default_rng(1)
    columns = rng.integers(0, 3, (6, 200)).astype(np.uint8)
    for h, block in enumerate(refine(columns)):
        names = [tuple(columns[: h + 1, i]) for i in range(200)]
        assert len(set(block.tolist())) == len(set(names)) == len(set(zip(names, block.tolist())))


def test_copies_are_told_by_text_as_well_as_id(spark):
    """Null ids and ids with several texts, of which some equal an earlier text."""
    from lemmata.llm.suffixes import drop_repeated_bytes, repeated_bytes

    last = 2**63 - 1
    a, b = "text A of more than fifty bytes, which a smaller id holds as well", "text B of more than fifty bytes that no other row holds, not at all"
    rows = [(5, a), (5, b), (3, a), (None, a), (None, "unique text of a row without an id, more than fifty bytes long"), (None, "short"), (None, ""), (None, None)]
    rows += [(None, t) if d % 5 == 0 else (100 + d // 40, t) for d, t in corpus(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((last if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in repeated_bytes(df).collect())
    assert got == brute([(last if d is None else d, t) for d, t in rows])
    kept = [(r["doc_id"], r["text"]) for r in drop_repeated_bytes(df).collect()]
    assert all(x in kept for x in [(5, ""), (5, b), (3, a), (None, ""), rows[4], (None, "short"), (None, None)])


def test_anchors_fill_their_buckets_evenly():
    """Anchors are k-grams of least hash; by the top bits of that hash, 7 of 10 fell into the first of 16 buckets, whose task then held most of the table."""
    from lemmata.llm.suffixes import anchors

    data = np.random.default_rng(5).integers(97, 123, 400_000).astype(np.uint8)
    at, h = anchors(data, np.array([0, 150_000, len(data)]))
    shares = np.bincount((h >> np.uint64(60)).astype(np.int64), minlength=16) / len(h)
    assert len(h) > 30_000 and shares.max() < 0.08
    assert len(np.unique(h)) == len({data[p : p + 32].tobytes() for p in at.tolist()})


def test_surroundings_and_texts_are_not_stored(spark):
    """Surroundings and texts were stored and then shuffled again: in the check of op10_suffixes more than four times the input of disk."""
    from pathlib import Path

    from lemmata.llm.storage import shared_folder
    from lemmata.llm.suffixes import repeated_bytes

    folder = Path(shared_folder(spark).removeprefix("file://"))
    before = set(folder.rglob("*"))
    rows = [(d, t) for d, t in corpus(6)]
    got = repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got.collect()) == brute(rows)
    assert set(folder.rglob("*")) == before


def test_rows_of_a_batch_come_in_one_order():
    """Entries are numbered in one step and looked up in another, to which a shuffle may give the rows in another order."""
    import pyarrow as pa

    from lemmata.llm.suffixes import _in_order

    rows = [(3, b"b"), (3, b"a"), (None, None), (None, b"a"), (1, b""), (3, b"a"), (1, None)]
    tables = [pa.table({"doc": pa.array([d for d, _ in r], pa.int64()), "packed": pa.array([t for _, t in r], pa.binary())}) for r in (rows, rows[::-1], rows[3:] + rows[:3])]
    first, *others = [_in_order(t).to_pylist() for t in tables]
    assert all(o == first for o in others) and len(first) == len(rows)
