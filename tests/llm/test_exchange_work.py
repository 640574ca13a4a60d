"""The work of an exchange round, and the merging of blocks against plain loops."""

import numpy as np

from lemmata.llm import class_lm, routes
from lemmata.llm.routes import Load


def load_of(rng, n, k):
    cells = rng.integers(1, 9, n).astype(np.int32)
    cell = np.concatenate([np.sort(rng.choice(2 * k, c, replace=False)) for c in cells]).astype(np.uint16)
    times = rng.integers(1, 4, len(cell)).astype(np.int64)
    times[::50] = 1000
    return Load(np.ones(n, np.int64), rng.integers(0, k - 2, n).astype(np.uint8), rng.integers(0, 9, n), cells, cell, times)


def test_equal_cells_are_worked_out_once(monkeypatch):
    rng = np.random.default_rng(5)
    classes, n = 16, 4000
    k = classes + 2
    load = load_of(rng, n, k)
    words, pairs = np.sort(rng.integers(0, 2**63, n)).astype(np.uint64), rng.integers(1, 10**5, (k, k))
    whole, done = class_lm._raised, []
    monkeypatch.setattr(class_lm, "_raised", lambda a, x: done.append(np.size(a)) or whole(a, x))
    got = class_lm.exchange(words, load, pairs, classes)
    sides = 3 * n * classes  # two margins and the pairs within a class
    assert sum(done) - sides < len(load.cell) * classes // 3
    monkeypatch.setattr(class_lm, "ALIKE", 1)  # each cell by itself
    assert (class_lm.exchange(words, load, pairs, classes) == got).all() and (got != load.mark).any()


def test_merged_blocks_by_plain_loops():
    rng = np.random.default_rng(6)
    keys = [np.sort(rng.choice(60, m, replace=False)).astype(np.uint64) for m in (0, 30, 1, 45)]
    marks = rng.integers(0, 9, 60)
    loads = [load_of(rng, len(v), 10) if len(v) else Load(*(np.zeros(0, t) for t in ("q", "B", "q", "i", "H", "q"))) for v in keys]
    for v, one in zip(keys, loads):
        one.mark = marks[v.astype(int)].astype(np.uint8)
    distinct, load, group = routes.merged(keys, loads)
    want: dict[int, list] = {}
    for v, one in zip(keys, loads):
        at = np.concatenate([[0], np.cumsum(one.cells)]).astype(int)
        for i, key in enumerate(v.tolist()):
            w = want.setdefault(key, [0, 10**9, {}])
            w[0], w[1] = w[0] + int(one.count[i]), min(w[1], int(one.owner[i]))
            for c, t in zip(one.cell[at[i] : at[i + 1]].tolist(), one.times[at[i] : at[i + 1]].tolist()):
                w[2][c] = w[2].get(c, 0) + t
    at = np.concatenate([[0], np.cumsum(load.cells)])
    got = {int(d): [int(load.count[i]), int(load.owner[i]), dict(zip(load.cell[at[i] : at[i + 1]].tolist(), load.times[at[i] : at[i + 1]].tolist()))] for i, d in enumerate(distinct)}
    assert got == want and list(got) == sorted(want) and (distinct[group] == np.concatenate(keys)).all() and (load.mark == marks[distinct.astype(int)]).all()
