"""The order of a project's files against a walk over its includes."""

import random

from lemmata.operators import project


def walked(mains, edges):
    """Files by a walk that skips includes of the main file; None for those met twice or below such."""
    out = {}
    for main in mains:
        seen, order = {}, []

        def visit(f, main=main, seen=seen, order=order):
            seen[f] = seen.get(f, 0) + 1
            order.append(f)
            if seen[f] < 3:  # enough to tell
                for _, g in sorted((o, g) for a, o, g in edges if a == f and g not in (main, f)):
                    visit(g)

        visit(main)
        place = 0
        for f in order:
            if seen[f] == 1:
                out[main, f] = place
                place += 1
            else:
                out[main, f] = None
    return out


def _run(spark, mains, edges):
    m = spark.createDataFrame([(x,) for x in mains], "main int")
    e = spark.createDataFrame(edges, "file int, offset int, included int")
    return {(r.main, r.file): r.position for r in project.source_order(m, e).collect()}


def test_random_graphs(spark):
    rng = random.Random(7)
    mains, edges = [], []
    for g in range(12):  # several graphs at once, each with files of its own
        n, base = rng.randint(1, 12), 100 * g
        mains += [base] + ([base + 1] if n > 3 and rng.random() < 0.4 else [])
        edges += [(base + rng.randint(0, max(0, k - 1)), rng.randint(0, 50) * 20 + k, base + k) for k in range(1, n) if rng.random() < 0.95]
        edges += [(base + a, 2000 + b, base + b) for a, b in (sorted(rng.sample(range(n), 2)) for _ in range(rng.choice([0, 0, 1, 2])) if n > 2)]
    assert _run(spark, mains, edges) == walked(mains, edges)


def test_deep_chains_and_stacked_diamonds(spark):
    chain = [(k, 0, k + 1) for k in range(80)]
    diamonds = [e for k in range(20) for a in [1000 + 3 * k] for e in ((a, 0, a + 1), (a, 1, a + 2), (a + 1, 0, a + 3), (a + 2, 0, a + 3))]
    got = _run(spark, [0, 1000], chain + diamonds)
    assert [got[0, k] for k in range(81)] == list(range(81))
    assert len(got) == 81 + 61  # a row a file, however many ways lead to it
    assert [got[1000, f] for f in (1000, 1001, 1002, 1003, 1004)] == [0, 1, 2, None, None]


def test_back_includes_and_lonely_files(spark):
    got = _run(spark, [1, 9], [(1, 0, 2), (2, 0, 1), (2, 5, 3), (3, 0, 3), (4, 0, 5)])
    assert got == {(1, 1): 0, (1, 2): 1, (1, 3): 2, (9, 9): 0}
