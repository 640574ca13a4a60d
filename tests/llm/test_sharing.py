"""Key sharing over one level and over several against plain counting."""

from collections import Counter

import numpy as np
import pyarrow as pa


def _table(spark, n=60):
    rng = np.random.default_rng(4)
    rows = [(i, " ".join(f"k{v}" for v in rng.integers(0, 400, 50))) for i in range(n)] + [(n, None), (n + 1, "")]
    return spark.createDataFrame(rows, "doc_id long, text string"), rows


def _keys(table):
    from lemmata.llm import sharing
    from lemmata.llm.shingles import shingle_sets
    from lemmata.llm import arrays

    return np.concatenate([shingle_sets(arrays.text_of(p, "text"), 1)[0] for p in sharing.parts(table, 1 << 20)] or [np.zeros(0, np.uint64)])


def test_levels_agree(spark):
    from lemmata.llm import sharing
    from pyspark.sql import functions as F

    df, rows = _table(spark)
    _, docs, _ = sharing.batched(df, "doc_id", "text")
    buckets = 64

    def of_batch(table: pa.Table, answers: pa.Table) -> pa.Table:
        keys = _keys(table)
        cls = sharing.class_of(keys, answers, buckets)
        return pa.table({"key": pa.array(keys.view(np.int64)), "cls": pa.array(cls.astype(np.int32))})

    got = []
    for fan_bits in (12, 3, 2):  # one level, two, three
        answers = sharing.shared_classes(docs, _keys, buckets, fan_bits)
        out = docs.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(of_batch, "key long, cls int")
        got.append(sorted(map(tuple, out.collect())))
    assert got[0] == got[1] == got[2]
    counts = Counter(k for _, t in rows if t for k in set(t.split()))
    want = Counter(int(c) for w in counts for c in [sharing.share_class(np.array([counts[w]]))[0]] * counts[w])
    assert Counter(c for _, c in got[0]) == want


def test_blocks_grow_with_the_input(spark):
    """Between levels a source sends at most 2 ** fan_bits blocks, whatever the number of buckets."""
    from lemmata.llm import sharing

    keys = np.unique(np.random.default_rng(1).integers(0, 2**40, 5000, dtype=np.uint64) << np.uint64(12))
    for bits in (8, 16, 20):
        step = -(-bits // max(1, -(-bits // 8)))
        cut = np.unique(sharing.cut(keys, 1 << bits))
        blocks = sharing._split(cut, np.ones(len(cut), np.int64), 7, 0, bits, step)
        assert blocks.num_rows <= 2**8
        back = np.concatenate([sharing.get_sorted(k) + (np.uint64(b) << np.uint64(32 + bits - step)) for b, k in zip(blocks["bucket"].to_pylist(), blocks["keys"].to_pylist())])
        assert (back == cut).all()
