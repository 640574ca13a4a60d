"""Kernels whose memory must follow the slice, not grow with it many times over."""

import tracemalloc

import numpy as np
import pyarrow as pa

from lemmata.llm import arrays, quality


def test_hashing_needs_no_tables_as_long_as_the_data():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 256, 3 << 20).astype(np.uint8)
    begin = np.array([0, 5, 65_535, 65_536, 131_000, 2_000_000, 3 << 20])
    end = np.array([3, 70_000, 65_536, 65_540, 400_000, 2_000_009, 3 << 20])
    tracemalloc.start()
    got = arrays.hash_spans(data, begin, end)
    peak = tracemalloc.get_traced_memory()[1]
    left = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert peak < 9 * len(data) + (8 << 20) and left < 4 << 20
    for a, b, h in zip(begin, end, got):  # a span hashes the same wherever it stands
        assert arrays.hash_spans(data[a:b].copy(), np.array([0]), np.array([b - a]))[0] == h or a == b


def test_quality_measures_small_slices(monkeypatch):
    from lemmata.llm.quality import quality_rules

    class Frame:
        schema = None

        def mapInArrow(self, run, schema):
            return run

    seen = []
    whole = quality.measure
    monkeypatch.setattr(quality, "measure", lambda texts, limits: seen.append(sum(map(len, texts.to_pylist()))) or whole(texts, limits))
    texts = [f"{i} " * 60 + "word " * (i % 50) for i in range(20_000)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    kept = [x for b in quality_rules(Frame(), keep_columns=True)(iter([batch])) for x in b.column("doc_id").to_pylist()]
    assert max(seen) <= 1 << 20 and sum(seen) == sum(map(len, texts))
    monkeypatch.undo()
    m = quality.measure(pa.array(texts))
    assert len(kept) <= int((m["n_words"] >= 50).sum())
