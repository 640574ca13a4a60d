"""The pipeline, stage by stage, against brute force."""

import zlib

import numpy as np

import corpus_pipeline
from tests.llm.test_ngram_join import brute as brute_join
from tests.llm.test_suffixes import brute as brute_bytes

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus():
    rng = np.random.default_rng(5)
    words = np.array([f"wörd{k}" if k % 7 == 0 else f"word{k}" for k in range(500)])
    passage = "\n".join(" ".join(rng.choice(words, 9)) for _ in range(6))
    rows = []
    for i in range(40):
        t = "\n".join(" ".join(rng.choice(words, 10)) for _ in range(9))
        if i % 4 == 0:
            t += "\n" + passage
        rows.append(t)
    rows += [rows[3], rows[5] + " one more", "short text", None, "", ("again and again " * 60)]
    return [(i, t, "en", "s", len(t or "")) for i, t in enumerate(rows)]


def test_stages(spark):
    from tokenizers import Tokenizer
    import public_tokenizers

    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "lines", "near_duplicates", "suffixes", "packing"]
    first = stages["quality"](spark, docs, "").cache()
    assert first.columns == COLUMNS
    assert {r["doc_id"] for r in first.collect()} == set(range(42))
    second = stages["lines"](spark, first, "").cache()
    texts = {r["doc_id"]: r for r in second.collect()}
    assert second.columns == COLUMNS and set(texts) == set(range(42))
    assert all(r["n_chars"] == len(r["text"]) for r in texts.values())
    assert texts[0]["text"] == rows[0][1] and len(texts[4]["text"]) < len(rows[4][1])
    third = stages["near_duplicates"](spark, second, "").cache()
    given = [(d, r["text"]) for d, r in texts.items()]
    assert {r["doc_id"] for r in third.collect()} == {d for d, _, c in brute_join(given) if c == d}
    fourth = stages["suffixes"](spark, third, "").cache()
    kept = [(r["doc_id"], r["text"]) for r in third.collect()]
    lost = {b[0]: b for b in brute_bytes(kept)}
    assert fourth.columns == COLUMNS
    for r in fourth.collect():
        before = texts[r["doc_id"]]["text"].encode()
        assert 0 <= len(before) - len(r["text"].encode()) - lost[r["doc_id"]][2] <= 3 * lost[r["doc_id"]][3] * 2
        assert lost[r["doc_id"]][2] or r["text"].encode() == before
    last = stages["packing"](spark, fourth, "").collect()
    plain = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in fourth.collect():
        ids = [*plain.encode(r["text"], add_special_tokens=False).ids, 1]
        for p in (p for p in last if p["doc_id"] == r["doc_id"]):
            part = ids[p["start"] : p["start"] + p["length"]]
            assert p["ids_crc32"] == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part)) and p["doc_tokens"] == len(ids)
        assert sum(p["length"] for p in last if p["doc_id"] == r["doc_id"]) == len(ids)


def test_without_keeps_whole_characters():
    from lemmata.llm.suffixes import without

    gone = np.packbits([0, 1, 0, 0, 0, 1]).tobytes()  # the first byte of é, and d
    assert without("aébcd", gone) == "abc"
    assert without("abc", None) == ""


def test_stages_of_edge_tables(spark):
    """Empty tables, repeated rows, null ids and texts, and extra columns whose names the operators use themselves."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, _gone string, gone int, sha string, hit boolean, at int, `a b` struct<`c d`:int>"
    more = ("x", "y", 1, "g", 2, "s", True, 3, (4,))
    long = "\n".join(" ".join(f"w{k}x{j}" for j in range(10)) for k in range(12))
    rows = [(i, t, *more) for i, t in [(1, long), (1, long), (2, long + "\nend"), (None, long), (3, None), (4, ""), (5, "one two"), (6, "\n".join(f"other {k} and more words {k * k}" for k in range(15)))]]
    for table in ([], rows):
        docs = spark.createDataFrame(table, schema).repartition(2)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, "")
            assert out.columns == docs.columns, name
            got = out.collect()
            assert all(r["_gone"] == "g" and r["a b"]["c d"] == 4 for r in got)
            texts = sorted(((r["doc_id"], r["text"]) for r in got), key=str)
            if not table:
                assert got == []
            elif name == "quality":
                assert {d for d, _ in texts} == {1, 2, None, 6} and len(texts) == 5
            elif name == "lines":
                assert len(texts) == len(rows) and texts.count((1, long)) == 2 and (3, None) in texts and (2, "end") in texts
            elif name == "near_duplicates":
                assert [d for d, _ in texts].count(1) == 2 and 2 not in {d for d, _ in texts} and {3, 4, 5, 6} <= {d for d, _ in texts}
            else:
                assert len(texts) == len(rows) and texts.count((1, long)) == 2 and (None, "") in texts and (3, None) in texts
        pieces = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
        assert len({(p["sequence_id"], p["offset"]) for p in pieces}) == len(pieces)
        assert sum(p["length"] == p["doc_tokens"] == 1 for p in pieces if p["doc_id"] in (3, 4)) == (2 if table else 0)
