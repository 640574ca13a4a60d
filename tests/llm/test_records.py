"""Chat formatting and WARC, against plain Python."""

import base64
import hashlib
import json

import pytest


def test_layouts_and_fingerprints():
    from lemmata.llm.chat import mapping_of, turns_of

    cases = [
        ({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]}, "messages"),
        ({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}, "from_value"),
        ({"prompt": "a", "completion": "b"}, "prompt_completion"),
        ({"instruction": "a", "input": "", "output": "b"}, "instruction_input_output"),
        ({"instruction": "a", "output": "b", "id": 7}, "instruction_output"),
    ]
    for record, want in cases:
        assert mapping_of(record)[1] == want
        assert turns_of(record, want) == [("user", "a"), ("assistant", "b")]
    assert mapping_of({"other": 1})[1] == "unknown" and turns_of({"other": 1}, "unknown") == []


HARD = ["", "\\", "\\\\[INST]", "</s>[INST] ok [/INST]", "[/INST] ", " [ROLE x] </s", "[OUT] a </s>", "]]>\n[SYS]", "é🙂" * 40, "a\\", "<", "["]


def test_template_is_reversible():
    from lemmata.llm.chat import format_turn, parse, unescape

    turns = [(r, t) for r in ("user", "system", "assistant", "tool]\\", "") for t in HARD]
    assert parse("".join(format_turn(*t)[0] for t in turns)) == turns
    for t in turns:
        f, a, b = format_turn(*t)
        assert unescape(f[a:b]) == t[1]
    with pytest.raises(ValueError):
        parse("[INST] open")


def test_conversation_digests(spark):
    from lemmata.llm.chat import chat_digests, turn_records

    rows = [(c, t, ("user", "assistant", "system")[(c + t) % 3], HARD[(c * 5 + t) % len(HARD)], "x") for c in range(6) for t in range(8)]
    rows += [(7, None, None, None, "x"), (7, 0, "assistant", "z", "x"), (7, 0, "assistant", "z", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, record string").repartition(5)
    got = {r["conv_id"]: r for r in chat_digests(turn_records(df)).collect()}
    assert set(got) == {0, 1, 2, 3, 4, 5, 7}
    for c in got:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        want = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] for r in own if r[2] == "assistant")
        assert got[c]["n_turns"] == len(own)
        assert got[c]["turns_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat_digests(turn_records(df.limit(0))).count() == 0


def test_bad_records_give_no_turn(spark):
    from lemmata.llm.chat import canonical_turns

    rows = [(1, 0, None), (2, 0, "{"), (3, 0, "[1]"), (4, 0, json.dumps({"messages": []})), (5, 0, json.dumps({"messages": [3, {"role": "user", "content": None}]}))]
    got = canonical_turns(spark.createDataFrame(rows, "conv_id long, turn long, record string")).collect()
    assert [(r["conv_id"], r["role"], r["text"]) for r in got if r["mapping"] != "unknown"] in ([], [(5, "user", "")])


def test_warc_round_trip(spark):
    from pyspark.sql import functions as F

    from lemmata.llm.warc import read_records, write_archives

    rows = [(i, f"http://h/{i}\n", f"<p>{i % 4}é</p>" * (i % 4 + 1), "x") for i in range(20)] + [(30, None, None, "x"), (31, "u", "", "x"), (32, "v", "WARC/1.1\r\n\r\n" * 5, "x"), (33, "w", "q" * 300_000, "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(3)
    index = write_archives(df)
    got = {r["page_id"]: r for r in read_records(index).collect()}
    bodies = {r[0]: (r[2] or "").encode() for r in rows}
    assert set(got) == set(bodies)
    for page, body in bodies.items():
        last = max(p for p, b in bodies.items() if b == body)
        r = got[page]
        assert r["payload_bytes"] == len(body)
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert (r["record_type"], r["refers_to"]) == (("response", None) if page == last else ("revisit", last))
        assert page != last or bytes(r["payload"]) == body
    some = read_records(index.filter(F.col("page_id").isin(3, 32))).collect()
    assert {r["page_id"] for r in some} == {3, 32}
    small = write_archives(df, min_revisit_bytes=1)
    assert {r["record_type"] for r in read_records(small).filter("page_id in (30, 31)").collect()} == {"response"}
    assert read_records(write_archives(df.limit(0))).count() == 0


def test_system_texts_content_parts_and_unknown_records_stay(spark):
    from lemmata.llm.chat import canonical_turns, chat_digests

    pair = [("user", "a"), ("assistant", "b")]
    parts = [{"type": "text", "text": "a"}, {"type": "image", "url": "u"}, {"type": "text", "text": "c"}]
    cases = [
        ({"system": "s", "prompt": "a", "response": "b"}, [("system", "s"), *pair]),
        ({"system": "s", "instruction": "a", "output": "b"}, [("system", "s"), *pair]),
        ({"system": "s", "messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]}, [("system", "s"), *pair]),
        ({"system": "s", "prompt": "a", "completion": "b", "id": 1}, [("system", "s"), *pair]),
        ({"messages": [{"role": "user", "content": parts}, {"role": "assistant", "content": "b"}]}, [("user", 'a\n{"type": "image", "url": "u"}\nc'), ("assistant", "b")]),
        ({"messages": [{"role": "user", "content": parts[:1]}]}, [("user", "a")]),
        ({"other": 1}, [("unknown", '{"other": 1}')]),
    ]
    df = spark.createDataFrame([(i, 0, json.dumps(r)) for i, (r, _) in enumerate(cases)] + [(99, 0, "{")], "conv_id long, turn long, record string")
    got = canonical_turns(df).orderBy("conv_id", "part").collect()
    for i, (_, want) in enumerate(cases):
        assert [(r["role"], r["text"]) for r in got if r["conv_id"] == i] == want
    assert [(r["role"], r["text"], r["mapping"]) for r in got if r["conv_id"] == 99] == [("unknown", "{", "unknown")]
    assert {r["conv_id"]: r["n_turns"] for r in chat_digests(df).collect()} == {i: len(w) for i, (_, w) in enumerate(cases)} | {99: 1}


def test_warc_repeated_and_null_ids(spark):
    from lemmata.llm.warc import read_records, write_archives

    rows = [(None, "u", "same"), (None, "v", "alone"), (4, "w", "same"), (4, "w", "same"), (4, "x", "other"), (9, "y", "same"), (None, None, None)]
    got = read_records(write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2))).collect()
    assert sorted(((r["page_id"], r["url"], r["record_type"], r["refers_to"]) for r in got), key=str) == sorted(
        [(None, "u", "revisit", 9), (None, "v", "response", None), (4, "w", "revisit", 9), (4, "w", "revisit", 9), (4, "x", "response", None), (9, "y", "response", None), (None, "", "response", None)], key=str)
    with pytest.raises(TypeError):
        write_archives(spark.createDataFrame([("a", "u", "h")], "page_id string, url string, html string"))


def test_chat_long_texts_and_quoted_columns(spark):
    from lemmata.llm.chat import chat_digests, format_turns

    long = "a [INST] b \\ </s> " * 60_000
    df = spark.createDataFrame([(1, 0, json.dumps({"messages": [{"role": "user", "content": long}, {"role": "assistant", "content": long}]}))], "conv_id long, turn long, record string")
    row = chat_digests(df).collect()[0]
    assert row["loss_chars"] == len(long) and row["loss_sha256"] == hashlib.sha256(long.encode()).hexdigest()
    turns = spark.sql("select 1L as conv_id, 0L as turn, 'user' as role, 'x' as text, named_struct('a b', 1, 'c`d', 'e') as `odd name`")
    assert format_turns(turns).collect()[0]["odd name"]["a b"] == 1
