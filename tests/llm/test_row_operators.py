"""Operators that judge or rewrite each row, against plain Python."""

import base64
import hashlib
import re
import zlib
from collections import Counter

import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "text string, doc_id long, key long, n_words string"
LONG = "lorem ipsum dolor " * 3000 + "\n" + "é ü ñ  x" * 50
TEXTS = [None, "", " ", "\n\n", "a", "one two three four five six", "x  y\t z\n\nw   q  r", "It's, fine... isn't IT? <|endoftext|> 12345 #*$%", "É́cole ÑANDÚ, straße! (ok)... x).", "the cat sat on the mat\n" * 40, LONG, LONG, "İstanbul \x1c\x85 end ", "  lead and trail  "]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(t, i, 7, "clash") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def rows_by_id(df, name="doc_id"):
    return {r[name]: r for r in df.collect()}


def test_byte_bpe_equals_the_library(docs):
    import tiktoken

    from lemmata.llm.byte_bpe import decode, encode, round_trip

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = rows_by_id(round_trip(docs, path, public_tokenizers.PATTERN))
    ids = encode(docs, path, public_tokenizers.PATTERN)
    apart = rows_by_id(ids)
    back = rows_by_id(decode(ids, path, public_tokenizers.PATTERN))
    for i, t in enumerate(TEXTS):
        want = plain.encode_ordinary(t or "")
        assert apart[i]["ids"] == want
        assert bytes(back[i]["decoded"]) == (t or "").encode()
        assert got[i]["n_tokens"] == len(want)
        assert got[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()


def brute_quality(text):
    text = text or ""
    words = WORD.findall(text)
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = set()
    for i in range(len(words) - 2):
        if grams[tuple(words[i : i + 3])] > 1:
            inside |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": dup, "n_repeat_words": len(inside)}


def test_quality_measures(docs):
    from lemmata.llm.quality import quality_rules

    got = rows_by_id(quality_rules(docs))
    for i, t in enumerate(TEXTS):
        want = brute_quality(t)
        assert {k: got[i][k] for k in want} == want
        assert got[i]["base_failed"] == (want["n_words"] < 50 or 100 * want["n_repeat_words"] > 50 * want["n_words"])
        assert not (got[i]["kept"] and got[i]["base_failed"])
    assert quality_rules(docs, keep_columns=True).columns == docs.columns


def test_quality_keeps_clean_and_drops_repetition(spark):
    from lemmata.llm.quality import quality_rules

    clean = " ".join(f"word{i} other{i * 7 % 97}" for i in range(100))
    loop = clean + " " + "this passage of twelve words comes again and again in it " * 8
    got = rows_by_id(quality_rules(spark.createDataFrame([(0, clean), (1, loop)], "doc_id long, text string")))
    assert got[0]["kept"] and not got[1]["kept"]
    assert got[1]["dup_10gram_chars"] == sum(map(len, WORD.findall("this passage of twelve words comes again and again in it"))) * 8


def test_media_round_trip(docs):
    from lemmata.llm.media import clips, read_avi, write_avi

    media = write_avi(docs)
    got = rows_by_id(read_avi(media))
    files = rows_by_id(media)
    for i, t in enumerate(TEXTS):
        text = (t or "").encode()
        body = text + bytes(max(64, -(-len(text) // 64) * 64) - len(text))
        assert (got[i]["n_bytes"], got[i]["payload_bytes"]) == (len(text), len(body))
        assert got[i]["payload_sha256"] == hashlib.sha256(body).hexdigest()
        assert got[i]["tail_crc32"] == zlib.crc32(body[-64:])
        assert got[i]["media_sha256"] == hashlib.sha256(bytes(files[i]["media"])).hexdigest()
        assert got[i]["media_bytes"] == len(files[i]["media"])
    assert got[10]["feature"] == got[11]["feature"] and got[10]["media_sha256"] == got[11]["media_sha256"]
    rows = clips(media).filter("doc_id = 10").orderBy("clip").collect()
    assert rows[0]["start_s"] == 0.0 and all(a["end_s"] == b["start_s"] for a, b in zip(rows, rows[1:]))


def test_jpeg_samples_and_shots():
    import numpy as np

    from lemmata.llm.media import avi, frames_of, payload_length, shots

    every = bytes(range(256)) * 8 + bytes([0, 255] * 512) + bytes([255] * 1024)
    file = avi(every)
    assert payload_length(file) == len(every) and frames_of(file).tobytes()[: len(every)] == every
    flat = np.full((60, 64), 10, np.uint8)
    flat[30:] = 200
    assert shots(flat)[0] == [0, 30]
    with pytest.raises(ValueError):
        frames_of(b"RIFX" + file[4:])


def _coded(planes, factors, quant, every):
    """A baseline JPEG written independently: float DCT, codes of equal length, restart intervals; planes are (height, width) per component."""
    import struct

    import numpy as np

    order, r, c, up = [], 0, 0, True
    for _ in range(64):  # walk the zigzag
        order.append((r, c))
        if up:
            r, c, up = (r, c + 1, False) if r == 0 and c < 7 else (r + 1, c, False) if c == 7 else (r - 1, c + 1, True)
        else:
            r, c, up = (r + 1, c, True) if c == 0 and r < 7 else (r, c + 1, True) if r == 7 else (r + 1, c - 1, False)
    height, width = planes[0].shape
    hmax, vmax = max(f[0] for f in factors), max(f[1] for f in factors)
    across, down = -(-width // (8 * hmax)), -(-height // (8 * vmax))
    acs = [run << 4 | size for run in range(16) for size in range(1, 11)] + [0, 0xF0]
    out, bits, level = b"", "", [0] * len(planes)

    def number(v):
        size = abs(v).bit_length()
        return size, format(v if v > 0 else v + (1 << size) - 1, f"0{size}b") if size else ""

    def flush(text):
        text += "1" * (-len(text) % 8)
        return bytes(int(text[i : i + 8], 2) for i in range(0, len(text), 8)).replace(b"\xff", b"\xff\x00")

    full = []
    for p, (h, v) in zip(planes, factors):
        small = p[:: vmax // v, :: hmax // h]
        full.append(np.pad(small, ((0, down * v * 8 - small.shape[0]), (0, across * h * 8 - small.shape[1])), "edge").astype(float) - 128)
    for unit in range(across * down):
        if unit and every and unit % every == 0:
            out += flush(bits) + bytes([0xFF, 0xD0 + (unit // every - 1) % 8])
            bits, level = "", [0] * len(planes)
        my, mx = divmod(unit, across)
        for k, (h, v) in enumerate(factors):
            for y in range(v):
                for x in range(h):
                    block = full[k][(my * v + y) * 8 :, (mx * h + x) * 8 :][:8, :8]
                    coef = [[sum(block[i, j] * np.cos((2 * i + 1) * a * np.pi / 16) * np.cos((2 * j + 1) * b * np.pi / 16) for i in range(8) for j in range(8)) / 4 * (0.5**0.5 if a == 0 else 1) * (0.5**0.5 if b == 0 else 1) for b in range(8)] for a in range(8)]
                    zz = [round(coef[a][b] / quant) for a, b in order]
                    size, extra = number(zz[0] - level[k])
                    level[k] = zz[0]
                    bits += format(size, "04b") + extra
                    run = 0
                    last = max((i for i in range(1, 64) if zz[i]), default=0)
                    for i in range(1, last + 1):
                        if not zz[i]:
                            run += 1
                            continue
                        while run > 15:
                            bits, run = bits + format(acs.index(0xF0), "08b"), run - 16
                        size, extra = number(zz[i])
                        bits, run = bits + format(acs.index(run << 4 | size), "08b") + extra, 0
                    if last < 63:
                        bits += format(acs.index(0), "08b")
    out += flush(bits)
    seg = lambda mark, body: bytes([0xFF, mark]) + struct.pack(">H", len(body) + 2) + body
    head = b"\xff\xd8" + seg(0xDB, bytes([0] + [quant] * 64)) + seg(0xC0, struct.pack(">BHHB", 8, height, width, len(planes)) + b"".join(bytes([i + 1, h << 4 | v, 0]) for i, (h, v) in enumerate(factors)))
    head += seg(0xC4, bytes([0, 0, 0, 0, 12] + [0] * 12) + bytes(range(12))) + seg(0xC4, bytes([0x10] + [0] * 7 + [len(acs)] + [0] * 8) + bytes(acs))
    head += (seg(0xDD, struct.pack(">H", every)) if every else b"") + seg(0xDA, bytes([len(planes)]) + b"".join(bytes([i + 1, 0]) for i in range(len(planes))) + b"\0\x3f\0")
    return head + out + b"\xff\xd9"


def test_frames_of_other_writers(spark):
    """Grey and subsampled colour frames with AC coefficients and restart intervals, from an encoder of the test's own."""
    import struct

    import numpy as np

    from lemmata.llm import jpeg
    from lemmata.llm.media import _chunk, clips, read_avi

    y, x = np.mgrid[0:21, 0:35]
    grey = ((x * 5 + y * 3) % 200 + 20).astype(np.uint8)
    for every in (0, 4):
        got = jpeg.decode(_coded([grey], [(1, 1)], 1, every))
        assert got.shape == (21, 35, 1) and np.abs(got[..., 0].astype(int) - grey).max() <= 2
    smooth = [(60 + 2 * x + y).astype(np.uint8), np.full((21, 35), 90, np.uint8), np.full((21, 35), 170, np.uint8)]
    got = jpeg.decode(_coded(smooth, [(2, 2), (1, 1), (1, 1)], 2, 2))
    assert got.shape == (21, 35, 3) and max(np.abs(got[..., k].astype(int) - smooth[k]).max() for k in range(3)) <= 4
    assert jpeg.rgb(got).shape == (21, 35, 3)
    dark, light = (_coded([np.full((16, 16), v, np.uint8)], [(1, 1)], 4, 0) for v in (30, 220))
    frames = [dark] * 6 + [light] * 6
    movi, index, at = b"movi", b"", 4
    for f in frames:
        index += struct.pack("<4sIII", b"00dc", 0x10, at, len(f))
        movi, at = movi + _chunk(b"00dc", f), at + 8 + len(f) + (len(f) & 1)
    foreign = _chunk(b"RIFF", b"AVI " + _chunk(b"LIST", movi) + _chunk(b"idx1", index))
    files = [foreign, b"", b"RIFF", foreign[:200], foreign.replace(b"\xff\xc0", b"\xff\xc2"), None]
    df = spark.createDataFrame([(i, None, f) for i, f in enumerate(files)], "doc_id long, n_bytes long, media binary")
    rows = rows_by_id(read_avi(df))
    assert rows[0]["error"] is None and rows[0]["payload_bytes"] is None and "frames=12;shots=0,6;" in rows[0]["feature"]
    assert all(rows[i]["error"] and rows[i]["feature"] is None for i in (1, 2, 3, 4)) and rows[5]["error"] is None
    assert [(r["clip"], r["start_s"], r["n_frames"]) for r in clips(df).orderBy("clip").collect()] == [(0, 0.0, 6), (1, 0.24, 6)]


def test_packing_covers_each_id_once(docs):
    from tokenizers import Tokenizer

    from lemmata.llm.packing import pack

    path = public_tokenizers.path("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    rows = pack(docs, path, with_ids=True, length=256).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
        assert r["length"] == len(r["ids"])
        assert r["ids_crc32"] == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in r["ids"]))
    for i, t in enumerate(TEXTS):
        want = [*plain.encode(t or "", add_special_tokens=False).ids, 1]
        parts = sorted(by_doc[i], key=lambda r: r["start"])
        assert [x for p in parts for x in p["ids"]] == want
        assert all(p["doc_tokens"] == len(want) for p in parts)
    for parts in by_sequence.values():
        at = 0
        for p in sorted(parts, key=lambda r: r["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 256 and at & (at - 1) == 0


def test_hilbert_neighbours():
    import numpy as np

    from lemmata.llm.packing import hilbert

    grid = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    order = np.argsort(hilbert(grid, 3))
    assert sorted(hilbert(grid, 3).tolist()) == list(range(512))
    assert (np.abs(np.diff(grid[order], axis=0)).sum(1) == 1).all()


def test_empty_tables(spark):
    from lemmata.llm.byte_bpe import round_trip
    from lemmata.llm.lines import drop_repeated_chunks
    from lemmata.llm.media import read_avi, write_avi
    from lemmata.llm.packing import pack
    from lemmata.llm.quality import quality_rules
    from lemmata.llm.toxicity import fit, score

    none = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    from pyspark.sql import functions as F

    for df in (
        round_trip(none, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN),
        quality_rules(none),
        read_avi(write_avi(none)),
        pack(none, public_tokenizers.path("word_bpe_49k.json")),
        drop_repeated_chunks(none, measures=True),
        score(none, fit(none, labels, F.lit(True))),
    ):
        assert df.count() == 0


def test_toxicity_finds_passages(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from lemmata.llm.toxicity import fit, score, segments

    rng = np.random.default_rng(3)
    words = np.array([f"w{i}" for i in range(400)])
    rows = []
    for i in range(600):
        text = rng.choice(words, 80).tolist()
        if i % 6 == 0:
            text[30:30] = rng.choice(["awful", "nasty", "vile"], 4).tolist()
        rows.append((i, " ".join(text), int(i % 6 == 0)))
    rows += [(1000, None, 0), (1001, "", 0), (1002, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"), F.col("doc_id") % 4 != 2)
    got = rows_by_id(score(df.select("doc_id", "text"), model))
    assert len(got) == len(rows)
    for i, _, toxic in rows[:600]:
        assert (got[i]["score"] >= 0.3) == bool(toxic)
        if toxic:
            assert 20 <= got[i]["top_begin"] <= 31 and 32 <= got[i]["top_end"] <= 45
    assert got[1000]["score"] == got[1001]["score"] < 0.3
    scores = rng.normal(-0.3, 1, 200)
    top = max(segments(scores), key=lambda s: s[2])
    brute = max(((i, j, scores[i:j].sum()) for i in range(200) for j in range(i + 1, 201)), key=lambda s: s[2])
    assert top[:2] == brute[:2] and abs(top[2] - brute[2]) < 1e-9


def brute_segments(scores, at=0):
    """The maximal segments by their definition: the best one, and those of what lies on either side."""
    best = max(((sum(scores[i:j]), -i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=(0, 0, 0))
    if best[0] <= 0:
        return []
    i, j = -best[1], best[2]
    return brute_segments(scores[:i], at) + [(at + i, at + j, best[0])] + brute_segments(scores[j:], at + j)


def test_toxicity_segments_and_scores_equal_brute_force(spark):
    """All maximal segments, and scores recomputed word by word from the model, over ties, nulls, repeated rows and clashing names."""
    import math

    import numpy as np
    import pyarrow as pa
    from pyspark.sql import functions as F

    from lemmata.llm import toxicity

    rng = np.random.default_rng(8)
    for n in (0, 1, 7, 60):
        scores = rng.normal(-0.2, 1, n)
        got, want = toxicity.segments(scores), brute_segments(scores.tolist())
        assert [g[:2] for g in got] == [w[:2] for w in want] and all(abs(g[2] - w[2]) < 1e-9 for g, w in zip(got, want))
    vocab = [f"word{i}" for i in range(60)] + ["bad", "Worse", "worst", "ünfein"]
    texts = [" ".join(rng.choice(vocab, int(rng.integers(0, 60)))) for _ in range(300)]
    rows = [(i, t, int("bad" in t), 0.5, 1) for i, t in enumerate(texts)] + [(3, texts[3], 1, 0.1, 2), (None, texts[4], None, 0.1, 2), (900, None, None, None, None), (901, "bad " * 3000, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int, score double, n_segments int").repartition(3)
    model = toxicity.fit(df, df.filter("toxic is not null"), F.lit(True))
    got = sorted(((r["doc_id"], r["score"], r["n_segments"]) for r in toxicity.score(df, model).collect()), key=str)
    want = []
    for i, t, *_ in rows:
        weights = []
        for w in re.findall(r"[^\W_]+", (t or "").lower()):
            codes, _ = toxicity.tokens(pa.array([w]))
            weights.append(max(float(model.weights[c]) for c in codes[:, 0]))
        over = [model.scale * s - math.log(max(model.constant * len(weights), 1)) for *_, s in (brute_segments(weights) if len(weights) < 100 else [(0, len(weights), sum(weights))])]
        x = math.log1p(sum(o for o in over if o > 0))
        want.append((i, 1 / (1 + math.exp(-min(max(model.slope * x + model.offset, -30), 30))), sum(o > 0 for o in over)))
    want.sort(key=str)
    by = lambda rows_: sorted(((i, round(p, 5), n) for i, p, n in rows_), key=str)
    assert by(got) == by(want) and len({p for _, p, _ in want}) > 3


def test_line_chunks(spark):
    from lemmata.llm.lines import drop_repeated_chunks, repeated_chunks

    shared = "\n".join(f"shared passage line number {k} with some words" for k in range(12))
    rows = [(i, f"own line {i} a\nown line {i} b\n" + shared + f"\nlast own line {i}\nand one more {i}", "x") for i in range(20)]
    rows += [(90, None, "x"), (91, "", "x"), (92, "one", "x"), (93, "\n\n\n", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, body string").repartition(4)
    got = rows_by_id(drop_repeated_chunks(df, measures=True))
    assert got[0]["text"] == rows[0][1] and got[90]["text"] is None and got[93]["text"] == "\n\n\n"
    for i in range(1, 20):
        kept = got[i]["text"].split("\n")
        assert f"own line {i} a" in kept and f"and one more {i}" in kept
        assert got[i]["n_removed_lines"] >= 4 and len(kept) == len(rows[i][1].split("\n")) - got[i]["n_removed_lines"]
        left = iter(rows[i][1].split("\n"))
        assert all(k in left for k in kept)
    assert repeated_chunks(df.filter("doc_id = 3")).count() == 0


def brute_lines(rows):
    """Kept lines of each row: every run of lines with words at both ends, two of them and 40 bytes at least, against all earlier ones."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, hashlib.sha256((rows[i][1] or "").encode()).digest()))
    same = lambda i, k: rows[i] == rows[k]
    split = [re.findall(r"[^\n]*\n|[^\n]+", t or "") for _, t in rows]
    first, gone = {}, [set() for _ in rows]
    for i in order:
        k = split[i]
        solid = [j for j, line in enumerate(k) if line.strip()]
        for x, a in enumerate(solid):
            for b in solid[x + 1 :]:
                key = "".join(k[a : b + 1]).removesuffix("\n")
                if len(key.encode()) + 1 < 40:
                    continue
                f, _, to = first.setdefault(key, (i, a, b))
                if a > to if same(f, i) else True:
                    gone[i].update(range(a, b + 1))
    return ["".join(line for j, line in enumerate(k) if j not in g) for k, g in zip(split, gone)]


def test_line_passages_equal_brute_force(spark):
    """Passages of short and long lines, at all edges, within one text, under null ids and under one id with several texts."""
    import numpy as np

    from lemmata.llm.lines import drop_repeated_chunks

    rng = np.random.default_rng(3)
    line = lambda: "" if rng.random() < 0.2 else " ".join(f"w{k}" for k in rng.integers(0, 10_000, int(rng.integers(1, 12))))
    passages = [[line() for _ in range(int(rng.integers(2, 9)))] for _ in range(8)] + [["a", "b", "c"] * 12, ["same line again and again"] * 5]
    rows = []
    for i in range(60):
        parts = [passages[int(rng.integers(10))] if rng.random() < 0.4 else [line() for _ in range(3)] for _ in range(int(rng.integers(0, 6)))]
        rows.append((None if i % 6 == 0 else i // 2, "\n".join(x for p in parts for x in p) + "\n" * int(rng.integers(2))))
    rows += [(900, None), (None, None), (901, "\n\n\n"), rows[7]]
    got = drop_repeated_chunks(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), measures=True).collect()
    want = sorted(((d, None if t is None else k) for (d, t), k in zip(rows, brute_lines(rows))), key=str)
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == want
    assert sum(r["n_removed_lines"] for r in got) > 100


def test_line_passages_without_ids_and_of_one_id(spark):
    from lemmata.llm.lines import drop_repeated_chunks

    shared = "a passage of two lines that repeats\nin rows without an id and of one id\n"
    rows = [(1, shared + "own 1"), (None, "own 2\n" + shared), (5, "clean\n" * 2 + "text of id 5"), (5, shared + "end"), (None, "clean too")]
    got = drop_repeated_chunks(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=str) == sorted([rows[0], (None, "own 2\n"), rows[2], (5, "end"), rows[4]], key=str)
