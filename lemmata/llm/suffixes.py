"""Suffix-array dedup: bytes covered by a string that starts in an earlier document.

Equal strings of ``length`` bytes select the same anchor: the k-gram of least
hash among their k-grams.  So a document's anchors that no other document holds
(``sharing``) cannot lie in a repeated string, and only the surroundings
of shared anchors are compared.

The surroundings, in which each string of ``length`` bytes around the anchor lies, are
aligned at it.  Each batch of documents is a shard, which sends its surroundings; no transform
is built per shard (README gives the figures).  A bucket's task refines the interleave of all shards'
entries: starting from their concatenation, each round takes one more symbol by a stable
partition (a sort of one column of bytes) of the current interleave and refines the block boundaries, so that
after h rounds blocks hold the entries with h common symbols.  This is done
from the anchor's end leftwards, and mirrored rightwards; a string's repeated interval
is the pair of its left and right block, and its smallest document decides.

A shard sends equal surroundings once.  For anchors that more than ``HOT``
documents hold, each string is sent by its own hash rather than by the anchor,
so their strings spread over all buckets.  Texts equal to one of a smaller id
(of at least ``length`` bytes) are covered throughout and are not compared at all; they are
told by id and digest, as rows of one id (or none) may differ in text.

Surroundings are written once, in the shuffle that deals them to buckets.  Where they lie goes through that
same shuffle, beside the buckets, to meet the masks; texts are not sent again, as the last step reads
the batches of the first.  Each step takes a batch's rows in the order of their ids and texts, so a batch
made anew (after a lost executor, say) numbers them alike.

Null text counts as empty.  Documents of equal id do not cover each other, and a
null id counts as larger than any other; ids are integers (other types raise
``TypeError``), of which 2^63 - 1 stands for null.  Rows equal in id and text get equal results, an
empty table gives no rows, and a very long text is one batch of its own.  Other columns keep their values, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from lemmata.llm import arrays, sharing
from lemmata.llm.storage import fresh

#: Bytes of a repeated string and of an anchor; documents beyond which an anchor is hot; text bytes of a slice.
LENGTH, GRAM, HOT, SLICE = 50, 32, 20_000, 512 << 10
#: Stands for what lies beyond a document; no UTF-8 text holds it.
BEYOND = 0xFF
_LAST_ID = np.iinfo(np.int64).max
_MUL = np.uint64(0xB492B66FBE98F273)


def _gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k-gram, by doubling."""
    with np.errstate(over="ignore"):
        have, width, power, level, step = None, 0, None, arrays._BYTE_CODES[data], _MUL
        size = 1
        while True:
            if k & size:
                if have is None:
                    have, width = level, size
                else:
                    n = len(data) - width - size + 1
                    have, width = have[:n] * step + level[width : width + n], width + size
            size <<= 1
            if size > k:
                return arrays.mix(have)
            n = len(data) - size + 1
            level = level[:n] * step + level[size // 2 : size // 2 + n]
            step = step * step


def _sliding(values: np.ndarray, w: int, f) -> np.ndarray:
    """f over each window of w values."""
    size, level = 1, values
    while size * 2 <= w:
        level = f(level[: len(level) - size], level[size:])
        size *= 2
    if size < w:
        level = f(level[: len(values) - w + 1], level[w - size : w - size + len(values) - w + 1])
    return level


def anchors(data: np.ndarray, off: np.ndarray, length: int = LENGTH, k: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the k-grams that have the least hash in some string of ``length`` bytes of their row.

    Least hashes are small ones, so they are mixed once more: else the first of the buckets by top bits would get most of them.
    """
    if len(data) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    w = length - k + 1
    h = _gram_hashes(data, k)
    m = len(h) - w + 1
    least = _sliding(h, w, np.minimum)
    start = np.zeros(m + 1, np.int32)  # strings that stay inside a row
    ok = np.diff(off) >= length
    np.add.at(start, off[:-1][ok], 1)
    np.add.at(start, np.minimum(off[1:][ok] - length + 1, m), -1)
    least = np.where(np.cumsum(start[:-1]) > 0, least, np.uint64(0))
    wide = np.concatenate([np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)])
    chosen = np.flatnonzero((_sliding(wide, w, np.maximum) == h) & (h > 0))
    return chosen, arrays.mix(h[chosen])


def refine(columns: np.ndarray, skip: int = 0) -> list[np.ndarray]:
    """Blocks by interleave refinement, without those of the first ``skip`` rounds.

    ``columns[h]`` holds the symbol that round h prepends, per entry in shard
    order.  Gives after each round the block number of each entry; entries share
    a block if all their symbols so far agree.
    """
    n = columns.shape[1]
    interleave = np.arange(n, dtype=np.int32)
    block = np.zeros(n, np.int32)
    out = []
    for h, symbols in enumerate(columns):
        placed = symbols[interleave]
        move = np.argsort(placed, kind="stable")
        placed, interleave, was = placed[move], interleave[move], block[move]
        edge = np.ones(n, bool)
        edge[1:] = (placed[1:] != placed[:-1]) | (was[1:] != was[:-1])
        block = np.cumsum(edge, dtype=np.int32) - 1
        if h >= skip:
            of_entry = np.empty(n, np.int32)
            of_entry[interleave] = block
            out.append(of_entry)
    return out


def covered_windows(around: np.ndarray, docs: np.ndarray, length: int = LENGTH, k: int = GRAM) -> np.ndarray:
    """Bit o of each entry: the string at offset o of its surroundings also starts in a smaller document.

    ``around`` has ``length - k`` bytes on both sides of an anchor of k bytes.
    """
    side = length - k
    left = refine(np.ascontiguousarray(around[:, side + k - 1 :: -1].T), k - 1)  # [j]: j bytes left of the anchor
    mirrored = np.ascontiguousarray(around[:, side + k :].T)
    right = [np.zeros(len(docs), np.int32), *refine(mirrored)]
    mask = np.zeros(len(docs), np.uint32)
    for o in range(side + 1):
        inside = (around[:, o] != BEYOND) & (around[:, o + length - 1] != BEYOND)
        pair = left[side - o].astype(np.int64) << 32 | right[o]
        order = np.argsort(pair, kind="stable")
        ranked = pair[order]
        first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        least = np.minimum.reduceat(docs[order], first)
        smaller = np.empty(len(docs), bool)
        smaller[order] = np.repeat(least, np.diff(np.append(first, len(docs)))) < docs[order]
        mask |= np.where(smaller & inside, np.uint32(1) << np.uint32(o), np.uint32(0))
    return mask


def _windows_inside(around: np.ndarray, length: int, k: int) -> np.ndarray:
    """Bit o: the string at offset o lies inside the document."""
    mask = np.zeros(len(around), np.uint32)
    for o in range(length - k + 1):
        mask |= np.where((around[:, o] != BEYOND) & (around[:, o + length - 1] != BEYOND), np.uint32(1) << np.uint32(o), np.uint32(0))
    return mask


def _cover(n: int, positions: np.ndarray, masks: np.ndarray, length: int, k: int) -> np.ndarray:
    """Which of n bytes lie in a covered string; positions are those of anchors."""
    mark = np.zeros(n + 1, np.int32)
    for o in range(length - k + 1):
        begin = positions[(masks >> np.uint32(o)) & np.uint32(1) == 1] - (length - k) + o
        np.add.at(mark, begin, 1)
        np.add.at(mark, begin + length, -1)
    return np.cumsum(mark[:-1]) > 0


def repeated_bytes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, k: int = GRAM, hot: int = HOT, digests: bool = True) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, gone, origin) of every row.

    ``gone`` has a bit per byte, set if it is removed, and is null for rows that lose none or all; ``origin`` is the digest of a text that loses bytes.
    Without ``digests``, kept_sha256 is null unless nothing or all is kept.
    """
    if not isinstance(df.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} must be an integer column, as smaller ids keep what larger ones lose")
    side = length - k
    rows, docs, buckets = sharing.batched(df.select(F.col(id_col).cast("long").alias(id_col), text_col), id_col, text_col)
    body = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    sums = rows.select("doc", "batch", F.octet_length("text").alias("n"), F.sha2(body, 256).alias("sha")).filter(F.col("n") >= length)
    lowest = sums.groupBy("sha").agg(F.min(F.coalesce("doc", F.lit(_LAST_ID))).alias("first"), F.count("*").alias("copies")).filter("copies > 1").select("sha", "first")
    copies = sums.join(lowest, "sha").filter(F.coalesce("doc", F.lit(_LAST_ID)) > F.col("first")).groupBy("batch").agg(F.collect_set(F.struct(F.coalesce("doc", F.lit(_LAST_ID)).alias("doc"), F.unhex("sha").alias("sha"))).alias("copies"))

    def keys_of(table: pa.Table) -> np.ndarray:
        out = []
        for p in sharing.parts(table, SLICE):
            data, off = arrays.raw(arrays.text_of(p, "text"))
            at, h = anchors(data, off, length, k)
            rows = arrays.row_of(at, off)
            order = np.lexsort((h, rows))
            h, rows = h[order], rows[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])
            out.append(h[new])
        return np.concatenate(out or [np.zeros(0, np.uint64)])

    hot_class = int(sharing.share_class(np.array([hot]))[0])

    def entries(table: pa.Table, answers: pa.Table) -> pa.Table:
        """A batch's surroundings by bucket (kind 0), and where they lie, with a bit per row that is a copy (kind 1)."""
        if not table.num_rows:
            return _rows([])
        table = _in_order(table)
        batch = table.column("batch")[0].as_py()
        whole = {(d["doc"], d["sha"]) for c in answers.column("copies").to_pylist() if c for d in c}
        kept = answers.filter(pa.array([c is not None for c in answers.column("classes").to_pylist()], pa.bool_()))
        got = []
        keys = []
        slices = list(sharing.parts(table, SLICE))
        ids = np.concatenate([arrays.column(p, "doc").fill_null(_LAST_ID).to_numpy() for p in slices])
        row0 = 0
        for p in slices:
            data, off = arrays.raw(arrays.text_of(p, "text"))
            at, h = anchors(data, off, length, k)
            rows = arrays.row_of(at, off)
            got.append((data, off, at, rows, row0))
            keys.append(h)
            row0 += len(off) - 1
        classes = sharing.class_of(np.concatenate(keys), kept, buckets)
        is_copy = np.isin(ids, np.array([d for d, _ in whole], np.int64))
        for data, off, _, _, r0 in got:  # other rows of that id may hold other texts
            for i in np.flatnonzero(is_copy[r0 : r0 + len(off) - 1]).tolist():
                is_copy[r0 + i] = (int(ids[r0 + i]), hashlib.sha256(data[off[i] : off[i + 1]]).digest()) in whole
        around, owner, place, label, hotness = [], [], [], [], []
        c0 = 0
        for (data, off, at, rows, r0), h in zip(got, keys):
            cls = classes[c0 : c0 + len(h)]
            c0 += len(h)
            use = np.flatnonzero((cls > 0) & ~is_copy[rows + r0])
            at, rows = at[use], rows[use]
            span = at[:, None] + np.arange(-side, k + side)
            outside = (span < off[rows][:, None]) | (span >= off[rows + 1][:, None])
            text = data[np.clip(span, 0, max(len(data) - 1, 0))] if len(data) else np.zeros((0, k + 2 * side), np.uint8)
            text[outside] = BEYOND
            around.append(text)
            owner.append(rows + r0)
            place.append(at - off[rows])
            label.append(h[use])
            hotness.append(cls[use] >= hot_class)
        around, owner, place = np.concatenate(around), np.concatenate(owner), np.concatenate(place).astype(np.int32)
        label, hotness = np.concatenate(label), np.concatenate(hotness)
        if hotness.any():  # a string of its own per offset, sent by its own hash
            index = np.flatnonzero(hotness)
            inside = _windows_inside(around[index], length, k)
            more, more_of = [], []
            for o in range(side + 1):
                own = index[(inside >> np.uint32(o)) & np.uint32(1) == 1]
                one = np.full((len(own), around.shape[1]), BEYOND, np.uint8)
                one[:, o : o + length] = around[own, o : o + length]
                more.append(one)
                more_of.append(own)
            single = np.concatenate(more)
            of = np.concatenate(more_of)
            edges = np.arange(len(single)) * single.shape[1]
            flat = np.ascontiguousarray(single).reshape(-1)
            cold = np.flatnonzero(~hotness)
            around = np.concatenate([around[cold], single])
            label = np.concatenate([label[cold], arrays.hash_spans(flat, edges, edges + single.shape[1])])
            owner, place = np.concatenate([owner[cold], owner[of]]), np.concatenate([place[cold], place[of]])
        # equal surroundings once, with their smallest document
        width = around.shape[1]
        flat = np.ascontiguousarray(around).reshape(-1)
        edges = np.arange(len(around)) * width
        same = arrays.hash_spans(flat, edges, edges + width)
        bucket = (label >> np.uint64(64 - (buckets.bit_length() - 1))).astype(np.int64)  # at most a row per entry, however many buckets
        doc = ids[owner]
        order = np.lexsort((doc, same, bucket))
        new = np.ones(len(order), bool)
        if len(order):
            o1, o0 = order[1:], order[:-1]
            new[1:] = (bucket[o1] != bucket[o0]) | (same[o1] != same[o0]) | (around[o1] != around[o0]).any(1)
        head = order[new]
        entry = np.cumsum(new) - 1  # of each place in order
        out = []
        used, where = np.unique(bucket[head], return_index=True)
        for b, i, j in zip(used.tolist(), where.tolist(), np.append(where[1:], len(head)).tolist()):
            h = head[i:j]
            out.append((0, batch, b, sharing.squeeze(around[h].tobytes(), 3), sharing.squeeze(doc[h].tobytes())))
        first = doc[order] == doc[head][entry] if len(order) else np.zeros(0, bool)
        # the first document's strings are decided by the merge, those of later ones are all covered
        whole_mask = np.where(first, np.uint32(0), _windows_inside(around, length, k)[order]).astype("<u4").view("<i4")
        owner, place = owner[order], place[order]
        lie = np.lexsort((place, owner))
        places = sharing.put_planes(np.diff(owner[lie], prepend=0), np.diff(place[lie], prepend=0), entry[lie], first[lie], whole_mask[lie])
        out.append((1, batch, batch, places, np.packbits(is_copy).tobytes()))
        return _rows(out)

    answers = sharing.shared_classes(docs, keys_of, buckets).withColumn("copies", F.lit(None).cast("array<struct<doc: bigint, sha: binary>>"))
    answers = answers.unionByName(copies.select("batch", F.lit(None).cast("int").alias("bucket"), F.lit(None).cast("binary").alias("classes"), "copies"))
    sent = docs.groupBy("batch").cogroup(answers.groupBy("batch")).applyInArrow(sharing.lean(entries), _SCHEMA)

    def merge(group: pa.Table) -> pa.Table:
        """Masks of a bucket's entries, per batch in the batch's order; places pass as they are."""
        if group.column("kind")[0].as_py():
            return group
        batches = group.column("batch").to_pylist()
        blocks = [np.frombuffer(sharing.expand(b), np.uint8).reshape(-1, k + 2 * side) for b in group.column("body").to_pylist()]
        docs_ = np.concatenate([np.frombuffer(sharing.expand(d), np.int64) for d in group.column("docs").to_pylist()])
        mask = covered_windows(np.concatenate(blocks), docs_, length, k)
        ends = np.cumsum([len(b) for b in blocks])
        out = [sharing.squeeze(mask[e - len(b) : e].tobytes()) for b, e in zip(blocks, ends)]
        return _rows([(0, b, r, m, None) for b, r, m in zip(batches, group.column("row").to_pylist(), out)])

    answered = sent.groupBy("kind", "row").applyInArrow(sharing.lean(merge), _SCHEMA)

    def apply(table: pa.Table, sides: pa.Table) -> pa.Table:
        """A batch's rows, by the masks of its entries and by where they lie."""
        out = []
        if table.num_rows:
            table = _in_order(table)
            texts = [sharing.expand(t) if t is not None else b"" for t in table.column("packed").to_pylist()]
            ids = table.column("doc").fill_null(_LAST_ID).to_pylist()
            kinds, rows, bodies = (sides.column(c).to_pylist() for c in ("kind", "row", "body"))
            masks = sorted((r, i) for i, (kd, r) in enumerate(zip(kinds, rows)) if kd == 0)
            mask = np.concatenate([np.frombuffer(sharing.expand(bodies[i]), np.uint32) for _, i in masks] or [np.zeros(0, np.uint32)])
            lies = kinds.index(1)
            is_copy = np.unpackbits(np.frombuffer(sides.column("docs")[lies].as_py(), np.uint8), count=len(ids)).astype(bool).tolist()
            owner, place, entry, first, whole = sharing.get_planes(bodies[lies], 5)
            owner, place = np.cumsum(owner), np.cumsum(place)
            own = np.where(first == 0, whole.view("<u4"), mask[entry])
            ends = np.searchsorted(owner, np.arange(len(ids) + 1)).tolist()
            for i, (doc, text) in enumerate(zip(ids, texts)):
                n, sha = len(text), hashlib.sha256(text).hexdigest()
                if is_copy[i]:
                    out.append((doc, n, n, 1, hashlib.sha256(b"").hexdigest(), None, sha))
                    continue
                a, b = ends[i], ends[i + 1]
                gone = _cover(n, place[a:b], own[a:b], length, k) if b > a else np.zeros(0, bool)
                if not gone.any():
                    out.append((doc, n, 0, 0, sha, None, None))
                    continue
                spans = int((gone & ~np.concatenate([[False], gone[:-1]])).sum())
                kept = hashlib.sha256(np.frombuffer(text, np.uint8)[~gone].tobytes()).hexdigest() if digests else None
                out.append((doc, n, int(gone.sum()), spans, kept, np.packbits(gone).tobytes(), sha))
        return pa.table([pa.array(c, kd) for c, kd in zip(zip(*out) if out else [()] * 7, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string()))], names=["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "gone", "origin"])

    out = docs.groupBy("batch").cogroup(answered.groupBy("batch")).applyInArrow(sharing.lean(apply), "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, gone binary, origin string")
    return out.select(F.when(F.col("doc") != _LAST_ID, F.col("doc")).alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256", "gone", "origin")


def drop_repeated_bytes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with repeated bytes taken out of their texts; a character that loses a byte goes as a whole, and a null text stays null."""
    doc, sha, gone, hit, digest = fresh(df, "doc", "sha", "gone", "hit", "digest")
    edits = repeated_bytes(df, id_col, text_col, digests=False).filter("n_removed > 0")
    edits = edits.select(F.col(id_col).alias(doc), F.col("origin").alias(sha), F.col("gone").alias(gone)).dropDuplicates([doc, sha]).withColumn(hit, F.lit(True))
    rows = df.withColumn(digest, F.sha2(F.encode(F.col(text_col), "UTF-8"), 256))
    joined = rows.join(edits, F.col(id_col).cast("long").eqNullSafe(F.col(doc)) & (F.col(digest) == F.col(sha)), "left")
    own = df.columns

    def run(batches):
        for batch in batches:
            text = arrays.column(batch, text_col)
            lost = arrays.column(batch, hit).fill_null(False).to_numpy(zero_copy_only=False)
            if lost.any():
                values, bits = text.to_pylist(), arrays.column(batch, gone)
                for i in np.flatnonzero(lost).tolist():
                    values[i] = without(values[i], bits[i].as_py())
                text = pa.array(values, text.type)
            yield pa.RecordBatch.from_arrays([text if c == text_col else arrays.column(batch, c) for c in own], names=own)
            arrays.trim()

    return joined.select(*own, hit, gone).mapInArrow(run, df.schema)


def without(text: str, gone: bytes | None) -> str:
    """A text without the characters that lose a byte; without all if ``gone`` is None."""
    if gone is None:
        return ""
    data = np.frombuffer(text.encode(), np.uint8)
    lost = np.unpackbits(np.frombuffer(gone, np.uint8), count=len(data)).astype(bool)
    char = np.cumsum((data & 0xC0) != 0x80) - 1
    drop = np.zeros(char[-1] + 1, bool)
    drop[char[lost]] = True
    return data[~drop[char]].tobytes().decode()


_SCHEMA = "kind int, batch int, row int, body binary, docs binary"
_KINDS = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]


def _rows(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(c, kd) for c, kd in zip(zip(*rows) if rows else [()] * 5, _KINDS)], names=[x.split()[0] for x in _SCHEMA.split(", ")])


def _in_order(table: pa.Table) -> pa.Table:
    """A batch's rows by id and text, as a shuffle gives them in any order; rows equal in both may change places."""
    return table.sort_by([("doc", "ascending"), ("packed", "ascending")])
