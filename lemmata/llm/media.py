"""Media columns: motion-JPEG in AVI, with shot detection.

``write_avi`` stores the bytes of each text losslessly: one byte is the grey
level of one 8x8 block, so only DC coefficients (quantised by 8) are needed and
a decoder returns the level exactly.  The DC Huffman table gives category s a
code of 9 - s bits, so each block takes 9 bits and one end-of-block bit, and
frames decode without a bit-serial loop.  ``read_avi`` walks the RIFF chunks and
``idx1``, decodes the intra frames, and finds shots where the histogram
difference of neighbouring frames exceeds an adaptive threshold.

Frames of other writers (``jpeg``: baseline, grey or colour) are decoded bit by bit, and
shots are found in their luma samples; files that hold no payload of this writer have
no payload columns, and damaged ones only an ``error``.

Null text counts as empty; a payload has 64 bytes at least.  Equal texts give
equal files, repeated rows a file each, an empty table none; other columns are not read.  A very long text is
coded and decoded ``RUN`` frames at a time.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lemmata.llm import arrays, jpeg

#: Samples (blocks) of a full frame, frames a second, histogram bins.
FRAME_SAMPLES, FPS, BINS = 1024, 25, 16
#: Frames coded or decoded at once.
RUN = 2048
#: A shot begins where a difference exceeds the local mean by so many deviations, and this at least.
WINDOW, DEVIATIONS, LEAST = 8, 3.0, 0.08


def _dc_codes() -> np.ndarray:
    """10 bits (DC difference, end of block) for each difference from -255 to 255."""
    out = np.zeros(511, np.uint64)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        prefix = ((1 << (8 - s)) - 1) << 1
        extra = d if d > 0 else d + (1 << s) - 1
        out[d + 255] = ((prefix << s) | (extra if s else 0)) << 1
    return out


_CODES = _dc_codes()
_DIFFS = np.zeros(1024, np.int16)
_DIFFS[_CODES.astype(np.int64)] = np.arange(-255, 256)
_VALID = np.zeros(1024, bool)
_VALID[_CODES.astype(np.int64)] = True


@lru_cache(512)
def _head(width: int, height: int) -> bytes:
    """JPEG markers up to the entropy-coded data, for a grey frame in pixels."""
    quant = b"\xff\xdb" + struct.pack(">HB", 67, 0) + bytes([8]) + bytes([1]) * 63
    frame = b"\xff\xc0" + struct.pack(">HBHHBBBB", 11, 8, height, width, 1, 1, 0x11, 0)
    dc = b"\xff\xc4" + struct.pack(">HB", 19 + 9, 0x00) + bytes([1] * 9 + [0] * 7) + bytes(range(8, -1, -1))
    ac = b"\xff\xc4" + struct.pack(">HB", 19 + 1, 0x10) + bytes([1] + [0] * 15) + b"\x00"
    scan = b"\xff\xda" + struct.pack(">HBBBBBB", 8, 1, 1, 0x00, 0, 63, 0)
    return b"\xff\xd8" + quant + frame + dc + ac + scan


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def payload(text: bytes) -> bytes:
    """The text with bytes 0 up to a positive multiple of 64."""
    return text + bytes(max(64, -(-len(text) // 64) * 64) - len(text))


def avi(body: bytes) -> bytes:
    """The AVI file that holds a payload (a positive multiple of 64 bytes)."""
    samples = min(FRAME_SAMPLES, len(body))
    frames = -(-len(body) // samples)
    width = 8 * 8
    height = samples // 8 * 8
    size, head = samples * 10 // 8, _head(width, height)
    movi, index, at = [b"movi"], [], 4
    for start in range(0, frames, RUN):
        part = body[start * samples : (start + RUN) * samples]
        grid = np.zeros((min(RUN, frames - start), samples), np.int16)
        grid.reshape(-1)[: len(part)] = np.frombuffer(part, np.uint8)
        bits = _CODES[np.diff(grid, axis=1, prepend=np.int16(128)) + 255].reshape(-1, 4)
        five = (bits[:, 0] << np.uint64(30)) | (bits[:, 1] << np.uint64(20)) | (bits[:, 2] << np.uint64(10)) | bits[:, 3]
        coded = (five << np.uint64(24)).astype(">u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()
        for i in range(len(grid)):
            frame = head + coded[i * size : (i + 1) * size].replace(b"\xff", b"\xff\x00") + b"\xff\xd9"
            movi.append(c := _chunk(b"00dc", frame))
            index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(frame)))
            at += len(c)
    main = struct.pack("<14I", 1_000_000 // FPS, 0, 0, 0x10, frames, 0, 1, 0, width, height, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIIIhhhh", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, frames, 0, 0xFFFFFFFF, 0, 0, 0, width, height)
    form = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 8, b"MJPG", width * height, 0, 0, 0, 0)
    header = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", form)) + _chunk(b"plen", struct.pack("<Q", len(body))))
    return _chunk(b"RIFF", b"AVI " + header + _chunk(b"LIST", b"".join(movi)) + _chunk(b"idx1", b"".join(index)))


def _chunks(data: bytes, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    while start + 8 <= end:
        name, size = data[start : start + 4], struct.unpack_from("<I", data, start + 4)[0]
        yield name, start + 8, start + 8 + size
        start += 8 + size + (size & 1)


@lru_cache(512)
def _own_samples(head: bytes) -> int | None:
    """Samples of a frame whose header is this writer's; None for another one."""
    if (at := head.find(b"\xff\xc0")) < 0 or len(head) < at + 9:
        return None
    height, width = struct.unpack_from(">HH", head, at + 5)
    return width * height // 64 if head == _head(width, height) else None


def _own_frames(coded: list[bytes], samples: int) -> np.ndarray:
    five = np.zeros((sum(map(len, coded)) // 5, 8), np.uint8)
    five[:, 3:] = np.frombuffer(b"".join(coded), np.uint8).reshape(-1, 5)
    word = five.view(">u8").astype(np.uint64).reshape(-1)
    codes = (np.stack([word >> np.uint64(30), word >> np.uint64(20), word >> np.uint64(10), word], 1) & np.uint64(1023)).astype(np.int64)
    if not _VALID[codes].all():
        raise ValueError("invalid entropy-coded data")
    return (np.cumsum(_DIFFS[codes].reshape(-1, samples), axis=1) + 128).astype(np.uint8)


def stored_frames(data: bytes) -> list[bytes]:
    """The JPEG frames of an AVI file, by its index."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    movi, index = None, b""
    for name, a, b in _chunks(data, 12, len(data)):
        if name == b"LIST" and data[a : a + 4] == b"movi":
            movi = a
        elif name == b"idx1":
            index = data[a:b]
    if movi is None or not index or len(index) % 16:
        raise ValueError("no frames or no index")
    entries = [(at, size) for name, _, at, size in struct.iter_unpack("<4sIII", index) if name[2:] in (b"dc", b"db")]
    if not entries:
        raise ValueError("no frames")
    # offsets count from the list's name, or from the file's start
    base = movi if data[movi + entries[0][0] + 2 : movi + entries[0][0] + 4] in (b"dc", b"db") else 0
    return [data[base + at + 8 : base + at + 8 + size] for at, size in entries]


def frames_of(data: bytes) -> np.ndarray:
    """The decoded samples of an AVI file, a row per frame: the payload's bytes, or the luma of another writer's frames."""
    frames = stored_frames(data)
    scan = frames[0].find(b"\xff\xda") + 10
    samples = _own_samples(frames[0][:scan]) if scan > 9 else None
    if samples and all(f[:scan] == frames[0][:scan] for f in frames):
        out = []
        for i in range(0, len(frames), RUN):
            coded = [f[scan:-2].replace(b"\xff\x00", b"\xff") for f in frames[i : i + RUN]]
            if any(len(c) != samples * 10 // 8 for c in coded):
                raise ValueError("a frame of another length")
            out.append(_own_frames(coded, samples))
        return np.concatenate(out)
    decoded = [jpeg.decode(f)[..., 0] for f in frames]
    if any(d.shape != decoded[0].shape for d in decoded):
        raise ValueError("frames of different sizes")
    return np.stack([d.reshape(-1) for d in decoded])


def payload_length(data: bytes) -> int | None:
    """The length of the payload that this writer stored; None in other files."""
    for name, a, b in _chunks(data, 12, len(data)):
        if name == b"LIST" and data[a : a + 4] == b"hdrl":
            for inner, c, _ in _chunks(data, a + 4, b):
                if inner == b"plen":
                    return struct.unpack_from("<Q", data, c)[0]
    return None


def shots(frames: np.ndarray) -> tuple[list[int], np.ndarray]:
    """First frames of the shots, and the histogram of all frames."""
    n = len(frames)
    keys = (frames.astype(np.int64) * BINS >> 8) + np.arange(n)[:, None] * BINS
    hist = np.bincount(keys.reshape(-1), minlength=n * BINS).reshape(n, BINS)
    if n < 2:
        return [0], hist.sum(0)
    diff = np.abs(np.diff(hist, axis=0)).sum(1) / (2 * frames.shape[1])
    c1, c2 = np.concatenate([[0], np.cumsum(diff)]), np.concatenate([[0], np.cumsum(diff * diff)])
    lo, hi = np.maximum(np.arange(n - 1) - WINDOW, 0), np.minimum(np.arange(n - 1) + WINDOW + 1, n - 1)
    k = hi - lo
    mean = (c1[hi] - c1[lo]) / k
    limit = mean + DEVIATIONS * np.sqrt(np.maximum((c2[hi] - c2[lo]) / k - mean * mean, 0))
    return [0, *(np.flatnonzero((diff > np.maximum(limit, LEAST))) + 1).tolist()], hist.sum(0)


def write_avi(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text as an AVI file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in arrays.slices(batch, text_col):
                data, off = arrays.raw(arrays.text_of(part, text_col))
                data = data.tobytes()
                files = [avi(payload(data[a:b])) for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
                yield pa.RecordBatch.from_arrays([arrays.column(part, id_col), pa.array(np.diff(off)), pa.array(files, pa.binary())], names=[id_col, "n_bytes", "media"])

    kind = dict(df.dtypes)[id_col]
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, media binary")


def _read(m: bytes) -> tuple:
    """Digests, features, clips and error of a file."""
    try:
        frames, length = frames_of(m), payload_length(m)
    except (ValueError, struct.error) as error:
        return (None, None, None, len(m), hashlib.sha256(m).hexdigest(), None, None, str(error))
    body = frames.tobytes()[:length] if length is not None else None
    starts, hist = shots(frames)
    feature = f"frames={len(frames)};shots={','.join(map(str, starts))};hist={','.join(map(str, hist.tolist()))}"
    known = (len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-64:])) if body is not None else (None,) * 3
    return (*known, len(m), hashlib.sha256(m).hexdigest(), feature, _timed(starts, len(frames)), None)


def _timed(starts: list[int], frames: int) -> list[dict]:
    return [{"clip": k, "start_s": a / FPS, "end_s": b / FPS, "n_frames": b - a} for k, (a, b) in enumerate(zip(starts, [*starts[1:], frames]))]


def read_avi(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Digests of the payload read back, features of the decoded frames, their timed clips, and what is wrong with a file; null media gives nulls."""
    clip = pa.list_(pa.struct([("clip", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("n_frames", pa.int32())]))
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), clip, pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in arrays.slices(batch, "media", 8 << 20):
                cols = list(zip(*(_read(m) if m is not None else (None,) * 8 for m in arrays.column(part, "media").to_pylist())))
                yield pa.RecordBatch.from_arrays([arrays.column(part, id_col), arrays.column(part, "n_bytes"), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=names)

    names = [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "clips", "error"]
    kind = dict(df.dtypes)[id_col]
    return df.select(id_col, "n_bytes", "media").mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, clips array<struct<clip: int, start_s: double, end_s: double, n_frames: int>>, error string")


def clips(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Timed clip rows: one per shot of each media file (of n_bytes and media, as ``write_avi`` gives them)."""
    return read_avi(df, id_col).select(id_col, F.explode("clips").alias("c")).select(id_col, "c.*")
