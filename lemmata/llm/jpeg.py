"""Baseline JPEG frames: tables, restart intervals and sampling factors as the frame states them.

Huffman codes are read by a table of all 16-bit prefixes; coefficients of a whole frame are
dequantised and transformed back at once.  Progressive, arithmetic and 12-bit frames,
frames without their own tables, and damaged ones raise ``ValueError``.
"""

from __future__ import annotations

import re
import struct

import numpy as np

#: Most samples of a frame; a damaged header must not ask for more.
MOST_SAMPLES = 1 << 27


def _zigzag() -> np.ndarray:
    """The row-major place of each coefficient in the order of the anti-diagonals, which turn at the edges."""
    cells = [(r, c) for r in range(8) for c in range(8)]
    cells.sort(key=lambda p: (sum(p), p[0] if sum(p) % 2 else p[1]))
    return np.array([r * 8 + c for r, c in cells])


_PLACE = _zigzag()
_K = np.arange(8)
_BASIS = np.cos((2 * _K[None, :] + 1) * _K[:, None] * np.pi / 16) * np.where(_K == 0, np.sqrt(1 / 8), 0.5)[:, None]


def _prefixes(counts: bytes, symbols: bytes) -> list[int]:
    """For each 16-bit prefix the length of its code times 256 plus its symbol; 0 if there is none."""
    out, code, k = np.zeros(1 << 16, np.int64), 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            low = code << (16 - length)
            if low + (1 << (16 - length)) > 1 << 16:
                raise ValueError("a Huffman table with too many codes")
            out[low : low + (1 << (16 - length))] = length << 8 | symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out.tolist()


def _extended(value: int, size: int) -> int:
    return value if value >> (size - 1) else value - (1 << size) + 1


class _Bits:
    """Bits of one restart interval, with zeros behind its end."""

    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n = data, 0, 0, 0
        self.left = 8 * len(data)

    def peek(self) -> int:
        while self.n < 16:
            more = self.data[self.at : self.at + 6]
            self.held = (self.held << 48) | int.from_bytes(more.ljust(6, b"\0"), "big")
            self.at += 6
            self.n += 48
        return (self.held >> (self.n - 16)) & 0xFFFF

    def drop(self, k: int) -> None:
        self.n -= k
        self.left -= k
        self.held &= (1 << self.n) - 1
        if self.left < 0:
            raise ValueError("entropy-coded data ends early")

    def symbol(self, table: list[int]) -> int:
        found = table[self.peek()]
        if not found:
            raise ValueError("no such code")
        self.drop(found >> 8)
        return found & 255

    def number(self, size: int) -> int:
        if not size:
            return 0
        value = self.peek() >> (16 - size)
        self.drop(size)
        return _extended(value, size)


def _block(bits: _Bits, dc: list[int], ac: list[int], before: int, out: np.ndarray) -> int:
    """Reads one block into ``out`` (in zigzag order); gives its DC level."""
    size = bits.symbol(dc)
    if size > 11:
        raise ValueError("a DC difference of more than 11 bits")
    out[0] = level = before + bits.number(size)
    k = 1
    while k < 64:
        run, size = divmod(bits.symbol(ac), 16)
        if not size:
            if run != 15:
                break
            k += 16
            continue
        k += run
        if k > 63:
            raise ValueError("a block of more than 64 coefficients")
        out[k] = bits.number(size)
        k += 1
    return level


def decode(data: bytes) -> np.ndarray:
    """Samples (height, width, components) of a frame: grey, or Y, Cb and Cr."""
    try:
        return _decode(data)
    except (struct.error, IndexError, KeyError) as error:
        raise ValueError("a damaged JPEG frame") from error


def _decode(data: bytes) -> np.ndarray:
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG frame")
    quant: dict[int, np.ndarray] = {}
    huff: dict[int, list[int]] = {}
    parts: list[list] = []
    width = height = every = 0
    at, planes = 2, {}
    while True:
        if data[at] != 0xFF:
            raise ValueError("no marker")
        while data[at + 1] == 0xFF:
            at += 1
        mark = data[at + 1]
        at += 2
        if mark == 0xD9:
            break
        size = struct.unpack_from(">H", data, at)[0]
        body = data[at + 2 : at + size]
        at += size
        if mark == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.int64)
                body = body[65 + 64 * wide :]
        elif mark == 0xC4:
            while body:
                n = sum(body[1:17])
                huff[body[0]] = _prefixes(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif mark in (0xC0, 0xC1):
            precision, height, width, n = struct.unpack_from(">BHHB", body)
            if precision != 8 or not n or not height or not width or width * height * n > MOST_SAMPLES:
                raise ValueError("a frame of another precision or size")
            parts = [[body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]] for i in range(n)]
        elif mark in (0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
            raise ValueError("not a baseline frame")
        elif mark == 0xDD:
            every = struct.unpack(">H", body)[0]
        elif mark == 0xDA:
            end = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]", re.S).search(data, at)
            stop = end.start() if end else len(data)
            own = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
            planes |= _scan(data[at:stop], [p for p in parts if p[0] in own], own, parts, width, height, every, huff, quant)
            at = stop
            if not end:
                break
    if not parts or len(planes) < len(parts):
        raise ValueError("a frame without all of its components")
    return np.stack([planes[p[0]] for p in parts], 2)


def _scan(data: bytes, parts: list, tables: dict, all_parts: list, width: int, height: int, every: int, huff: dict, quant: dict) -> dict[int, np.ndarray]:
    """The planes of a scan's components, at full size."""
    hmax, vmax = max(p[1] for p in all_parts), max(p[2] for p in all_parts)
    across, down = -(-width // (8 * hmax)), -(-height // (8 * vmax))
    alone = len(parts) == 1
    grids, layout = {}, []
    for name, h, v, q in parts:
        wide, tall = across * h, down * v  # blocks, with those beyond the frame's edge
        grids[name] = np.zeros((tall * wide, 64), np.int32)
        if alone:  # only blocks that the frame needs, row by row
            used_w, used_h = -(-(-(-width * h // hmax)) // 8), -(-(-(-height * v // vmax)) // 8)
            layout.append((name, [[y * wide + x] for y in range(used_h) for x in range(used_w)]))
        else:
            layout.append((name, [[(my * v + y) * wide + mx * h + x for y in range(v) for x in range(h)] for my in range(down) for mx in range(across)]))
    units = len(layout[0][1])
    pieces = [p.replace(b"\xff\x00", b"\xff") for p in re.split(rb"\xff[\xd0-\xd7]", data)]
    step = every or units
    if len(pieces) < -(-units // step):
        raise ValueError("restart intervals are missing")
    for k, piece in zip(range(0, units, step), pieces):
        bits, level = _Bits(piece), dict.fromkeys(grids, 0)
        for unit in range(k, min(k + step, units)):
            for name, places in layout:
                t = tables[name]
                for place in places[unit]:
                    level[name] = _block(bits, huff[t >> 4], huff[16 | t & 15], level[name], grids[name][place])
    out = {}
    for name, h, v, q in parts:
        blocks = np.zeros((len(grids[name]), 64))
        blocks[:, _PLACE] = grids[name] * quant[q]
        pixels = np.einsum("ui,nuv,vj->nij", _BASIS, blocks.reshape(-1, 8, 8), _BASIS)
        plane = np.clip(np.rint(pixels + 128), 0, 255).astype(np.uint8).reshape(down * v, across * h, 8, 8).swapaxes(1, 2).reshape(down * v * 8, across * h * 8)
        out[name] = plane.repeat(vmax // v, 0).repeat(hmax // h, 1)[:height, :width]
    return out


def rgb(samples: np.ndarray) -> np.ndarray:
    """Red, green and blue of Y, Cb, Cr samples; grey ones three times."""
    y = samples[..., 0].astype(float)
    if samples.shape[2] < 3:
        return np.repeat(samples[..., :1], 3, 2)
    cb, cr = samples[..., 1] - 128.0, samples[..., 2] - 128.0
    out = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], 2)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)
