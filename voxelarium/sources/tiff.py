"""Minimal TIFF: uncompressed (or deflated) grey images, striped or tiled, several pages; and a tiled writer."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable

import numpy as np

_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 16: 8}
_CODES = {1: "B", 3: "H", 4: "I", 16: "Q"}


def _pages(data: bytes):
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if not order:
        raise ValueError("not a TIFF file")
    (magic,) = struct.unpack(order + "H", data[2:4])
    big = magic == 43
    off = struct.unpack(order + ("Q" if big else "I"), data[8:16] if big else data[4:8])[0]
    while off:
        n = struct.unpack(order + ("Q" if big else "H"), data[off : off + (8 if big else 2)])[0]
        off += 8 if big else 2
        tags = {}
        for _ in range(n):
            tag, kind = struct.unpack(order + "HH", data[off : off + 4])
            count = struct.unpack(order + ("Q" if big else "I"), data[off + 4 : off + (12 if big else 8)])[0]
            at = off + (12 if big else 8)
            size = _SIZES.get(kind, 1) * count
            if size > (8 if big else 4):
                at = struct.unpack(order + ("Q" if big else "I"), data[at : at + (8 if big else 4)])[0]
            raw = data[at : at + size]
            tags[tag] = list(struct.unpack(order + f"{count}{_CODES[kind]}", raw)) if kind in _CODES else raw
            off += 20 if big else 12
        yield order, tags
        off = struct.unpack(order + ("Q" if big else "I"), data[off : off + (8 if big else 4)])[0]


def read(data: bytes) -> list[np.ndarray]:
    """Every page of a file as an array [row, column]."""
    return [_image(data, order, tags) for order, tags in _pages(data)]


def _image(data: bytes, order: str, t: dict) -> np.ndarray:
    w, h = t[256][0], t[257][0]
    bits, form, packing = t.get(258, [1])[0], t.get(339, [1])[0], t.get(259, [1])[0]
    if t.get(277, [1])[0] != 1 or packing not in (1, 8, 32946):
        raise ValueError("only grey images, stored or deflated, are supported")
    kind = {(8, 1): "u1", (16, 1): "u2", (32, 3): "f4", (64, 3): "f8", (16, 2): "i2", (32, 2): "i4", (32, 1): "u4"}.get((bits, form))
    if not kind:
        raise ValueError(f"{bits} bits of format {form} are not supported")
    dtype = np.dtype(order + kind)
    unpack = (lambda b: b) if packing == 1 else zlib.decompress
    out = np.zeros((h, w), dtype)
    if 324 in t:
        tw, th = t[322][0], t[323][0]
        across = -(-w // tw)
        if len(t[324]) != across * -(-h // th):
            raise ValueError("tiles are missing")
        for k, (off, size) in enumerate(zip(t[324], t[325], strict=True)):
            y, x = k // across * th, k % across * tw
            tile = np.frombuffer(unpack(data[off : off + size]), dtype)[: tw * th].reshape(th, tw)
            out[y : y + th, x : x + tw] = tile[: h - y, : w - x]
        return out
    rows = min(t.get(278, [h])[0], h)
    for k, (off, size) in enumerate(zip(t[273], t[279], strict=True)):
        part = np.frombuffer(unpack(data[off : off + size]), dtype)
        y = k * rows
        out[y : y + rows] = part[: min(rows, h - y) * w].reshape(-1, w)
    return out


def write_tiled(width: int, height: int, tile: int, tiles: Iterable[tuple[int, int, bytes]], description: str = "", big: bool | None = None) -> bytes:
    """A tiled grey byte image.  Tiles (tile column, tile row, tile*tile bytes) may come in any order; all must come."""
    if tile % 16:
        raise ValueError("a tile's side is a multiple of 16")
    across, down = -(-width // tile), -(-height // tile)
    big = width * height >= 2 << 30 if big is None else big
    offsets, body, at = [0] * (across * down), [], 16 if big else 8
    for x, y, raw in tiles:
        if len(raw) != tile * tile:
            raise ValueError("a tile has tile * tile bytes")
        offsets[y * across + x] = at
        body.append(raw)
        at += len(raw)
    if 0 in offsets:
        raise ValueError(f"{offsets.count(0)} of {len(offsets)} tiles are missing")
    word, code = ("Q", 16) if big else ("I", 4)
    text = description.encode() + b"\0"
    entries = [(256, 4, [width]), (257, 4, [height]), (258, 3, [8]), (259, 3, [1]), (262, 3, [1]), (270, 2, text), (277, 3, [1]), (322, 4, [tile]), (323, 4, [tile]), (324, code, offsets), (325, code, [tile * tile] * len(offsets))]
    return _assemble(body, at, entries, big, word)


def _assemble(body: list[bytes], at: int, entries, big: bool, word: str) -> bytes:
    slot = 8 if big else 4
    ifd = at
    extra_at = ifd + (8 if big else 2) + len(entries) * (20 if big else 12) + slot
    head, extra = b"", b""
    for tag, kind, values in entries:
        raw = values if kind == 2 else struct.pack(f"<{len(values)}{_CODES[kind]}", *values)
        count = len(values)
        if len(raw) <= slot:
            value = raw.ljust(slot, b"\0")
        else:
            value = struct.pack("<" + word, extra_at + len(extra))
            extra += raw + b"\0" * (len(raw) % 2)
        head += struct.pack("<HH" + word, tag, kind, count) + value
    start = struct.pack("<2sHHHQ", b"II", 43, 8, 0, ifd) if big else struct.pack("<2sHI", b"II", 42, ifd)
    return start + b"".join(body) + struct.pack("<Q" if big else "<H", len(entries)) + head + struct.pack("<" + word, 0) + extra


def tiled_header(width: int, height: int, tile: int, description: str = "", big: bool | None = None) -> tuple[bytes, int]:
    """(header, place of the first tile) of a tiled grey byte image whose tiles follow in row order: directory and
    offsets come first, so that tiles can be written anywhere and in any order."""
    if tile % 16:
        raise ValueError("a tile's side is a multiple of 16")
    n = -(-width // tile) * -(-height // tile)
    big = width * height >= 2 << 30 if big is None else big
    word, code = ("Q", 16) if big else ("I", 4)

    def built(first: int) -> bytes:
        offsets = [first + k * tile * tile for k in range(n)]
        entries = [(256, 4, [width]), (257, 4, [height]), (258, 3, [8]), (259, 3, [1]), (262, 3, [1]), (270, 2, description.encode() + b"\0"), (277, 3, [1]), (322, 4, [tile]), (323, 4, [tile]), (324, code, offsets), (325, code, [tile * tile] * n)]
        return _assemble([], 16 if big else 8, entries, big, word)

    first = -(-len(built(0)) // 16) * 16  # its length doesn't depend on the offsets
    return built(first).ljust(first, b"\0"), first


def write(image: np.ndarray, description: str = "") -> bytes:
    """One grey image in a single strip: bytes, 16-bit, or 32-bit floats."""
    bits, form = {"u1": (8, 1), "u2": (16, 1), "f4": (32, 3)}[image.dtype.str[1:]]
    raw = np.ascontiguousarray(image.astype(image.dtype.newbyteorder("<"))).tobytes()
    h, w = image.shape
    entries = [(256, 4, [w]), (257, 4, [h]), (258, 3, [bits]), (259, 3, [1]), (262, 3, [1]), (270, 2, description.encode() + b"\0"), (273, 4, [8]), (277, 3, [1]), (278, 4, [h]), (279, 4, [len(raw)]), (339, 3, [form])]
    return _assemble([raw], 8 + len(raw), entries, False, "I")
