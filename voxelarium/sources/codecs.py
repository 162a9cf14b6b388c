"""Chunk codecs: raw, zstd, LZ4, the blosc container; sniffing of a codec that is not available."""

from __future__ import annotations

import struct

import pyarrow as pa


def zstd(data: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompressobj().decompress(data)


def lz4(data: bytes, size: int) -> bytes:
    return pa.Codec("lz4_raw").decompress(data, size).to_pybytes()


def blosc(data: bytes) -> bytes:
    """A blosc 1 frame: a 16-byte header, block offsets, blocks of length-prefixed streams.

    Byte shuffle is undone for item sizes over one.  A stream whose length equals its block is stored.
    """
    if len(data) < 16:
        raise ValueError("a blosc frame has 16 bytes of header")
    flags, item = data[2], data[3]
    total, block, size = struct.unpack("<III", data[4:16])
    if size > len(data):
        raise ValueError("the blosc frame is cut short")
    if flags & 2:
        return bytes(data[16 : 16 + total])
    codec = flags >> 5
    n = -(-total // block) if block else 0
    out = bytearray()
    for i, off in enumerate(struct.unpack(f"<{n}I", data[16 : 16 + 4 * n])):
        want = min(block, total - i * block)
        split = item if not flags & 16 and item > 1 and want == block and block % item == 0 else 1
        part = bytearray()
        for _ in range(split):
            (m,) = struct.unpack("<i", data[off : off + 4])
            body = bytes(data[off + 4 : off + 4 + m])
            each = want // split
            part += body if m == each else zstd(body) if codec == 4 else lz4(body, each) if codec == 1 else _unknown(codec)
            off += 4 + m
        if flags & 1 and item > 1:
            k = len(part) // item
            part = bytearray(part[j * k + i] for i in range(k) for j in range(item))
        out += part
    return bytes(out)


def _unknown(codec: int):
    raise ValueError(f"blosc codec {codec} is not supported")


def blosc_frame(data: bytes, codec: str = "zstd", block: int = 1 << 16) -> bytes:
    """A blosc frame of single bytes, for writers and round trips."""
    import zstandard

    n = max(1, -(-len(data) // block))
    parts, off = [], 16 + 4 * n
    offsets = []
    for i in range(n):
        raw = data[i * block : (i + 1) * block]
        body = zstandard.compress(raw) if codec == "zstd" else pa.Codec("lz4_raw").compress(raw).to_pybytes()
        if len(body) >= len(raw):
            body = raw
        offsets.append(off)
        parts.append(struct.pack("<i", len(body)) + body)
        off += 4 + len(body)
    head = struct.pack("<BBBBIII", 2, 1, (4 if codec == "zstd" else 1) << 5, 1, len(data), block, off)
    return head + struct.pack(f"<{n}I", *offsets) + b"".join(parts)


def is_lossy(data: bytes) -> bool:
    """Whether a chunk begins like the lossy 256-voxel codec, which has no public decoder to build on."""
    return data[:4] == b"C3DC"


def decode(data: bytes, compressor: dict | None, size: int) -> bytes:
    """A chunk's bytes; compressor as in array metadata."""
    kind = (compressor or {}).get("id")
    if kind is None:
        return data
    if kind == "blosc":
        return blosc(data)
    if kind == "zstd":
        return zstd(data)
    if kind == "lz4":
        return lz4(data[4:], struct.unpack("<i", data[:4])[0])
    if kind == "c3d" or is_lossy(data):
        raise NotImplementedError("this lossy codec has no public decoder")
    raise ValueError(f"the compressor {kind} is not supported")
