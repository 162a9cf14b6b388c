"""NumPy twins of the folds and the dense-chunk kernels, for Arrow batches."""

from __future__ import annotations

import numpy as np

from voxelarium.model import Compositing


def unit(x: np.ndarray, c: Compositing) -> np.ndarray:
    return np.clip((x / 255.0 - c.low) / (c.high - c.low), 0.0, 1.0)


def composite_alpha(samples: np.ndarray, c: Compositing) -> np.ndarray:
    """Rows of samples to one value each: all rays step by step, those that are opaque frozen."""
    v, a = np.zeros(len(samples)), np.zeros(len(samples))
    for k in range(samples.shape[1]):
        q = unit(samples[:, k], c)
        live = (q > 0) & (a < c.stop)
        w = np.where(live, (1.0 - a) * np.minimum(q * c.strength, 1.0), 0.0)
        v += w * q
        a += w
    return np.clip(v * 255.0, 0, 255).astype(np.int32)


def composite_max(samples: np.ndarray) -> np.ndarray:
    return samples.max(1).astype(np.int32)


def trilinear_q8_partial(block: np.ndarray, origin, pos: np.ndarray) -> np.ndarray:
    """For each position the weighted sum of those of its eight corners that lie in a dense block [z, y, x].

    Sums over the blocks that hold the other corners add up to the sample times 2**24.
    """
    base = np.floor(pos).astype(np.int64)
    frac = ((pos - base) * 256).astype(np.int64)
    size = np.array(block.shape[::-1])
    total = np.zeros(len(pos), np.int64)
    base = base - np.asarray(origin)
    near = np.flatnonzero(((base >= -1) & (base < size)).all(1))
    b, f = base[near], frac[near]
    # a border of zeros stands for what other blocks hold
    padded = np.zeros(size[::-1] + 2, np.int64)
    padded[1:-1, 1:-1, 1:-1] = block
    flat, sy, sz = padded.ravel(), padded.shape[2], padded.shape[1] * padded.shape[2]
    at = (b[:, 2] + 1) * sz + (b[:, 1] + 1) * sy + b[:, 0] + 1
    gx, gy, gz = (256 - f).T
    fx, fy, fz = f.T
    row = lambda o: flat[at + o] * gx + flat[at + o + 1] * fx
    plane = lambda o: row(o) * gy + row(o + sy) * fy
    total[near] = plane(0) * gz + plane(sz) * fz
    return total


def halve(block: np.ndarray) -> np.ndarray:
    """2x2x2 integer means of a dense block with even sides."""
    z, y, x = block.shape
    return (block.reshape(z // 2, 2, y // 2, 2, x // 2, 2).astype(np.uint32).sum((1, 3, 5)) // 8).astype(np.uint8)


def upsample_axis(origin: int, scale: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lower index, upper index, weight of the upper in 256ths) of `size` target places, clamped at the edges."""
    t = np.arange(size, dtype=np.int64)
    q = origin * 256 + ((2 * t + 1) * 128) // scale - 128
    raw = q >> 8
    low = np.clip(raw, 0, size - 1)
    return low, np.minimum(low + 1, size - 1), np.where((q < 0) | (raw >= size - 1), 0, q - (low << 8))


def upsample(parent: np.ndarray, child: tuple[int, int, int], shift: int) -> np.ndarray:
    """The part of a parent block that a child chunk covers, interpolated to full size; child is (x, y, z)."""
    n = parent.shape[0]
    mask = (1 << shift) - 1
    ax = [upsample_axis((c & mask) * (n >> shift), 1 << shift, n) for c in child]
    p = parent.astype(np.int64)

    def along(axis: int, a, block):
        low, high, w = a
        shape = [1, 1, 1]
        shape[axis] = n
        w = w.reshape(shape)
        return (block.take(low, axis) * (256 - w) + block.take(high, axis) * w) >> 8

    return along(0, ax[2], along(1, ax[1], along(2, ax[0], p))).astype(np.uint8)


def voxel_hash(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
    """A deterministic pseudo-random byte per voxel: 64-bit FNV steps over the coordinates, one middle byte kept."""
    h = np.full(np.broadcast(x, y, z).shape, 0xCBF29CE484222325, np.uint64)
    for c in (x, y, z):
        h = (h ^ np.asarray(c).astype(np.uint64)) * np.uint64(0x100000001B3)
        h = h ^ (h >> np.uint64(15))
    return ((h >> np.uint64(24)) & np.uint64(255)).astype(np.uint8)
