"""NumPy kernels over Arrow string batches: UTF-8 bytes, words, hashes, minimizers.

Everything works on a *slab*: the concatenated UTF-8 bytes of a run of rows plus the row offsets.  Rows are
grouped into slabs of bounded size, so memory follows the slab (or one very long row), never the partition.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text handled at once.
SLAB = 1 << 21


def splitmix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer, elementwise on uint64."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _byte_class(ranges) -> np.ndarray:
    """Boolean table of the bytes outside the given inclusive ranges."""
    out = np.ones(256, bool)
    for a, b in ranges:
        out[a : b + 1] = False
    return out


#: Words that end at ASCII white space, and words of letters, digits and non-ASCII characters.
SPACED = _byte_class([(0x20, 0x20), (0x09, 0x0D)])
ALNUM = _byte_class([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_SEEDS = [0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93]
_BASES = [0x9E3779B97F4A7C15 | 1, 0xD6E8FEB86659FD93 | 1]
_POWERS: list[tuple[np.ndarray, np.ndarray]] = [(np.ones(1, U64), np.ones(1, U64))] * 2


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i mod 2**64 for i < n (kept between calls)."""
    have = _POWERS[which]
    if len(have[0]) < n:
        size = max(n, SLAB + 4096)
        both = []
        for b in (_BASES[which], pow(_BASES[which], -1, 1 << 64)):
            x = np.full(size, b, U64)
            x[0] = 1
            both.append(np.multiply.accumulate(x))
        have = _POWERS[which] = (both[0], both[1])
    return have[0][:n], have[1][:n]


def _octets(data: np.ndarray) -> np.ndarray:
    """A view of the eight bytes from each place on, zero past the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.lib.stride_tricks.as_strided(padded, (len(data) + 1, 8), (1, 1))


def octets(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number, zero past the end."""
    padded = np.zeros(len(data) + 15, np.uint8)
    padded[: len(data)] = data
    out = np.empty(-(-len(data) // 8) * 8, U64)
    for k in range(8):
        out[k::8] = padded[k : k + len(out)].view(U64)
    return out[: len(data)]


#: Values handled at once where arrays pass through several steps: what fits the processor's cache.
STEP = 1 << 15


def _mixed(x: np.ndarray, spare: np.ndarray) -> np.ndarray:
    """The splitmix64 finalizer in place."""
    spare = spare[: len(x)]
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        np.right_shift(x, U64(shift), out=spare)
        x ^= spare
        x *= U64(factor)
    np.right_shift(x, U64(31), out=spare)
    x ^= spare
    return x


class Prefix:
    """Prefix sums of a byte array: the hash of any span of eight bytes or more in constant time.

    A polynomial modulo 2**64 over bytes has colliding strings whatever its base (Thue-Morse words).  The terms here are
    mixed values of eight bytes each, which overlap, so strings of that kind do not cancel.
    """

    def __init__(self, data: np.ndarray, which: int = 0):
        p, self.inverse = powers(which, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, U64)
        padded = np.zeros(len(data) + STEP + 16, np.uint8)
        padded[: len(data)] = data
        value, spare = np.empty(STEP, U64), np.empty(STEP, U64)
        for i in range(0, len(data), STEP):
            n = min(STEP, len(data) - i)
            for k in range(8):
                value[k::8] = padded[i + k : i + k + STEP].view(U64)
            x = value[:n]
            x += U64(_SEEDS[which])
            _mixed(x, spare)
            x *= p[i : i + n]
            x[:1] += self.sums[i : i + 1]
            np.cumsum(x, out=self.sums[i + 1 : i + n + 1])

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of data[start:end], eight bytes at least; the length takes part."""
        return splitmix((self.sums[end - 7] - self.sums[start]) * self.inverse[start] + (end - start).astype(U64) * U64(0xA24BAED4963EE407))

    def grams(self, k: int) -> np.ndarray:
        """span(i, i + k) of every place."""
        out = np.empty(max(0, len(self.sums) - k), U64)
        size, spare = U64(k * 0xA24BAED4963EE407 % 2**64), np.empty(STEP, U64)
        for i in range(0, len(out), STEP):
            x = out[i : i + STEP]
            np.subtract(self.sums[i + k - 7 : i + k - 7 + len(x)], self.sums[i : i + len(x)], out=x)
            x *= self.inverse[i : i + len(x)]
            x += size
            _mixed(x, spare)
        return out


_KEEP = np.array([(1 << 8 * i) - 1 for i in range(9)], U64)
#: Longer words are hashed one by one.
LONG_WORD = 64


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """Hash of each word data[start:end]: eight bytes a round, or BLAKE2 for long ones."""
    size = end - start
    h = splitmix(size.astype(U64) + U64(_SEEDS[which]))
    octets = _octets(data)
    live = np.flatnonzero(size <= LONG_WORD)
    at = 0
    while len(live):
        block = octets[start[live] + at].view(U64).ravel() & _KEEP[np.minimum(size[live] - at, 8)]
        x = h[live] ^ block
        h[live] = splitmix(x * U64(0x9FB21C651E98DF25) + U64(0x2545F4914F6CDD1D))
        at += 8
        live = live[size[live] > at]
    for i in np.flatnonzero(size > LONG_WORD):
        h[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8, salt=bytes([which])).digest(), "little")
    return h


def slabs(column, limit: int = SLAB) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, past last row, bytes, offsets) of runs of rows; null is empty text.

    column: an Arrow string or binary array.  A row longer than the limit forms a slab of its own.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = column.cast(pa.large_binary() if pa.types.is_large_binary(column.type) or pa.types.is_binary(column.type) else pa.large_string())
    if wide.null_count:
        wide = wide.fill_null(b"" if pa.types.is_large_binary(wide.type) else "")
    n = len(wide)
    offsets = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + n + 1] if n else np.zeros(1, np.int64)
    raw = wide.buffers()[2] if n else None
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray = SPACED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, word offsets of each row) of the maximal runs of bytes in the table, within rows."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = table[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = offsets[:-1]
    first[cut] = inside[cut]
    start = np.flatnonzero(first)
    last = inside[:-1] & ~inside[1:]
    cut = offsets[1:]
    cut = cut[cut > 0] - 1
    last[cut] = inside[cut]
    return start, np.flatnonzero(last) + 1, np.searchsorted(start, offsets)


def grams(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of k consecutive values (they may cross rows: mask with gram_rows)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    x = np.full(n, 0x2545F4914F6CDD1D + seed, U64)
    for j in range(k):
        x *= U64(0x9FB21C651E98DF25)
        x += h[j : j + n]
        x ^= x >> U64(29)
    return splitmix(x)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The concatenated ranges start .. start+count."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) + np.repeat(starts - (ends - counts), counts)


def window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w values (two running minima per block of w)."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    m = -(-len(x) // w) * w
    padded = np.full(m, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


PLACE_BITS = 24


def minimizers(h: np.ndarray, w: int) -> np.ndarray:
    """For each run of w hashes the place of its smallest one, the leftmost among equals.

    Hashes are compared by their upper 40 bits; which gram is chosen depends on the run's content alone.
    The array is handled in overlapping pieces.
    """
    n = len(h) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low, out = U64((1 << PLACE_BITS) - 1), np.empty(n, np.int64)
    for i in range(0, n, 2 * STEP):
        x = h[i : i + 2 * STEP + w - 1]
        m = len(x) - w + 1
        out[i : i + m] = (window_min((x & ~low) | np.arange(len(x), dtype=U64), w) & low).astype(np.int64) + i
    return out


def marked(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of n places lie in one of the given ranges."""
    d = np.zeros(n + 1, np.int32)
    np.add.at(d, start, 1)
    np.add.at(d, end, -1)
    return np.cumsum(d[:-1]) > 0


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
