"""Anchored windows: exact search for windows of W symbols that start in more than one place.

Every window contains grams of K symbols; the smallest under a fixed order is its anchor.  The choice depends on the
window's content alone, so equal windows have equal anchors at equal offsets, and only windows whose anchor recurs can
recur.  Windows of consecutive starts that share one anchor form a *piece*; a piece is named by the hash of its anchor
and the hash of all it spans.  Pieces are 2/(W-K+2) as many as symbols, so the shuffle carries pieces, not windows.

Grams that are frequent in a bounded sample of rows come last in the order.  This moves work only: any fixed order
finds the same windows.  With it, windows across the edge of a common passage take an anchor outside it, and the pieces
inside have few different contexts, which bounds the group of an anchor.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelarium.llm import textcore as tc

U64 = np.uint64
#: Rows of the sample that frequent grams come from, and in how many of them a gram counts as frequent.
SAMPLE_ROWS, SAMPLE_TIMES = 1024, 6


class Order:
    """The frequent grams, sorted, behind a table of their low bits."""

    def __init__(self, grams: np.ndarray):
        self.grams = grams
        self.bits = np.zeros(1 << 16, bool)
        self.bits[(grams & U64(0xFFFF)).astype(np.int64)] = True

    def keys(self, g: np.ndarray) -> np.ndarray:
        out = g >> U64(1)
        if len(self.grams):
            hit = np.flatnonzero(self.bits[(g & U64(0xFFFF)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.grams, g[hit]), len(self.grams) - 1)
            out[hit[self.grams[at] == g[hit]]] |= U64(1 << 63)
        return out


def frequent(docs: DataFrame, grams_of_row) -> np.ndarray:
    """Grams that recur in a sample: SAMPLE_ROWS rows of smallest hashed id.  Bounded, and a matter of speed only."""
    sample = docs.where(F.col("text").isNotNull()).select("text", F.xxhash64("doc_id").alias("_o")).orderBy("_o", "text").limit(SAMPLE_ROWS).select("text")
    def per_batch(batches):
        import pyarrow as pa
        for b in batches:
            for i, j, d, off in tc.slabs(b.column(0)):
                for r in range(j - i):
                    g = np.unique(grams_of_row(d[off[r] : off[r + 1]]))
                    yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64))], ["g"])
    top = sample.mapInArrow(per_batch, "g long").groupBy("g").count().where(F.col("count") >= SAMPLE_TIMES)
    rows = top.orderBy(F.desc("count"), "g").limit(1 << 15).select("g").collect()
    return np.sort(np.array([r.g for r in rows], np.int64).view(U64)) if rows else np.zeros(0, U64)


def pieces(g: np.ndarray, row_of: np.ndarray, row_end: np.ndarray, order: Order, window: int, k: int):
    """(anchor place, first start, number of starts, row) of each piece of a slab.

    g: gram hashes of the slab; row_of: row of each symbol; row_end: past-last symbol of each row.
    """
    place = tc.minimizers(order.keys(g), window - k + 1)
    row = row_of[: len(place)]
    starts = np.flatnonzero(np.arange(len(place)) + window <= row_end[row]) if len(place) else np.zeros(0, np.int64)
    at = place[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (at[1:] != at[:-1]) | (row[starts[1:]] != row[starts[:-1]])
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(starts)))
    return at[first], starts[first], n, row[starts[first]]
