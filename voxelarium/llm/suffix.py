"""Operator 5: remove byte strings that occur elsewhere, by difference-cover suffix arrays.

Ordering every suffix of the corpus would shuffle each byte many times over.  Suffixes that can agree on a whole window
share its anchor (see anchors.py), so the distribution is by anchor: pieces that occur twice as a whole are settled by
their name, and the suffixes of the pieces that share an anchor but not all their context are sorted together.  Each
task sorts the suffixes it holds with the difference-cover algorithm: the triples at places not divisible by three are
sorted and named, the names are sorted recursively, the remaining suffixes follow from the sampled ranks, the two
sequences are merged, and neighbours that agree on a whole window mark it.

Defined results: null text is empty; rows equal in every column are occurrences of each other; a text shorter than the
window loses nothing; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelarium.llm import textcore as tc
from voxelarium.llm.anchors import Order, frequent, pieces
from voxelarium.llm.base import cut, keyed, no_key, ship

WINDOW, GRAM = 400, 240
#: Bytes of text whose suffixes are sorted together (whole anchor groups).
SORTED_BYTES = 1 << 20


# ---- difference-cover suffix array ----------------------------------------------------------------------------------
def _names(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(sorting order, rank from 1 with ties equal) of rows given by non-negative integer columns."""
    key = parts[0].astype(np.int64)
    for p in parts[1:]:
        width = int(p.max(initial=0)) + 1
        if int(key.max(initial=0)) >= (1 << 62) // width:
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
        key = key * width + p
    order = np.argsort(key)
    ks = key[order]
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(np.concatenate(([1], (ks[1:] != ks[:-1]).astype(np.int64)))) if len(key) else 0
    return order, rank


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array of positive integers, with the difference cover {1, 2} modulo 3."""
    n = len(s)
    if n < 4:
        return np.array(sorted(range(n), key=lambda i: s[i:].tolist()), np.int64)
    t = np.concatenate((s.astype(np.int64), np.zeros(4, np.int64)))
    one = np.arange(1, n + (n % 3 == 1), 3)  # a place past the end keeps the two classes apart
    two = np.arange(2, n, 3)
    sampled = np.concatenate((one, two))
    order, name = _names([t[sampled], t[sampled + 1], t[sampled + 2]])
    if int(name.max()) < len(sampled):
        # the names of class 1, then those of class 2; the last name of class 1 covers the end of the string
        order = suffix_array(name)
    rank12 = np.empty(len(sampled), np.int64)
    rank12[order] = np.arange(1, len(sampled) + 1)
    rank = np.zeros(n + 5, np.int64)
    rank[sampled] = rank12
    zero = np.arange(0, n, 3)
    o0, _ = _names([t[zero], rank[zero + 1]])
    zero = zero[o0]
    s12 = sampled[order]
    s12 = s12[s12 < n]
    # place of every remaining suffix among the sampled ones, class by class
    big = n + 6
    c1, c2 = s12[s12 % 3 == 1], s12[s12 % 3 == 2]
    less1 = np.searchsorted(t[c1] * big + rank[c1 + 1], t[zero] * big + rank[zero + 1])
    head0, head2 = t[zero] * (int(t.max()) + 1) + t[zero + 1], t[c2] * (int(t.max()) + 1) + t[c2 + 1]
    if int(t.max()) + 1 > 2**20:
        both = np.unique(np.concatenate((head0, head2)), return_inverse=True)[1]
        head0, head2 = both[: len(head0)], both[len(head0) :]
    less2 = np.searchsorted(head2 * big + rank[c2 + 2], head0 * big + rank[zero + 2])
    out = np.empty(n, np.int64)
    at0 = less1 + less2 + np.arange(len(zero))
    out[at0] = zero
    rest = np.ones(n, bool)
    rest[at0] = False
    out[rest] = s12
    return out


def repeated_starts(data: np.ndarray, offsets: np.ndarray, window: int) -> np.ndarray:
    """Starts (in the concatenation) of windows within rows that occur at least twice, by one suffix array.

    Rows end in a separator; neighbours in suffix order that agree on a window mark both.
    """
    rows = len(offsets) - 1
    size = np.diff(offsets)
    s = np.full(len(data) + rows, 1, np.int64)
    body = tc.ranges(offsets[:-1] + np.arange(rows), size)
    s[body] = data.astype(np.int64) + 2
    sa = suffix_array(s)
    row_end = np.repeat(offsets[1:] + np.arange(rows), size + 1)
    whole = sa[sa + window <= row_end[sa]]
    if len(whole) < 2:
        return np.zeros(0, np.int64)
    # equal neighbours: compare the windows themselves, eight bytes at a time
    raw = np.zeros(len(s), np.uint8)
    raw[body] = data
    eight = tc.octets(raw)
    live = np.arange(len(whole) - 1)
    for i in [*range(0, window - 7, 8), window - 8]:
        live = live[eight[whole[live] + i] == eight[whole[live + 1] + i]]
    same = np.zeros(len(whole) - 1, bool)
    same[live] = True
    hit = np.zeros(len(whole), bool)
    hit[:-1] |= same
    hit[1:] |= same
    starts = whole[hit]
    return np.sort(starts - np.repeat(np.arange(rows), size + 1)[starts])


# ---- stages ---------------------------------------------------------------------------------------------------------
def _batch(names, arrays):
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in arrays], list(names))


def _piece_map(window: int, k: int, common: np.ndarray):
    """Pieces of each batch.  Those that recur within the batch are settled there (kind 1), but for one that stands
    for all m of them (kind 0): a hot piece reaches the shuffle by anchor once per batch."""
    def run(batches):
        order = Order(common)
        for b in batches:
            k1, k2 = (np.asarray(b.column(i)) for i in (0, 1))
            parts = []
            for i, j, d, off in tc.slabs(b.column(2)):
                if len(d) < window:
                    continue
                p = tc.Prefix(d)
                g = p.grams(k)
                row_of = np.repeat(np.arange(j - i), np.diff(off))
                at, a, n, row = pieces(g, row_of, off[1:], order, window, k)
                whole = tc.Prefix(d, 1).span(a, a + n - 1 + window) ^ tc.splitmix((at - a).astype(np.uint64) + np.uint64(11))
                parts.append((tc.signed(g[at]), tc.signed(whole), k1[i + row], k2[i + row], (a - off[row]).astype(np.int64), n.astype(np.int32)))
            if not parts:
                continue
            h, s, r1, r2, a, n = (np.concatenate(c) for c in zip(*parts, strict=True))
            o = np.lexsort((s, h))
            new = np.concatenate(([True], (h[o][1:] != h[o][:-1]) | (s[o][1:] != s[o][:-1])))
            kind, m = np.ones(len(h), np.int32), np.zeros(len(h), np.int32)
            kind[o[new]] = 0
            m[o[new]] = np.diff(np.append(np.flatnonzero(new), len(o)))
            yield _batch(PIECE_NAMES, (kind, h * (1 - kind), s * (1 - kind), r1, r2, a, n, m))
    return run


PIECE = "kind int, h long, s long, k1 long, k2 long, a long, n int, m int"
PIECE_NAMES = ("kind", "h", "s", "k1", "k2", "a", "n", "m")


def by_anchor(mapped: DataFrame) -> DataFrame:
    """Pieces to be settled go to their anchor's partition and are sorted by it, settled ones go anywhere."""
    return mapped.repartition(F.when(F.col("kind") == 0, F.col("h")).otherwise(F.xxhash64("k2", "a"))).sortWithinPartitions("h")


#: Rows of whole groups that a task holds at once.
HELD_ROWS = 1 << 18


class Groups:
    """Whole groups of a partition sorted by a key, some at a time, so that a task holds no more than it needs."""

    def __init__(self, key: str, enough: int = HELD_ROWS, measure=lambda b: b.num_rows):
        self.key, self.enough, self.measure = key, enough, measure
        self.held, self.size, self.limit = [], 0, enough

    def push(self, batch: pa.RecordBatch):
        if not batch.num_rows:
            return
        self.held.append(batch)
        self.size += self.measure(batch)
        if self.size < self.limit:
            return
        t = pa.Table.from_batches(self.held).combine_chunks()
        key = np.asarray(t.column(self.key).combine_chunks())
        end = int(np.searchsorted(key, key[-1]))  # the last group may go on
        self.held = t.slice(end).to_batches()
        self.size = sum(map(self.measure, self.held))
        self.limit = max(self.enough, 2 * self.size)
        if end:
            yield t.slice(0, end)

    def flush(self):
        if self.held:
            yield pa.Table.from_batches(self.held).combine_chunks()
        self.held = []


def columns(table: pa.Table) -> dict[str, np.ndarray]:
    return {c: np.asarray(table.column(c).combine_chunks()) for c in table.column_names}


SETTLED = ("kind", "h", "k1", "k2", "a", "n")


def _settle(batches):
    """A partition of pieces sorted by anchor.  kind 1: every start recurs; kind 2: to be compared by content."""
    groups = Groups("h")
    for b in batches:
        kind = np.asarray(b.column("kind"))
        if kind.any():
            yield b.filter(pa.array(kind == 1)).select(list(SETTLED))
        for t in groups.push(b.filter(pa.array(kind == 0))):
            yield from _settle_groups(columns(t))
    for t in groups.flush():
        yield from _settle_groups(columns(t))


def _settle_groups(x: dict[str, np.ndarray]):
    order = np.lexsort((x["s"], x["h"]))
    h, s = x["h"][order], x["s"][order]
    newh = np.concatenate(([True], h[1:] != h[:-1]))
    news = newh | np.concatenate(([True], s[1:] != s[:-1]))
    cls, grp = np.cumsum(news) - 1, np.cumsum(newh) - 1
    size = np.bincount(cls, weights=x["m"][order])
    classes = np.bincount(grp[news])
    # one of each class, where an anchor has several
    for kind, o in ((1, order[size[cls] > 1]), (2, order[(classes[grp] > 1) & news])):
        for i in range(0, len(o), 50_000):
            q = o[i : i + 50_000]
            yield _batch(SETTLED, (np.full(len(q), kind, np.int32), *(x[c][q] for c in SETTLED[1:])))


def _cut_out(window: int):
    """Bytes of the pieces asked for."""
    def run(batches):
        for b in batches:
            asked = b.column(3).to_pylist()
            texts = b.column(2).cast(pa.binary())
            out = {c: [] for c in ("h", "k1", "k2", "a", "n", "t")}
            for r, ask in enumerate(asked):
                raw = texts[r].as_py() or b""
                for q in ask:
                    for c, v in zip(out, (q["h"], b.column(0)[r].as_py(), b.column(1)[r].as_py(), q["a"], q["n"], raw[q["a"] : q["a"] + q["n"] - 1 + window]), strict=True):
                        out[c].append(v)
            if out["h"]:
                yield pa.RecordBatch.from_pydict(out, pa.schema([("h", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("a", pa.int64()), ("n", pa.int32()), ("t", pa.binary())]))
    return run


def _sort_suffixes(window: int):
    """Suffix arrays over whole anchor groups of a partition sorted by anchor, some SORTED_BYTES at a time."""
    def one(t: pa.Table):
        size = np.asarray(pc.binary_length(t.column("t"))).astype(np.int64)
        raw = np.frombuffer(b"".join(t.column("t").to_pylist()), np.uint8)
        off = np.concatenate(([0], np.cumsum(size)))
        starts = repeated_starts(raw, off, window)
        if len(starts):
            row = np.searchsorted(off, starts, "right") - 1
            new = np.concatenate(([True], (starts[1:] != starts[:-1] + 1) | (row[1:] != row[:-1])))
            f = np.flatnonzero(new)
            n = np.diff(np.append(f, len(starts)))
            r = row[f]
            k1, k2, a = (np.asarray(t.column(c).combine_chunks()) for c in ("k1", "k2", "a"))
            yield _batch(("k1", "k2", "a", "n"), (k1[r], k2[r], a[r] + starts[f] - off[r], n.astype(np.int32)))

    def run(batches):
        groups = Groups("h", SORTED_BYTES, lambda b: b.nbytes)
        for b in batches:
            for t in groups.push(b):
                yield from one(t)
        for t in groups.flush():
            yield from one(t)

    return run


HIT = "k1 long, k2 long, a long, n int"


def repeated_ranges(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(k1, k2, hits): for each row with any, the runs (a, n) of starts of windows that also start anywhere else."""
    spark = docs.sparkSession
    ship(spark)
    base = keyed(docs, "text")

    def byte_grams(d):
        return tc.Prefix(d).grams(gram)

    common = frequent(docs, byte_grams)
    settled = cut(by_anchor(base.mapInArrow(_piece_map(window, gram, common), PIECE)).mapInArrow(_settle, "kind int, h long, k1 long, k2 long, a long, n int"), "pieces", free=True)
    asked = settled.where("kind = 2").groupBy("k1", "k2").agg(F.collect_list(F.struct("h", "a", "n")).alias("ask"))
    # the texts are shuffled by row key once: the join below and the one that removes spans share the exchange
    # a row equal to another in id and text asks once: the pieces of one of them speak for both
    texts = base.join(asked, ["k1", "k2"]).select("k1", "k2", "text", "ask").dropDuplicates(["k1", "k2"])
    found = texts.mapInArrow(_cut_out(window), "h long, k1 long, k2 long, a long, n int, t binary").repartition("h").sortWithinPartitions("h").mapInArrow(_sort_suffixes(window), HIT)
    hits = settled.where("kind = 1").select("k1", "k2", "a", "n").unionByName(found)
    return hits.groupBy("k1", "k2").agg(F.collect_list(F.struct("a", "n")).alias("hits"))


def _remove(window: int):
    def run(batches):
        for b in batches:
            texts = b.column("text").cast(pa.binary())
            out = {c: [] for c in ("k1", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")}
            k1 = b.column("k1").to_pylist()
            for r, hits in enumerate(b.column("hits").to_pylist()):
                raw = texts[r].as_py() or b""
                spans, kept, last = [], hashlib.sha256(), 0
                for q in sorted((q["a"], q["a"] + q["n"] - 1 + window) for q in hits or ()):
                    if spans and q[0] <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], q[1])
                    else:
                        spans.append([*q])
                for a, e in spans:
                    kept.update(raw[last:a])
                    last = e
                kept.update(raw[last:])
                for c, v in zip(out, (k1[r], len(raw), sum(e - a for a, e in spans), len(spans), kept.hexdigest(), [{"start": a, "end": e} for a, e in spans]), strict=True):
                    out[c].append(v)
            yield pa.RecordBatch.from_pydict(out, pa.schema([("k1", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]))
    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per input row: sizes, removed spans and the hash of what is left."""
    hits = repeated_ranges(docs, window, gram)
    joined = keyed(docs, "text").join(hits, ["k1", "k2"], "left")
    out = joined.mapInArrow(_remove(window), "k1 long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, end: long>>")
    return out.select(no_key(), "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans")


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")


SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, h, len(h) // 2 AS n FROM d),
g AS (SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 800)) AS k FROM (SELECT doc_id, h, unnest(range(n - 399)) AS i FROM b WHERE n >= 400)),
r AS (SELECT k FROM g GROUP BY k HAVING count(*) > 1),
s AS (SELECT g.doc_id, g.i FROM g SEMI JOIN r ON r.k = g.k),
j AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400 THEN 0 ELSE 1 END AS new FROM s),
c AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM j),
x AS (SELECT doc_id, run, min(i) AS a, max(i) + 400 AS e FROM c GROUP BY doc_id, run),
y AS (SELECT doc_id, a, e, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM x),
z AS (SELECT y.doc_id, sum(e - a) AS gone, count(*) AS spans, string_agg(substr(b.h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS front, max(e) AS last FROM y JOIN b ON b.doc_id = y.doc_id GROUP BY y.doc_id)
SELECT b.doc_id, CAST(b.n AS BIGINT) AS n_bytes, CAST(coalesce(z.gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(z.spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(z.front, '') || substr(b.h, 2 * coalesce(z.last, 0) + 1))) AS kept_sha256
FROM b LEFT JOIN z ON z.doc_id = b.doc_id
"""
