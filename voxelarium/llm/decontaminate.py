"""Operator 10: benchmark decontamination with training suffix arrays.

Each slab of documents (a shard's working set) is turned into a suffix array over its words by prefix doubling; every
test suffix is binary-searched in it.  Neighbouring hits on one diagonal join into the longest verbatim matches, whose
places give the words hit; the words of a match are compared as they are spelled.  Documents never leave their partition: there is no shuffle.

The benchmark is read in blocks of about BLOCK_BYTES of text (by hash of item_id).  A single block, the common case, is
broadcast and applied in one pass.  A larger benchmark means more passes, one block broadcast in each: a pass writes
the hits it finds, and all passes' hits are merged by row at the end.

Defined results: null text has no words; an item without words is never matched; rows repeated in the benchmark count
once per item_id; a null item_id counts as the empty string; a document repeated in the table is marked each time;
extra columns pass through the filter unchanged; an empty benchmark marks nothing.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelarium.llm import textcore as tc
from voxelarium.llm.base import cut, keyed, no_key, ship

WINDOW = 10
BLOCK_BYTES = 4 << 20


def _lowered(d: np.ndarray) -> np.ndarray:
    return tc.LOWER[d]


def _spelled(d, off):
    """Lower-cased bytes, starts and ends of the words, their hashes, and the word offsets of the rows."""
    d = _lowered(d)
    start, end, wo = tc.words(d, off, tc.ALNUM)
    return d, start, end, tc.word_hashes(d, start, end), wo


def _words(d, off):
    return _spelled(d, off)[3:]


class Tests:
    """The windows of one block of items: word hashes by length, and which items have them where."""

    def __init__(self, rows: list[tuple[str, bytes]], window: int):
        text = b"".join(t for _, t in rows)
        off = np.concatenate(([0], np.cumsum([len(t) for _, t in rows]))).astype(np.int64)
        d, start, end, h, wo = _spelled(np.frombuffer(text, np.uint8), off)
        _, first = np.unique(h, return_index=True)
        #: how the word of each hash is spelled
        self.spelled = {int(h[i]): d[start[i] : end[i]].tobytes() for i in first.tolist()}
        self.names = sorted({i for i, _ in rows})
        ids = {x: k for k, x in enumerate(self.names)}
        self.groups = {}
        for n in range(1, window + 1):
            at, item = [], []
            for r, (name, _) in enumerate(rows):
                size = int(wo[r + 1] - wo[r])
                if size == n or (n == window and size > n):
                    at.append(np.arange(wo[r], wo[r + 1] - n + 1))
                    item.append(np.full(size - n + 1, ids[name]))
            if not at:
                continue
            at, item = np.concatenate(at), np.concatenate(item)
            grid = h[at[:, None] + np.arange(n)]
            distinct, which = np.unique(grid, axis=0, return_inverse=True)
            which = which.ravel()
            order = np.argsort(which, kind="stable")
            self.groups[n] = (distinct, np.searchsorted(which[order], np.arange(len(distinct) + 1)), item[order], at[order])


def _suffixes(ids: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first `depth` symbols (0 ends a row), by prefix doubling."""
    n = len(ids)
    top = int(ids.max(initial=0)) + 1
    done, rank = 1, ids.astype(np.int64)
    key = None
    while done < depth:
        step, key, base = done, rank, top
        while done < depth and int(key.max(initial=0)) < (1 << 62) // max(base, 1) and done < 4 * step:
            shifted = np.zeros(n, np.int64)
            shifted[: max(n - done, 0)] = rank[done:]
            key = key * base + shifted
            done += step
        order = np.argsort(key, kind="stable")
        ks = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate(([1], (ks[1:] != ks[:-1]).astype(np.int64))))
        top = int(rank.max(initial=0)) + 1
    return order if key is not None else np.argsort(rank, kind="stable")


def _search(ids: np.ndarray, sa: np.ndarray, tests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[low, high) of the suffixes that begin with each test row."""
    m, n = tests.shape
    padded = np.concatenate((ids, np.zeros(n, ids.dtype)))

    def bound(upper: bool) -> np.ndarray:
        lo, hi = np.zeros(m, np.int64), np.full(m, len(sa), np.int64)
        while True:
            live = np.flatnonzero(lo < hi)
            if not len(live):
                return lo
            mid = (lo[live] + hi[live]) >> 1
            d = padded[sa[mid][:, None] + np.arange(n)] - tests[live]
            first = np.argmax(d != 0, axis=1)
            sign = d[np.arange(len(live)), first]
            right = (sign <= 0) if upper else (sign < 0)
            lo[live] = np.where(right, mid + 1, lo[live])
            hi[live] = np.where(right, hi[live], mid)

    low = bound(False)
    return low, bound(True)


def matches(d: np.ndarray, off: np.ndarray, tests: Tests, window: int):
    """(words before each row, words hit, (row, item) pairs as row * items + item, longest match of each row) of a slab."""
    low, start, end, h, wo = _spelled(d, off)
    while True:
        out = _matches(h, wo, tests, window)
        # a word of a match that is spelled otherwise only shares a hash: it gets one of its own
        wrong = [i for i in np.flatnonzero(out[1]).tolist() if tests.spelled[int(h[i])] != low[start[i] : end[i]].tobytes()]
        if not wrong:
            return out
        used = set(h.tolist()) | set(tests.spelled)
        fresh = (x for x in range(1, 2**64) if x not in used)
        h[wrong] = np.array([next(fresh) for _ in wrong], np.uint64)


def _matches(h: np.ndarray, wo: np.ndarray, tests: Tests, window: int):
    rows = len(wo) - 1
    hit = np.zeros(len(h), bool)
    longest = np.zeros(rows, np.int64)
    pairs = np.zeros(0, np.int64)
    if not len(h) or not tests.groups:
        return wo, hit, pairs, longest
    vocabulary, inverse = np.unique(h, return_inverse=True)
    # a zero after each row keeps windows within rows
    place = np.arange(len(h)) + np.repeat(np.arange(rows), np.diff(wo))
    ids = np.zeros(len(h) + rows, np.int64)
    ids[place] = inverse + 1
    back = np.full(len(ids), -1, np.int64)
    back[place] = np.arange(len(h))
    sa = _suffixes(ids, window)
    found = []
    for n, (grid, first, item, at) in tests.groups.items():
        k = np.minimum(np.searchsorted(vocabulary, grid), len(vocabulary) - 1)
        known = np.flatnonzero((vocabulary[k] == grid).all(1))
        if not len(known):
            continue
        low, high = _search(ids, sa, k[known] + 1)
        some = np.flatnonzero(high > low)
        if not len(some):
            continue
        counts = high[some] - low[some]
        p = back[sa[tc.ranges(low[some], counts)]]
        t = np.repeat(known[some], counts)
        hit |= tc.marked(len(h), p, p + n)
        uses = first[t + 1] - first[t]
        pick = tc.ranges(first[t], uses)
        found.append((np.repeat(p, uses), at[pick], item[pick], n))
    if found:
        row_of = np.repeat(np.arange(rows), np.diff(wo))
        for p, q, item, n in found:
            pairs = np.union1d(pairs, row_of[p] * len(tests.names) + item)
            # runs of hits on one diagonal are one verbatim match
            o = np.lexsort((p, p - q))
            run = np.flatnonzero(np.concatenate(([True], ((p - q)[o][1:] != (p - q)[o][:-1]) | (p[o][1:] != p[o][:-1] + 1))))
            size = np.diff(np.append(run, len(p))) + n - 1
            np.maximum.at(longest, row_of[p[o][run]], size)
    return wo, hit, pairs, longest


def _blocks(benchmark: DataFrame, window: int) -> tuple[int, Iterator[Tests]]:
    """The number of blocks, and the blocks one by one: the driver holds one at a time."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), F.encode("text", "UTF-8").alias("t")).where(F.length("t") > 0).distinct()
    total = items.agg(F.sum(F.length("t"))).first()[0] or 0
    n = max(1, math.ceil(total / BLOCK_BYTES))

    def each():
        for k in range(n):
            block = items.where(F.pmod(F.xxhash64("i"), F.lit(n)) == k) if n > 1 else items
            yield Tests([(r.i, bytes(r.t)) for r in block.collect()], window)

    return n, each()


def _found(b: pa.RecordBatch, column: int, tests: Tests, window: int):
    """(words, words hit, longest match, items) of each row of a batch, and the mask of its hit words by slab."""
    rows = b.num_rows
    n_words, n_hit, longest = np.zeros(rows, np.int64), np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    items: list[list[str]] = [[] for _ in range(rows)]
    masks = []
    for i, j, d, off in tc.slabs(b.column(column)):
        wo, hit, pairs, far = matches(d, off, tests, window)
        longest[i:j] = far
        for x in pairs.tolist():
            items[i + x // len(tests.names)].append(tests.names[x % len(tests.names)])
        n_words[i:j] = np.diff(wo)
        sums = np.concatenate(([0], np.cumsum(hit)))
        n_hit[i:j] = sums[wo[1:]] - sums[wo[:-1]]
        masks.append((i, j, wo, hit))
    return n_words, n_hit, longest, [sorted(x) for x in items], masks


def _marks(key, n_words, n_hit, longest, items) -> pa.RecordBatch:
    digest = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
    return pa.RecordBatch.from_arrays(
        [key, pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(digest, pa.string()), pa.array([x > 0 for x in n_hit], pa.bool_()), pa.array(longest, pa.int64()), pa.array(items, pa.list_(pa.string()))],
        ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest_match", "items"],
    )


MARKS = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest_match long, items array<string>"


def _hits(docs: DataFrame, blocks: Iterator[Tests], window: int) -> DataFrame:
    """(k1, k2, words, items, longest) of the rows hit, from one pass per block: words are runs (start, end)."""
    base, found = keyed(docs, "text"), None
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for tests in blocks:
        shared = docs.sparkSession.sparkContext.broadcast(tests)

        def run(batches, shared=shared):
            for b in batches:
                _, n_hit, longest, items, masks = _found(b, 2, shared.value, window)
                runs = [[] for _ in range(b.num_rows)]
                for i, j, wo, hit in masks:
                    for r in range(i, j):
                        if n_hit[r]:
                            m = np.concatenate(([False], hit[wo[r - i] : wo[r - i + 1]], [False])).astype(np.int8)
                            edge = np.flatnonzero(np.diff(m))
                            runs[r] = [{"start": int(x), "end": int(y)} for x, y in zip(edge[::2], edge[1::2], strict=True)]
                some = np.flatnonzero(n_hit)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(some)), b.column(1).take(pa.array(some)), pa.array([runs[r] for r in some], run_type), pa.array([items[r] for r in some], pa.list_(pa.string())), pa.array(longest[some])], ["k1", "k2", "words", "items", "longest"])

        part = cut(base.mapInArrow(run, "k1 long, k2 long, words array<struct<start: long, end: long>>, items array<string>, longest long").dropDuplicates(["k1", "k2"]), "hits")
        shared.unpersist()
        found = part if found is None else found.unionByName(part)
    return found.groupBy("k1", "k2").agg(F.flatten(F.collect_list("words")).alias("words"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.max("longest").alias("longest"))


def _merged(batches):
    for b in batches:
        n_words = []
        for _, _, d, off in tc.slabs(b.column("text")):
            n_words += np.diff(_words(d, off)[1]).tolist()
        n_hit = []
        for words in b.column("words").to_pylist():
            end = hit = 0
            for x, y in sorted((w["start"], w["end"]) for w in words or ()):
                hit += max(0, y - max(x, end))
                end = max(end, y)
            n_hit.append(hit)
        items = [sorted(x or ()) for x in b.column("items").to_pylist()]
        yield _marks(b.column("k1"), n_words, n_hit, [x or 0 for x in b.column("longest").to_pylist()], items)


def mark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest_match and items of every row."""
    ship(docs.sparkSession)
    n, blocks = _blocks(benchmark, window)
    if n > 1:
        joined = keyed(docs, "text").join(_hits(docs, blocks, window), ["k1", "k2"], "left").select("k1", "text", "words", "items", "longest")
        return joined.mapInArrow(_merged, MARKS).withColumn("doc_id", no_key("doc_id"))
    shared = docs.sparkSession.sparkContext.broadcast(next(blocks))

    def run(batches):
        for b in batches:
            n_words, n_hit, longest, items, _ = _found(b, 1, shared.value, window)
            yield _marks(b.column(0), n_words, n_hit, longest, items)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, MARKS)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs, all columns unchanged, that hold no benchmark window."""
    ship(docs.sparkSession)
    n, blocks = _blocks(benchmark, window)
    if n > 1:
        hit = _hits(docs, blocks, window).select("k1", "k2")
        rows = keyed(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
        return rows.join(hit, ["k1", "k2"], "left_anti").select("row.*")
    shared = docs.sparkSession.sparkContext.broadcast(next(blocks))
    column = docs.columns.index("text")

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(_found(b, column, shared.value, window)[1] == 0))

    return docs.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema]))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = mark(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return marks.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


_TOKENS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS (SELECT doc_id, {_TOKENS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_TOKENS} AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item, list_slice(w, i, i + 9) AS g FROM (SELECT item, w, unnest(range(1, len(w) - 8)) AS i FROM b WHERE len(w) >= 10)
  UNION SELECT item, w AS g FROM b WHERE len(w) BETWEEN 1 AND 9),
lens AS (SELECT DISTINCT len(g) AS n FROM bw),
dw AS (SELECT doc_id, n, i, list_slice(w, i, i + n - 1) AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
m AS (SELECT dw.doc_id, dw.n, dw.i, bw.item FROM dw JOIN bw ON dw.g = bw.g),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM m)) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(hit.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(it.n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(it.items, '')) AS items_sha256, coalesce(hit.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN it ON d.doc_id = it.doc_id
"""
