"""Operator 6: remove word spans that earlier documents hold, on a De Bruijn graph of word windows.

Edges are windows of 13 consecutive words, nodes their 12-word overlaps.  As in published constructions of compacted
graphs, edges are not shuffled one by one: consecutive edges that share an anchor (anchors.py) travel as one path piece,
named by all the words it spans.  An equi-join by anchor finds the pieces that occur in several documents; a piece whose
name recurs is a path without branches in all its documents.  Where pieces share an anchor but not their name the path
branches inside them, and their single edges are joined.  Every repeated edge so knows a source in an earlier document.

Pieces and edges are then glued in one Spark window over each document (`glued`): two that follow each other have one
node between them, and the path goes on there if the source's place advances with the document's; it ends where the
source branches off, changes or ends.  The glued paths are the maximal spans, with the coordinates of their source.

At last the spans are verified: the words at each span's source coordinates are read in the source document and
digested, the digests are joined to the spans, and a span is removed only where its own words, read from the text, have
the same digest (`verified`).

Defined results: null text has no words; rows with a null doc_id are neither earlier nor later than others and lose
nothing; rows of equal doc_id do not count as earlier than each other; a text of fewer than 13 words loses nothing;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxelarium.llm import textcore as tc
from voxelarium.llm.anchors import Order, frequent, pieces
from voxelarium.llm.base import cut, no_key, ship
from voxelarium.llm.base import keyed as keyed_
from voxelarium.llm.suffix import Groups, _batch, columns

WINDOW, GRAM = 13, 5
PIECE = "h long, s long, k1 long, k2 long, a long, n int"
HIT = "k1 long, k2 long, a long, n int, src long, src_a long"


def keyed(docs: DataFrame, *keep: str) -> DataFrame:
    """As keyed of base; 32 bits of k2 are enough here, as rows with a null id take no part in any join."""
    return keyed_(docs, *keep).withColumn("k2", F.col("k2").bitwiseAND(F.lit(0xFFFFFFFF)))


def _word_hashes(d, off):
    """Two independent hashes of each word, and the word offsets of the rows."""
    start, end, wo = tc.words(d, off)
    return tc.word_hashes(d, start, end), tc.word_hashes(d, start, end, 1), wo


def _piece_map(window: int, k: int, common: np.ndarray):
    """Pieces of each batch.  A piece that a smaller doc_id of the batch holds too is settled there (kind 1: x and y
    are its source's doc_id and place); the others (kind 0: x and y are anchor and name) go on, so that a hot piece
    reaches the shuffle by anchor once per batch."""
    def run(batches):
        order = Order(common)
        for b in batches:
            k1, k2 = (np.asarray(b.column(i)) for i in (0, 1))
            parts = []
            for i, j, d, off in tc.slabs(b.column(2)):
                wh, other, wo = _word_hashes(d, off)
                if len(wh) < window:
                    continue
                row_of = np.repeat(np.arange(j - i), np.diff(wo))
                g = tc.grams(wh, k)
                at, a, n, row = pieces(g, row_of, wo[1:], order, window, k)
                power, inverse = tc.powers(1, len(wh) + 1)
                sums = np.zeros(len(wh) + 1, np.uint64)
                np.cumsum(other * power[:-1], out=sums[1:])
                name = tc.splitmix((sums[a + n - 1 + window] - sums[a]) * inverse[a] + tc.splitmix((n * 64 + at - a).astype(np.uint64)))
                parts.append((tc.signed(g[at]), tc.signed(name), k1[i + row], k2[i + row], (a - wo[row]).astype(np.int64), n.astype(np.int32)))
            if not parts:
                continue
            h, s, r1, r2, a, n = (np.concatenate(c) for c in zip(*parts, strict=True))
            o = np.lexsort((a, r1, s, h))
            new = np.concatenate(([True], (h[o][1:] != h[o][:-1]) | (s[o][1:] != s[o][:-1])))
            first = o[np.flatnonzero(new)][np.cumsum(new) - 1]
            settled = r1[o] > r1[first]
            x, y = np.where(settled, r1[first], h[o]), np.where(settled, a[first], s[o])
            back = np.argsort(o)  # the order of the documents compresses best
            yield _batch(PIECE_NAMES, (x[back], y[back], r1, r2, a << 16 | n.astype(np.int64) << 1 | settled[back]))
    return run


#: p holds place, number of edges and kind of a piece: a << 16 | n << 1 | kind.
PIECE = "x long, y long, k1 long, k2 long, p long"
PIECE_NAMES = ("x", "y", "k1", "k2", "p")


SETTLED = ("kind", "k1", "k2", "a", "n", "src", "src_a")


def _settle(batches):
    """Pieces sorted by anchor.  kind 1: every edge has an earlier source; kind 2: edges to be compared one by one."""
    groups = Groups("x")
    for b in batches:
        p = np.asarray(b.column("p"))
        done = np.flatnonzero(p & 1)
        if len(done):
            x, y, k1, k2 = (np.asarray(b.column(c))[done] for c in ("x", "y", "k1", "k2"))
            yield _batch(SETTLED, (np.ones(len(done), np.int32), k1, k2, p[done] >> 16, (p[done] >> 1 & 0x7FFF).astype(np.int32), x, y))
        for t in groups.push(b.filter(pa.array(p & 1 == 0))):
            yield from _settle_groups(columns(t))
    for t in groups.flush():
        yield from _settle_groups(columns(t))


def _settle_groups(x: dict[str, np.ndarray]):
    x |= {"n": (x["p"] >> 1 & 0x7FFF).astype(np.int32), "a": x["p"] >> 16}
    order = np.lexsort((x["a"], x["k1"], x["y"], x["x"]))
    h, s, k1 = x["x"][order], x["y"][order], x["k1"][order]
    newh = np.concatenate(([True], h[1:] != h[:-1]))
    news = newh | np.concatenate(([True], s[1:] != s[:-1]))
    cls, grp = np.cumsum(news) - 1, np.cumsum(newh) - 1
    first = np.flatnonzero(news)
    source, source_a = k1[first], x["a"][order][first]
    hit = k1 > source[cls]
    classes = np.bincount(grp[news])
    gf = np.flatnonzero(newh)
    several = (np.minimum.reduceat(k1, gf) < np.maximum.reduceat(k1, gf)) & (classes > 1)
    ask = several[grp] & ~hit
    for kind, mask in ((1, hit), (2, ask)):
        o = np.flatnonzero(mask)
        for i in range(0, len(o), 50_000):
            q = o[i : i + 50_000]
            yield _batch(SETTLED, (np.full(len(q), kind, np.int32), *(x[c][order[q]] for c in ("k1", "k2", "a", "n")), source[cls[q]], source_a[cls[q]]))


def _edges(window: int):
    """The edges (windows) of the pieces asked for: hash and place."""
    def run(batches):
        for b in batches:
            k1, k2 = (np.asarray(b.column(i)) for i in (0, 1))
            asked = b.column(3)
            flat = asked.flatten()
            counts = np.asarray(pc.list_value_length(asked)).astype(np.int64)
            at, n = np.asarray(flat.field("a")), np.asarray(flat.field("n")).astype(np.int64)
            row = np.repeat(np.arange(len(counts)), counts)
            for i, j, d, off in tc.slabs(b.column(2)):
                mine = np.flatnonzero((row >= i) & (row < j))
                wh, other, wo = _word_hashes(d, off)
                if not len(mine) or len(wh) < window:
                    continue
                place = tc.ranges(at[mine], n[mine])
                r = np.repeat(row[mine], n[mine])
                w = place + wo[r - i]
                yield _batch(("w", "v", "k1", "k2", "a"), (tc.signed(tc.grams(wh, window)[w]), tc.signed(tc.grams(other, window, 99)[w]), k1[r], k2[r], place))
    return run


def _first_edges(batches):
    """Edges sorted by hash: those with an earlier document, with its place."""
    groups = Groups("w")
    for b in batches:
        for t in groups.push(b):
            yield from _first_of(columns(t))
    for t in groups.flush():
        yield from _first_of(columns(t))


def _first_of(x: dict[str, np.ndarray]):
    order = np.lexsort((x["a"], x["k1"], x["v"], x["w"]))
    w, v, k1 = x["w"][order], x["v"][order], x["k1"][order]
    new = np.concatenate(([True], (w[1:] != w[:-1]) | (v[1:] != v[:-1])))
    cls = np.cumsum(new) - 1
    source = k1[new][cls]
    hit = np.flatnonzero(k1 > source)
    o = order[hit]
    yield _batch(("k1", "k2", "a", "n", "src", "src_a"), (x["k1"][o], x["k2"][o], x["a"][o], np.ones(len(o), np.int32), source[hit], x["a"][order][new][cls][hit]))


def repeated_edges(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(k1, k2, spans): for each row with any, the maximal spans (start, end, source_doc, source_start, digests) that
    earlier documents hold."""
    spark = docs.sparkSession
    ship(spark)
    base = keyed(docs, "text")
    named = base.where(F.col("k1") != F.lit(-(2**63)))

    def word_grams(d):
        return tc.grams(_word_hashes(d, np.array([0, len(d)]))[0], gram)

    common = frequent(docs, word_grams)
    settled = cut(named.mapInArrow(_piece_map(window, gram, common), PIECE).repartition(F.when(F.col("p").bitwiseAND(F.lit(1)) == 0, F.col("x")).otherwise(F.xxhash64("k2", "p"))).sortWithinPartitions("x").mapInArrow(_settle, f"kind int, {HIT}"), "paths", free=True)
    asked = settled.where("kind = 2").groupBy("k1", "k2").agg(F.collect_set(F.struct("a", "n")).alias("ask"))
    texts = base.join(asked, ["k1", "k2"]).select("k1", "k2", "text", "ask").dropDuplicates(["k1", "k2"])
    single = texts.mapInArrow(_edges(window), "w long, v long, k1 long, k2 long, a long").repartition("w").sortWithinPartitions("w").mapInArrow(_first_edges, HIT)
    hits = settled.where("kind = 1").drop("kind").unionByName(single)
    return verified(cut(glued(hits, window), "spans", free=True), base)


def glued(hits: DataFrame, window: int) -> DataFrame:
    """(k1, k2, start, end, source_doc, source_start) from pieces (k1, k2, a, n, src, src_a) of paths: n edges from place
    a on, whose source lies in document src from place src_a on.  One shuffle by document."""
    one = hits.repartition("k1", "k2").groupBy("k1", "k2", "a", "src", "src_a").agg(F.max("n").alias("n"))
    along = Window.partitionBy("k1", "k2").orderBy("a")
    before = lambda c: F.lag(c).over(along)
    goes_on = (before("src") == F.col("src")) & (F.col("src_a") - before("src_a") == F.col("a") - before("a")) & (F.col("a") <= before("a") + before("n"))
    path = one.withColumn("_new", F.when(goes_on, 0).otherwise(1)).withColumn("_path", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    span = path.groupBy("k1", "k2", "_path").agg(F.min("a").alias("start"), (F.max(F.col("a") + F.col("n")) - 1 + window).alias("end"), F.min("src").alias("source_doc"), F.min("src_a").alias("source_start"))
    return span.drop("_path")


#: Spans of one source that its text is read for at once.
ASKED = 4096


def _digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def _source_digests(batches):
    """(source_doc, source_start, size, digest) of the spans asked for in each source's text."""
    for b in batches:
        texts = b.column("text").cast(pa.binary())
        out = {c: [] for c in ("source_doc", "source_start", "size", "digest")}
        k1 = b.column("k1").to_pylist()
        for r, asked in enumerate(b.column("asked").to_pylist()):
            words = (texts[r].as_py() or b"").split()
            for q in asked:
                at, size = q["source_start"], q["size"]
                for c, v in zip(out, (k1[r], at, size, _digest(words[at : at + size])), strict=True):
                    out[c].append(v)
        yield pa.RecordBatch.from_pydict(out, pa.schema([("source_doc", pa.int64()), ("source_start", pa.int64()), ("size", pa.int64()), ("digest", pa.binary())]))


def verified(spans: DataFrame, base: DataFrame) -> DataFrame:
    """(k1, k2, spans): the spans of each row, each with the digests of the words at its source coordinates (several
    where several texts bear the source's doc_id), to be compared with its own."""
    spans = spans.withColumn("size", F.col("end") - F.col("start"))
    want = spans.select(F.col("source_doc").alias("k1"), "source_start", "size").distinct()
    part = F.floor((F.row_number().over(Window.partitionBy("k1").orderBy("source_start", "size")) - 1) / ASKED)
    asked = want.withColumn("_part", part).groupBy("k1", "_part").agg(F.collect_list(F.struct("source_start", "size")).alias("asked"))
    read = base.select("k1", "text").join(asked, "k1").select("k1", "text", "asked").mapInArrow(_source_digests, "source_doc long, source_start long, size long, digest binary")
    read = cut(read.groupBy("source_doc", "source_start", "size").agg(F.collect_set("digest").alias("digests")), "digests", free=True)
    whole = spans.join(read, ["source_doc", "source_start", "size"])
    return whole.groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct("start", "end", "source_doc", "source_start", "digests"))).alias("spans"))


def _remove(batches):
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("source_doc", pa.int64()), ("source_start", pa.int64())])
    for b in batches:
        texts = b.column("text").cast(pa.binary())
        out = {c: [] for c in ("k1", "n_words", "n_removed", "kept_sha256", "spans")}
        k1 = b.column("k1").to_pylist()
        for r, spans in enumerate(b.column("spans").to_pylist()):
            words = (texts[r].as_py() or b"").split()
            spans = [q for q in spans or () if _digest(words[q["start"] : q["end"]]) in q.pop("digests")]
            kept, last, gone = [], 0, 0
            for a, e in ((q["start"], q["end"]) for q in spans):
                if e > last:
                    kept += words[last:a] if a > last else []
                    gone += e - max(a, last)
                    last = e
            kept += words[last:]
            for c, v in zip(out, (k1[r], len(words), gone, hashlib.sha256(b" ".join(kept)).hexdigest(), spans), strict=True):
                out[c].append(v)
        yield pa.RecordBatch.from_pydict(out, pa.schema([("k1", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(span))]))


def remove_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per input row: word counts, removed spans with their sources, and the hash of what is left."""
    joined = keyed(docs, "text").join(repeated_edges(docs, window, gram), ["k1", "k2"], "left")
    out = joined.mapInArrow(_remove, "k1 long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start: long, end: long, source_doc: long, source_start: long>>")
    return out.select(no_key(), "n_words", "n_removed", "kept_sha256", "spans")


def op6_debruijn_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_spans(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
g AS (SELECT doc_id, i, list_slice(w, i, i + 12) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
f AS (SELECT k, min(doc_id) AS first FROM g GROUP BY k),
h AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM (SELECT g.doc_id, g.i FROM g JOIN f ON f.k = g.k WHERE f.first < g.doc_id)),
w AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
k AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM w ANTI JOIN h ON w.doc_id = h.doc_id AND w.p = h.p GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN k ON k.doc_id = d.doc_id
"""
