"""Operator 9: language identification of mixed text.

Script ranges narrow the candidates of each word: a language stands for the scripts that hold at least SCRIPT_SHARE of
its training letters.  A word's score under a language is the log-likelihood of its letter trigrams; Viterbi with a
switching penalty labels the words, and runs of one label are the spans.  A document's language is the one with most
letters, its score their share.

The model is fitted on a bounded sample: about SAMPLE_ROWS rows of each language, by hash of doc_id, of documents
whose crc32(doc_id) modulo 3 is not 1, from their text and non-null lang; trigram counts are summed on the executors
and only TRIGRAMS numbers per language reach the driver.  Every document is predicted over its whole text.

The Viterbi recursion is max-plus linear.  It runs over blocks of BLOCK words from every entry state at once, then
over the blocks of each document, then inside the blocks with known ends, so the time does not depend on how the words
are spread over documents.

Defined results: `und` with score 0 for null text or text without a letter; text in scripts no language stands for gets
the most frequent language with score 0; ties go to the first language by code point; extra columns are ignored;
repeated rows are each predicted; with nothing to learn from, every document is `und`.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelarium.llm import textcore as tc
from voxelarium.llm.base import ship

SAMPLE_ROWS, TRIGRAMS, SCRIPT_SHARE = 1500, 1 << 16, 0.005
SWITCH, FOREIGN, BLOCK = 12.0, 60.0, 64

#: First and last code point of script ranges (fixed values of the Unicode standard); other letters are script 1.
SCRIPTS = (
    ("Latin", ((0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF))),
    ("Greek", ((0x370, 0x3FF), (0x1F00, 0x1FFF))),
    ("Cyrillic", ((0x400, 0x52F),)),
    ("Armenian", ((0x530, 0x58F),)),
    ("Hebrew", ((0x590, 0x5FF),)),
    ("Arabic", ((0x600, 0x6FF), (0x750, 0x77F))),
    ("Devanagari", ((0x900, 0x97F),)),
    ("Bengali", ((0x980, 0x9FF),)),
    ("Tamil", ((0xB80, 0xBFF),)),
    ("Thai", ((0xE00, 0xE7F),)),
    ("Georgian", ((0x10A0, 0x10FF),)),
    ("Ethiopic", ((0x1200, 0x137F),)),
    ("Kana", ((0x3040, 0x30FF),)),
    ("Hangul", ((0x1100, 0x11FF), (0xAC00, 0xD7AF))),
    ("Han", ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2FA1F))),
)


@functools.cache
def tables() -> tuple[np.ndarray, np.ndarray]:
    """(script of each code point, 0 for non-letters; lower-case form of each code point below 2**16)."""
    script = np.zeros(0x110000, np.uint8)
    letters = np.fromiter((chr(i).isalpha() for i in range(0x30000)), bool, 0x30000)
    script[:0x30000][letters] = 1
    for k, (_, spans) in enumerate(SCRIPTS):
        for a, b in spans:
            part = script[a : b + 1]
            part[part > 0] = k + 2
    lower = np.arange(0x10000, dtype=np.uint32)
    for i in range(0x10000):
        if letters[i]:
            c = chr(i).lower()
            if len(c) == 1:
                lower[i] = ord(c)
    return script, lower


def words(text: list[str]):
    """(trigram bucket of each letter, first letter of each word, script of each word, words before each text, code
    point place of each word's start and end) of a list of texts."""
    script, lower = tables()
    sizes = np.array([len(t) for t in text], np.int64)
    cp = np.frombuffer("\n".join(text).encode("utf-32-le", "surrogatepass"), np.uint32)
    begin = np.concatenate(([0], np.cumsum(sizes + 1)))  # texts are separated by one line break
    s = script[cp]
    low = np.where(cp < 0x10000, lower[np.minimum(cp, 0xFFFF)], cp)
    inside = s > 0
    at = np.flatnonzero(inside)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    start = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    end = np.flatnonzero(last) + 1
    mid = low[at].astype(np.uint64)
    before = np.where(first[at], 0, low[np.maximum(at - 1, 0)]).astype(np.uint64)
    after = np.where(last[at], 0, low[np.minimum(at + 1, max(len(low) - 1, 0))]).astype(np.uint64)
    mixed = (before * np.uint64(0x9E3779B97F4A7C15) + mid) * np.uint64(0xC2B2AE3D27D4EB4F) + after
    bucket = ((mixed * np.uint64(0x9FB21C651E98DF25)) >> np.uint64(48)).astype(np.int64) % TRIGRAMS
    return bucket, np.searchsorted(at, start), s[start], np.searchsorted(start, begin[:-1]), np.searchsorted(start, begin[1:] - 1), start, end, begin


class Model:
    def __init__(self, names: list[str], logs: np.ndarray, stands: np.ndarray, prior: np.ndarray):
        self.names, self.logs, self.stands = names, logs, stands
        self.likely = names[int(np.argmax(prior))] if names else "und"


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """The model from a sample of the training documents."""
    ship(docs.sparkSession)
    held = held_out(F.col("doc_id"))
    learn = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held).select(F.col("lang").cast("string").alias("lang"), "text", F.xxhash64("doc_id", F.lit(9)).alias("_h"))
    counts = {r["lang"]: r["count"] for r in learn.groupBy("lang").count().collect()}
    names = sorted(counts)
    if not names:
        return Model([], np.zeros((0, TRIGRAMS)), np.zeros((0, len(SCRIPTS) + 2), bool), np.zeros(0))
    share = F.create_map(*[F.lit(x) for k in names for x in (k, min(1.0, sample_rows / counts[k]))])
    sample = learn.where(F.pmod(F.col("_h"), F.lit(1 << 30)) < share[F.col("lang")] * float(1 << 30)).select("lang", "text")

    def count(batches):
        for b in batches:
            langs = b.column(0).to_pylist()
            for lang in set(langs):
                text = [t for t, x in zip(b.column(1).to_pylist(), langs, strict=True) if x == lang]
                bucket, w, s, *_ = words(text)
                n = np.bincount(bucket, minlength=TRIGRAMS)
                size = np.diff(np.append(w, len(bucket)))
                per = np.bincount(s, weights=size, minlength=len(SCRIPTS) + 2).astype(np.int64)
                some = np.flatnonzero(n)
                key = np.concatenate((some, TRIGRAMS + np.arange(len(per))))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(key)), pa.array(key), pa.array(np.concatenate((n[some], per)))], ["lang", "key", "n"])

    rows = sample.mapInArrow(count, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n")).collect()
    table = np.zeros((len(names), TRIGRAMS + len(SCRIPTS) + 2))
    for r in rows:
        table[names.index(r["lang"]), r["key"]] = r["n"]
    grams, scripts = table[:, :TRIGRAMS], table[:, TRIGRAMS:]
    logs = np.log(grams + 0.5) - np.log(grams.sum(1, keepdims=True) + 0.5 * TRIGRAMS)
    stands = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(1, keepdims=True), 1)
    return Model(names, logs, stands, np.array([counts[k] for k in names]))


def viterbi(e: np.ndarray, lengths: np.ndarray, penalty: float = SWITCH, block: int = BLOCK) -> np.ndarray:
    """Best label of each word.  e: scores by word and label; lengths: words of each document, in order."""
    n, k = e.shape
    label = np.zeros(n, np.int64)
    if not n or k < 2:
        return label
    per = -(-lengths // block)
    blocks = int(per.sum())
    doc = np.repeat(np.arange(len(lengths)), per)
    nth = np.arange(blocks) - np.repeat(np.cumsum(per) - per, per)
    start = (np.cumsum(lengths) - lengths)[doc] + nth * block
    size = np.minimum(block, (np.cumsum(lengths))[doc] - start)
    place = np.minimum(start[:, None] + np.arange(block), n - 1)
    score = np.where((np.arange(block) < size[:, None])[:, :, None], e[place], 0.0)
    # every block from every entry state
    d = np.full((blocks, k, k), -1e18)
    d[:, np.arange(k), np.arange(k)] = 0.0
    for t in range(block):
        d = np.maximum(d, d.max(2, keepdims=True) - penalty) + score[:, t, None, :]
    # block after block, all documents side by side, the longest first
    order = np.argsort(-per, kind="stable")
    first = np.cumsum(per) - per
    v = np.zeros((len(lengths), k))
    back = np.zeros((blocks, k), np.int64)
    for step in range(int(per.max())):
        live = order[: np.searchsorted(-per[order], -step, "left")]
        b = first[live] + step
        reach = v[live][:, :, None] + d[b]
        back[b] = reach.argmax(1)
        v[live] = reach.max(1)
    exit_, entry = np.zeros(blocks, np.int64), np.zeros(blocks, np.int64)
    now = v.argmax(1)
    for step in range(int(per.max()) - 1, -1, -1):
        live = order[: np.searchsorted(-per[order], -step, "left")]
        b = first[live] + step
        exit_[b] = now[live]
        entry[b] = back[b, now[live]]
        now[live] = entry[b]
    # inside each block between its known ends
    d = np.full((blocks, k), -1e18)
    d[np.arange(blocks), entry] = 0.0
    came = np.zeros((block, blocks, k), np.int16)
    for t in range(block):
        top = d.argmax(1)
        jump = d[np.arange(blocks), top][:, None] - penalty
        came[t] = np.where(d >= jump, np.arange(k), top[:, None])
        d = np.maximum(d, jump) + score[:, t]
    path = np.zeros((blocks, block), np.int64)
    now = exit_
    for t in range(block - 1, -1, -1):
        path[:, t] = now
        now = came[t, np.arange(blocks), now].astype(np.int64)
    return path[np.arange(block) < size[:, None]]


def label(text: list[str], model: Model):
    """(language of each text, its share of the letters, word labels, word extents) of a list of texts."""
    bucket, w, script, lo, hi, start, end, begin = words(text)
    k = len(model.names)
    names, score = ["und"] * len(text), np.zeros(len(text))
    if not k or not len(w):
        return names, score, np.zeros(0, np.int64), lo, hi, start, end, begin
    e = np.empty((len(w), k))
    for j in range(k):
        e[:, j] = np.add.reduceat(model.logs[j][bucket], w)
    e -= e.max(1, keepdims=True)
    allowed = model.stands[:, script].T
    known = allowed.any(1)
    e = np.where(known[:, None], np.where(allowed, e, -FOREIGN), 0.0)
    got = viterbi(e, hi - lo)
    letters = np.diff(np.append(w, len(bucket)))
    doc = np.repeat(np.arange(len(text)), hi - lo)
    share = np.bincount(doc * k + got, weights=letters * known, minlength=len(text) * k).reshape(len(text), k)
    total = np.bincount(doc, weights=letters, minlength=len(text))
    best = share.argmax(1)
    for r in np.flatnonzero(total > 0):
        names[r] = model.names[best[r]] if share[r, best[r]] > 0 else model.likely
        score[r] = share[r, best[r]] / total[r]
    return names, score, got, lo, hi, start, end, begin


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _texts(column, limit: int = tc.SLAB):
    """Runs of rows of bounded length; null is empty."""
    rows, size, first = [], 0, 0
    for r in range(len(column)):
        t = column[r].as_py() or ""
        rows.append(t)
        size += len(t)
        if size >= limit // 2:
            yield first, rows
            rows, size, first = [], 0, r + 1
    if rows:
        yield first, rows


def identify(docs: DataFrame, model: Model, spans: bool = False) -> DataFrame:
    """doc_id, held_out, lang_pred, score and, on request, the labelled spans in code points."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    one = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])

    def run(batches):
        for b in batches:
            lang, score, runs = [], [], []
            for _, text in _texts(b.column("text")):
                names, share, got, lo, hi, start, end, begin = label(text, shared.value)
                lang += names
                score += share.tolist()
                if spans:
                    for r in range(len(text)):
                        out = []
                        for w in range(lo[r], hi[r]) if len(got) else ():
                            name = shared.value.names[got[w]]
                            if out and out[-1]["lang"] == name:
                                out[-1]["end"] = int(end[w] - begin[r])
                            else:
                                out.append({"start": int(start[w] - begin[r]), "end": int(end[w] - begin[r]), "lang": name})
                        runs.append(out)
            cols = [b.column("doc_id"), b.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays(cols + ([pa.array(runs, pa.list_(one))] if spans else []), ["doc_id", "held_out", "lang_pred", "score"] + ["spans"] * spans)

    schema = "doc_id long, held_out boolean, lang_pred string, score double" + ", spans array<struct<start: long, end: long, lang: string>>" * spans
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, schema)


def accept(docs: DataFrame, model: Model, least: float = 0.3) -> DataFrame:
    """The rows of docs, all columns unchanged, with a language that holds at least a share of the letters."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    column = docs.columns.index("text")

    def run(batches):
        for b in batches:
            keep = []
            for _, text in _texts(b.column(column)):
                names, score, *_ = label(text, shared.value)
                keep += [x != "und" and s >= least for x, s in zip(names, score, strict=True)]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema]))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, fit(docs))
