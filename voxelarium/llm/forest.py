"""Operator 2: MinHash near-duplicates with an LSH forest.

A document's set holds its distinct 5-word shingles (the whole sequence where there are fewer words).  Equal sets form
one class and are compared once.  A class's signature has FUNCTIONS minima; TREES orders of it are sorted, each by its
own three functions and then by all the others in turn.  Classes that share the first three functions of a tree form a
region.  In a sorted order the classes with the longest common prefix stand side by side, so each class is a candidate
with its NEIGHBOURS predecessors in the region: a region of up to NEIGHBOURS + 1 classes is compared whole.  A pair of
similarity 0.75 shares no region with probability (1 - 0.75**3)**21 = 1e-5.

Regions of more classes, and those at a partition's edge, are *crowded*.  There a class is a candidate with CROWDED
predecessors, those of the longest common prefix at whatever depth they branch off.  Once these links are known, the classes of crowded regions that still hold several components are joined exactly,
by the prefixes of their sets (see `crowded`): classes that share a long passage with thousands of others and are no
near-duplicates have rare shingles at the front of the order, so they meet in small groups.  Nothing is capped.

Candidates whose signatures agree too rarely for the threshold (below AGREE of 64, where 48 are expected) are dropped;
the rest are confirmed on full sets, in rounds: each class is first checked with its best candidate, then with more of
those that the links so far leave in other components, at last with all of them.

Defined results: null text and text without words have an empty set, are linked with nothing and kept; rows with null
doc_id are linked with nothing and kept; rows of one doc_id are one node; ties go to the smallest doc_id; extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxelarium.llm import textcore as tc
from voxelarium.llm.base import components, cut, ends, keyed, no_key, ship
from voxelarium.llm.suffix import Groups, _batch, columns

WORDS, SIMILAR = 5, (75, 100)
FUNCTIONS, TREES, DEPTH, NEIGHBOURS, AGREE = 64, 21, 3, 6, 30
#: Neighbours before each class of a crowded region.
CROWDED = 2
U64 = np.uint64
#: Rows of a group compared in one task; rows of a group compared with plain index arithmetic.
BLOCK, SMALL = 1 << 16, 64
#: Ratio of the sizes in a bucket of sizes.
RATIO = 1.1
_A = tc.splitmix(np.arange(1, FUNCTIONS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)
_B = tc.splitmix(np.arange(1, FUNCTIONS + 1, dtype=U64) * U64(0xD1342543DE82EF95))


def _grams(h: np.ndarray, k: int = WORDS) -> np.ndarray:
    return tc.grams(h, min(k, len(h)), seed=len(h) if len(h) < k else 0) if len(h) else h


def shingles(h: np.ndarray, k: int = WORDS) -> np.ndarray:
    """Distinct shingles of one document's word hashes."""
    return np.unique(_grams(h, k))


def signature(u: np.ndarray) -> np.ndarray:
    low = np.full(FUNCTIONS, np.iinfo(np.uint64).max, U64)
    step = (1 << 20) // FUNCTIONS
    for i in range(0, len(u), step):
        low = np.minimum(low, (u[i : i + step, None] * _A + _B).min(0))
    return (low >> U64(32)).astype(np.uint32)


def _word_hashes(d, off, which: int = 0):
    d = tc.LOWER[d]
    start, end, wo = tc.words(d, off)
    return tc.word_hashes(d, start, end, which), wo


def _sketch(batches):
    for b in batches:
        n, g1, g2, sig = [], [], [], []
        for i, j, d, off in tc.slabs(b.column("text")):
            (h, wo), (other, _) = _word_hashes(d, off), _word_hashes(d, off, 1)
            for r in range(j - i):
                u, at = np.unique(_grams(h[wo[r] : wo[r + 1]]), return_index=True)
                n.append(len(u))
                # the two halves of a set's name come from two independent hashes of its words
                g1.append(int(tc.splitmix(u ^ U64(0x1F83D9ABFB41BD6B)).sum(dtype=U64)))
                g2.append(int(tc.splitmix(_grams(other[wo[r] : wo[r + 1]])[at] + U64(0x5BE0CD19137E2179)).sum(dtype=U64)))
                sig.append(signature(u).tobytes() if len(u) else None)
        yield pa.RecordBatch.from_arrays([b.column("k1"), b.column("k2"), pa.array(n, pa.int64()), pa.array(np.array(g1, U64).view(np.int64)), pa.array(np.array(g2, U64).view(np.int64)), pa.array(sig, pa.binary())], ["k1", "k2", "n", "g1", "g2", "sig"])


def _packed(sig: np.ndarray) -> pa.Array:
    """Four bits of each function."""
    nibble = (sig & 15).astype(np.uint8)
    return pa.array([x.tobytes() for x in nibble[:, ::2] << 4 | nibble[:, 1::2]], pa.binary())


def _grow(batches):
    """Each class once for every tree: region key, and the other functions in the tree's order, four bits a function."""
    for b in batches:
        if not b.num_rows:
            continue
        sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint32).reshape(-1, FUNCTIONS)
        for t in range(TREES):
            first = sig[:, DEPTH * t : DEPTH * (t + 1)].astype(U64)
            key = tc.grams(np.concatenate((first, np.full((len(sig), 1), t, U64)), 1).ravel(), DEPTH + 1)[:: DEPTH + 1]
            order = (np.arange(FUNCTIONS) + DEPTH * (t + 1)) % FUNCTIONS
            yield pa.RecordBatch.from_arrays([pa.array(tc.signed(np.ascontiguousarray(key))), b.column("id"), b.column("n"), _packed(sig[:, order])], ["key", "id", "n", "sig"])


_NIBBLES = np.array([(x >> 4 == 0) + (x & 15 == 0) for x in range(256)], np.uint8)


def _near(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Sizes that the threshold allows."""
    return SIMILAR[1] * np.minimum(n, m) >= SIMILAR[0] * np.maximum(n, m)


def _neighbours(batches):
    """Candidates among a sorted partition's rows: the NEIGHBOURS before each in its region, or CROWDED of them.

    The classes of crowded regions are named too: (region, class, -1).
    """
    carry = first = None

    def named(key, id_):
        return _batch(("a", "b", "agree"), (key, id_, np.full(len(key), -1, np.int32)))

    for b in batches:
        if not b.num_rows:
            continue
        x = [np.asarray(b.column(c)) for c in ("key", "id", "n")] + [np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint8).reshape(-1, FUNCTIONS // 2)]
        start = 0
        if carry is not None:
            start = len(carry[0])
            x = [np.concatenate((p, q)) for p, q in zip(carry, x, strict=True)]
        carry = [p[-NEIGHBOURS - 1 :] for p in x]
        key, id_, n, sig = x
        first = key[0] if first is None else first
        many = np.unique(np.append(key[NEIGHBOURS + 1 :][key[NEIGHBOURS + 1 :] == key[: -NEIGHBOURS - 1]], first))
        in_ = np.isin(key, many)
        if in_.any():
            yield named(key[in_], id_[in_])
        for gap in range(1, NEIGHBOURS + 1):
            i = np.arange(max(start, gap), len(key))
            i = i[(key[i] == key[i - gap]) & (id_[i] != id_[i - gap]) & ((gap <= CROWDED) | ~in_[i])]
            i = i[_near(n[i], n[i - gap])]
            agree = _NIBBLES[sig[i] ^ sig[i - gap]].sum(1, dtype=np.int32)
            ok = agree >= AGREE
            i, agree = i[ok], agree[ok]
            if len(i):
                yield _batch(("a", "b", "agree"), (np.minimum(id_[i], id_[i - gap]), np.maximum(id_[i], id_[i - gap]), agree))
    if carry is not None:
        in_ = carry[0] == carry[0][-1]
        yield named(carry[0][in_], carry[1][in_])


# ---- classes of crowded regions -------------------------------------------------------------------------------------
def _tokens(batches):
    """The shingles of each class."""
    for b in batches:
        id_ = np.asarray(b.column("id"))
        for i, j, d, off in tc.slabs(b.column("text")):
            h, wo = _word_hashes(d, off)
            sets = [shingles(h[wo[r] : wo[r + 1]]) for r in range(j - i)]
            n = np.array([len(u) for u in sets], np.int32)
            yield _batch(("w", "id", "n"), (tc.signed(np.concatenate(sets)), np.repeat(id_[i:j], n), np.repeat(n, n)))


def _bucket(n: np.ndarray) -> np.ndarray:
    return np.floor(np.log(np.maximum(n, 1)) / np.log(RATIO) + 1e-9).astype(np.int64)


def _prefixes(batches):
    """The front of each class's set, from its shingles that occur elsewhere (sorted by class, then rarest first).

    Let a pair of sizes n <= m share its first common shingle at places i and j (from 0) of the two sets.  The overlap
    is at most min(n - i, m - j), and 3 (n + m) / 7 at least.  So i <= n / 7 and n <= 7 (m - j) / 3 - m.  The smaller
    set is listed under its own bucket of sizes, the larger one (place as ~j) under the buckets that are left to it.
    """
    groups = Groups("id")

    def of(x):
        new = np.concatenate(([True], x["id"][1:] != x["id"][:-1]))
        first = np.flatnonzero(new)
        have = np.diff(np.append(first, len(new)))
        n = x["n"].astype(np.int64)
        # shingles of this class alone come first and need no row
        place = np.arange(len(new)) - np.repeat(first, have) + n - np.repeat(have, have)
        low, high = _bucket(-(-SIMILAR[0] * n // SIMILAR[1])), _bucket(np.minimum(n, 7 * (n - place) // 3 - n))
        key = x["w"].view(U64)
        small = np.flatnonzero(7 * place <= n)
        k = np.flatnonzero((SIMILAR[1] * (n - place) >= SIMILAR[0] * n) & (high >= low))
        times = high[k] - low[k] + 1
        large, at = np.repeat(k, times), tc.ranges(low[k], times)
        row, bucket = np.concatenate((small, large)), np.concatenate((_bucket(n[small]), at))
        side = np.concatenate((place[small], ~place[large]))
        g = tc.splitmix(key[row] + bucket.astype(U64) * U64(0x9E3779B97F4A7C15))
        for i in range(0, len(row), 50_000):
            q = slice(i, i + 50_000)
            yield _batch(("g", "cls", "n", "place"), (tc.signed(g[q]), x["id"][row[q]], x["n"][row[q]], side[q].astype(np.int32)))

    for b in batches:
        for t in groups.push(b):
            yield from of(columns(t))
    for t in groups.flush():
        yield from of(columns(t))


def _allowed(n, i, m, j):
    """The test of _prefixes for the smaller set (n, i) and the larger one (m, j)."""
    return (n <= m) & (7 * np.minimum(n - i, m - j) >= 3 * (n + m))


def _meet(batches):
    """Pairs of different components in groups of one shingle and bucket (whole groups, or two blocks of one)."""
    groups = Groups("g")

    def pairs(a, b):
        return _batch(("a", "b"), (np.minimum(a, b), np.maximum(a, b)))

    def of(x):
        g, id_, comp, n, place, block, pair = (x[c] for c in ("g", "id", "comp", "n", "place", "block", "pair"))
        n, place = n.astype(np.int64), place.astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
        size = np.diff(np.append(first, len(g)))
        crowd = np.repeat(size, size) > SMALL
        i = np.flatnonzero(~crowd)
        for gap in range(1, SMALL):
            i = i[i + gap < len(g)]
            i = i[g[i] == g[np.minimum(i + gap, len(g) - 1)]]
            if not len(i):
                break
            p, q = i, i + gap
            ok = (comp[p] != comp[q]) & ((place[p] < 0) != (place[q] < 0)) & ~(pair[p] & (block[p] == block[q]))
            p, q = p[ok], q[ok]
            s = np.where(place[p] >= 0, p, q)
            t = p + q - s
            ok = _allowed(n[s], place[s], n[t], ~place[t])
            if ok.any():
                yield pairs(id_[s[ok]], id_[t[ok]])
        for f, m in zip(first[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
            r = np.arange(f, f + m)
            names, count = np.unique(comp[r], return_counts=True)
            most = names[count.argmax()]
            s, t = r[place[r] >= 0], r[place[r] < 0]
            # members of the largest component meet only the others
            for left, right in ((s[comp[s] == most], t[comp[t] != most]), (s[comp[s] != most], t)):
                step = max(1, (1 << 20) // max(1, len(right)))
                for k in range(0, len(left) if len(right) else 0, step):
                    u = left[k : k + step, None]
                    ok = (comp[u] != comp[right]) & _allowed(n[u], place[u], n[right], ~place[right]) & ~(pair[u] & (block[u] == block[right]))
                    p, q = np.nonzero(ok)
                    if len(p):
                        yield pairs(id_[left[k + p]], id_[right[q]])

    for b in batches:
        for t in groups.push(b):
            yield from of(columns(t))
    for t in groups.flush():
        yield from of(columns(t))


def _agreed(batches):
    """Pairs whose signatures agree often enough."""
    for b in batches:
        if not b.num_rows:
            continue
        x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint32).reshape(-1, FUNCTIONS) for c in ("sa", "sb"))
        agree = (x == y).sum(1).astype(np.int32)
        ok = agree >= AGREE
        yield pa.RecordBatch.from_arrays([b.column("a").filter(pa.array(ok)), b.column("b").filter(pa.array(ok)), pa.array(agree[ok])], ["a", "b", "agree"])


def crowded(text: DataFrame, comp: DataFrame, classes: DataFrame) -> DataFrame:
    """Candidates (a, b, agree) of different components among classes (id, text): an exact join by set prefixes.

    A global order puts rare shingles first; two sets at the threshold share one of the first few (see _prefixes).
    Groups with one component are dropped, groups beyond BLOCK rows are compared block against block.
    """
    n = int(text.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a doc_id with several texts may stand for several classes: sets are told apart by both parts of the key
    key = F.xxhash64("id", "k2")
    names = text.select(key.alias("cls"), "id").join(comp, "id")
    tokens = text.select(key.alias("id"), "text").mapInArrow(_tokens, "w long, id long, n int").withColumn("df", F.count("*").over(Window.partitionBy("w"))).where("df > 1")
    front = tokens.repartition(n, "id").sortWithinPartitions("id", "df", "w").select("id", "w", "n").mapInArrow(_prefixes, "g long, cls long, n int, place int")
    front = cut(front.join(names, "cls"), "prefixes", free=True)
    group = front.groupBy("g").agg(F.count("*").alias("rows"), F.min("comp").alias("low"), F.max("comp").alias("high"), F.max(F.col("place") >= 0).alias("small"), F.max(F.col("place") < 0).alias("large"))
    group = group.where("low <> high AND small AND large").select("g", F.ceil(F.col("rows") / BLOCK).cast("int").alias("blocks"))
    member = front.join(group, "g").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    lone = member.where("blocks = 1").select("g", "id", "comp", "n", "place", "block", F.lit(False).alias("pair"))
    split = member.where("blocks > 1").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    split = split.select(F.xxhash64("g", F.least("block", "other"), F.greatest("block", "other")).alias("g"), "id", "comp", "n", "place", "block", (F.col("block") != F.col("other")).alias("pair"))
    found = lone.unionByName(split).repartition(n, "g").sortWithinPartitions("g").mapInArrow(_meet, "a long, b long").distinct()
    sig = lambda end: classes.select(F.col("id").alias(end), F.col("sig").alias(f"s{end}"))
    return found.join(sig("a"), "a").join(sig("b"), "b").mapInArrow(_agreed, "a long, b long, agree int").groupBy("a", "b").agg(F.max("agree").alias("agree"))


def _similar(a: bytes, b: bytes) -> bool:
    """Whether two texts' sets meet the threshold, under each of two independent hashes."""
    for which in (0, 1):
        u = [shingles(_word_hashes(d, np.array([0, len(d)]), which)[0]) for d in (np.frombuffer(t, np.uint8) for t in (a, b))]
        both = len(np.intersect1d(*u, assume_unique=True))
        if SIMILAR[1] * both < SIMILAR[0] * (len(u[0]) + len(u[1]) - both):
            return False
    return True


def _confirm(batches):
    """Pairs whose full sets meet the threshold."""
    for b in batches:
        left, right = (b.column(c).cast(pa.binary()) for c in ("ta", "tb"))
        keep = [_similar(left[r].as_py(), right[r].as_py()) for r in range(b.num_rows)]
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(keep, pa.bool_())], ["a", "b", "linked"])


#: Candidates of a class checked in each round; at last all that join different components.
ROUNDS = (1, 3, 12, None)


def links(classes: DataFrame, base: DataFrame) -> DataFrame:
    """Verified links (a, b) between classes that connect every component."""
    n = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    forest = classes.select("id", F.col("n").cast("int").alias("n"), "sig").mapInArrow(_grow, "key long, id long, n int, sig binary")
    forest = forest.repartitionByRange(n, "key", "sig", "id").sortWithinPartitions("key", "sig", "id")
    found = cut(forest.mapInArrow(_neighbours, "a long, b long, agree int").groupBy("a", "b").agg(F.max("agree").alias("agree")), "candidates", free=True)
    open_ = found.where("agree >= 0")
    linked = settle(open_, cut(texts(classes, base, ends(open_)), "texts"), None)
    # crowded regions that still hold several components
    comp = components(linked)
    member = found.where("agree < 0").select(F.col("a").alias("key"), F.col("b").alias("id")).join(comp, "id", "left").select("key", "id", F.coalesce("component", "id").alias("comp"))
    mixed = member.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("key")
    left = cut(member.join(mixed, "key", "left_semi").select("id", "comp").distinct(), "crowded")
    if left.isEmpty():
        return linked
    text = cut(texts(classes, base, left.select("id")), "texts")
    return settle(cut(crowded(text, left, classes), "across"), text, linked)


def texts(classes: DataFrame, base: DataFrame, ids: DataFrame) -> DataFrame:
    wanted = classes.join(ids, "id", "left_semi").select("id", "k1", "k2")
    return base.join(wanted, ["k1", "k2"]).select("id", "k2", "text").dropDuplicates(["id", "k2"])


def settle(open_: DataFrame, text: DataFrame, linked: DataFrame | None) -> DataFrame:
    """The links so far and those among the candidates, confirmed in rounds.

    Rounds spare work where classes have many candidates each; those left are confirmed at once where they are few.
    """
    count = lambda df: df.agg(F.count("*"), F.count_distinct("b")).first()
    n, of = count(open_)
    for most in ROUNDS:
        pick = open_
        if most is None or n <= 2 * most * of:
            most = None
        else:
            # the best of each class, looked at from its later partner: at most so many a class
            best = Window.partitionBy("b").orderBy(F.desc("agree"), "a")
            pick = open_.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= most)
        t = text.select(F.col("id").alias("_i"), F.col("text").alias("_t"))
        pairs = pick.select("a", "b").join(t, F.col("a") == F.col("_i")).select("a", "b", F.col("_t").alias("ta")).join(t, F.col("b") == F.col("_i")).select("a", "b", "ta", F.col("_t").alias("tb"))
        checked = cut(pairs.mapInArrow(_confirm, "a long, b long, linked boolean").groupBy("a", "b").agg(F.max("linked").alias("linked")), "checked", free=True)
        found = checked.where("linked").select("a", "b")
        linked = found if linked is None else cut(linked.unionByName(found), "verified")
        if most is None:
            break
        comp = components(linked)
        ca, cb = comp.select(F.col("id").alias("a"), F.col("component").alias("ca")), comp.select(F.col("id").alias("b"), F.col("component").alias("cb"))
        rest = open_.join(checked.select("a", "b"), ["a", "b"], "left_anti").join(ca, "a", "left").join(cb, "b", "left")
        open_ = cut(rest.where(~F.coalesce(F.col("ca") == F.col("cb"), F.lit(False))).select("a", "b", "agree"), "open")
        n, of = count(open_)
        if not n:
            break
    return linked


def near_duplicates(docs: DataFrame) -> DataFrame:
    """k1, k2, doc_id, n_shingles, component_id, kept of every row."""
    ship(docs.sparkSession)
    base = keyed(docs, "text")
    rows = cut(base.mapInArrow(_sketch, "k1 long, k2 long, n long, g1 long, g2 long, sig binary"), "sketches")
    none = F.lit(-(2**63))
    usable = rows.where((F.col("n") > 0) & (F.col("k1") != none))
    classes = cut(usable.groupBy("g1", "g2").agg(F.min(F.struct("k1", "k2")).alias("first"), F.min("n").alias("n"), F.min("sig").alias("sig")).select("g1", "g2", F.col("first.k1").alias("id"), F.col("first.k1").alias("k1"), F.col("first.k2").alias("k2"), "n", "sig"), "classes")
    # classes under one doc_id are one node: tie them with self links through their shared id
    comp = components(links(classes, base))
    # a doc_id with several texts belongs to several classes: these hang together
    tie = usable.select("k1", "g1", "g2").join(classes.select("g1", "g2", "id"), ["g1", "g2"]).join(comp, "id", "left").select("k1", F.coalesce("component", "id").alias("c"))
    node = tie.groupBy("k1").agg(F.min("c").alias("low"), F.max("c").alias("high"))
    several = node.where("low <> high")
    if not several.isEmpty():
        more = tie.join(several.select("k1"), "k1", "left_semi").select(F.col("k1").alias("a"), F.col("c").alias("b"))
        upper = components(more).select(F.col("id").alias("low"), F.col("component").alias("_up"))
        node = node.join(upper, "low", "left").select("k1", F.coalesce("_up", "low").alias("low"))
    per_doc = node.select("k1", F.col("low").alias("_component"))
    out = rows.select("k1", "k2", "n").join(per_doc, "k1", "left")
    component = F.coalesce("_component", F.when(F.col("k1") != none, F.col("k1")))
    return out.select("k1", "k2", no_key(), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("k1") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns unchanged, that stand for their group; of equal rows one stays."""
    names = docs.columns
    kept = near_duplicates(docs).where("kept").select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2")).distinct()
    rows = keyed(docs, F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"))
    one = rows.join(kept, (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2"))).dropDuplicates(["k1", "k2"])
    return one.select("_row.*")


def op2_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("k1", "k2")


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, list_slice(w, i, i + 4) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
cc(id, m) USING KEY (id) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.b, min(cc.m) FROM cc JOIN e ON e.a = cc.id JOIN recurring.cc r ON r.id = e.b WHERE cc.m < r.m GROUP BY e.b)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, cc.m AS component_id, d.doc_id = cc.m AS kept FROM d JOIN cc ON cc.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""
