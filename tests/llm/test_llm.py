"""The training-data operators against plain-Python definitions, their SQL, and hand-made edge cases."""

import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import brute
from voxelarium.llm import base, debruijn, decontaminate, forest, language, mixing, pii, projections, registry, sharding, suffix, textcore, urllist

DOCS = "doc_id long, text string, lang string, source string, n_chars long, k1 int, target string, size int, `spans` string"


def table(spark, rows):
    """Documents with clashing extra columns from (doc_id, text[, lang[, source]])."""
    full = [(*r, *[None] * (4 - len(r)), len(r[1] or ""), 7, "t", 1, "s") for r in rows]
    return spark.createDataFrame(full, DOCS).repartition(3)


def vocabulary(seed, n=60):
    r = random.Random(seed)
    return ["".join(r.choice("abcdeéß") for _ in range(r.randint(1, 7))) for _ in range(n)]


def corpus(seed=0, n=40):
    """Documents with copies, near copies, shared passages, repeated lines, nulls, empty and one-word texts."""
    r, v = random.Random(seed), vocabulary(seed)
    prose = lambda k: " ".join(r.choice(v) for _ in range(k))
    passage, line = prose(90), prose(14)
    rows = [(i, prose(r.randint(1, 200))) for i in range(n)]
    rows += [(100 + i, rows[i % 7][1]) for i in range(9)]
    for i in range(9):
        w = rows[i + 7][1].split(" ")
        w[r.randrange(len(w))] = "edited"
        rows.append((120 + i, " ".join(w)))
    rows += [(140 + i, prose(r.randint(0, 30)) + "\n" + passage + "\t" + prose(r.randint(0, 30))) for i in range(6)]
    rows += [(160 + i, "\n".join([line] * (i + 2)) + prose(3)) for i in range(4)]
    rows += [(180, None), (181, ""), (182, " \n\t "), (183, "one"), (184, "one"), (185, "x" * 5000), (186, "y" * 5000 + passage), (187, "a b c d"), (188, "A B C D"), (189, "a b c e")]
    rows += [rows[3], rows[3], (None, rows[5][1]), (None, None), (None, prose(50))]
    return rows


def plain(rows):
    return sorted((tuple(r) for r in rows), key=repr)


# ---- kernels ----
def test_words_and_hashes():
    text = "a  bb\x0bccc\n".encode() + "é d".encode()
    d = np.frombuffer(text, np.uint8)
    s, e, wo = textcore.words(d, np.array([0, 10, 10, len(d)]))
    assert [text[a:b].decode() for a, b in zip(s, e, strict=True)] == ["a", "bb", "ccc", "é", "d"] and wo.tolist() == [0, 3, 3, 5]
    h = textcore.word_hashes(np.frombuffer(b"xabcyabc" + b"z" * 100 + b"abc" + b"z" * 100, np.uint8), np.array([1, 5, 108, 0, 8, 111]), np.array([4, 8, 111, 3, 108, 211]))
    assert h[0] == h[1] == h[2] != h[3] and h[4] == h[5]
    for which in range(2):
        p = textcore.Prefix(np.frombuffer(b"xabcdefghyabcdefgh", np.uint8), which)
        h = p.span(np.array([1, 10, 0]), np.array([9, 18, 8]))
        assert h[0] == h[1] != h[2]


@pytest.mark.parametrize("w", [1, 2, 5, 13])
def test_minimizers(w):
    h = textcore.splitmix(np.random.default_rng(0).integers(0, 50, 300).astype(np.uint64))
    key = h >> np.uint64(24)
    assert textcore.minimizers(h, w).tolist() == [i + int(np.argmin(key[i : i + w])) for i in range(len(h) - w + 1)]


def test_suffix_array():
    r = random.Random(1)
    for _ in range(400):
        s = np.array([r.randint(1, r.choice([1, 2, 5])) for _ in range(r.randint(0, 40))], np.int64)
        assert suffix.suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


def test_groups_stay_whole():
    import pyarrow as pa

    r = random.Random(3)
    keys = sorted(r.choice([5, 5, 5, *range(40)]) for _ in range(500))
    groups, seen = suffix.Groups("h", 20), []
    for i in range(0, 500, 7):
        seen += list(groups.push(pa.RecordBatch.from_pydict({"h": pa.array(keys[i : i + 7], pa.int64())})))
    parts = [t.column("h").to_pylist() for t in [*seen, *groups.flush()]]
    assert sum(parts, []) == keys and len(parts) > 8
    assert all(a[-1] != b[0] for a, b in zip(parts, parts[1:]))


@pytest.mark.parametrize("at_once", [1 << 20, 20])
def test_components(spark, monkeypatch, at_once):
    monkeypatch.setattr(base, "LINKS", at_once)
    r = random.Random(2)
    edges = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 160)] + [(200, 200)]
    u = brute.Sets({x for e in edges for x in e})
    for a, b in edges:
        u.join(a, b)
    got = {x.id: x.component for x in base.components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    assert got == {x: u.find(x) for x in u.up}
    assert base.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- 1: mixing ----
def test_mix(spark):
    rows = [(i, "w " * (i % 13), None, [None, "b", "a", "é", "c"][i % 5]) for i in range(300)] + [(7, "w w", None, "a")] * 3 + [(None, "w", None, "b")]
    docs = table(spark, rows)
    sizes = mixing.sizes_of(docs)
    mixed = mixing.mix(sizes, mixing.decide(sizes)).collect()
    assert len(mixed) == len(rows) and plain(mixed) == plain(mixing.mix(sizes, mixing.decide(sizes)).collect())
    per = defaultdict(lambda: [0, 0, 0])
    for r in mixed:
        assert 0 <= r.copies <= 2
        p = per[r.source]
        p[0] += r.size
        p[1] += r.size * r.copies
        p[2] = r.target
    assert sum(p[2] for p in per.values()) == pytest.approx(1.5 * sum(p[0] for p in per.values()))
    for size, taken, target in per.values():
        assert target <= 2 * size and abs(taken - target) <= 13
    out = mixing.repeat(docs)
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in mixed)
    assert mixing.repeat(docs.limit(0)).count() == 0


def test_mix_of_null_ids(spark):
    """Fifty rows without an id are told apart by their texts: the target falls among them."""
    rows = [(None, f"t{i} " * 10, None, "b") for i in range(50)] + [(i, "w " * 10, None, "a") for i in range(50)]
    sizes = mixing.sizes_of(table(spark, rows))
    taken = [r for r in mixing.mix(sizes, mixing.decide(sizes)).collect() if r.source == "b"]
    assert abs(sum(r.size * r.copies for r in taken) - taken[0].target) <= 10


def test_targets_of_one_source(spark):
    got = mixing.targets(spark.createDataFrame([("a", 10), ("a", 5)], "source string, size long")).first()
    assert (got.source_size, got.target) == (15, 22.5)


# ---- 2: near-duplicates ----
def test_near_duplicates(spark):
    rows = corpus(3)
    got = forest.near_duplicates(table(spark, rows)).drop("k1", "k2").collect()
    assert plain(got) == brute.near_duplicates(rows)


def test_near_duplicates_in_a_crowded_region(spark):
    """Hundreds of documents share a 70 % passage (similarity 0.54); some have one true partner just above 0.75."""
    r = random.Random(21)
    prose = lambda k: [f"w{r.randrange(10**6)}" for _ in range(k)]
    passage, rows = prose(140), []
    for i in range(600):
        own = prose(60)
        rows.append((i, " ".join(passage + own)))
        if i < 150:
            rows.append((1000 + i, " ".join(passage + own[:32] + prose(28))))
    want = brute.near_duplicates(rows)
    assert sum(not kept for *_, kept in want) == 150
    got = forest.near_duplicates(table(spark, rows)).drop("k1", "k2").collect()
    assert plain(got) == want


def test_near_duplicates_of_a_template(spark):
    """5,000 documents at similarity 0.68 to each other; 200 of them have one partner just above the threshold."""
    r = random.Random(23)
    prose = lambda k: [f"w{r.randrange(10**9)}" for _ in range(k)]
    passage, rows, want = prose(200), [], {}
    for i in range(5000):
        own = prose(44)
        rows.append((i, " ".join(passage + own)))
        want[i] = i
        if i % 25 == 0:
            far = passage + own[:12] + prose(32)
            rows.append((10000 + i, " ".join(far)))
            a, b = (brute.shingle_set(x[1]) for x in rows[-2:])
            assert 0.75 <= len(a & b) / len(a | b) < 0.77
            want[10000 + i] = i
    a, b = (brute.shingle_set(rows[k][1]) for k in (3, 4))
    assert 0.67 < len(a & b) / len(a | b) < 0.7
    got = {x.doc_id: x.component_id for x in forest.near_duplicates(table(spark, rows)).collect()}
    assert got == want


def test_crowded_classes_are_joined_exactly(spark, monkeypatch):
    """The exact join alone, on sets of many sizes that share passages, in whole groups and in blocks."""
    r = random.Random(24)
    v = [f"w{k}" for k in range(400)]
    passages = [[r.choice(v) for _ in range(n)] for n in (5, 30, 60, 60)]
    rows = {}
    for i in range(160):
        w = sum((p for p in passages if r.random() < 0.6), []) + [r.choice(v) for _ in range(r.randint(0, 20))]
        rows[i] = " ".join(w) or "x"
    rows |= {500 + i: rows[i % 9] + " edited" * (i % 3) for i in range(120)}
    sets = {i: brute.shingle_set(t) for i, t in rows.items()}
    want = {(i, j) for i in rows for j in rows if i < j and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])}
    text = spark.createDataFrame([(i, 0, t) for i, t in rows.items()], "id long, k2 long, text string")
    sig = lambda t: forest.signature(forest.shingles(forest._word_hashes(*(lambda d: (d, np.array([0, len(d)])))(np.frombuffer(t.encode(), np.uint8)))[0])).tobytes()
    classes = spark.createDataFrame([(i, sig(t)) for i, t in rows.items()], "id long, sig binary")
    for block, small in ((1 << 16, 64), (1 << 16, 2), (50, 2)):
        monkeypatch.setattr(forest, "BLOCK", block)
        monkeypatch.setattr(forest, "SMALL", small)
        got = {(x.a, x.b) for x in forest.crowded(text, text.select("id", F.col("id").alias("comp")), classes).collect()}
        assert want <= got
        comp = {i: i % 5 for i in rows}
        some = forest.crowded(text, spark.createDataFrame(list(comp.items()), "id long, comp long"), classes).collect()
        assert {p for p in want if comp[p[0]] != comp[p[1]]} <= {(x.a, x.b) for x in some} <= {p for p in got if comp[p[0]] != comp[p[1]]}


def thue_morse(n=10):
    """Two words of 2**n letters whose polynomial hashes modulo a power of two are equal, whatever the base."""
    t = "a"
    for _ in range(n):
        t += t.translate(str.maketrans("ab", "ba"))
    return t, t.translate(str.maketrans("ab", "ba"))


def test_words_that_polynomial_hashes_confuse(spark):
    x, y = thue_morse()
    own = lambda k: [f"u{k}x{i}" for i in range(6)]
    rows = [(1, " ".join([x] * 13)), (2, " ".join([y] * 13)), (3, " ".join([*own(3), x, *own(4)])), (4, " ".join([*own(3), y, *own(4)]))]
    got = {r.doc_id: r.component_id for r in forest.near_duplicates(table(spark, rows)).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4}
    assert all(r.n_removed == 0 for r in debruijn.remove_spans(table(spark, rows)).collect())
    bench = spark.createDataFrame([(1, f"{x} {x} {x}")], "item_id long, text string")
    assert {r.doc_id: r.n_hit for r in decontaminate.mark(table(spark, rows), bench).collect()} == {1: 13, 2: 0, 3: 0, 4: 0}
    assert all(r.n_removed == 0 for r in suffix.remove_repeats(table(spark, [(1, x), (2, y + "c")]), 1000).collect())


def test_near_duplicates_of_one_id_with_several_texts(spark):
    v = vocabulary(4)
    a, b = (" ".join(random.Random(k).choice(v) for _ in range(40)) for k in (1, 2))
    got = {r.doc_id: r.component_id for r in forest.near_duplicates(table(spark, [(5, a), (5, b), (2, a), (3, b), (9, "z")])).collect()}
    assert got == {5: 2, 2: 2, 3: 2, 9: 9}


def test_keep_one(spark):
    docs = table(spark, corpus(3))
    out = forest.keep_one(docs)
    assert out.columns == docs.columns
    kept = {(d, n) for d, n, _, k in brute.near_duplicates(corpus(3)) if k}
    assert {(r.doc_id, len(brute.shingle_set(r.text))) for r in out.collect()} == kept
    assert forest.keep_one(docs.limit(0)).count() == 0


# ---- 3: urls ----
def test_temporal_list(spark):
    log = spark.createDataFrame([("domain", "bad.org", "add", 10), ("domain", "bad.org", "add", 12), ("domain", "bad.org", "remove", 20), ("domain", "bad.org", "add", 30), ("url", "ok.org/x", "add", 5), ("domain", "void.org", "remove", 1)], "kind string, pattern string, action string, at int")
    caps = [(1, "http://bad.org/a", 9), (2, "https://u@A.Bad.org:80/a?q", 10), (3, "http://bad.org", 20), (4, "http://bad.org", 31), (5, "http://notbad.org", 15), (6, "http://OK.org/x/?y#z", 5), (7, "http://ok.org/xy", 5), (8, None, 5), (9, "no url", 5), (10, "http://bad.org", None), (2, "https://u@A.Bad.org:80/a?q", 10), (11, "http://void.org", 5)]
    out = urllist.evaluate(spark.createDataFrame(caps, "id int, url string, fetched_at int"), log)
    assert sorted((r.id, r.blocked) for r in out.collect()) == [(1, False), (2, True), (2, True), (3, False), (4, True), (5, False), (6, True), (7, False), (8, False), (9, False), (10, False), (11, False)]
    assert not urllist.evaluate(spark.createDataFrame(caps, "id int, url string, fetched_at int"), log.limit(0)).where("blocked").count()


def test_temporal_list_keeps_other_columns(spark):
    caps = spark.createDataFrame([(1, "http://a.org/x", 5, "h", 7, True)], "id int, url string, fetched_at int, pattern string, start int, kind boolean")
    log = spark.createDataFrame([("domain", "a.org", "add", 1)], "kind string, pattern string, action string, at int")
    r = urllist.evaluate(caps, log).first()
    assert (r.blocked, r.n_active, r.pattern, r.start, r.kind) == (True, 1, "h", 7, True)
    assert urllist.evaluate(caps.limit(0), log).count() == 0


# ---- 4: sharding ----
def test_sharding(spark):
    rows = corpus(5) * 3
    got = sharding.shard(table(spark, rows), 5, 64, whole_rows=True).collect()
    assert len(got) == len(rows) and set(sharding.PLACED) <= set(got[0].asDict()) and got[0].n_chars is not None
    places, load = defaultdict(list), defaultdict(int)
    for r in got:
        data = (r.text or "").encode()
        assert (r["size"], r.text_crc32) == (len(data) + 16, zlib.crc32(data))
        places[r.shard].append(r.slot)
        load[r.shard] += r["size"]
    assert all(sorted(p) == list(range(len(p))) for p in places.values()) and len(places) == 5
    assert max(load.values()) - min(load.values()) <= 2 * max(r["size"] for r in got) * 3
    assert sharding.shard(table(spark, rows).limit(0)).count() == 0


def test_sharding_by_brute_force(spark, sf):
    """Every row of the documents against a plain computation: slots by xxHash, sums, the edited map, ranks."""
    import xxhash

    def spark_hash(*values):
        h = 42
        for v in values:
            h = h if v is None else xxhash.xxh64_intdigest(v.to_bytes(8, "little", signed=True), h)
        return h - 2**64 if h >= 2**63 else h

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()] + [(None, "x"), (None, None), (3, "y"), (3, "y")]
    records = [(d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t in rows]
    slot = [spark_hash(d, c) % 8192 for d, _, c in records]
    weight = [0] * 8192
    for (_, n, _), k in zip(records, slot, strict=True):
        weight[k] += n
    shard_of = sharding.SlotMap.initial().rebalanced(weight).shard_of
    load = [sum(w for w, x in zip(weight, shard_of, strict=True) if x == k) for k in range(40)]
    assert max(load) - min(load) <= 0.01 * sum(load) / 40
    order = sorted(range(len(rows)), key=lambda i: (shard_of[slot[i]], slot[i], records[i][0] is not None, records[i][0] or 0, records[i][2], records[i][1]))
    want, seen = [], defaultdict(int)
    for i in order:
        k = shard_of[slot[i]]
        want.append((*records[i], "bytes", k, seen[k], None))
        seen[k] += 1
    got = sharding.shard(table(spark, rows)).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard").collect()
    assert plain(got) == sorted(want, key=repr)


def test_slot_map(spark, tmp_path):
    weight = [random.Random(i).randint(1, 100) for i in range(512)]
    first = sharding.SlotMap.initial(8, 512)
    second = first.rebalanced(weight)
    assert second.version == 1 and all(second.shard_of[s] == b for s, _, b in second.edits)
    load = [sum(w for w, x in zip(weight, second.shard_of, strict=True) if x == k) for k in range(8)]
    assert max(load) - min(load) <= 2
    third = second.rebalanced(weight, 9)
    assert any(b == 8 for _, _, b in third.edits)
    third.save(spark, str(tmp_path))
    assert sharding.SlotMap.load(spark, str(tmp_path), 2, 9).shard_of == third.shard_of


# ---- 5 and 6: repeated spans ----
@pytest.mark.parametrize("seed", [6, 7])
def test_byte_repeats(spark, seed):
    rows = corpus(seed)
    out = suffix.remove_repeats(table(spark, rows)).drop("spans").collect()
    assert plain(out) == brute.byte_repeats(rows)


def test_byte_repeats_with_a_short_window(spark):
    rows = corpus(8, 20)
    out = suffix.remove_repeats(table(spark, rows), 24, 10).drop("spans").collect()
    assert plain(out) == brute.byte_repeats(rows, 24)


@pytest.mark.parametrize("seed", [9, 10])
def test_word_repeats(spark, seed):
    rows = corpus(seed)
    out = debruijn.remove_spans(table(spark, rows)).drop("spans").collect()
    assert plain(out) == brute.word_repeats(rows)


def test_word_spans_line_up_with_their_source(spark):
    rows = [r for r in corpus(11) if r[0] is not None]
    words = {d: brute.WORD.findall(t or "") for d, t in rows}
    n = 0
    for r in debruijn.remove_spans(table(spark, rows)).collect():
        for s in r.spans:
            n += 1
            assert s.source_doc < r.doc_id
            assert words[r.doc_id][s.start : s.end] == words[s.source_doc][s.source_start : s.source_start + s.end - s.start]
    assert n > 20


def test_word_spans_are_verified_at_their_source(spark, monkeypatch):
    """Spans come from the glued paths, and only where the words at their source are the same: a span whose
    coordinates point elsewhere removes nothing."""
    rows = [(1, " ".join(f"w{i}" for i in range(40))), (2, "x " + " ".join(f"w{i}" for i in range(5, 35))), (3, " ".join(f"w{i}" for i in range(40)))]
    docs = table(spark, rows)
    whole = {r.doc_id: r for r in debruijn.remove_spans(docs).collect()}
    assert [tuple(s) for s in whole[2].spans] == [(1, 31, 1, 5)] and [tuple(s) for s in whole[3].spans] == [(0, 40, 1, 0)]
    glued = debruijn.glued
    monkeypatch.setattr(debruijn, "glued", lambda hits, window: glued(hits, window).withColumn("source_start", F.when(F.col("k1") == 2, F.col("source_start") + 1).otherwise(F.col("source_start"))))
    shifted = {r.doc_id: r for r in debruijn.remove_spans(docs).collect()}
    assert shifted[2].n_removed == 0 and not shifted[2].spans and shifted[3].n_removed == 40
    monkeypatch.setattr(debruijn, "ASKED", 1)
    monkeypatch.setattr(debruijn, "glued", glued)
    assert plain(debruijn.remove_spans(docs).collect()) == plain(whole.values())


@pytest.mark.parametrize("f", [suffix.remove_repeats, debruijn.remove_spans])
def test_repeats_of_an_empty_table(spark, f):
    assert f(table(spark, [])).count() == 0


# ---- 7: personal data ----
_KINDS = [re.compile(p) for p in (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]


def naive_spans(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    ok = [lambda s: True, lambda s: all(int(x) <= 255 for x in s.split(".")), lambda s: 14 <= len(digits(s)) <= 19 and pii.luhn(digits(s)), lambda s: 10 <= len(digits(s)) <= 15]
    return sorted((m.start(), k, m.end()) for k in range(4) for m in _KINDS[k].finditer(t) if ok[k](m[0]))


def test_base_spans_are_the_patterns():
    r = random.Random(12)
    for alphabet in ("a1.@+- ()9é2", "0123456789 -.+", "1.@a"):
        for _ in range(4000):
            t = "".join(r.choice(alphabet) for _ in range(r.randint(0, 60)))
            assert pii.base_spans(t) == naive_spans(t), t


def test_pii(spark):
    text = "é write to a.b@c-d.org or +1 (212) 555-0100; card 4111 1111 1111 1111, IBAN GB82 WEST 1234 5698 7654 32 ssn 123-45-6789 at 10.0.0.255, 10.0.0.256"
    rows = [(1, text), (2, None), (3, ""), (4, text), (None, "x@y.z"), (5, "1" * 20000 + "." * 20000 + "a@" * 5000)]
    got = pii.find(table(spark, rows)).collect()
    r = next(x for x in got if x.doc_id == 1)
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 1, 1)
    assert [s.kind for s in r.found] == ["email", "phone", "card", "iban", "national", "ip"]
    assert all(0 < s.score <= 1 for s in r.found)
    kept = [f"{s.kind}:{s.start}:{s.end}" for s in r.found]
    assert r.spans == ",".join(kept) and r.base_sha256 == brute.sha(",".join(k for k in kept if not k.startswith(("iban", "national"))))
    assert text[r.found[2].start : r.found[2].end] == "4111 1111 1111 1111"
    assert all(x.base_sha256 == brute.sha("") for x in got if x.doc_id in (2, 3))
    assert pii.base_spans("0" * 9000 + "1.2.3.4 " + "9" * 9000 + ".1.1.1") == [(0, 1, 9007)]
    assert pii.find(table(spark, [])).count() == 0


# ---- 8: embeddings ----
def test_projections(spark):
    rng = np.random.default_rng(13)
    rows, base_ = [], rng.standard_normal((30, 16))
    for i in range(400):
        e = base_[i % 30] + rng.standard_normal(16) * rng.choice([0.0, 0.02, 0.05, 0.5])
        rows.append((i, [float(x) for x in e.astype(np.float32)], int(i % 3)))
    rows += [(1000 + i, rows[0][1], 0) for i in range(700)]  # one very common vector: more than a block
    bad = [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [float("nan")] + [1.0] * 15, 1), (2003, [None] + [1.0] * 15, 1), (2004, rows[5][1], None), (2005, [], 1), (2006, [float("inf")] * 16, 1), (None, rows[6][1], 0), (2007, rows[7][1][:8], 1)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in projections.near_duplicates(df).collect()}
    x, label = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    link = (x @ x.T >= 0.98) & (label[:, None] == label)
    np.fill_diagonal(link, False)
    ids = [r[0] for r in rows]
    u = brute.Sets(ids)
    for i, j in zip(*np.nonzero(link), strict=True):
        u.join(ids[i], ids[j])
    assert {i: got[i] for i in ids} == {d: (int(link[k].sum()), u.find(d), u.find(d) == d) for k, d in enumerate(ids)}
    assert all(got[b[0]] == (0, b[0], True) for b in bad)
    assert projections.near_duplicates(df.limit(0)).count() == 0


def linked(x, block=1000):
    """Number of links and component of each row of unit vectors, by brute force."""
    u, n = brute.Sets(range(len(x))), np.zeros(len(x), int)
    for k in range(0, len(x), block):
        i, j = np.nonzero(x[k : k + block] @ x.T >= 0.98)
        i += k
        i, j = i[i != j], j[i != j]
        n += np.bincount(i, minlength=len(x))
        for p, q in zip(i.tolist(), j.tolist(), strict=True):
            u.join(p, q)
    return [(int(n[i]), u.find(i)) for i in range(len(x))]


def unit(v):
    return v / np.linalg.norm(v, axis=-1, keepdims=True)


def vectors(spark, x, label):
    import pandas as pd

    return spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)), "embedding": x.tolist(), "label": label})).repartition(4)


def test_projections_in_a_concentrated_label(spark):
    """3,000 vectors of mutual cosine about 0.97; 300 have one partner at the threshold: compared whole."""
    rng = np.random.default_rng(15)
    x = unit(unit(rng.standard_normal(64)) * 0.9849 + unit(rng.standard_normal((3000, 64))) * 0.1732)
    x = np.concatenate((x, unit(x[:300] + unit(rng.standard_normal((300, 64))) * 0.195)))
    df = vectors(spark, x, 0)
    assert [r.passes for r in projections.plan(df.selectExpr("label", "embedding AS e")).collect()] == [0]
    got = {r.vec_id: (r.n_links, r.component_id) for r in projections.near_duplicates(df).collect()}
    assert [got[i] for i in range(len(x))] == linked(x)


def test_projections_of_a_large_label(spark):
    """12,000 vectors about a mean, 400 planted pairs near the threshold, a crowd of 500 and fifty copies: by passes."""
    rng = np.random.default_rng(16)
    x = unit(unit(rng.standard_normal(48)) * 0.6 + unit(rng.standard_normal((12000, 48))) * 0.8)
    pairs = unit(x[:400] + unit(rng.standard_normal((400, 48))) * 0.19)
    crowd = unit(x[500] + unit(rng.standard_normal((500, 48))) * 0.17)
    x = np.concatenate((x, pairs, crowd, np.repeat(x[900:901], 50, 0)))
    df = vectors(spark, x, 3).withColumn("h1", F.lit("clash")).withColumn("passes", F.lit(1.5)).withColumn("id", F.lit(None).cast("string"))
    (passes,) = [r.passes for r in projections.plan(df.selectExpr("label", "embedding AS e")).collect()]
    assert 5 < passes and 2 * passes * projections.WINDOW < len(x)
    want = linked(x)
    got = {r.vec_id: (r.n_links, r.component_id) for r in projections.near_duplicates(df).collect()}
    same = [got[i] == w for i, w in enumerate(want)]
    assert sum(w[0] > 0 for w in want) > 1300 and not any(w[0] == 0 and not s for w, s in zip(want, same, strict=True))
    right = sum(s for w, s in zip(want, same, strict=True) if w[0])
    assert right >= 0.995 * sum(w[0] > 0 for w in want), (right, sum(w[0] > 0 for w in want))


def test_projections_of_extreme_components(spark):
    rows = [(1, [1e-200, 2e-200], 0), (2, [1e200, 2e200], 0), (3, [2e200, 1e200], 0), (4, [5e-324, 1e-323], 0)]
    got = {r.vec_id: r.component_id for r in projections.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 1}


def test_blocks_count_a_large_component(spark, monkeypatch):
    monkeypatch.setattr(projections, "BLOCK", 16)
    rng = np.random.default_rng(14)
    v = rng.standard_normal(8)
    rows = [(i, [float(a) for a in v + rng.standard_normal(8) * 0.05], 0) for i in range(100)]
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    want = (x @ x.T >= 0.98).sum(1) - 1
    got = {r.vec_id: r.n_links for r in projections.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert [got[i] for i in range(100)] == want.tolist()


# ---- 9: language ----
def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    for _ in range(60):
        lengths = rng.integers(0, 30, 6)
        e = -rng.random((int(lengths.sum()), 3)) * 4
        got, at = language.viterbi(e, lengths, 2.0, 4), 0
        for n in lengths:
            path, part = got[at : at + n], e[at : at + n]
            at += n
            if n:
                d = part[0].copy()
                for t in range(1, n):
                    d = np.maximum(d, d.max() - 2.0) + part[t]
                value = part[np.arange(n), path].sum() - 2.0 * (path[1:] != path[:-1]).sum()
                assert value == pytest.approx(d.max())


def test_language_held_out_accuracy(spark, sf):
    rows = registry.QUERIES["op9_language"](spark, sf).collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(truth) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held)


def test_language_edges(spark):
    en, el = "the cat and the dog were in the house ", "το σπίτι και η γάτα είναι εδώ "
    learn = [(i, en * 3, "en") for i in range(60)] + [(i + 100, el * 3, "el") for i in range(60)]
    model = language.fit(table(spark, learn))
    mixed = en * 4 + el * 2
    rows = [(1, None), (2, ""), (3, "123 !?"), (4, en), (5, el), (6, mixed), (7, "中文"), (8, "a"), (4, en), (None, en)]
    got = sorted((r.doc_id or 0, r.lang_pred, round(r.score, 2)) for r in language.identify(table(spark, rows), model, spans=True).collect())
    assert [x for x in got if x[0] in (1, 2, 3)] == [(1, "und", 0), (2, "und", 0), (3, "und", 0)]
    assert {x[1] for x in got if x[0] in (0, 4)} == {"en"} and ("el" in {x[1] for x in got if x[0] == 5})
    assert next(x for x in got if x[0] == 7)[1:] in (("en", 0), ("el", 0))
    spans = next(r for r in language.identify(table(spark, rows), model, spans=True).collect() if r.doc_id == 6).spans
    assert [s.lang for s in spans] == ["en", "el"] and mixed[spans[1].start :].startswith("το")
    assert {r.doc_id for r in language.accept(table(spark, rows), model).collect()} >= {4, 5, 6, None}
    assert language.fit(table(spark, [])).names == []
    assert {r.lang_pred for r in language.identify(table(spark, rows), language.fit(table(spark, []))).collect()} == {"und"}


def test_language_of_an_empty_table(spark):
    model = language.fit(table(spark, [(i, "the cat and the dog", "en") for i in range(60)] + [(i, "le chat et le chien", "fr") for i in range(100, 160)]))
    assert language.identify(table(spark, []), model).count() == 0 and language.accept(table(spark, []), model).count() == 0


# ---- 10: decontamination ----
def test_decontamination(spark):
    rows = corpus(15)
    long = next(t for d, t in rows if d == 141)
    items = [(1, " ".join(long.split()[5:40])), (10, "ONE"), (2, rows[2][1]), (2, rows[2][1]), (None, rows[4][1]), (3, None), (4, ""), (5, "never seen anywhere at all"), (6, rows[1][1].upper())]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = table(spark, rows)
    marks = decontaminate.mark(docs, bench)
    want = brute.contaminated(rows, items)
    assert plain(marks.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()) == want
    clean = decontaminate.decontaminate(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(not r[5] for r in want)
    assert decontaminate.mark(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.mark(docs.limit(0), bench).count() == 0


def test_decontamination_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 700)  # several blocks
    rows = corpus(16, 15)
    items = [(i, rows[i][1]) for i in range(6)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = table(spark, rows)
    got = decontaminate.mark(docs, bench).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()
    want = brute.contaminated(rows, items)
    assert plain(got) == want
    clean = decontaminate.decontaminate(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(not r[5] for r in want)


def test_words_of_equal_hash_are_told_apart(monkeypatch):
    """All words of the same length share a hash: matches are those of the spelling."""
    monkeypatch.setattr(textcore, "word_hashes", lambda d, start, end, which=0: (end - start).astype(np.uint64))
    flat = lambda t: (np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))
    tests = decontaminate.Tests([("1", b"aa bbb c dddd")], 4)
    for text, want in (("x AA bbb c dddd y", 4), ("zz bbb c dddd", 0), ("aa bbb c dddd zz yyy x wwww aa bbb c dddd", 8)):
        assert int(decontaminate.matches(*flat(text), tests, 4)[1].sum()) == want
    assert not forest._similar(b"aa bb cc dd ee", b"x1 bb cc") and forest._similar(b"aa", b"aa")


def test_longest_match(spark):
    words = [f"w{i}" for i in range(60)]
    r = decontaminate.mark(table(spark, [(1, "x " + " ".join(words[5:40]) + " y")]), spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")).first()
    assert r.longest_match == 35 == r.n_hit


# ---- whole tables ----
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracles(name, spark, sf, duck):
    df = registry.QUERIES[name](spark, sf)
    r = duck.sql(registry.ORACLES[name])
    assert sorted(df.columns) == sorted(r.columns)
    want = sorted((repr(tuple(x)) for x in r.fetchall()))
    assert sorted(repr(tuple(x[c] for c in r.columns)) for x in df.collect()) == want


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "mix_sources", "shard"]
    counts = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, base.cut(stage(spark, docs, sf), name)
        counts.append(docs.count())
        if i < 4:
            assert docs.columns == before.columns
        if name in ("language_id", "near_duplicates", "decontamination"):
            assert docs.exceptAll(before).isEmpty()
    kept = {d for d, _, _, k in brute.near_duplicates([(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]) if k}
    assert counts[0] == 1000 and counts[1] == len(kept) and counts[2] < counts[1] and counts[4] == counts[3]
    assert corpus_pipeline.run(spark, sf).count() == counts[4]


def test_pipeline_on_odd_tables(spark, tmp_path):
    rows = [(*r, *(("en", "s") if i % 3 else (None, None))) for i, r in enumerate(corpus(17, 12))]
    folder = str(tmp_path / "in")
    table(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, rows[2][1])], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert corpus_pipeline.run(spark, folder).count() > 0
    empty = str(tmp_path / "empty")
    table(spark, []).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{empty}/benchmark.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_texts_longer_than_a_slab(spark):
    """Two texts of about 3 MB, longer than what is handled at once, that share four fifths."""
    a = [f"w{i * 7919 % 1000003}" for i in range(400_000)]
    b = a[:320_000] + [f"x{i}" for i in range(80_000)]
    ta, tb = " ".join(a), " ".join(b)
    assert min(len(ta), len(tb)) > textcore.SLAB
    docs = table(spark, [(1, ta), (2, tb), (3, "short " * 3)])
    same = len(" ".join(a[:320_000])) + 1
    got = {r.doc_id: r for r in suffix.remove_repeats(docs).collect()}
    assert [tuple(x) for x in got[1].spans] == [tuple(x) for x in got[2].spans] == [(0, same)] and got[3].n_removed == 0
    assert got[1].kept_sha256 == brute.sha(ta[same:])
    got = {r.doc_id: r for r in debruijn.remove_spans(docs).collect()}
    assert (got[1].n_removed, got[2].n_removed) == (0, 320_000) and got[2].kept_sha256 == brute.sha(" ".join(b[320_000:]))
    got = {r.doc_id: r.component_id for r in forest.near_duplicates(docs).collect()}
    assert got == {1: 1, 2: 2, 3: 3}  # 0.67
    near = table(spark, [(1, ta), (2, " ".join(a[:390_000]))])
    assert {r.component_id for r in forest.near_duplicates(near).collect()} == {1}
    bench = spark.createDataFrame([(1, " ".join(a[390_000:390_030])), (2, " ".join(a[100:120]))], "item_id long, text string")
    assert {r.doc_id: (r.n_hit, r.n_items) for r in decontaminate.mark(docs, bench).collect()} == {1: (50, 2), 2: (20, 1), 3: (0, 0)}
    assert {r.doc_id: r.n_email for r in pii.find(table(spark, [(1, ta + " a@b.cd"), (2, "a@b.cd " * 300_000)])).collect()} == {1: 1, 2: 300_000}
