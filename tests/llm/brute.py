"""Plain-Python definitions of the operators' results on small tables."""

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(x) -> str:
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def byte_repeats(rows, w=400):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + w] for t in texts for i in range(len(t) - w + 1))
    out = []
    for (d, _), t in zip(rows, texts, strict=True):
        gone = [False] * len(t)
        for i in range(len(t) - w + 1):
            if seen[t[i : i + w]] > 1:
                gone[i : i + w] = [True] * w
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((d, len(t), sum(gone), spans, sha(bytes(c for c, g in zip(t, gone, strict=True) if not g))))
    return sorted(out, key=repr)


def word_repeats(rows, w=13):
    texts = [WORD.findall(t or "") for _, t in rows]
    first = {}
    for (d, _), t in zip(rows, texts, strict=True):
        for i in range(len(t) - w + 1):
            if d is not None:
                k = tuple(t[i : i + w])
                first[k] = min(first.get(k, d), d)
    out = []
    for (d, _), t in zip(rows, texts, strict=True):
        gone = [False] * len(t)
        for i in range(len(t) - w + 1):
            if d is not None and first[tuple(t[i : i + w])] < d:
                gone[i : i + w] = [True] * w
        out.append((d, len(t), sum(gone), sha(" ".join(x for x, g in zip(t, gone, strict=True) if not g))))
    return sorted(out, key=repr)


class Sets:
    def __init__(self, ids):
        self.up = {i: i for i in ids}

    def find(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def shingle_set(text):
    w = WORD.findall((text or "").translate(ASCII_LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def near_duplicates(rows):
    sets = [(d, shingle_set(t)) for d, t in rows]
    u = Sets({d for d, _ in sets if d is not None})
    live = [(d, s) for d, s in sets if d is not None and s]
    where = defaultdict(list)
    for i, (d, s) in enumerate(live):
        shared = Counter(j for x in s for j in where[x])
        for x in s:
            where[x].append(i)
        for j, n in shared.items():
            if 100 * n >= 75 * (len(s) + len(live[j][1]) - n):
                u.join(d, live[j][0])
    return sorted(((d, len(s), u.find(d) if d is not None else None, d is None or u.find(d) == d) for d, s in sets), key=repr)


LOW = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contaminated(rows, items, w=10):
    tests = defaultdict(set)
    for i, t in items:
        t = LOW.findall((t or "").translate(ASCII_LOWER))
        for k in range(max(1, len(t) - w + 1)) if t else ():
            tests[tuple(t[k : k + w])].add("" if i is None else str(i))
    lengths = sorted({len(k) for k in tests})
    out = []
    for d, t in rows:
        t = LOW.findall((t or "").translate(ASCII_LOWER))
        hit, found = [False] * len(t), set()
        for n in lengths:
            for i in range(len(t) - n + 1):
                k = tuple(t[i : i + n])
                if k in tests:
                    hit[i : i + n] = [True] * n
                    found |= tests[k]
        out.append((d, len(t), sum(hit), len(found), sha(",".join(sorted(found))), any(hit)))
    return sorted(out, key=repr)
