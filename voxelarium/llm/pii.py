"""Operator 7: personal data.  Patterns propose spans, checksums confirm them, words nearby adjust the score.

Base kinds are email, ip, card and phone with fixed patterns; the method adds iban (mod 97), and national numbers in
the 3-2-4 form that a context word supports.  Every span has a score between 0 and 1: a prior of its kind, raised by a
passed checksum and by context words within CONTEXT characters before it.  The score never removes a base span.

All searches take time linear in the text: an e-mail address is grown from its '@', digit patterns start only where
no digit precedes, and repeated groups are possessive.

Defined results: null text is empty; no spans hash as the empty string; offsets are code points; extra columns are
ignored; rows repeated in the table are each reported; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelarium.llm.base import ship

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "national")
CONTEXT = 40

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# a digit pattern can only begin after a non-digit: a run of digits is taken whole by the match before
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){10,30}(?![A-Za-z0-9])")
_NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_DIGITS = re.compile(r"[0-9]")

#: Prior score of each kind, and the words near a span that speak for it.
PRIOR = {"email": 0.8, "ip": 0.5, "card": 0.5, "phone": 0.6, "iban": 0.5, "national": 0.2}
WORDS = {
    "email": ("mail", "contact", "write to", "courriel", "correo"),
    "ip": ("ip", "address", "host", "server", "adresse"),
    "card": ("card", "visa", "credit", "payment", "carte", "karte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "llame"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta"),
    "national": ("ssn", "social security", "national id", "tax id"),
}


def luhn(digits: str) -> bool:
    """The sum with every second digit from the right doubled is a multiple of ten."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(text: str) -> bool:
    """The check of an international account number: rotated by four and read in base 36 digits, 1 modulo 97."""
    s = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _emails(text: str):
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the base kinds, sorted."""
    out = [(a, 0, e) for a, e in _emails(text)]
    if _DIGITS.search(text):
        for m in _IP.finditer(text):
            parts = [x.lstrip("0") for x in m[0].split(".")]  # a part may have any number of digits
            if all(len(x) <= 3 and int(x or 0) <= 255 for x in parts):
                out.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def added_spans(text: str) -> list[tuple[int, int, int]]:
    """Spans of the kinds beyond the base, confirmed by checksum or context."""
    out = []
    if _DIGITS.search(text):
        for m in _IBAN.finditer(text):
            # the longest prefix that ends at a word's end and passes the check
            parts = m[0].split(" ")
            for k in range(len(parts), 0, -1):
                s = " ".join(parts[:k])
                if 15 <= len(s.replace(" ", "")) <= 34 and mod97(s):
                    out.append((m.start(), 4, m.start() + len(s)))
                    break
        for m in _NATIONAL.finditer(text):
            if m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000" and context(text, m.start(), "national"):
                out.append((m.start(), 5, m.end()))
    return out


def context(text: str, start: int, kind: str) -> bool:
    near = text[max(0, start - CONTEXT) : start].lower()
    return any(re.search(rf"(?<![^\W_]){re.escape(w)}", near) for w in WORDS[kind])


def score(text: str, start: int, kind: str) -> float:
    value = PRIOR[kind]
    if kind in ("card", "iban"):
        value += 0.3  # a checksum has confirmed it
    if context(text, start, kind):
        value += 0.5 * (1 - value)
    return round(value, 3)


def find(docs: DataFrame) -> DataFrame:
    """One row per input row: counts of the base kinds, digests, and all spans with kind, place and score."""
    ship(docs.sparkSession)
    one = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
    schema = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in BASE), ("base_sha256", pa.string()), ("spans", pa.string()), ("found", pa.list_(one))])

    def run(batches):
        for b in batches:
            out = {c: [] for c in schema.names}
            out["doc_id"] = b.column(0).to_pylist()
            texts = b.column(1)
            for r in range(b.num_rows):
                text = texts[r].as_py() or ""
                base = base_spans(text)
                every = sorted(base + added_spans(text))
                for k, name in enumerate(BASE):
                    out[f"n_{name}"].append(sum(s[1] == k for s in base))
                out["base_sha256"].append(hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{e}" for a, k, e in base).encode()).hexdigest())
                out["spans"].append(",".join(f"{KINDS[k]}:{a}:{e}" for a, k, e in every))
                out["found"].append([{"kind": KINDS[k], "start": a, "end": e, "score": score(text, a, KINDS[k])} for a, k, e in every])
            yield pa.RecordBatch.from_pydict(out, schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, found array<struct<kind: string, start: long, end: long, score: double>>")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
