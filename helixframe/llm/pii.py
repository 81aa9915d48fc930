"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

Four base kinds (email, ip, card, phone) are kept as matched. The method adds IBANs (mod 97), national numbers, card
numbers of 12 or 13 digits and bare telephone numbers, each with a prior score that context words raise or lower; a
span counts from a score of 0.5. Spans are code points, end exclusive.

Each text is scanned alone, whole, in time linear in its length; nothing is shuffled.

Defined results: a null or empty text has no spans; repeated rows are scanned each; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import by_bytes
from helixframe.llm.secret_scan import redacted, shown

KINDS = ("email", "ip", "card", "phone", "iban", "national", "shortcard", "tel")
BASE = KINDS[:4]

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a leftmost match can't start inside a run of digits: the run's first digit would match too
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_TEL = re.compile(r"(?<![0-9+().-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9-])")

#: (prior score, words that raise it, words that lower it) by kind (fixed values).
CONTEXT = {
    "iban": (0.6, ("iban", "bank", "account", "konto", "compte", "cuenta"), ("example", "test")),
    "national": (0.3, ("ssn", "social", "security", "national", "taxpayer"), ("part", "serial", "order")),
    "shortcard": (0.2, ("card", "visa", "credit", "debit", "maestro"), ("isbn", "ean", "order", "serial")),
    "tel": (0.3, ("phone", "tel", "call", "fax", "mobile", "telefon", "téléphone"), ("isbn", "order", "serial", "version")),
}
NEAR = 48


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local@domain; walks from each @, since a local part can't hold one."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
        at = text.find("@", max(end, at + 1))


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    out = [(s, 0, e) for s, e in emails(text)]
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_small, m.groups()))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return out


def _score(text: str, kind: str, start: int, end: int) -> float:
    prior, more, less = CONTEXT[kind]
    words = set(re.findall(r"[^\W\d_]+", f"{text[max(0, start - NEAR) : start]} {text[end : end + NEAR // 2]}".lower()))
    return prior + 0.35 * any(w in words for w in more) - 0.35 * any(w in words for w in less)


def method_spans(text: str) -> list[tuple[int, int, int]]:
    found = [("iban", m) for m in _IBAN.finditer(text) if mod97(m[0])]
    found += [("national", m) for m in _NATIONAL.finditer(text)]
    found += [("shortcard", m) for m in _CARD.finditer(text) if 12 <= m.end() - m.start() <= 25 and 12 <= len(d := re.sub("[ -]", "", m[0])) <= 13 and luhn(d)]
    found += [("tel", m) for m in _TEL.finditer(text)]
    return [(m.start(), KINDS.index(k), m.end()) for k, m in found if _score(text, k, m.start(), m.end()) >= 0.5]


def scan(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and all spans of one text, sorted by start, then kind."""
    text = text or ""
    base = sorted(base_spans(text))
    return base, sorted([*base, *method_spans(text)])


def scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches):
        rows = [scan(t) for t in batch.column("text").to_pylist()]
        counts = [[sum(k == i for _, k, _ in base) for base, _ in rows] for i in range(len(BASE))]
        digests = [hashlib.sha256(shown(base, KINDS).encode()).hexdigest() for base, _ in rows]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, counts, [pa.int64()] * 4), pa.array(digests, pa.string()), pa.array([shown(x, KINDS) for _, x in rows], pa.string())], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])


def find(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, a digest of the base spans, and all spans."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scan_batches, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def masked(text: str, mark: str = "<PII>") -> str:
    """One text with every span replaced."""
    return redacted(text, scan(text)[1], mark)
