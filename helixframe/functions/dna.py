"""Scalar functions on DNA strings and 1-based closed coordinates, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Nucleotide codes and their complements (fixed values).
CODES = "ACGTUWSMKRYBDHVNacgtuwsmkrybdhvn"
COMPLEMENTS = "TGCAAWSKMYRVHDBNTGCAAWSKMYRVHDBN"
#: Terminal dinucleotide pairs of canonical introns (fixed values).
CANONICAL = ("GT-AG", "GC-AG", "AT-AC")


def reverse_complement(seq: Column) -> Column:
    """The other strand, in upper case. F3."""
    return F.reverse(F.translate(seq, CODES, COMPLEMENTS))


def py_slice(seq: Column, start: Column | int | None, stop: Column | int | None) -> Column:
    """seq[start:stop] with Python's rules for negative and out-of-range places."""
    n = F.length(seq)

    def place(x: Column | int | None, default: Column) -> Column:
        if x is None:
            return default
        x = F.lit(x) if isinstance(x, int) else x
        return F.when(x < 0, F.greatest(x + n, F.lit(0))).otherwise(F.least(x, n))

    a, b = place(start, F.lit(0)), place(stop, n)
    return F.substring(seq, a + 1, F.greatest(b - a, F.lit(0)))


def span_length(start: Column, stop: Column, seq: Column | None = None) -> Column:
    """Bases of a closed interval; of the sequence where a coordinate is missing or 0. P1."""
    by_place = F.abs(start - stop) + 1
    return by_place if seq is None else F.when(F.coalesce(start, F.lit(0)) * F.coalesce(stop, F.lit(0)) != 0, by_place).otherwise(F.length(seq))


def relative_coords(start: Column, stop: Column, strand: Column, end: str, lo: int, hi: int) -> tuple[Column, Column]:
    """Genomic coordinates of places lo..hi relative to the 5' or 3' end, upstream negative, in ascending order. F4."""
    minus = strand == "-"
    if end == "five":
        a, b = F.when(minus, stop - lo).otherwise(start + lo), F.when(minus, stop - hi).otherwise(start + hi)
    else:
        a, b = F.when(minus, start - lo).otherwise(stop + lo), F.when(minus, start - hi).otherwise(stop + hi)
    return F.least(a, b), F.greatest(a, b)


def valid_bases(seq: Column) -> Column:
    """No character but A, C, G and T; an empty string is valid. P4."""
    return ~seq.rlike("[^ACGT]")


def terminal_pair(seq: Column) -> Column:
    """First and last two bases as XX-YY."""
    return F.concat(F.substring(seq, 1, 2), F.lit("-"), py_slice(seq, -2, None))


def is_canonical(pair: Column) -> Column:
    """P5."""
    return pair.isin(*CANONICAL)


def longest_run(text: Column, chars: str) -> Column:
    """Length of the longest run of characters of a regular-expression class; 0 without one. F7."""
    runs = F.regexp_extract_all(text, F.lit(f"([{chars}]+)"), F.lit(1))
    return F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0))


def kmers(seq: Column, width: int) -> Column:
    """All windows of so many characters, left to right; none where the text is shorter. W9."""
    n = F.length(seq)
    some = F.transform(F.sequence(F.lit(1), F.greatest(n - width + 1, F.lit(1))), lambda i: F.substring(seq, i, F.lit(width)))
    return F.when(n >= width, some).otherwise(F.array().cast("array<string>"))


def hamming(a: Column, b: Column) -> Column:
    """Places at which two strings of one length differ."""
    return F.aggregate(F.sequence(F.lit(1), F.length(a)), F.lit(0), lambda t, i: t + F.when(F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1)), 0).otherwise(1))


def ambiguous_pair(pair: Column) -> Column:
    """Whether more than one canonical pair is nearest, so the terminal bases say nothing. F12."""
    away = F.array(*[hamming(pair, F.lit(c)) for c in CANONICAL])
    return F.size(F.filter(away, lambda d: d == F.array_min(away))) > 1
