"""Names, labels and text columns of the reports."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from helixframe.functions import numbers


def abbreviate(species: str, n: int | tuple[int, int] | None = 3, separator: str = "") -> str:
    """homo_sapiens -> HomSap; one word: its first letter in upper case and the rest. F18."""
    words = [w for w in re.split(r"\W+|_+", species) if w]
    if len(words) < 2:
        return species[:1].upper() + species[1:]
    sizes = (n, n) if not isinstance(n, tuple) else n
    return separator.join(w[:k].capitalize() if k else w.capitalize() for w, k in zip(words[:2], sizes, strict=True))


def or_dot(c: Column | str) -> Column:
    """The value as text, a dot for null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.cast("string"), F.lit("."))


def tsv(*columns: Column | str) -> Column:
    """One line of a headerless report. K1."""
    return F.concat_ws("\t", *[or_dot(c) for c in columns])


def intron_name(species: str, gene: Column, transcript: Column, index: Column, family: Column, omitted: Column, tags: Column) -> Column:
    """species-gene@transcript-intron_i(n);[o:x];tags with ? for unknown parts. F19."""
    known = lambda c: F.coalesce(c.cast("string"), F.lit("?"))
    base = F.concat(F.lit(f"{species}-"), known(gene), F.lit("@"), known(transcript), F.lit("-intron_"), known(index), F.lit("("), known(family), F.lit(")"))
    left_out = F.when(omitted.isNotNull(), F.concat(F.lit("[o:"), omitted, F.lit("]")))
    marks = F.array_join(F.array_sort(tags), "")
    marks = F.when(marks != "", marks)
    return F.concat_ws(";", base, left_out, marks)


def simple_name(species: str, number: Column) -> Column:
    """Uninformative names."""
    return F.concat(F.lit(f"{species}-i_"), number.cast("string"))


def floored(x: Column, digits: int) -> Column:
    """x cut off (towards minus infinity) after so many decimals."""
    return numbers.floor(x * 10**digits) / 10**digits


def plain(x: Column) -> Column:
    """A number with up to three decimals, without an exponent, with one decimal at least."""
    text = F.regexp_replace(numbers.fixed(x), "0+$", "")
    return F.when(text.endswith("."), F.concat(text, F.lit("0"))).otherwise(text)


def label(name: Column, relative: Column) -> Column:
    """name;score% with the relative score floored to three decimals; name;? without one. F20."""
    return F.when(relative.isNull(), F.concat(name, F.lit(";?"))).otherwise(F.concat(name, F.lit(";"), plain(floored(relative, 3)), F.lit("%")))


def motif_string(up: Column, five: Column, bp: Column, bp_u2: Column, three: Column, down: Column) -> Column:
    """up|five...bp/bp_u2...three|down; without branch points that part goes. F21."""
    middle = F.when(bp.isNotNull(), F.concat(bp, F.lit("/"), F.coalesce(bp_u2, F.lit(""))))
    return F.concat(up, F.lit("|"), F.concat_ws("...", five, middle, three), F.lit("|"), down)


def bps_context(region: Column, bp: Column, start: Column) -> Column:
    """The region with the branch point in brackets. F21."""
    return F.concat(F.substring(region, F.lit(1), start), F.lit("["), bp, F.lit("]"), F.substring(region, start + F.length(bp) + 1, F.length(region)))
