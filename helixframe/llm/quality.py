"""Quality rules: a table of thresholds that compiles into one projection of built-in functions.

Each rule bounds one whole-text measure. Ratios are compared as integers (100 * part > percent * whole), so no
rule depends on rounding. The compiled projection has no user function, join or shuffle: the scan feeds it and
it emits one row per document, whatever the size of the corpus.

Defined results: a null or empty text has no words, fails the word-count rule and is rejected; repeated rows and
ties are judged row by row; without a `lang`, a text counts as one in a covered language; extra columns pass through `annotate` untouched unless they are named like one of its
outputs, which then replace them; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import text_or_empty

SYMBOLS = "[#*$%&|<>]"

#: The languages that STOP_WORDS and the bound on long words are made for, and codes that name no language.
COVERED = ("en", "de", "fr", "es", "eng", "deu", "ger", "fra", "fre", "spa")
NO_LANGUAGE = ("und", "mul", "mis", "zxx", "unk", "xx", "xxx")
#: Frequent function words of the four languages of the corpora (fixed values).
STOP_WORDS = (
    "the be to of and that have with is was for are on in a by from at as or it "
    "der die das und ein eine ist von zu mit den im für auf sich des dem nicht auch es "
    "le la les de des un une et est que qui en dans pour pas sur avec par du il elle "
    "el los las una y que en un por con para su se del lo no al es como más o"
).split()


@dataclass(frozen=True)
class Rule:
    """Reject a document when 100 * part is above max_percent (or below min_percent) of whole (empty: of 1).

    min_words: the rule doesn't speak about texts with fewer words.
    covered: nor, if this is set, about texts whose `lang` names a language other than COVERED.
    """

    name: str
    part: str
    whole: str
    max_percent: int | None = None
    min_percent: int | None = None
    min_words: int = 0
    covered: bool = False

    def fails(self, elsewhere: Column) -> Column:
        part, whole = F.col(self.part) * 100, F.col(self.whole) if self.whole else F.lit(1)
        out = part > whole * self.max_percent if self.max_percent is not None else part < whole * self.min_percent
        out = out & (F.col("n_words") >= self.min_words) if self.min_words else out
        return out & ~elsewhere if self.covered else out


#: The threshold table. The first two are the base rules.
RULES = (
    Rule("few_words", "n_words", "", min_percent=1000),
    Rule("repeated_windows", "n_repeat_words", "n_words", max_percent=20),
    Rule("symbols", "n_symbols", "n_words", max_percent=25, min_words=10),
    Rule("short_words", "word_chars", "n_words", min_percent=200, min_words=10),
    Rule("long_words", "word_chars", "n_words", max_percent=1500, min_words=10, covered=True),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", max_percent=50, min_words=10),
    Rule("stop_words", "n_stop_words", "n_words", min_percent=2, min_words=40, covered=True),
)
BASE_RULES = ("few_words", "repeated_windows")
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words")


def _window_hashes(word_hashes: Column, n: Column) -> Column:
    """One 64-bit hash for each 5-word window, in text order. Windows are compared within one text only."""
    none = F.array().cast("array<bigint>")
    return F.when(n < 5, none).otherwise(
        F.transform(
            F.slice(word_hashes, 1, F.greatest(n - 4, F.lit(0))),
            lambda h, i: F.xxhash64(h, F.get(word_hashes, i + 1), F.get(word_hashes, i + 2), F.get(word_hashes, i + 3), F.get(word_hashes, i + 4)),
        )
    )


def _covered(windows: Column) -> Column:
    """Words in windows that occur twice or more: the union of [i, i + 5) over those windows' places."""
    placed = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    near = lambda s, j, step: F.coalesce(F.get(s, j + step)["h"], F.lit(None).cast("bigint"))

    def of(s: Column) -> Column:
        twice = F.filter(s, lambda e, j: F.coalesce((j > 0) & (near(s, F.greatest(j - 1, F.lit(0)), 0) == e["h"]), F.lit(False)) | F.coalesce(near(s, j, 1) == e["h"], F.lit(False)))
        at = F.array_sort(F.transform(twice, lambda e: e["i"]))
        start = F.struct(F.lit(-5).cast("int").alias("last"), F.lit(0).cast("bigint").alias("n"))
        return F.aggregate(at, start, lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(5), i - a["last"])).alias("n")), lambda a: a["n"])

    # the sorted array is bound once, as the single element that transform() visits
    return F.get(F.transform(F.array(placed), of), 0)


def measures(df: DataFrame, text: str = "text") -> DataFrame:
    """df with MEASURES; works in three projections so that each array is built once for a row."""
    df = df.withColumns({"__text": text_or_empty(text)})
    df = df.withColumns(
        {
            "__words": F.filter(F.split("__text", r"[\x20\x09-\x0D]+"), lambda w: w != ""),
            "__lines": F.filter(F.split("__text", "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\f\r")) != ""),
            "__symbols": F.length("__text") - F.length(F.regexp_replace("__text", SYMBOLS, "")),
        }
    )
    n = F.size("__words")
    df = df.withColumns({"__hashes": F.transform("__words", lambda w: F.xxhash64(w))})
    df = df.withColumns({"__windows": _window_hashes(F.col("__hashes"), n)})
    repeats = F.size("__windows") > F.size(F.array_distinct("__windows"))
    df = df.withColumns(
        {
            "n_words": n.cast("bigint"),
            "word_chars": F.length(F.array_join("__words", "")).cast("bigint"),
            "n_symbols": F.col("__symbols").cast("bigint"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint"),
            "n_repeat_words": F.when(repeats, _covered(F.col("__windows"))).otherwise(F.lit(0).cast("bigint")),
            "n_lines": F.size("__lines").cast("bigint"),
            "n_stop_words": F.size(F.filter("__words", lambda w: F.lower(w).isin(STOP_WORDS))).cast("bigint"),
        }
    )
    return df.drop("__text", "__words", "__lines", "__symbols", "__hashes", "__windows")


def _elsewhere(df: DataFrame) -> Column:
    """Whether `lang` (a code, with a region or not) names a language other than COVERED; not if it names none."""
    if "lang" not in df.columns:
        return F.lit(False)
    code = F.lower(F.regexp_extract(F.coalesce(F.col("lang").cast("string"), F.lit("")), "^([A-Za-z]{2,3})(?:[-_].*)?$", 1))
    return (code != "") & ~code.isin(*COVERED, *NO_LANGUAGE)


def annotate(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """df with its measures, failed_rules (comma-joined names, in table order), base_failed and kept."""
    df = measures(df, text)
    elsewhere = _elsewhere(df)
    named = [F.when(r.fails(elsewhere), F.lit(r.name)) for r in rules]
    base = [r.fails(elsewhere) for r in rules if r.name in BASE_RULES]
    df = df.withColumns({"failed_rules": F.concat_ws(",", *named), "base_failed": base[0] | base[1] if len(base) == 2 else F.lit(False)})
    return df.withColumns({"kept": F.col("failed_rules") == ""})


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The pipeline's stage: documents that no rule rejects, with the columns they came with, whatever their names."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(f"`{text}`").alias("text"), *(["lang"] if "lang" in docs.columns else []))
    # a filter moves below a projection by copying its expressions, here a dozen arrays many times over; it can't pass a
    # projection that numbers rows
    judged = annotate(packed, rules).select("__row", "kept", F.monotonically_increasing_id().alias("__number"))
    return judged.where("kept and __number >= 0").select("__row.*")
