"""Text identity: scripts, literal text, agreement text, similarity."""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

# Python's unicode tables define the script rule; above this plane there are no
# Latin, Cyrillic or Hangul letters.
_SCRIPT_SCAN_END = 0x30000


@lru_cache(maxsize=None)
def letter_class(script_word: str) -> str:
    """Body of a regex class with every letter whose Unicode name has the word.

    Ranges are written as ``\\x{..}`` escapes, which the Java regex engine and
    RE2 read the same way.
    """
    points = (
        cp
        for cp in range(_SCRIPT_SCAN_END)
        if chr(cp).isalpha() and script_word in unicodedata.name(chr(cp), "")
    )
    spans: list[list[int]] = []
    for cp in points:
        if spans and cp == spans[-1][1] + 1:
            spans[-1][1] = cp
        else:
            spans.append([cp, cp])
    return "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in spans)


# The code points that count as white space, as the body of a regex class.
BLANKS = (
    r"\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)

# Below U+0300 every string is already NFC, and only these five letters have a
# full casefold that differs from lower-casing.
_BEYOND_SIMPLE = "[\\x{300}-\\x{10FFFF}]"
_BEYOND_SIMPLE_FOLD = "[\\x{300}-\\x{10FFFF}\\x{B5}\\x{DF}\\x{149}\\x{17F}\\x{1F0}]"


@F.pandas_udf(StringType())
def _nfc_udf(text: pd.Series) -> pd.Series:
    return text.map(lambda s: unicodedata.normalize("NFC", s), na_action="ignore")


@F.pandas_udf(StringType())
def _fold_udf(text: pd.Series) -> pd.Series:
    return text.map(
        lambda s: unicodedata.normalize("NFC", s).casefold(), na_action="ignore"
    )


@F.pandas_udf(StringType())
def _agreement_udf(text: pd.Series) -> pd.Series:
    def one(s: str) -> str:
        kept = filter(str.isalnum, unicodedata.normalize("NFC", s))
        return "".join(ch.casefold() for ch in kept)

    return text.map(one, na_action="ignore")


def _unicode_path(text: Column, pattern: str, udf, plain: Column) -> Column:
    """Send only the rows that match ``pattern`` through the Arrow UDF."""
    # ASCII texts are told apart by their byte length, before any pattern runs
    hard = ~is_ascii(text) & text.rlike(pattern)
    return F.when(hard, udf(F.when(hard, text))).otherwise(plain)


def is_blank(text: Column) -> Column:
    """True for an empty text and one of white space only, null for null."""
    return ~text.rlike(f"[^{BLANKS}]")


def nfc(text: Column) -> Column:
    return _unicode_path(text, _BEYOND_SIMPLE, _nfc_udf, text)


def casefold(text: Column) -> Column:
    """NFC followed by full case folding."""
    return _unicode_path(text, _BEYOND_SIMPLE_FOLD, _fold_udf, F.lower(text))


def agreement_text(text: Column) -> Column:
    """Letters and digits only, case-folded: the key used to compare readings."""
    plain = F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))
    return _unicode_path(text, _BEYOND_SIMPLE_FOLD, _agreement_udf, plain)


def literal_text(text: Column) -> Column:
    """Unified newlines, NFC, nothing else changed."""
    return nfc(F.regexp_replace(text, "\r\n?", "\n"))


def _beyond_ascii(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x00-\x7F]+", "")


def _letters(rest: Column, script_word: str) -> Column:
    return F.length(F.regexp_replace(rest, f"[^{letter_class(script_word)}]+", ""))


def is_ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def script_letters(composed: Column) -> Column:
    """struct<latin, cyrillic> letter counts of an NFC text column."""
    # ASCII letters are counted apart: the wide classes only see what is left
    plain = is_ascii(composed)
    ascii_latin = F.length(F.regexp_replace(composed, "[^A-Za-z]+", ""))
    rest = _beyond_ascii(composed)
    return F.struct(
        F.when(plain, ascii_latin).otherwise(ascii_latin + _letters(rest, "LATIN")).alias("latin"),
        F.when(plain, F.lit(0)).otherwise(_letters(rest, "CYRILLIC")).alias("cyrillic"),
    )


def script_label(text: Column) -> Column:
    """``korean``/``cyrillic``/``latin`` joined by ``+``; ``other`` if none."""
    parts = [
        F.when(text.rlike(f"[{letter_class(word)}]"), F.lit(label))
        for label, word in (("korean", "HANGUL"), ("cyrillic", "CYRILLIC"), ("latin", "LATIN"))
    ]
    joined = F.concat_ws("+", *parts)
    return F.when(joined == "", F.lit("other")).otherwise(joined)


def clamp_confidence(value: Column) -> Column:
    """Confidence in [0, 1]; null, unparsable, NaN and infinite become 0."""
    number = value.try_cast("double")
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) != F.lit(float("inf")))
    return F.when(finite, F.least(F.lit(1.0), F.greatest(F.lit(0.0), number))).otherwise(
        F.lit(0.0)
    )


def short_text(text: Column, limit: int = 220) -> Column:
    compact = F.trim(F.regexp_replace(text, f"[{BLANKS}]+", " "))
    return F.when(F.length(compact) <= limit, compact).otherwise(
        F.concat(F.substring(compact, 1, limit - 1), F.lit("…"))
    )


@F.pandas_udf(DoubleType())
def similarity(left: pd.Series, right: pd.Series) -> pd.Series:
    """Matching-block ratio of two texts; not symmetric, keep the earlier one left."""
    return pd.Series(
        [SequenceMatcher(None, a, b).ratio() for a, b in zip(left, right)], dtype="float64"
    )
