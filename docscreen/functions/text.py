"""Text functions as Column expressions: digits, canonical forms, masks."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Code points of the two further digit scripts, and what OCR reads letters for.
ARABIC_DIGITS = "٠١٢٣٤٥٦٧٨٩"
EXTENDED_DIGITS = "۰۱۲۳۴۵۶۷۸۹"
MISREAD = ("OolI|SB", "0011158")
MISREAD_ALL = ("OolI|SBZ", "00111582")
DIACRITICS = "[ؐ-ًؚ-ٰٟۖ-ۭـ]"
LETTERS = ("إأآٱةىؤئ،؛：", "ااااهيوي,;:")
#: Texts of these characters alone are composed already (a test proves it); and what Python's \s has beyond Java's.
COMPOSED = r"^[\x00-\x7f،؛؟ء-غف-ي٠-٩]*$"
BLANKS = r"[\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
EDGE = r"\s:：;؛.,'\"_\-"
TRUTHY = ("yes", "y", "true", "1", "نعم")


def normalize_digits(c: Column) -> Column:
    """Both Arabic digit scripts to ASCII."""
    return F.translate(c, ARABIC_DIGITS + EXTENDED_DIGITS, "0123456789" * 2)


def numeric_only(c: Column) -> Column:
    """Digits of a field after repairing misread letters."""
    return F.regexp_replace(F.translate(normalize_digits(c), *MISREAD_ALL), "[^0-9]", "")


def numeric_with_separators(c: Column) -> Column:
    """As numeric_only without Z, but what is no digit, slash, blank, hyphen or dot becomes a blank."""
    return F.regexp_replace(F.translate(normalize_digits(F.coalesce(c, F.lit(""))), *MISREAD), r"[^0-9/ \-.]", " ")


def digit_chunks(c: Column) -> Column:
    return F.regexp_extract_all(numeric_with_separators(c), F.lit("([0-9]+)"), F.lit(1))


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    """Unicode compatibility composition, which Spark has no function for."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


@F.pandas_udf(T.ArrayType(T.StringType()))
def nfkc_each(s: pd.Series) -> pd.Series:
    """As nfkc, of every string of an array."""
    return s.map(lambda xs: None if xs is None else [None if x is None else unicodedata.normalize("NFKC", x) for x in xs])


def canonical(c: Column, compose: bool = True) -> Column:
    """The form that names are compared in. NFKC comes first, in an Arrow batch that gets only the texts it may change;
    compose=False is for texts composed before, as in a lambda, where no batch can run."""
    if compose:
        plain = F.coalesce(c.rlike(COMPOSED), F.lit(True))
        c = F.when(plain, c).otherwise(nfkc(F.when(~plain, c)))
    t = F.regexp_replace(c, DIACRITICS, "")
    return F.lower(F.trim(F.regexp_replace(F.translate(t, *LETTERS), BLANKS, " ")))


def canonical_each(c: Column) -> Column:
    """As canonical, of every string of an array."""
    plain = ~F.exists(c, lambda x: ~F.coalesce(x.rlike(COMPOSED), F.lit(True)))
    c = F.when(plain, c).otherwise(nfkc_each(F.when(~plain, c)))
    return F.transform(c, lambda x: canonical(x, compose=False))


def clean(c: Column) -> Column:
    """Edge punctuation and stray single Arabic letters at the edges go; empty becomes null."""
    t = F.regexp_replace(c, f"^[{EDGE}]+|[{EDGE}]+$", "")
    t = F.regexp_replace(F.regexp_replace(t, r"\s+", " "), r"^(?:[ء-ي]\s+)+", "")
    return F.nullif(F.regexp_replace(t, r"(?:\s+[ء-ي])+$", ""), F.lit(""))


def has_arabic(c: Column) -> Column:
    return F.coalesce(c.rlike(r"[؀-ۿ]"), F.lit(False))


def has_latin(c: Column) -> Column:
    return F.coalesce(c.rlike("[A-Za-z]"), F.lit(False))


def mask_id(c: Column, keep: int = 4) -> Column:
    """The first characters and a star for each other; nothing but stars if there are no others."""
    n = F.length(c)
    return F.when(n == 0, c).when(n <= keep, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.left(c, F.lit(keep)), F.repeat(F.lit("*"), F.greatest(n - keep, F.lit(0)))))


def mask_identifiers(c: Column) -> Column:
    """Masks every run of exactly ten digits of a text, in either script."""
    return F.regexp_replace(c, "(?<![0-9٠-٩])([0-9٠-٩]{4})[0-9٠-٩]{6}(?![0-9٠-٩])", "$1******")


def aliases(c: Column) -> Column:
    """A list written with pipes: trimmed, without empties."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), "[|]"), lambda x: F.trim(x)), lambda x: x != "")


def truthy(c: Column, empty: bool = False) -> Column:
    """yes-like words; empty says what an empty cell means."""
    t = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return t.isin(*TRUTHY) | ((t == "") & F.lit(empty))


def find_ten_digit_numbers(c: Column) -> Column:
    return F.regexp_extract_all(normalize_digits(c), F.lit("(?<![0-9])([0-9]{10})(?![0-9])"), F.lit(1))
