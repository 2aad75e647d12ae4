"""Text normalisation, n-grams and content identity. Column expressions; NFKC alone needs Python."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NUL = "\x00"


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility normalisation (Spark has no built-in for it)."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def spaces_collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normalized_text(text: Column) -> Column:
    """NFKC, line ends as LF, no blanks before them, runs of blanks and tabs as one blank, trimmed."""
    t = F.regexp_replace(nfkc(text), r"\r\n?", "\n")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[ \t]+\n", "\n"), r"[ \t]+", " "))


def comparison_key(text: Column) -> Column:
    """Trimmed, A-Z in lower case; other letters stay."""
    return F.translate(F.trim(text), UPPER, SMALL)


def match_key(text: Column) -> Column:
    """What linkage compares: lower case without white space."""
    return F.regexp_replace(F.lower(text), r"\s+", "")


def narrowed(text: Column) -> Column:
    """Full-width ASCII, dashes and tildes to their plain forms, one character for one."""
    wide = "".join(chr(0xFF01 + i) for i in range(94)) + "　"
    plain = "".join(chr(0x21 + i) for i in range(94)) + " "
    return F.translate(text, wide + "‐‑‒–—―−〜～", plain + "-------~~")


def grams(text: Column, n: int = 2) -> Column:
    """All n-grams in order; a text shorter than n is its own only gram; none of an empty text."""
    # a look-ahead reads each character n times; taking substrings by place would read the text anew for each
    many = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))
    return F.when(F.length(text) > n, many).when(F.length(text) > 0, F.array(text)).otherwise(F.array().cast("array<string>"))


def set_dice(a: Column, b: Column) -> Column:
    """Dice of the distinct elements of two arrays; 0 if both are empty."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    total = F.size(x) + F.size(y)
    return F.when(total > 0, 2.0 * F.size(F.array_intersect(x, y)) / total).otherwise(0.0)


def netstring(text: Column) -> Column:
    return F.concat(F.octet_length(text).cast("string"), F.lit(":"), text, F.lit(","))


def identity(namespace: str, *parts: Column) -> Column:
    """``namespace-`` and 32 hex digits of the SHA-256 of the NUL-joined parts."""
    joined = F.concat_ws(NUL, F.lit(namespace), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.concat(F.lit(f"{namespace}-"), F.substring(F.sha2(F.encode(joined, "UTF-8"), 256), 1, 32))


def column_letter(index: Column) -> Column:
    """Spreadsheet letters of a column from 1 (up to three letters)."""
    digit = lambda v: F.char(F.lit(65) + v.cast("int"))
    i = index.cast("int") - 1
    return F.when(i < 26, digit(i)).when(i < 702, F.concat(digit(F.floor(i / 26) - 1), digit(i % 26))).otherwise(F.concat(digit(F.floor((i - 702) / 676)), digit(F.floor((i - 702) / 26) % 26), digit((i - 702) % 26)))


def canonical_timestamp(text: Column) -> Column:
    """Whether a text is ISO-8601 UTC with milliseconds and survives a round trip."""
    pattern = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
    return F.coalesce(F.date_format(F.try_to_timestamp(text, F.lit(pattern)), pattern) == text, F.lit(False))


def excel_date(serial: Column, base_1904: bool = False) -> Column:
    """Timestamp of a serial day number; null for 60, the day that 1900 did not have."""
    days = serial.cast("double") + (1462 if base_1904 else 0)
    shifted = F.when(days >= 61, days).when(days < 60, days + 1)
    return F.timestamp_micros(((shifted - 25569) * 86_400_000_000).cast("long"))
