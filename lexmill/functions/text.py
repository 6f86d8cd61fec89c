"""Text normalisation, hashing and shingles as column expressions.

Latin-1 text stays in the JVM. Only rows with other characters reach an Arrow UDF, because Spark has
neither Unicode normalisation nor case folding.
"""

from __future__ import annotations

import ast
import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

#: Every code point that separates words, fixed by Unicode.
SPACES = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_LATIN = r"^[\x{00}-\x{ff}]*$"


@F.pandas_udf(T.StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


@F.pandas_udf(T.StringType())
def _fold(s: pd.Series) -> pd.Series:
    return s.map(str.casefold, na_action="ignore")


@F.pandas_udf(T.StringType())
def _nfc_fold(s: pd.Series) -> pd.Series:
    return s.map(lambda t: unicodedata.normalize("NFC", t).casefold(), na_action="ignore")


def _beyond_latin(text: Column, udf, native: Column) -> Column:
    latin = text.rlike(_LATIN)
    return F.when(latin, native).otherwise(udf(F.when(~latin, text)))


def nfc(text: Column) -> Column:
    return _beyond_latin(text, _nfc, text)


def _latin_fold(text: Column) -> Column:
    return F.replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), F.lit("µ"), F.lit("μ"))


def casefold(text: Column) -> Column:
    return _beyond_latin(text, _fold, _latin_fold(text))


def normalize(text: Column, unicode: bool = True) -> Column:
    """NFC (unless ``unicode`` is off), no NUL, and CRLF or CR as LF."""
    t = nfc(text) if unicode else text
    return F.replace(F.replace(F.replace(t, F.lit("\x00"), F.lit("")), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def collapse(text: Column) -> Column:
    """Words separated by single blanks."""
    return F.array_join(words(text), " ")


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACES + "+"), lambda w: w != "")


def canonical(text: Column, unicode: bool = True) -> Column:
    """Folded and collapsed; with NFC first unless ``unicode`` is off."""
    folded = _beyond_latin(text, _nfc_fold if unicode else _fold, _latin_fold(text))
    return collapse(folded)


def strip(text: Column) -> Column:
    """Without outer Unicode white space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"^{SPACES}+|{SPACES}+$", "")


def text_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def shingles(canonical_text: Column, n: int = 5) -> Column:
    """Distinct word n-grams; one shingle of all words for fewer than n; none for an empty text."""
    def build(w: Column) -> Column:
        k = F.size(w)
        grams = F.transform(F.sequence(F.lit(1), k - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(k >= n, grams).when(k > 0, F.array(F.array_join(w, " "))).otherwise(F.array().cast("array<string>"))

    parts = F.filter(F.split(canonical_text, " "), lambda w: w != "")
    return F.array_distinct(F.element_at(F.transform(F.array(parts), build), 1))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


#: The names of a model's edits, in order.
VARIANTS = ("P1", "P2", "P3")


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("variant", T.StringType()), T.StructField("text", T.StringType())])))
def literal_variants(s: pd.Series) -> pd.Series:
    """Parses Python-literal lists of {name: text}, names in VARIANTS: malformed or foreign values give [], and
    values that are not strings or are blank are dropped; values are kept as they are."""

    def one(t: str | None) -> list[dict[str, str]]:
        try:
            items = ast.literal_eval(t) if isinstance(t, str) else []
        except (ValueError, SyntaxError, MemoryError, RecursionError):
            return []
        if not isinstance(items, (list, tuple)):
            return []
        return [{"variant": k, "text": v} for d in items if isinstance(d, dict) for k in VARIANTS for v in [d.get(k)] if isinstance(v, str) and v.strip()]

    return s.map(one)


def literal_variants_of(text: Column) -> Column:
    return literal_variants(F.coalesce(text, F.lit("")))
