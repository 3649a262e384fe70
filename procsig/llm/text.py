"""Column expressions and SQL fragments that several text operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: The word classes (everything but ASCII white space; ASCII letters, digits and
#: all non-ASCII characters).
SPACE_WORD = r"[^\x20\x09-\x0D]+"
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPACE_CHARS = " \t\n\x0b\f\r"


def ascii_lower(c: Column) -> Column:
    """A-Z in lower case, every other character as it is (``lower`` would change É too)."""
    return F.translate(c, UPPER, LOWER)


def space_words(c: Column) -> Column:
    """The words of ``SPACE_WORD`` in order; NULL has none. A translation and a split, no regular expression."""
    others = SPACE_CHARS.replace(" ", "")
    return F.array_remove(F.split(F.translate(F.coalesce(c, F.lit("")), others, " " * len(others)), " "), "")


_BREAKS = "".join(chr(i) for i in range(128) if not chr(i).isalnum())


def alnum_words(c: Column) -> Column:
    """The words of ``ALNUM_WORD`` in ASCII lower case."""
    spaced = F.translate(F.coalesce(c, F.lit("")), UPPER + _BREAKS, LOWER + " " * len(_BREAKS))
    return F.array_remove(F.split(spaced, " "), "")


def sql_words(expr: str, pattern: str) -> str:
    return f"regexp_extract_all(coalesce({expr}, ''), '{pattern}')"


def sql_ascii_lower(expr: str) -> str:
    return f"translate({expr}, '{UPPER}', '{LOWER}')"


def packed(docs: DataFrame) -> DataFrame:
    """``doc_id, text, text_key, row_of``: whole rows as one struct, so that no column name can clash."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"), whole.alias("row_of"))
