"""String clean-up expressions."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# Cells that mean "missing" in the raw form, before trimming.
# "NA" is absent on purpose, it is an ordinary category.
NULL_TOKENS = ("", " ", "nan", "NaN", "null", "NULL", "none", "None")

# Words that stand for a boolean.
TRUE_WORDS = ("yes", "y", "true", "t", "1")
FALSE_WORDS = ("no", "n", "false", "f", "0")

# Words that make a string column "binary" in a profile.
BINARY_WORDS = ("yes", "no", "true", "false", "0", "1", "y", "n")

# Fixed value: template text left unfilled in a document.
PLACEHOLDER = r"(?i)^\((enter|verify).*\)$"

# Fixed value: white space, Unicode's included. Spelled out because the regex
# flag for it makes every match several times slower.
BLANK = r" \t\f\u000b\u001c-\u001f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WHITE = BLANK + r"\r\n"
ASCII_TABS = r"\t\f\u000b\u001c\u001d\u001e\u001f"

NUMBER = r"^\s*[+-]?((\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|(?i:inf(inity)?))\s*$"
WHOLE_NUMBER = r"^\s*[+-]?\d+\s*$"


def missing_to_null(c: Column, tokens=NULL_TOKENS) -> Column:
    return F.when(~c.isin(*tokens), c)


def single_spaced(c: Column, lines: bool = False) -> Column:
    """Every run of white space as one space, line breaks only with ``lines``.

    Single spaces are left where they are, and texts in ASCII are looked through with a set that
    needs one table look-up a character.
    """
    breaks = r"\r\n" if lines else ""

    def pattern(blank: str) -> str:
        return f" [ {blank}{breaks}]+|[{blank}{breaks}][ {blank}{breaks}]*"

    plain = F.regexp_replace(c, pattern(ASCII_TABS), " ")
    return F.when(F.octet_length(c) == F.length(c), plain).otherwise(F.regexp_replace(c, pattern(BLANK[1:]), " "))


def squish(c: Column) -> Column:
    """Trim and collapse white space; an empty result becomes null."""
    return F.nullif(F.trim(single_spaced(c, lines=True)), F.lit(""))


def without_placeholder(c: Column) -> Column:
    clean = squish(c)
    return F.when(~clean.rlike(PLACEHOLDER), clean)


def is_bool_word(c: Column) -> Column:
    return F.lower(F.trim(c)).isin(*TRUE_WORDS, *FALSE_WORDS)


def bool_word_to_int(c: Column) -> Column:
    word = F.lower(F.trim(c))
    return F.when(word.isin(*TRUE_WORDS), F.lit(1)).when(word.isin(*FALSE_WORDS), F.lit(0)).cast("bigint")


def parse_double(c: Column) -> Column:
    """A double, or null for anything that is not a plain number."""
    return F.when(c.rlike(NUMBER), c.try_cast("double"))


def pseudonym(c: Column) -> Column:
    """First 16 hex digits of SHA-256 of the string form; null stays null."""
    return F.substring(F.sha2(c.cast("string"), 256), 1, 16)


def slug_text(text: str) -> str:
    """ASCII letters and digits in lower case, joined by single underscores."""
    plain = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode("ascii")
    return "_".join(re.findall(r"[a-z0-9]+", plain.lower())) or "col"


@F.pandas_udf(T.StringType())
def slug(values: pd.Series) -> pd.Series:
    """``slug_text`` over a column; Spark SQL has no Unicode decomposition.

    Keys repeat a lot, so each batch slugs its distinct values once.
    """
    codes, distinct = pd.factorize(values)
    slugs = pd.Series([slug_text(v) for v in distinct] + [None], dtype=object)
    return slugs.take(codes).reset_index(drop=True)
