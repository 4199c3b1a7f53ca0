"""Column naming. Works on the name list only; the data is never touched."""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterable

from pyspark.sql import DataFrame

from twintable.functions.text import slug_text


def standard_name(name: str) -> str:
    """Lower case, anything but letters, digits and underscore replaced."""
    return re.sub(r"_+", "_", re.sub(r"\W", "_", name.strip().lower())).strip("_") or "col"


def number_repeats(names: Iterable[str]) -> list[str]:
    """Make names unique by appending ``_2``, ``_3``, ..."""
    uses: Counter[str] = Counter()
    unique: dict[str, None] = {}
    for name in names:
        uses[name] += 1
        numbers = itertools.count(uses[name])
        unique[next(c for n in numbers if (c := f"{name}_{n}" if n > 1 else name) not in unique)] = None
    return list(unique)


def standardize_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*number_repeats(standard_name(c) for c in df.columns))


def slug_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*number_repeats(slug_text(c) for c in df.columns))


def resolve_columns(df: DataFrame, names: Iterable[str]) -> list[str]:
    """The given names in standard form, unknown ones left out."""
    return [n for n in map(standard_name, names) if n in df.columns]
