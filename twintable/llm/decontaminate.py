"""Benchmark items in documents by pigeonhole edit matching.

An item may differ from its place in a document by ``budget`` edits. Cut into budget + 1
pieces, at least one piece must appear unchanged; all pieces of all items are looked up in
one pass over a document, and what surrounds a hit is checked by Myers' bit-parallel distance.
"""

from __future__ import annotations

from collections import defaultdict
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: ASCII letters in lower case, digits and all bytes beyond ASCII stay, the rest are gaps.
_KEPT = bytes((c if chr(c).isalnum() or c >= 128 else 32) for c in range(256))
#: Characters of items that one pass over the documents looks for.
PASS_CHARS = 8 << 20


def normalise(text: str | None) -> str:
    """Lower case, runs of other characters as one space; a character per UTF-8 byte."""
    return b" ".join((text or "").lower().encode("utf-8", "surrogatepass").translate(_KEPT).split()).decode("latin-1")


def edit_budget(length: int, share: float) -> int:
    return int(length * share)


def cut(item: str, budget: int) -> list[tuple[int, str]]:
    """``item`` as budget + 1 pieces of nearly equal length, with their offsets."""
    n = min(budget + 1, len(item))
    at = [len(item) * i // n for i in range(n + 1)]
    return [(at[i], item[at[i] : at[i + 1]]) for i in range(n)]


def myers(pattern: str, text: str) -> tuple[int, int]:
    """Least edit distance of ``pattern`` to any part of ``text``, and where that part ends first.

    The column of the distance table is held as two bit vectors of the pattern's length.
    """
    size = len(pattern)
    if not size:
        return 0, 0
    where: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        where[c] |= 1 << i
    full, top = (1 << size) - 1, 1 << (size - 1)
    plus, minus, now, best, end = full, 0, size, size, 0
    for i, c in enumerate(text):
        equal = where.get(c, 0)
        across = (((equal & plus) + plus) ^ plus) | equal
        down = equal | minus
        up_plus = (minus | ~(across | plus)) & full
        up_minus = plus & across
        if up_plus & top:
            now += 1
        elif up_minus & top:
            now -= 1
        up_plus, up_minus = (up_plus << 1) & full, (up_minus << 1) & full
        plus = (up_minus | ~(down | up_plus)) & full
        minus = up_plus & down
        if now < best:
            best, end = now, i + 1
    return best, end


@lru_cache(maxsize=2)
def _automaton(items: tuple[tuple[int, str], ...], share: float) -> ahocorasick.Automaton:
    found: dict[str, list] = defaultdict(list)
    for item, text in items:
        for offset, piece in cut(text, edit_budget(len(text), share)):
            found[piece].append((item, offset, text))
    out = ahocorasick.Automaton()
    for piece, places in found.items():
        out.add_word(piece, (len(piece), places))
    out.make_automaton()
    return out


def matches(text: str, automaton: ahocorasick.Automaton, share: float) -> dict[int, int]:
    """Items within their budget of a part of ``text``, with the least distance."""
    best: dict[int, int] = {}
    seen: dict[int, tuple[int, int]] = {}  # the last window checked of an item
    for end, (size, places) in automaton.iter(text):
        for item, offset, pattern in places:
            if best.get(item) == 0:
                continue
            budget = edit_budget(len(pattern), share)
            start = end + 1 - size - offset
            window = (max(0, start - budget), min(len(text), start + len(pattern) + budget))
            if item in seen and seen[item][0] <= window[0] and window[1] <= seen[item][1]:
                continue
            seen[item] = window
            distance = 0 if text.startswith(pattern, start) and start >= 0 else myers(pattern, text[window[0] : window[1]])[0]
            if distance <= budget and distance < best.get(item, budget + 1):
                best[item] = distance
    return best


def contaminated(documents: DataFrame, benchmark: DataFrame, share: float = 0.05, min_chars: int = 24, into: str = "items") -> DataFrame:
    """``documents`` with a column ``into``, an array of (item_id, distance) by item, empty for clean ones.

    ``documents`` have a ``text`` and any other columns but ``into``. An item matches within
    ``share`` of its normalised length in edits. Items shorter than ``min_chars`` after
    normalising say too little and are not looked for, nor are null ones; repeated items
    count once under each id, null ids not at all. Null and empty documents match nothing.
    Rows are not moved: the items go to the executors in passes of ``PASS_CHARS``
    characters, whatever their number.
    """
    passes, held = [[]], 0
    for item, text in benchmark.where("item_id is not null").select("item_id", "text").distinct().sort("item_id", "text").toLocalIterator():
        text = normalise(text)
        if len(text) < min_chars:
            continue
        if held and held + len(text) > PASS_CHARS:
            passes.append([])
            held = 0
        passes[-1].append((int(item), text))
        held += len(text)
    out = documents.withColumn(into, F.array().cast("array<struct<item_id:long,distance:int>>"))
    for items in filter(None, passes):
        out = out.mapInArrow(_pass(tuple(items), share, into), out.schema)
    return out


def _pass(items: tuple[tuple[int, str], ...], share: float, into: str):
    def run(batches):
        automaton = _automaton(items, share)
        for batch in batches:
            names = batch.schema.names
            at = names.index(into)
            found = []
            for text, old in zip(batch.column(names.index("text")), batch.column(at).to_pylist(), strict=True):
                merged = {x["item_id"]: x["distance"] for x in old or []}
                for item, distance in matches(normalise(text.as_py()), automaton, share).items():
                    merged[item] = min(distance, merged.get(item, distance))
                found.append([{"item_id": i, "distance": d} for i, d in sorted(merged.items())])
            yield batch.set_column(at, into, pa.array(found, type=batch.schema.types[at]))

    return run


def decontaminate(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that match no item, with all their columns."""
    into = "items"
    while into in documents.columns:
        into += "_"
    return contaminated(documents, benchmark, into=into, **options).where(F.size(into) == 0).drop(into)
