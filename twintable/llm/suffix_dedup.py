"""Byte strings of 400 or more that occur more than once, removed from all their places.

1. Each window of 400 bytes has an anchor, the start of the 100 bytes in it of least hash, so equal
   windows have equal anchors. Neighbouring windows with one anchor are a record: the bytes
   they cover, aligned at the anchor. A record whose core, the 100 bytes at the anchor, is
   unique in the corpus holds no repeat; equal records are settled by counting.
2. What is left meets by core. The Burrows-Wheeler order of a collection of records is built
   by columns: each round puts the next symbol to the left in front of every record at once,
   orders the suffixes by it and carries the common prefixes of neighbours along. A window
   is a repeat if its suffix shares 400 bytes with a neighbour.
3. A core with very many different records is cut into records of fewer windows on a grid
   from the anchor, whose core is what all windows of a cell of the grid have in common, down
   to single windows, which are settled by counting; so no collection grows with the corpus.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from twintable.llm.common import keep, mix, slices, utf8, whole_groups

LENGTH = 400
#: Bytes whose hash picks the anchor, and windows that can have one anchor.
GRAM = 100
SPAN = LENGTH - GRAM + 1
#: Records of a collection built by columns; larger ones are cut into an eighth of the windows.
COLLECTION, CUT = 1024, 8
#: Bits of a position within a block of documents.
PLACE = 28
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


class _Rolling:
    """Hashes of any part of some bytes, from sums over powers of two odd bases modulo 2**64."""

    def __init__(self, data: np.ndarray):
        self.sums, self.back = [], []
        with np.errstate(over="ignore"):
            for base in _BASES:
                up = np.full(len(data) + 1, base, dtype=np.uint64)
                down = np.full(len(data) + 1, pow(base, -1, 1 << 64), dtype=np.uint64)
                up[0] = down[0] = 1
                np.multiply.accumulate(up, out=up)
                np.multiply.accumulate(down, out=down)
                self.sums.append(np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1])]))
                self.back.append(down)

    def one(self, start: np.ndarray, end: np.ndarray, which: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sums[which][end] - self.sums[which][start]) * self.back[which][start]

    def of(self, start: np.ndarray, end: np.ndarray, more: np.ndarray) -> np.ndarray:
        """A word of all bits of both hashes, the length and ``more``."""
        with np.errstate(over="ignore"):
            x = mix(self.one(start, end, 0)) + self.one(start, end, 1)
            return mix(mix(x + (end - start).astype(np.uint64)) + more.astype(np.uint64))


def records(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """Records of documents that lie in ``data`` up to ``ends``: document, first window, windows, bytes before the anchor, core and whole hash."""
    none = tuple(np.zeros(0, np.int64) for _ in range(6))
    n = len(data)
    if n < LENGTH:
        return none
    rolling = _Rolling(data)
    at = np.arange(n - GRAM + 1)
    key = (mix(rolling.one(at, at + GRAM, 0)) >> np.uint64(PLACE) << np.uint64(PLACE)) | at.astype(np.uint64)
    blocks = -(-len(key) // SPAN)
    padded = np.full(blocks * SPAN, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[: len(key)] = key
    grid = padded.reshape(blocks, SPAN)
    before = np.minimum.accumulate(grid, axis=1).ravel()
    after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    start = np.arange(n - LENGTH + 1)
    anchor = (np.minimum(after[start], before[start + SPAN - 1]) & np.uint64((1 << PLACE) - 1)).astype(np.int64)
    of = np.searchsorted(ends, start, side="right")
    good = start + LENGTH <= ends[of]
    start, anchor, of = start[good], anchor[good], of[good]
    if not len(start):
        return none
    new = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (of[1:] != of[:-1])))
    first, last = start[new], start[np.append(new[1:], len(start)) - 1]
    left = anchor[new] - first
    core = rolling.of(anchor[new], anchor[new] + GRAM, np.zeros(len(new), np.int64))
    whole = rolling.of(first, last + LENGTH, left)
    begin = np.concatenate([[0], ends[:-1]])[of[new]]
    return of[new], first - begin, last - first + 1, left, core.view(np.int64), whole.view(np.int64)


def _read(batches):
    for batch in batches:
        for part in slices(batch, "bytes", 1 << 20):
            raws = part.column(2).to_pylist()
            ends = np.cumsum([len(r) for r in raws])
            of, first, windows, left, core, whole = records(np.frombuffer(b"".join(raws), dtype=np.uint8), ends)
            at = pa.array(of)
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(at), part.column(1).take(at), pa.array(first), pa.array(windows.astype(np.int32)), pa.array(left.astype(np.int32)), pa.array(core), pa.array(whole)],
                names=["key", "sum", "first", "windows", "left", "core", "whole"],
            )


def repeats_by_columns(data: list[bytes], left: np.ndarray, windows: np.ndarray, group: np.ndarray) -> list[np.ndarray]:
    """Of each record the windows that another record of its group has at the same place.

    Records are aligned at their anchor and sorted by group. Round by round, from the last
    column to the first, every record gets the symbol of that column in front: ``order``
    is the order of the suffixes (whose preceding symbols are the Burrows-Wheeler
    transform) and ``common`` what each shares with the one before it.
    """
    n = len(data)
    before, sizes = int(left.max()), np.array([len(d) for d in data])
    width = before + int((sizes - left).max())
    table = np.zeros((n, width), dtype=np.int16)
    for i, d in enumerate(data):
        table[i, before - left[i] : before - left[i] + len(d)] = np.frombuffer(d, dtype=np.uint8)
        table[i, before - left[i] : before - left[i] + len(d)] += 1
    order, common = np.arange(n), np.zeros(n + 1, dtype=np.int32)
    found = [np.zeros(int(w), dtype=bool) for w in windows]
    flags = np.zeros((n, int(windows.max())), dtype=bool)
    rank = group.astype(np.int64) * 512
    for column in range(width - 1, -1, -1):
        symbol = table[order, column]
        moved = np.argsort(rank[order] + symbol, kind="stable")
        order, symbol = order[moved], symbol[moved]
        alike = np.append(False, (symbol[1:] == symbol[:-1]) & (symbol[1:] > 0) & (group[order][1:] == group[order][:-1]))
        to = np.flatnonzero(alike)
        new = np.zeros(n + 1, dtype=np.int32)
        if len(to):
            # The least common prefix between the two old places.
            pairs = np.column_stack([moved[to - 1] + 1, moved[to] + 1]).ravel()
            new[to] = np.minimum(np.minimum.reduceat(common, pairs)[::2] + 1, LENGTH)
        common = new
        offset = column - before
        best = np.maximum(common[:-1], common[1:])
        hit = order[best >= LENGTH]
        window = offset + left[hit]
        inside = (window >= 0) & (window < windows[hit])
        flags[hit[inside], window[inside]] = True
    for i in range(n):
        found[i] = flags[i, : windows[i]]
    return found


def _runs(flags: np.ndarray) -> list[list[int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.view(np.int8), [0]])))
    return edge.reshape(-1, 2).tolist()


_RUNS = pa.list_(pa.list_(pa.int32()))
_FOUND = "core long, whole long, runs array<array<int>>"


def _by_columns(whole: pa.Table, starts: np.ndarray):
    group = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    begin = 0
    for stop in starts[1:]:
        if stop - begin >= 2048 or stop == whole.num_rows:
            if stop - begin > 1:
                yield from _collection(whole.slice(begin, stop - begin), group[begin:stop])
            begin = stop


def _collection(part: pa.Table, group: np.ndarray):
    found = repeats_by_columns(part.column("data").to_pylist(), part.column("left").to_numpy(), part.column("windows").to_numpy(), group)
    n = part.column("n").to_numpy()
    hit = [i for i in range(len(found)) if n[i] == 1 and found[i].any()]
    if hit:
        at = pa.array(hit)
        yield pa.table({"core": part.column("core").take(at), "whole": part.column("whole").take(at), "runs": pa.array([_runs(found[i]) for i in hit], _RUNS)})


def _word(*parts: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(b"".join(parts), digest_size=8).digest(), "little", signed=True)


def _cut(width: int):
    """Records of at most ``width`` windows, cut at multiples of it from the anchor."""

    def run(batches):
        for batch in batches:
            rows = []
            for core, whole, windows, left, data in zip(*[batch.column(batch.schema.names.index(c)).to_pylist() for c in ("core", "whole", "windows", "left", "data")], strict=True):
                start = 0
                while start < windows:
                    cell = (start - left) // width
                    stop = min(windows, (cell + 1) * width + left)
                    shared = data[(cell + 1) * width - 1 + left : cell * width + LENGTH + left]
                    own, of_cell = data[start : stop - 1 + LENGTH], cell.to_bytes(4, "little", signed=True)
                    here = (start - left).to_bytes(4, "little", signed=True)
                    rows.append((core, whole, start, stop - start, left - start, _word(of_cell, shared), _word(here, own), own))
                    start = stop
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["of_core", "of_whole", "offset", "windows", "left", "core", "whole", "data"])

    return run


def _all(windows: Column) -> Column:
    return F.array(F.array(F.lit(0), windows))


def _resolved(reps: DataFrame, width: int) -> DataFrame:
    """Runs of repeated windows of different records: core, whole, n (places), windows, left, data."""
    reps = keep(reps)
    kinds = keep(reps.groupBy("core").agg(F.count("*").alias("kinds")).where("kinds > 1"))
    known = keep(reps.join(kinds, "core"))
    out = reps.where("n > 1").select("core", "whole", _all(F.col("windows")).alias("runs"))
    small = known.where(F.col("kinds") <= COLLECTION).select("core", "whole", "n", "windows", "left", "data")
    out = out.union(whole_groups(small, ["core"], _by_columns, _FOUND, 2048))
    large = known.where(F.col("kinds") > COLLECTION)
    if width == 1 or large.isEmpty():
        return out
    less = max(1, width // CUT)
    parts = keep(large.select("core", "whole", "windows", "left", "data").mapInArrow(_cut(less), "of_core long, of_whole long, offset int, windows int, left int, core long, whole long, data binary"))
    again = parts.groupBy("core", "whole").agg(F.count("*").alias("n"), F.first("windows").alias("windows"), F.first("left").alias("left"), F.first("data").alias("data"))
    back = parts.select("of_core", "of_whole", "offset", "core", "whole").join(_resolved(again, less), ["core", "whole"])
    moved = F.transform("runs", lambda r: F.transform(r, lambda x: x + F.col("offset")))
    back = back.groupBy("of_core", "of_whole").agg(F.flatten(F.collect_list(moved)).alias("runs"))
    once = large.where("n = 1").select(F.col("core").alias("of_core"), F.col("whole").alias("of_whole"))
    return out.union(back.join(once, ["of_core", "of_whole"]).select("of_core", "of_whole", "runs"))


def _finish(batches):
    """Lengths, removed bytes, removed runs and digest of what is left; runs are of windows, in any order."""
    for batch in batches:
        size, gone, spans, digest = [], [], [], []
        for raw, runs in zip(batch.column(1), batch.column(2).to_pylist(), strict=True):
            data = raw.as_buffer()
            view, sha, at, removed, n = memoryview(data), hashlib.sha256(), 0, 0, 0
            merged: list[list[int]] = []
            for a, b in sorted((r[0], r[1] - 1 + LENGTH) for r in runs or []):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            for a, b in merged:
                sha.update(view[at:a])
                at, removed, n = b, removed + b - a, n + 1
            sha.update(view[at:])
            size.append(len(view))
            gone.append(removed)
            spans.append(n)
            digest.append(sha.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest)], names=["key", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def removed_runs(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, sum (hash of the text), runs: first and end of runs of windows that occur elsewhere in the corpus."""
    kind = dict(df.dtypes)[key]
    docs = df.select(F.col(key).alias("key"), F.xxhash64(text).alias("sum"), utf8(F.col(text)).alias("bytes"))
    found = keep(docs.where(F.octet_length("bytes") >= LENGTH).mapInArrow(_read, f"key {kind}, sum long, first long, windows int, left int, core long, whole long"), "zstd")
    # Written down, so that the join is one of two scans, whose hot cores Spark can split.
    cores = keep(found.groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core"))
    often = keep(found.join(cores, "core"), "zstd")
    place = F.struct("key", "sum", "first")
    each = keep(often.groupBy("core", "whole").agg(F.count("*").alias("n"), F.min(place).alias("place"), F.first("windows").alias("windows"), F.first("left").alias("left")))
    mixed = keep(each.groupBy("core").agg(F.count("*").alias("kinds")).where("kinds > 1").select("core"))
    r, d = keep(each.join(mixed, "core")).alias("r"), docs.alias("d")
    # Texts by key and hash; where rows repeat both, any of them will do.
    texts = d.join(r, F.col("d.key").eqNullSafe(F.col("r.place.key")) & (F.col("d.sum") == F.col("r.place.sum")))
    data = F.substring("d.bytes", (F.col("r.place.first") + 1).cast("int"), F.col("r.windows") - 1 + LENGTH)
    reps = texts.select("r.core", "r.whole", "r.n", "r.windows", "r.left", data.alias("data")).dropDuplicates(["core", "whole"])
    alone = each.where("n > 1").join(mixed, "core", "left_anti").select("core", "whole", _all(F.col("windows")).alias("runs"))
    runs = keep(alone.union(_resolved(reps, SPAN)))
    moved = F.transform("runs", lambda x: F.transform(x, lambda y: (y + F.col("first")).cast("int")))
    placed = often.select("key", "sum", "first", "core", "whole").join(runs, ["core", "whole"]).select("key", "sum", moved.alias("runs"))
    return placed.groupBy("key", "sum").agg(F.flatten(F.collect_set("runs")).alias("runs"))


def remove_repeats(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_removed, n_spans, kept_sha256 for each row of ``df``.

    Every byte of the UTF-8 text that lies in a string of 400 bytes which also starts
    elsewhere, in another row or the same, is removed; ``n_spans`` counts maximal runs of
    them. Repeated rows are elsewhere to each other. Null texts are empty, null keys are
    rows like others, other columns are ignored, an empty table gives an empty result.
    """
    kind = dict(df.dtypes)[key]
    runs = removed_runs(df, key, text).alias("r")
    docs = df.select(F.col(key).alias("key"), F.xxhash64(text).alias("sum"), utf8(F.col(text)).alias("bytes")).alias("d")
    both = docs.join(runs, F.col("d.key").eqNullSafe(F.col("r.key")) & (F.col("d.sum") == F.col("r.sum")), "left")
    out = both.select("d.key", "d.bytes", "r.runs").mapInArrow(_finish, f"key {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.withColumnRenamed("key", key)
