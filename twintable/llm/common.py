"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from twintable.session import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder below the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"


def open_folder(uri: str) -> tuple[FileSystem, str]:
    if uri.startswith("file:/"):
        uri = "file:///" + uri[5:].lstrip("/")
    return FileSystem.from_uri(uri)


def keep(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends there."""
    path = scratch(df.sparkSession)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def utf8(text: Column) -> Column:
    """Bytes of a text, none for null."""
    return F.coalesce(F.encode(text, "UTF-8"), F.lit(b""))


def modest_batches(spark: SparkSession, rows: int = 1000) -> None:
    """At most ``rows`` rows in a batch that goes to Python, as a row may hold a long text.

    A setting of the session that changes no result; a smaller one stays.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(name, rows)


def release() -> None:
    """Gives freed memory back to the machine; a worker otherwise holds it while it waits for its next task."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows whose ``column`` holds about ``limit`` bytes; a longer value comes alone."""
    values = batch.column(batch.schema.get_field_index(column))
    sizes = pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if start < batch.num_rows:
        yield batch.slice(start)
    release()


def whole_groups(df: DataFrame, keys: list[str], fn: Callable, schema: str, rows: int = 4096) -> DataFrame:
    """``fn(table, starts)`` over tables that hold whole groups of ``keys``, many at a time.

    Rows of a key lie together after one shuffle and a sort, so tables are cut only between
    groups; a caller bounds the groups by what it puts into the keys. ``starts`` are the rows
    at which groups begin, with the number of rows at the end.
    """

    def run(batches):
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.schema.names
            tail = tuple(batch.column(names.index(k))[batch.num_rows - 1].as_py() for k in keys)
            if sum(b.num_rows for b in held) + batch.num_rows >= rows and (held or tail is not None):
                edge = _last_group(batch, keys)
                if edge or (held and last != tail):
                    if edge:
                        held.append(batch.slice(0, edge))
                    yield from _call(fn, held, keys)
                    held = [batch.slice(edge)]
                    last = tail
                    continue
            held.append(batch)
            last = tail
        if held:
            yield from _call(fn, held, keys)

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def _changes(batch, keys) -> np.ndarray:
    """Rows that differ from the one before in a key."""
    n = batch.num_rows
    out = np.zeros(max(n - 1, 0), dtype=bool)
    for k in keys:
        c = batch.column(k)
        if isinstance(c, pa.ChunkedArray):
            c = c.combine_chunks()
        out |= np.asarray(pc.fill_null(pc.not_equal(c.slice(1), c.slice(0, n - 1)), True).to_numpy(zero_copy_only=False), dtype=bool)
    return np.flatnonzero(out) + 1


def _last_group(batch, keys) -> int:
    found = _changes(batch, keys)
    return int(found[-1]) if len(found) else 0


def _call(fn, held, keys):
    whole = pa.Table.from_batches(held).combine_chunks()
    starts = np.concatenate([[0], _changes(whole, keys), [whole.num_rows]])
    for out in fn(whole, starts):
        yield from out.to_batches() if isinstance(out, pa.Table) else [out]


def fixed(column) -> np.ndarray:
    """A binary column whose values have one length as rows of bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 0), dtype=np.uint8)
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), -1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads all bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of ``n`` vertices the smallest one that the pairs connect it to."""
    root = np.arange(n)
    while len(i):
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, root[i], low)
        np.minimum.at(root, root[j], low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
        if (root == before).all():
            break
    return root
