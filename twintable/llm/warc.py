"""WARC archives from a table of pages, and back.

Records are sorted by page over ranges that depend on the pages alone, files roll at a
compressed size, and a file is named by its range and number: the same pages give the same
files, whatever the partitions. Tasks write under temporary names; only files in the manifest
of the attempts that succeeded get their final name, so a lost executor leaves no half file.
"""

from __future__ import annotations

import base64
import hashlib
import math
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow.fs import FileType
from pyspark.sql import DataFrame, SparkSession, functions as F

from twintable.llm.common import keep, open_folder, utf8

#: Payload bytes of a range of pages, and compressed bytes after which a file ends.
RANGE_BYTES, FILE_BYTES = 32 << 20, 16 << 20
#: Ids sampled for each border between ranges; the driver holds 8 bytes for each.
SAMPLES = 32
#: Tasks that read the files of an archive.
MOST_TASKS = 100_000
#: Dates of archives that are to be the same each time they are written.
DATE = "1970-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_READ = 1 << 20


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def _record_id(page: int | None, sha1: bytes, k: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page}:{sha1.hex()}:{k}')}>"


def _line(text: str) -> str:
    """A header value on one line: control characters and blanks percent-encoded."""
    return "".join(f"%{ord(c):02X}" if ord(c) <= 32 or ord(c) == 127 else c for c in text)


def record(headers: list[tuple[str, str | int | None]], block: bytes) -> bytes:
    """A record as a gzip member of its own; headers without a value are left out."""
    lines = [b"WARC/1.1"] + [f"{k}: {v}".encode("utf-8", "surrogatepass") for k, v in [*headers, ("Content-Length", len(block))] if v is not None]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def page_record(page: int | None, url: str | None, payload: bytes, k: int, of: int | None, of_url: str | None, revisit: bool) -> bytes:
    """A response with its payload, or a revisit of the page ``of`` without it."""
    sha1 = hashlib.sha1(payload).digest()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _record_id(page, sha1, k)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", None if url is None else _line(url)),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", "sha1:" + base32(sha1)),
        ("WARC-Block-Digest", "sha1:" + base32(hashlib.sha1(block).digest())),
        ("WARC-Profile", _PROFILE if revisit else None),
        ("WARC-Refers-To", _record_id(of, sha1, 0) if revisit else None),
        ("WARC-Refers-To-Target-URI", _line(of_url) if revisit and of_url is not None else None),
        ("X-Page-Id", page),
        ("X-Refers-To-Page-Id", of if revisit else None),
    ]
    return record(headers, block)


class _File:
    """A file under a temporary name, with what the manifest says of it."""

    def __init__(self, folder: str, name: str):
        self.fs, root = open_folder(folder)
        self.name, self.temporary = name, f"_tmp/{name}.{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(f"{root}/{self.temporary}", compression=None)
        self.bytes, self.records, self.sha = 0, 0, hashlib.sha256()
        self.add(record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(_SPACE, name)}>"), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
        self.records = 0

    def add(self, data: bytes) -> None:
        self.out.write(data)
        self.sha.update(data)
        self.bytes += len(data)
        self.records += 1

    def close(self) -> pa.RecordBatch:
        self.out.close()
        row = (self.name, self.temporary, self.records, self.bytes, self.sha.hexdigest())
        return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=["name", "temporary", "records", "bytes", "sha256"])


_MANIFEST = "name string, temporary string, records long, bytes long, sha256 string"


def _write(folder: str, file_bytes: int):
    """Writes rows sorted by range, page, digest and kind: first what a page revisits, then the page."""

    def run(batches):
        file, of_range, number, key, known, k = None, None, 0, None, None, 0
        for batch in batches:
            for cut, page, sha1, target, of_url, url, payload in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if cut != of_range or file.bytes >= file_bytes:
                    if file:
                        yield file.close()
                    number = number + 1 if cut == of_range else 0
                    of_range = cut
                    file = _File(folder, f"part-{cut:06d}-{number:05d}.warc.gz")
                if (page, sha1) != key:
                    key, known, k = (page, sha1), None, 0
                if payload is None:
                    known = (target, of_url)
                    continue
                # Rows that repeat page and payload revisit the first of them.
                revisit = known is not None or k > 0
                of, of_address = known or (page, url)
                file.add(page_record(page, url, payload, k, of, of_address, revisit))
                k += 1
        if file:
            yield file.close()

    return run


def write_warc(pages: DataFrame, folder: str, min_bytes: int = 0, range_bytes: int = RANGE_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) below ``folder``; returns the manifest, a row per file.

    Payload is the html in UTF-8, null is empty. Of equal payloads of ``min_bytes`` or more
    the page with the smallest page_id is a response, the others are revisits of it; rows
    that repeat a page_id and a payload revisit the first. Null ids come first in the order
    and are revisited only if all equal payloads have none. Other columns are ignored. The
    payload is shuffled once; an empty table writes no file.
    """
    spark = pages.sparkSession
    data = pages.select("page_id", "url", utf8(F.col("html")).alias("payload"))
    read = data.withColumn("sha1", F.unhex(F.sha1("payload")))
    facts = keep(read.select("page_id", "url", "sha1", F.octet_length("payload").cast("long").alias("size")))
    heads = keep(
        facts.where(F.col("size") >= min_bytes).groupBy("sha1")
        .agg(F.count("*").alias("n"), F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("head")).where("n > 1 and head is not null")
    )
    own = facts.where(F.col("size") >= min_bytes).select("page_id", "sha1")
    revisits = own.join(heads, "sha1").where(~F.col("page_id").eqNullSafe(F.col("head.page_id"))).select("page_id", "sha1", F.col("head.page_id").alias("target"), F.col("head.url").alias("of_url")).distinct()
    total = facts.agg(F.sum("size")).first()[0] or 0
    ranges = max(1, math.ceil(total / range_bytes))
    # The ids with the smallest hashes are a sample that doesn't depend on the partitions.
    some = facts.where("page_id is not null").select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(SAMPLES * ranges)
    some = np.sort(np.array([r[0] for r in some.collect()], dtype=np.int64))
    borders = some[np.arange(1, ranges) * len(some) // ranges] if len(some) else some

    @F.pandas_udf("int")
    def range_of(page: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(borders, page.to_numpy(dtype=np.int64), side="right").astype(np.int32))

    both = revisits.select("page_id", "sha1", "target", "of_url", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload")).union(
        read.select("page_id", "sha1", F.lit(None).cast("long"), F.lit(None).cast("string"), "url", "payload")
    )
    smallest = F.lit(-(1 << 63)).cast("long")
    cut = range_of(F.coalesce("page_id", smallest))
    rows = both.select(cut.alias("cut"), "page_id", "sha1", "target", "of_url", "url", "payload", F.col("payload").isNotNull().alias("own"))
    rows = rows.repartition(ranges, "cut").sortWithinPartitions("cut", "page_id", "sha1", "own", "url").drop("own")
    fs, root = open_folder(folder)
    fs.create_dir(f"{root}/_tmp", recursive=True)
    manifest = keep(rows.mapInArrow(_write(folder, file_bytes), _MANIFEST))
    done = keep(manifest.repartition("name").mapInArrow(_commit(folder), _MANIFEST))
    done.write.json(f"{folder}/manifest")
    fs.delete_dir(f"{root}/_tmp")
    return done


def _commit(folder: str):
    """Gives files their final name; a second attempt finds them there."""

    def run(batches):
        fs, root = open_folder(folder)
        for batch in batches:
            for name, temporary, size in zip(*[batch.column(i).to_pylist() for i in (0, 1, 3)], strict=True):
                there, before = fs.get_file_info([f"{root}/{name}", f"{root}/{temporary}"])
                if before.type != FileType.NotFound:
                    fs.move(f"{root}/{temporary}", f"{root}/{name}")
                elif there.type == FileType.NotFound or there.size != size:
                    raise FileNotFoundError(f"{name} was not written")
            yield batch

    return run


def members(stream) -> Iterator[bytes]:
    """Records of an open archive, one at a time."""
    packer, out, data = zlib.decompressobj(31), [], b""
    while True:
        data = data or stream.read(_READ)
        if not data:
            if out:
                raise ValueError("an archive ends inside a record")
            return
        out.append(packer.decompress(data))
        data = packer.unused_data
        if packer.eof:
            yield b"".join(out)
            packer, out = zlib.decompressobj(31), []


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    size = int(headers["Content-Length"])
    if not lines[0].startswith("WARC/") or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"not a record: {raw[:40]!r}")
    block = rest[:size]
    if "WARC-Block-Digest" in headers and headers["WARC-Block-Digest"] != "sha1:" + base32(hashlib.sha1(block).digest()):
        raise ValueError(f"{headers['WARC-Record-ID']} is damaged")
    return headers, block


_RECORD = "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Responses and revisits of the files in the manifest below ``folder``, with checked digests.

    page_id, url, record_type, payload (null for revisits), payload_bytes and payload_digest
    of the full payload, refers_to. A task holds one record of a file at a time.
    """
    names = spark.read.schema(_MANIFEST).json(f"{folder}/manifest").select("name")

    def run(batches):
        fs, root = open_folder(folder)
        rows, held = [], 0
        kinds = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64()]

        def flush():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in _RECORD.split(", ")])

        for batch in batches:
            for name in batch.column(0).to_pylist():
                with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for raw in members(stream):
                        headers, block = parse_record(raw)
                        if headers["WARC-Type"] not in ("response", "revisit"):
                            continue
                        http, _, body = block.partition(b"\r\n\r\n")
                        size = int(http.rpartition(b"Content-Length: ")[2])
                        digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        own = headers["WARC-Type"] == "response"
                        if own and (len(body) != size or base32(hashlib.sha1(body).digest()) != digest):
                            raise ValueError(f"{headers['WARC-Record-ID']} is damaged")
                        page, of = headers.get("X-Page-Id"), headers.get("X-Refers-To-Page-Id")
                        rows.append((page and int(page), headers.get("WARC-Target-URI"), headers["WARC-Type"], body if own else None, size, digest, of and int(of)))
                        held += len(body) + 256
                        if held > 4 << 20:
                            yield flush()
                            rows, held = [], 0
        if rows:
            yield flush()

    files = names.count()  # a number of its own, so that names, small as they are, aren't put into one task
    return names.repartition(max(1, min(files, MOST_TASKS)), "name").mapInArrow(run, _RECORD)
