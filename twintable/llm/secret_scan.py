"""Secrets in texts, told from copied examples by who owns them across the corpus."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from twintable.llm.common import keep

#: Kinds in the order in which spans with one start are listed; the first three are the base.
KINDS = ("assign", "access", "hex", "opaque")
BASE = 3
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
#: Long runs of key characters; they count as secrets only where one owner has them.
_OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}")
_MIXED = tuple(map(re.compile, ("[a-z]", "[A-Z]", "[0-9]")))


def find(text: str) -> list[tuple[int, int, int, int, str]]:
    """Candidates as (start, kind, end, start of the value, value), by start and kind."""
    out = []
    for m in _ASSIGN.finditer(text):
        if m.end(2) - m.start(2) >= 12:
            out.append((m.start(), 0, m.end(), m.start(2), m[2]))
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start(), m[0]) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end(), m.start(), m[0]) for m in _HEX.finditer(text)]
    taken = sorted((x[0], x[2]) for x in out)
    at, furthest = 0, 0  # of the spans that begin before the run ends, the furthest end; runs come in order
    for m in _OPAQUE.finditer(text):
        while at < len(taken) and taken[at][0] < m.end():
            furthest = max(furthest, taken[at][1])
            at += 1
        if furthest <= m.start() and all(p.search(m[0]) for p in _MIXED):
            out.append((m.start(), 3, m.end(), m.start(), m[0]))
    return sorted(out)


def _spans(found) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, *_ in found)


_FOUND = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("value", pa.int64()), ("hash", pa.string())]))
_FOUND_SQL = "array<struct<start:long,kind:int,end:long,value:long,hash:string>>"


def candidates(df: DataFrame, text: str, keys: dict[str, Column]) -> DataFrame:
    """``keys`` with counts of the base kinds, ``base_sha256`` and all candidates of each row; values only as hashes."""
    part = df.select(F.coalesce(F.col(text), F.lit("")).alias("__text"), *[c.alias(n) for n, c in keys.items()])
    kinds = dict(part.dtypes)
    counts = [f"n_{k}" for k in KINDS[:BASE]]

    def run(batches):
        for batch in batches:
            n, base, found = [[] for _ in counts], [], []
            for x in batch.column(0):
                own = find(x.as_py())
                first = [c for c in own if c[1] < BASE]
                for k in range(BASE):
                    n[k].append(sum(c[1] == k for c in first))
                base.append(hashlib.sha256(_spans(first).encode()).hexdigest())
                found.append([{"start": a, "kind": k, "end": b, "value": v, "hash": hashlib.sha256(w.encode()).hexdigest()[:32]} for a, k, b, v, w in own])
            more = [*[pa.array(x, pa.int64()) for x in n], pa.array(base, pa.string()), pa.array(found, _FOUND)]
            names = [*batch.schema.names[1:], *counts, "base_sha256", "found"]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *more], names=names)

    return part.mapInArrow(run, ", ".join([*[f"{n} {kinds[n]}" for n in keys], *[f"{c} long" for c in counts], "base_sha256 string", f"found {_FOUND_SQL}"]))


def ownership(found: DataFrame) -> DataFrame:
    """How many owners and repositories have a candidate: hash, n_owners, n_repos, n_places, from hash, owner, repo.

    Three counts, each combined before its shuffle, so that a value in every row costs a row
    per map task. Null owners and repositories count as one each.
    """
    in_repo = found.groupBy("hash", "owner", "repo").agg(F.count("*").alias("n"))
    of_owner = in_repo.groupBy("hash", "owner").agg(F.count("*").alias("repos"), F.sum("n").alias("n"))
    return of_owner.groupBy("hash").agg(
        F.count("*").alias("n_owners"), F.sum("repos").alias("n_repos"), F.sum("n").alias("n_places")
    )


def _judged(rows: DataFrame, example_owners: int) -> DataFrame:
    """Candidates of kept ``rows`` (id, owner, repo, found), one a row, with ``live``."""
    each = rows.where(F.size("found") > 0).select("id", "owner", "repo", F.explode("found").alias("f")).select("id", "owner", "repo", "f.*")
    # Written down, so that the join is one of two scans, whose hot values Spark can split.
    known = keep(ownership(each).select("hash", (F.col("n_owners") < example_owners).alias("live")))
    return each.join(known, "hash")


def scan(df: DataFrame, key: str, text: str, owner: Column, repo: Column, example_owners: int = 3) -> DataFrame:
    """A row per row of ``df``: key, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_examples.

    Base spans are always listed; opaque runs only where fewer than ``example_owners`` owners
    have the value in the whole table. ``n_live`` and ``n_examples`` count all candidates on
    either side of that line. Null texts are empty; null and repeated keys are rows like
    others; other columns are ignored; an empty table gives an empty result.
    """
    rows = keep(candidates(df, text, {"key": F.col(key), "owner": owner, "repo": repo, "id": F.monotonically_increasing_id()}))
    span = F.concat(F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1), F.lit(":"), F.col("start"), F.lit(":"), F.col("end"))
    said = _judged(rows, example_owners).groupBy("id").agg(
        F.array_sort(F.collect_list(F.when((F.col("kind") < BASE) | F.col("live"), F.struct("start", "kind", span.alias("span"))))).alias("all"),
        F.count_if("live").alias("n_live"),
        F.count_if(~F.col("live")).alias("n_examples"),
    )
    zero = F.lit(0).cast("long")
    return rows.join(said, "id", "left").select(
        F.col("key").alias(key),
        "n_assign",
        "n_access",
        "n_hex",
        "base_sha256",
        F.coalesce(F.array_join(F.col("all.span"), ","), F.lit("")).alias("spans"),
        F.coalesce("n_live", zero).alias("n_live"),
        F.coalesce("n_examples", zero).alias("n_examples"),
    )


def redact(df: DataFrame, key: str, text: str, owner: Column, repo: Column, example_owners: int = 3, mark: str = "[SECRET]") -> DataFrame:
    """``df`` with live values in ``text`` replaced by ``mark``; examples and all rows stay.

    Places come from ``scan``'s judgement. They meet the texts again by key and hash of the
    text, so that repeated keys do no harm. Columns of ``df`` other than ``text`` are kept as they are.
    """
    own = {"key": F.col(key), "sum": F.xxhash64(F.col(text)), "owner": owner, "repo": repo, "id": F.monotonically_increasing_id()}
    rows = keep(candidates(df, text, own).where(F.size("found") > 0))
    cuts = _judged(rows, example_owners).where("live").groupBy("id").agg(F.array_sort(F.collect_set(F.struct(F.col("value").alias("a"), F.col("end").alias("b")))).alias("cuts"))
    cuts = rows.join(cuts, "id").groupBy("key", "sum").agg(F.first("cuts").alias("cuts"))
    names = df.columns
    left = df.select(*[F.col(f"`{c}`") for c in names]).alias("d")
    on = F.col(f"d.`{key}`").eqNullSafe(F.col("c.key")) & (F.xxhash64(F.col(f"d.`{text}`")) == F.col("c.sum"))
    both = left.join(cuts.alias("c"), on, "left")
    # Overlapping places are cut once: a piece begins where the furthest end before it lies.
    pieces = F.aggregate(
        "c.cuts",
        F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at")),
        lambda acc, x: F.when(
            x["b"] <= acc["at"], acc
        ).otherwise(
            F.struct(
                F.concat(acc["out"], F.when(x["a"] < acc["at"], F.lit("")).otherwise(
                    F.concat(F.substring(F.col(f"d.`{text}`"), (acc["at"] + 1).cast("int"), (x["a"] - acc["at"]).cast("int")), F.lit(mark))
                )).alias("out"),
                x["b"].alias("at"),
            )
        ),
        lambda acc: F.concat(acc["out"], F.substring(F.col(f"d.`{text}`"), (acc["at"] + 1).cast("int"), F.lit(2**31 - 1))),
    )
    new = F.when(F.coalesce(F.size("c.cuts"), F.lit(0)) > 0, pieces).otherwise(F.col(f"d.`{text}`"))
    return both.select(*[new.alias(c) if c == text else F.col(f"d.`{c}`") for c in names])
