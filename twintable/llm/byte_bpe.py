"""Byte-level byte-pair encoding and decoding by higher-order functions.

Texts are cut into words by Spark's own regular expressions. Words are folded pair by pair in
order of rank, by an expression over their bytes with the ranks as literals. The words that
most blocks of documents have are folded once and written to the shared folder, a table of
bounded size that tasks read; what a block has besides is folded with the block, each word once. So neither texts nor
words are shuffled, and documents take the tokens of their words as the block passes by.
"""

from __future__ import annotations

import base64
import hashlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow.fs import FileSelector
from pyspark.sql import Column, DataFrame, functions as F

from twintable.llm.common import keep, modest_batches, open_folder, release, scratch

#: White space, and the pattern of words of the vocabulary, in Java's syntax.
SPACE = "\\t-\\r \\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PATTERN = f"'s|'t|'re|'ve|'m|'ll|'d| ?\\p{{L}}+| ?\\p{{N}}+| ?[^{SPACE}\\p{{L}}\\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Text bytes of a block of documents; a longer document is a block of its own.
BLOCK_BYTES = 8 << 20
#: Frequent words that all tasks read: how many at most, and the most bytes of one.
FREQUENT_WORDS, FREQUENT_BYTES = 500_000, 32
#: Words of more bytes aren't folded, as a fold copies the word at each step, but merged in ``merge_long``.
LONG_BYTES = 256
#: Words of a block that are folded as one row.
CHUNK = 2_000
_IDS = pa.list_(pa.int32())
#: Larger than any rank: the pair is no token.
NONE = 1 << 30
#: Slots of the literal rank map and of its displacements; primes whose product exceeds 2**32.
SLOTS, SHIFTS = 131_071, 65_521


def public_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@dataclass(frozen=True)
class Ranks:
    """A vocabulary: tokens of single bytes, merges by pair of tokens and hex of each token as literals."""

    bytes: str
    shifts: str
    slots: str
    pieces: str


def _tokens(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    if max(ranks.values()) >= 1 << 16 or len(ranks) != max(ranks.values()) + 1:
        raise ValueError("ranks must be 0 to n - 1 below 65536")
    return ranks


@lru_cache(maxsize=2)
def load(path: str) -> Ranks:
    """The rank file as a perfect hash of pairs: slot = (pair mod SLOTS + shift[pair mod SHIFTS]) mod SLOTS."""
    ranks = _tokens(path)
    pairs = {}
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            a, b = ranks.get(token[:i]), ranks.get(token[i:])
            if a is not None and b is not None:
                pairs[a << 16 | b] = rank
    if len(pairs) > 0.9 * SLOTS:
        raise ValueError(f"{len(pairs)} pairs don't fit {SLOTS} slots")
    groups: dict[int, list[int]] = {}
    for pair in pairs:
        groups.setdefault(pair % SHIFTS, []).append(pair)
    slots, shifts, free = np.full(SLOTS, -1, dtype=np.int64), np.zeros(SHIFTS, dtype=np.int64), np.ones(SLOTS, bool)
    for of, own in sorted(groups.items(), key=lambda x: -len(x[1])):
        home = np.array(own) % SLOTS
        shift = (of * 2_654_435_761) % SLOTS
        while not free[(home + shift) % SLOTS].all():
            shift = (shift + 7919) % SLOTS
        at = (home + shift) % SLOTS
        free[at], shifts[of], slots[at] = False, shift, [pair << 16 | pairs[pair] for pair in own]
    pieces = [b""] * len(ranks)
    for token, rank in ranks.items():
        pieces[rank] = token
    return Ranks(
        ",".join(str(ranks[bytes([i])]) for i in range(256)),
        ",".join(map(str, shifts)),
        ",".join(map(str, slots)),
        ",".join(p.hex() for p in pieces),
    )


def _literal(values: str, kind: str) -> Column:
    """An array literal; the optimizer evaluates it once."""
    out = F.split(F.lit(values), ",")
    return out if kind == "string" else out.cast(f"array<{kind}>")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def encode_bytes(data: Column, ranks: Ranks) -> Column:
    """Token ids of a word given as an array of byte values; null for null, empty for empty.

    A fold over the word's pairs: each step merges the leftmost pair of least rank and looks
    up the two pairs that the new token forms with its neighbours.
    """
    return _let(_tables(ranks), lambda t: _fold(data, t["slots"], t["shifts"], ranks))


def encode_words(words_: Column, ranks: Ranks) -> Column:
    """Token ids of each word of an array, given as arrays of byte values, in its order."""
    return _let(_tables(ranks), lambda t: F.transform(words_, lambda w: _fold(w, t["slots"], t["shifts"], ranks)))


def _tables(ranks: Ranks) -> Column:
    return F.struct(_literal(ranks.slots, "bigint").alias("slots"), _literal(ranks.shifts, "int").alias("shifts"))


def _fold(data: Column, slots: Column, shifts: Column, ranks: Ranks) -> Column:
    def merged(pair: Column) -> Column:
        entry = F.get(slots, (pair % SLOTS + F.get(shifts, (pair % SHIFTS).cast("int"))) % SLOTS)
        return F.when(F.shiftright(entry, 16) == pair, entry.bitwiseAND(F.lit(0xFFFF).cast("bigint"))).otherwise(F.lit(NONE).cast("bigint")).cast("int")

    def key(a: Column, b: Column) -> Column:
        return a.cast("bigint") * 65536 + b

    start = F.transform(data, lambda x: F.get(_literal(ranks.bytes, "int"), x))
    first = _let(
        start,
        lambda ids: F.struct(
            ids.alias("ids"),
            F.transform(
                F.slice(F.zip_with(ids, F.slice(ids, F.lit(2), F.size(ids)), key), F.lit(1), F.greatest(F.size(ids) - 1, F.lit(0))), merged
            ).alias("next"),
        ),
    )

    def step(state: Column, _) -> Column:
        ids, next_ = state["ids"], state["next"]

        def merge(x: Column) -> Column:
            best, at = x["best"], x["at"]
            around = F.array_compact(F.array(key(F.get(ids, at - 2), best), key(best, F.get(ids, at + 1))))
            return F.struct(
                F.concat(F.slice(ids, F.lit(1), at - 1), F.array(best), F.slice(ids, at + 2, F.size(ids))).alias("ids"),
                F.concat(
                    F.slice(next_, F.lit(1), F.greatest(at - 2, F.lit(0))), F.transform(around, merged), F.slice(next_, at + 2, F.size(ids))
                ).alias("next"),
            )

        def chosen(best: Column) -> Column:
            found = F.struct(best.alias("best"), F.array_position(next_, best).cast("int").alias("at"))
            return F.when(best < NONE, _let(found, merge)).otherwise(state)

        return F.when(F.size(next_) > 0, _let(F.array_min(next_), chosen)).otherwise(state)

    return _let(first, lambda state: F.aggregate(state["next"], state, step)["ids"])


def decode_ids(ids: Column, ranks: Ranks) -> Column:
    """The bytes of token ids: their pieces one after another."""
    pieces = _literal(ranks.pieces, "string")
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(pieces, i)), ""))


def words(text: Column) -> Column:
    """The words of a text in order, none for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PATTERN), F.lit(0))


def byte_values(word: Column) -> Column:
    """The bytes of a word in UTF-8 as numbers."""
    as_chars = F.decode(F.encode(word, "UTF-8"), "ISO-8859-1")
    return F.transform(F.split(as_chars, ""), F.ascii)


class Merges:
    """The same ranks for words too long to fold."""

    def __init__(self, ranks: Ranks):
        self.first = np.array(ranks.bytes.split(","), dtype=np.int64)
        slots = np.array(ranks.slots.split(","), dtype=np.int64)
        slots = np.sort(slots[slots >= 0])
        self.pairs, self.ranks = slots >> 16, slots & 0xFFFF

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where it is no token."""
        wanted = left << 16 | right
        place = np.minimum(np.searchsorted(self.pairs, wanted), len(self.pairs) - 1)
        return np.where(self.pairs[place] == wanted, self.ranks[place], NONE)

    def merge_long(self, word: bytes) -> np.ndarray:
        """Token ids of a word: each step merges all places of the pair of least rank, from the left.

        That equals merging one place after another as long as no pair that comes about has a
        lesser rank; where one has, the step is done again with the leftmost place alone.
        Steps are at most as many as there are different merges, as a rule, each along the word.
        """
        ids = self.first[np.frombuffer(word, dtype=np.uint8)]
        after = self.of(ids[:-1], ids[1:])
        while len(after) and (best := after.min()) < NONE:
            at = np.flatnonzero(after == best)
            begins = np.append(True, np.diff(at) > 1)  # of places in a row, every second one overlaps
            at = at[(at - at[begins][np.cumsum(begins) - 1]) % 2 == 0]
            for places in (at, at[:1]):
                new_ids = ids.copy()
                new_ids[places] = best
                new_ids = np.delete(new_ids, places + 1)
                now = places - np.arange(len(places))
                changed = np.union1d(now[now < len(new_ids) - 1], now[now > 0] - 1)
                ranks = self.of(new_ids[changed], new_ids[changed + 1])
                if len(places) == 1 or not (ranks < best).any():
                    break
            # The pair at a merged place goes on from its second token.
            after = np.delete(after, places)
            after[changed] = ranks
            ids = new_ids
        return ids


def _batches_of(block_bytes: int, rows):
    """Runs ``rows(keys, words, ends)`` over blocks of documents: their keys, all words, and where each document's end."""

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.column(1).values.nbytes
            if size >= block_bytes * 2:  # as much again for where the words end
                yield from blocks(held)
                held, size = [], 0
                release()
        if held:
            yield from blocks(held)
        release()

    def blocks(held):
        batch = pa.Table.from_batches(held).combine_chunks().to_batches()
        held.clear()
        if not batch:
            return
        (batch,) = batch
        keys, lists = batch.column(0), batch.column(1)
        ends = lists.offsets.to_numpy().astype(np.int64)
        text = np.frombuffer(lists.values.buffers()[1], dtype=np.int32)[lists.values.offset :] if len(lists.values) else np.zeros(1, np.int32)
        at = text[ends]
        total = int(at[-1] - at[0])
        most = max(block_bytes, -(-total // max(1, total // block_bytes)))  # equal parts, no small rest
        start = 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(at, at[start] + most, side="right")) - 1)
            yield from rows(keys.slice(start, stop - start), lists.values.slice(ends[start], ends[stop] - ends[start]), ends[start : stop + 1] - ends[start])
            start = stop

    return run


def _block(keys, words_, ends):
    """A block as one row: keys, words of each document, place of each word among the distinct ones, those."""
    coded = words_.dictionary_encode()
    places = coded.indices.to_numpy().astype(np.int32) if len(words_) else np.zeros(0, np.int32)
    row = {
        "keys": pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys),
        "sizes": pa.array([np.diff(ends).astype(np.int32)], pa.list_(pa.int32())),
        # Byte by byte of all places, which packs better.
        "places": pa.array([places.view(np.uint8).reshape(-1, 4).T.tobytes()], pa.binary()),
        "words": pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary),
    }
    yield pa.RecordBatch.from_arrays(list(row.values()), names=list(row))


def frequent_words(blocks: DataFrame, most: int = FREQUENT_WORDS) -> DataFrame:
    """word: the words that most blocks have, two at least, at most ``most``; from ``words`` of each block.

    All blocks are counted. The least number of blocks is found from a table of how many words
    there are for each quarter of a power of two, so no sort is needed; where not all words
    of the last of these fit, those of least hash are taken. Which words these are changes
    nothing but the work.
    """
    each = blocks.select(F.explode("words").alias("word")).where(F.octet_length("word") <= FREQUENT_BYTES)
    counts = each.groupBy("word").agg(F.count("*").alias("n")).where("n > 1")
    counts = keep(counts.withColumn("step", F.floor(F.log2("n") * 4).cast("int")), "zstd")
    left, taken = most, F.lit(False)
    for step, n in counts.groupBy("step").count().orderBy(F.desc("step")).collect():  # a row for each step, at most 256
        # A little less than would fit, as shares by hash vary.
        taken |= (F.col("step") == step) & (F.pmod(F.xxhash64("word"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, 0.98 * left / n if n > left else 1.0)))
        left -= n
        if left <= 0:
            break
    return counts.where(taken).select("word")


@lru_cache(maxsize=2)
def _frequent(path: str, column: str) -> pa.Array:
    """A column of the frequent words, in the same order in every task."""
    files, folder = open_folder(path)
    found = sorted(i.path for i in files.get_file_info(FileSelector(folder)) if i.base_name.endswith(".parquet"))
    parts = [pq.read_table(f, columns=[column], filesystem=files) for f in found]
    kind = _IDS if column == "ids" else pa.string()
    return pa.concat_arrays([c.cast(kind) for p in parts for c in p.column(column).chunks] or [pa.array([], kind)])


def _values(words_: pa.StringArray) -> pa.ListArray:
    """The bytes of each word in UTF-8 as numbers."""
    ends = np.concatenate([[0], np.cumsum(pc.binary_length(words_).to_numpy(zero_copy_only=False))]).astype(np.int32)
    data = np.zeros(0, np.uint8)
    if ends[-1]:
        first = np.frombuffer(words_.buffers()[1], dtype=np.int32)[words_.offset]
        data = np.frombuffer(words_.buffers()[2], dtype=np.uint8)[first : first + ends[-1]]
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(data.astype(np.int32)))


def _told_apart(path: str, merges: Merges):
    """Rows of a block: words to fold as byte values, then tokens of long words, then its documents with the place of each word.

    Places count the frequent words first, then those to fold, then the long ones.
    """

    def row(keys=None, sizes=None, places=None, words_=None, given=None):
        columns = [
            pa.array([sizes], pa.list_(pa.int32())),
            pa.array([places], pa.binary()),
            pa.array([[]], pa.list_(_IDS)) if words_ is None else pa.ListArray.from_arrays(pa.array([0, len(words_)], pa.int32()), words_),
            pa.array([[] if given is None else [given]], pa.list_(pa.list_(pa.int32()))),
        ]
        keys = pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)
        return pa.RecordBatch.from_arrays([keys, *columns], names=["keys", "sizes", "places", "words", "given"])

    def run(batches):
        known = _frequent(path, "word")
        for batch in batches:
            for i in range(batch.num_rows):
                yield from rows(known, batch.column(0)[i].values, batch.column(1)[i].values, batch.column(2)[i].as_buffer(), batch.column(3)[i].values)
            release()

    def rows(known, keys, sizes, places, words_):
        place = pc.fill_null(pc.index_in(words_, value_set=known), -1).to_numpy().astype(np.int32)
        new = np.flatnonzero(place < 0)
        fresh = words_.take(pa.array(new))
        long = pc.binary_length(fresh).to_numpy(zero_copy_only=False) > LONG_BYTES
        order = np.argsort(long, kind="stable")
        place[new[order]] = len(known) + np.arange(len(new), dtype=np.int32)
        fold = _values(fresh.filter(pa.array(~long)))
        for start in range(0, len(fold), CHUNK):
            yield row(keys.slice(0, 0), words_=fold.slice(start, CHUNK))
        for i in np.flatnonzero(long):
            yield row(keys.slice(0, 0), given=merges.merge_long(fresh[i].as_py().encode()).astype(np.int32))
        at = np.ascontiguousarray(np.frombuffer(places, dtype=np.uint8).reshape(4, -1).T).view(np.int32).ravel()
        yield row(keys, sizes, place[at].tobytes())

    return run


def encoded_blocks(df: DataFrame, key: str, text: str, ranks: Ranks, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, str]:
    """Rows of blocks in their order, with ``ids``, and the folder of the frequent words with theirs.

    Blocks are written once with their distinct words. Then a block is rows of ``ids``, the
    tokens of words that aren't frequent, and one with keys, sizes and places of its documents
    after them; what follows in the same tasks reads them in this order. Blocks are bounded by ``block_bytes``, so a task holds little; the frequent words are at most
    ``FREQUENT_WORDS`` of ``FREQUENT_BYTES``.
    """
    spark = df.sparkSession
    modest_batches(spark)
    release()  # what building the ranks took
    # The literals are megabytes long as text; descriptions of plans on the driver end before that.
    spark.conf.set("spark.sql.maxPlanStringLength", 100_000)
    kind = dict(df.dtypes)[key]
    cut = df.select(F.col(key).alias("key"), words(F.col(text)).alias("words"))
    blocks = keep(cut.mapInArrow(_batches_of(block_bytes, _block), f"keys array<{kind}>, sizes array<int>, places binary, words array<string>"), "zstd")
    modest_batches(spark, 8)  # a row is a block
    # Tasks read these words from the shared folder: through the driver they would be held there several times.
    frequent = scratch(spark)
    frequent_words(blocks).repartition(64).withColumn("ids", encode_bytes(byte_values(F.col("word")), ranks)).write.parquet(frequent)
    run = _told_apart(frequent, Merges(ranks))
    rows = blocks.mapInArrow(run, f"keys array<{kind}>, sizes array<int>, places binary, words array<array<int>>, given array<array<int>>")
    rows = rows.select("keys", "sizes", "places", F.concat(encode_words(F.col("words"), ranks), "given").alias("ids"))
    return rows, frequent


def _said(ids: pa.ListArray) -> pa.Array:
    """The ids of each word in decimal, joined by a space."""
    if not len(ids):
        return pa.array([], pa.string())
    return pc.binary_join(pa.ListArray.from_arrays(pc.subtract(ids.offsets, ids.offsets[0]), ids.flatten().cast(pa.string())), " ")


def _documents(batches):
    """For each block: keys, ends of documents in words, places, ids of its own words."""
    own = [pa.array([], _IDS)]
    for batch in batches:
        for i in range(batch.num_rows):
            if batch.column(1)[i].as_py() is None:
                own.append(batch.column(3)[i].values.cast(_IDS))
                continue
            sizes = batch.column(1)[i].values.to_numpy()
            places = np.frombuffer(batch.column(2)[i].as_buffer(), dtype=np.int32)
            yield batch.column(0)[i].values, np.concatenate([[0], np.cumsum(sizes)]), places, pa.concat_arrays(own)
            own = [pa.array([], _IDS)]
            release()


def _digests(frequent: str, hex_pieces: str):
    def run(batches):
        pieces = pa.array([bytes.fromhex(p) for p in hex_pieces.split(",")], pa.large_binary())
        often = _frequent(frequent, "ids")
        often_said = _said(often)
        for keys, ends, places, rest in _documents(batches):
            parts = max(1, -(-len(places) // 500_000))
            each = max(1, -(-len(keys) // parts))
            ids, said = pa.concat_arrays([often, rest]), pa.concat_arrays([often_said, _said(rest)])
            for start in range(0, len(keys), each):
                stop = min(len(keys), start + each)
                own, edge = pa.array(places[ends[start] : ends[stop]]), ends[start : stop + 1] - ends[start]
                joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), said.take(own)), " ")
                tokens, flat = np.zeros(len(edge), np.int64), pa.array([], pa.int32())
                if len(own):
                    lists = ids.take(own)
                    flat = lists.flatten()
                    tokens = (lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py())[edge]
                # The pieces of all tokens, one after another, are the decoded bytes.
                data = pieces.take(flat)
                at = np.frombuffer(data.buffers()[1], dtype=np.int64)[data.offset :][tokens] if len(flat) else np.zeros(len(edge), np.int64)
                raw = memoryview(data.buffers()[2]) if len(flat) else memoryview(b"")
                yield pa.RecordBatch.from_arrays(
                    [
                        keys.slice(start, stop - start),
                        pa.array(np.diff(tokens).astype(np.int64)),
                        pa.array([hashlib.sha256(x.as_buffer() or b"").hexdigest() for x in joined]),
                        pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)]),
                    ],
                    names=["key", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return run


def token_digests(df: DataFrame, key: str, text: str, path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256 for each row of ``df``.

    ``ids_sha256`` is of the decimal ids joined by one space, ``decoded_sha256`` of the bytes
    that the ids decode to. Null and empty texts have no tokens; null and repeated keys are
    rows like others; other columns are ignored; an empty table gives an empty result. Words
    of more than ``LONG_BYTES`` are merged all places of a pair at a time.
    """
    kind, ranks = dict(df.dtypes)[key], load(path)
    blocks, frequent = encoded_blocks(df, key, text, ranks, block_bytes)
    out = blocks.mapInArrow(_digests(frequent, ranks.pieces), f"key {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("key", key)


def _ids(frequent: str):
    def run(batches):
        often = _frequent(frequent, "ids")
        for keys, ends, places, rest in _documents(batches):
            ids = pa.concat_arrays([often, rest])
            for start in range(len(keys)):
                own = ids.take(pa.array(places[ends[start] : ends[start + 1]]))
                flat = own.flatten() if len(own) else pa.array([], pa.int32())
                yield pa.RecordBatch.from_arrays([keys.slice(start, 1), pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)], names=["key", "ids"])

    return run


def encode(df: DataFrame, key: str, text: str, path: str) -> DataFrame:
    """key and ``ids``, the tokens of each text of ``df``, in the order of the text."""
    kind = dict(df.dtypes)[key]
    blocks, frequent = encoded_blocks(df, key, text, load(path))
    return blocks.mapInArrow(_ids(frequent), f"key {kind}, ids array<int>").withColumnRenamed("key", key)
