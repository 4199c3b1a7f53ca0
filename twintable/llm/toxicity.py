"""Toxicity by two Kneser-Ney models of characters, one for each label.

Each class has its own counts of characters after the beginning of their word, or after four
characters further on; where it hasn't seen what follows, both fall back on one smoothed
distribution that they share. As the shared part cancels, the ratio of the two likelihoods
depends on a character and what it is seen after alone: it is worked out once for each in
Spark and looked up while scoring. The tables of these ratios are exact and grow with the
corpus: tasks read small ones from the shared folder, others are joined with what blocks of documents hold.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow.fs import FileSelector
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from twintable.llm.common import keep, modest_batches, open_folder, release, scratch, slices

#: A character is seen after its whole word up to ``PREFIX`` characters, further on after ``ORDER`` - 1.
ORDER, PREFIX = 5, 8
BITS = 7
DISCOUNT = 0.75
#: With at most so many different grams tasks read the whole tables, 12 bytes for each gram and context; both ways give the same scores.
LOOKUP_GRAMS = 2_000_000
#: Documents meet the ratios of their grams in blocks of so many bytes, a longer document alone; work goes by slices.
BLOCK_BYTES, SLICE_BYTES = 8 << 20, 1 << 19
#: Labelled rows that weigh the features against each other; the models themselves count all the others.
CALIBRATION_ROWS = 20_000
FEATURES = 6
#: Different grams whose counts a task holds before it sends them, 24 bytes each.
HELD_GRAMS = 1_000_000
#: Log ratio from which a word speaks for toxicity.
STRONG = 3.0
_WIDE, _GAP, _DIGIT = 2048, 127, 27


def _alphabet() -> np.ndarray:
    """Numbers of characters: a to z, digits as one, Latin letters with marks, the other letters dealt to what is left; the rest are gaps."""
    out = np.full(_WIDE, _GAP, dtype=np.int64)
    for c in range(_WIDE):
        if "a" <= chr(c) <= "z":
            out[c] = c - 96
        elif chr(c).isdigit():
            out[c] = _DIGIT
        elif chr(c).isalpha():
            out[c] = c - 0xDF + 28 if 0xDF <= c <= 0xFF else 61 + c % 66
    return out


_ALPHABET = _alphabet()


def codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each character with what it is seen after as a number, the text it belongs to, and whether it is a gap.

    A text is lower case between gaps, runs of gaps are one, and stands after a gap.
    """
    parts, sizes = [], []
    for text in texts:
        raw = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        c = np.where(raw < _WIDE, _ALPHABET[np.minimum(raw, _WIDE - 1)], 61 + raw % 66)
        if len(c):
            c = np.append(c, _GAP)
            gap = c == _GAP
            c = c[~gap | np.append(True, ~gap[:-1])]
            if c[0] == _GAP:
                c = c[1:]
        sizes.append(len(c))
        parts += [np.full(PREFIX, _GAP, dtype=np.int64), c]
    chars = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
    sizes = np.array(sizes, dtype=np.int64)
    if not sizes.sum():
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    whole = np.zeros(len(chars) - PREFIX, dtype=np.int64)
    for i in range(PREFIX + 1):
        whole = (whole << BITS) | chars[i : len(chars) - PREFIX + i]
    place = np.arange(len(chars))
    gap_at = np.maximum.accumulate(np.where(chars == _GAP, place, 0))
    inside = place[1:] - gap_at[:-1]  # characters since the last gap, this one included
    inside = inside[PREFIX - 1 :]
    keep_ = np.where(inside <= PREFIX, inside + 1, ORDER)
    whole &= (np.int64(1) << (BITS * keep_)) - 1
    starts = np.cumsum(sizes + PREFIX) - (sizes + PREFIX)
    mine = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    return whole[at], mine, chars[at + PREFIX] == _GAP


def _count(batches):
    """gram, toxic, plain of a task: counts of slices are added up in a sorted table that leaves once it has ``HELD_GRAMS``."""

    def rows(held):
        return pa.RecordBatch.from_arrays([pa.array(x) for x in held], names=["gram", "toxic", "plain"])

    held, fresh, size = _no_counts(), [], 0
    for batch in batches:
        for part in slices(batch, "text", SLICE_BYTES):
            toxic = np.asarray(part.column(1).to_numpy(zero_copy_only=False), dtype=np.int64)
            found, mine, _ = codes(part.column(0).to_pylist())
            of = toxic[mine] if len(mine) else np.zeros(0, np.int64)
            fresh.append(_added([(found, of, 1 - of)]))
            size += len(fresh[-1][0])
            if size > HELD_GRAMS // 4:
                held, fresh, size = _added([held, *fresh]), [], 0
                if len(held[0]) > HELD_GRAMS:
                    yield rows(held)
                    held = _no_counts()
    yield rows(_added([held, *fresh]))


def _no_counts():
    return tuple(np.zeros(0, np.int64) for _ in range(3))


def _added(tables):
    """Tables of gram, toxic, plain as one with each gram once, in ascending order."""
    grams, *counts = (np.concatenate(x) for x in zip(*tables, strict=True))
    order = np.argsort(grams, kind="stable")
    grams = grams[order]
    first = np.flatnonzero(np.append(True, grams[1:] != grams[:-1])) if len(grams) else np.zeros(0, np.int64)
    return grams[first], *[np.add.reduceat(c[order], first) if len(first) else c for c in counts]


def gram_counts(texts: DataFrame) -> DataFrame:
    """Counts of each character with what it is seen after, in texts with label 1 and 0: gram, toxic, plain, from text, toxic."""
    part = texts.select("text", F.col("toxic").cast("long")).mapInArrow(_count, "gram long, toxic long, plain long")
    return part.groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("plain").alias("plain"))


def _tail(gram: Column, size: int) -> Column:
    """The last ``size`` characters."""
    return gram.bitwiseAND(F.lit((1 << (BITS * size)) - 1).cast("long"))


def shared_backoff(grams: DataFrame) -> DataFrame:
    """Kneser-Ney over both classes together, from one character up to four: gram, p.

    A shorter sequence counts by the number of different characters before it.
    """
    below = None
    tables = []
    now = grams.select("gram")
    for size in range(ORDER - 1, 0, -1):
        # Written down, as the next one comes from it too.
        now = keep(now.groupBy(_tail(F.col("gram"), size).alias("gram")).agg(F.count("*").alias("n")))
        tables.append((size, now))
    of_context = Window.partitionBy("context")  # a context has at most 2**BITS grams
    for size, now in reversed(tables):
        own = now.withColumn("context", F.shiftright("gram", BITS))
        own = own.select("*", F.sum("n").over(of_context).alias("all"), F.count("*").over(of_context).alias("kinds"))
        seen, rest = F.greatest(F.col("n") - DISCOUNT, F.lit(0.0)) / F.col("all"), F.lit(DISCOUNT) * F.col("kinds") / F.col("all")
        if below is None:
            below = own.select("gram", (seen + rest / float(1 << BITS)).alias("p"))
        else:
            less = below.select(F.col("gram").alias("less"), F.col("p").alias("q"))
            below = own.join(less, _tail(F.col("gram"), size - 1) == F.col("less")).select("gram", (seen + rest * F.col("q")).alias("p"))
    return below


def ratios(grams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Logs of toxic over plain likelihood: of each gram seen, and for others after a context seen."""
    by = F.shiftright("gram", BITS).alias("context")
    context = grams.groupBy(by).agg(
        *[F.sum(c).alias(f"{c}_all") for c in ("toxic", "plain")], *[F.count_if(F.col(c) > 0).alias(f"{c}_kinds") for c in ("toxic", "plain")]
    )
    context = keep(context)

    def rest(c):
        return F.when(F.col(f"{c}_all") > 0, DISCOUNT * F.col(f"{c}_kinds") / F.col(f"{c}_all")).otherwise(1.0)

    def likely(c):
        own = F.when(F.col(f"{c}_all") > 0, F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) / F.col(f"{c}_all")).otherwise(0.0)
        return own + rest(c) * F.col("p")

    back = shared_backoff(grams).withColumnRenamed("gram", "short")
    own = grams.withColumn("context", F.shiftright("gram", BITS)).withColumn("short", _tail(F.col("gram"), ORDER - 1))
    own = own.join(context, "context").join(back, "short")
    seen = own.select("gram", F.log(likely("toxic") / likely("plain")).cast("float").alias("ratio"))
    other = context.select("context", F.log(rest("toxic") / rest("plain")).cast("float").alias("ratio"))
    return seen, other


def _arrays(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Keys in ascending order and their ratios, of a table in the shared folder."""
    files, folder = open_folder(path)
    found = sorted(i.path for i in files.get_file_info(FileSelector(folder)) if i.base_name.endswith(".parquet"))
    parts = [pq.read_table(f, filesystem=files) for f in found]
    keys, values = (np.concatenate([np.zeros(0, kind), *[p.column(i).to_numpy() for p in parts]]) for i, kind in enumerate((np.int64, np.float32)))
    order = np.argsort(keys)
    return keys[order], values[order]


def _at(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Values of ``wanted``, not a number where ``keys`` has none."""
    if not len(keys):
        return np.full(len(wanted), np.nan, dtype=np.float32)
    place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[place] == wanted, values[place], np.float32(np.nan))


@dataclass
class Lookup:
    """Ratios of grams and, for others, of contexts: all of a model, or those that a block of documents needs."""

    grams: np.ndarray
    ratios: np.ndarray
    contexts: np.ndarray
    rests: np.ndarray

    def find(self, grams: np.ndarray) -> np.ndarray:
        out = _at(self.grams, self.ratios, grams)
        new = np.flatnonzero(np.isnan(out))
        out[new] = _at(self.contexts, self.rests, grams[new] >> BITS)
        return np.nan_to_num(out.astype(np.float64))


def _readable(path: str) -> bool:
    """Whether tasks can open a folder by themselves."""
    try:
        open_folder(path)
    except (OSError, ValueError):  # a store that only Spark knows
        return False
    return True


@lru_cache(maxsize=1)
def _lookup(grams: str, contexts: str) -> Lookup:
    """The whole tables of a model, once for each Python worker; at most ``LOOKUP_GRAMS`` grams."""
    out = Lookup(*_arrays(grams), *_arrays(contexts))
    release()
    return out


@dataclass
class Model:
    """Tables of ratios, with few grams their folders, and weights; ``share`` is the score of every text where a class has no texts."""

    seen: DataFrame | None
    other: DataFrame | None
    folders: tuple[str, str] | None
    weights: np.ndarray | None
    share: float


def features(texts: list[str | None], lookup: Lookup) -> np.ndarray:
    """Of each text: mean log ratio of a character, that of the three most toxic words, how many words are as toxic."""
    found, mine, gap = codes(texts)
    out = np.zeros((len(texts), FEATURES))
    if not len(found):
        return out
    grams, place = np.unique(found, return_inverse=True)
    each = lookup.find(grams)[place]
    sizes = np.bincount(mine, minlength=len(texts))
    out[:, 0] = np.bincount(mine, weights=each, minlength=len(texts)) / np.maximum(sizes, 1)
    first = np.flatnonzero(np.append(True, gap[:-1] | (mine[1:] != mine[:-1])))
    words = np.add.reduceat(each, first)
    of = mine[first]
    order = np.lexsort((-words, of))
    words, of = words[order], of[order]
    starts = np.searchsorted(of, np.arange(len(texts)))
    rank = np.arange(len(of)) - starts[of]
    for k in range(3):
        here = rank == k
        out[of[here], 1 + k] = words[here]
    over = np.maximum(words - STRONG, 0)
    out[:, 4] = np.log1p(np.bincount(of, weights=over > 0, minlength=len(texts)))
    out[:, 5] = np.log1p(np.bincount(of, weights=over, minlength=len(texts)))
    return out


def _over(df: DataFrame, model: Model, fn, schema) -> DataFrame:
    """``fn(rows, lookup)`` over slices of rows with a ``text``, with the ratios of all grams in them."""
    if model.folders is None:
        return _over_blocks(df, model, fn, schema)
    folders = model.folders

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                yield fn(part, _lookup(*folders))

    return df.mapInArrow(run, schema)


def _block_grams(batches):
    """block, gram once for each run of rows of a block, from block, text."""

    def rows(block, grams):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(grams), block, dtype=np.int64)), pa.array(grams)], names=["block", "gram"])

    now, held = None, np.zeros(0, np.int64)
    for batch in batches:
        for part in slices(batch, "text", SLICE_BYTES):
            of = part.column(0).to_numpy(zero_copy_only=False)
            for block in dict.fromkeys(of.tolist()):
                grams = np.unique(codes(part.filter(pa.array(of == block)).column(1).to_pylist())[0])
                if block != now:
                    if len(held):
                        yield rows(now, held)
                    now, held = block, grams
                else:
                    held = np.union1d(held, grams)
    if len(held):
        yield rows(now, held)


def _over_blocks(df: DataFrame, model: Model, fn, schema) -> DataFrame:
    """As ``_over``, where the tables are too large for a task: the different grams of a block are joined with them.

    A gram is there at most once for each run of rows of a block, so a frequent one is no hot
    key. A task holds a block and the ratios of its own grams.
    """
    block = "block"
    while block in df.columns:
        block += "_"

    def deal(batches):
        task, n, held = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                if held and held + part.nbytes > BLOCK_BYTES:
                    n, held = n + 1, 0
                held += part.nbytes
                mine = pa.array(np.full(part.num_rows, task << 32 | n, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([*part.columns, mine], names=[*part.schema.names, block])

    rows = keep(df.mapInArrow(deal, df.withColumn(block, F.lit(0).cast("long")).schema), "zstd")
    grams = rows.select(F.col(block).alias("block"), "text").mapInArrow(_block_grams, "block long, gram long")
    grams = grams.join(model.seen, "gram", "left").withColumn("context", F.shiftright("gram", BITS))
    grams = grams.join(model.other.withColumnRenamed("ratio", "rest"), "context", "left")
    grams = grams.select("block", "gram", F.coalesce("ratio", "rest", F.lit(0).cast("float")).alias("ratio"))

    def run(left, right):
        keys = right.column("gram").to_numpy()
        order = np.argsort(keys)
        none = np.zeros(0, np.int64)
        lookup = Lookup(keys[order], right.column("ratio").to_numpy()[order], none, none.astype(np.float32))
        batches = left.drop_columns([block]).combine_chunks().to_batches()
        return pa.Table.from_batches([fn(part, lookup) for batch in batches for part in slices(batch, "text", SLICE_BYTES)])

    return rows.groupBy(block).cogroup(grams.groupBy("block")).applyInArrow(run, schema)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights and intercept by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -60, 60)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def _remainder(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))


def _calibration(held: DataFrame, texts: DataFrame) -> DataFrame:
    """The ``CALIBRATION_ROWS`` first keys by hash, as far as they have ``2 * CALIBRATION_ROWS`` texts together: key, toxic.

    Keys with few texts come first, so that one with very many is left to the counts.
    """
    first = keep(held.orderBy(F.xxhash64("key"), "key").limit(CALIBRATION_ROWS))
    sizes = texts.select("key").join(F.broadcast(first.select("key")), "key").groupBy("key").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.orderBy("n", F.xxhash64("key"), "key"))  # at most CALIBRATION_ROWS keys
    taken = sizes.withColumn("upto", upto).where(F.col("upto") <= 2 * CALIBRATION_ROWS)
    return keep(first.join(F.broadcast(taken.select("key")), "key"))


def fit(documents: DataFrame, labels: DataFrame, key: str = "doc_id") -> Model:
    """Models of the texts whose label may be learnt: crc32(key) mod 3 is not 1.

    A key with several labels counts as toxic if one says so; null keys and labels are left
    out. Of a fifth of the labelled keys, the ``CALIBRATION_ROWS`` first by hash are held back
    to weigh the features; the rows of all other keys are counted.
    """
    modest_batches(documents.sparkSession)
    known = keep(
        labels.select(F.col(key).alias("key"), F.col("toxic").cast("int").alias("toxic"))
        .where(F.col("key").isNotNull() & F.col("toxic").isin(0, 1))
        .where(_remainder(F.col("key")) % 3 != 1)
        .groupBy("key").agg(F.max("toxic").alias("toxic"))
    )
    held = F.floor(_remainder(F.col("key")) / 3) % 5 == 0
    texts = documents.select(F.col(key).alias("key"), "text").where(F.col("key").isNotNull() & (_remainder(F.col("key")) % 3 != 1))
    sample = _calibration(known.where(held), texts)
    learnt = known.join(F.broadcast(sample.select("key")), "key", "left_anti")
    # Labels grow with the table, so they are never sent whole: the join is the same at every size.
    grams = keep(gram_counts(texts.join(learnt.hint("merge"), "key").select("text", "toxic")))
    sums = grams.agg(F.sum("toxic"), F.sum("plain"), F.count("*")).first()
    if not sums[0] or not sums[1]:
        return Model(None, None, None, None, 1.0 if sums[0] else 0.0)
    seen, other = ratios(grams)
    folders = scratch(documents.sparkSession), scratch(documents.sparkSession)
    if sums[2] <= LOOKUP_GRAMS and _readable(folders[0]):
        # Tasks read these tables from the shared folder: through the driver they would be held there several times.
        for rows, folder in zip((seen, other), folders, strict=True):
            rows.write.parquet(folder)
        model = Model(None, None, folders, None, 0.0)
    else:
        model = Model(keep(seen), keep(other), None, None, 0.0)

    def weigh(part, lookup):
        found = features(part.column(0).to_pylist(), lookup)
        return pa.RecordBatch.from_arrays([part.column(1), *[pa.array(found[:, i]) for i in range(FEATURES)]], names=["toxic", *[f"f{i}" for i in range(FEATURES)]])

    # At most CALIBRATION_ROWS keys of 12 bytes.
    rows = texts.join(F.broadcast(sample), "key").select("text", "toxic")
    rows = _over(rows, model, weigh, "toxic int, " + ", ".join(f"f{i} double" for i in range(FEATURES)))
    rows = rows.orderBy(F.xxhash64(*rows.columns)).toArrow()  # at most 2 * CALIBRATION_ROWS
    y = rows.column(0).to_numpy().astype(float)
    if len(y) and 0 < y.sum() < len(y):
        x = np.column_stack([rows.column(1 + i).to_numpy() for i in range(FEATURES)])
    else:  # too few labels to hold any back: a text is as toxic as its mean ratio says
        x, y = np.eye(FEATURES)[[0, 0]] * [[1.0], [-1.0]], np.array([1.0, 0.0])
    model.weights = _logistic(x, y)
    release()
    return model


def score(documents: DataFrame, model: Model, into: str = "score") -> DataFrame:
    """``documents`` with the score of each whole ``text``: 0 to 1, higher is more toxic; null is empty."""
    if model.weights is None:
        return documents.withColumn(into, F.lit(model.share))
    modest_batches(documents.sparkSession)
    weights = model.weights

    def run(part, lookup):
        z = features(part.column(part.schema.names.index("text")).to_pylist(), lookup) @ weights[:-1] + weights[-1]
        return pa.RecordBatch.from_arrays([*part.columns, pa.array(1 / (1 + np.exp(-np.clip(z, -60, 60))))], names=[*part.schema.names, into])

    return _over(documents, model, run, documents.withColumn(into, F.lit(0.0)).schema)


def toxicity(documents: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``documents``.

    Rows are scored one by one: nulls, repeats and empty texts have a score like others. A
    null doc_id is not held out.
    """
    rows = score(documents.select("doc_id", "text"), fit(documents, labels))
    return rows.select(
        "doc_id",
        (F.col("doc_id").isNotNull() & (_remainder(F.col("doc_id")) % 3 == 1)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def drop_toxic(documents: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The documents predicted not toxic, with all their columns."""
    into = "score"
    while into in documents.columns:
        into += "_"
    return score(documents, fit(documents, labels), into).where(F.col(into) < threshold).drop(into)
