"""Posting lists, vector codes and Merkle manifests against brute force."""

import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from twintable.llm import merkle, posting_lists, vector_codes

VECTORS = "vec_id long, embedding array<float>, label int, digest string, raw int, `list` string, key string, n int, code string"
REST = ("x", 1, "l", "k", 2, "c")
NAN, INF = float("nan"), float("inf")


def usable(v, zero=False):
    return bool(v) and None not in v and bool(np.isfinite(np.array(v, dtype=float)).all()) and (zero or any(v))


@pytest.fixture(scope="module")
def hard_vectors():
    """Clusters, copies, a very common vector, ties, repeated rows and keys, and unusable vectors."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 16))
    rows = [(i, [float(x) for x in np.float32(centres[i % 6] + rng.normal(size=16) * 0.4)], i % 3) for i in range(400)]
    common = rows[3][1]
    rows += [(1000 + i, common, 1) for i in range(200)]
    rows += [(2000, [-x for x in common], 0), (2001, [4 * x for x in common], None), (2020, [0.0] * 16, 0), (2002, [-0.0] * 15 + [1.0], 0), (2003, [0.0] * 15 + [1.0], 0)]
    rows += [(2004, None, 0), (2005, [], 0), (2006, [None] + [1.0] * 15, 0), (2007, [NAN] * 16, 0), (2008, [INF] + [1.0] * 15, 1), (2009, [1.0] * 32, 1)]
    rows += [(40, rows[40][1], 1), (60, rows[61][1], 1), (None, rows[5][1], None), (None, None, None)]
    return rows


@pytest.fixture(scope="module")
def vectors(spark, hard_vectors):
    return spark.createDataFrame([(*r, *REST) for r in hard_vectors], VECTORS).repartition(5).cache()


def exact_neighbours(rows, k):
    """The nearest by inner product, in doubles added up in order; rows that repeat key and vector are one."""
    own = sorted({(i, tuple(np.float32(v).astype(float) + 0.0)) for i, v, _ in rows if i is not None and usable(v) and len(v) == 16})
    ids, x = np.array([o[0] for o in own]), np.array([o[1] for o in own])
    out = Counter()
    for q in range(len(own)):
        if ids[q] % 20 == 0:
            score = np.zeros(len(ids))
            for j in range(x.shape[1]):
                score = score + x[:, j] * x[q, j]
            near = [t for t in np.lexsort((ids, -score)) if ids[t] != ids[q]][:k]
            out.update((int(ids[q]), r + 1, int(ids[t]), float(score[t])) for r, t in enumerate(near))
    return out


def test_one_list_finds_all_neighbours_in_order(vectors, hard_vectors):
    # Two vectors share the key 60: each is a query, and neither is a neighbour of the other.
    got = Counter(tuple(r) for r in posting_lists.nearest(vectors, F.col("vec_id") % 20 == 0).where("query_id <> 60").collect())
    want = Counter({w: n for w, n in exact_neighbours(hard_vectors, 20).items() if w[0] != 60})
    assert got == want and len(want) > 400


@pytest.mark.parametrize("block", [4096, 16])
def test_lists_reach_the_recall_and_full_length(vectors, hard_vectors, monkeypatch, block):
    monkeypatch.setattr(posting_lists, "LIST_ROWS", 12)
    monkeypatch.setattr(posting_lists, "SAMPLED_ROWS", 4)
    monkeypatch.setattr(posting_lists, "BLOCK", block)
    index = posting_lists.build(vectors, k=10)
    assert len(index.lists.centroids) > 20
    held = index.postings.groupBy("digest").agg(F.sum(F.bit_count("mask")).alias("n"), F.size(F.first("ids")).alias("ids")).agg(F.max("n"), F.min("n"), F.max("ids")).first()
    assert held[0] == 2 and held[1] == 1 and held[2] == 11  # boundary vectors lie in two lists
    rows = posting_lists.search(index, vectors.where("vec_id % 20 = 0"), k=10).where("query_id <> 60").collect()
    want = {w for w in exact_neighbours(hard_vectors, 10) if w[0] != 60}
    by_query = Counter(r.query_id for r in rows)
    assert set(by_query.values()) == {10} and set(by_query) == {w[0] for w in want}
    pairs = {(w[0], w[2]) for w in want}
    assert len({(r.query_id, r.vec_id) for r in rows} & pairs) >= 0.9 * len(pairs)


def test_the_walk_finds_what_looking_at_all_centroids_finds():
    x = np.random.default_rng(1).normal(size=(4000, 8))
    lists = posting_lists.fit(x, 120, np.abs(x).max(), np.linalg.norm(x / np.abs(x).max(), axis=1).max(), 20)
    q = np.random.default_rng(2).normal(size=(50, 8))
    far = posting_lists._apart(lists.asked(q), lists.centroids)
    assert (lists.chosen(q) == (far <= lists.ratio * far.min(axis=1, keepdims=True))).mean() > 0.999
    sizes = np.bincount(lists.places(x)[1], minlength=120)
    assert sizes.min() > 0 and sizes.max() < 6 * sizes.mean()


def test_search_of_few_and_no_rows(spark, vectors):
    few = spark.createDataFrame([(20, [1.0, 2.0], 1), (21, [1.0, 2.0], 1), (22, [2.0, 1.0], 1)], "vec_id long, embedding array<double>, label int")
    got = posting_lists.nearest(few, F.col("vec_id") % 20 == 0).collect()
    assert [tuple(r) for r in sorted(got)] == [(20, 1, 21, 5.0), (20, 2, 22, 4.0)]
    none = posting_lists.nearest(vectors.limit(0), F.col("vec_id") % 20 == 0)
    assert none.count() == 0 and none.columns == ["query_id", "rank", "vec_id", "score"]


def lloyd_by_hand(rows, parts=16, entries=64, rounds=2):
    own = [(i, label, [int(np.floor(256 * float(np.float32(c)))) for c in v]) for i, v, label in rows if usable(v, zero=True) and len(v) == 16]
    packed = lambda w: np.array(w, dtype="<i4").tobytes()
    own.sort(key=lambda r: (r[0] is not None, r[0] or 0, packed(r[2])))
    books = [[[r[2][p]] for r in own[:entries]] for p in range(parts)]
    near = lambda book, x: min(range(len(book)), key=lambda e: (sum((a - b) ** 2 for a, b in zip(book[e], x, strict=True)), e))
    for _ in range(rounds):
        for p in range(parts):
            of = {}
            for r in own:
                of.setdefault(near(books[p], [r[2][p]]), []).append([r[2][p]])
            for e, xs in of.items():
                books[p][e] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    sha = hashlib.sha256(",".join(str(c) for book in books for entry in book for c in entry).encode()).hexdigest()
    coded, by_label = [], Counter()
    for i, label, x in own:
        code = [near(books[p], [x[p]]) for p in range(parts)]
        error = sum((books[p][c][0] - x[p]) ** 2 for p, c in enumerate(code))
        by_label[label] += error
        coded.append((i, "".join(f"{c:02x}" for c in code), error, label))
    return Counter((i, code, error, by_label[label], sha) for i, code, error, label in coded)


@pytest.mark.parametrize("space", [4 << 20, 64 * 20])
def test_vector_codes_equal_lloyd_by_hand(vectors, hard_vectors, monkeypatch, space):
    monkeypatch.setattr(vector_codes, "BLOCK_BYTES", space)
    assert Counter(tuple(r) for r in vector_codes.vector_codes(vectors).collect()) == lloyd_by_hand(hard_vectors)


def test_dual_tree_assigns_as_all_distances_do():
    rng = np.random.default_rng(0)
    for trial in range(150):
        n, w, k, spread = int(rng.integers(1, 900)), int(rng.integers(1, 6)), int(rng.integers(1, 65)), int(rng.choice([1, 3, 40, 1 << 26]))
        x, c = rng.integers(-spread, spread + 1, size=(n, w)), rng.integers(-spread, spread + 1, size=(k, w))
        if trial % 3 == 0:  # entries that are parts themselves, some of them twice
            c = x[rng.integers(0, n, k)]
        x = x[vector_codes.tree_order(x, vector_codes._depth(n))]
        nearest, sums, counts = vector_codes.assign(x, vector_codes.Entries(c))
        want = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, want, x)
        assert (nearest == want).all() and (sums == total).all() and (counts == np.bincount(want, minlength=k)).all()


def test_vector_codes_of_few_no_and_unfit_rows(spark, vectors):
    assert vector_codes.vector_codes(vectors.limit(0)).count() == 0
    one = vector_codes.vector_codes(vectors.where("vec_id = 7")).collect()
    assert [(r.code, r.error, r.label_error) for r in one] == [("00" * 16, 0, 0)]
    bad = spark.createDataFrame([(1, [1.0] * 10, 1)], "vec_id long, embedding array<double>, label int")
    with pytest.raises(ValueError, match="don't divide"):
        vector_codes.vector_codes(bad)


def manifest_by_hand(rows):
    """Rows as (key, group, fields, changed fields)."""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    sized = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    groups = {}
    for key, group, fields, changed in rows:
        groups.setdefault(group, []).append((key, sha("".join(map(sized, fields))), sha("".join(map(sized, changed)))))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha("".join(out[-1][i : i + 8])) for i in range(0, len(out[-1]), 8)])
        return out

    def way(tree, i):
        found = []
        for nodes in tree[:-1]:
            run = i // 8 * 8
            found.append(("".join(nodes[run:i]), "".join(nodes[i + 1 : run + 8])))
            i //= 8
        return found

    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[g] = levels([r[1] for r in groups[g]])
    crown = levels([trees[g][-1][0] for g in order])
    out = Counter()
    for turn, g in enumerate(order):
        for i, (key, leaf, changed) in enumerate(groups[g]):
            steps, h = way(trees[g], i) + way(crown, turn), changed
            for before, after in steps:
                h = sha(before + h + after)
            out[key, leaf, trees[g][-1][0], crown[-1][0], sha("".join(b + a for b, a in steps)), h, h == crown[-1][0]] += 1
    return out


@pytest.mark.parametrize("levels", [4, 1, 2])
def test_manifest_equals_a_tree_by_hand(spark, hard_rows, monkeypatch, levels):
    monkeypatch.setattr(merkle, "LEVELS", levels)  # one level: a tier of blocks for each
    monkeypatch.setattr(merkle, "BLOCK_BITS", 3 * levels)
    langs = [None, "en", "", "zz", "é", "a b"]
    rows = [(d, t, langs[min(i % 9, 5)] if i < 40 else "en", f"s{i % 3}" if i % 5 else None, None if i % 4 else i) for i, (d, t) in enumerate(hard_rows)]
    rows += [(5000 + i, f"Row {i}", "en", "hot", i) for i in range(700)] + [(9, "same Text", "en", "hot", 1)] * 80
    rows += [(1, "ALONE", "only", None, 5)]
    more = ("h", "g", 3, "w")
    df = spark.createDataFrame([(*r, *more) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, hash string, grp string, rank int, way string")

    def lowered(d, t):
        hit = d is not None and t is not None and zlib.crc32(str(d).encode()) % 3 == 0
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in t) if hit else t

    want = manifest_by_hand([(d, g, (d, s, g, n, t), (d, s, g, n, lowered(d, t))) for d, t, g, s, n in rows])
    found = merkle.manifest(df.repartition(4), changed={"text": merkle.lowered(F.col("doc_id"), F.col("text"))})
    got = found.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("way")), "folded_root", "verified").collect()
    assert Counter(tuple(r) for r in got) == want
    assert {r.verified for r in got} == {True, False}


def test_manifest_of_one_and_no_rows(spark, no_docs, hard_docs):
    assert merkle.manifest(no_docs).count() == 0
    one = merkle.manifest(hard_docs.where("doc_id = 4")).collect()
    assert [(r.leaf == r.subroot == r.root == r.folded_root, r.way, r.verified) for r in one] == [(True, [], True)]
