"""Joins, components and repeated strings against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from twintable.llm import metric_join, ngram_join, suffix_dedup
from twintable.llm.components import components


def reach(links: dict) -> dict:
    """The smallest vertex that each vertex reaches."""
    out = {}
    for v in sorted(links):
        if v not in out:
            open_ = [v]
            out[v] = v
            while open_:
                for w in links[open_.pop()]:
                    if w not in out:
                        out[w] = v
                        open_.append(w)
    return out


def test_components_of_paths_stars_and_loops(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(60)] + [(200, i) for i in range(100, 140)] + [(300, 300)]
    edges += [(rng.randint(400, 480), rng.randint(400, 480)) for _ in range(50)] * 2
    rng.shuffle(edges)
    links = defaultdict(set)
    for a, b in edges:
        if a != b:
            links[a].add(b)
            links[b].add(a)
    got = {r.vertex: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == reach(links)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingle_set(text):
    w = re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").lower().encode())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


@pytest.mark.parametrize("block", [512, 3])
def test_ngram_join_equals_all_pairs(hard_docs, hard_rows, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "TEXT_BLOCK", block)
    sets = [shingle_set(t) for _, t in hard_rows]
    links = {i: {j for j in range(len(sets)) if i != j and sets[i] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])} for i in range(len(sets))}
    ids = [-1 if d is None else d for d, _ in hard_rows]
    group = defaultdict(set)
    for i, r in reach(links).items():
        group[r].add(i)
    want = Counter()
    for members in group.values():
        least = min(ids[i] for i in members)
        want.update((ids[i], least, len(links[i])) for i in members)
    got = Counter((-1 if r.doc_id is None else r.doc_id, -1 if r.class_id is None else r.class_id, r.n_links) for r in ngram_join.ngram_jaccard(hard_docs).collect())
    assert got == want


def test_one_of_each_keeps_the_smallest_and_all_columns(hard_docs, hard_rows, no_docs):
    kept = ngram_join.one_of_each(hard_docs)
    assert kept.columns == hard_docs.columns
    sets = [(d, shingle_set(t)) for d, t in hard_rows]
    got = Counter((-1 if r.doc_id is None else r.doc_id) for r in kept.collect())
    assert got[100] == 0  # copies of 12 go
    assert got[7] == 2 and got[9] == got[10] == 0  # the smallest of a class is the copy of 9 that has id 7; the other text of id 7 is alone
    assert got[-1] >= 1 and all(got[d] == 1 for d, s in sets if d is not None and d < 5)
    assert ngram_join.one_of_each(no_docs).count() == 0 and ngram_join.ngram_jaccard(no_docs).count() == 0


def test_pruning_hardly_drops_pairs_at_the_threshold():
    rng = np.random.default_rng(1)
    common = rng.integers(0, 1 << 63, 800, dtype=np.uint64)
    lost = 0
    for _ in range(40):
        a, b = (np.unique(np.append(common, rng.integers(0, 1 << 63, 100, dtype=np.uint64))) for _ in range(2))
        lost += len(ngram_join.pruned(np.array([ngram_join.sketch(a)]), np.array([ngram_join.sketch(b)]))[0]) == 0
    assert lost == 0
    assert ngram_join.LEAST[80] < 60


@pytest.mark.parametrize("per_pivot,block", [(4096, 2048), (6, 7)])
def test_metric_join_equals_all_pairs(spark, monkeypatch, per_pivot, block):
    monkeypatch.setattr(metric_join, "PER_PIVOT", per_pivot)
    monkeypatch.setattr(metric_join, "BLOCK", block)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(9, 8))
    rows = [(i, [float(x) for x in np.float32(centres[i % 9] + rng.normal(size=8) * 0.06 * (i % 4))], i % 2) for i in range(120)]
    rows += [(500, rows[0][1], 0), (501, rows[0][1], 0), (502, rows[0][1], 1), (503, None, 0), (504, [], 0), (505, [0.0] * 8, 0), (506, [None] + [1.0] * 7, 0), (507, [float("nan")] * 8, 0), (508, [float("inf")] + [1.0] * 7, 0)]
    rows += [(509, rows[0][1], None), (510, [2 * x for x in rows[0][1]], 0), (511, [1.0, 2.0], 0), (512, [1.0, 2.0], 0), (5, rows[3][1], 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, digest string").repartition(4)
    usable = {}
    for i, (_, v, label) in enumerate(rows):
        if v and label is not None and None not in v and np.isfinite(v).all() and any(v):
            usable[i] = (label, np.array(np.float32(v), dtype=float))
    links = {i: set() for i in range(len(rows))}
    for i, (a, x) in usable.items():
        for j, (b, y) in usable.items():
            if i != j and a == b and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                links[i].add(j)
    group = defaultdict(set)
    for i, r in reach(links).items():
        group[r].add(i)
    want = Counter()
    for members in group.values():
        least = min(rows[i][0] for i in members)
        want.update((rows[i][0], len(links[i]), least, rows[i][0] == least) for i in members)
    assert Counter(tuple(r) for r in metric_join.metric_join(df).collect()) == want
    assert metric_join.metric_join(df.limit(0)).count() == 0


def removed(texts):
    seen = Counter(t[i : i + 400] for t in texts for i in range(len(t) - 399))
    out = Counter()
    for t in texts:
        mark = np.zeros(len(t) + 2, dtype=np.int8)
        for i in range(len(t) - 399):
            if seen[t[i : i + 400]] > 1:
                mark[i + 1 : i + 401] = 1
        kept = bytes(b for b, m in zip(t, mark[1:-1], strict=True) if not m)
        out[(len(t), int(mark.sum()), int((np.diff(mark) == 1).sum()), hashlib.sha256(kept).hexdigest())] += 1
    return out


@pytest.mark.parametrize("collection,cut", [(1024, 8), (2, 4)])
def test_repeated_strings_equal_brute_force(hard_docs, hard_rows, no_docs, monkeypatch, collection, cut):
    monkeypatch.setattr(suffix_dedup, "COLLECTION", collection)
    monkeypatch.setattr(suffix_dedup, "CUT", cut)
    got = suffix_dedup.remove_repeats(hard_docs).collect()
    want = removed([(t or "").encode() for _, t in hard_rows])
    assert Counter(tuple(r)[1:] for r in got) == want
    assert Counter(r.doc_id for r in got) == Counter(d for d, _ in hard_rows)
    assert sum(r.n_removed for r in got) > 3000
    assert suffix_dedup.remove_repeats(no_docs).count() == 0
