"""Networks of columns: codes, structure, rare values, and the private one's budget."""

import itertools
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from twintable.functions.noise import wide_uniform_index
from twintable.operators import network
from twintable.operators.network import BayesNetwork, Coding, PrivateBayesNetwork, key_number, number_key, private_edges, search_network, set_entropies
from twintable.operators.sampling import SAMPLERS


def entropy(rows):
    n = len(rows)
    return -sum(k / n * math.log2(k / n) for k in Counter(rows).values())


@pytest.mark.parametrize("together", [1 << 16, 50])
def test_entropies_of_sets_equal_counting(spark, monkeypatch, together):
    monkeypatch.setattr(network, "COUNTED_ROWS", together)
    rng = np.random.default_rng(0)
    rows = [tuple("abcdefgh"[int(x)] for x in rng.integers(0, 2 + np.arange(4) * 2)) for _ in range(700)]
    df = spark.createDataFrame(rows, "w string, x string, y string, z string").repartition(3)
    sets = [s for k in (1, 2, 3, 4) for s in itertools.combinations("wxyz", k)]
    got = set_entropies(df, {c: list("abcdefgh") for c in "wxyz"}, sets)
    for s in sets:
        assert got[s] == pytest.approx(entropy([tuple(r["wxyz".index(c)] for c in s) for r in rows]))
    assert set_entropies(df.limit(0), {c: ["a"] for c in "wxyz"}, [("w",)]) == {("w",): 0.0}


def test_search_counts_pairs_and_follows_the_information():
    rng = np.random.default_rng(3)
    n, names = 400, [f"c{i}" for i in range(30)]
    data = {c: rng.integers(0, 3, n) for c in names}
    data["c7"] = data["c3"]  # a copy
    data["c9"] = data["c1"] + 3 * data["c2"]
    counted = []

    def entropies(sets):
        counted.append(len(sets))
        return {s: entropy(list(zip(*[data[c] for c in s], strict=True))) for s in sets}

    found = search_network(names, 2, entropies, lambda s: int(np.argmax(s)), "c0")
    nodes = {x.name: x.parents for x in found}
    assert len(counted) == 2 and max(counted) <= 30 + 30 * 29  # two passes, no triple that isn't a choice
    assert [x.name for x in found][0] == "c0" and set(nodes) == set(names)
    seen = set()
    for x in found:
        assert set(x.parents) <= seen and len(x.parents) == min(2, len(seen))
        seen.add(x.name)
    assert "c3" in nodes["c7"] or "c7" in nodes["c3"]
    def told(child, *parents):
        whole = entropies([(child,), parents, (child, *parents)])
        return whole[(child,)] + whole[parents] - whole[(child, *parents)]

    # First parents make a tree of the most information: no tree of Kruskal's has more.
    root = {c: c for c in names}
    best = 0.0
    for a, b in sorted(itertools.combinations(names, 2), key=lambda p: -told(*p)):
        ends = []
        for c in (a, b):
            while root[c] != c:
                c = root[c]
            ends.append(c)
        if ends[0] != ends[1]:
            root[ends[0]] = ends[1]
            best += told(a, b)
    assert sum(told(x.name, x.parents[0]) for x in found[1:]) == pytest.approx(best)
    for i, x in enumerate(found):
        if len(x.parents) == 2:
            assert told(x.name, *x.parents) == pytest.approx(max(told(x.name, x.parents[0], p.name) for p in found[:i] if p.name != x.parents[0]))
    assert all(not x.parents for x in search_network(names, 0, entropies, lambda s: 0, "c0"))


@pytest.mark.parametrize("structure", [None, [("kind", ()), ("name", ("kind",)), ("size", ("kind", "name"))]])
def test_rare_values_keep_their_dependence(spark, structure):
    rows = [("abc"[i % 3], f"{'abc'[i % 3]}-{i * 7 % 4000}", i % 3 * 10 + i % 2) for i in range(6000)]
    rows += [("d", "common", 5)] * 900 + [(None, None, None)] * 60
    df = spark.createDataFrame(rows, "kind string, name string, size int").repartition(5)
    fitted = BayesNetwork(max_values=40, buckets=16, structure=structure).fit(df)
    assert fitted.wide == ["name"] and max(len(c.codes()) for c in fitted.codings.values()) <= 1 + 40 + 16
    made = fitted.generate(5000).cache()
    assert made.dtypes == df.dtypes and made.count() == 5000
    assert made.select("name").distinct().count() > 1200
    wrong = made.where("kind is distinct from if(name = 'common', 'd', substr(name, 1, 1))")
    assert wrong.count() == 0
    assert made.where("kind = 'a' and size > 1 or kind = 'c' and size < 20 or (kind is null) != (size is null)").count() == 0
    assert abs(made.where("name = 'common'").count() / 5000 - 900 / 6960) < 0.02
    again = fitted.generate(5000)
    assert Counter(map(tuple, made.collect())) == Counter(map(tuple, again.repartition(2).collect()))


def test_values_that_look_like_codes_and_nested_ones(spark):
    rows = [(v, [i % 3, None], bytearray([i % 2, 255]), i % 2 == 0) for i, v in enumerate(["#1", "=x", "", "\u0000", None, "#", "0"] * 30)]
    df = spark.createDataFrame(rows, "text string, list array<int>, raw binary, flag boolean")
    for kept in (3, 256):
        made = BayesNetwork(max_values=kept, buckets=2).fit(df).generate(400).cache()
        assert made.dtypes == df.dtypes
        # the text that marks a null is taken for one
        assert {r["text"] for r in made.collect()} <= {"#1", "=x", "", None, "#", "0", "\u0000"}
        assert {tuple(r["list"]) for r in made.collect()} == {(0, None), (1, None), (2, None)}
        assert {bytes(r["raw"]) for r in made.collect()} == {b"\x00\xff", b"\x01\xff"}
    empty = BayesNetwork().fit(df.limit(0))
    assert empty.rows == 0 and empty.generate().count() == 0


def test_keys_of_numbers_keep_order_and_come_back(spark):
    xs = [-1.7e308, -5.0, -1.0, -1e-3, 0.0, 1e-3, 0.5, 3.25, 1e6, 1.7e308]
    keys = [r["k"] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(number_key(F.col("x")).alias("k")).collect()]
    assert keys == sorted(set(keys))
    for x, k in zip(xs, keys, strict=True):
        assert key_number(k) <= x + abs(x) * 1e-9 and x <= key_number(k + 1) + abs(x) * 1e-3


def test_private_edges_come_near_the_quantiles(spark):
    df = spark.range(40000).select((F.col("id") % 1000 / 10).alias("x"), F.lit(7.0).alias("same"), F.when(F.col("id") < 0, 1.0).alias("none"))
    edges = private_edges(df, ["x", "same", "none"], 4, 5.0, np.random.default_rng(1))
    assert np.allclose(edges["x"][:5], [0, 25, 50, 75, 99.9], atol=2.5)
    assert edges["same"][0] == pytest.approx(7, rel=1e-4) and edges["same"][-1] == pytest.approx(7, rel=1e-4)
    assert len(edges["none"]) >= 2


def test_private_network_spends_its_budget_and_hides_single_rows(spark):
    rows = [("ab"[i % 2], float(i % 50), i % 7) for i in range(3000)] + [("unheard of", 1e12, 6)]
    df = spark.createDataFrame(rows, "kind string, size double, n int")
    fitted = PrivateBayesNetwork(epsilon=4.0, delta=1e-5, seed=11, public=False).fit(df)
    assert fitted.ledger.spent() == pytest.approx(4.0) and fitted.ledger.spent_delta() == pytest.approx(1e-5)
    by_what = {r["what"]: r["epsilon"] for r in fitted.ledger.table(spark).collect()}
    assert set(by_what) == {"values of kind", "edges of size", "edges of n", "parents", "cell counts"}
    made = fitted.generate(3001)
    assert {r["kind"] for r in made.select("kind").distinct().collect()} <= {"a", "b", None}
    assert made.agg(F.max("size")).first()[0] < 100
    with pytest.raises(ValueError, match="budget"):
        fitted.ledger.spend("more", "laplace", 0.5)


def test_values_taken_as_public_are_listed(spark):
    df = spark.range(300).select((F.col("id") % 3).cast("string").alias("k"), F.when(F.col("id") % 2 == 0, F.col("id") * 0.5).alias("x"))
    fitted = PrivateBayesNetwork(epsilon=2.0, seed=3).fit(df)
    assert [(e[0], e[1], e[2]) for e in fitted.ledger.entries][:2] == [("values of k", "taken as public", 0.0), ("values of x", "taken as public", 0.0)]
    assert fitted.ledger.spent() == pytest.approx(2.0)
    made = fitted.generate(400).cache()
    assert made.where("k is null").count() == 0 and made.where("x is null").count() > 0


def test_public_knowledge_costs_nothing_and_nulls_stay_null(spark):
    df = spark.range(400).select(F.when(F.col("id") % 2 == 0, F.col("id") % 90).alias("x"), F.lit("a").alias("k"))
    fitted = PrivateBayesNetwork(epsilon=1e6, bounds={"x": (10, 60)}, domains={"k": ["a", "b"]}, seed=1).fit(df)
    assert [e[0] for e in fitted.ledger.entries] == ["parents", "cell counts"]
    made = fitted.generate(2000).cache()
    assert abs(made.where("x is null").count() / 2000 - 0.5) < 0.06
    assert made.where("x < 10 or x > 60").count() == 0 and fitted.codings["k"] == Coding(values=("a", "b"))


def test_whole_numbers_over_the_whole_range(spark):
    lo, hi = -9 * 10**18, 9 * 10**18
    got = [r[0] for r in spark.range(4000).select(wide_uniform_index(lo, hi, 5, F.col("id"))).collect()]
    assert min(got) < lo * 0.95 and max(got) > hi * 0.95 and min(got) >= lo and max(got) <= hi
    assert len({g % 2 for g in got}) == 2 and abs(sum(g > 0 for g in got) - 2000) < 200
    df = spark.createDataFrame([(lo,), (hi,)], "x bigint")
    made = SAMPLERS["uniform_domain"]().fit(df).generate(50)
    assert made.dtypes == [("x", "bigint")] and made.distinct().count() > 40


@pytest.mark.parametrize("dense, sparse", [(1 << 22, 1 << 20), (100, 1 << 20), (0, 40)])
def test_entropies_with_cells_in_arrays_and_without(spark, monkeypatch, dense, sparse):
    monkeypatch.setattr(network, "COUNTED_ROWS", 50)
    monkeypatch.setattr(network, "DENSE_CELLS", dense)
    monkeypatch.setattr(network, "SPARSE_CELLS", sparse)
    rows = [("abcdefgh"[i % 8], "abcde"[i * i % 5], "abc"[i // 7 % 3]) for i in range(600)]
    sets = [("x",), ("x", "y"), ("x", "y", "z")]
    got = set_entropies(spark.createDataFrame(rows, "x string, y string, z string").coalesce(1), {c: list("abcdefgh") for c in "xyz"}, sets)
    for s in sets:
        assert got[s] == pytest.approx(entropy([tuple(r["xyz".index(c)] for c in s) for r in rows]))


def test_draws_halve_the_codes(spark):
    """Codes follow their shares, and no row looks at all codes of its column."""
    rows = [(f"v{i % 300 if i % 2 else 0:03}", "ab"[i % 2]) for i in range(3000)]
    fitted = BayesNetwork(structure=[("v", ()), ("k", ("v",))]).fit(spark.createDataFrame(rows, "v string, k string"))
    made = fitted.generate(4000)
    assert "lambdafunction" not in made._jdf.queryExecution().analyzed().toString()
    counts = Counter(r["v"] for r in made.collect())
    assert counts["v000"] == pytest.approx(2000, rel=0.1) and set(counts) <= {r[0] for r in rows}
