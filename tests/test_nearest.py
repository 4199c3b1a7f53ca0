import numpy as np
import pyarrow as pa
import pytest

from twintable.operators import nearest
from twintable.operators.privacy import distance_summary, privacy_summary


def brute(real, syn, skip_self):
    """Distances by definition, over all pairs."""
    fill = np.median([r[0] for r in real if r[0] is not None])
    names = [r[2] for r in real if r[2] is not None]
    mode = min(set(names), key=lambda v: (-names.count(v), v))

    def clean(rows):
        return [(fill if x is None else x, y, mode if c is None else c, d) for x, y, c, d in rows]

    real, syn = clean(real), clean(syn)
    sd = [np.std([r[j] for r in real]) or 1.0 for j in (0, 1)]
    known = [{r[j] for r in real} for j in (2, 3)]
    out = []
    for i, s in enumerate(syn):
        best = np.inf
        for k, r in enumerate(real):
            if skip_self and i == k:
                continue
            d = sum(((s[j] - r[j]) / sd[j]) ** 2 for j in (0, 1))
            d += sum(0 if s[j] == r[j] else 2 if s[j] in known[j - 2] else 1 for j in (2, 3))
            best = min(best, d)
        out.append(np.sqrt(best))
    return np.sort(out)


def spread(distances):
    return np.sort([r["distance"] for r in distances.collect() for _ in range(r["n"])])


def make(rng, n, hot):
    rows = []
    for i in range(n):
        if i < hot:  # one category tuple, distinct numbers
            rows.append((float(rng.normal() * 0.1), float(rng.normal() * 0.1), "a", "p"))
        elif i < hot + n // 10:  # copies
            rows.append((5.0, -5.0, "b", "q"))
        else:
            rows.append((
                None if rng.random() < 0.1 else float(rng.normal() * 3),
                float(rng.integers(0, 6)),
                None if rng.random() < 0.1 else str(rng.choice(["a", "b", "c"])),
                str(rng.choice(["p", "q", "r", "s"])),
            ))
    return rows


SCHEMA = "x double, y double, c string, d string, label string"


@pytest.mark.parametrize("pivots,block", [(1024, 8192), (7, 16), (1, 8192)])
def test_against_all_pairs(spark, monkeypatch, pivots, block):
    monkeypatch.setattr(nearest, "MAX_PIVOTS", pivots)
    monkeypatch.setattr(nearest, "BLOCK_ROWS", block)
    monkeypatch.setattr(nearest, "TILE_CELLS", 200)
    rng = np.random.default_rng(11)
    real, syn = make(rng, 180, 60), make(rng, 120, 40)
    syn += [(0.0, 0.0, "new", "p"), (100.0, 100.0, "new", "other"), real[70][:2] + ("c", "s")]
    r = spark.createDataFrame([(*row, "L") for row in real], SCHEMA)
    s = spark.createDataFrame([(*row, "L") for row in syn], SCHEMA)
    assert spread(nearest.synthetic_to_real(r, s, "label")) == pytest.approx(brute(real, syn, False))
    assert spread(nearest.real_to_real(r, "label")) == pytest.approx(brute(real, real, True))


def test_numbers_only_and_categories_only(spark):
    rng = np.random.default_rng(5)
    values = [(float(v),) for v in rng.normal(size=50)]
    df = spark.createDataFrame(values, "x double")
    got = spread(nearest.real_to_real(df, None))
    flat = np.array([v[0] for v in values]) / np.std(values)
    gaps = np.abs(flat[:, None] - flat[None, :]) + np.eye(50) * 1e9
    assert got == pytest.approx(np.sort(gaps.min(axis=1)))
    words = spark.createDataFrame([("a",), ("b",), ("b",)], "w string")
    assert spread(nearest.real_to_real(words, None)) == pytest.approx([0, 0, np.sqrt(2)])


def test_single_row(spark):
    df = spark.createDataFrame([(1.0,)], "x double")
    row = nearest.real_to_real(df, None).first()
    assert row["n"] == 1 and not np.isfinite(row["distance"])


def test_privacy_of_a_copy(spark, goods):
    row = privacy_summary(goods, goods, "grade", ["component_type"]).first()
    assert row["exact_overlap_with_real_train_rate"] == 1.0
    assert row["syn_to_real_mean"] == 0.0 and row["suspiciously_close_rate"] == 1.0


def test_distance_summary_weights(spark):
    df = spark.createDataFrame([(2, 1.0), (1, 4.0)], "n bigint, distance double")
    row = distance_summary(df, "side").first()
    assert (row["min"], row["median"], row["mean"]) == pytest.approx((1.0, 1.0, 2.0))


@pytest.mark.parametrize("cell,pairs", [(8, 50), (1, 7), (64, 200_000)])
def test_small_cells_and_few_pairs_at_a_time(spark, monkeypatch, cell, pairs):
    monkeypatch.setattr(nearest, "CELL_ROWS", cell)
    monkeypatch.setattr(nearest, "PAIRS", pairs)
    rng = np.random.default_rng(23)
    real, syn = make(rng, 300, 90), make(rng, 150, 40)
    syn += [(0.0, 0.0, "new", "p"), (100.0, 100.0, "new", "other")]
    r = spark.createDataFrame([(*row, "L") for row in real], SCHEMA)
    s = spark.createDataFrame([(*row, "L") for row in syn], SCHEMA)
    assert spread(nearest.synthetic_to_real(r, s, "label")) == pytest.approx(brute(real, syn, False))
    assert spread(nearest.real_to_real(r, "label")) == pytest.approx(brute(real, real, True))


def compared(n):
    """Boxes looked at and rows compared for a row, where ``n`` rows differ in two numbers and two categories."""
    rng = np.random.default_rng(3)
    values = np.column_stack([rng.integers(0, 50, n), rng.random(n) * 900, rng.integers(0, 64, n), rng.integers(0, 25, n)]).astype(float)
    deviations = [values[:, 0].std(), values[:, 1].std()]
    pivots = values[rng.random(n) < nearest.CELL_PIVOTS / nearest.CELL_ROWS]
    tree = nearest._halved(pivots, deviations, n / len(pivots))
    cell, _ = tree.home(values)
    names = ["a", "b", "c", "d"]
    order = np.argsort(cell, kind="stable")
    found, starts, rows = np.unique(cell[order], return_index=True, return_counts=True)
    box = {f"{side}_{x}": by.reduceat(values[order, j], starts) for side, by in (("low", np.minimum), ("high", np.maximum)) for j, x in enumerate(names)}
    tree = tree.with_boxes(pa.table({"cell": found, "rows": rows, **box}), names)
    asked = values[:500]
    weights = np.full((500, 2), 2.0)
    members = dict(zip(found, np.split(values[order], starts[1:])))
    bound = np.empty(500)
    for i in range(500):
        square = nearest._square_distances(asked[i : i + 1], weights[:1], members[cell[i]], deviations)
        bound[i] = square[square > 0].min()
    pairs = [(row, node) for rows_, nodes in tree.reached(asked, weights, bound, deviations) for row, node in zip(rows_, nodes)]
    return len(pairs) / 500, sum(len(members[node]) for _, node in pairs) / 500


def test_work_of_a_row_does_not_grow_with_the_table():
    few, many = compared(40_000), compared(640_000)
    assert many[0] < 2 * few[0] and many[1] < 2 * few[1]
    assert many[1] < 20 * nearest.CELL_ROWS


def test_unique_category_does_not_make_cells():
    rng = np.random.default_rng(4)
    sample = np.column_stack([rng.random(2000), np.arange(2000.0)])
    tree = nearest._halved(sample, [sample[:, 0].std()], 100.0)
    assert set(tree.column) == {-1, 0}
