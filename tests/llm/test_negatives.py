"""Hard negatives against a plain version that scores every pair."""

import math

import numpy as np
import pytest

from lodestrata.llm import negatives, queries

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows):
    rows = [(v, [min(max(math.floor(256 * x), -(2**24)), 2**24) for x in e], (label + 1) % 10 if v is not None and v % 7 == 0 else label)
            for v, e, label in rows if label is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    first = lambda found: sorted(found, key=lambda r: (-r[0], math.inf if r[1] is None else r[1]))[:5]
    out = []
    for a, (anchor, x, label) in enumerate(rows):
        if anchor is None or anchor % 100:
            continue
        scored = [(sum(map(int.__mul__, x, y)), v, own) for b, (v, y, own) in enumerate(rows) if b != a and len(x) == len(y)]
        for score, positive, _ in first([s for s in scored if s[2] == label]):
            found = first([s for s in scored if s[2] != label and 80 * score <= 100 * s[0] <= 100 * score])
            out += [(anchor, positive, k, v, score, s) for k, (s, v, _) in enumerate(found, 1)]
    return sorted(out, key=str)


def run(spark, rows, cell_bytes=negatives.CELL_BYTES, schema=SCHEMA):
    return sorted((tuple(r) for r in negatives.mine(spark.createDataFrame(rows, schema), cell_bytes).collect()), key=str)


def clustered(seed, n, dims, centres, spread):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centres, dims))
    x = middle[rng.integers(centres, size=n)] + spread * rng.normal(size=(n, dims))
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    return [(k, row.tolist(), int(label)) for k, (row, label) in enumerate(zip(x, rng.choice([0, 0, 0, 1, 2, 3], size=n), strict=True))]


@pytest.mark.parametrize(("spread", "cell_bytes"), [(0.2, 900), (3.0, 900), (0.05, negatives.CELL_BYTES)])
def test_many_small_cells_and_one_large(spark, spread, cell_bytes):
    rows = clustered(1, 1500, 6, 12, spread)
    rows[:700:70] = [(k, rows[1][1], 1) for k, *_ in rows[:700:70]]  # equal vectors, anchors among them
    want = plain(rows)
    assert len(want) > 100 and run(spark, rows, cell_bytes) == want


def test_a_search_ends_before_the_last_ring(spark, monkeypatch):
    rounds, scanned = [], negatives._scanned
    monkeypatch.setattr(negatives, "_scanned", lambda blocks, store, positives: rounds.append(positives) or scanned(blocks, store, positives))
    rows = clustered(2, 3000, 3, 40, 0.05)
    assert run(spark, rows, 600) == plain(rows)
    rings = math.ceil(math.sqrt(3000 / negatives._cell_rows(3, 600))) ** 2
    every = next(k for k in range(9) if negatives.FIRST * negatives.GROWTH**k >= rings) + 1
    assert rounds.count(False) < every


def test_odd_rows(spark):
    rows = [(100, [1.0, 0.0], 1), (200, [], 1), (1, [], 1), (2, [], 2), (300, [0.5], None), (400, None, 1), (500, [1.0, None], 1), (600, [float("nan"), 1.0], 1)]
    rows += [(3, [0.9, 0.1], 1), (4, [0.9, 0.2], 2), (4, [0.9, 0.2], 2), (None, [0.9, 0.2], 2), (None, [0.8, 0.1], 1), (7, [1.0, 0.0], 0), (8, [1e300, -1e300], 1), (9, [70000.0, 3.0], 2)]
    rows += [(700, [-1.0, 0.0], 3), (10, [1.0, 0.1], 3), (11, [-0.9, 0.1, 0.0], 3), (100, [1.0, 0.0], 1), (800, [0.0, -0.0], 5), (12, [0.0, 0.0], 5), (13, [0.001, 0.0], 4)]
    assert run(spark, rows) == plain(rows) and run(spark, rows, 1) == plain(rows)
    assert any(r[0] == 200 for r in plain(rows)) and any(r[3] is None for r in plain(rows))
    assert run(spark, []) == [] and run(spark, [(100, [1.0], 1)]) == [] and run(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []
    clashing = [(v, e, label, "x", 1) for v, e, label in rows]
    assert run(spark, clashing, schema=f"{SCHEMA}, uid string, part int") == plain(rows)


def test_long_vectors_with_large_components(spark):
    rng = np.random.default_rng(4)
    rows = [(k, (rng.normal(size=2000) * 3e4).tolist(), k % 3) for k in range(40)] + [(100, [6e4] * 2000, 0), (101, [6e4] * 1999 + [5.9e4], 0), (102, [6e4] * 1998 + [5e4] * 2, 1)]
    assert run(spark, rows) == plain(rows)


def test_a_ring_s_least_distance_holds():
    rng = np.random.default_rng(6)
    x = rng.integers(-256, 256, size=(400, 5))
    square = (x**2).sum(axis=1)
    keys = negatives.Keys(int(square.max()), np.zeros((1, 6)), np.zeros((1, 2)))
    y = keys.augmented(x, square)
    keys.pivots, keys.rings = y[:7], np.sort(np.hstack([np.zeros((7, 1)), rng.uniform(50, 400, size=(7, 4)), np.full((7, 1), np.inf)]), axis=1)
    pivot, _, ring = keys.place(y)
    for q in x[:30]:
        pivots, rings, least = keys.order(np.append(q.astype(float), 0.0))
        bound = dict(zip(zip(pivots.tolist(), rings.tolist(), strict=True), least.tolist(), strict=True))
        away = np.sqrt(((y - np.append(q, 0.0)) ** 2).sum(axis=1))
        assert len(bound) == 35 and (np.diff(least) >= 0).all()
        assert all(bound[p, r] <= d + 1e-6 for p, r, d in zip(pivot.tolist(), ring.tolist(), away.tolist(), strict=True))
        assert np.allclose(away, [negatives.distance(float(s), int((q**2).sum()), keys.top) for s in x @ q], atol=1e-6)


def test_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = sorted((tuple(r) for r in queries.op11_hard_negatives(spark, "/root/testdata/sf0.1").collect()), key=str)
    assert got == plain(rows) and len(got) > 400
