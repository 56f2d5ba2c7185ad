from __future__ import annotations

import math
import random

import numpy as np

from tallyframe.llm import hard_negatives as hn

SCHEMA = "vec_id long, label int, embedding array<double>, rank string"


def table(spark, *rows):
    """Embeddings with one more column that clashes."""
    return spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)


def brute(rows, every=100):
    part = []
    for i, label, vec in rows:
        if label is None or vec is None or not all(x is not None and math.isfinite(x) for x in vec):
            continue
        part.append((i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, [math.floor(256 * x) for x in vec]))
    out = []
    for i, label, vec in part:
        if i is None or i % every:
            continue
        scored = sorted(((-sum(a * b for a, b in zip(vec, v)), (j is None, j or 0), j, k) for j, k, v in part
                         if j != i and len(v) == len(vec)), key=lambda x: x[:2])
        for ps, _, p, _ in [x for x in scored if x[3] == label][:5]:
            fits = [x for x in scored if x[3] != label and 30 * -ps <= 100 * -x[0] <= 90 * -ps][:10]
            out += [(i, p, rank, n, -ps, -ns) for rank, (ns, _, n, _) in enumerate(fits, 1)]
    return sorted(out, key=repr)


def run(frame, **how):
    out = hn.hard_negatives(frame, **how)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted((tuple(r) for r in out.collect()), key=repr)


def made(n, seed, dims=6, labels=3):
    draw = random.Random(seed)
    return [(i, draw.randrange(labels), [draw.gauss(0.1, 0.3) for _ in range(dims)]) for i in range(n)]


def test_given_vectors(spark, given):
    rows = [tuple(r) for r in given("embeddings").select("vec_id", "label", "embedding").collect()]
    assert run(given("embeddings")) == brute(rows)


def test_several_blocks(spark):
    rows = made(2300, 3)
    assert run(table(spark, *rows).repartition(4)) == brute(rows)


def test_missing_values_and_ties(spark):
    nan, inf = float("nan"), float("inf")
    rows = made(40, 4) + [(100, 1, [0.5] * 6)] * 2 + [(200, 1, [0.5] * 6), (201, 2, [0.2] * 6), (None, 1, [0.5] * 6), (None, 2, [0.2] * 6)]
    rows += [(300, None, [1.0] * 6), (301, 1, None), (400, 1, [nan] + [0.1] * 5), (401, 1, [inf] + [0.1] * 5), (402, 1, [None] + [0.1] * 5)]
    rows += [(i, 1 + i % 2, [0.3] * 6) for i in range(500, 540)] + [(600, 3, [-0.5] * 6), (700, 3, [0.0] * 6), (701, 4, [0.0] * 6)]
    rows += [(800, 5, []), (801, 5, []), (802, 6, []), (900, 1, [0.2, 0.4]), (901, 1, [0.3, 0.3]), (902, 2, [0.1, 0.2])]
    assert run(table(spark, *rows)) == brute(rows)


def test_few_rows(spark):
    assert run(table(spark)) == []
    assert run(table(spark, (0, 1, [1.0]))) == []
    rows = [(0, 1, [1.0, 1.0]), (1, 2, [1.0, 0.5]), (2, 3, [0.5, 0.1])]
    assert run(table(spark, *rows)) == brute(rows) and len(brute(rows)) > 0


def test_large_components_score_exactly(spark):
    top = (hn.MOST - 1) / 256
    rows = [(0, 1, [top, -top]), (1, 2, [top, 1.0]), (2, 2, [top - 1, -top]), (3, 2, [top / 2, -top / 3]), (4, 1, [top / 2, 0.0]), (5, 1, [2 * top, 0.0])]
    assert run(table(spark, *rows)) == brute(rows[:-1])  # the last one's component is too large


def test_curve_visits_neighbours_and_every_cell():
    for dims, bits in ((2, 3), (3, 2)):
        cells = np.array(np.meshgrid(*[np.arange(1 << bits)] * dims)).reshape(dims, -1).T
        keys = hn.hilbert_key(cells, bits)
        assert len(set(keys)) == len(cells)
        path = cells[sorted(range(len(cells)), key=keys.__getitem__)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_bounds_hold_and_zones_spare_blocks():
    draw = np.random.default_rng(2)
    a, b = draw.integers(-200, 200, (20, 5)), draw.integers(-200, 200, (50, 5))
    low, high = b.reshape(5, 10, 5).min(axis=1), b.reshape(5, 10, 5).max(axis=1)
    least, most = hn.bounds(a, low, high)
    s = hn.scores(a, b).reshape(20, 5, 10)
    assert (least <= s.min(axis=2)).all() and (most >= s.max(axis=2)).all()
    # two far clusters: a window around the anchor's own cluster doesn't read the other
    row = {"ids": [1], "dim": 2, "data": np.array([[10, 10]], "<i4").tobytes(), "owner": [0, 0], "wlow": [150, -900], "whigh": [300, -100]}
    assert hn._meets(row, [[8, 8], [-20, -20]], [[12, 12], [-9, -9]]).tolist() == [[True, False], [False, True]]


def test_routes_leave_out_groups_that_no_window_needs(spark):
    near = [(i, 1, [1.0 + 0.001 * i, 1.0]) for i in range(600)]
    far = [(1001 + i, 2, [-1.0, -1.0 - 0.001 * i]) for i in range(9000)]
    blocks = hn.hilbert_blocks(hn.integer_vectors(table(spark, *near, *far)), 100)
    zones = blocks.where("block IS NULL").collect()
    assert len(zones) >= 2 and any(z.high[0] < 0 for z in zones)
    assert run(table(spark, *near, *far)) == brute(near + far)
