"""Inverted multi-index against all pairs."""

from __future__ import annotations

import math

import numpy as np

from readloom.llm import multiindex


def brute(rows):
    def good(v, label):
        return label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    n = len(rows)
    links, label = [0] * n, list(range(n))
    near = np.zeros((n, n), bool)
    for i, (_, a, la) in enumerate(rows):
        for j, (_, b, lb) in enumerate(rows):
            if i != j and la == lb and good(a, la) and good(b, lb) and len(a) == len(b):
                x, y = np.array(a), np.array(b)
                near[i, j] = x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.98
    links = near.sum(1)
    for _ in range(n):
        new = [min([label[i]] + [label[j] for j in np.flatnonzero(near[i])]) for i in range(n)]
        if new == label:
            break
        label = new
    names = {k: min((rows[i][0] for i in range(n) if label[i] == k and rows[i][0] is not None), default=None) for k in label}
    return sorted(((r[0], int(links[i]), names[label[i]]) for i, r in enumerate(rows)), key=str)


def test_same_as_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(multiindex, "BLOCK", 16)
    rng = np.random.default_rng(1)
    rows = []
    for i in range(260):
        v = rng.normal(size=16)
        if i % 2:
            base = np.array(rows[-1][1])
            v = base + rng.normal(size=16) * np.linalg.norm(base) * 0.03
        rows.append((i, v.tolist(), i % 3))
    # a crowd of near copies and one of exact copies
    centre = rng.normal(size=16)
    rows += [(1000 + i, (centre + rng.normal(size=16) * 0.12).tolist(), 1) for i in range(60)]
    rows += [(2000 + i, centre.tolist(), 2) for i in range(40)]
    rows += [(3000, None, 1), (3001, [], 1), (3002, [0.0] * 16, 1), (3003, [float("nan")] + [1.0] * 15, 1), (3004, [None] + [1.0] * 15, 1),
             (3005, centre.tolist(), None), (3006, [1.0, 2.0], 1), (3007, [2.0, 4.0], 1), (3008, [float("inf")] * 16, 1), (None, centre.tolist(), 2),
             (2000, centre.tolist(), 2), (3009, [1.0], 0), (3010, [3.0], 0)]
    df = spark.createDataFrame([(a, v, label, "x") for a, v, label in rows], "vec_id long, embedding array<double>, label int, node string").repartition(4)
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in multiindex.near_vectors(df).collect()), key=str)
    want = brute(rows)
    found, all_ = sum(r[1] for r in got), sum(r[1] for r in want)
    assert 0.99 * all_ <= found <= all_
    assert [r[0] for r in got] == [r[0] for r in want]
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
    assert np.mean([g == w for g, w in zip(got, want, strict=True)]) > 0.9
    assert multiindex.near_vectors(df.limit(0)).count() == 0


def test_nearest_cells_come_first():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    grid = multiindex.Grid(x, 400, 0.98)
    a, b = multiindex._nearest(x[:, :4], grid.left), multiindex._nearest(x[:, 4:], grid.right)
    total = (a[:, :, None] + b[:, None, :]).reshape(len(x), -1)
    for depth in (1, 3, 10, total.shape[1]):
        got = np.take_along_axis(total, grid.cells(x, depth), 1)
        assert np.allclose(got, np.sort(total, 1)[:, :depth])
