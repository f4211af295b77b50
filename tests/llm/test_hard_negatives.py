"""Hard negatives against a plain search over all pairs."""

import math
import random

import numpy as np
import pytest

from citewright.llm import hard_negatives as hn


def plain(rows):
    ok = [(v, lab, [math.floor(256 * x) for x in e]) for v, e, lab in rows if v is not None and lab is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    ok = [r for r in ok if max((abs(q) for q in r[2]), default=0) ** 2 * len(r[2]) < 2**62]
    out = []
    for a, own, x in ok:
        if a % 100:
            continue
        scored = [(-sum(p * q for p, q in zip(x, y)), v, lab) for v, lab, y in ok if v != a and len(y) == len(x)]
        positives = sorted((s, v) for s, v, lab in scored if lab == own)[:5]
        negatives = sorted((s, v) for s, v, lab in scored if lab != own)
        for ps, p in positives:
            fit = [(s, v) for s, v in negatives if 80 * -ps <= 100 * -s <= 100 * -ps][:5]
            out += [(a, p, k + 1, v, -ps, -s) for k, (s, v) in enumerate(fit)]
    return sorted(out)


def vectors(seed, n, dim, spread):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(6, dim))
    x = centers[rng.integers(0, 6, n)] + spread * rng.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return [(i, [float(v) for v in np.float32(r)], int(k)) for i, (r, k) in enumerate(zip(x, rng.integers(0, 4, n), strict=True))]


ODD = [
    (100, None, 1), (200, [0.1, None], 1), (300, [0.1, 0.2], None), (None, [0.5, 0.5], 1), (400, [float("nan"), 1.0], 2), (500, [float("inf"), 1.0], 2), (600, [], 1), (601, [], 1), (602, [], 2),
    (700, [1.0, 0.0], 1), (700, [1.0, 0.0], 1), (701, [1.0, 0.0], 1), (702, [1.0, 0.0], 2), (702, [1.0, 0.0], 2), (703, [0.9, 0.1], 2), (800, [0.0, 0.0], 1), (801, [-1.0, 0.0], 1), (802, [-1.0, 0.0], 2),
    (900, [1e6, 1e6], 3), (901, [1e6, 1e6 - 0.3], 3), (902, [1e6, 1e6 - 1], 4), (903, [1e30, 1.0], 4), (-100, [0.7, 0.7], 1), (1000, [0.2], 1),
]


@pytest.mark.parametrize("rows", [vectors(1, 900, 8, 0.4), vectors(2, 1500, 16, 0.05), ODD, vectors(3, 400, 2, 0.3) + ODD])
@pytest.mark.parametrize("small", [False, True])
def test_against_all_pairs(spark, monkeypatch, rows, small):
    """Also with small leaves, small chunks, and more than one block of anchors."""
    if small:
        monkeypatch.setattr(hn, "LEAF", 4)
        monkeypatch.setattr(hn, "ANCHOR_BYTES", 400)
    data = [(*r, "x", 1) for r in rows]
    random.Random(4).shuffle(data)
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int, aid string, score int").repartition(3)
    got = [tuple(r) for r in hn.hard_negatives(df).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()]
    want = plain(rows)
    assert want and sorted(got) == want


def test_empty(spark):
    assert hn.hard_negatives(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    assert hn.hard_negatives(spark.createDataFrame([(100, [1.0], 1)], "vec_id long, embedding array<float>, label int")).count() == 0


def test_pruning_passes_groups_over():
    """A far group is dropped as node pairs: none of its rows is scored, and none that matters is missed."""
    rng = np.random.default_rng(0)
    near, far = np.float64([200, 0, 0, 0]), np.float64([-200, 0, 0, 0])
    x = np.floor(np.concatenate([near + rng.normal(size=(3000, 4)) * 9, far + rng.normal(size=(3000, 4)) * 9]))
    rows, anchors = hn.Tree(np.arange(6000), x), hn.Tree(np.arange(10_000, 10_400), np.floor(near + rng.normal(size=(400, 4)) * 9))
    best = hn.Best(np.full((400, 1), hn.NONE, np.int64), np.full((400, 1), 1 << 62, np.int64))
    seen = []
    add = best.add
    best.add = lambda *a: (seen.append(int(a[4].max())), add(*a))
    hn.search(anchors, rows, best)
    want = np.sort((anchors.x @ rows.x.T).astype(np.int64), axis=1)[:, ::-1][:, : hn.BEST]
    assert (best.score[:, 0] == want).all()
    assert max(seen) < 3000
