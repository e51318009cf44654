"""Hard negatives against a plain search, the bounds of a cell, and rows that must not crash it."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import hard_negatives as H

ROW = "vec_id long, embedding array<float>, label int, id int, norm string, part int"


def brute(rows):
    """(anchor, positive, rank, negative, scores) from (vec_id, embedding, label); by definition."""
    good = set()
    for i, v, label in rows:
        if i is not None and v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v):
            good.add((i, label, tuple(math.floor(256 * float(np.float32(x))) for x in v)))
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a in good:
        if a[0] % 50:
            continue
        every = [(score(a[2], b[2]), b[0], b[1]) for b in good if b[0] != a[0]]
        best = lambda some: sorted(some, key=lambda x: (-x[0], x[1]))
        for ps, p, _ in best(x for x in every if x[2] == a[1])[:5]:
            fit = best(x for x in every if x[2] != a[1] and 50 * ps <= 100 * x[0] <= 95 * ps)
            out += [(a[0], p, k + 1, n, ps, ns) for k, (ns, n, _) in enumerate(fit[:3])]
    return sorted(out)


def table(seed, n, dims=(6,), spread=2.0):
    """Components on a coarse grid, so that scores tie; norms differ widely."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        d = int(rng.choice(dims))
        v = (rng.integers(-2, 6, d) / 8 * float(2.0 ** rng.integers(-2, 3)) * spread).astype(np.float32)
        rows.append((int(i * 5 % (5 * n)), [float(x) for x in v], int(rng.integers(0, 4))))
    return rows


def mined(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], ROW)
    got = H.mine(H.usable(df), F.col("id") % 50 == 0).collect()
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in got)


@pytest.mark.parametrize("seed,dims", [(1, (6,)), (2, (3, 6, 9))])
def test_equals_a_plain_search(spark, monkeypatch, seed, dims):
    """Several cells, buckets and vector lengths; hot label and vector; nulls, repeats, repeated ids, zero vectors."""
    for name, value in (("BUCKET", 8), ("GROUP", 4), ("PART", 3), ("PARTS", 2)):
        monkeypatch.setattr(H, name, value)
    rows = table(seed, 150, dims)
    same = [0.5] * dims[0]
    rows += [(1000 + k, same, 1) for k in range(60)] + [rows[0], rows[0], (rows[0][0], [0.25] * 6, 2)]
    rows += [(None, same, 1), (2000, None, 1), (2050, same, None), (2100, [float("nan")] * 6, 1), (2150, [float("inf")] * 6, 1), (2200, [None, 1.0], 1), (2250, [], 1), (2300, [0.0] * 6, 3), (2350, same, 77)]
    got, want = mined(spark, rows), brute(rows)
    assert want and got == want


def test_given_vectors(spark):
    """A label that is one of a kind has no positives; an empty table has no rows."""
    assert mined(spark, []) == []
    assert mined(spark, [(50, [1.0], 1), (51, [1.0], 2)]) == []
    rows = [(50, [1.0, 0.0], 1), (51, [1.0, 1.0], 1), (52, [0.9, 0.0], 2), (53, [0.95, 7.0], 2), (54, [0.5, 0.0], 2), (55, [0.4, 0.0], 2)]
    assert mined(spark, rows) == brute(rows) and {r[3] for r in brute(rows)} == {52, 53, 54}


def test_scores_beyond_floating_point(spark):
    big = [2.0**20 + 1, 2.0**21 - 3, 1.0]
    rows = [(50, big, 1), (51, [x + 1 for x in big], 1), (52, [x / 2 + 2 for x in big], 2), (53, [x / 2 + 1 for x in big], 2), (54, [x / 2 for x in big], 3)]
    assert mined(spark, rows) == brute(rows) != []


def test_bounds_skip_buckets_and_lose_nothing():
    """Once the windows are full, buckets of small norm are not multiplied."""
    rng = np.random.default_rng(0)
    vecs = rng.integers(1, 50, (4000, 8)) * (rng.integers(1, 40, 4000)[:, None])
    order = np.argsort(-(vecs**2).sum(axis=1), kind="stable")
    vecs, ids, labels = vecs[order], np.arange(4000), np.arange(4000) % 2
    a = np.arange(0, 4000, 400)
    cell = H.Cell(ids[a], labels[a], vecs[a], np.full((10, 1), H.LEAST), np.full((10, 1), H.MOST), True, 5)
    for k in range(0, 4000, 50):
        cell.meet(float(np.sqrt((vecs[k] ** 2).sum())), ids[k : k + 50], labels[k : k + 50], vecs[k : k + 50])
    score = vecs[a] @ vecs.T
    for j, i in enumerate(a):
        fit = [(-int(score[j, x]), int(x)) for x in ids if x != i and labels[x] == labels[i]]
        assert [(-int(s), int(x)) for s, x in zip(cell.best.score[j], cell.best.id[j])] == sorted(fit)[:5]
    assert cell.skipped > cell.seen // 2
