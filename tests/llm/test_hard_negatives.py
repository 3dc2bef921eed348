"""Hard negatives against a plain restatement."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketloom.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int"
CLASHING = ("row", "q", "tree", "place", "parent", "within", "window", "score", "low", "anchor_id", "columns")


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema).withColumns({c: F.lit("x") for c in CLASHING})


def plain(rows, every=100, n_positives=5, n_negatives=5):
    taken = []
    for key, vector, label in {(k, None if v is None else tuple(v), x): None for k, v, x in rows}:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        taken.append((key, [math.floor(256 * x) for x in vector], (label + 1) % 10 if key is not None and key % 7 == 0 else label))
    out = []
    for a in taken:
        if a[0] is None or a[0] % every:
            continue
        score = lambda r: sum(x * y for x, y in zip(a[1], r[1]))  # noqa: B023, E731
        first = lambda rows, n: sorted(rows, key=lambda r: (-r[0], r[1] is None, r[1] or 0))[:n]
        for p, positive in first([(score(r), r[0]) for r in taken if r is not a and r[2] == a[2]], n_positives):
            fits = [(score(r), r[0]) for r in taken if r[2] != a[2] and 80 * p <= 100 * score(r) <= 100 * p]
            out += [(a[0], positive, k, negative, p, s) for k, (s, negative) in enumerate(first(fits, n_negatives), 1)]
    return sorted(out, key=repr)


def vectors(rng, n, width, labels, spread):
    centres = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(6)]
    rows = []
    for i in range(n):
        centre = centres[i % 6]
        rows.append((i, [float(np.float32(c + spread * rng.gauss(0, 1))) for c in centre], rng.randrange(labels)))
    return rows


@pytest.mark.parametrize(("labels", "spread", "tree"), [(2, 0.05, 128), (9, 1.0, 3), (3, 0.0, 16), (1, 0.3, 128)])
def test_same_as_scoring_all(spark, labels, spread, tree):
    rng = random.Random(labels)
    rows = vectors(rng, 260, 5, labels, spread)
    some = rows[100]
    rows += [some, (None, some[1], some[2]), (None, some[1], some[2] + 1), (100, [x + 0.5 for x in some[1]], some[2]), (100, some[1], (some[2] + 1) % 10)]
    rows += [(301, None, 1), (302, [1.0, None, 1.0, 1.0, 1.0], 1), (303, [float("nan")] * 5, 1), (400, [float("inf")] * 5, 1), (305, some[1], None), (500, [], 1), (600, [1.5, -2.0], 2), (700, [0.0] * 5, 1)]
    got = hard_negatives.mined(frame(spark, rows), every=20, share=3, tree=tree, pivots=4, tile_anchors=4, tile_rows=50).collect()
    assert sorted(map(tuple, got), key=repr) == plain(rows, every=20)


def test_scores_beyond_53_bits(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice([-1, 1]) * rng.uniform(1e4, 3e5) * 2.0**4, rng.uniform(-1e5, 1e5), rng.uniform(-9, 9)], i % 3) for i in range(120)]
    kind = "vec_id long, embedding array<double>, label int"
    got = hard_negatives.mined(frame(spark, rows, kind), every=10, share=4, tree=4, tile_rows=40).collect()
    want = plain(rows, every=10)
    assert sorted(map(tuple, got), key=repr) == want and max(r[4] for r in want) > 2**53


def test_fewer_rows_than_asked_for(spark):
    rows = [(100, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [0.9, 0.0], 2), (3, [-1.0, 0.0], 1), (4, [0.0, 1.0], 1)]
    assert [tuple(r) for r in hard_negatives.mined(frame(spark, rows)).collect()] == [(100, 1, 1, 2, 65536, 58880)]
    assert hard_negatives.mined(frame(spark, rows[:1])).isEmpty() and hard_negatives.mined(frame(spark, [])).isEmpty()


def test_bounds_leave_out_what_is_far():
    """Anchors that lie close together score few of the candidates anew."""
    rng = np.random.default_rng(0)
    centre = rng.normal(size=64)
    centre *= 256 / np.linalg.norm(centre)
    q = np.floor(centre + rng.normal(size=(40, 64)) * 0.5)
    order, parent, edge = hard_negatives.spanning_tree(q)
    q = q[order]
    candidates = np.floor(rng.normal(size=(3000, 64)) * 32)
    scored = []

    class Counted(hard_negatives.Scores):
        def __call__(self, vector, which=slice(None)):
            out = super().__call__(vector, which)
            scored.append(len(out))
            return out

    plain_scores = candidates @ q.T
    low = np.sort(plain_scores, axis=0)[-20].astype(np.int64)
    anchors = {
        "q": q, "parent": parent, "edge": edge, "inner": np.ones(40, bool), "label": np.zeros(40), "row": np.arange(40),
        "low": [np.array([x]) for x in low], "high": [np.array([2**62])] * 40,
    }
    rows = {"q": candidates, "label": np.ones(3000), "row": np.arange(100, 3100), "vec_id": np.arange(3000)}
    original, hard_negatives.Scores = hard_negatives.Scores, Counted
    try:
        found = {place: sorted(values.tolist()) for place, _, _, values in hard_negatives.windowed(anchors, rows, False, 5)}
    finally:
        hard_negatives.Scores = original
    assert found == {i: sorted(np.sort(plain_scores[:, i])[-5:].astype(int).tolist()) for i in range(40)}
    assert sum(scored) < 0.1 * 40 * 3000
