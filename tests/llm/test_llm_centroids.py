import hashlib
import math
import random

import numpy as np
import pytest

from tablewright.llm import centroids

VECTORS = "vec_id long, embedding array<float>, label int, id int, v int, cluster int, far int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, 2, 3, 4) for i, v in rows], VECTORS).repartition(3)


def brute(rows, k=8, rounds=10, dim=64):
    """Plain rounds over Python integers."""
    kept = []
    for i, v in rows:
        if v is None or len(v) != dim or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((i, [math.floor(1024 * float(np.float32(x))) for x in v]))
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in order[:k]]

    def assign():
        out = []
        for i, v in kept:
            d = [sum((x - y) ** 2 for x, y in zip(v, c)) for c in centres]
            out.append((i, v, d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        found = assign()
        for c in range(len(centres)):
            mine = [v for _, v, got, _ in found if got == c]
            if mine:
                centres[c] = [sum(col) // len(mine) for col in zip(*mine)]
    found = assign()
    inertia = [sum(d for _, _, got, d in found if got == c) for c in range(len(centres))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, c, d, inertia[c], sum(inertia), sha[c]) for i, _, c, d in found), key=repr)


def got(df):
    return sorted((tuple(r)[:6] for r in df.collect()), key=repr)


def random_rows(n, groups=5, seed=1, spread=0.05):
    rng = random.Random(seed)
    middles = [[rng.gauss(0, 0.3) for _ in range(64)] for _ in range(groups)]
    return [(i, [x + rng.gauss(0, spread) for x in middles[rng.randrange(groups)]]) for i in range(n)]


@pytest.mark.parametrize("spread", [0.01, 0.4])
def test_equals_brute_force(spark, spread):
    rows = random_rows(300, spread=spread)
    df = centroids.cluster(table(spark, rows))
    assert got(df) == brute(rows)
    assert max(r.compared for r in df.collect()) <= 8


def test_bounds_drop_centroids(spark):
    df = centroids.cluster(table(spark, random_rows(300, groups=8, spread=0.005)))
    assert sum(r.compared for r in df.collect()) < 0.6 * 8 * 300


def test_bounds_hold_and_ties_take_the_smaller():
    rng = np.random.default_rng(3)
    x = rng.integers(-600, 600, (400, 64))
    pivots, centres = x[:6], rng.integers(-300, 300, (9, 64))
    centres[7] = centres[2]
    far = np.sqrt(np.stack([centroids.squared(x, p) for p in pivots], axis=1))
    bound = centroids.ptolemy(far, pivots, centres)
    true = np.stack([centroids.squared(x, c) for c in centres], axis=1)
    assert (bound ** 2 <= true).all() and bound.max() > 0
    label, best, _ = centroids.nearest(x, bound, centres)
    assert (label == true.argmin(axis=1)).all() and (best == true.min(axis=1)).all()


def test_odd_rows(spark):
    rows = random_rows(40)
    same = [0.25] * 64
    rows += [(100 + i, same) for i in range(30)] + [(100, same), (7, same), (7, [0.5] * 64), (None, same), (None, [0.1] * 64)]
    rows += [(200, None), (201, []), (202, [0.5] * 63), (203, [0.5] * 63 + [None]), (204, [math.nan] + same[1:]), (205, [math.inf] + same[1:])]
    assert got(centroids.cluster(table(spark, rows))) == brute(rows)


def test_few_and_none(spark):
    assert got(centroids.cluster(table(spark, random_rows(3)))) == brute(random_rows(3))
    assert got(centroids.cluster(table(spark, [(5, [0.5] * 64)]))) == brute([(5, [0.5] * 64)])
    empty = centroids.cluster(table(spark, [(1, None)]))
    assert empty.count() == 0 and empty.columns[:6] == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    with pytest.raises(Exception, match="no long holds"):
        centroids.cluster(table(spark, [(1, [3e38] + [0.0] * 63), (2, [0.0] * 64)])).count()
