import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.llm import negatives

VECTORS = "vec_id long, embedding array<float>, label int, id int, a int, g int, v int"
SMALL = negatives.Settings(rows=37, group=2, anchors=3)


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], VECTORS).repartition(4)


def mined(spark, rows, every=10, settings=SMALL):
    relabel = F.expr("CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END")
    part = negatives.taking_part(table(spark, rows), "vec_id", "embedding", "label", 256, relabel)
    return sorted(tuple(r) for r in negatives.mine(part, F.col("id") % every == 0, settings).collect())


def brute(rows, every=10, positives=5, k=10):
    """Every anchor, every positive, every row."""
    known = {}
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        whole = [math.floor(256 * float(np.float32(x))) for x in v]
        mine = ((label + 1) % 10 if i % 7 == 0 else label, whole)
        known[i] = min(known.get(i, mine), mine)
    out = []
    for a, (la, va) in known.items():
        if a % every:
            continue
        scores = [(-sum(x * y for x, y in zip(va, v)), i, label) for i, (label, v) in known.items()]
        own = sorted((s, i) for s, i, label in scores if label == la and i != a)[:positives]
        for ps, p in own:
            fit = sorted((s, i) for s, i, label in scores if label != la and 30 * -ps <= 100 * -s <= 90 * -ps)[:k]
            out += [(a, p, r, i, -ps, -s) for r, (s, i) in enumerate(fit, 1)]
    return sorted(out)


def random_rows(n, seed=1, dim=16, labels=10, digits=None):
    rng = random.Random(seed)
    middles = [[rng.gauss(0, 0.2) for _ in range(dim)] for _ in range(labels)]
    common = [rng.gauss(0, 0.3) for _ in range(dim)]
    rows = []
    for i in range(n):
        label = rng.randrange(labels)
        v = [c + m + rng.gauss(0, 0.15) for c, m in zip(common, middles[label])]
        rows.append((i, [round(x, digits) for x in v] if digits is not None else v, label))
    return rows


@pytest.mark.parametrize("settings", [SMALL, negatives.Settings()])
def test_equals_brute_force(spark, settings):
    rows = random_rows(400)
    want = brute(rows)
    assert len(want) > 500
    assert mined(spark, rows, settings=settings) == want


def test_ties_and_a_hot_label(spark):
    # Coarse components make many equal scores; a third of the rows are one vector.
    rows = random_rows(300, seed=2, dim=4, labels=3, digits=1)
    rows = [(i, rows[0][1] if i % 3 == 0 else v, label) for i, v, label in rows]
    want = brute(rows)
    assert len(want) > 200
    assert mined(spark, rows) == want


def test_odd_rows(spark):
    rows = random_rows(120, seed=3, dim=6)
    rows += [rows[0], rows[10], (10, [0.1] * 6, 0), (None, [0.5] * 6, 1), (1000, None, 1), (1010, [], 2), (1020, [0.5] * 6, None)]
    rows += [(1030, [0.5, None], 1), (1040, [math.nan] * 6, 1), (1050, [math.inf] * 6, 1), (1060, [0.4] * 3, 2), (1061, [0.3] * 9, 4), (-20, [0.4] * 6, 4)]
    assert mined(spark, rows) == brute(rows)


def test_no_positives_no_anchors_no_rows(spark):
    assert mined(spark, [(0, [0.5] * 4, 1), (1, [0.4] * 4, 2)]) == []
    assert mined(spark, [(1, [0.5] * 4, 1), (2, [0.4] * 4, 2)]) == []
    assert mined(spark, []) == []
    # Scores of zero and below open windows of zero or none.
    rows = [(0, [1.0, 0.0], 1), (1, [0.0, 1.0], 1), (2, [-1.0, 0.0], 1), (3, [0.0, -1.0], 2), (4, [-0.5, 0.0], 2)]
    assert mined(spark, rows) == brute(rows) != []


def test_scores_beyond_doubles_stay_exact():
    a = np.array([[2**28 + 1, 1], [-(2**28), 3]], dtype=np.int64)
    b = np.array([[2**28 - 1, 7]], dtype=np.int64)
    assert negatives._product(a, b).tolist() == [[(2**28 + 1) * (2**28 - 1) + 7], [-(2**28) * (2**28 - 1) + 21]]
    with pytest.raises(ValueError):
        negatives._product(a * 2**10, b * 2**10)
