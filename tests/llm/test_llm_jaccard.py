import random

import llm_fixtures as fixtures
import numpy as np
import pytest
from llm_fixtures import none, odd  # noqa: F401

from tablewright.llm import jaccard

TINY = jaccard.Settings(block=6, pivots=3, levels=3)


def shingle_set(text, k):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1)))


def brute(rows, k=5):
    """Component of every id, by comparing all pairs."""
    sets = [(d, shingle_set(t, k)) for d, t in rows if d is not None]
    root = {d: d for d, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                ra, rb = sorted((find(a), find(b)))
                root[rb] = ra
    return {d: find(d) for d in root}


def family(rng, words, n, start, length=150, edits=8):
    base = [rng.choice(words) for _ in range(length)]
    rows = []
    for i in range(n):
        own = list(base)
        for _ in range(rng.randint(0, edits)):
            own[rng.randrange(length)] = rng.choice(words) + "x"
        rows.append((start + i, " ".join(own)))
    return rows


def chain(rng, words, n, start, length=80, step=6):
    """Texts that each differ a little from the one before and much from the first."""
    now, rows = [rng.choice(words) for _ in range(length)], []
    for i in range(n):
        rows.append((start + i, " ".join(now)))
        now = now[step:] + [rng.choice(words) + "y" for _ in range(step)]
    return rows


def check(spark, rows, settings=jaccard.Settings()):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in jaccard.jaccard_components(df, settings=settings).collect()}
    want = brute(rows, settings.shingle)
    assert {d: r.component_id for d, r in got.items()} == want
    assert {d: r.n_shingles for d, r in got.items()} == {d: len(shingle_set(t, settings.shingle)) for d, t in rows}
    return want


def mixed(seed):
    rng = random.Random(seed)
    words = fixtures.words_of_language(rng, ["an", "be", "co", "du", "en", "fi"], 900)
    rows = family(rng, words, 70, 0) + family(rng, words, 30, 200, 60, 3) + family(rng, words, 2, 300, 40, 1) + chain(rng, words, 30, 500)
    # A passage that many texts share, more or less of them, is no reason to link them.
    passage = fixtures.sentence(rng, 60, words)
    rows += [(400 + i, passage + " " + fixtures.sentence(rng, 10 + i, words)) for i in range(40)]
    rows += [(600 + i, fixtures.sentence(rng, 30, words)) for i in range(40)] + [(700, rows[0][1].upper()), (701, "one"), (702, "ONE"), (703, "one two")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("settings", [jaccard.Settings(), TINY])
def test_components_equal_brute_force(spark, settings):
    want = check(spark, mixed(4), settings)
    assert 1 < len(set(want.values())) < len(want)


def test_large_regions_are_parted(spark, monkeypatch):
    parted = []
    whole = jaccard.cells
    monkeypatch.setattr(jaccard, "cells", lambda *a: parted.append(a[2]) or whole(*a))
    rng = random.Random(8)
    words = fixtures.words_of_language(rng, ["an", "be", "co", "du", "en", "fi"], 900)
    check(spark, family(rng, words, 90, 0, 100, 9) + chain(rng, words, 40, 500, 80, 8), TINY)
    assert parted


def test_exactly_the_limit_is_linked(spark):
    words = [f"w{i}" for i in range(60)]
    # Single words: 16 common of 20 is linked, 15 of 20 is not.
    rows = [(1, " ".join(words[:20])), (2, " ".join(words[:16])), (3, " ".join(words[20:40])), (4, " ".join(words[20:35]))]
    assert check(spark, rows, jaccard.Settings(shingle=1)) == {1: 1, 2: 1, 3: 3, 4: 4}


def test_places_hold_enough_common_shingles():
    """Two sets at the limit share as many first shingles as the filter asks for, whatever their sizes."""
    rng = np.random.default_rng(5)
    settings = jaccard.Settings()
    for _ in range(3000):
        n = int(rng.integers(1, 200))
        universe = rng.permutation(400)
        both = universe[:n]
        more = int(rng.integers(0, n // 4 + 1))
        cut = int(rng.integers(0, more + 1))
        a, b = np.sort(np.concatenate([both, universe[200:200 + cut]])), np.sort(np.concatenate([both, universe[300:300 + more - cut]]))
        union = n + more
        if 100 * n < 80 * union:
            continue
        fa, fb = (x[:jaccard._places(len(x), settings)] for x in (a, b))
        common = len(np.intersect1d(fa, fb))
        for x in (a, b):
            assert common >= 1 + ((len(x) * 80 + 99) // 100) // settings.extra


def test_defined_results(spark, odd, none):
    rows = jaccard.jaccard_components(odd).collect()
    assert len(rows) == len(fixtures.odd_rows())
    by = {r.doc_id: r for r in rows}
    assert by[1].n_shingles == by[2].n_shingles == by[3].n_shingles == 0 and by[3].component_id == 3
    assert {by[d].component_id for d in (4, 5, 6)} == {4} and by[8].component_id == 7
    assert by[9].n_shingles == 1 and by[10].component_id == 9
    assert by[None].component_id is None
    assert jaccard.jaccard_components(none).count() == 0


def test_rows_of_one_key_are_one_document(spark):
    a, b = "p q r s t u v w", "h i j k l m n o"
    near = " ".join(f"n{i}" for i in range(60))
    rows = spark.createDataFrame([(1, a), (2, a), (2, b), (3, b), (2, near), (9, near + " z"), (9, near + " z")], "doc_id long, text string")
    assert {r.component_id for r in jaccard.jaccard_components(rows).collect()} == {1}
