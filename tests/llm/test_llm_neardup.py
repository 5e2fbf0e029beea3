import random

import llm_fixtures as fixtures

from llm_fixtures import none, odd  # noqa: F401

from tablewright.llm import components, neardup


def shingle_set(text, k):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + k]) for i in range(max(1, len(words) - k + 1)))


def brute(rows, k):
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
    """Copies of one text, each with some words changed: likeness around the limit."""
    base = [rng.choice(words) for _ in range(length)]
    rows = []
    for i in range(n):
        own = list(base)
        for _ in range(rng.randint(0, edits)):
            own[rng.randrange(length)] = rng.choice(words) + "x"
        rows.append((start + i, " ".join(own)))
    return rows


def check(spark, rows, settings):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {(r.doc_id): r for r in neardup.near_duplicates(df, settings=settings).collect()}
    want = brute(rows, settings.shingle)
    assert {d: r.component_id for d, r in got.items()} == want
    for d, t in rows:
        assert got[d].n_shingles == len(shingle_set(t, settings.shingle))
        assert got[d].kept == (want[d] == d)


def test_components_equal_brute_force(spark):
    rng = random.Random(4)
    words = fixtures.words_of_language(rng, ["an", "be", "co", "du", "en", "fi"], 900)
    rows = family(rng, words, 90, 0) + family(rng, words, 30, 200, 60, 3) + family(rng, words, 2, 300, 40, 1)
    # A passage that many texts share is no reason to link them.
    passage = fixtures.sentence(rng, 60, words)
    rows += [(400 + i, passage + " " + fixtures.sentence(rng, 60, words)) for i in range(40)]
    check(spark, rows, neardup.Settings(shingle=4))


def test_blocks_of_a_large_group(spark):
    rng = random.Random(6)
    words = fixtures.words_of_language(rng, ["an", "be", "co", "du", "en", "fi"], 900)
    check(spark, family(rng, words, 120, 0), neardup.Settings(shingle=4, block=16))


def test_exactly_the_limit_is_linked(spark):
    words = [f"w{i}" for i in range(60)]
    # 20 single-word shingles: 18 common of 20 and 20 is 18/22, 16 of 20 is 16/20.
    rows = [(1, " ".join(words[:20])), (2, " ".join(words[:16])), (3, " ".join(words[:15]))]
    check(spark, rows, neardup.Settings(shingle=1))


def test_defined_results(spark, odd, none):
    rows = neardup.near_duplicates(odd).collect()
    assert len(rows) == len(fixtures.odd_rows())
    by = {r.doc_id: r for r in rows}
    assert by[1].n_shingles == by[2].n_shingles == by[3].n_shingles == 0 and by[3].component_id == 3
    assert {by[d].component_id for d in (4, 5, 6)} == {4} and by[8].component_id == 7
    assert by[9].n_shingles == 1 and by[10].component_id == 9
    assert by[None].component_id is None and by[None].kept
    assert neardup.near_duplicates(none).count() == 0
    kept = neardup.keep_first(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 1, 2, 3, 4, 4, 7, 9, 11, 12, 13, 14]


def test_rows_of_one_key_are_one_document(spark):
    a, b = "p q r s t u v w", "h i j k l m n o"
    rows = spark.createDataFrame([(1, a), (2, a), (2, b), (3, b)], "doc_id long, text string")
    assert {r.component_id for r in neardup.near_duplicates(rows).collect()} == {1}


def test_components_of_a_chain(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0
