"""Spelling joins, history by batches and append-only dictionaries against brute force and the full run."""

import random

import pytest
from conftest import rows

from tablewright.operators import encoding as e
from tablewright.operators import groups as g
from tablewright.operators import joins as j
from tablewright.operators import spelling as sp
from tablewright.operators import states as hs


def edits(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for k, y in enumerate(b, 1):
            now.append(min(last[k] + 1, now[-1] + 1, last[k - 1] + (x != y)))
        last = now
    return last[-1]


@pytest.mark.parametrize("most", [1, 2])
def test_nearest_keys_equal_brute_force(spark, most, join_mode):
    rng = random.Random(most)
    known = {"".join(rng.choice("abс") for _ in range(rng.randint(1, 9))) for _ in range(60)}
    values = {"".join(rng.choice("abсd") for _ in range(rng.randint(0, 9))) for _ in range(120)} | set(list(known)[:5])
    want = {}
    for v in values:
        fit = [(edits(v, k), k) for k in known]
        fit = [f for f in fit if f[0] == 0 or f[0] <= most and min(len(v), len(f[1])) >= 3]
        if fit:
            want[v] = min(fit)
    df = spark.createDataFrame([(v,) for v in values] * 2 + [(None,)], "k string")
    dim = spark.createDataFrame([(k,) for k in known] + [(None,)], "k string")
    got = {r.k: (r.distance, r.match) for r in sp.nearest_keys(df, dim, "k", most, 3).collect()}
    assert got == want and any(d for d, _ in want.values())


def test_exact_hits_are_unchanged(spark, join_mode):
    dim = spark.createDataFrame([("Омск", 1), ("Томск", 2), ("Пермь", 3)], "city string, n int")
    df = spark.createDataFrame([(1, "Омск"), (2, "Томск"), (3, "Прмь"), (4, "Омс"), (5, "Рим"), (6, None), (7, "Омск")], "i int, city string")
    near = sp.enrich_near(df, dim, "city")
    got = {r.i: (r.n, r.city_match, r.city_distance) for r in near.collect()}
    exact = {r.i: r.n for r in j.enrich(df, dim, "city").collect()}
    assert all(got[i][0] == n for i, n in exact.items() if n is not None) and got[1] == (1, "Омск", 0)
    # Too short for a near match; nothing near; null.
    assert got[3] == (3, "Пермь", 1) and got[4] == got[5] == got[6] == (None, None, None) and len(got) == 7
    empty = sp.enrich_near(df, dim.where("n > 9"), "city")
    assert empty.where("n is null").count() == 7
    with pytest.raises(Exception, match="repeated dimension key"):
        sp.enrich_near(df, dim.union(dim), "city").collect()


def test_any_cut_into_batches_equals_the_full_run(spark, tmp_path):
    rng = random.Random(5)
    data = [(rng.choice(["u1", "u2", "u3", None]), rng.choice(["a", "b", None]), rng.choice([None, 1e6 + rng.random(), 3.0])) for _ in range(90)]
    data += [("alone", None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(data)], "i int, u string, c string, x double")
    wanted = [g.Feature("x", s, s, f) for s, f in (("mean", -1.0), ("std", 0.0), ("sum", None), ("count", None))] + [g.Feature("c", "nunique", "kinds", 0)]
    want = {r.u: tuple(r)[1:] for r in g.group_stats(df, "u", wanted).collect()}
    for seed in range(2):
        cut = [rng.randrange(4) for _ in range(len(data))]
        parts = spark.createDataFrame(list(enumerate(cut)), "i int, part int")
        store = hs.StateStore(spark, f"{tmp_path}/{seed}", "u", ["x"], ["c"])
        tagged = df.join(parts, "i")
        for name in rng.sample(range(4), 4):
            store.add(str(name), tagged.where(f"part = {name}"))
        version = store.add("2", df)
        assert version == 4 and store.pending(["1", "9", "9"]) == ["9"]
        got = {r.u: tuple(r)[1:] for r in store.features(wanted).collect()}
        assert got.keys() == want.keys() and all(got[u] == pytest.approx(want[u], rel=1e-9, abs=1e-6) for u in want)
        assert store.features(wanted, version=1).count() <= len(want)
    with pytest.raises(ValueError):
        store.features([g.Feature("x", "median", "m")])


def test_refitting_changes_no_code(spark):
    one = spark.createDataFrame([("b", "x"), ("d", None)], "p string, q string")
    two = spark.createDataFrame([("a", "x"), ("b", "w"), ("c", "é"), (None, "w")], "p string, q string")
    first = e.label_dictionary([one], ["p", "q"])
    second = e.extend_dictionary(first, [two], ["p", "q"])
    assert rows(second, "column", "code") == [
        ("p", "b", 0), ("p", "d", 1), ("p", "a", 2), ("p", "c", 3), ("p", "nan", 4),
        ("q", "nan", 0), ("q", "x", 1), ("q", "w", 2), ("q", "é", 3),
    ]
    assert rows(e.extend_dictionary(second, [one, two], ["p", "q"]), "column", "code") == rows(second, "column", "code")
    # A column that the first version did not have starts at 0.
    fresh = e.extend_dictionary(first.where("column = 'p'"), [two], ["q"])
    assert rows(fresh.where("column = 'q'"), "code") == [("q", "w", 0), ("q", "x", 1), ("q", "é", 2)]
    assert first.dtypes == second.dtypes
