import hashlib
import random
import struct

import llm_fixtures as fixtures
import pytest
import xxhash
from pyspark.sql import functions as F

from llm_fixtures import none, odd  # noqa: F401

from tablewright.llm import fingerprint as fp

SETTINGS = fp.Settings(run=4)


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def chained(codes):
    seed = 42
    for c in codes:
        seed = xxhash.xxh64_intdigest(struct.pack("<q", c), seed)
    return signed(seed)


def brute(text, k=10, s=2):
    """Positions and codes of the closed syncmers, from the definition."""
    words = [w for w in (text or "").lower().replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
    h = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in words]
    if not h:
        return []
    if len(h) < k:
        return [(0, chained(h))]
    m = [chained(h[i:i + s]) for i in range(len(h) - s + 1)]
    last = k - s
    found = []
    for i in range(len(h) - k + 1):
        window = m[i:i + last + 1]
        if min(window) in (window[0], window[-1]):
            found.append((i, chained([m[i + d] for d in sorted({*range(0, last + 1, s), last})])))
    return found


def alike(a, b):
    x, y = {c for _, c in a}, {c for _, c in b}
    return len(x & y) / len(x | y) if x | y else 1.0


@pytest.mark.parametrize("k,s", [(10, 2), (6, 3), (4, 1), (3, 2)])
def test_anchors_equal_brute_force(spark, k, s):
    rng = random.Random(1)
    words = fixtures.words_of_language(rng, ["an", "be", "co", "É"], 50)
    texts = [fixtures.sentence(rng, n, words) for n in (0, 1, k - 1, k, k + 1, 80, 300)] + ["a " * 40, "x\t\ny  z", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: [(a.pos, a.code) for a in r.a] for r in rows.select("i", fp.anchors(F.col("t"), fp.Settings(k, s)).alias("a")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute(t, k, s), t


def documents(rng):
    words = fixtures.words_of_language(rng, ["an", "be", "co", "é", "😀"], 400)
    rows = [(i * 7, fixtures.sentence(rng, rng.choice([0, 3, 20, 90, 200]), words)) for i in range(23)]
    return rows + [(500, None), (501, rows[3][1]), (502, rows[3][1])]


def test_fingerprints_equal_brute_force(spark):
    rows = documents(random.Random(8))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in fp.fingerprints(df, settings=SETTINGS).collect()}
    order = sorted(((d, t or "") for d, t in rows), reverse=True)
    assert len(got) == len(rows)
    for (d, t), (_, following) in zip(order, order[1:] + order[:1], strict=True):
        half = len(t) // 2
        edit = t[:len(t) - half] + following[:half]
        own, new, other = brute(t), brute(edit), brute(following)
        r = got[d]
        assert r.n_chars == len(t)
        assert r.edited_sha256 == hashlib.sha256(edit.encode()).hexdigest()
        text = lambda a: "".join(f"{c & 0xFFFFFFFF:08X}" for _, c in a)
        assert (r.fingerprint, r.edited_fingerprint) == (text(own), text(new))
        assert abs(r.near_edited - alike(own, new)) < 1e-12 and abs(r.near_next - alike(own, other)) < 1e-12
    assert got[501].fingerprint == got[502].fingerprint and got[502].near_next == 1.0


def test_an_edit_moves_no_anchor_elsewhere(spark):
    rng = random.Random(3)
    words = [fixtures.sentence(rng, 1, fixtures.words_of_language(rng, ["an", "be", "co"], 400)) for _ in range(200)]
    edited = words[:100] + ["new", "words"] + words[101:]
    a, b = (spark.createDataFrame([(i, " ".join(w))], "doc_id long, text string") for i, w in enumerate((words, edited)))
    pairs = fp.positional_matches(a, b).collect()
    before = {r.left_pos for r in pairs if r.left_pos == r.right_pos and r.left_pos <= 90}
    after = {r.left_pos for r in pairs if r.right_pos == r.left_pos + 1 and r.left_pos > 100}
    want = [p for p, _ in brute(" ".join(words))]
    assert before == {p for p in want if p <= 90} and after == {p for p in want if p > 100}


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    plan = fp.fingerprints(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_defined_results(odd, none):
    rows = fp.fingerprints(odd, settings=SETTINGS).collect()
    assert len(rows) == len(fixtures.odd_rows())
    by = {r.doc_id: r for r in rows}
    assert by[1].n_chars == 0 and by[1].fingerprint == "" and by[1].near_next == 0.0 and by[2].near_next == 1.0
    assert by[None].near_next == 0.0 and by[12].n_anchors == 1
    assert len({r.fingerprint for r in rows if r.doc_id in (4, 5, 6, None)}) == 1
    assert fp.fingerprints(none).count() == 0


def test_one_document_follows_itself(spark):
    df = spark.createDataFrame([(5, "ab cd")], "doc_id long, text string")
    r = fp.fingerprints(df).first()
    assert r.near_next == 1.0 and r.edited_sha256 == hashlib.sha256(b"ab ab").hexdigest()


@pytest.mark.parametrize("n", range(10, 21, 2))
def test_different_short_texts_are_not_alike(spark, n):
    rng = random.Random(n)
    words = [f"w{i}" for i in range(5000)]
    rows = [(i, " ".join(rng.sample(words, n))) for i in range(40)]
    got = {r.doc_id: r for r in fp.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == 40
    assert all(r.near_next < 0.2 and r.near_edited < 1 for r in got.values())


def test_short_texts_without_syncmers_are_compared_by_runs(spark):
    plain = [t for i in range(200) if not brute(t := " ".join(f"w{i}x{j}" for j in range(10)))]
    near = next(t for t in (plain[0].rsplit(" ", 1)[0] + f" v{i}" for i in range(100)) if not brute(t))
    df = spark.createDataFrame([(1, None), (2, plain[1]), (3, near), (4, plain[0].upper()), (5, plain[0])], "doc_id long, text string")
    got = {r.doc_id: r.near_next for r in fp.fingerprints(df).collect()}
    # Nine runs of two words each, of which eight are common to the near ones.
    assert got == {5: 1.0, 4: 0.8, 3: 0.0, 2: 0.0, 1: 0.0}
    assert fp.positional_matches(df.where("doc_id = 4"), df.where("doc_id = 5")).count() == 9
