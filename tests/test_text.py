import math
from pathlib import Path

import numpy as np
import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as hs
from pyspark.sql import functions as F

from tablewright.functions import text as tx
from tablewright.operators import lsa as ls
from tablewright.operators import text as ot

STOP = ["the", "и"]


def stats(spark, text):
    df = spark.createDataFrame([(1, text)], "id int, text string")
    return ot.text_features(df, "id", "text", "desc", STOP).first()


def test_tokens_and_counts(spark):
    r = stats(spark, "The  the кот, кот!! и x² 😀 ...?:")
    assert r.tokens_desc == ["The", "the", "кот", ",", "кот", "!", "!", "и", "x²", "😀", ".", ".", ".", "?", ":"]
    # Case matters for stop words; the emoji is no listed mark.
    assert r.words_desc == ["The", "кот", "кот", "x²", "😀"]
    assert (r.CNT_stopwords_desc, r.CNT_puncs_desc, r.CNT_numerics_desc) == (2, 8, 1)
    assert (r.CNT_exclamation_desc, r.CNT_question_desc, r.CNT_colon_desc) == (2, 1, 1)
    assert (r.CNT_word_desc, r.CNT_unique_word_desc, r.PCENT_unique_word_desc) == (5, 4, 0.8)
    assert r.AVG_word_len_desc == pytest.approx((3 + 3 + 3 + 2 + 1) / 5) and r.CNT_char_desc == 32


@pytest.mark.parametrize("text", [None, "", "  \n"])
def test_empty_text(spark, text):
    r = stats(spark, text)
    assert r.tokens_desc == [] and r.PCENT_unique_word_desc == 0.0 and r.AVG_word_len_desc == 0.0
    assert r.CNT_char_desc == len(text or "")


@settings(max_examples=15, deadline=None)
@given(hs.lists(hs.text(alphabet="aé и1.!? \n_", max_size=30), min_size=1, max_size=8))
def test_counts_agree_with_python(spark, texts):
    import regex

    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for r in ot.text_features(df, "id", "text", "d", STOP).collect():
        toks = regex.findall(tx.TOKEN_PATTERN, texts[r.id])
        words = [w for w in toks if w not in STOP and w not in tx.PUNCTUATION]
        assert r.tokens_d == toks and r.words_d == words and r.CNT_unique_word_d == len(set(words))


def test_polarity(spark, join_mode):
    df = spark.createDataFrame([(1, ["good", "good", "bad", "x"], ["bad"]), (2, [], [])], "id int, a array<string>, b array<string>")
    lexicon = spark.createDataFrame([("good", 1), ("bad", -1), ("x", 0)], "word string, polarity int")
    one, two = ot.polarity(df, "id", {"a": "a", "b": "b"}, lexicon).orderBy("id").collect()
    assert (one.CNT_Pos_Words_a, one.CNT_Neg_Words_a, one.CNT_Neg_Words_b) == (2, 1, 1)
    assert one.RATIO_PosNeg_Word_a == pytest.approx(2.01 / 1.01) and one.PCENT_Pos_Word_a == 0.5
    assert two.RATIO_PosNeg_Word_a == 1.0 and two.PCENT_Pos_Word_a == 0.0


def test_entities_count_covered_tokens_once(spark, join_mode):
    df = spark.createDataFrame([(1, ["a", "b", "c", "a"], ["b"]), (2, ["z"], []), (3, [], [])], "id int, t array<string>, u array<string>")
    entities = spark.createDataFrame([("a b",), ("b c",), ("a b c d",), ("b",), ("b",)], "phrase string")
    got = rows(ot.entity_words(df, "id", {"t": "t", "u": "u"}, entities), "id")
    assert got == [(1, 3, 1), (2, 0, 0), (3, 0, 0)]


@pytest.fixture
def terms(spark):
    data = [(1, 1.0, ["A", "b"]), (2, 0.5, ["a", "c"]), (3, 0.0, ["c", "c", "d"]), (4, 0.0, [])]
    df = spark.createDataFrame(data, "id int, y double, w array<string>")
    stems = spark.createDataFrame([("b", "bb")], "word string, stem string")
    return ot.normalise_terms(df, "id", {"title": "w"}, stems).join(df.select("id", "y"), "id")


def test_term_pool_and_contrast(spark, terms, join_mode):
    pool = ot.term_pool(terms, "y")
    sums = rows(pool.groupBy("nonzero").agg(F.sum("freq")), "nonzero")
    assert sums == [(False, pytest.approx(1.0)), (True, pytest.approx(1.0))]
    contrast = {r.term: (r.freq_diff, r["count"]) for r in ot.term_contrast(pool).collect()}
    assert contrast["a"] == (0.5, 2) and contrast["c"] == (pytest.approx(0.25 - 2 / 3), 3)
    assert contrast["bb"] == (0.25, 1) and contrast["d"] == (pytest.approx(-1 / 3), 1)


def test_equal_scores_merge_or_not(spark, join_mode):
    terms = spark.createDataFrame(
        [(1, "t", "p"), (1, "t", "q"), (1, "t", "q"), (1, "t", "unknown"), (2, None, None)], "id int, field string, term string"
    )
    ranking = spark.createDataFrame([("t", "p", 0.5, 5), ("t", "q", 0.5, 3)], "field string, term string, freq_diff double, count long")
    assert rows(ot.ranking_score(terms, "id", ranking, {"t": "s"}), "id") == [(1, 0.5), (2, 0.0)]
    assert rows(ot.ranking_score(terms, "id", ranking, {"t": "s"}, distinct="term"), "id") == [(1, 1.0), (2, 0.0)]


TINY = ["red fox jumps", "red the fox", "lazy dog", None]


@pytest.fixture
def tiny(spark):
    return spark.createDataFrame(list(enumerate(TINY)), "id int, text string")


def python_tfidf():
    docs = []
    for text in TINY:
        words = [w for w in (text or "NA").lower().split() if len(w) > 1 and w not in STOP]
        docs.append(words + [f"{a} {b}" for a, b in zip(words, words[1:])])
    vocab = sorted({t for d in docs for t in d})
    df = {t: sum(t in d for d in docs) for t in vocab}
    a = np.array([[d.count(t) * (math.log((1 + len(docs)) / (1 + df[t])) + 1) for t in vocab] for d in docs])
    return vocab, a / np.linalg.norm(a, axis=1, keepdims=True)


def test_tfidf_by_hand(spark, tiny, join_mode):
    weights = ls.lsa_weights(tiny, "id", "text", STOP)
    vocab, want = python_tfidf()
    got = np.zeros_like(want)
    for r in weights.collect():
        got[r.id, vocab.index(r.term)] = r.weight
    assert np.allclose(got, want)
    # A pair bridges the removed stop word.
    assert rows(weights.where("id = 1 and term = 'red fox'").agg(F.count("*"))) == [(1,)]


def low_rank(spark, n=60, m=40, rank=3):
    rng = np.random.default_rng(0)
    a = rng.random((n, rank)) @ np.diag([9.0, 4.0, 1.0][:rank]) @ rng.random((rank, m))
    data = [(i, f"t{j}", float(a[i, j])) for i in range(n) for j in range(m)]
    return a, spark.createDataFrame(data, "id int, term string, weight double").repartition(5)


def test_svd_matches_numpy(spark, join_mode):
    a, weights = low_rank(spark)
    values, loadings = ls.fit_svd(weights, "id", k=5, oversample=3, n_iter=3)
    s = np.linalg.svd(a, compute_uv=False)[:3]
    assert len(values) == 3 and np.allclose(values, s, rtol=1e-6)  # rank 3: no more come back
    v = {r.term: r.loadings for r in loadings.collect()}
    v = np.array([v[f"t{j}"] for j in range(a.shape[1])])
    assert np.allclose(v.T @ v, np.eye(3), atol=1e-8)
    assert all(v[np.abs(v[:, i]).argmax(), i] > 0 for i in range(3))
    assert np.allclose((a @ v) @ v.T, a, atol=1e-6)


def test_svd_keeps_small_directions(spark):
    rng = np.random.default_rng(5)
    u, _ = np.linalg.qr(rng.normal(size=(30, 8)))
    v, _ = np.linalg.qr(rng.normal(size=(20, 8)))
    s = np.array([1.0, 0.5, 0.1, 1e-2, 7e-4, 3e-4, 5e-5, 1e-5])
    a = (u * s) @ v.T
    cells = [(i, f"t{j}", float(a[i, j])) for i in range(30) for j in range(20)]
    weights = spark.createDataFrame(cells, "id int, term string, weight double")
    values, loadings = ls.fit_svd(ls.weight_blocks(weights, "id", block_rows=7), "id", k=8, oversample=4, n_iter=4)
    assert len(values) == 8 and np.allclose(values, s, rtol=1e-4)
    got = {r.term: r.loadings for r in loadings.collect()}
    got = np.array([got[f"t{j}"] for j in range(20)])
    assert np.allclose(np.abs((got * v).sum(axis=0)), 1.0, atol=1e-4)


def test_lsa_projects_every_document(spark, tiny):
    out = ls.lsa(tiny, "id", "text", STOP, k=3, oversample=3, n_iter=4)
    _, want = python_tfidf()
    got = np.array([list(r)[1:] for r in out.orderBy("id").collect()])
    u, s, _ = np.linalg.svd(want)
    assert out.columns == ["id", "SVD_text_1", "SVD_text_2", "SVD_text_3"]
    assert np.allclose(np.linalg.norm(got, axis=0), s[:3], atol=1e-6)


def test_terms_that_need_no_counts_come_once_a_row(spark):
    words = spark.createDataFrame([(1, ["Cat", "cat", "cats", "dog"]), (1, ["cat"]), (2, [])], "id int, w array<string>")
    stems = spark.createDataFrame([("cats", "cat")], "word string, stem string")
    every = ot.normalise_terms(words, "id", {"d": "w"}, stems)
    once = ot.normalise_terms(words, "id", {"d": "w"}, stems, distinct=True)
    assert rows(once.select("id", "field", "term"), "id", "term") == [(1, "d", "cat"), (1, "d", "cat"), (1, "d", "cat"), (1, "d", "dog"), (2, None, None)]
    ranking = spark.createDataFrame([("d", "cat", 0.5, 4), ("d", "dog", 0.5, 1)], "field string, term string, freq_diff double, count long")
    for how, want in (("score", 0.5), ("term", 1.0)):
        got = [rows(ot.ranking_score(t, "id", ranking, {"d": "s"}, distinct=how), "id") for t in (every, once)]
        assert got[0] == got[1] == [(1, want), (2, 0.0)]


@pytest.mark.parametrize("block_bytes", [1, 1 << 20])
def test_blocks_hold_the_weights_of_whole_documents(spark, block_bytes):
    texts = [(i, t) for i, t in enumerate(TINY)] + [(1, "late fox"), (None, "red fox red")]
    df = spark.createDataFrame(texts, "id int, text string")
    weights = ls.lsa_weights(df, "id", "text", STOP, block_bytes)
    lengths = {r.id: r.s for r in weights.groupBy("id").agg(F.sum(F.col("weight") * F.col("weight")).alias("s")).collect()}
    assert None in lengths and np.allclose(list(lengths.values()), 1.0)  # rows that share a key are one document
    counts = ls.ngram_counts(df, "id", "text", STOP)
    before = ls.tfidf(counts, ls.fit_idf(counts, df), "id")

    def listed(w):
        return sorted(((-1 if r.id is None else r.id, r.term, round(r.weight, 12)) for r in w.collect()))

    assert listed(weights) == listed(before)
    blocks = ls.lsa_blocks(df, "id", "text", STOP, block_bytes)
    loadings = blocks.terms.select("term").distinct().select("term", F.array(F.length("term").cast("double")).alias("loadings"))
    got = {r.id: r.p_1 for r in ls.project(blocks, df.where("id is not null").select("id").distinct(), loadings, "id", 1, "p").collect()}
    want = {r.id: r.s for r in before.groupBy("id").agg(F.sum(F.col("weight") * F.length("term")).alias("s")).collect()}
    assert all(abs(got[k] - want.get(k, 0.0)) < 1e-9 for k in got)


def test_lsa_keeps_no_vectors_of_terms(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(3)
    texts = [(i, " ".join(f"w{j}" for j in rng.integers(0, 10**6, 300))) for i in range(120)]
    sizes = {}

    def stored(df, name="stage"):
        out = materialize(df, name)
        sizes[name] = sizes.get(name, 0) + sum(f.stat().st_size for f in Path(out._stored_path.removeprefix("file:")).glob("*.parquet"))
        return out

    materialize = ls.materialize
    monkeypatch.setattr(ls, "materialize", stored)
    out = ls.lsa(spark.createDataFrame(texts, "id int, text string"), "id", "text", STOP, k=10, n_iter=1)
    assert out.count() == 120
    # About 70,000 terms: 20 numbers for each of them are 11 MB.
    assert sum(sizes.values()) < 6_000_000


def test_lsa_gives_the_points_of_the_other_way(spark, join_mode):
    rng = np.random.default_rng(4)
    texts = [(i, " ".join(f"w{j}" for j in rng.geometric(0.05, rng.integers(1, 40)))) for i in range(90)]
    # Missing, empty and equal texts, keys of several rows, rows without a key.
    texts += [(i, None) for i in range(90, 130)] + [(130, ""), (131, None), (131, ""), (132, None), (132, None), (133, None), (133, "w1 w2")]
    texts += [(200 + i, "w5 w6 w5") for i in range(30)] + texts[:7] + [(None, "w8 w9"), (None, "w8")]
    df = spark.createDataFrame(texts, "id long, text string")
    blocks = ls.lsa_blocks(df, "id", "text", STOP)
    values, loadings = ls.fit_svd(blocks, "id", k=4, oversample=6, n_iter=2)
    want = ls.project(blocks, df, loadings, "id", 4, "SVD_text")
    got = ls.lsa(df, "id", "text", STOP, k=4, oversample=6, n_iter=2, matrix_bytes=1000, group_bytes=3000)
    assert got.columns == want.columns
    numbers = [np.array(sorted((-1 if r[0] is None else r[0], *map(lambda x: round(x, 6) + 0.0, r[1:])) for r in t.collect())) for t in (want, got)]
    assert numbers[0].shape == numbers[1].shape and np.allclose(*numbers, atol=2e-6)


def test_lsa_keeps_long_keys_apart(spark):
    df = spark.createDataFrame([(2**53, "w4 w5"), (2**53 + 1, "w3"), (None, "w8")], "id long, text string")
    got = {r.id: np.array(r[1:]) for r in ls.lsa(df, "id", "text", STOP, k=3).collect()}
    assert len(got) == 3 and not np.allclose(got[2**53], got[2**53 + 1])


def test_noise_is_the_hash_of_term_and_number(spark):
    terms = spark.createDataFrame([("a",), ("two words",), ("\u0451\u043b\u043a\u0430",)], "term string")
    for number in (0, 7, 3109):
        rows = terms.select(F.xxhash64("term").alias("h"), (F.xxhash64("term", F.lit(number)) / F.lit(float(2**63))).alias("v")).collect()
        assert ls._noise(np.array([r.h for r in rows]), [number])[:, 0].tolist() == [r.v for r in rows]


def test_lsa_without_any_word(spark):
    df = spark.createDataFrame([(1, ""), (2, "x"), (None, "")], "id int, text string")
    assert rows(ls.lsa(df, "id", "text", STOP, k=2), "id") == [(None, 0.0, 0.0), (1, 0.0, 0.0), (2, 0.0, 0.0)]


def test_a_short_lexicon_is_counted_in_place(spark, monkeypatch):
    data = [(1, ["good", "good", "bad", "x"], ["bad"]), (1, ["bad"], ["q"]), (2, [], []), (3, None, ["good"]), (None, ["good"], ["x", None])]
    df = spark.createDataFrame(data, "id int, a array<string>, b array<string>")
    lexicon = spark.createDataFrame([("good", 1), ("bad", -1), ("x", 0), ("y", None), (None, 1)], "word string, polarity int")
    counted = ot.polarity(df, "id", {"a": "a", "b": "b"}, lexicon)
    assert "Generate" not in counted._jdf.queryExecution().executedPlan().toString()  # no row for each word
    monkeypatch.setattr(ot, "LEXICON_WORDS", 0)
    joined = ot.polarity(df, "id", {"a": "a", "b": "b"}, lexicon)
    assert counted.schema == joined.schema and rows(counted, "id") == rows(joined, "id")
    monkeypatch.undo()
    twice = lexicon.unionByName(lexicon.where("word = 'bad'"))
    assert rows(ot.polarity(df, "id", {"a": "a"}, twice).where("id = 1").select("CNT_Neg_Words_a")) == [(4,)]


def test_terms_meet_their_loadings_in_groups(spark, monkeypatch):
    monkeypatch.setattr(ls, "PART_BYTES", 40)  # many groups of terms
    df = spark.createDataFrame([(i, f"w{i % 7} w{i % 5} w{i % 3} same words") for i in range(40)] + [(40, "alone"), (41, None)], "id long, text string")
    blocks = ls.lsa_blocks(df, "id", "text", STOP, 300)
    assert blocks.parts > 10 and blocks.named.select("part").distinct().count() > 5
    every = blocks.terms.select("term").distinct().where("term <> 'alone' and term not like 'w1%'")  # some without loadings
    loadings = every.select("term", F.array(F.length("term").cast("double"), F.crc32(F.col("term").cast("binary")) / 1e9).alias("loadings")).localCheckpoint()
    grouped, single = (ls.project(b, df, loadings, "id", 2, "p") for b in (blocks, ls.Blocks(blocks.rows, blocks.terms, "id", "bigint")))
    plans = [t._jdf.queryExecution().executedPlan().toString() for t in (grouped, single)]
    assert "Generate" not in plans[0] and "Generate" in plans[1]  # no row for each term
    assert np.allclose(np.array(rows(grouped, "id")), np.array(rows(single, "id"))) and grouped.count() == 42


def test_weights_make_no_row_for_each_term(spark):
    df = spark.createDataFrame([(1, "red fox red"), (2, "red dog")], "id int, text string")
    plan = ls.lsa_weights(df, "id", "text", STOP)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Generate" not in plan


def test_rows_of_term_groups_are_short(spark, monkeypatch):
    monkeypatch.setattr(ls, "CELLS", 50)
    df = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 11}" for j in range(20))) for i in range(30)], "id long, text string")
    matrix = ls._counted_groups(df, "id", "text", STOP, 1000, 10**6)
    assert matrix.terms.agg(F.max(F.size("docs"))).first()[0] <= 80  # the last term of a row has 30 documents at most
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= ls.BATCH_BYTES
