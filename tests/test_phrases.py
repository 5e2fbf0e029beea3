"""Phrases of any length against a search of every place."""

import random

import pytest

from tablewright.operators import text as ot
from tablewright.operators.phrases import PhraseIndex


def brute(tokens, phrases):
    inside = set()
    for p in phrases:
        for i in range(len(tokens) - len(p) + 1):
            if tokens[i:i + len(p)] == p:
                inside.update(range(i, i + len(p)))
    return len(inside)


def made(seed, letters="abc"):
    rng = random.Random(seed)
    phrases = [[rng.choice(letters) for _ in range(rng.randint(1, 8))] for _ in range(rng.randint(1, 12))]
    texts = [[rng.choice(letters) for _ in range(rng.randint(0, 40))] for _ in range(20)]
    return [p for p in phrases if len(p) > 1 or seed % 2], texts


@pytest.mark.parametrize("seed", range(40))
def test_automaton_equals_brute_force(seed):
    phrases, texts = made(seed)
    index = PhraseIndex(phrases)
    assert [index.covered(t) for t in texts] == [brute(t, phrases) for t in texts]


def test_entity_words_of_any_length(spark, join_mode):
    phrases, texts = made(4, "abcd")
    phrases += [["bank", "of", "new", "york"], list("abcdabcd")]
    texts += [["the", "bank", "of", "new", "york", "of"], ["bank", "of", "new"], [], list("abcdabcdabcd")]
    df = spark.createDataFrame([(i, t, t[::-1]) for i, t in enumerate(texts)] + [(99, None, None)], "k int, a array<string>, b array<string>")
    entities = spark.createDataFrame([(" ".join(p),) for p in phrases + phrases[:2]] + [(None,), ("",)], "phrase string")
    got = {r.k: (r.CNT_Named_Entity_a, r.CNT_Named_Entity_b) for r in ot.entity_words(df, "k", {"a": "a", "b": "b"}, entities).collect()}
    assert got == {**{i: (brute(t, phrases), brute(t[::-1], phrases)) for i, t in enumerate(texts)}, 99: (0, 0)}
    none = ot.entity_words(df, "k", {"a": "a"}, entities.where("phrase = 'nothing'"))
    assert {r.CNT_Named_Entity_a for r in none.collect()} == {0}
