"""Small tables with everything that may go wrong in a column."""

import random

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng, n, words):
    return " ".join(rng.choice(words) for _ in range(n))


def words_of_language(rng, letters, n=300):
    return ["".join(rng.choice(letters) for _ in range(rng.randint(3, 7))) for _ in range(n)]


def odd_rows():
    """doc_id, text, lang, source, n_chars with nulls, empty and long texts, repeats and copies."""
    rng = random.Random(11)
    words = words_of_language(rng, ["an", "be", "co", "du", "en", "fi"])
    base = sentence(rng, 120, words)
    long = "\n".join(sentence(rng, 200, words) for _ in range(60))
    return [
        (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, " \t\n ", None, None, 4), (4, base, "en", "a", len(base)),
        (5, base, "en", "b", len(base)), (6, base.upper(), "en", "a", len(base)), (7, long, "en", "a", len(long)),
        (8, long + " more", "en", None, len(long) + 5), (9, "one two", "en", "c", 7), (10, "One TWO", "en", "c", 7),
        (11, "é" * 400, "fr", "c", 400), (12, "1234 5678 !!", "en", "a", 12), (13, "日本語 😀 text\x00end", "ja", "a", 14),
        (None, base, "en", "a", len(base)), (4, base, "en", "a", len(base)), (14, sentence(rng, 3, words), None, "a", 9),
    ]


def clashing(df):
    """The same table with columns named as operators name theirs."""
    for name in ("_quality", "_language", "_id", "_source", "_at", "_gone", "id", "ids", "n", "half", "sig", "kept", "component_id", "slot", "run", "key", "payload", "shard"):
        df = df.selectExpr("*", f"1 AS `{name}`")
    return df


@pytest.fixture(scope="session")
def odd(spark):
    return clashing(spark.createDataFrame(odd_rows(), DOC).repartition(3))


@pytest.fixture(scope="session")
def none(spark):
    return clashing(spark.createDataFrame([], DOC))
