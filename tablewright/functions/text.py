"""Tokens and their statistics as Column expressions (no shuffle, no Python)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ASCII punctuation marks, one word or one mark as a token,
# and words of two or more characters for n-grams.
PUNCTUATION = r"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~"""
TOKEN_PATTERN = r"[\p{L}\p{M}\p{N}_]+|[^ \t\n\r\f\p{L}\p{M}\p{N}_]"
WORD_PATTERN = r"[\p{L}\p{M}\p{N}_]{2,}"
NUMERIC_PATTERN = r"\p{N}"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text) -> Column:
    """Words and single marks; null text has no tokens."""
    return F.regexp_extract_all(F.coalesce(_col(text), F.lit("")), F.lit(TOKEN_PATTERN), F.lit(0))


def is_punctuation(token: Column) -> Column:
    """True for a token found, as a substring, in the list of marks."""
    return F.contains(F.lit(PUNCTUATION), token)


def is_stop_word(token: Column, stop_words: Sequence[str]) -> Column:
    return token.isin(*stop_words) if len(stop_words) else F.lit(False)


def clean_words(token_array, stop_words: Sequence[str]) -> Column:
    """Tokens that are neither stop words nor punctuation; case matters."""
    return F.filter(
        _col(token_array), lambda t: ~is_stop_word(t, stop_words) & ~is_punctuation(t)
    )


def count_tokens(token_array, keep) -> Column:
    return F.size(F.filter(_col(token_array), keep))


def count_marks(token_array, marks: Sequence[str]) -> Column:
    return count_tokens(token_array, lambda t: t.isin(*marks))


def count_numeric(text) -> Column:
    return F.regexp_count(F.coalesce(_col(text), F.lit("")), F.lit(NUMERIC_PATTERN))


def average_length(words) -> Column:
    """Mean number of characters in a word; 0 without words."""
    words = _col(words)
    total = F.length(F.array_join(words, ""))
    return F.coalesce(F.try_divide(total.cast("double"), F.size(words).cast("double")), F.lit(0.0))


def ngram_array(text, stop_words: Sequence[str]) -> Column:
    """Lower-cased words of 2+ characters, then pairs of neighbours.

    Stop words go first, so a pair may bridge a removed word. Missing text
    reads ``NA``.
    """
    lowered = F.lower(F.coalesce(_col(text), F.lit("NA")))
    words = F.filter(
        F.regexp_extract_all(lowered, F.lit(WORD_PATTERN), F.lit(0)), lambda w: ~is_stop_word(w, stop_words)
    )
    return words


def with_bigrams(words) -> Column:
    words = _col(words)
    n = F.size(words)
    pairs = F.zip_with(
        F.slice(words, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(words, F.lit(2), F.greatest(n - 1, F.lit(0))),
        lambda a, b: F.concat(a, F.lit(" "), b),
    )
    return F.concat(words, pairs)
