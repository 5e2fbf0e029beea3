"""Language identification by words, backing off to ever shorter n-grams.

The method is the published word-based backoff: every language has a list of
words with their log frequency. A word of the text that stands in any list
scores its negative log frequency in each language, or a fixed penalty where
it is missing. A word in no list is cut into character n-grams, longest
first; the first length with a known n-gram gives the mean score of those, and
shorter ones are tried only if none is known. The text scores the mean over
all its words, and the language with the least is chosen.

Training counts words and n-grams with Spark over a bounded sample of labelled
rows (about ``rows_per_language``, chosen by a hash of the key) and keeps the
most frequent entries of each list, fewer the more languages there are, so the
model has a proven size and is broadcast. Every label is learned. Every text is then scored whole, inside the tasks of its scan.

Defined results: a null text, or one without a letter, is ``und`` with score
0. A text of letters of which nothing is known gets the most frequent
training language with an even score. Ties go to the language with more
training rows, then by name. Without any training row all texts are ``und``.
Rows with a null label or null key are not trained on.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.common import fresh, small_batches
from tablewright.session import materialize

UNKNOWN = "und"
SCHEMA = "lang_pred string, score double"
_WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Settings:
    """Bounds of the model; they do not depend on the size of the input."""

    rows_per_language: int = 2000
    max_words: int = 20_000
    max_ngrams: int = 8_000
    #: Lists of more languages than this are shorter, so that the model keeps its size; no language is left out.
    full_lists: int = 64
    longest: int = 5
    #: Negative log10 frequency of an entry that a language does not have.
    penalty: float = 7.0


@dataclass
class Scores:
    """A matrix of entries by languages that holds only what the lists hold; all else is the penalty.

    The last row is the penalty everywhere.
    """

    starts: np.ndarray
    columns: np.ndarray
    values: np.ndarray
    width: int
    penalty: float

    def __len__(self) -> int:
        return len(self.starts)

    def __getitem__(self, rows: np.ndarray) -> np.ndarray:
        out = np.full((len(rows), self.width), self.penalty)
        ends = np.append(self.starts[1:], len(self.values))[rows]
        sizes = ends - self.starts[rows]
        # Places of the values of all rows, one row after another.
        at = np.arange(int(sizes.sum())) + np.repeat(ends - np.cumsum(sizes), sizes)
        out[np.repeat(np.arange(len(rows)), sizes), self.columns[at]] = self.values[at]
        return out


@dataclass
class Model:
    """Scores by entry: ``tables[0]`` for words, ``tables[n]`` for n-grams of n characters.

    A table gives the row of an entry in ``scores``, which has a column for
    each language; the last row holds the penalty everywhere.
    """

    languages: list[str]
    tables: dict[int, dict[str, int]]
    scores: np.ndarray | Scores
    longest: int
    _seen: dict[str, int] = field(default_factory=dict)
    _rows: np.ndarray | None = None

    #: Words whose scores a worker remembers, fewer with more than four languages; reached, it starts anew.
    REMEMBERED = 200_000

    def _entries(self, word: str) -> list[int]:
        """Rows whose mean is the score of a word: its own, or those of its longest known n-grams."""
        own = self.tables[0].get(word)
        if own is not None:
            return [own]
        padded = f" {word} "
        for n in range(min(self.longest, len(padded)), 0, -1):
            get = self.tables[n].get
            found = [x for i in range(len(padded) - n + 1) if (x := get(padded[i:i + n])) is not None]
            if found:
                return found
        return [len(self.scores) - 1]

    def score_words(self, words: list[str]) -> np.ndarray:
        """A row of scores for each word."""
        entries = [self._entries(w) for w in words]
        sizes = np.fromiter(map(len, entries), dtype=np.int64, count=len(entries))
        flat = np.fromiter(chain.from_iterable(entries), dtype=np.int64, count=int(sizes.sum()))
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        return np.add.reduceat(self.scores[flat], starts, axis=0) / sizes[:, None]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0
        words = _WORD.findall(text.lower())
        seen = self._seen
        new = list(set(words).difference(seen))
        if self._rows is None or len(seen) + len(new) > len(self._rows):
            if self._rows is not None and len(seen) + len(new) > self.REMEMBERED * 4 // max(4, len(self.languages)):
                seen.clear()
                new = list(set(words))
            grown = np.empty((max((1 << 16) // len(self.languages), 2 * (len(seen) + len(new))), len(self.languages)))
            if seen:
                grown[:len(seen)] = self._rows[:len(seen)]
            self._rows = grown
        if new:
            n = len(seen)
            self._rows[n:n + len(new)] = self.score_words(new)
            seen.update(zip(new, range(n, n + len(new)), strict=True))
        rows = np.fromiter(map(seen.__getitem__, words), dtype=np.int64, count=len(words))
        return self._choose(self._rows[rows].mean(axis=0))

    def _choose(self, scores: np.ndarray) -> tuple[str, float]:
        """The least score, and its share when scores are read as log probabilities of a word."""
        # Rounded so that the order in which words are summed cannot break a tie.
        best = int(np.argmin(np.round(scores, 9)))
        share = float(1.0 / np.sum(np.power(10.0, scores[best] - scores)))
        return self.languages[best], min(1.0, max(0.0, share))


def is_held_out(key: Column) -> Column:
    """Rows that are never trained on: crc32 of the key as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _sample(docs: DataFrame, key: str, text: str, lang: str, settings: Settings) -> tuple[DataFrame, list]:
    """About ``rows_per_language`` rows of each language, and [language, rows] by size."""
    labelled = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l"))
    labelled = labelled.where(F.col("l").isNotNull() & F.col("k").isNotNull() & ~is_held_out(F.col("k")))
    counts = labelled.groupBy("l").agg(F.count(F.lit(1)).alias("n"))
    counts = materialize(counts, "language-sizes")
    sizes = [(r["l"], r["n"]) for r in counts.orderBy(F.desc("n"), "l").collect()]  # a row for each language
    draw = F.pmod(F.xxhash64("k"), F.lit(1 << 30)) / float(1 << 30)
    drawn = labelled.join(F.broadcast(counts), "l").where(draw < F.least(F.lit(1.0), F.lit(float(settings.rows_per_language)) / F.col("n")))
    return drawn.drop("n"), sizes


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", settings: Settings = Settings()) -> Model:
    """Fit the lists; see the module's text for what is counted."""
    small_batches(docs.sparkSession)
    sample, sizes = _sample(docs, key, text, lang, settings)
    languages = [l for l, _ in sizes]
    longest = settings.longest

    def count_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n: Counter = Counter()
            for l, t in zip(batch["l"], batch["t"], strict=True):
                n.update((l, w) for w in _WORD.findall((t or "").lower()))
            yield pd.DataFrame([(l, w, c) for (l, w), c in n.items()], columns=["l", "w", "n"])

    def count_ngrams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n: Counter = Counter()
            for l, w, c in zip(batch["l"], batch["w"], batch["n"], strict=True):
                padded = f" {w} "
                for size in range(1, longest + 1):
                    for i in range(len(padded) - size + 1):
                        n[l, size, padded[i:i + size]] += c
            yield pd.DataFrame([(l, s, g, c) for (l, s, g), c in n.items()], columns=["l", "size", "w", "n"])

    if not languages:
        return Model([], {n: {} for n in range(longest + 1)}, np.zeros((1, 0)), longest)
    words = sample.mapInPandas(count_words, "l string, w string, n long").groupBy("l", "w").agg(F.sum("n").alias("n"))
    words = materialize(words, "language-words")
    grams = words.mapInPandas(count_ngrams, "l string, size int, w string, n long")
    grams = grams.groupBy("l", "size", "w").agg(F.sum("n").alias("n"))
    lists = words.select("l", F.lit(0).alias("size"), "w", "n").unionByName(grams)
    # A list holds what a bounded sample holds, so its rank is a bounded task.
    each = Window.partitionBy("l", "size")
    share = min(1.0, settings.full_lists / len(languages))
    most = F.when(F.col("size") == 0, int(settings.max_words * share)).otherwise(int(settings.max_ngrams * share))
    kept = (
        lists.withColumn("total", F.sum("n").over(each))
        .withColumn("place", F.row_number().over(each.orderBy(F.desc("n"), "w")))
        .where(F.col("place") <= most).select("l", "size", "w", "n", "total").toPandas()
    )
    column = {l: i for i, l in enumerate(languages)}
    tables: dict[int, dict[str, int]] = {n: {} for n in range(longest + 1)}
    at = np.empty(len(kept), dtype=np.int64)
    n = 0
    for i, (size, w) in enumerate(zip(kept["size"], kept["w"], strict=True)):
        at[i] = tables[size].setdefault(w, n)
        n += at[i] == n
    order = np.argsort(at, kind="stable")
    starts = np.searchsorted(at[order], np.arange(n + 1))
    values = (np.log10(kept["total"]) - np.log10(kept["n"])).to_numpy()[order]
    scores = Scores(starts, kept["l"].map(column).to_numpy()[order], values, len(languages), settings.penalty)
    return Model(languages, tables, scores, longest)


def language(docs: DataFrame, model: Model, text: str = "text") -> Column:
    """Struct of ``lang_pred`` and ``score`` for the text column of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(SCHEMA)
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for texts in batches:
            yield pd.DataFrame([m.predict(t) for t in texts], columns=["lang_pred", "score"])

    return scored(F.col(text))


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", model: Model | None = None, settings: Settings = Settings()) -> DataFrame:
    """key, held_out, lang_pred and score for every row, trained on the rows not held out."""
    small_batches(docs.sparkSession)
    model = model or train(docs, key, text, lang, settings)
    scored = docs.select(F.col(key), is_held_out(F.col(key)).alias("held_out"), language(docs, model, text).alias("_l"))
    return scored.select(key, "held_out", "_l.*")


def keep_identified(docs: DataFrame, min_score: float = 0.5, key: str = "doc_id", text: str = "text", lang: str = "lang", settings: Settings = Settings()) -> DataFrame:
    """Rows whose language is known with at least ``min_score``, with their own columns.

    Rejected are texts without letters and those whose best language has less
    than half of the share: no language of the corpus.
    """
    small_batches(docs.sparkSession)
    model = train(docs, key, text, lang, settings)
    c = fresh(docs, "_language")
    scored = docs.withColumn(c, language(docs, model, text))
    return scored.where((F.col(c)["lang_pred"] != UNKNOWN) & (F.col(c)["score"] >= min_score)).drop(c)
