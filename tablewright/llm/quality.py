"""Quality rules: counts of a text, and bands for its zstandard ratio.

A ratio is compressed bytes over bytes. Repetitive text has a small one,
random characters a large one, and both depend on the length: a short text
cannot repay the frame header, a long one has more to refer back to. So the
limits are given by length, for the whole document and for fixed chunks of it;
a document fails when its own ratio is outside its band, or when too large a
share of its chunks is outside theirs.

The rules are a Column over the text, evaluated in Arrow batches inside the
scan's tasks: no shuffle, and memory bounded by one batch.

Defined results: a null text has no words, so all counts are 0 and it fails
the base rules; so does an empty one. Repeated rows get equal results. The
text is never cut: a long one is compressed whole and in all its chunks.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import fresh, small_batches, words_of

#: Least bytes of a band, and the smallest and largest ratio allowed in it.
BANDS = (
    (0, 0.00, float("inf")),
    (128, 0.34, 1.10),
    (256, 0.32, 0.95),
    (512, 0.30, 0.88),
    (1024, 0.29, 0.80),
    (2048, 0.27, 0.76),
    (8192, 0.25, 0.72),
    (32768, 0.22, 0.70),
)

SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "n_bytes long, ratio double, n_chunks long, low_chunks long, high_chunks long, reason string, kept boolean"
)


@dataclass(frozen=True)
class Limits:
    """Parameters of the rules; the defaults are those of production."""

    bands: Sequence[tuple[int, float, float]] = BANDS
    chunk_bytes: int = 4096
    #: A document may have this share of its chunks outside their band.
    bad_share: float = 0.3
    level: int = 3
    min_words: int = 50
    repeat_percent: int = 50

    def band(self, n_bytes: int) -> tuple[float, float]:
        low, high = 0.0, float("inf")
        for least, lo, hi in self.bands:
            if n_bytes >= least:
                low, high = lo, hi
        return low, high


_SYMBOLS = b"#*$%&|<>"
_SPACES = b" \t\n\v\f\r"


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    if not text:
        return 0, 0, 0, 0, 0
    # A lone surrogate cannot be in a Spark string, so every text encodes.
    data = text.encode()
    words = words_of(data)
    word_chars = len(text) - (len(data) - len(data.translate(None, _SPACES)))
    n_symbols = len(data) - len(data.translate(None, _SYMBOLS))
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    n_dup = len(lines) - len(set(lines))
    return len(words), word_chars, n_symbols, n_dup, _repeated_words(words)


def _repeated_words(words: list[bytes]) -> int:
    """Words inside a 3-word window that occurs twice or more, each counted once."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    times = Counter(windows)
    n = end = 0
    for i, window in enumerate(windows):
        if times[window] > 1:
            n += i + 3 - max(i, end)
            end = i + 3
    return n


def compression(text: str | None, limits: Limits, packer: zstandard.ZstdCompressor) -> tuple:
    """n_bytes, ratio, n_chunks, low_chunks, high_chunks, and the reason to reject or None.

    Chunks are consecutive ``chunk_bytes`` of the UTF-8 text; the last may be
    shorter and is judged by the band of its own length.
    """
    data = (text or "").encode()
    if not data:
        return 0, None, 0, 0, 0, None
    ratio = len(packer.compress(data)) / len(data)
    low, high = limits.band(len(data))
    reason = "repetitive" if ratio < low else "incompressible" if ratio > high else None
    n = lows = highs = 0
    for start in range(0, len(data), limits.chunk_bytes):
        chunk = data[start:start + limits.chunk_bytes]
        part = len(packer.compress(chunk)) / len(chunk)
        low, high = limits.band(len(chunk))
        n, lows, highs = n + 1, lows + (part < low), highs + (part > high)
    if reason is None and lows + highs > limits.bad_share * n:
        reason = "repetitive chunks" if lows >= highs else "incompressible chunks"
    return len(data), ratio, n, lows, highs, reason


def judge(text: str | None, limits: Limits, packer: zstandard.ZstdCompressor) -> tuple:
    """One row of ``SCHEMA``."""
    counts = base_counts(text)
    failed = counts[0] < limits.min_words or 100 * counts[4] > limits.repeat_percent * counts[0]
    *sizes, reason = compression(text, limits, packer)
    return *counts, failed, *sizes, "base" if failed else reason, not failed and reason is None


def quality(text: Column, limits: Limits = Limits()) -> Column:
    """Struct of counts, ratios and verdict of a text column."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    @F.pandas_udf(SCHEMA)
    def verdicts(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        packer = zstandard.ZstdCompressor(level=limits.level)
        for texts in batches:
            out = pd.DataFrame([judge(t, limits, packer) for t in texts], columns=names)
            yield out.astype({"ratio": "float64", "base_failed": "bool", "kept": "bool"})

    return verdicts(text)


def quality_table(docs: DataFrame, key: str = "doc_id", text: str = "text", limits: Limits = Limits()) -> DataFrame:
    """Key and the fields of ``SCHEMA`` for every row; other columns are not read."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(key), quality(F.col(text), limits).alias("_q")).select(key, "_q.*")


def keep_good(docs: DataFrame, text: str = "text", limits: Limits = Limits()) -> DataFrame:
    """The rows that pass, with their own columns; names never clash."""
    small_batches(docs.sparkSession)
    q = fresh(docs, "_quality")
    judged = docs.withColumn(q, quality(F.col(text), limits))
    return judged.where(F.col(q)["kept"]).drop(q)
