"""Near-duplicate documents by MinHash with tensored banding.

A document is the set of its word shingles. Two small collections of
``tables`` half keys, each of ``width`` minhash values, are computed for a set;
a table of the index is keyed by one half key of either collection, so
``tables ** 2`` tables cost only ``2 * tables * width`` minhash values. Two sets
of similarity s miss each other with a chance of at most
``2 * (1 - s ** width) ** tables``: 7e-5 at s = 0.8 with the defaults.

1. Equal sets are one class from the start, represented by its smallest key.
2. Half keys that only one class has are dropped, then the rest are combined
   to table keys.
3. Every class of a bucket is paired with the smallest one of it. Signature
   bytes sort out hopeless pairs, and the full shingle sets decide the rest.
4. What stars leave open is finished exactly: buckets whose classes, apart
   from the centre, are still in more than one component are compared fully,
   in blocks of ``block`` classes by half key. A block pair returns only the
   links that join something new, never its pairs.
5. Components of all links give each document the smallest key it can reach.

No bucket is collected, capped or sampled: centres are aggregates, and large
buckets are cut into block pairs.

Defined results: a text that is null or has no word is the empty set, linked
with nothing. With fewer words than a shingle has, the whole sequence is the
one shingle. Rows that share a key are one document: links of one are links of
all. A row with a null key is linked with nothing; its component is null and
it is kept. Columns other than key and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import small_batches, store, words_of
from tablewright.llm.components import components


@dataclass(frozen=True)
class Settings:
    shingle: int = 5
    #: Least similarity in percent, compared in whole numbers.
    percent: int = 80
    width: int = 2
    tables: int = 10
    #: Equal signature bytes, of 2 * tables * width, below which a pair is not
    #: compared: at similarity 0.8 fewer than 18 of 40 has a chance of 1e-6.
    least_equal: int = 18
    #: Classes of a bucket that are compared at once.
    block: int = 512
    seed: int = 20_240_501


_MIX = np.uint64(0x9E3779B97F4A7C15)
_HALF = np.uint64(32)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _HALF)) * _MIX
    return x ^ (x >> _HALF)


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit codes of the k-word shingles of a text, A-Z in lower case."""
    words = words_of(text.encode().lower()) if text else []
    if not words:
        return np.empty(0, dtype=np.uint64)
    codes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    n = min(k, len(words))
    # The length is part of the code: a short text equals only the same short text.
    out = np.full(len(words) - n + 1, np.uint64(n), dtype=np.uint64)
    for i in range(n):
        out = _mix(out + codes[i:len(codes) - n + 1 + i])
    return np.unique(out)


def _functions(settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Factors and masks of the 2 * tables * width hash functions."""
    n = 2 * settings.tables * settings.width
    draw = np.random.default_rng(settings.seed)
    factors = draw.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return factors, draw.integers(0, 1 << 63, n, dtype=np.uint64)


def _minima(codes: np.ndarray, factors: np.ndarray, masks: np.ndarray) -> np.ndarray:
    """The minhash values of a set."""
    least = np.full(len(factors), np.iinfo(np.uint64).max, dtype=np.uint64)
    for start in range(0, len(codes), 4096):
        part = (codes[start:start + 4096, None] ^ masks) * factors
        np.minimum(least, part.min(axis=0), out=least)
    return least


def sketches(docs: DataFrame, key: str, text: str, settings: Settings) -> DataFrame:
    """id, n (set size), set (128-bit code of the whole set), half keys and signature bytes of every row."""
    factors, masks = _functions(settings)
    salt = np.arange(1, 2 * settings.tables + 1, dtype=np.uint64)
    k, width = settings.shingle, settings.width

    def one(t: str | None) -> tuple:
        codes = shingles(t, k)
        if not len(codes):
            return 0, None, None, None
        least = _minima(codes, factors, masks)
        half = salt.copy()
        for column in least.reshape(-1, width).T:
            half = _mix(half + column)
        return len(codes), xxhash.xxh3_128_digest(codes.tobytes()), half.view(np.int64), (_mix(least) >> np.uint64(56)).astype(np.uint8).tobytes()

    @F.pandas_udf("n long, set binary, half array<long>, sig binary")
    def sketch(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([one(t) for t in texts], columns=["n", "set", "half", "sig"])

    return docs.select(F.col(key).alias("id"), sketch(F.col(text)).alias("_s")).select("id", "_s.*")


def table_keys(classes: DataFrame, settings: Settings) -> DataFrame:
    """id, a (half key of the first collection) and key of every table a class may share with another."""
    halves = classes.select("id", F.posexplode("half").alias("at", "h"))
    shared = halves.groupBy("h").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("h")
    left = halves.join(shared, "h", "left_semi")
    # At most 2 * tables half keys meet again for a class.
    side = left.groupBy("id").agg(
        F.collect_list(F.when(F.col("at") < settings.tables, F.col("h"))).alias("first"),
        F.collect_list(F.when(F.col("at") >= settings.tables, F.col("h"))).alias("second"),
    )
    pairs = side.select("id", F.explode("first").alias("a"), "second").select("id", "a", F.explode("second").alias("b"))
    return pairs.select("id", "a", F.xxhash64("a", "b").alias("key"))


def _likely(least: int) -> Column:
    @F.pandas_udf("boolean")
    def likely(a: pd.Series, b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype=bool)
        x = np.frombuffer(b"".join(a), dtype=np.uint8).reshape(len(a), -1)
        y = np.frombuffer(b"".join(b), dtype=np.uint8).reshape(len(a), -1)
        return pd.Series((x == y).sum(axis=1) >= least)

    return likely(F.col("sig_a"), F.col("sig_b"))


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(a) + len(b) - len(np.union1d(a, b))
    return 100 * both >= percent * (len(a) + len(b) - both)


def confirm(pairs: DataFrame, texts: DataFrame, settings: Settings) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough; ``texts`` has id and text."""
    k, percent = settings.shingle, settings.percent

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Rows of one centre follow each other, so its set is made once.
        last: tuple = (None, None)
        for batch in batches:
            keep = []
            for ta, tb in zip(batch["text_a"], batch["text_b"], strict=True):
                if last[0] != ta:
                    last = (ta, shingles(ta, k))
                keep.append(_similar(last[1], shingles(tb, k), percent))
            yield batch.loc[np.array(keep, dtype=bool), ["a", "b"]]

    kind = dict(texts.dtypes)["id"]
    b = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    a = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    return pairs.join(b, "b").join(a, "a").mapInPandas(check, f"a {kind}, b {kind}")


def compare_blocks(members: DataFrame, texts: DataFrame, settings: Settings) -> DataFrame:
    """Links inside every group ``a`` of (a, id), found by comparing all of it in block pairs.

    ``texts`` has id, text and sig. A block pair is at most twice ``block``
    classes whatever the size of its group.
    """
    size, k, percent, least = settings.block, settings.shingle, settings.percent, settings.least_equal
    sizes = members.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / size).cast("int")
    cut = members.join(sizes, "a").withColumn("blocks", blocks)
    cut = cut.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    cut = cut.select("a", "id", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    cut = cut.select("a", "id", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))
    rows = cut.join(texts, "id").select("a", "lo", "hi", "block", "id", "text", "sig")

    def links(group: pd.DataFrame) -> pd.DataFrame:
        ids, block = group["id"].to_numpy(), group["block"].to_numpy()
        inside = group["lo"].iat[0] == group["hi"].iat[0]
        sets = [shingles(t, k) for t in group["text"]]
        n = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
        starts = np.concatenate(([0], np.cumsum(n)[:-1]))
        values, flat = np.unique(np.concatenate(sets), return_inverse=True)
        sig = np.frombuffer(b"".join(group["sig"]), dtype=np.uint8).reshape(len(sets), -1)
        root = list(range(len(sets)))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        found, mark = [], np.zeros(len(values), dtype=np.int64)
        for i in range(len(sets)):
            if not inside and block[i] != group["lo"].iat[0]:
                continue
            may = (sig == sig[i]).sum(axis=1) >= least
            may &= (np.arange(len(sets)) > i) if inside else (block != block[i])
            if not may.any():
                continue
            mark[flat[starts[i]:starts[i] + n[i]]] = 1
            both = np.add.reduceat(mark[flat], starts)
            mark[flat[starts[i]:starts[i] + n[i]]] = 0
            for j in np.flatnonzero(may & (100 * both >= percent * (n + n[i] - both))):
                x, y = find(i), find(int(j))
                if x != y:
                    root[x] = y
                    found.append((ids[i], ids[j]))
        return pd.DataFrame(found, columns=["a", "b"])

    kind = dict(members.dtypes)["id"]
    return rows.groupBy("a", "lo", "hi").applyInPandas(links, f"a {kind}, b {kind}").distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """key, n_shingles, component_id and kept (first of its component) for every row."""
    small_batches(docs.sparkSession)
    sketch = store(sketches(docs, key, text, settings), "sketches")
    full = sketch.where("n > 0 and id is not null")
    members = full.select("id", "set")
    # Classes of equal sets, and of rows that share a key.
    classes = full.groupBy("set").agg(F.min("id").alias("id"), F.min_by(F.struct("half", "sig"), "id").alias("s"))
    classes = store(classes.select("id", "set", "s.*"), "classes")

    keys = store(table_keys(classes, settings), "table-keys")
    centres = keys.groupBy("key").agg(F.min("id").alias("c"), F.max("id").alias("hi")).where("c <> hi").select("key", "c")
    inside = store(keys.join(centres, "key").where("id <> c").select("key", "a", "id", "c"), "buckets")

    pairs = inside.select(F.col("c").alias("a"), F.col("id").alias("b")).distinct()
    sig = classes.select("id", "sig")
    sig_a, sig_b = (sig.select(F.col("id").alias(x), F.col("sig").alias(f"sig_{x}")) for x in "ab")
    likely = pairs.join(sig_a, "a").join(sig_b, "b").where(_likely(settings.least_equal)).select("a", "b")
    wanted = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    source = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    texts = store(source.join(wanted, "id", "left_semi"), "texts")
    links = store(confirm(likely, texts, settings), "star-links")

    label = components(links)
    named = inside.join(label.withColumnRenamed("node", "id"), "id", "left")
    named = named.select("key", "a", "id", "c", F.coalesce("label", "id").alias("label"))
    mixed = named.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("key")
    left = store(inside.join(mixed, "key", "left_semi").select("a", "id").distinct(), "open-buckets")
    more = compare_blocks(left, texts.join(sig, "id"), settings)
    links = links.unionByName(more)

    # Rows that share a key but not a set are one document all the same.
    names = members.distinct().join(classes.select("set", F.col("id").alias("rep")), "set")
    twice = names.where("id <> rep").join(names.groupBy("id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo <> hi").select("id"), "id", "left_semi")
    label = components(links.unionByName(twice.select(F.col("id").alias("a"), F.col("rep").alias("b"))))

    reps = classes.select("set", F.col("id").alias("node")).join(label, "node", "left")
    reps = reps.select("set", F.coalesce("label", "node").alias("component"))
    out = sketch.select("id", "n", "set").join(reps, "set", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(
        F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"),
    )


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` whose document is the first of its component, with their own columns."""
    found = near_duplicates(docs, key, text, settings)
    gone = store(found.where(~F.col("kept")).select(F.col(key).alias("_gone")).distinct(), "gone")
    return docs.join(gone, docs[key] == gone["_gone"], "left_anti")
