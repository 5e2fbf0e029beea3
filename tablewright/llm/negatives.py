"""Hard negatives: for each anchor and positive, the best rows of another label inside a window below the positive's score.

A score is the inner product of whole-number vectors. The first ``positives``
rows of an anchor's own label are its positives; a positive of score p asks for
the first ``k`` rows of other labels with ``least * p <= 100 * s <= most * p``.
The windows of an anchor overlap, so they are not searched one by one:

1. The upper limits of its positives cut an anchor's scores into disjoint
   slots: slot j holds the scores above limit j + 1 and up to limit j.
2. A combiner keeps the first ``k`` rows of each slot, in every task and again
   where the tasks meet, so an anchor never has more than positives * k rows
   of a group of rows.
3. Slots from j downwards, merged in descending order, hold the first rows up
   to limit j, whichever of them the first k are; the lower limit only cuts
   the end of that list off. One sorted merge of an anchor's slots answers all
   of its windows.

Anchors and rows are packed into blocks of bounded size, and every block of
anchors meets every group of row blocks in one task of a co-group: no cross
join, no broadcast, no vector on the driver. Work is the stated query set
against all rows.

Defined results: rows without a label or a vector, or with a null or
non-finite component, and rows without a key take no part. A key names one
row: rows that share it count as the one with the smallest label, then the
smallest components. Higher scores come first, ties by smaller key. Vectors of
different lengths are compared over their common part. An anchor without
positives, and a positive without rows in its window, returns nothing. Scores
too large for a long are an error. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tablewright.llm.common import small_batches, store
from tablewright.operators.ordering import global_index


@dataclass(frozen=True)
class Settings:
    positives: int = 5
    k: int = 10
    #: Window of a negative's score in hundredths of the positive's.
    least: int = 30
    most: int = 90
    #: Rows of a packed block, blocks of a group, and anchors of a block.
    rows: int = 2048
    group: int = 4
    anchors: int = 2048


BATCH = 2048
#: Anchors whose scores are held at once.
SLICE = 128


def taking_part(df: DataFrame, key: str, vector: str, label: str, scale: float, relabel: Column | None = None) -> DataFrame:
    """id, label and v (whole numbers) of the rows that take part, one for each key."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    fit = df.where(F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(True)))
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))
    named = F.col(label) if relabel is None else relabel
    rows = fit.select(F.col(key).cast("long").alias("id"), F.struct(named.cast("long").alias("label"), whole.alias("v")).alias("r"))
    return rows.groupBy("id").agg(F.min("r").alias("r")).select("id", "r.label", "r.v")


def _packed(ids: list, labels: list, vectors: list) -> Iterator[dict]:
    """One block for each length of vector."""
    lengths = np.fromiter(map(len, vectors), dtype=np.int64, count=len(vectors))
    for width in np.unique(lengths):
        at = np.flatnonzero(lengths == width)
        data = np.stack([vectors[i] for i in at]).astype(np.int64) if width else np.zeros((len(at), 0), dtype=np.int64)
        yield {
            "width": int(width), "ids": np.array([ids[i] for i in at], dtype=np.int64).tobytes(),
            "labels": np.array([labels[i] for i in at], dtype=np.int64).tobytes(), "data": data.tobytes(),
        }


def row_blocks(rows: DataFrame, settings: Settings) -> DataFrame:
    """The rows packed, at most ``rows`` of them in a block: block, width, ids, labels, data."""
    size = settings.rows

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = TaskContext.get().partitionId() << 32
        for batch in batches:
            out = []
            for start in range(0, len(batch), size):
                part = batch.iloc[start:start + size]
                out += _packed(part["id"].tolist(), part["label"].tolist(), part["v"].tolist())
            for at, block in enumerate(out):
                block["block"] = first + at
            first += len(out)
            if out:
                yield pd.DataFrame(out)[["block", "width", "ids", "labels", "data"]]

    return store(rows.mapInPandas(pack, "block long, width int, ids binary, labels binary, data binary"), "row-blocks")


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows over the columns both have."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    if not width or not len(a) or not len(b):
        return np.zeros((len(a), len(b)), dtype=np.int64)
    # In Python's whole numbers: the least long has no positive counterpart.
    most = max(int(a.max()), -int(a.min())) * max(int(b.max()), -int(b.min())) * width
    if most < 2**53:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most >= 2**63:
        raise ValueError("vectors whose scores no long holds")
    return a @ b.T


def _first(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k, best score first, ties by smaller id."""
    at = np.arange(len(score))
    if len(score) > k:
        limit = -np.partition(-score, k - 1)[k - 1]
        at = np.flatnonzero(score >= limit)
    return at[np.lexsort((ids[at], -score[at]))][:k]


def _blocks_of(group: pd.DataFrame) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    out = []
    for width, ids, labels, data in zip(group["width"], group["ids"], group["labels"], group["data"], strict=True):
        ids = np.frombuffer(ids, dtype=np.int64)
        out.append((ids, np.frombuffer(labels, dtype=np.int64), np.frombuffer(data, dtype=np.int64).reshape(len(ids), width)))
    return out


Picker = Callable[[int, int, np.ndarray, np.ndarray, np.ndarray], list[tuple[int, np.ndarray]]]


def against_all(anchors: DataFrame, blocks: DataFrame, n_blocks: int, n_anchor_blocks: int, pick: Picker, limits: bool, settings: Settings) -> DataFrame:
    """anchor, slot, id, score that ``pick`` keeps of each anchor and group of row blocks.

    ``pick(anchor, label, ids, labels, scores[, uppers])`` returns places by slot.
    ``anchors`` has a (block), width, ids, labels, data and, with ``limits``,
    uppers: one list of whole numbers for each anchor, packed.
    """
    groups = -(-n_blocks // settings.group)
    rows = blocks.withColumn("g", F.pmod(F.xxhash64("block"), F.lit(groups)))
    rows = rows.withColumn("a", F.explode(F.expr(f"sequence(0L, {n_anchor_blocks - 1}L)")))
    each = anchors.withColumn("g", F.explode(F.expr(f"sequence(0L, {groups - 1}L)")))

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = {"anchor": [], "slot": [], "id": [], "score": []}
        sides = _blocks_of(left)
        if sides and len(right):
            ids, labels = (np.concatenate([s[i] for s in sides]) for i in (0, 1))
            uppers = [np.frombuffer(u, dtype=np.int64).reshape(-1, settings.positives + 1) for u in right["uppers"]] if limits else None
            for b, (a_ids, a_labels, a_data) in enumerate(_blocks_of(right)):
                for start in range(0, len(a_ids), SLICE):
                    scores = np.concatenate([_product(a_data[start:start + SLICE], s[2]) for s in sides], axis=1)
                    for i, row in enumerate(scores, start):
                        extra = (uppers[b][i],) if limits else ()
                        for slot, at in pick(a_ids[i], a_labels[i], ids, labels, row, *extra):
                            found["anchor"].append(np.full(len(at), a_ids[i]))
                            found["slot"].append(np.full(len(at), slot))
                            found["id"].append(ids[at])
                            found["score"].append(row[at])
        return pd.DataFrame({c: np.concatenate(v) if v else np.empty(0, dtype=np.int64) for c, v in found.items()})

    schema = "anchor long, slot int, id long, score long"
    return rows.groupBy("a", "g").cogroup(each.groupBy("a", "g")).applyInPandas(score, schema)


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The first k rows of each anchor and slot; tasks cut their own rows down before the shuffle."""
    order = Window.partitionBy("anchor", "slot").orderBy(F.col("score").desc(), "id")
    return found.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k)


def anchor_blocks(anchors: DataFrame, settings: Settings) -> DataFrame:
    """The anchors packed by position: a (block), width, ids, labels, data."""
    placed = global_index(anchors, ["id"], "at").withColumn("a", F.floor(F.col("at") / settings.anchors).cast("long"))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(_packed(group["id"].tolist(), group["label"].tolist(), group["v"].tolist()))
        out["a"] = group["a"].iat[0]
        return out[["a", "width", "ids", "labels", "data"]]

    # A group is one block, of a fixed number of anchors.
    return placed.groupBy("a").applyInPandas(pack, "a long, width int, ids binary, labels binary, data binary")


def _with_limits(anchors: DataFrame, slots: DataFrame, settings: Settings) -> DataFrame:
    """Anchor blocks with the descending upper limits of each anchor and, last, the least score of any window."""
    wide = settings.positives

    def merge(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        known = dict(zip(right["anchor"], zip(right["uppers"], right["floor"], strict=True), strict=True))
        packed = []
        for ids in left["ids"]:
            block = np.full((len(ids) // 8, wide + 1), np.iinfo(np.int64).min, dtype=np.int64)
            for i, anchor in enumerate(np.frombuffer(ids, dtype=np.int64)):
                if anchor in known:
                    uppers, floor = known[anchor]
                    block[i, :len(uppers)], block[i, wide] = uppers, floor
            packed.append(block.tobytes())
        return left.assign(uppers=packed)[["a", "width", "ids", "labels", "data", "uppers"]]

    schema = "a long, width int, ids binary, labels binary, data binary, uppers binary"
    return anchors.groupBy("a").cogroup(slots.groupBy("a")).applyInPandas(merge, schema)


def mine(rows: DataFrame, is_anchor: Column, settings: Settings = Settings()) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; ``rows`` has id, label and v, a row for each id."""
    spark = rows.sparkSession
    small_batches(spark, BATCH)
    rows = store(rows, "vectors")
    blocks = row_blocks(rows, settings)
    placed = store(anchor_blocks(rows.where(is_anchor), settings), "anchors")
    n_blocks, n_anchor_blocks = blocks.count(), placed.agg(F.coalesce(F.max("a") + 1, F.lit(0))).first()[0]
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not n_anchor_blocks:
        return spark.createDataFrame([], schema)
    positives, k = settings.positives, settings.k

    def same(anchor, label, ids, labels, scores):
        at = np.flatnonzero((labels == label) & (ids != anchor))
        return [(0, at[_first(scores[at], ids[at], positives)])]

    best = _merged(against_all(placed, blocks, n_blocks, n_anchor_blocks, same, False, settings), positives)
    # Whole-number limits of a window, and the slot that its upper limit opens.
    upper, lower = (
        F.expr(f"CAST({rounding}(CAST(score AS DECIMAL(20, 0)) * {share // 100}.{share % 100:02d}BD) AS LONG)")
        for rounding, share in (("floor", settings.most), ("ceil", settings.least))
    )
    pos = best.select("anchor", F.col("id").alias("positive"), F.col("score").alias("p"), upper.alias("upper"), lower.alias("lower"))
    pos = store(pos, "positives")
    # At most five limits an anchor.
    slots = pos.groupBy("anchor").agg(F.sort_array(F.collect_set("upper"), False).alias("uppers"), F.min("lower").alias("floor"))
    a_of = global_index(rows.where(is_anchor).select("id"), ["id"], "at")
    a_of = a_of.select(F.col("id").alias("anchor"), F.floor(F.col("at") / settings.anchors).cast("long").alias("a"))
    limited = store(_with_limits(placed, slots.join(a_of, "anchor"), settings), "limits")

    def by_slot(anchor, label, ids, labels, scores, limits):
        out = []
        uppers = limits[:positives]
        # Limits fall; unused places hold the least long, and so does an anchor without positives.
        uppers = uppers[uppers > np.iinfo(np.int64).min]
        if not len(uppers):
            return out
        other = np.flatnonzero((labels != label) & (scores <= uppers[0]) & (scores >= limits[positives]))
        slot = np.searchsorted(-uppers, -scores[other], side="right") - 1
        for j in range(len(uppers)):
            at = other[slot == j]
            if len(at):
                out.append((j, at[_first(scores[at], ids[at], k)]))
        return out

    kept = _merged(against_all(limited, blocks, n_blocks, n_anchor_blocks, by_slot, True, settings), k)
    # Descending merge of an anchor's slots, at most positives * k rows.
    merged = kept.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "id"))).alias("m"))
    window = F.slice(F.filter("m", lambda r: (-r["s"] <= F.col("upper")) & (-r["s"] >= F.col("lower"))), 1, k)
    answered = pos.join(merged, "anchor").select("anchor", "positive", "p", F.posexplode(window).alias("at", "n"))
    return answered.select(
        F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), (F.col("at") + 1).cast("int").alias("rank"),
        F.col("n.id").alias("negative_id"), F.col("p").alias("positive_score"), (-F.col("n.s")).alias("negative_score"),
    )
