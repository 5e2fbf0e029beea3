"""Centroid clustering of whole-number vectors with Ptolemaic lower bounds.

For points of Euclidean space Ptolemy's inequality says, for pivots p and s,

    d(x, c) * d(p, s) >= |d(x, p) * d(c, s) - d(x, s) * d(c, p)|

so the distances of a vector to fixed pivots, computed once and stored beside
it, give a lower bound on its distance to any centroid of any round from the
distances of the centroid to the same pivots. The pivots are the first
centroids and the pairs all pairs of different ones. A round

1. compares a vector exactly with the centroid of the least bound,
2. drops every centroid whose bound lies above that distance, the bound having
   been lowered by more than the rounding of its own computation,
3. compares what is left exactly, in whole numbers, ties to the smaller number.

A task adds up its vectors by centroid, so a round shuffles at most one sum a
component, centroid and task, and the driver sees the sums of each centroid. Vectors never move:
they are stored once in the shared folder and read again each round.

Defined results: vectors of another length than ``dim``, null ones and ones
with a null or non-finite component are left out. Rows that repeat are vectors
like any other; rows with equal keys are ordered by their components. A row
without a key is clustered too, but is a first centroid only when rows with a
key are too few. With fewer vectors than ``k`` there are as many centroids as
vectors; without vectors the result is empty. A component too large for
distances to fit a long is an error. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import small_batches, store


@dataclass(frozen=True)
class Settings:
    k: int = 8
    rounds: int = 10
    dim: int = 64
    #: A component x counts as floor(scale * x).
    scale: int = 1024
    #: First centroids have the least sha256 of ``seed:key``.
    seed: int = 3


#: Relative rounding that a bound is lowered by; its own is some ten units of 1.1e-16.
SLACK = 1e-12

BATCH = 4000


def whole_vectors(df: DataFrame, key: str, vector: str, settings: Settings) -> DataFrame:
    """id and v (whole numbers) of the rows that take part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    fit = df.where((F.size(vector) == settings.dim) & ~F.coalesce(bad, F.lit(True)))
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(settings.scale))).cast("long"))
    return fit.select(F.col(key).alias("id"), whole.alias("v"))


def first_centroids(rows: DataFrame, settings: Settings) -> np.ndarray:
    """The k vectors whose keys have the least hashes; k rows reach the driver."""
    order = F.sha2(F.concat(F.lit(f"{settings.seed}:"), F.col("id").cast("string")), 256)
    first = rows.orderBy(order.asc_nulls_last(), "v").limit(settings.k).collect()
    return np.array([r.v for r in first], dtype=np.int64).reshape(len(first), settings.dim)


def squared(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``x`` to one point."""
    gap = x - centre
    return np.einsum("ij,ij->i", gap, gap)


def ptolemy(far: np.ndarray, pivots: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Lower bounds, rows by centroids, from the distances ``far`` of rows to pivots."""
    to = np.sqrt(np.stack([squared(centres, p) for p in pivots]).astype(np.float64))
    bound = np.zeros((len(far), len(centres)))
    for p in range(len(pivots)):
        for s in range(p + 1, len(pivots)):
            apart = np.sqrt(float(squared(pivots[p:p + 1], pivots[s])[0]))
            if not apart:
                continue
            a, b = far[:, p, None] * to[None, s], far[:, s, None] * to[None, p]
            np.maximum(bound, (np.abs(a - b) - SLACK * (a + b)) / apart * (1 - SLACK), out=bound)
    return bound


def nearest(x: np.ndarray, bound: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid of each row, the squared distance, and how many were compared exactly."""
    rows = np.arange(len(x))
    label = bound.argmin(axis=1)
    gap = x - centres[label]
    best = np.einsum("ij,ij->i", gap, gap)
    open_ = bound * bound * (1 - SLACK) <= best[:, None]
    open_[rows, label] = False
    for c in range(len(centres)):
        at = np.flatnonzero(open_[:, c])
        d = squared(x[at], centres[c])
        better = (d < best[at]) | ((d == best[at]) & (c < label[at]))
        best[at[better]], label[at[better]] = d[better], c
    return label, best, open_.sum(axis=1) + 1


def _matrix(cells: pd.Series, kind, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(cells), dtype=kind).reshape(-1, width)


def with_pivot_distances(rows: DataFrame, pivots: np.ndarray, settings: Settings) -> DataFrame:
    """id, v and far (distances to the pivots), both packed."""
    dim = settings.dim
    # Twice the largest component, squared, times the length has to stay below 2^63.
    most = int(np.sqrt((2**63 - 1) / dim) / 2)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            x = np.stack(batch["v"].to_numpy()).astype(np.int64)
            if x.max() > most or x.min() < -most:
                raise ValueError(f"a component beyond {most} / {settings.scale} makes distances that no long holds")
            far = np.sqrt(np.stack([squared(x, p) for p in pivots], axis=1).astype(np.float64))
            yield pd.DataFrame({"id": batch["id"], "v": [r.tobytes() for r in x], "far": [r.tobytes() for r in far]})

    kind = dict(rows.dtypes)["id"]
    return rows.mapInPandas(measure, f"id {kind}, v binary, far binary")


def assigned(table: DataFrame, pivots: np.ndarray, centres: np.ndarray, settings: Settings) -> DataFrame:
    """id, cluster, distance (squared) and compared (centroids compared exactly) of every vector."""
    dim = settings.dim

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x, far = _matrix(batch["v"], np.int64, dim), _matrix(batch["far"], np.float64, len(pivots))
            label, best, compared = nearest(x, ptolemy(far, pivots, centres), centres)
            yield pd.DataFrame({"id": batch["id"], "cluster": label, "distance": best, "compared": compared})

    return table.mapInPandas(assign, f"id {dict(table.dtypes)['id']}, cluster int, distance long, compared int")


def moved(table: DataFrame, pivots: np.ndarray, centres: np.ndarray, settings: Settings) -> np.ndarray:
    """The centroids after one round: exact floors of means, empty ones unchanged."""
    dim = settings.dim

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(len(centres), dtype=np.int64)
        total = np.zeros((len(centres), dim), dtype=np.int64)
        for batch in batches:
            x, far = _matrix(batch["v"], np.int64, dim), _matrix(batch["far"], np.float64, len(pivots))
            label, _, _ = nearest(x, ptolemy(far, pivots, centres), centres)
            n += np.bincount(label, minlength=len(centres))
            for c in np.unique(label):
                total[c] += x[label == c].sum(axis=0)
        used = np.flatnonzero(n)
        if len(used):
            yield pd.DataFrame({"cluster": used, "n": n[used], "total": total[used].tolist()})

    parts = table.select("v", "far").mapInPandas(add, "cluster int, n long, total array<long>")
    sums = parts.select("cluster", "n", F.posexplode("total").alias("at", "t"))
    sums = sums.groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    out = centres.copy()
    for row in sums.collect():  # one a centroid and component
        out[row.cluster, row.at] = row.t // row.n
    return out


def cluster(df: DataFrame, key: str = "vec_id", vector: str = "embedding", settings: Settings = Settings()) -> DataFrame:
    """Key, cluster, distance, cluster_inertia, inertia, centroid_sha256 and compared for every vector that takes part."""
    spark = df.sparkSession
    small_batches(spark, BATCH)
    rows = whole_vectors(df, key, vector, settings)
    centres = pivots = first_centroids(rows, settings)
    if not len(pivots):
        return rows.limit(0).selectExpr(
            f"id AS `{key}`", "0 AS cluster", "0L AS distance", "0L AS cluster_inertia", "0L AS inertia", "'' AS centroid_sha256", "0 AS compared"
        )
    table = store(with_pivot_distances(rows, pivots, settings), "vectors")
    for _ in range(settings.rounds):
        centres = moved(table, pivots, centres, settings)
    out = store(assigned(table, pivots, centres, settings), "clusters")
    hashes = [(c, hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(centres.tolist())]
    names = spark.createDataFrame(hashes, "cluster int, centroid_sha256 string")
    # A row for each centroid.
    inertia = out.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia")).join(names, "cluster")
    total = out.agg(F.sum("distance")).first()[0]
    return out.join(F.broadcast(inertia), "cluster").select(
        F.col("id").alias(key), "cluster", "distance", "cluster_inertia", F.lit(total).cast("long").alias("inertia"), "centroid_sha256", "compared"
    )
