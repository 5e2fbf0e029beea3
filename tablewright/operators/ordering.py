"""Positions, parts and ranks without sorting a whole table in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.session import materialize

_IN_PARTITION = (1 << 33) - 1


def hash_order(key, seed: int | str) -> Column:
    """A reproducible random order: the md5 of seed and key, as hex text."""
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def hash_fold(key, n: int, seed: int | str = 0) -> Column:
    """Fold 0..n-1 of a row, from the leading digits of its hash."""
    return F.pmod(F.conv(F.substring(hash_order(key, seed), 1, 8), 16, 10).cast("long"), F.lit(n)).cast("int")


def global_index(
    df: DataFrame, order: Sequence, name: str = "row_index", total: str | None = None
) -> DataFrame:
    """0-based position of every row under a total order.

    Rows are range-partitioned, numbered inside their partition and written
    once; the start of each partition is a running sum over one count per
    partition. No task ever holds more than its own range.
    """
    cols = df.columns
    ranged = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_mid", F.monotonically_increasing_id())
    )
    stored = materialize(ranged, "index")
    pid = F.shiftright(F.col("_mid"), 33)
    # As many rows as there were range partitions.
    counts = stored.groupBy(pid.alias("_pid")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    starts = counts.select(
        "_pid",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"),
        F.sum("_n").over(everything).alias("_total"),
    )
    position = F.col("_start") + F.col("_mid").bitwiseAND(_IN_PARTITION)
    extra = [F.col("_total").alias(total)] if total else []
    return (
        stored.withColumn("_pid", pid)
        .join(F.broadcast(starts), "_pid")
        .select(*cols, position.alias(name), *extra)
    )


def assign_part(df: DataFrame, n: int, order: Sequence, name: str = "part") -> DataFrame:
    """Even split into ``n`` consecutive parts, 1-based, larger parts first."""
    indexed = global_index(df, order, "_pos", total="_total")
    small = f"(_total div {n})"
    large = f"({small} + 1)"
    edge = f"((_total % {n}) * {large})"
    part = F.expr(
        f"CASE WHEN _pos < {edge} THEN _pos div {large} "
        f"ELSE (_total % {n}) + (_pos - {edge}) div {small} END"
    )
    return indexed.withColumn(name, (part + 1).cast("int")).drop("_pos", "_total")


def chunk_id(df: DataFrame, size: int, order: Sequence, name: str = "chunk") -> DataFrame:
    """Number of the fixed-size chunk a row falls in, from 0."""
    indexed = global_index(df, order, "_pos")
    return indexed.withColumn(name, F.expr(f"_pos div {int(size)}")).drop("_pos")


def rank_terms(df: DataFrame, score: str, term: str, n: int | None = None) -> DataFrame:
    """Sort by score, best first, ties by term; ``n`` keeps the top of a report."""
    ordered = df.orderBy(F.col(score).desc(), F.col(term).asc())
    return ordered.limit(n) if n is not None else ordered
