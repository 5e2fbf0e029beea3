"""Enrichment by keys that differ in spelling, through an index of deletions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.operators.joins import attach, unique_by
from tablewright.session import materialize


def deletions(text: Column, most: int) -> Column:
    """The text and all that is left of it after up to ``most`` deletions of a character."""
    found = level = F.array(text)
    for _ in range(most):
        level = F.array_distinct(F.flatten(F.transform(level, lambda t: F.transform(
            F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1))), lambda i, t=t: F.concat(F.substring(t, F.lit(1), i - 1), F.substr(t, i + 1))
        ))))
        found = F.array_union(found, level)
    return found


def nearest_keys(values: DataFrame, known: DataFrame, key: str, most: int = 2, least_length: int = 4) -> DataFrame:
    """(key, match, distance) of every different value that has a known key within ``most`` edits.

    A known value is its own match. Otherwise the least edit distance counts,
    ties go to the first in order of code points, and values or keys with
    fewer than ``least_length`` characters match nothing but themselves. Two texts
    within ``most`` edits leave a common rest after as many deletions on each
    side, so rests are joined by equality and only texts that share one are
    compared. Null has no match.
    """
    mine = values.select(key).where(F.col(key).isNotNull()).distinct()
    theirs = materialize(known.select(F.col(key).alias("match")).where("match is not null").distinct(), "known-keys")
    own = mine.join(theirs, F.col(key) == F.col("match"), "left")
    own = materialize(own, "exact-keys")
    exact = own.where("match is not null").withColumn("distance", F.lit(0))
    other = own.where("match is null").select(key).where(F.length(key) >= least_length)
    left = other.select(key, F.explode(deletions(F.col(key), most)).alias("_rest"))
    right = theirs.where(F.length("match") >= least_length).select("match", F.explode(deletions(F.col("match"), most)).alias("_rest"))
    pairs = left.join(right, "_rest").select(key, "match").distinct()
    near = pairs.withColumn("distance", F.levenshtein(key, "match")).where(F.col("distance") <= most)
    best = near.groupBy(key).agg(F.min(F.struct("distance", "match")).alias("_b")).select(key, "_b.match", "_b.distance")
    return exact.select(key, "match", "distance").unionByName(best)


def enrich_near(
    df: DataFrame, dimension: DataFrame, key: str, most: int = 2, least_length: int = 4, on_duplicate: str = "error"
) -> DataFrame:
    """Left-join a dimension by the nearest key; adds its columns, ``<key>_match`` and ``<key>_distance``.

    Rows are never multiplied, and a row whose key the dimension holds gets the
    same values as from ``joins.enrich``.
    """
    single = unique_by(dimension, key, on_duplicate)
    found = nearest_keys(df, single, key, most, least_length).withColumnsRenamed({"match": f"{key}_match", "distance": f"{key}_distance"})
    side = found.join(single.withColumnRenamed(key, f"{key}_match"), f"{key}_match")
    return attach(df, side, key)
