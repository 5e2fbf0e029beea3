"""History statistics as a state that new batches are merged into."""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.operators.groups import Feature
from tablewright.session import exists, qualified

#: Features that a state can answer.
KINDS = ("mean", "std", "sum", "count", "nunique")


def _parts(value: str) -> Column:
    """Count, mean and sum of squared differences from the mean."""
    x = F.col(value).cast("double")
    return F.struct(
        F.count(x).alias("n"), F.coalesce(F.avg(x), F.lit(0.0)).alias("mean"),
        F.coalesce(F.var_pop(x) * F.count(x), F.lit(0.0)).alias("m2"),
    ).alias(value)


def batch_state(rows: DataFrame, key: str, values: Sequence[str], distinct: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(stats, pairs) of a batch: moments of each value by key, and the different (key, field, value) of counted fields.

    A null key is no group, as in ``group_stats``; nulls are no values.
    """
    known = rows.where(F.col(key).isNotNull())
    stats = known.groupBy(key).agg(F.count(F.lit(1)).alias("rows"), *[_parts(v) for v in values])
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in distinct])
    if not distinct:
        each = F.expr("CAST(array() AS array<struct<field:string,value:string>>)")
    pairs = known.select(key, F.inline(each)).where("value is not null").distinct()
    return stats, pairs


def _merged(parts: Column) -> Column:
    """Moments of several states of one key, put together pair by pair."""

    def join(a: Column, b: Column) -> Column:
        n = a["n"] + b["n"]
        gap = b["mean"] - a["mean"]
        share = F.when(n > 0, b["n"].cast("double") / n).otherwise(0.0)
        return F.struct(n.alias("n"), (a["mean"] + gap * share).alias("mean"), (a["m2"] + b["m2"] + gap * gap * a["n"] * share).alias("m2"))

    empty = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
    return F.aggregate(parts, empty, join)


def merge(key: str, *states: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """One state as if all the rows had been one batch; a key has one row in each state."""
    stats, pairs = (reduce(lambda a, b: a.unionByName(b), [s[i] for s in states]) for i in (0, 1))
    values = [c for c in stats.columns if c not in (key, "rows")]
    # As many rows of a key as there are states.
    joined = stats.groupBy(key).agg(F.sum("rows").alias("rows"), *[_merged(F.sort_array(F.collect_list(v))).alias(v) for v in values])
    return joined, pairs.distinct()


def features(state: tuple[DataFrame, DataFrame], key: str, wanted: Sequence[Feature]) -> DataFrame:
    """What ``group_stats`` gives for the same rows."""
    stats, pairs = state
    unknown = [f.stat for f in wanted if f.stat not in KINDS]
    if unknown:
        raise ValueError(f"a state has no {unknown}")
    counted = [f for f in wanted if f.stat == "nunique"]

    def value(f: Feature) -> Column:
        m = F.col(f.field) if f.stat != "nunique" else None
        found = {
            "mean": lambda: F.when(m["n"] > 0, m["mean"]),
            "std": lambda: F.when(m["n"] > 1, F.sqrt(m["m2"] / (m["n"] - 1))),
            "sum": lambda: m["mean"] * m["n"],
            "count": lambda: m["n"],
            "nunique": lambda: F.coalesce(F.col(f"_d_{f.field}"), F.lit(0)),
        }[f.stat]()
        return (found if f.fill is None else F.coalesce(found, F.lit(f.fill))).alias(f.name)

    if counted:
        sizes = pairs.groupBy(key).agg(*[F.count(F.when(F.col("field") == f, 1)).alias(f"_d_{f}") for f in dict.fromkeys(f.field for f in counted)])
        stats = stats.join(sizes, key, "left")
    return stats.select(key, *[value(f) for f in wanted])


class StateStore:
    """Versions of a state in a folder; every version lists the batches in it.

    A batch is merged once: one that a version already holds changes nothing,
    so a repeated or killed run goes on where the last complete version is.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, values: Sequence[str], distinct: Sequence[str] = ()):
        self.spark, self.path, self.key = spark, qualified(spark, path), key
        self.values, self.distinct = list(values), list(distinct)

    def _last(self) -> tuple[int, list[str]]:
        if not exists(self.spark, f"{self.path}/versions"):
            return 0, []
        lines = self.spark.read.schema("version int, batches string").json(f"{self.path}/versions").orderBy(F.col("version").desc()).limit(1).collect()
        return (lines[0].version, json.loads(lines[0].batches)) if lines else (0, [])

    def _tables(self, version: int) -> tuple[DataFrame, DataFrame]:
        return tuple(self.spark.read.parquet(f"{self.path}/{name}-{version:06d}") for name in ("stats", "pairs"))

    def pending(self, batches: Sequence[str]) -> list[str]:
        """Names of the batches that the state does not hold yet."""
        done = set(self._last()[1])
        return [b for b in dict.fromkeys(batches) if b not in done]

    def add(self, batch: str, rows: DataFrame) -> int:
        """Merge a batch and give the version that holds it."""
        version, done = self._last()
        if batch in done:
            return version
        states = [batch_state(rows, self.key, self.values, self.distinct)]
        if version:
            states.insert(0, self._tables(version))
        for name, table in zip(("stats", "pairs"), merge(self.key, *states), strict=True):
            # A killed write leaves no line in versions and is written again.
            table.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/{name}-{version + 1:06d}")
        line = self.spark.createDataFrame([(version + 1, json.dumps([*done, batch]))], "version int, batches string")
        line.coalesce(1).write.mode("append").json(f"{self.path}/versions")
        return version + 1

    def features(self, wanted: Sequence[Feature], version: int | None = None) -> DataFrame:
        return features(self._tables(self._last()[0] if version is None else version), self.key, wanted)
