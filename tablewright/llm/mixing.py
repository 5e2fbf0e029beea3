"""Mixing sources to target weights by Pfair scheduling.

The documents of a source, in a reproducible random order, form blocks of
``block_rows``. A source with weight w = units / period gets block i released at
slot floor(i / w) and due by slot ceil((i + 1) / w). Every slot goes to the
released block with the earliest deadline, ties to the first source by name.
Since the weights add up to one and all times are whole slots, earliest
deadline first meets every deadline, so at any slot no source is a whole block
ahead of or behind its share. The schedule repeats after ``period`` slots, so
one period is worked out and all blocks look their slot up.

Each document is placed once. When the smaller sources are used up their slots
stay empty and the others keep their own slots: nothing is dropped or
repeated, and each prefix has the target shares among the sources that last.

Only DataFrame functions are used. Ranks inside a source come from ranges of
one global order, so a source with a third of all rows is many tasks.

Defined results: a null source is the source ``''``. Rows that share source and
key are one document and share a place. An empty table gives an empty one.
A source missing from given weights is an error, a weight of a source without
documents leaves its slots empty.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import fresh
from tablewright.operators.ordering import global_index, hash_order
from tablewright.session import materialize


@dataclass(frozen=True)
class Settings:
    block_rows: int = 16
    #: About the units that all weights add up to; each source has one at least.
    period: int = 1000
    #: Weights are the row counts to this power: 1 keeps the shares, 0 evens them out.
    power: float = 0.5
    seed: int = 7


def units_by_size(docs: DataFrame, source: str = "source", settings: Settings = Settings()) -> DataFrame:
    """source and units: whole weights from the sizes of the sources.

    One row per source; the number of sources, not of documents, bounds it.
    """
    sizes = docs.groupBy(F.coalesce(F.col(source), F.lit("")).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    raw = sizes.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(settings.power)))
    total = raw.agg(F.sum("w").alias("all"))
    share = F.floor(F.lit(settings.period) * F.col("w") / F.col("all") + 0.5).cast("int")
    return raw.join(F.broadcast(total)).select("source", F.greatest(F.lit(1), share).alias("units"))


def period_slots(units: DataFrame) -> DataFrame:
    """source, units, period, turn (block within the period) and slot, for one period.

    Earliest deadline first over the slots of a period, as a fold over one row
    that holds the weights; its size is that of the weights, never of the data.
    """
    pairs = units.agg(F.array_sort(F.collect_list(F.struct("source", "units"))).alias("s"), F.sum("units").cast("int").alias("period"))
    pairs = pairs.where("period > 0")

    def step(state: Column, t: Column) -> Column:
        def candidate(x: Column, k: Column) -> Column:
            done = F.element_at(state["done"], k + 1)
            due = F.ceil((done + 1) * F.col("period") / x["units"])
            released = F.floor(done * F.col("period") / x["units"]) <= t
            return F.when(released & (done < x["units"]), F.struct(due.alias("due"), k.alias("k")))

        best = F.array_min(F.transform(F.col("s"), candidate))["k"]
        counted = F.transform(state["done"], lambda n, k: n + F.when(k == best, 1).otherwise(0))
        return F.struct(counted.alias("done"), F.concat(state["order"], F.array(best)).alias("order"))

    start = F.struct(F.transform("s", lambda x: F.lit(0)).alias("done"), F.array().cast("array<int>").alias("order"))
    order = F.aggregate(F.sequence(F.lit(0), F.col("period") - 1), start, step)["order"]
    slots = pairs.withColumn("order", order).select("s", "period", F.posexplode("order").alias("slot", "k"))
    by_source = slots.groupBy(F.col("s")[F.col("k")].alias("x"), "period").agg(F.sort_array(F.collect_list("slot")).alias("slots"))
    return by_source.select("x.source", "x.units", "period", F.posexplode("slots").alias("turn", "slot"))


def schedule(docs: DataFrame, key: str = "doc_id", source: str = "source", units: DataFrame | None = None, settings: Settings = Settings()) -> DataFrame:
    """key, source, units, block, place, released, due and slot of every document.

    Sorted by (slot, place) the documents are in their mixed order.
    """
    rows = docs.select(F.col(key).alias("id"), F.coalesce(F.col(source), F.lit("")).alias("source")).distinct()
    units = units if units is not None else units_by_size(docs, source, settings)
    slots = materialize(period_slots(units), "period")
    order = ["source", hash_order(F.coalesce(F.col("id").cast("string"), F.lit("")), settings.seed), "id"]
    numbered = materialize(global_index(rows, order, "rank"), "ranks")
    starts = numbered.groupBy("source").agg(F.min("rank").alias("start"))
    # As many rows as there are sources.
    known = starts.join(slots.select("source", "units", "period").distinct(), "source", "left")
    known = known.withColumn("units", F.when(F.col("units").isNull(), F.raise_error(F.concat(F.lit("no weight for source "), "source"))).otherwise(F.col("units")))
    ranked = numbered.join(known, "source").withColumn("rank", F.col("rank") - F.col("start"))
    block = F.floor(F.col("rank") / settings.block_rows)
    placed = ranked.select(
        "id", "source", "units", "period", block.alias("block"), (F.col("rank") % settings.block_rows).cast("int").alias("place"),
        (block % F.col("units")).cast("int").alias("turn"),
    )
    placed = placed.join(slots.select("source", "turn", F.col("slot").alias("in_period")), ["source", "turn"])
    cycle = F.floor(F.col("block") / F.col("units"))
    return placed.select(
        F.col("id").alias(key), F.col("source").alias(source), "units", "block", "place",
        F.floor(F.col("block") * F.col("period") / F.col("units")).alias("released"),
        F.ceil((F.col("block") + 1) * F.col("period") / F.col("units")).alias("due"),
        (cycle * F.col("period") + F.col("in_period")).alias("slot"),
    )


def with_places(docs: DataFrame, key: str = "doc_id", source: str = "source", units: DataFrame | None = None, settings: Settings = Settings(), slot: str = "slot", place: str = "place") -> DataFrame:
    """Every row of ``docs`` with its slot and its place in the slot, in no order."""
    own, of, at, inside = (fresh(docs, name) for name in ("_id", "_source", "_slot", "_place"))
    placed = schedule(docs, key, source, units, settings)
    placed = placed.select(F.col(key).alias(own), F.col(source).alias(of), F.col("slot").alias(at), F.col("place").alias(inside))
    same = docs[key].eqNullSafe(placed[own]) & (F.coalesce(docs[source], F.lit("")) == placed[of])
    joined = docs.join(placed, same).drop(own, of)
    return joined.withColumnsRenamed({at: slot, inside: place})


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", units: DataFrame | None = None, settings: Settings = Settings()) -> DataFrame:
    """All rows of ``docs`` in their mixed order: ranges of slots, sorted inside; written out, file by file in that order.

    A reader may take the files in another order; :func:`with_places` looks the
    slots of the same rows up again, and they are the same ones.
    """
    slot, place = fresh(docs, "_slot"), fresh(docs, "_place")
    mixed = with_places(docs, key, source, units, settings, slot, place)
    return mixed.repartitionByRange(slot, place).sortWithinPartitions(slot, place).drop(slot, place)
