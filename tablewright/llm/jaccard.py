"""Documents linked by the Jaccard similarity of their word shingles, found exactly by a metric-space join.

1 - similarity is a metric, so distances to a few pivot documents tell which
documents can be close at all. Far from every pivot all distances are 1 and
tell nothing; there the rarest shingles part the space first. With r the
distance of the limit (0.2) the join goes:

1. **Documents without neighbours leave.** Two sets of the least similarity
   share at least one of their first ``n - ceil(0.8 n) + 1`` shingles in any
   common order, and one more for each place that both add to that. Shingles
   of the first places in hash order are counted over all documents; a document
   that shares too few of its own is farther than r from all others.
2. **Pivots.** Of the documents left, all shingles are counted, and each keeps
   the places it needs when the rarest come first. The first document of such
   a shingle is the pivot of all that hold it, so two linked documents always
   have a pivot in common, and shingles of passages that many documents share
   come last and make none.
3. **Regions.** The distance of each document to its pivots is computed from the
   full sets. Those within r of a pivot are linked with it. A region is done
   when links join all of it. Otherwise only documents outside the pivot's
   component still have to be compared, with whatever lies within r of their
   own distance to the pivot; the triangle inequality rules the others out.
4. **Recursion.** A region too large for one task takes further pivots from
   its own documents. Each document goes home to the nearest (a Voronoi cell) and
   also to every pivot at most 2 r farther than that: if y lives with q and
   d(x, y) <= r, then d(x, q) <= d(y, q) + r <= d(y, home of x) + r
   <= d(x, home of x) + 2 r. Cells are regions again. A region that cells do
   not make less work, or that is small, is compared in block pairs of bounded
   size, which return only the links that join something new.

Every link between different texts is found or already implied by others; no
step samples or caps. Distances are compared with a little slack outwards, links
are decided in whole numbers.

Defined results: a text that is null or has no word is the empty set, linked
with nothing. With fewer words than a shingle has, the whole sequence is the
one shingle. Equal sets are one class. Rows that share a key are one document:
links of one are links of all. A row with a null key is linked with nothing;
its component is null. Columns other than key and text are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import small_batches, store
from tablewright.llm.components import components
from tablewright.llm.neardup import shingles
from tablewright.session import materialize


@dataclass(frozen=True)
class Settings:
    shingle: int = 5
    #: Least similarity in percent, compared in whole numbers.
    percent: int = 80
    #: One more place of the first count for so many shingles.
    extra: int = 10
    #: Pivots that part a large region.
    pivots: int = 8
    #: Documents, and their shingles, that a block holds; a region of one block is not parted.
    block: int = 512
    block_shingles: int = 1_000_000
    levels: int = 4
    #: Bits of the test that keeps texts without neighbours from the shuffle: 4 MiB.
    bits: int = 1 << 25


#: Distances are compared with this much room.
SLACK = 1e-9


def _places(n: int, settings: Settings) -> int:
    """Places of the first count of a set of n."""
    return n - -(-settings.percent * n // 100) + 1 + n // settings.extra


def sketches(docs: DataFrame, key: str, text: str, settings: Settings) -> DataFrame:
    """id, n (set size), set (128-bit code of the whole set) and first (its first shingles in hash order) of every row."""

    def one(t: str | None) -> tuple:
        codes = shingles(t, settings.shingle)
        if not len(codes):
            return 0, None, None
        return len(codes), xxhash.xxh3_128_digest(codes.tobytes()), codes[:_places(len(codes), settings)].view(np.int64)

    @F.pandas_udf("n long, set binary, first array<long>")
    def sketch(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([one(t) for t in texts], columns=["n", "set", "first"])

    return docs.select(F.col(key).alias("id"), sketch(F.col(text)).alias("_s")).select("id", "_s.*")


def with_neighbours(sketch: DataFrame, settings: Settings) -> DataFrame:
    """set of the classes that share as many of their first shingles as a linked one must."""
    # A class by a short name and as often as it has rows; all of its rows hold the same shingles.
    short = F.xxhash64("set")
    tokens = sketch.select(short.alias("c"), F.explode("first").alias("t"))
    shared = tokens.groupBy("t").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("t")
    held = tokens.join(shared, "t", "left_semi").groupBy("c").agg(F.count(F.lit(1)).alias("held"))
    sizes = sketch.groupBy("set").agg(F.first("n").alias("n"), F.count(F.lit(1)).alias("rows")).withColumn("c", short)
    # A linked set has at least this share of the shingles, so it adds at least this many places.
    needed = F.expr(f"rows * (1 + ((n * {settings.percent} + 99) div 100) div {settings.extra})")
    return sizes.join(held, "c").where(F.col("held") >= needed).select("set")


def _marked(ids: DataFrame, bits: int) -> Callable[[Column], Column]:
    """A test of an id that every id of ``ids`` passes and few others, by one bit for each hash.

    The bits are ``bits / 8`` bytes whatever the number of ids. With too many ids
    for them the test passes more, and the join behind it does the rest.
    """
    spread = lambda c: F.pmod(F.xxhash64(c), F.lit(bits))
    place = spread(F.col("id")) + 1
    parts = ids.groupBy(F.bitmap_bucket_number(place).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("m"))
    held = np.zeros(bits // 8, dtype=np.uint8)
    for row in parts.collect():  # 4 KiB each, no more than the bits
        part = np.frombuffer(bytes(row.m), dtype=np.uint8)
        held[(row.b - 1) * len(part):row.b * len(part)] = part
    shared = ids.sparkSession.sparkContext.broadcast(held)

    @F.pandas_udf("boolean")
    def test(places: pd.Series) -> pd.Series:
        at = places.to_numpy()
        return pd.Series((shared.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1)

    return lambda c: test(spread(c))


def full_sets(docs: DataFrame, key: str, text: str, classes: DataFrame, settings: Settings) -> DataFrame:
    """c, n and codes (the whole set) of ``classes``, which has c, id and set."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for c, want, t in zip(batch["c"], batch["set"], batch["text"], strict=True):
                codes = shingles(t, settings.shingle)
                # Another row of the same key may have another text.
                if len(codes) and xxhash.xxh3_128_digest(codes.tobytes()) == bytes(want):
                    out.append((c, len(codes), codes.view(np.int64)))
            yield pd.DataFrame(out, columns=["c", "n", "codes"])

    source = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).where("id is not null")
    # Most texts have no neighbours; they stay where they are.
    source = source.where(_marked(classes, settings.bits)(F.col("id")))
    found = source.join(classes.select("c", "id", "set"), "id").select("c", "set", "text")
    sets = store(found.mapInPandas(read, "c long, n long, codes array<long>"), "sets")
    # Rows that repeat as a whole.
    if sets.groupBy("c").count().where("count > 1").take(1):
        sets = store(sets.dropDuplicates(["c"]), "sets")
    return sets


def pivot_pairs(sets: DataFrame, settings: Settings) -> DataFrame:
    """(p, c): every class with the pivots of its rarest shingles."""
    every = sets.select("c", F.explode("codes").alias("t"))
    often = every.groupBy("t").agg(F.count(F.lit(1)).alias("f")).where("f > 1")
    held = every.join(often, "t").groupBy("c").agg(F.sort_array(F.collect_list(F.struct("f", "t"))).alias("held"))
    # Shingles that no other class has are the rarest and take the first places.
    left = F.expr(f"CAST(n - (n * {settings.percent} + 99) div 100 + 1 - (n - size(held)) AS INT)")
    kept = held.join(sets.select("c", "n"), "c").withColumn("left", left).where("left > 0")
    keys = kept.select("c", F.explode(F.slice("held", F.lit(1), F.col("left"))).alias("k")).select("c", F.col("k.t").alias("t"))
    keys = materialize(keys, "rare-shingles")
    pivots = keys.groupBy("t").agg(F.min("c").alias("p"), F.max("c").alias("hi")).where("p <> hi").select("t", "p")
    return keys.join(pivots, "t").where("c <> p").select("p", "c").distinct()


def distances(pairs: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame:
    """``pairs`` (.., p, c) with d, their distance, and near, whether they are linked, from the full sets."""
    percent = settings.percent
    names = pairs.columns

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            d, near = np.empty(len(batch)), np.empty(len(batch), dtype=bool)
            for i, (a, b) in enumerate(zip(batch["codes_p"], batch["codes_c"], strict=True)):
                both = len(np.intersect1d(a, b, assume_unique=True))
                union = len(a) + len(b) - both
                d[i], near[i] = 1 - both / union, 100 * both >= percent * union
            yield batch[names].assign(d=d, near=near)

    sides = pairs.join(sets.select(F.col("c"), F.col("codes").alias("codes_c")), "c")
    sides = sides.join(sets.select(F.col("c").alias("p"), F.col("codes").alias("codes_p")), "p")
    schema = ", ".join(f"{c} {t}" for c, t in pairs.dtypes)
    return sides.select(*names, "codes_p", "codes_c").mapInPandas(measure, f"{schema}, d double, near boolean")


def open_regions(members: DataFrame, links: DataFrame, settings: Settings) -> DataFrame:
    """Members (g, p, c, d, above) that may still have a link to find, with their label, and out: not in the pivot's component.

    ``above`` is the size of the region they came from.

    Dropped are regions whose members the links join already, and members of the
    pivot's component that lie farther than r from the distances at which the
    others are.
    """
    r = 1 - settings.percent / 100 + SLACK
    label = components(links)
    centre = members.select("g", "p").distinct().select("g", "p", F.col("p").alias("c"), F.lit(0.0).alias("d"), F.lit(None).cast("long").alias("above"))
    every = members.unionByName(centre)
    named = every.join(label.withColumnRenamed("node", "c"), "c", "left").withColumn("label", F.coalesce("label", "c"))
    main = F.max(F.when(F.col("c") == F.col("p"), F.col("label")))
    span = named.groupBy("g").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), main.alias("main")).where("lo <> hi").select("g", "main")
    rows = materialize(named.join(span, "g").select("g", "p", "c", "d", "above", "label", (F.col("label") != F.col("main")).alias("out")), "open")
    reach = rows.where("out").groupBy("g").agg((F.min("d") - r).alias("from"), (F.max("d") + r).alias("to"))
    kept = rows.join(reach, "g").where(F.col("out") | F.col("d").between(F.col("from"), F.col("to")))
    return kept.select("g", "p", "c", "d", "above", "label", "out")


def _of(sets: DataFrame, members: DataFrame, settings: Settings) -> DataFrame:
    """The sets of a few members; the rest would only be moved."""
    return sets.where(_marked(members.select(F.col("c").alias("id")), settings.bits)(F.col("c")))


def cells(members: DataFrame, sets: DataFrame, level: int, settings: Settings) -> DataFrame:
    """Large regions parted: g, p, c, d, near, above of the Voronoi cells with their windows.

    Where windows hold so much that the cells together are more work than half
    of the region, the region stays whole; the links to its new pivots, which
    come with ``near``, have still joined many of its documents.
    """
    r2 = 2 * (1 - settings.percent / 100) + SLACK
    drawn = [F.min_by("c", F.when(F.col("out"), F.xxhash64("c", F.lit(level), F.lit(i)))) for i in range(settings.pivots)]
    pivots = members.groupBy("g").agg(F.array_distinct(F.array(*drawn)).alias("ps"))
    pairs = members.select("g", "c", "size").join(pivots, "g").select("g", "c", "size", F.explode("ps").alias("p"))
    far = materialize(distances(pairs, sets, settings), "pivot-distances")
    home = far.groupBy("g", "c").agg(F.min("d").alias("least"))
    inside = far.join(home, ["g", "c"]).withColumn("within", F.col("d") <= F.col("least") + r2)
    sizes = inside.where("within").groupBy("g", "p").agg(F.count(F.lit(1)).alias("n"), F.first("size").alias("size"))
    helped = sizes.groupBy("g").agg((F.sum(F.col("n") * F.col("n")) * 2 < F.first("size") * F.first("size")).alias("helped"))
    known = materialize(inside.where("c <> p").join(helped, "g"), "cells")
    parted = known.where("helped AND within").select(F.xxhash64("g", "p").alias("g"), "p", "c", "d", "near", F.col("size").alias("above"))
    links = known.where("near AND NOT (helped AND within)").select("g", "p", "c", "d", "near", F.lit(None).cast("long").alias("above"))
    whole = members.join(helped.where("NOT helped").select("g"), "g", "left_semi")
    whole = whole.select("g", "p", "c", "d", F.lit(False).alias("near"), F.col("size").alias("above"))
    return parted.withColumn("member", F.lit(True)).unionByName(links.withColumn("member", F.lit(False))).unionByName(
        whole.where("c <> p").withColumn("member", F.lit(True))
    )


def compare_blocks(members: DataFrame, sizes: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame:
    """Links (a, b) inside the regions of (g, c, d, label) that join something new, found in block pairs."""
    percent, r = settings.percent, 1 - settings.percent / 100 + SLACK
    cut = members.join(sizes.select("g", "blocks"), "g")
    cut = cut.withColumn("block", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cut = cut.withColumns({"lo": F.least("block", "other"), "hi": F.greatest("block", "other")})
    rows = cut.join(sets.select("c", "codes"), "c").select("g", "lo", "hi", "block", "c", "d", "label", "codes")

    def links(group: pd.DataFrame) -> pd.DataFrame:
        ids, block, d = group["c"].to_numpy(), group["block"].to_numpy(), group["d"].to_numpy()
        inside = group["lo"].iat[0] == group["hi"].iat[0]
        sets_ = list(group["codes"])
        n = np.fromiter(map(len, sets_), dtype=np.int64, count=len(sets_))
        starts = np.concatenate(([0], np.cumsum(n)[:-1]))
        values, flat = np.unique(np.concatenate(sets_), return_inverse=True)
        # Components of the group; a pair of one component has nothing to add.
        _, part = np.unique(group["label"].to_numpy(), return_inverse=True)
        found, mark = [], np.zeros(len(values), dtype=np.int64)
        for i in range(len(sets_)):
            may = (part != part[i]) & (np.abs(d - d[i]) <= r)
            may &= 100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i])
            if not inside:
                may &= block != block[i]
            at = np.flatnonzero(may)
            if not len(at):
                continue
            own = flat[starts[i]:starts[i] + n[i]]
            mark[own] = 1
            for j in at:
                if part[j] == part[i]:
                    continue
                both = int(mark[flat[starts[j]:starts[j] + n[j]]].sum())
                if 100 * both >= percent * (n[i] + n[j] - both):
                    part[part == part[j]] = part[i]
                    found.append((ids[i], ids[j]))
            mark[own] = 0
        return pd.DataFrame(found, columns=["a", "b"])

    return rows.groupBy("g", "lo", "hi").applyInPandas(links, "a long, b long").distinct()


def _sizes(members: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame:
    """g, size, above and blocks of every region."""
    n = members.join(sets.select("c", "n"), "c").groupBy("g").agg(
        F.count(F.lit(1)).alias("size"), F.max("above").alias("above"), F.sum("n").alias("total")
    )
    blocks = F.greatest(F.ceil(F.col("size") / settings.block), F.ceil(F.col("total") / settings.block_shingles)).cast("int")
    return materialize(n.select("g", "size", "above", blocks.alias("blocks")), "regions")


def class_links(sets: DataFrame, settings: Settings) -> DataFrame:
    """Links (a, b) between the classes of ``sets`` (c, n, codes) that join all that similarity joins."""
    pairs = materialize(pivot_pairs(sets, settings), "pivot-pairs")
    met = pairs.select("c").unionByName(pairs.select(F.col("p").alias("c"))).distinct()
    sets = store(sets.join(met, "c", "left_semi"), "sets")
    far = materialize(distances(pairs, sets, settings), "pivot-distances")
    links = far.where("near").select(F.col("p").alias("a"), F.col("c").alias("b"))
    members = far.select(F.col("p").alias("g"), "p", "c", "d", F.lit(None).cast("long").alias("above"))
    for level in range(settings.levels + 1):
        rows = materialize(open_regions(members, links, settings), "members")
        sizes = _sizes(rows, sets, settings)
        # A cell that kept nearly all of the region it came from gains nothing from more pivots.
        parted = (F.col("blocks") > 1) & (F.col("above").isNull() | (F.col("size") < 0.8 * F.col("above"))) & F.lit(level < settings.levels)
        large, small = sizes.where(parted), sizes.where(~parted)
        alone = materialize(rows.join(small.select("g"), "g", "left_semi"), "small-regions")
        more = materialize(compare_blocks(alone, small, _of(sets, alone, settings), settings), "block-links")
        links = links.unionByName(more)
        if not large.take(1):
            return links
        crowd = materialize(rows.join(large.select("g", "size"), "g"), "large-regions")
        found = materialize(cells(crowd, _of(sets, crowd, settings), level, settings), "parted")
        links = links.unionByName(found.where("near").select(F.col("p").alias("a"), F.col("c").alias("b")))
        members = found.where("member").drop("near", "member")
    raise AssertionError("the last level compares all that is left")


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> DataFrame:
    """key, n_shingles and component_id, the smallest key that links reach, for every row."""
    small_batches(docs.sparkSession)
    sketch = store(sketches(docs, key, text, settings), "sketches")
    full = sketch.where("n > 0 and id is not null")
    classes = full.groupBy("set").agg(F.min("id").alias("id"), F.first("n").alias("n"))
    # Written once, so that the numbers stay.
    classes = store(classes.select(F.monotonically_increasing_id().alias("c"), "set", "id", "n"), "classes")
    near = store(classes.select("c", "set", "id").join(with_neighbours(full, settings), "set"), "with-neighbours")
    sets = full_sets(docs, key, text, near, settings)
    links = class_links(sets, settings)

    # Rows that share a key but not a set are one document all the same.
    names = full.select("id", "set").distinct().join(classes.select("set", "c"), "set")
    twice = names.groupBy("id").agg(F.min("c").alias("a"), F.max("c").alias("z")).where("a <> z")
    same = names.join(twice, "id").where("c <> a").select("a", F.col("c").alias("b"))
    label = components(links.unionByName(same))

    reps = classes.select("c", "set", "id").join(label, classes["c"] == label["node"], "left")
    reps = store(reps.select("set", "id", F.coalesce("label", "c").alias("label")), "labels")
    first = reps.groupBy("label").agg(F.min("id").alias("component"))
    named = reps.join(first, "label").select("set", "component")
    out = sketch.select("id", "n", "set").join(named, "set", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"))
