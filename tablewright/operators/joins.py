"""Keyed joins: features to items, dictionaries, dimensions."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.session import materialize, plain_bytes

#: A key with more than this share of the rows, and more rows than one task should have, is hot.
HOT_SHARE = 1e-5
TASK_ROWS = 1_000_000


def _keys(key: str | Sequence[str]) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def assemble(base: DataFrame, features: Sequence[DataFrame], key: str | Sequence[str]) -> DataFrame:
    """Left-join feature tables, each with one row per key, to ``base``.

    All joins use the same key, so ``base`` is shuffled once however many
    tables follow.
    """
    return reduce(lambda left, right: left.join(right, _keys(key), "left"), features, base)


def _broadcast_limit(spark: SparkSession) -> int:
    """``spark.sql.autoBroadcastJoinThreshold`` in bytes; 0 when switched off."""
    text = str(spark.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760")).strip().lower()
    found = re.fullmatch(r"(-?\d+)\s*([kmgtp]?)b?", text)
    if not found:
        raise ValueError(f"spark.sql.autoBroadcastJoinThreshold is not a size: {text}")
    number, unit = found.groups()
    return max(int(number), 0) * 1024 ** " kmgtp".index(unit or " ")


def fits_broadcast(df: DataFrame) -> bool:
    """Hold the size of a stored table against the broadcast threshold of the session.

    The size was measured when the table was written; a table that was not
    stored here is measured now. A type whose size is not plain to measure
    counts as too large.
    """
    limit = _broadcast_limit(df.sparkSession)
    if not limit:
        return False
    known = getattr(df, "_stored_bytes", None)
    if known is None:
        size = plain_bytes(df)
        if size is None:
            return False
        known = df.agg(size.alias("bytes")).first()["bytes"]
    return known <= limit


def attach(
    items: DataFrame, stats: DataFrame, key: str | Sequence[str],
    fill: Mapping[str, Any] | None = None, weight: str | None = None,
    how: str = "left", store: bool = True, salt_by: Sequence[str] | None = None,
    hot: DataFrame | None = None, even: bool = False,
) -> DataFrame:
    """Join statistics, one row per key, to items.

    The statistics are stored (unless ``store`` is off because they are
    already) and their size is known from that. Small ones are broadcast, so
    ``items`` is not shuffled; larger ones take :func:`salted_attach`.
    ``weight`` names a column of ``stats`` with the row count behind each key;
    it tells the hot keys and is dropped. Without it they are counted in
    ``items``, unless ``even`` says that no key has many rows.
    """
    keys = _keys(key)
    if store:
        stats = materialize(stats, "stats")
    plain = stats.drop(weight) if weight else stats
    if fits_broadcast(stats):
        joined = items.join(F.broadcast(plain), keys, how)
    elif even:
        joined = items.join(plain, keys, how)
    else:
        joined = salted_attach(items, stats, keys, weight, how, salt_by=salt_by, hot=hot)
    return joined.fillna(dict(fill)) if fill else joined


def hot_keys(
    sizes: DataFrame, key: str | Sequence[str], size: str, share: float = HOT_SHARE, task_rows: int = TASK_ROWS
) -> DataFrame:
    """Keys that hold more than ``share`` of the total size and more than ``task_rows``.

    There are fewer than ``1 / share`` of them, whatever the data. ``_parts``
    is the number of tasks the rows of a key should be spread over.
    """
    total = sizes.agg(F.sum(size).cast("double").alias("_total")).scalar()
    most = F.greatest(F.lit(float(task_rows)), F.lit(share) * total)
    parts = F.ceil(F.col(size).cast("double") / most).cast("int")
    return materialize(sizes.select(*_keys(key), parts.alias("_parts")).where("_parts > 1"), "hot")


def salted_attach(
    items: DataFrame, stats: DataFrame, key: str | Sequence[str], weight: str | None = None,
    how: str = "left", hot_share: float = HOT_SHARE, task_rows: int = TASK_ROWS,
    salt_by: Sequence[str] | None = None, hot: DataFrame | None = None,
) -> DataFrame:
    """Join that spreads the rows of each hot key over as many tasks as its size asks for.

    The list of hot keys (:func:`hot_keys`, found here unless given) is short
    by construction and broadcast. Only their statistics are repeated. The
    salt is a hash of the row, hence the same when a task is run again. Rows
    without a key match nothing and are spread over 1024 salts.
    """
    keys = _keys(key)
    if hot is None and weight is None:
        hot = hot_keys(items.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size")), keys, "_size", hot_share, task_rows)
    elif hot is None:
        hot = hot_keys(stats.select(*keys, weight), keys, weight, hot_share, task_rows)
    spread_over = salt_by or [c for c in items.columns if c not in keys] or keys
    no_key = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    parts = F.when(no_key, F.lit(1024)).otherwise(F.coalesce("_parts", F.lit(1)))
    salted = items.join(F.broadcast(hot), keys, "left").withColumn("_salt", F.pmod(F.hash(*spread_over), parts))
    copies = (
        (stats.drop(weight) if weight else stats)
        .join(F.broadcast(hot), keys, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)))
        .drop("_parts")
    )
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt", "_parts")


def outer_zero(a: DataFrame, b: DataFrame, key: str | Sequence[str], value: Any = 0) -> DataFrame:
    """Full outer join; a missing side counts as ``value``."""
    keys = _keys(key)
    joined = a.join(b, keys, "full_outer")
    return joined.fillna(value, subset=[c for c in joined.columns if c not in keys])


def lookup(
    df: DataFrame, dictionary: DataFrame, key: str | Sequence[str],
    on_missing: str = "null", default: Any = None, weight: str | None = None, store: bool = True,
) -> DataFrame:
    """Look values up by key.

    ``on_missing``: ``null`` leaves them null, ``default`` fills ``default``
    (a constant, or one for each column), ``error`` fails the job on the first
    key the dictionary lacks.
    """
    keys = _keys(key)
    values = [c for c in dictionary.columns if c not in keys and c != weight]
    marked = dictionary.withColumn("_found", F.lit(True))
    joined = attach(df, marked, keys, weight=weight, store=store)
    if on_missing == "error":
        name = F.concat_ws(", ", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys])
        complain = F.raise_error(F.concat(F.lit(f"no entry for {'/'.join(keys)} = "), name))
        first = values[0]
        checked = F.when(F.col("_found").isNull(), complain.cast(dictionary.schema[first].dataType)).otherwise(F.col(first))
        return joined.withColumn(first, checked).drop("_found")
    if on_missing == "default":
        fills = default if isinstance(default, Mapping) else dict.fromkeys(values, default)
        joined = joined.withColumns({
            c: F.when(F.col("_found").isNull(), F.lit(v)).otherwise(F.col(c)) for c, v in fills.items()
        })
    elif on_missing != "null":
        raise ValueError(f"unknown on_missing: {on_missing}")
    return joined.drop("_found")


def unique_by(df: DataFrame, key: str | Sequence[str], on_duplicate: str = "error") -> DataFrame:
    """One row per key: fail on a repeated key, or keep the smallest row.

    Rows with a null key are left out; a join can never reach them.
    """
    keys = _keys(key)
    rest = [c for c in df.columns if c not in keys]
    df = df.dropna(subset=keys)
    if not rest:
        return df.distinct()
    grouped = df.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_row"), F.count(F.lit(1)).alias("_n"))
    if on_duplicate == "error":
        name = F.concat_ws(", ", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys])
        bad = F.raise_error(F.concat(F.lit("repeated dimension key: "), name))
        row = F.when(F.col("_n") > 1, bad.cast(grouped.schema["_row"].dataType)).otherwise(F.col("_row"))
    elif on_duplicate == "first":
        row = F.col("_row")
    else:
        raise ValueError(f"unknown on_duplicate: {on_duplicate}")
    flat = grouped.select(*keys, row.alias("_row"))
    return flat.select(*[F.col(c) if c in keys else F.col(f"_row.`{c}`").alias(c) for c in df.columns])


def enrich(
    df: DataFrame, dimension: DataFrame, key: str | Sequence[str], on_duplicate: str = "error"
) -> DataFrame:
    """Left-join a dimension without multiplying rows."""
    return attach(df, unique_by(dimension, key, on_duplicate), key)


def pending(inputs: DataFrame, done: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Inputs that have no output yet."""
    return inputs.join(done.select(*_keys(key)), _keys(key), "left_anti")
