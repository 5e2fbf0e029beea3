"""Group statistics: history features, target encoding, listing periods."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.dates import days_between
from tablewright.functions.numeric import deviation
from tablewright.operators.joins import attach, lookup
from tablewright.operators.ordering import hash_fold
from tablewright.session import materialize_all

STATS: dict[str, Callable[[Column], Column]] = {
    "mean": F.avg,
    "std": F.stddev_samp,
    "var": F.var_samp,
    "sum": lambda c: F.coalesce(F.sum(c), F.lit(0)),
    "count": F.count,
    "min": F.min,
    "max": F.max,
    "median": F.median,
    "nunique": F.count_distinct,
    "nunique_approx": F.approx_count_distinct,
}

WEIGHT = "_weight"


@dataclass(frozen=True)
class Feature:
    """``stat`` of ``field``, named ``name``; null results take ``fill``."""

    field: str
    stat: str
    name: str
    fill: Any = None


# The history features: names, statistics and fills are fixed values.
USER_FEATURES = (
    Feature("region", "nunique", "region_user_nunique", 0),
    Feature("city", "nunique", "city_user_nunique", 0),
    Feature("category_name", "nunique", "ctg_name_user_nunique", 0),
    Feature("parent_category_name", "nunique", "prtctg_nm_user_nunique", -1),
    Feature("price", "mean", "price_user_mean", -1.0),
    Feature("price", "std", "price_user_std", 0.0),
)
CATEGORY_FEATURES = (
    Feature("price", "mean", "price_ctg_mean", -1.0),
    Feature("price", "std", "price_ctg_std", 0.0),
)
PARENT_FEATURES = (
    Feature("price", "mean", "price_prtctg_mean", -1.0),
    Feature("price", "std", "price_prtctg_std", 0.0),
)


def group_stats(
    history: DataFrame, key: str, features: Sequence[Feature], weight: str | None = None,
    ignore: Mapping[str, Any] | None = None,
) -> DataFrame:
    """All features that share a key in one aggregate; a null key is no group.

    Distinct counts are taken from the distinct combinations of their fields,
    joined to the other statistics by key, so that history rows are not
    repeated once for each counted field. ``ignore`` names sentinel values
    (such as a missing price of -1) to leave out of the statistics. ``weight``
    adds the group's row count, for salted joins.
    """
    rows = history.where(F.col(key).isNotNull())
    for field, sentinel in (ignore or {}).items():
        rows = rows.withColumn(field, F.when(F.col(field) != F.lit(sentinel), F.col(field)))

    def finish(f: Feature) -> Column:
        c = STATS[f.stat](F.col(f.field))
        return (c if f.fill is None else F.coalesce(c, F.lit(f.fill))).alias(f.name)

    counted = [f for f in features if f.stat == "nunique"]
    others = [f for f in features if f.stat != "nunique"]
    size = [F.count(F.lit(1)).alias(weight)] if weight else []
    if not counted:
        return rows.groupBy(key).agg(*[finish(f) for f in others], *size)
    fields = list(dict.fromkeys(f.field for f in counted))
    combos = rows.groupBy(key, *fields).agg(F.count(F.lit(1)).alias("_rows"))
    n_rows = [F.sum("_rows").alias(weight)] if weight else []
    nunique = combos.groupBy(key).agg(*[finish(f) for f in counted], *n_rows)
    if not others:
        return nunique
    return rows.groupBy(key).agg(*[finish(f) for f in others]).join(nunique, key)


def group_feature(
    items: DataFrame, history: DataFrame, field: str, key: str, name: str, fill: Any, stat: str
) -> DataFrame:
    """One statistic of one field by one key, attached to items.

    The fill applies to the statistic, so a key without history stays null.
    """
    stats = group_stats(history, key, [Feature(field, stat, name, fill)], weight=WEIGHT)
    return attach(items, stats, key, weight=WEIGHT)


def history_features(items: DataFrame, history: DataFrame, ignore: Mapping[str, Any] | None = None) -> DataFrame:
    """User, category and parent-category history plus two price deviations."""
    stats = materialize_all({
        key: group_stats(history, key, features, weight=WEIGHT, ignore=ignore)
        for key, features in (
            ("user_id", USER_FEATURES), ("category_name", CATEGORY_FEATURES), ("parent_category_name", PARENT_FEATURES),
        )
    })
    out = items
    for key, table in stats.items():
        out = attach(out, table, key, weight=WEIGHT, store=False)
    return price_deviations(out)


def price_deviations(df: DataFrame) -> DataFrame:
    """Standardised deviation of the price from both category means."""
    return df.withColumns({
        "price_diff_ctg_ratio": deviation("price", "price_ctg_mean", "price_ctg_std"),
        "price_diff_prtctg_ratio": deviation("price", "price_prtctg_mean", "price_prtctg_std"),
    })


def group_zscore(df: DataFrame, x: str, key: str, history: DataFrame | None = None, name: str | None = None) -> DataFrame:
    """``(x - mean) / std`` of the group; null where the spread is 0."""
    stats = group_stats(
        df if history is None else history, key,
        [Feature(x, "mean", "_mean"), Feature(x, "std", "_std", 0.0)], weight=WEIGHT,
    )
    joined = attach(df, stats, key, weight=WEIGHT)
    return joined.withColumn(name or f"{x}_{key}_zscore", deviation(x, "_mean", "_std")).drop("_mean", "_std")


def target_stats(train: DataFrame, key: str, target: str, stats: Sequence[str] = ("mean", "std"), prefix: str = "dp") -> DataFrame:
    return group_stats(train, key, [Feature(target, s, f"{key}_{prefix}_{s}") for s in stats], weight=WEIGHT)


def target_encode(
    train: DataFrame, apply_to: DataFrame, keys: Sequence[str], target: str,
    stats: Sequence[str] = ("mean", "std"), prefix: str = "dp", on_missing: str = "error",
) -> DataFrame:
    """Statistics of the target by each key, fitted on ``train``.

    ``on_missing``: ``error`` fails on a key unseen in training, ``null``
    leaves it null, ``global`` takes the statistic over all training rows.
    """
    fitted = materialize_all({key: target_stats(train, key, target, stats, prefix) for key in keys})
    out = apply_to
    for key, table in fitted.items():
        out = lookup(out, table, key, "null" if on_missing == "global" else on_missing, weight=WEIGHT, store=False)
    if on_missing == "global":
        overall = {s: train.agg(STATS[s](F.col(target))).scalar() for s in stats}
        out = out.withColumns({
            f"{k}_{prefix}_{s}": F.coalesce(F.col(f"{k}_{prefix}_{s}"), overall[s]) for k in keys for s in stats
        })
    return out


def target_stats_sets(train: DataFrame, keys: Sequence[str], target: str, stats: Sequence[str] = ("mean", "std")) -> DataFrame:
    """The statistics of several keys from one pass, in long form.

    Rows are (key_name, key_value, <stats>, n), one for each value of each key.
    """
    sets = train.select(target, *keys).groupingSets([[k] for k in keys], *keys)
    which = F.grouping_id()
    full = 2 ** len(keys) - 1
    long = sets.agg(
        *[STATS[s](F.col(target)).alias(s) for s in stats],
        F.count(F.lit(1)).alias("n"),
        which.alias("_gid"),
    )
    name, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, k in enumerate(keys):
        bit = full - 2 ** (len(keys) - 1 - i)
        name = F.when(F.col("_gid") == bit, F.lit(k)).otherwise(name)
        value = F.when(F.col("_gid") == bit, F.col(k).cast("string")).otherwise(value)
    return long.select(name.alias("key_name"), value.alias("key_value"), *stats, "n").where("key_value is not null")


def target_encode_folds(
    train: DataFrame, row_key: str, key: str, target: str, n_folds: int = 5, seed: int = 0, name: str | None = None
) -> DataFrame:
    """Out-of-fold target mean: each row is encoded by the rows of other folds.

    Folds come from a hash of the row key. Sums by (key, fold) are small, so
    the total of the other folds is a subtraction and no row sees its own
    target. A key that occurs in one fold only has no mean: null.
    """
    name = name or f"{key}_dp_mean_oof"
    rows = train.withColumn("_fold", hash_fold(row_key, n_folds, seed))
    parts = rows.where(F.col(key).isNotNull()).groupBy(key, "_fold").agg(
        F.sum(F.col(target).cast("double")).alias("_s"), F.count(target).alias("_n"), F.count(F.lit(1)).alias(WEIGHT)
    )
    whole = parts.groupBy(key).agg(F.sum("_s").alias("_ts"), F.sum("_n").alias("_tn"))
    other = parts.join(whole, key).select(
        key, "_fold", WEIGHT,
        F.try_divide(F.col("_ts") - F.coalesce("_s", F.lit(0.0)), (F.col("_tn") - F.col("_n")).cast("double")).alias(name),
    )
    return attach(rows, other, [key, "_fold"], weight=WEIGHT).drop("_fold")


def listing_item_stats(periods: DataFrame, item: str = "item_id", start: str = "date_from", end: str = "date_to") -> DataFrame:
    """Days up and number of periods for each item."""
    days = periods.where(F.col(item).isNotNull()).select(item, days_between(start, end).alias("_days"))
    return days.groupBy(item).agg(
        F.coalesce(F.sum("_days"), F.lit(0.0)).alias("days_up_sum"),
        F.count("_days").alias("times_put_up"),
    )


def listing_user_stats(
    periods: DataFrame, items: DataFrame, item: str = "item_id", user: str = "user_id"
) -> DataFrame:
    """Averages over a user's items that have periods, and all their items.

    ``items`` holds one row for each item; an item without an owner counts for
    nobody.
    """
    owners = items.select(item, user).where(F.col(user).isNotNull())
    per_item = listing_item_stats(periods, item)
    averages = per_item.join(owners, item).groupBy(user).agg(
        F.avg("days_up_sum").alias("ave_days_up_user"),
        F.avg("times_put_up").alias("avg_times_up_user"),
    )
    counts = owners.groupBy(user).agg(F.count(item).alias("n_user_items"))
    return averages.join(counts, user, "full_outer")


def listing_features(items: DataFrame, periods: DataFrame, history: DataFrame) -> DataFrame:
    """Listing statistics attached to items; the two averages fall back to 0."""
    stats = listing_user_stats(periods, history).withColumn(WEIGHT, F.coalesce("n_user_items", F.lit(1)))
    return attach(
        items, stats, "user_id", fill={"ave_days_up_user": 0.0, "avg_times_up_user": 0.0}, weight=WEIGHT
    )


def profile(df: DataFrame) -> DataFrame:
    """Column name, type and null count, from one pass over the table."""
    nulls = df.agg(
        *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"_{i}") for i, c in enumerate(df.columns)],
        F.count(F.lit(1)).alias("_rows"),
    )
    rows = F.array(*[
        F.struct(
            F.lit(c).alias("column_name"), F.lit(t).alias("dtype"),
            F.col(f"_{i}").alias("null_count"), F.col("_rows").alias("row_count"),
        )
        for i, (c, t) in enumerate(df.dtypes)
    ])
    return nulls.select(F.inline(rows))
