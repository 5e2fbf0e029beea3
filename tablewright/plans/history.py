"""Queries: target encoding, user and category history, listing periods."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.operators import groups as g
from tablewright.operators import model
from tablewright.operators.joins import attach
from tablewright.operators.states import StateStore
from tablewright.plans.registry import ITEMS, PERIODS, Tables, query, r, rounded
from tablewright.session import fresh_path

ENCODED = ("region", "category_name", "parent_category_name")

TARGET_ENCODE = f"""WITH {ITEMS},
{','.join(f'''
e_{k} AS (SELECT {k}, avg(price) AS m, stddev_samp(price) AS s FROM items WHERE is_train AND {k} IS NOT NULL GROUP BY {k})''' for k in ENCODED)}
SELECT item_id, {', '.join(f'round(e_{k}.m, 4) AS {k}_dp_mean, round(e_{k}.s, 4) AS {k}_dp_std' for k in ENCODED)}
FROM items {' '.join(f'LEFT JOIN e_{k} ON e_{k}.{k} = items.{k}' for k in ENCODED)}"""


@query("target_encode", TARGET_ENCODE)
def target_encode(t: Tables):
    items = t.items
    coded = g.target_encode(items.where("is_train"), items, ENCODED, "price")
    return rounded(coded.select("item_id", *[f"{k}_dp_{s}" for k in ENCODED for s in ("mean", "std")]), 4)


@query("target_encode_sets", f"""WITH {ITEMS}
SELECT CASE WHEN grouping(region) = 0 THEN 'region' WHEN grouping(category_name) = 0 THEN 'category_name'
            ELSE 'parent_category_name' END AS key_name,
       coalesce(region, category_name, parent_category_name) AS key_value,
       round(avg(price), 4) AS mean, round(stddev_samp(price), 4) AS std, count(*) AS n
FROM items WHERE is_train
GROUP BY GROUPING SETS ((region), (category_name), (parent_category_name))
HAVING coalesce(region, category_name, parent_category_name) IS NOT NULL""")
def target_encode_sets(t: Tables):
    return rounded(g.target_stats_sets(t.items.where("is_train"), ENCODED, "price"), 4)


FOLD = "CAST('0x' || substr(md5('3:' || CAST(item_id AS VARCHAR)), 1, 8) AS BIGINT) % 5"


@query("target_encode_folds", f"""WITH {ITEMS},
f AS (SELECT *, {FOLD} AS fold FROM items WHERE is_train),
p AS (SELECT category_name, fold, sum(price) AS s, count(price) AS n FROM f GROUP BY ALL),
w AS (SELECT category_name, sum(s) AS ts, sum(n) AS tn FROM p GROUP BY ALL)
SELECT item_id, round((ts - s) / nullif(tn - n, 0), 4) AS category_name_dp_mean_oof
FROM f JOIN p USING (category_name, fold) JOIN w USING (category_name)""")
def target_encode_folds(t: Tables):
    train = t.items.where("is_train").select("item_id", "category_name", "price")
    out = g.target_encode_folds(train, "item_id", "category_name", "price", n_folds=5, seed=3)
    return rounded(out.select("item_id", "category_name_dp_mean_oof"), 4)


@query("rmse", f"""WITH {ITEMS},
e AS (SELECT category_name, avg(price) AS m FROM items WHERE is_train GROUP BY category_name)
SELECT round(sqrt(avg((m - price) * (m - price))), 4) AS rmse, count(*) AS n
FROM items JOIN e USING (category_name) WHERE NOT is_train""")
def rmse(t: Tables):
    items = t.items.select("item_id", "category_name", "price", "is_train")
    train, test = items.where("is_train"), items.where("not is_train")
    scored = g.target_encode(train, test, ["category_name"], "price", stats=["mean"])
    pairs = model.evaluate(
        scored.withColumnRenamed("category_name_dp_mean", "prediction"), test, "item_id", target="price"
    )
    return rounded(model.rmse(pairs), 4)


BASELINE_RMSE = f"""WITH {ITEMS},
ranked AS (SELECT *, row_number() OVER (ORDER BY md5('11:' || CAST(item_id AS VARCHAR)), item_id) AS rn,
                  count(*) OVER () AS n FROM items),
s AS (SELECT *, rn <= ceil(CAST(0.15 AS DOUBLE) * n) AS is_test FROM ranked),
e AS (SELECT user_id, avg(price) AS m FROM s WHERE NOT is_test GROUP BY user_id),
o AS (SELECT avg(price) AS am FROM s WHERE NOT is_test)
SELECT round(sqrt(avg((coalesce(m, am) - price) ** 2)), 4) AS rmse, count(*) AS n
FROM s LEFT JOIN e USING (user_id), o WHERE is_test"""


@query("baseline_rmse", BASELINE_RMSE)
def baseline_rmse(t: Tables):
    items = t.orders.select(
        F.col("o_orderkey").alias("item_id"), F.col("o_custkey").alias("user_id"), F.col("o_totalprice").alias("price")
    )
    split = model.holdout(items, "item_id", 0.15, seed=11)
    train, test = split.where("not is_test"), split.where("is_test")
    scored = g.target_encode(train, test, ["user_id"], "price", stats=["mean"], on_missing="global")
    return rounded(model.rmse(scored, "user_id_dp_mean", "price"), 4)


HIST_USER = f"""WITH {ITEMS},
u AS (SELECT user_id, avg(price) AS m, stddev_samp(price) AS s, count(*) AS n FROM items
      WHERE user_id IS NOT NULL GROUP BY user_id)
SELECT item_id, round(coalesce(m, -1), 6) AS price_user_mean, round(coalesce(s, 0), 4) AS price_user_std
FROM items LEFT JOIN u USING (user_id)"""


@query("hist_user_stats", HIST_USER)
def hist_user_stats(t: Tables):
    items = t.items.select("item_id", "user_id", "price")
    features = [f for f in g.USER_FEATURES if f.field == "price"]
    stats = g.group_stats(items, "user_id", features, weight=g.WEIGHT)
    out = attach(items, stats, "user_id", weight=g.WEIGHT)
    # Means of a few prices in cents end in ties at four places.
    return out.select("item_id", r("price_user_mean", 6).alias("price_user_mean"), r("price_user_std", 4).alias("price_user_std"))


@query("hist_user_nunique", f"""WITH {ITEMS},
u AS (SELECT user_id, count(DISTINCT region) AS a, count(DISTINCT city) AS b, count(DISTINCT category_name) AS c,
             count(DISTINCT parent_category_name) AS d FROM items GROUP BY user_id)
SELECT item_id, a AS region_user_nunique, b AS city_user_nunique, c AS ctg_name_user_nunique,
       d AS prtctg_nm_user_nunique FROM items LEFT JOIN u USING (user_id)""")
def hist_user_nunique(t: Tables):
    items = t.items
    features = [f for f in g.USER_FEATURES if f.stat == "nunique"]
    stats = g.group_stats(items, "user_id", features, weight=g.WEIGHT)
    out = attach(items.select("item_id", "user_id"), stats, "user_id", weight=g.WEIGHT)
    return out.drop("user_id")


HIST_PRICE = f"""WITH {ITEMS},
c AS (SELECT category_name, avg(price) AS m, stddev_samp(price) AS s FROM items GROUP BY category_name),
p AS (SELECT parent_category_name, avg(price) AS pm, stddev_samp(price) AS ps FROM items GROUP BY parent_category_name)
SELECT item_id, round(coalesce(m, -1), 4) AS price_ctg_mean, round(coalesce(s, 0), 4) AS price_ctg_std,
       round(coalesce(pm, -1), 4) AS price_prtctg_mean, round(coalesce(ps, 0), 4) AS price_prtctg_std
FROM items LEFT JOIN c USING (category_name) LEFT JOIN p USING (parent_category_name)"""


@query("hist_price_stats", HIST_PRICE)
def hist_price_stats(t: Tables):
    out = t.items.select("item_id", "category_name", "parent_category_name", "price")
    items = out
    for key, features in (("category_name", g.CATEGORY_FEATURES), ("parent_category_name", g.PARENT_FEATURES)):
        out = attach(out, g.group_stats(items, key, features, weight=g.WEIGHT), key, weight=g.WEIGHT)
    return rounded(out.drop("category_name", "parent_category_name", "price"), 4)


@query("price_group_zscore", f"""WITH {ITEMS},
c AS (SELECT category_name, avg(price) AS m, stddev_samp(price) AS s FROM items GROUP BY category_name)
SELECT item_id, round((price - m) / nullif(s, 0), 6) AS price_diff_ctg_ratio
FROM items LEFT JOIN c USING (category_name)""")
def price_group_zscore(t: Tables):
    items = t.items.select("item_id", "category_name", "price")
    out = g.group_zscore(items, "price", "category_name", name="price_diff_ctg_ratio")
    return rounded(out.select("item_id", "price_diff_ctg_ratio"))


@query("event_user_stats", """WITH u AS (
SELECT user_id, count(DISTINCT event_type) AS event_type_user_nunique, avg(value) AS m, stddev_samp(value) AS s,
       sum(value) AS t, min(value) AS lo, max(value) AS hi, count(value) AS n FROM events GROUP BY user_id)
SELECT event_id, event_type_user_nunique, round(m, 6) AS value_user_mean, round(coalesce(s, 0), 6) AS value_user_std,
       round(t, 4) AS value_user_sum, lo AS value_user_min, hi AS value_user_max, n AS value_user_count
FROM events LEFT JOIN u USING (user_id)""")
def event_user_stats(t: Tables):
    events = t.events.select("event_id", "user_id", "event_type", "value")
    features = [
        g.Feature("event_type", "nunique", "event_type_user_nunique", 0),
        g.Feature("value", "mean", "value_user_mean"), g.Feature("value", "std", "value_user_std", 0.0),
        g.Feature("value", "sum", "value_user_sum"), g.Feature("value", "min", "value_user_min"),
        g.Feature("value", "max", "value_user_max"), g.Feature("value", "count", "value_user_count", 0),
    ]
    stats = g.group_stats(events, "user_id", features, weight=g.WEIGHT)
    out = attach(events.select("event_id", "user_id"), stats, "user_id", weight=g.WEIGHT).drop("user_id")
    return out.withColumns({
        "value_user_mean": r("value_user_mean"), "value_user_std": r("value_user_std"), "value_user_sum": r("value_user_sum", 4),
    })


DAYS = "(epoch_us(CAST(date_to AS TIMESTAMP)) - epoch_us(CAST(date_from AS TIMESTAMP))) / 86400000000.0"
PER_ITEM = f"per_item AS (SELECT item_id, sum({DAYS}) AS days_up_sum, count(*) AS times_put_up FROM periods GROUP BY item_id)"
PER_USER = """per_user AS (
  SELECT coalesce(a.user_id, c.user_id) AS user_id, ave_days_up_user, avg_times_up_user, n_user_items FROM
  (SELECT user_id, avg(days_up_sum) AS ave_days_up_user, avg(times_put_up) AS avg_times_up_user
   FROM per_item JOIN items USING (item_id) GROUP BY user_id) a
  FULL JOIN (SELECT user_id, count(item_id) AS n_user_items FROM items GROUP BY user_id) c ON a.user_id = c.user_id)"""


@query("listing_item_stats", f"""WITH {PERIODS}, {PER_ITEM}
SELECT item_id, round(days_up_sum, 6) AS days_up_sum, times_put_up FROM per_item""")
def listing_item_stats(t: Tables):
    return rounded(g.listing_item_stats(t.periods))


@query("listing_user_stats", f"""WITH {ITEMS}, {PERIODS}, {PER_ITEM}, {PER_USER}
SELECT user_id, round(ave_days_up_user, 6) AS ave_days_up_user, round(avg_times_up_user, 6) AS avg_times_up_user,
       n_user_items FROM per_user""")
def listing_user_stats(t: Tables):
    items = t.orders.select(F.col("o_orderkey").alias("item_id"), F.col("o_custkey").alias("user_id"))
    return rounded(g.listing_user_stats(t.periods, items))


@query("listing_features", f"""WITH {ITEMS}, {PERIODS}, {PER_ITEM}, {PER_USER}
SELECT item_id, round(coalesce(ave_days_up_user, 0), 6) AS ave_days_up_user,
       round(coalesce(avg_times_up_user, 0), 6) AS avg_times_up_user, n_user_items
FROM items LEFT JOIN per_user USING (user_id)""")
def listing_features(t: Tables):
    items = t.orders.select(F.col("o_orderkey").alias("item_id"), F.col("o_custkey").alias("user_id"))
    return rounded(g.listing_features(items, t.periods, items).drop("user_id"))


@query("hist_by_batches", f"""WITH {ITEMS}
SELECT user_id, count(DISTINCT region) AS region_user_nunique, count(DISTINCT city) AS city_user_nunique,
  count(DISTINCT category_name) AS ctg_name_user_nunique, count(DISTINCT parent_category_name) AS prtctg_nm_user_nunique,
  round(avg(price), 6) AS price_user_mean, round(coalesce(stddev_samp(price), 0), 4) AS price_user_std FROM items GROUP BY user_id""")
def hist_by_batches(t: Tables):
    """User history from a state that four batches of days were merged into, one of them twice."""
    fields = list(dict.fromkeys(f.field for f in g.USER_FEATURES if f.stat == "nunique"))
    store = StateStore(t.spark, fresh_path(t.spark, "history"), "user_id", ["price"], fields)
    batch = F.pmod(F.dayofyear("activation_date"), F.lit(4))
    for i in (2, 0, 3, 2, 1):
        store.add(f"batch {i}", t.items.where(batch == i))
    out = store.features(g.USER_FEATURES)
    return out.withColumns({"price_user_mean": r("price_user_mean", 6), "price_user_std": r("price_user_std", 4)})
