import math
import statistics

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tablewright.operators import encoding as e
from tablewright.operators import groups as g
from tablewright.operators import model


@pytest.fixture
def history(spark):
    data = [
        ("u1", "r1", "c1", "k1", "p1", 10.0), ("u1", "r1", "c2", "k1", "p1", 20.0), ("u2", None, "c1", "k2", "p1", -1.0),
        (None, "r9", "c9", "k1", "p2", 40.0),
    ]
    return spark.createDataFrame(
        data, "user_id string, region string, city string, category_name string, parent_category_name string, price double"
    )


def test_group_stats(spark, history):
    got = rows(g.group_stats(history, "user_id", g.USER_FEATURES, weight="n"), "user_id")
    u1, u2 = ({k: v for k, v in zip(g.group_stats(history, "user_id", g.USER_FEATURES, weight="n").columns, r)} for r in got)
    assert u1["region_user_nunique"] == 1 and u1["city_user_nunique"] == 2 and u1["n"] == 2
    assert u1["price_user_std"] == pytest.approx(statistics.stdev([10, 20]))
    # One row: no spread. A group without a region has none. The missing price counts as -1.
    assert u2["price_user_std"] == 0.0 and u2["region_user_nunique"] == 0 and u2["price_user_mean"] == -1.0
    ignored = g.group_stats(history, "user_id", [g.Feature("price", "mean", "m")], ignore={"price": -1.0})
    assert rows(ignored, "user_id") == [("u1", 15.0), ("u2", None)]


def test_history_features_keep_rows(spark, history, join_mode):
    items = spark.createDataFrame(
        [(1, "u1", "k1", "p1", 15.0), (2, "new", "k9", "p1", 5.0), (3, None, "k2", None, 1.0)],
        "item_id int, user_id string, category_name string, parent_category_name string, price double",
    )
    out = {r.item_id: r for r in g.history_features(items, history).collect()}
    assert len(out) == 3
    assert out[1].price_user_mean == 15.0 and out[2].price_user_mean is None and out[3].region_user_nunique is None
    assert out[3].price_ctg_std == 0.0 and out[3].price_diff_ctg_ratio is None


def test_group_feature(spark, history):
    items = spark.createDataFrame([(1, "u1"), (2, "zz")], "item_id int, user_id string")
    out = g.group_feature(items, history, "price", "user_id", "top", -5.0, "max")
    assert rows(out.select("item_id", "top"), "item_id") == [(1, 20.0), (2, None)]


def test_target_encode(spark, join_mode):
    train = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0), (None, 9.0)], "k string, y double")
    test = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, k string")
    with pytest.raises(Exception, match="no entry for k = c"):
        g.target_encode(train, test, ["k"], "y").collect()
    out = g.target_encode(train, test, ["k"], "y", on_missing="null")
    assert rows(out.select("id", "k_dp_mean", "k_dp_std"), "id") == [(1, 2.0, math.sqrt(2)), (2, 5.0, None), (3, None, None)]
    out = g.target_encode(train, test, ["k"], "y", stats=["mean"], on_missing="global")
    assert rows(out.select("id", "k_dp_mean"), "id") == [(1, 2.0), (2, 5.0), (3, 4.5)]


def test_target_sets_equal_single_keys(spark):
    train = spark.range(60).select(F.expr("'a' || id % 3 AS k"), F.expr("'b' || id % 4 AS m"), F.expr("id * 1.0D AS y"))
    sets = g.target_stats_sets(train, ["k", "m"], "y")
    for key in ("k", "m"):
        got = rows(sets.where(F.col("key_name") == key).select("key_value", "mean", "n"), "key_value")
        assert got == rows(train.groupBy(key).agg(F.avg("y"), F.count("*")), key)


def test_out_of_fold_uses_other_folds(spark):
    train = spark.range(200).select("id", F.expr("'k' || id % 3 AS k"), F.expr("id * 1.0D AS y"))
    got = {r.id: r.oof for r in g.target_encode_folds(train, "id", "k", "y", 4, seed=1, name="oof").collect()}
    from tablewright.operators.ordering import hash_fold

    data = train.withColumn("f", hash_fold("id", 4, 1)).collect()
    for r in data:
        others = [q.y for q in data if q.k == r.k and q.f != r.f]
        assert got[r.id] == pytest.approx(statistics.mean(others))


def test_listing_edges(spark, join_mode):
    periods = spark.createDataFrame(
        [("i1", "2017-01-01", "2017-01-01"), ("i2", "2017-01-01", "2017-01-04"), ("i2", "2017-01-05", "2017-01-06"),
         ("i3", "2017-01-01", None), ("orphan", "2017-01-01", "2017-01-11")],
        "item_id string, f string, t string",
    ).select("item_id", F.to_date("f").alias("date_from"), F.to_date("t").alias("date_to"))
    assert rows(g.listing_item_stats(periods), "item_id") == [("i1", 0.0, 1), ("i2", 4.0, 2), ("i3", 0.0, 0), ("orphan", 10.0, 1)]
    items = spark.createDataFrame([("i1", "u"), ("i2", "u"), ("i4", "u"), ("i5", "v"), ("i3", None)], "item_id string, user_id string")
    assert rows(g.listing_user_stats(periods, items), "user_id") == [("u", 2.0, 1.5, 3), ("v", None, None, 1)]
    out = g.listing_features(items, periods, items)
    assert rows(out.select("item_id", "ave_days_up_user", "n_user_items"), "item_id") == [
        ("i1", 2.0, 3), ("i2", 2.0, 3), ("i3", 0.0, None), ("i4", 2.0, 3), ("i5", 0.0, 1),
    ]


def test_profile(spark):
    df = spark.createDataFrame([(1, None), (2, "x")], "a int, b string")
    assert rows(g.profile(df), "column_name") == [("a", "int", 0, 2), ("b", "string", 1, 2)]


def test_label_encode_shares_one_dictionary(spark):
    train = spark.createDataFrame([("iPhone", 1), ("teXet", 2), (None, 3), ("Ягода", 4)], "p string, id int")
    test = spark.createDataFrame([("10", 5), ("iPhone", 6)], "p string, id int")
    coded, dictionary, names = e.label_encode({"train": train, "test": test})
    assert names == ["p"]
    assert [r.value for r in dictionary.orderBy("code").collect()] == ["10", "iPhone", "nan", "teXet", "Ягода"]
    assert rows(coded["train"].select("id", "p"), "id") == [(1, 1), (2, 3), (3, 2), (4, 4)]
    assert rows(coded["test"].select("id", "p"), "id") == [(5, 0), (6, 1)]
    unseen = e.apply_dictionary(spark.createDataFrame([("new",)], "p string"), dictionary, ["p"], unseen=-1)
    assert rows(unseen) == [(-1,)]


def test_cardinality_gate_is_exact_near_the_limit(spark):
    df = spark.range(3000).select(F.concat(F.lit("a"), F.col("id")).alias("at"), F.concat(F.lit("b"), F.col("id") % 2999).alias("below"))
    assert e.encodable([df]) == ["below"]
    coded, dictionary, names = e.label_encode({"x": df}, "strings")
    assert names == ["at", "below"] and dictionary.where("column = 'at'").count() == 3000
    assert dict(coded["x"].dtypes) == {"at": "bigint", "below": "bigint"}
    assert coded["x"].agg(F.max("at"), F.min("at"), F.count_distinct("at")).first()[:] == (2999, 0, 3000)


def test_dense_ids_are_ranks(spark, join_mode):
    a = spark.range(500).select((F.col("id") % 37).alias("u"))
    b = spark.createDataFrame([(1000,), (None,)], "u bigint")
    coded = e.dense_id({"a": a.withColumn("row", F.monotonically_increasing_id()), "b": b}, "u", "code")
    values = sorted({str(i % 37) for i in range(500)} | {"1000", "nan"})
    got = {(str(r.u) if r.u is not None else "nan"): r.code for d in coded.values() for r in d.collect()}
    assert got == {v: i for i, v in enumerate(values)}


def test_one_hot(spark):
    df = spark.createDataFrame([(1, "x"), (2, None), (3, "y")], "id int, c string")
    codes = e.label_dictionary([df], ["c"])
    values = e.dictionary_values(codes, ["c"])
    assert values == {"c": ["x", "y"]}
    assert rows(e.one_hot(df, ["c"], values), "id") == [(1, 1, 0), (2, 0, 0), (3, 0, 1)]
    two = df.withColumn("d", F.lit("z"))
    sparse = e.one_hot_sparse(two, ["c", "d"], e.label_dictionary([two], ["c", "d"]))
    # nan, x, y, then z.
    assert rows(sparse, "id") == [(1, [1, 3]), (2, [3]), (3, [2, 3])]


@pytest.mark.parametrize("digits", [1, 4])
def test_splits_are_exact(spark, digits):
    df = spark.range(101).withColumn("zero", F.col("id") % 3 == 0)
    test = model.holdout(df, "id", 0.15, seed=2, digits=digits).where("is_test")
    assert test.count() == 16  # ceil(15.15)
    again = model.holdout(df.repartition(7), "id", 0.15, seed=2).where("is_test")
    assert rows(test, "id") == rows(again, "id")
    strata = spark.createDataFrame([(i, 0.0 if i < 7 else 1.0) for i in range(12)], "id int, y double")
    split = model.stratified_split(strata, "id", F.col("y") != 0, 0.5, digits=digits)
    # 3.5 and 2.5 round to the even neighbour
    assert rows(split.groupBy("y").agg(F.count_if("is_test"), F.count("*")), "y") == [(0.0, 4, 7), (1.0, 2, 5)]
    assert model.holdout(df, "id", 0.0).where("is_test").count() == 0


def test_model_path(spark):
    df = spark.range(400).select(
        "id", (F.col("id") % 4).cast("int").alias("cat"), F.when(F.col("id") % 7 != 0, (F.col("id") % 10) * 1.0).alias("num"),
        ((F.col("id") % 4) * 10.0).alias("y"),
    )
    split = model.holdout(df, "id", 0.2, name="valid")
    matrix = model.design_matrix(split, ["cat", "num"], ["cat"])
    fitted = model.fit_gbt(matrix, "y", "valid", {"maxIter": 20, "maxDepth": 3, "stepSize": 0.3, "maxBins": 16})
    pairs = model.evaluate(model.predict(fitted, matrix, "id"), df, "id", target="y")
    assert model.rmse(pairs).first().rmse < 2.0
    top = model.importances(spark, fitted, ["cat", "num"]).collect()
    assert top[0].features == "cat" and sum(r.importance for r in top) == pytest.approx(1.0)
