"""The whole feature table on a small listing market, and the driver contract."""

import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

import __spark_entry__ as contract
from tablewright.plans.listing import STEPS, Sources, train_and_test, wide_table

ITEM = (
    "item_id string, user_id string, region string, city string, parent_category_name string, category_name string, "
    "param_1 string, param_2 string, param_3 string, title string, description string, price double, "
    "item_seq_number int, activation_date date, user_type string, image string, image_top_1 double"
)
DAY = dt.date(2017, 3, 15)


def item(i, user, city, cat, title, desc, price, image=None):
    return (
        f"i{i}", user, "R1" if city != "Perm" else "R2", city, "P" + cat[-1], cat, "p1", None, "p3", title, desc, price, i,
        DAY, "Private", image, 1.0,
    )


@pytest.fixture
def sources(spark):
    train = [
        item(1, "u1", "Omsk", "c1", "red bike", "good bike, fast!", 10.0, "a.jpg"),
        item(2, "u1", "Omsk", "c1", "blue bike", None, None),
        item(3, "u2", "Perm", "c2", "old sofa", "bad sofa", 30.0, "b.jpg"),
        item(4, "u3", "Perm", "c2", None, "red red sofa of Omsk", 50.0),
    ]
    test = [item(5, "u1", "Omsk", "c1", "red sofa", "bike?", 20.0, "zz.jpg"), item(6, "u9", "Oslo", "c9", "new", "", 1.0)]
    active = [item(1, "u1", "Tver", "c2", "t", "d", 12.0), item(7, "u1", "Omsk", "c1", "t", "d", 14.0)]
    target = {"i1": 0.0, "i2": 0.5, "i3": 0.0, "i4": 1.0}

    def table(data):
        return spark.createDataFrame(data, ITEM).withColumn("image", F.regexp_replace("image", r"\.jpg$", ""))

    def frame(data, schema):
        return spark.createDataFrame(data, schema)

    known = F.create_map(*[F.lit(x) for kv in target.items() for x in kv])
    return Sources(
        train=table(train).withColumn("deal_probability", known[F.col("item_id")]), test=table(test), history=[table(active)],
        periods=frame([("i1", DAY, dt.date(2017, 3, 20)), ("i7", DAY, DAY), ("i7", DAY, dt.date(2017, 3, 18))], "item_id string, date_from date, date_to date"),
        population=frame([("Omsk", 1000), ("Omsk", 2000), ("Perm", 500)], "city string, population int"),
        geocode=frame([("Omsk R1", "x", 1.0, 2.0)], "region_city string, address string, latitude double, longitude double"),
        image_stats=frame([("a", 3.5)], "image string, blurriness double"),
        image_vectors=frame([("a", 0.1, 0.2)], "image string, image_feature_1 double, image_feature_2 double"),
        lexicon=frame([("good", 1), ("bad", -1)], "word string, polarity int"), entities=frame([("Omsk",)], "phrase string"),
        stems=frame([("sofas", "sofa")], "word string, stem string"), stop_words=["of"],
    )


def test_wide_table(spark, sources, join_mode):
    wide = wide_table(sources, STEPS, k=3, oversample=3, n_iter=2)
    train, test = train_and_test(wide)
    got = {r.item_id: r for r in wide.collect()}
    assert sorted(got) == [f"i{n}" for n in range(1, 7)]
    assert train.count() == 4 and "deal_probability" not in test.columns
    one, two, five, six = got["i1"], got["i2"], got["i5"], got["i6"]
    # Target statistics come from train only; an unseen category stays null.
    assert one.category_name_dp_mean == 0.25 and five.category_name_dp_mean == 0.25 and six.category_name_dp_mean is None
    # History keeps the active version of i1: city Tver, category c2, price 12.
    assert one.city_user_nunique == 2 and one.price_user_mean == pytest.approx((12 + 14 - 1 + 20) / 4)
    assert two.price == -1.0
    # u1 owns i1 (5 days, once) and i7 (0 + 3 days, twice), and two items without periods.
    assert (one.ave_days_up_user, one.avg_times_up_user, one.n_user_items) == (4.0, 1.5, 4)
    assert (six.ave_days_up_user, six.n_user_items) == (0.0, 1)
    assert one.population == 1000 and six.population is None and one.latitude == 1.0
    assert [got[i].region_city for i in ("i1", "i3", "i6")] == [0, 2, 1]
    assert (one.activation_date, one.activation_weekday) == (73, 2)
    assert (one.blurriness, one.image_feature_2) == (3.5, 0.2) and (five.blurriness, two.image_feature_1) == (-1.0, -1.0)
    assert one.CNT_Pos_Words_desc == 1 and got["i3"].CNT_Neg_Words_desc == 1 and got["i4"].CNT_Named_Entity_desc == 1
    assert one.CNT_exclamation_desc == 1 and five.CNT_question_desc == 1 and two.CNT_word_desc == 0
    assert one.RankingScore_title is not None and len([c for c in wide.columns if c.startswith("SVD_")]) == 9
    # Codes are ranks over both tables; null reads "nan".
    assert [got[i].city for i in ("i1", "i3", "i6")] == [0, 2, 1] and one.param_2 == 0 and one.user_type == 0


def test_contract_names_and_smoke(spark):
    queries, oracle = contract.queries(), contract.oracle_sql()
    assert set(oracle) <= set(queries) and len(queries) > 60
    df = contract.entry(spark)
    assert df.count() == 1500


@pytest.mark.parametrize("name", ["target_encode_sets", "holdout_split", "text_basic", "term_top_k", "vector_entropy"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "orders", "documents", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = contract.queries()[name](spark, sf)
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({contract.oracle_sql()[name]})").fetchall()
    assert sorted(rows(df), key=repr) == sorted(want, key=repr)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark):
    sf = "/root/testdata/sf0.001"
    queries = contract.queries()
    # Category statistics reach the items without a shuffle of the items.
    plan = plan_of(queries["hist_price_stats"](spark, sf))
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    # Only the columns a query needs are read, and filters reach the scan.
    plan = plan_of(queries["target_encode_folds"](spark, sf))
    assert "o_orderdate" not in plan.split("ReadSchema", 1)[1].split("\n", 1)[0]
    # The n-grams of a text are counted where the text is.
    assert plan_of(queries["ngram_counts"](spark, sf)).count("Exchange") == 0
