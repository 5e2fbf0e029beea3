import pytest
from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions import clean_ratio, days_between, days_since, parse_date, ratio, weekday
from tablewright.operators import columns as c
from tablewright.operators import joins as j
from tablewright.operators import ordering as o
from tablewright.operators import sets as s
from tablewright.session import fresh_path, materialize, materialize_all
from tablewright.sources import tables as st
from tablewright.sources.images import image_key
from tablewright.streaming.resume import process_new_files


def test_cast_fill_and_fill(spark):
    df = spark.createDataFrame([("1", "3.5"), ("x", None), (None, "7")], "a string, b string")
    out = c.cast_fill(df, {"a": ("int", -1), "b": ("bigint", -1)})
    assert rows(out) == [(1, 3), (-1, -1), (-1, 7)]
    assert rows(c.fill(df, {"b": "NA"})) == [("1", "3.5"), ("x", "NA"), (None, "7")]


def test_name_patterns(spark):
    df = spark.createDataFrame([(1, None, None, "t")], "id int, image_1 double, image_2 double, title string")
    assert c.cols_like(df, "image") == ["image_1", "image_2"]
    assert c.drop_like(df, "image").columns == ["id", "title"]
    assert c.keep_like(df, ["image"], always=["id"]).columns == ["id", "image_1", "image_2"]
    assert rows(c.fill_like(df, "image", -1.0)) == [(1, -1.0, -1.0, "t")]
    split = c.vertical_split(df, "id", {"text": ["title"], "img": ["image_1"]})
    assert split["text"].columns == ["id", "title"] and split["img"].columns == ["id", "image_1"]


def test_concatenation(spark):
    df = spark.createDataFrame([("a", None, "c")], "x string, y string, z string")
    assert rows(df.select(c.concat_fill(["x", "y", "z"]), c.concat_key(["x", "y", "z"]))) == [("a  c", "a c")]


def test_dates(spark):
    df = spark.sql("SELECT timestamp_ntz'2017-03-13 12:00:00' AS a, timestamp_ntz'2017-03-15 00:00:00' AS b")
    assert rows(df.select(days_since("a"), weekday("a"), days_between("a", "b"), days_between("a", "b", whole_days=True))) == [
        (71, 0, 1.5, 2.0)
    ]
    bad = spark.createDataFrame([("2017-02-30",), ("2017-02-03",)], "d string").select(parse_date("d"))
    assert [r[0] is None for r in bad.collect()] == [True, False]


def test_ratios(spark):
    df = spark.createDataFrame([(1.0, 0.0), (0.0, 0.0), (1.0, 4.0)], "a double, b double")
    assert rows(df.select(ratio("a", "b"))) == [(None,), (None,), (0.25,)]
    odd = spark.createDataFrame([(float("inf"),), (float("nan"),), (None,), (0.5,)], "x double")
    assert rows(odd.select(clean_ratio("x"))) == [(1.0,), (0.0,), (0.0,), (0.5,)]


def test_union_and_split(spark):
    train = spark.createDataFrame([(1, 0.5)], "id int, y double")
    test = spark.createDataFrame([(2,)], "id int")
    both = s.tagged_union({"train": train, "test": test})
    assert rows(both, "id") == [(1, 0.5, "train"), (2, None, "test")]
    assert rows(s.untag(both, "test")) == [(2, None)]


def test_dedup_first_takes_the_first_source(spark):
    data = [(1, 2, "c"), (1, 0, "a"), (1, 1, "b"), (2, 3, "d"), (None, 1, "n"), (None, 0, "m")]
    df = spark.createDataFrame(data, "k int, prio int, v string")
    for parts in (1, 5):
        assert rows(s.dedup_first(df.repartition(parts), "k", ["prio"]), "k") == [(None, 0, "m"), (1, 0, "a"), (2, 3, "d")]


def test_distinct_keys(spark):
    a = spark.createDataFrame([("x", "r"), ("y", "r")], "city string, region string")
    b = spark.createDataFrame([("x", "r")], "city string, region string")
    assert rows(s.distinct_keys([a, b], c.concat_key(["city", "region"])), "key") == [("x r",), ("y r",)]


@pytest.mark.parametrize("n_rows,n", [(10, 3), (3, 5), (100, 7)])
def test_parts_and_chunks_match_windows(spark, n_rows, n):
    df = spark.range(n_rows).select(F.hash("id").alias("x"), "id").repartition(6)
    got = {r.id: r.part for r in o.assign_part(df, n, ["x", "id"]).collect()}
    want = {r.id: r.p for r in df.selectExpr("id", f"ntile({n}) OVER (ORDER BY x, id) AS p").collect()}
    assert got == want
    chunks = {r.id: r.chunk for r in o.chunk_id(df, 4, ["x", "id"]).collect()}
    want = {r.id: r.p for r in df.selectExpr("id", "(row_number() OVER (ORDER BY x, id) - 1) div 4 AS p").collect()}
    assert chunks == want


def test_attach_keeps_rows_in_both_modes(spark, join_mode):
    # Half of all rows share one key, some have none.
    items = spark.range(3000).select("id", F.expr("CASE WHEN id % 2 = 0 THEN 7 WHEN id % 11 = 0 THEN NULL ELSE id % 100 END AS k"))
    stats = items.where("k is not null and k < 90").groupBy("k").agg(F.sum("id").alias("total"), F.count("*").alias("n"))
    want = rows(items.join(stats.drop("n"), "k", "left").select("id", "k", "total"), "id")
    assert rows(j.attach(items, stats, "k", weight="n").select("id", "k", "total"), "id") == want
    assert rows(j.attach(items, stats.drop("n"), "k").select("id", "k", "total"), "id") == want
    inner = j.attach(items, stats, "k", weight="n", how="inner")
    assert inner.count() == items.where("k < 90").count()
    plan = inner._jdf.queryExecution().executedPlan().toString()
    if join_mode == "broadcast":
        assert "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan
    else:
        assert "_salt" in plan


def test_lookup_policies(spark, join_mode):
    df = spark.createDataFrame([(1, "a"), (2, "zz"), (3, None)], "id int, k string")
    codes = spark.createDataFrame([("a", 10.0), ("b", None)], "k string, v double")
    assert rows(j.lookup(df, codes, "k").select("id", "v"), "id") == [(1, 10.0), (2, None), (3, None)]
    filled = j.lookup(df, codes, "k", on_missing="default", default=0.0)
    assert rows(filled.select("id", "v"), "id") == [(1, 10.0), (2, 0.0), (3, 0.0)]
    with pytest.raises(Exception, match="no entry for k = zz"):
        j.lookup(df.where("id < 3"), codes, "k", on_missing="error").collect()
    assert rows(j.lookup(df.where("id = 1"), codes, "k", on_missing="error").select("v")) == [(10.0,)]
    with pytest.raises(ValueError):
        j.lookup(df, codes, "k", on_missing="guess")


def test_enrich_guards_against_fan_out(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, city string")
    dim = spark.createDataFrame([("a", 5), ("a", 4), (None, 1), (None, 2)], "city string, pop int")
    with pytest.raises(Exception, match="repeated dimension key: a"):
        j.enrich(df, dim, "city").collect()
    assert rows(j.enrich(df, dim, "city", on_duplicate="first").select("id", "pop"), "id") == [(1, 4), (2, None)]


def test_outer_zero_and_pending(spark):
    a = spark.createDataFrame([("x", 1.0)], "w string, f1 double")
    b = spark.createDataFrame([("y", 2.0)], "w string, f0 double")
    assert rows(j.outer_zero(a, b, "w"), "w") == [("x", 1.0, 0.0), ("y", 0.0, 2.0)]
    inputs = spark.range(5)
    assert rows(j.pending(inputs, inputs.where("id < 3"), "id"), "id") == [(3,), (4,)]


def test_csv_messy(spark):
    words = [(1, 'two\nlines, "quoted"'), (2, "nan"), (3, "null"), (4, "NA"), (5, ""), (6, None), (7, "  padded "), (8, "a\r\nb")]
    df = spark.createDataFrame(words, "id int, text string")
    path = st.write_csv(df, fresh_path(spark, "csv"), null_value=r"\N")
    assert rows(st.read_items(spark, path, df.schema, null_value=r"\N", multiline=True), "id") == words
    # With the plain setting empty and missing text are both missing.
    path = st.write_csv(df, fresh_path(spark, "csv"))
    assert rows(st.read_items(spark, path, df.schema, columns=["text"], multiline=True).where("text is null").agg(F.count("*"))) == [(2,)]


def test_split_malformed(spark):
    path = fresh_path(spark, "csv")
    lines = ["id,region,price", "1,North,10.0", "2,North,abc", "3,10,5.0", "4,,5.0"]
    spark.createDataFrame([(line,) for line in lines], "value string").coalesce(1).write.text(path)
    schema = T.StructType().add("id", T.IntegerType()).add("region", T.StringType()).add("price", T.DoubleType())
    raw = st.read_items(spark, path, schema, keep_malformed=True)
    good, bad = st.split_malformed(raw, {"shifted": ~F.col("region").rlike("^[0-9]+$")})
    assert rows(good, "id") == [(1, "North", 10.0), (4, None, 5.0)]
    assert rows(bad.select("id", "reject_reason"), "id") == [(2, "unparsable"), (3, "shifted")]


def test_tables_are_replaced_and_chunked(spark):
    root = fresh_path(spark, "root")
    for n in (50, 30):
        st.write_table(spark.range(n).coalesce(1), root, "t", max_rows_per_file=10)
    back = st.read_table(spark, root, "t", ["id"])
    assert back.count() == 30 and len(back.inputFiles()) == 3
    path = st.write_dictionary(spark.createDataFrame([("b", 1)], "value string, code int"), f"{root}/d")
    assert rows(st.read_dictionary(spark, path, "value string, code int")) == [("b", 1)]


def test_materialize_keeps_schema_and_rows(spark):
    df = spark.range(10).withColumn("a", F.array(F.col("id").cast("double")))
    kept = materialize_all({"one": df, "two": df.where("id < 3")})
    assert kept["one"].dtypes == df.dtypes and kept["two"].count() == 3
    assert "Project" not in materialize(df)._jdf.queryExecution().optimizedPlan().toString()


def test_image_key(spark):
    df = spark.createDataFrame([("a/b/c1.jpg",), ("c2.jpg?x=1#y",), ("c3",)], "p string")
    assert [r[0] for r in df.select(image_key("p")).collect()] == ["c1", "c2", "c3"]


def test_stream_handles_new_files_once(spark):
    source, target, progress = (fresh_path(spark, n) for n in ("in", "out", "progress"))
    for batch in range(2):
        spark.range(batch * 10, batch * 10 + 10).write.mode("append").parquet(source)
        process_new_files(spark, source, "id long", lambda df: df.withColumn("x", F.col("id") * 2), target, progress)
        process_new_files(spark, source, "id long", lambda df: df.withColumn("x", F.col("id") * 2), target, progress)
    out = spark.read.parquet(target)
    assert out.count() == 20 and rows(out.agg(F.sum("x"))) == [(380,)]
