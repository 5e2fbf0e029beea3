"""Queries: projection, filling, unions, keys, ordering, splits, round trips."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright.functions import dates
from tablewright.operators import columns as c
from tablewright.operators import encoding as e
from tablewright.operators import groups as g
from tablewright.operators import joins as j
from tablewright.operators import model
from tablewright.operators import ordering as o
from tablewright.operators import sets as s
from tablewright.operators.spelling import enrich_near
from tablewright.plans.registry import ITEMS, Tables, query
from tablewright.session import fresh_path, materialize
from tablewright.sources import images as im
from tablewright.sources import tables as st
from tablewright.sources.records import read_records
from tablewright.streaming.resume import process_new_files


@query("vertical_split", f"""WITH {ITEMS}
SELECT item_id, user_id, category_name, parent_category_name, activation_date, price, region, city FROM items""")
def vertical_split(t: Tables):
    parts = c.vertical_split(t.items, "item_id", {
        "basic": ["user_id", "category_name", "parent_category_name", "activation_date"],
        "target": ["price"],
        "place": ["region", "city"],
    })
    return j.assemble(parts["basic"], [parts["target"], parts["place"]], "item_id")


@query("pattern_project", "SELECT o_orderkey, o_orderstatus, o_orderpriority, o_orderdate FROM orders")
def pattern_project(t: Tables):
    return c.keep_like(t.orders, ["order"], always=["o_orderkey"])


@query("pattern_fill", """SELECT d.doc_id, coalesce(quality, -1) AS label_quality, coalesce(toxic, -1) AS label_toxic,
nullif(lang, 'en') AS lang FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def pattern_fill(t: Tables):
    labels = t.labels.withColumnsRenamed({"quality": "label_quality", "toxic": "label_toxic"})
    docs = t.documents.select("doc_id", F.nullif("lang", F.lit("en")).alias("lang"))
    return c.fill_like(docs.join(labels, "doc_id", "left"), "label_", -1)


@query("cast_fill", """SELECT event_id, coalesce(CAST(floor(nullif(value, 6.55)) AS BIGINT), -1) AS price,
coalesce(TRY_CAST(regexp_extract(props, '[0-9]+') AS INTEGER), 0) AS k,
coalesce(TRY_CAST(event_type AS INTEGER), -9) AS code FROM events""")
def cast_fill(t: Tables):
    raw = t.events.select(
        "event_id", F.floor(F.nullif("value", F.lit(6.55))).cast("double").alias("price"),
        F.regexp_extract("props", "[0-9]+", 0).alias("k"), F.col("event_type").alias("code"),
    )
    return c.cast_fill(raw, {"price": ("bigint", -1), "k": ("int", 0), "code": ("int", -9)})


@query("date_features", """SELECT event_id, CAST(strftime(ts, '%Y-%m-%d') AS DATE) AS event_date,
CAST(date_diff('day', DATE '2017-01-01', CAST(ts AS DATE)) AS INTEGER) AS days,
CAST(isodow(ts) - 1 AS INTEGER) AS weekday FROM events""")
def date_features(t: Tables):
    return t.events.select(
        "event_id", dates.parse_date(F.date_format("ts", "yyyy-MM-dd")).alias("event_date"),
        dates.days_since("ts").alias("days"), dates.weekday("ts").alias("weekday"),
    )


@query("tagged_union", """SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice END AS target,
CASE WHEN o_orderkey % 4 <> 0 THEN 'train' ELSE 'test' END AS split FROM orders""")
def tagged_union(t: Tables):
    orders = t.orders.select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("target"))
    both = s.tagged_union({
        "train": orders.where("o_orderkey % 4 <> 0"), "test": orders.where("o_orderkey % 4 = 0").drop("target"),
    })
    return s.tagged_union({tag: s.untag(both, tag) for tag in ("train", "test")})


LINE_COLUMNS = (
    "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
    "l_shipdate",
)


@query("dedup_precedence", f"""WITH u AS (
SELECT *, 1 AS priority FROM lineitem WHERE l_linenumber <= 4
UNION ALL SELECT *, 0 AS priority FROM lineitem WHERE l_linenumber >= 3),
w AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
      ORDER BY priority, {', '.join(LINE_COLUMNS)}) AS rn FROM u)
SELECT l_orderkey, l_linenumber, {', '.join(LINE_COLUMNS)}, priority FROM w WHERE rn = 1""")
def dedup_precedence(t: Tables):
    both = s.tagged_union({
        "1": t.lineitem.where("l_linenumber <= 4"), "0": t.lineitem.where("l_linenumber >= 3"),
    }, tag="priority").withColumn("priority", F.col("priority").cast("int"))
    return s.dedup_first(both, ["l_orderkey", "l_linenumber"], ["priority", *LINE_COLUMNS])


@query("distinct_geo_keys", """SELECT DISTINCT n_name || ' ' || r_name AS city_region FROM
(SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier)
JOIN nation ON n_nationkey = k JOIN region ON r_regionkey = n_regionkey""")
def distinct_geo_keys(t: Tables):
    users = t.customer.select(F.col("c_nationkey").alias("n_nationkey"))
    sellers = t.supplier.select(F.col("s_nationkey").alias("n_nationkey"))
    placed = [df.join(F.broadcast(t.places), "n_nationkey") for df in (users, sellers)]
    return s.distinct_keys(placed, c.concat_key(["city", "region"]), "city_region")


@query("geo_enrich", f"""WITH {ITEMS},
pop AS (SELECT n_name AS city, 1000 * (n_nationkey + 1) AS population FROM nation WHERE n_nationkey % 5 <> 0),
geo AS (SELECT n_name || ' ' || r_name AS region_city, n_nationkey * 1.5e0 - 20 AS latitude, n_nationkey * 3e0 - 30 AS longitude
        FROM nation JOIN region ON r_regionkey = n_regionkey)
SELECT item_id, i.city || ' ' || i.region AS region_city, population, latitude, longitude FROM items i
LEFT JOIN pop ON pop.city = i.city LEFT JOIN geo ON geo.region_city = i.city || ' ' || i.region""")
def geo_enrich(t: Tables):
    population = t.nation.where("n_nationkey % 5 <> 0").select(
        F.col("n_name").alias("city"), (1000 * (F.col("n_nationkey") + 1)).alias("population")
    )
    geocode = t.places.select(
        c.concat_key(["city", "region"]).alias("region_city"),
        (F.col("n_nationkey") * F.lit(1.5) - 20).alias("latitude"), (F.col("n_nationkey") * F.lit(3.0) - 30).alias("longitude"),
    )
    keyed = t.items.select("item_id", "city", c.concat_key(["city", "region"]).alias("region_city"))
    placed = j.enrich(j.enrich(keyed, population, "city"), geocode, "region_city")
    return placed.select("item_id", "region_city", "population", "latitude", "longitude")


@query("geo_enrich_spelling", f"""WITH {ITEMS},
pop AS (SELECT n_name AS city, 1000 * (n_nationkey + 1) AS population FROM nation WHERE n_nationkey % 5 <> 0),
spelled AS (SELECT item_id, CASE item_id % 4 WHEN 1 THEN left(city, 1) || substr(city, 3) WHEN 2 THEN 'Q' || substr(city, 2)
  WHEN 3 THEN substr(city, 2, 1) || left(city, 1) || substr(city, 3) ELSE city END AS city FROM items),
near AS (SELECT s.city, p.city AS city_match, levenshtein(s.city, p.city) AS d, population FROM (SELECT DISTINCT city FROM spelled) s, pop p),
best AS (SELECT * FROM near WHERE d = 0 OR (d <= 2 AND least(length(city), length(city_match)) >= 4)
  QUALIFY row_number() OVER (PARTITION BY city ORDER BY d, city_match) = 1)
SELECT item_id, s.city, city_match, CAST(d AS INTEGER) AS city_distance, population FROM spelled s LEFT JOIN best USING (city)""")
def geo_enrich_spelling(t: Tables):
    """Population by city although three of four cities are spelled with a letter lost, wrong or swapped."""
    population = t.nation.where("n_nationkey % 5 <> 0").select(
        F.col("n_name").alias("city"), (1000 * (F.col("n_nationkey") + 1)).alias("population")
    )
    city, kind = F.col("city"), F.col("item_id") % 4
    spelled = F.when(kind == 1, F.concat(F.substring(city, 1, 1), F.substr(city, F.lit(3)))).when(
        kind == 2, F.concat(F.lit("Q"), F.substr(city, F.lit(2)))
    ).when(kind == 3, F.concat(F.substring(city, 2, 1), F.substring(city, 1, 1), F.substr(city, F.lit(3)))).otherwise(city)
    return enrich_near(t.items.select("item_id", spelled.alias("city")), population, "city")


@query("label_extend", f"""WITH {ITEMS},
long AS (SELECT item_id % 5 = 0 AND region < 'C' AS early, unnest([{{'c': 'city', 'v': city}}, {{'c': 'category_name', 'v': category_name}}, {{'c': 'day', 'v': CAST(activation_date AS VARCHAR)}}]) AS s FROM items),
seen AS (SELECT s.c AS c, s.v AS v, bool_or(early) AS early FROM long GROUP BY 1, 2)
SELECT c AS "column", v AS value, CAST(row_number() OVER (PARTITION BY c ORDER BY NOT early, v) - 1 AS INTEGER) AS code, early AS known FROM seen""")
def label_extend(t: Tables):
    """Codes of a few items, then of all: those known before keep theirs."""
    rows = t.items.withColumn("day", F.col("activation_date").cast("string"))
    names = ["city", "category_name", "day"]
    first = materialize(e.label_dictionary([rows.where("item_id % 5 = 0 AND region < 'C'")], names), "codes")
    later = e.extend_dictionary(first, [rows], names)
    return later.join(first.select("column", "value", F.lit(True).alias("known")), ["column", "value"], "left").fillna(False)


@query("key_normalise", r"""WITH named AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url
  ELSE regexp_replace(url, '[?#].*$', '') || '.jpg' || CASE WHEN page_id % 3 = 1 THEN '?size=2' ELSE '' END END AS url FROM pages)
SELECT page_id, regexp_replace(string_split(regexp_replace(url, '[?#].*$', ''), '/')[-1], '\.jpg$', '') AS image FROM named""")
def key_normalise(t: Tables):
    bare = F.regexp_replace("url", r"[?#].*$", "")
    picture = F.concat(bare, F.lit(".jpg"), F.when(F.col("page_id") % 3 == 1, F.lit("?size=2")).otherwise(F.lit("")))
    named = t.pages.withColumn("url", F.when(F.col("page_id") % 3 == 0, F.col("url")).otherwise(picture))
    return named.select("page_id", im.image_key("url").alias("image"))


@query("param_concat", """SELECT p_partkey, p_brand || ' ' || coalesce(nullif(p_type, 'ECONOMY'), '') || ' ' || p_name
AS param_all, concat_ws(' ', p_brand, nullif(p_type, 'ECONOMY')) AS param_key FROM part""")
def param_concat(t: Tables):
    params = t.part.withColumn("p_type", F.nullif("p_type", F.lit("ECONOMY")))
    return params.select(
        "p_partkey", c.concat_fill(["p_brand", "p_type", "p_name"]).alias("param_all"),
        c.concat_key(["p_brand", "p_type"]).alias("param_key"),
    )


@query("strict_lookup", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, s_name
FROM lineitem LEFT JOIN supplier ON s_suppkey = l_suppkey""")
def strict_lookup(t: Tables):
    names = t.supplier.select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return j.lookup(lines, names, "l_suppkey", on_missing="error")


@query("outer_zero", """SELECT coalesce(c.k, s.k) AS nation, coalesce(customers, 0) AS customers, coalesce(suppliers, 0) AS suppliers
FROM (SELECT c_nationkey AS k, count(*) AS customers FROM customer WHERE c_acctbal > 0 GROUP BY 1) c
FULL JOIN (SELECT s_nationkey AS k, count(*) AS suppliers FROM supplier GROUP BY 1) s ON c.k = s.k""")
def outer_zero(t: Tables):
    users = t.customer.where("c_acctbal > 0").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("customers"))
    sellers = t.supplier.groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("suppliers"))
    return j.outer_zero(users, sellers, "nation")


@query("profile_nulls", """WITH d AS (SELECT d.*, quality, toxic FROM documents d LEFT JOIN labels USING (doc_id))
SELECT 'doc_id' AS column_name, 'bigint' AS dtype, count(*) FILTER (doc_id IS NULL) AS null_count, count(*) AS row_count FROM d
UNION ALL SELECT 'text', 'string', count(*) FILTER (text IS NULL), count(*) FROM d
UNION ALL SELECT 'lang', 'string', count(*) FILTER (lang IS NULL), count(*) FROM d
UNION ALL SELECT 'source', 'string', count(*) FILTER (source IS NULL), count(*) FROM d
UNION ALL SELECT 'n_chars', 'bigint', count(*) FILTER (n_chars IS NULL), count(*) FROM d
UNION ALL SELECT 'quality', 'int', count(*) FILTER (quality IS NULL), count(*) FROM d
UNION ALL SELECT 'toxic', 'int', count(*) FILTER (toxic IS NULL), count(*) FROM d""")
def profile_nulls(t: Tables):
    return g.profile(t.documents.join(t.labels, "doc_id", "left"))


# Order and splits


@query("ntile_parts", "SELECT o_orderkey, CAST(ntile(7) OVER (ORDER BY o_totalprice, o_orderkey) AS INTEGER) AS part FROM orders")
def ntile_parts(t: Tables):
    return o.assign_part(t.orders.select("o_orderkey", "o_totalprice"), 7, ["o_totalprice", "o_orderkey"]).drop("o_totalprice")


@query("chunk_ids", """SELECT o_orderkey,
CAST((row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1) // 1000 AS BIGINT) AS chunk FROM orders""")
def chunk_ids(t: Tables):
    return o.chunk_id(t.orders.select("o_orderkey", "o_orderdate"), 1000, ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("shuffled_order", """SELECT event_id, row_number() OVER (ORDER BY md5('5:' || CAST(event_id AS VARCHAR)), event_id) - 1 AS position
FROM events""")
def shuffled_order(t: Tables):
    keyed = t.events.select("event_id").withColumn("_h", o.hash_order("event_id", 5))
    return o.global_index(keyed, ["_h", "event_id"], "position").drop("_h")


@query("pending_items", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def pending_items(t: Tables):
    return j.pending(t.documents.select("doc_id", "source"), t.labels, "doc_id")


@query("pending_stream", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, o_totalprice FROM orders")
def pending_stream(t: Tables):
    target, progress = fresh_path(t.spark, "stream-out"), fresh_path(t.spark, "stream-progress")

    def narrow(df):
        return df.select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"), "o_totalprice")

    for _ in range(2):  # the second run finds nothing new
        process_new_files(t.spark, t.dir, t.orders.schema, narrow, target, progress, files="orders.parquet")
    return t.spark.read.parquet(target)


@query("holdout_split", """WITH w AS (SELECT o_orderkey, count(*) OVER () AS n,
row_number() OVER (ORDER BY md5('7:' || CAST(o_orderkey AS VARCHAR)), o_orderkey) AS rn FROM orders)
SELECT o_orderkey, rn <= ceil(CAST(0.15 AS DOUBLE) * n) AS is_test FROM w""")
def holdout_split(t: Tables):
    return model.holdout(t.orders.select("o_orderkey"), "o_orderkey", 0.15, seed=7)


@query("stratified_split", """WITH w AS (SELECT o_orderkey, o_orderstatus, count(*) OVER (PARTITION BY o_orderstatus) AS n,
row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('9:' || CAST(o_orderkey AS VARCHAR)), o_orderkey) AS rn FROM orders)
SELECT o_orderkey, o_orderstatus, rn <= round_even(CAST(0.2 AS DOUBLE) * n, 0) AS is_test FROM w""")
def stratified_split(t: Tables):
    orders = t.orders.select("o_orderkey", "o_orderstatus")
    return model.stratified_split(orders, "o_orderkey", F.col("o_orderstatus"), 0.2, seed=9)


@query("stratified_split_zero", """WITH w AS (SELECT doc_id, quality, count(*) OVER (PARTITION BY quality <> 0) AS n,
row_number() OVER (PARTITION BY quality <> 0 ORDER BY md5('1:' || CAST(doc_id AS VARCHAR)), doc_id) AS rn FROM labels)
SELECT doc_id, quality, rn <= round_even(CAST(0.2 AS DOUBLE) * n, 0) AS is_test FROM w""")
def stratified_split_zero(t: Tables):
    return model.stratified_split(t.labels.drop("toxic"), "doc_id", F.col("quality") != 0, 0.2, seed=1)


@query("stratified_split_null", """WITH b AS (SELECT d.doc_id, quality FROM documents d LEFT JOIN labels USING (doc_id)),
w AS (SELECT doc_id, quality, count(*) OVER (PARTITION BY quality) AS n,
row_number() OVER (PARTITION BY quality ORDER BY md5('3:' || CAST(doc_id AS VARCHAR)), doc_id) AS rn FROM b)
SELECT doc_id, quality, rn <= round_even(CAST(0.2 AS DOUBLE) * n, 0) AS is_test FROM w""")
def stratified_split_null(t: Tables):
    """Documents without a label are a stratum of their own."""
    labelled = t.documents.select("doc_id").join(t.labels.select("doc_id", "quality"), "doc_id", "left")
    return model.stratified_split(labelled, "doc_id", F.col("quality"), 0.2, seed=3, digits=1, most=50)


# Encoding

PART_CODES = ("p_name", "p_brand", "p_type")


def _parts(t: Tables):
    parts = t.part.select("p_partkey", "p_name", "p_brand", F.nullif("p_type", F.lit("PROMO")).alias("p_type"))
    return {"train": parts.where("p_partkey % 4 <> 0"), "test": parts.where("p_partkey % 4 = 0")}


PARTS = "parts AS (SELECT p_partkey, p_name, p_brand, coalesce(nullif(p_type, 'PROMO'), 'nan') AS p_type FROM part)"


@query("label_encode", f"""WITH {PARTS}
SELECT p_partkey, {', '.join(f'CAST(dense_rank() OVER (ORDER BY {k}) - 1 AS INTEGER) AS {k}' for k in PART_CODES)} FROM parts""")
def label_encode(t: Tables):
    coded, _, _ = e.label_encode(_parts(t))
    return coded["train"].unionByName(coded["test"])


@query("label_dictionary", f"WITH {PARTS} " + " UNION ALL ".join(
    f"""SELECT '{k}' AS "column", {k} AS value, CAST(row_number() OVER (ORDER BY {k}) - 1 AS INTEGER) AS code
    FROM (SELECT DISTINCT {k} FROM parts)""" for k in PART_CODES))
def label_dictionary(t: Tables):
    _, dictionary, _ = e.label_encode(_parts(t))
    path = st.write_dictionary(dictionary, fresh_path(t.spark, "dictionary"))
    return st.read_dictionary(t.spark, path, "`column` string, value string, code int")


@query("label_apply", """WITH d AS (SELECT p_name, CAST(row_number() OVER (ORDER BY p_name) - 1 AS INTEGER) AS code
FROM (SELECT DISTINCT p_name FROM part WHERE p_size <= 3))
SELECT p_partkey, coalesce(code, -1) AS p_name FROM part LEFT JOIN d USING (p_name)""")
def label_apply(t: Tables):
    dictionary = materialize(e.label_dictionary([t.part.where("p_size <= 3").select("p_name")], ["p_name"]), "codes")
    return e.apply_dictionary(t.part.select("p_partkey", "p_name"), dictionary, ["p_name"], unseen=-1)


@query("dense_user_id", """SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY CAST(o_custkey AS VARCHAR)) - 1 AS BIGINT) AS user_id
FROM orders""")
def dense_user_id(t: Tables):
    orders = t.orders.select("o_orderkey", F.col("o_custkey").alias("user_id"))
    coded = e.dense_id({"train": orders.where("o_orderkey % 4 <> 0"), "test": orders.where("o_orderkey % 4 = 0")}, "user_id")
    return coded["train"].unionByName(coded["test"])


PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
STATUSES = ("F", "O", "P")


@query("one_hot", f"""SELECT o_orderkey,
{', '.join(f"CAST(o_orderstatus = '{v}' AS INTEGER) AS o_orderstatus_{v}" for v in STATUSES)},
{', '.join(f"CAST(coalesce(nullif(o_orderpriority, '5-LOW') = '{v}', FALSE) AS INTEGER) AS " + f'"o_orderpriority_{v}"' for v in PRIORITIES[:-1])}
FROM orders""")
def one_hot(t: Tables):
    orders = t.orders.select(
        "o_orderkey", "o_orderstatus", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("o_orderpriority")
    )
    columns = ["o_orderstatus", "o_orderpriority"]
    return e.one_hot(orders, columns, e.dictionary_values(e.label_dictionary([orders], columns), columns))


@query("one_hot_sparse", """WITH o AS (SELECT o_orderkey, o_orderstatus, nullif(o_orderpriority, '5-LOW') AS p FROM orders),
s AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT o_orderstatus AS v FROM o)),
q AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT coalesce(p, 'nan') AS v FROM o))
SELECT o_orderkey, s.code || CASE WHEN p IS NULL THEN '' ELSE ',' || (q.code + (SELECT count(*) FROM s)) END AS active
FROM o JOIN s ON s.v = o_orderstatus JOIN q ON q.v = coalesce(p, 'nan')""")
def one_hot_sparse(t: Tables):
    orders = t.orders.select(
        "o_orderkey", "o_orderstatus", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("o_orderpriority")
    )
    columns = ["o_orderstatus", "o_orderpriority"]
    coded = e.one_hot_sparse(orders, columns, materialize(e.label_dictionary([orders], columns), "codes"))
    return coded.select("o_orderkey", F.array_join("active", ",").alias("active"))


@query("label_encode_strings", """SELECT doc_id, dense_rank() OVER (ORDER BY text) - 1 AS text, dense_rank() OVER (ORDER BY lang) - 1 AS lang,
dense_rank() OVER (ORDER BY coalesce(nullif(source, 'src3'), 'nan')) - 1 AS source, n_chars FROM documents""")
def label_encode_strings(t: Tables):
    """Every string column is coded, also one with a value of its own in each row."""
    docs = t.documents.withColumn("source", F.nullif("source", F.lit("src3")))
    coded, _, _ = e.label_encode({"all": docs}, "strings")
    return coded["all"]


# Round trips through storage


@query("csv_roundtrip_scan", """SELECT doc_id, CAST(length(text) AS INTEGER) AS n, md5(text) AS text_md5, nullif(lang, 'de') AS lang,
CASE WHEN lang = 'fr' THEN 'NA' WHEN lang = 'es' THEN '' ELSE 'null' END AS word FROM documents""")
def csv_roundtrip_scan(t: Tables):
    word = F.when(F.col("lang") == "fr", "NA").when(F.col("lang") == "es", "").otherwise("null")
    docs = t.documents.select("doc_id", "text", F.nullif("lang", F.lit("de")).alias("lang"), word.alias("word"))
    path = st.write_csv(docs, fresh_path(t.spark, "csv"), null_value=r"\N", max_rows_per_file=100_000)
    back = st.read_items(t.spark, path, docs.schema, ["doc_id", "text", "lang", "word"], null_value=r"\N", multiline=True)
    return back.select("doc_id", F.length("text").alias("n"), F.md5(F.col("text").cast("binary")).alias("text_md5"), "lang", "word")


@query("csv_ranges_scan", """SELECT doc_id, CAST(length(text) AS INTEGER) AS n, md5(text) AS text_md5, nullif(lang, 'de') AS lang FROM documents""")
def csv_ranges_scan(t: Tables):
    """The same from byte ranges of the files, although texts hold line breaks."""
    docs = t.documents.select("doc_id", "text", F.nullif("lang", F.lit("de")).alias("lang"))
    path = st.write_csv(docs, fresh_path(t.spark, "csv"), null_value=r"\N")
    back = read_records(t.spark, path, docs.schema, null_value=r"\N")
    return back.select("doc_id", F.length("text").alias("n"), F.md5(F.col("text").cast("binary")).alias("text_md5"), "lang")


@query("quarantine_rows", """SELECT o_orderkey, CASE WHEN o_orderkey % 97 = 0 THEN 'user type in category'
WHEN o_orderkey % 101 = 0 THEN 'unparsable' END AS reject_reason FROM orders""")
def quarantine_rows(t: Tables):
    shifted = F.col("o_orderkey") % 97 == 0
    broken = (F.col("o_orderkey") % 101 == 0) & ~shifted
    raw = t.orders.select(
        F.col("o_orderkey").cast("string").alias("o_orderkey"),
        F.when(shifted, "Private").otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(broken, "12,5 euro").otherwise(F.col("o_totalprice").cast("string")).alias("o_totalprice"),
    )
    path = st.write_csv(raw, fresh_path(t.spark, "csv"))
    back = st.read_items(
        t.spark, path, t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice").schema, keep_malformed=True
    )
    rules = {"user type in category": F.col("o_orderstatus").isin(*STATUSES)}
    good, bad = st.split_malformed(back, rules)
    return good.select("o_orderkey", F.lit(None).cast("string").alias("reject_reason")).unionByName(
        bad.select("o_orderkey", "reject_reason")
    )


@query("table_roundtrip", "SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice FROM orders")
def table_roundtrip(t: Tables):
    root = fresh_path(t.spark, "tables")
    st.write_table(t.orders, root, "orders")
    st.write_table(t.orders, root, "orders")  # replaces
    return st.read_table(t.spark, root, "orders", ["o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"])


@query("chunked_roundtrip", "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem")
def chunked_roundtrip(t: Tables):
    root = fresh_path(t.spark, "tables")
    lines = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    st.write_table(lines, root, "lines", max_rows_per_file=1_000_000)
    return st.read_table(t.spark, root, "lines")
