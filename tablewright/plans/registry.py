"""Named queries over the given tables, each with its SQL counterpart."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.operators.joins import attach

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``."""

    def register(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def r(c, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column; the order of a sum differs between engines."""
    return df.select(*[r(F.col(f"`{c}`"), digits).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


class Tables:
    """The parquet tables of one folder, and their roles as listings."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def texts(self) -> DataFrame:
        return self.documents.select("doc_id", "text")

    @cached_property
    def places(self) -> DataFrame:
        """city (nation) and region of each of the 25 nations."""
        joined = self.nation.join(F.broadcast(self.region), F.col("n_regionkey") == F.col("r_regionkey"), "left")
        return joined.select("n_nationkey", F.col("n_name").alias("city"), F.col("r_name").alias("region"))

    @cached_property
    def items(self) -> DataFrame:
        """Orders as listings of users who live in a city."""
        homes = self.customer.join(F.broadcast(self.places), F.col("c_nationkey") == F.col("n_nationkey"), "left")
        owners = homes.select(F.col("c_custkey").alias("user_id"), "region", "city")
        orders = self.orders.select(
            F.col("o_orderkey").alias("item_id"), F.col("o_custkey").alias("user_id"),
            F.col("o_orderstatus").alias("parent_category_name"), F.col("o_orderpriority").alias("category_name"),
            F.col("o_totalprice").alias("price"), F.col("o_orderdate").cast("date").alias("activation_date"),
            (F.col("o_orderkey") % 4 != 0).alias("is_train"),
        )
        return attach(orders, owners, "user_id", store=False)

    @cached_property
    def periods(self) -> DataFrame:
        """Line items as listing periods of their order."""
        lines = self.lineitem.select(F.col("l_orderkey").alias("item_id"), "l_shipdate")
        dates = self.orders.select(F.col("o_orderkey").alias("item_id"), "o_orderdate")
        joined = attach(lines, dates, "item_id", how="inner", store=False, even=True)
        return joined.select(
            "item_id", F.least("o_orderdate", "l_shipdate").alias("date_from"),
            F.greatest("o_orderdate", "l_shipdate").alias("date_to"),
        )


ITEMS = """items AS (
  SELECT o_orderkey AS item_id, o_custkey AS user_id, o_orderstatus AS parent_category_name,
         o_orderpriority AS category_name, o_totalprice AS price, CAST(o_orderdate AS DATE) AS activation_date,
         o_orderkey % 4 <> 0 AS is_train, r_name AS region, n_name AS city
  FROM orders LEFT JOIN customer ON c_custkey = o_custkey
  LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey)"""

PERIODS = """periods AS (
  SELECT l_orderkey AS item_id, least(o_orderdate, l_shipdate) AS date_from,
         greatest(o_orderdate, l_shipdate) AS date_to
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"""
