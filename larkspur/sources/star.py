"""The star-schema tables as the pricing domain's relations.

A part is a product variant, a supplier a shop, a (part, supplier) pair a listing, and an order line one observation of
its offer: unit price rounded half up, observed when shipped. Orders are crawl runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: All queries are as of this moment: nothing reads the clock.
AS_OF = "1998-12-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp_ntz")


def half_up(x: Column) -> Column:
    """Rounds half towards plus infinity."""
    return F.floor(x + F.lit(0.5)).cast("bigint")


def percent(x: Column) -> Column:
    """A ratio as a percentage with two places, half up."""
    return F.floor(x * 10000 + F.lit(0.5)) / F.lit(100.0)


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """variant_id, shop_id, run_id, line, price, regular, observed_at, in_stock of each observation."""
    x = table(spark, sf_dir, "lineitem")
    return x.select(
        F.col("l_partkey").alias("variant_id"), F.col("l_suppkey").alias("shop_id"), F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("line"),
        half_up(F.col("l_extendedprice") * (1 - F.col("l_discount")) / F.col("l_quantity")).alias("price"),
        half_up(F.col("l_extendedprice") / F.col("l_quantity")).alias("regular"),
        F.col("l_shipdate").alias("observed_at"), (F.col("l_linestatus") == "O").alias("in_stock"),
    )


def latest_offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest observation of each listing; ties go to the later run, then the later line.

    A maximum of structs combines in the map tasks, so the shuffle carries a row for each listing and task at most.
    """
    last = observations(spark, sf_dir).groupBy("variant_id", "shop_id").agg(F.max(F.struct("observed_at", "run_id", "line", "price", "regular", "in_stock")).alias("o"))
    return last.select("variant_id", "shop_id", "o.*")


OFFERS_SQL = """
obs AS (
  SELECT l_partkey AS variant_id, l_suppkey AS shop_id, l_orderkey AS run_id, l_linenumber AS line,
    CAST(floor(l_extendedprice * (1 - l_discount) / l_quantity + 0.5) AS BIGINT) AS price,
    CAST(floor(l_extendedprice / l_quantity + 0.5) AS BIGINT) AS regular,
    l_shipdate AS observed_at, l_linestatus = 'O' AS in_stock
  FROM lineitem),
latest AS (
  SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY variant_id, shop_id ORDER BY observed_at DESC, run_id DESC, line DESC) AS k FROM obs) WHERE k = 1)
"""
