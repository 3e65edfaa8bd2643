"""Sharded forms of the test tables, and the same in SQL.

Geographic: a customer's or supplier's shard is its nation, its island the
nation's region. By hash: an order's shard is its customer key modulo 64, with
islands 0 (40 shards), 1 (16), 2 (8) and an empty island 3.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shardkit.functions.names import shard_name

ORDER_SHARDS = 64


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def as_int(col: Column) -> Column:
    return col.cast("int")


def cents(col: str) -> Column:
    """Money as whole cents, so that sums do not depend on their order."""
    return F.floor(F.col(col) * 100 + 0.5)


def labels(df: DataFrame, number: Column) -> DataFrame:
    return df.select(shard_name(number).alias("shard"))


def orders(spark: SparkSession, sf: str) -> DataFrame:
    shard_no = as_int(F.col("o_custkey") % ORDER_SHARDS)
    island = F.when(F.col("shard_no") < 40, 0).when(F.col("shard_no") < 56, 1).otherwise(2)
    return (
        table(spark, sf, "orders")
        .withColumn("shard_no", shard_no)
        .withColumn("shard", shard_name(F.col("shard_no")))
        .withColumn("island_no", island)
    )


ORDERS = """
ord AS (
  SELECT *, CASE WHEN shard_no < 40 THEN 0 WHEN shard_no < 56 THEN 1 ELSE 2 END AS island_no,
         'sh' || lpad(CAST(shard_no AS VARCHAR), 4, '0') AS shard
  FROM (SELECT *, CAST(o_custkey % 64 AS INTEGER) AS shard_no FROM orders)
)"""


def order_islands(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n,) for n in range(4)], "island_no int")


def nations(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("shard_no"), F.col("n_regionkey").alias("island_no")
    )


def customers(spark: SparkSession, sf: str) -> DataFrame:
    """Customers under the columns they share with suppliers, and their market segment."""
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        F.col("c_acctbal").alias("acctbal"),
        F.col("c_mktsegment").alias("mktsegment"),
        F.col("c_nationkey").alias("shard_no"),
        shard_name(F.col("c_nationkey")).alias("shard"),
    )


def suppliers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("id"),
        F.col("s_name").alias("name"),
        F.col("s_acctbal").alias("acctbal"),
        F.col("s_nationkey").alias("shard_no"),
        shard_name(F.col("s_nationkey")).alias("shard"),
    )


def sql_label(number: str) -> str:
    return f"('sh' || lpad(CAST({number} AS VARCHAR), 4, '0'))"


PARTIES = f"""
cust AS (
  SELECT c_custkey AS id, c_name AS name, c_acctbal AS acctbal, c_mktsegment AS mktsegment,
         c_nationkey AS shard_no, {sql_label('c_nationkey')} AS shard FROM customer
),
supp AS (
  SELECT s_suppkey AS id, s_name AS name, s_acctbal AS acctbal,
         s_nationkey AS shard_no, {sql_label('s_nationkey')} AS shard FROM supplier
)"""
