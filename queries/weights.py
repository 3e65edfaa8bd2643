"""Weights of shards, and reports of them."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from queries.fixtures import (
    ORDERS, PARTIES, as_int, cents, customers, labels, nations, order_islands, orders, sql_label, suppliers, table,
)
from shardkit.functions import numbers
from shardkit.functions.names import shard_name
from shardkit.operators import report
from shardkit.operators import weights as wts
from shardkit.session import scratch_path
from shardkit.sources import layout


def shard_weights(spark: SparkSession, sf: str) -> DataFrame:
    """Weight, revenue and share of every shard by island; lines are aggregated before they meet their suppliers."""
    net = F.floor(F.col("l_extendedprice") * 100 * (1 - F.col("l_discount")) + 0.5)
    lines = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("lines"), F.sum(net).alias("revenue")
    )
    home = suppliers(spark, sf).join(nations(spark, sf), "shard_no").select("id", "shard_no", "island_no")
    per_shard = lines.join(home, lines.l_suppkey == home.id).groupBy("island_no", "shard_no").agg(
        F.sum("lines").alias("weight"), F.sum("revenue").alias("revenue_cents")
    )
    shares = report.shard_share(per_shard)
    return shares.select("island_no", "shard_no", shard_name(F.col("shard_no")).alias("shard"), "weight",
                         "revenue_cents", "ratio", "share")


def _texts(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    documents = table(spark, sf, "documents").select("text", "lang", "source", "n_chars", "doc_id")
    pages = table(spark, sf, "pages").select("url", "html", "page_id")
    return {
        "documents": documents.withColumn("shard", shard_name(F.col("doc_id") % 4)),
        "pages": pages.withColumn("shard", shard_name(F.col("page_id") % 3)),
    }


def default_weights(spark: SparkSession, sf: str) -> DataFrame:
    active = labels(table(spark, sf, "labels"), F.col("doc_id") % 5)
    weights = wts.default_weights(wts.table_sizes(_texts(spark, sf)), active)
    return weights.select("shard", F.col("Size").alias("size"), F.col("Tables").alias("tables"))


def table_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return wts.table_sizes(_texts(spark, sf)).withColumnRenamed("table", "tab")


def stored_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Sizes of the stored files, whose bytes SQL cannot know: which shards and tables have any."""
    paths = {"orders": scratch_path(spark, "orders"), "customer": scratch_path(spark, "customer")}
    places = spark.range(64).select(as_int(F.col("id")).alias("shard_no"), as_int(F.col("id") % 4).alias("island_no"))
    layout.write_placed(orders(spark, sf), places, paths["orders"])
    layout.write_placed(customers(spark, sf), places, paths["customer"])
    sizes = wts.stored_sizes(spark, paths)
    return sizes.select("shard_no", F.col("table").alias("tab"), (F.col("bytes") > 0).alias("has_bytes"))


def _order_aggs() -> list:
    return [
        F.count(F.lit(1)).alias("Orders"),
        F.sum(cents("o_totalprice")).alias("Cents"),
        F.max("o_orderkey").alias("LastKey"),
        F.min("o_orderpriority").alias("Priority"),
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("Price"),
    ]


def custom_weights(spark: SparkSession, sf: str) -> DataFrame:
    active = labels(table(spark, sf, "customer"), F.col("c_custkey") % 80)
    weights = wts.custom_weights(orders(spark, sf), _order_aggs()[:3], active)
    return weights.select(
        "shard", F.col("Orders").alias("orders"), F.col("Cents").alias("cents"), F.col("LastKey").alias("last_key")
    )


def parse_weight(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey").cast("string")
    text = (
        F.when(F.col("c_custkey") % 7 == 0, F.concat(key, F.lit(" MB")))
        .when(F.col("c_custkey") % 7 == 1, F.concat(key, F.lit(".5  MB \n")))
        .when(F.col("c_custkey") % 7 == 2, key)
        .when(F.col("c_custkey") % 7 == 3, F.lit("0 MB"))
        .when(F.col("c_custkey") % 7 == 4, F.concat(F.lit("-"), key, F.lit(" MB")))
        .when(F.col("c_custkey") % 7 == 5, F.col("c_mktsegment"))
    )
    parsed = numbers.parse_weight(text)
    return table(spark, sf, "customer").select("c_custkey", parsed["weight"].alias("weight"), parsed["unit"].alias("unit"))


def _order_weights(spark: SparkSession, sf: str) -> DataFrame:
    """Weight rows of the orders' shards; the unit is the first letter of the lowest priority."""
    unit = F.concat(F.count(F.lit(1)).cast("string"), F.lit(" "), F.min("o_orderstatus")).alias("Orders")
    keys = ["island_no", "shard_no"]
    df = orders(spark, sf)
    active = df.select(*keys).distinct()
    high = F.count_if(F.col("o_totalprice") > 499000).alias("High")
    measured = wts.custom_weights(df, [unit, *_order_aggs()[1:], high], active, keys)
    return wts.weight_rows(measured, keys)


def other_measures(spark: SparkSession, sf: str) -> DataFrame:
    rows = _order_weights(spark, sf)
    return rows.select("island_no", "shard_no", F.explode("other").alias("measure", "value"))


def drop_isolated_shard0(spark: SparkSession, sf: str) -> DataFrame:
    home = F.when(F.col("shard_no") == 0, 9).when(F.col("shard_no") == 7, 8).otherwise(F.col("shard_no") % 5)
    rows = customers(spark, sf).groupBy(home.alias("island_no"), "shard_no").agg(F.count(F.lit(1)).alias("weight"))
    return wts.drop_isolated_shard0(rows)


def island_weights(spark: SparkSession, sf: str) -> DataFrame:
    island = F.when(F.col("shard_no") == 0, 9).otherwise(F.col("shard_no") % 5).alias("island_no")
    label = F.when(F.col("shard_no") == 7, F.lit("misc")).otherwise(F.col("shard")).alias("shard")
    rows = customers(spark, sf).select(island, label, "acctbal")
    # shards of orders from 25 on have no customers
    active = orders(spark, sf).select(island, label)
    aggs = [F.count(F.lit(1)).alias("Rows"), F.sum(cents("acctbal")).alias("Cents")]
    found = wts.island_weights(rows, aggs, active, include_isolated_shard0=False)
    return found.select("island_no", "shard_no", "weight", "unit", F.col("other.Cents").alias("cents"))


def shard_share(spark: SparkSession, sf: str) -> DataFrame:
    shares = report.shard_share(_order_weights(spark, sf))
    return shares.select("island_no", "shard_no", "weight", "ratio", "share")


def island_totals(spark: SparkSession, sf: str) -> DataFrame:
    return report.island_totals(_order_weights(spark, sf))


def other_totals(spark: SparkSession, sf: str) -> DataFrame:
    return report.other_totals(_order_weights(spark, sf))


def grand_total(spark: SparkSession, sf: str) -> DataFrame:
    return report.grand_total(_order_weights(spark, sf), order_islands(spark))


def totals(spark: SparkSession, sf: str) -> DataFrame:
    return report.totals(_order_weights(spark, sf), order_islands(spark))


QUERIES = {
    f.__name__: f
    for f in (
        shard_weights, default_weights, table_sizes, stored_sizes, custom_weights, parse_weight, other_measures,
        drop_isolated_shard0, island_weights, shard_share, island_totals, other_totals, grand_total, totals,
    )
}

# tenths of a percentage from its exact binary value, halves up
_SHARE = """
CASE WHEN total = 0 THEN '-' ELSE
  (SELECT CAST(t // 10 AS VARCHAR) || '.' || CAST(t % 10 AS VARCHAR) || '%' FROM (
    SELECT CASE WHEN weight / total * 100 < 1
           THEN (CAST(weight / total * 100 * 144115188075855872 AS HUGEINT) * 20 + 144115188075855872) // 288230376151711744
           ELSE (CAST(weight / total * 100 * 4503599627370496 AS HUGEINT) * 20 + 4503599627370496) // 9007199254740992
           END AS t)) END"""

_TEXTS = """
sizes AS (
  SELECT doc_id % 4 AS n, 'documents' AS tab,
         sum(strlen(text) + coalesce(strlen(lang), 0) + coalesce(strlen(source), 0)) + 8 * count(n_chars) + 8 * count(doc_id) AS bytes
  FROM documents GROUP BY 1
  UNION ALL
  SELECT page_id % 3, 'pages', sum(strlen(url) + strlen(html)) + 8 * count(page_id) FROM pages GROUP BY 1)"""

_WEIGHTS = f"""
{ORDERS}, w AS (
  SELECT island_no, shard_no, count(*) AS weight, min(o_orderstatus) AS unit,
         CAST(sum(floor(o_totalprice * 100 + 0.5)) AS BIGINT) AS cents, max(o_orderkey) AS last_key,
         min(o_orderpriority) AS priority, sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS price,
         count(*) FILTER (o_totalprice > 499000) AS high
  FROM ord GROUP BY 1, 2),
m AS (
  SELECT island_no, shard_no, unnest(['Cents', 'LastKey', 'Priority', 'Price', 'High']) AS measure,
         unnest([CAST(cents AS VARCHAR), CAST(last_key AS VARCHAR), priority,
                 regexp_replace(CAST(price AS VARCHAR), '\\.?0+$', ''), CAST(high AS VARCHAR)]) AS value
  FROM w)"""

ORACLES = {
    "shard_weights": f"""
        WITH w AS (
          SELECT n_regionkey AS island_no, s_nationkey AS shard_no, {sql_label('s_nationkey')} AS shard, count(*) AS weight,
                 CAST(sum(floor(l_extendedprice * 100 * (1 - l_discount) + 0.5)) AS BIGINT) AS revenue_cents
          FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey GROUP BY 1, 2),
        t AS (SELECT *, CAST(sum(weight) OVER (PARTITION BY island_no) AS BIGINT) AS total FROM w)
        SELECT island_no, shard_no, shard, weight, revenue_cents, weight / total AS ratio, {_SHARE} AS share FROM t""",
    "default_weights": f"""
        WITH {_TEXTS}, mb AS (
          SELECT n, CAST(CAST(round(sum(bytes) / 1024 / 1024) AS BIGINT) AS VARCHAR) || ' MB' AS size, count(DISTINCT tab) AS tables
          FROM sizes GROUP BY 1)
        SELECT {sql_label('a.n')} AS shard, size, coalesce(tables, 0) AS tables
        FROM (SELECT DISTINCT doc_id % 5 AS n FROM labels) a LEFT JOIN mb USING (n)""",
    "table_sizes": f"WITH {_TEXTS} SELECT {sql_label('n')} AS shard, tab, CAST(bytes AS BIGINT) AS bytes FROM sizes",
    "stored_sizes": f"""
        WITH {ORDERS}
        SELECT DISTINCT shard_no, 'orders' AS tab, true AS has_bytes FROM ord
        UNION ALL SELECT DISTINCT c_nationkey, 'customer', true FROM customer""",
    "custom_weights": f"""
        WITH {ORDERS}, found AS (
          SELECT shard, count(*) AS orders, CAST(sum(floor(o_totalprice * 100 + 0.5)) AS BIGINT) AS cents,
                 max(o_orderkey) AS last_key
          FROM ord GROUP BY 1)
        SELECT a.shard, coalesce(orders, 0) AS orders, cents, last_key
        FROM (SELECT DISTINCT {sql_label('c_custkey % 80')} AS shard FROM customer) a LEFT JOIN found f ON f.shard = a.shard""",
    "parse_weight": """
        SELECT c_custkey,
               CAST(CASE WHEN c_custkey % 7 < 3 THEN c_custkey ELSE 0 END AS BIGINT) AS weight,
               CASE c_custkey % 7 WHEN 0 THEN 'MB' WHEN 1 THEN '.5  MB' WHEN 2 THEN '' WHEN 3 THEN 'MB' END AS unit
        FROM customer""",
    "other_measures": f"WITH {_WEIGHTS} SELECT island_no, shard_no, measure, value FROM m",
    "drop_isolated_shard0": """
        SELECT CASE WHEN c_nationkey = 7 THEN 8 ELSE c_nationkey % 5 END AS island_no, c_nationkey AS shard_no,
               count(*) AS weight
        FROM customer WHERE c_nationkey <> 0 GROUP BY 1, 2""",
    "island_weights": f"""
        WITH {PARTIES}, {ORDERS}, found AS (
          SELECT shard_no, count(*) AS n, CAST(sum(floor(acctbal * 100 + 0.5)) AS BIGINT) AS cents
          FROM cust GROUP BY 1)
        SELECT a.shard_no % 5 AS island_no, a.shard_no, coalesce(n, 0) AS weight, CASE WHEN n > 0 THEN '' END AS unit,
               coalesce(CAST(cents AS VARCHAR), 'null') AS cents
        FROM (SELECT DISTINCT shard_no FROM ord WHERE shard_no NOT IN (0, 7)) a LEFT JOIN found USING (shard_no)""",
    "shard_share": f"""
        WITH {_WEIGHTS}, t AS (SELECT *, CAST(sum(weight) OVER (PARTITION BY island_no) AS BIGINT) AS total FROM w)
        SELECT island_no, shard_no, weight, weight / total AS ratio, {_SHARE} AS share FROM t""",
    "island_totals": f"""
        WITH {_WEIGHTS}
        SELECT island_no, CAST(sum(weight) AS BIGINT) AS weight, arg_min(unit, shard_no) AS unit, count(*) AS shards
        FROM w GROUP BY 1""",
    "other_totals": f"""
        WITH {_WEIGHTS}, n AS (
          SELECT island_no, measure, TRY_CAST(regexp_extract(value, '^[-+]?\\d+(\\.\\d+)?') AS DECIMAL(38, 10)) AS v FROM m)
        SELECT island_no, measure, regexp_replace(CAST(sum(v) FILTER (v <> 0) AS VARCHAR), '\\.?0+$', '') AS total
        FROM n GROUP BY 1, 2""",
    "grand_total": f"""
        WITH {_WEIGHTS}
        SELECT CAST(sum(weight) AS BIGINT) AS weight, arg_min(unit, island_no * 1000 + shard_no) AS unit,
               CAST(4 AS BIGINT) AS islands, count(*) AS shards
        FROM w""",
    "totals": f"""
        WITH {_WEIGHTS}
        SELECT island_no, grouping(island_no) = 1 AS is_total, CAST(sum(weight) AS BIGINT) AS weight,
               arg_min(unit, island_no * 1000 + shard_no) AS unit, CASE WHEN grouping(island_no) = 1 THEN 4 ELSE 1 END::BIGINT AS islands,
               count(*) AS shards
        FROM w GROUP BY ROLLUP (island_no)""",
}
