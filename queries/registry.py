"""Shard labels and the registry of shards."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from queries.fixtures import PARTIES, as_int, cents, customers, labels, nations, sql_label, suppliers, table
from shardkit.functions import names
from shardkit.operators import registry as reg


def shard_name(spark: SparkSession, sf: str) -> DataFrame:
    label = names.shard_name(F.col("o_orderkey")).alias("shard")
    return table(spark, sf, "orders").groupBy(label).agg(F.count(F.lit(1)).alias("orders"))


def shard_no(spark: SparkSession, sf: str) -> DataFrame:
    texts = (
        table(spark, sf, "documents").select(F.col("source").alias("text"))
        .unionByName(table(spark, sf, "customer").select(F.col("c_mktsegment").alias("text")))
        .unionByName(table(spark, sf, "pages").select(F.col("url").alias("text")))
    )
    return texts.groupBy(names.shard_no(F.col("text")).alias("shard_no")).agg(F.count(F.lit(1)).alias("texts"))


def shard_range(spark: SparkSession, sf: str) -> DataFrame:
    found = suppliers(spark, sf)
    ends = found.agg(F.min("shard_no").alias("lo"), F.max("shard_no").alias("hi")).first()
    counts = found.groupBy("shard_no").agg(F.count(F.lit(1)).alias("n"))
    members = reg.shard_range(spark, ends.lo, ends.hi + 5)
    return members.join(counts, "shard_no", "left").select(
        "shard_no", "shard", F.coalesce("n", F.lit(0)).alias("suppliers")
    )


def missing_shards(spark: SparkSession, sf: str) -> DataFrame:
    existing = labels(table(spark, sf, "orders"), F.col("o_custkey") % 97 * 3)
    return reg.missing_shards(existing, 0, 300)


def droppable_shards(spark: SparkSession, sf: str) -> DataFrame:
    existing = labels(table(spark, sf, "customer"), F.col("c_custkey") % 128)
    data = labels(table(spark, sf, "supplier"), F.col("s_suppkey") % 64 * 2)
    return reg.droppable_shards(existing, data, 10, 100)


def _active(df: DataFrame) -> DataFrame:
    return df.select("shard").distinct().withColumn("status", F.lit(reg.ACTIVE))


def _rich(df: DataFrame, mean: int) -> DataFrame:
    """Shards with so many cents on average, over all their rows."""
    means = df.groupBy("shard").agg(F.sum(cents("acctbal")).alias("cents"), F.count(F.lit(1)).alias("n"))
    return _active(means.filter(F.col("cents") > F.col("n") * mean))


def activate_shards(spark: SparkSession, sf: str) -> DataFrame:
    registry = _rich(suppliers(spark, sf), 550_000)
    return reg.activate_shards(registry, customers(spark, sf), 5, 9)[1]


def deactivate_shards(spark: SparkSession, sf: str) -> DataFrame:
    stopped, registry = reg.deactivate_shards(_active(customers(spark, sf)), 20, 40)
    was = stopped.withColumn("stopped", F.lit(True))
    return registry.join(was, "shard", "left").withColumn("stopped", F.coalesce("stopped", F.lit(False)))


def active_shards(spark: SparkSession, sf: str) -> DataFrame:
    registry = _rich(suppliers(spark, sf), 400_000)
    found = reg.active_shards(registry, customers(spark, sf))
    return found.select(F.array_join("shards", ",").alias("shards"), F.size("shards").alias("n"))


def reconcile_active(spark: SparkSession, sf: str) -> DataFrame:
    registry = _active(labels(table(spark, sf, "supplier"), F.col("s_suppkey") % 40))
    existing = labels(table(spark, sf, "customer"), F.col("c_custkey") % 35)
    new = labels(table(spark, sf, "orders"), F.col("o_custkey") % 30)
    return reg.reconcile_active(registry, existing, new)


ENDINGS = ["", "old", "old_5", "old20230109070954", "older", "new", "old_"]


def retired_shards(spark: SparkSession, sf: str) -> DataFrame:
    ending = F.get(F.array(*[F.lit(e) for e in ENDINGS]), as_int(F.col("doc_id") % len(ENDINGS)))
    name = F.concat(names.shard_name(F.col("doc_id") % 10000), ending)
    return reg.retired_shards(table(spark, sf, "documents").select(name.alias("shard")))


def duplicate_active(spark: SparkSession, sf: str) -> DataFrame:
    first = customers(spark, sf).join(nations(spark, sf), "shard_no").select("shard", "island_no")
    island = as_int((F.col("shard_no") + F.col("id") % 2) % 5)
    second = suppliers(spark, sf).select("shard", island.alias("island_no"))
    found = reg.duplicate_active(first.unionByName(second))
    return found.select("shard", F.array_join(F.transform("islands", lambda i: i.cast("string")), ",").alias("islands"))


QUERIES = {
    f.__name__: f
    for f in (
        shard_name, shard_no, shard_range, missing_shards, droppable_shards, activate_shards, deactivate_shards,
        active_shards, reconcile_active, retired_shards, duplicate_active,
    )
}

def _rich_sql(mean: int) -> str:
    return f"GROUP BY shard HAVING sum(floor(acctbal * 100 + 0.5)) > count(*) * {mean}"


_SERIES = "(SELECT {label} AS shard FROM (SELECT unnest(generate_series({lo}, {hi})) AS n))"


def _series(lo: int, hi: int) -> str:
    return _SERIES.format(label=sql_label("n"), lo=lo, hi=hi)


ORACLES = {
    "shard_name": f"SELECT {sql_label('o_orderkey')} AS shard, count(*) AS orders FROM orders GROUP BY 1",
    "shard_no": r"""
        SELECT TRY_CAST(NULLIF(regexp_extract(text, '(\d+)', 1), '') AS INTEGER) AS shard_no, count(*) AS texts
        FROM (SELECT source AS text FROM documents UNION ALL SELECT c_mktsegment FROM customer
              UNION ALL SELECT url FROM pages)
        GROUP BY 1""",
    "shard_range": f"""
        WITH {PARTIES}, members AS (
          SELECT CAST(unnest(generate_series(lo, hi)) AS INTEGER) AS shard_no
          FROM (SELECT min(shard_no) AS lo, max(shard_no) + 5 AS hi FROM supp))
        SELECT m.shard_no, {sql_label('m.shard_no')} AS shard, count(s.id) AS suppliers
        FROM members m LEFT JOIN supp s USING (shard_no) GROUP BY 1""",
    "missing_shards": f"""
        SELECT shard FROM {_series(0, 300)} r
        WHERE NOT EXISTS (SELECT 1 FROM orders WHERE {sql_label('o_custkey % 97 * 3')} = r.shard)""",
    "droppable_shards": f"""
        SELECT shard, shard NOT IN (SELECT {sql_label('s_suppkey % 64 * 2')} FROM supplier) AS is_empty
        FROM {_series(10, 100)} r
        WHERE shard IN (SELECT {sql_label('c_custkey % 128')} FROM customer)""",
    "activate_shards": f"""
        WITH {PARTIES}
        SELECT shard, 'active' AS status
        FROM (SELECT shard FROM supp {_rich_sql(550000)} UNION SELECT shard FROM {_series(5, 9)} r)
        WHERE shard IN (SELECT shard FROM cust)""",
    "deactivate_shards": f"""
        WITH {PARTIES}
        SELECT DISTINCT shard, CASE WHEN shard_no BETWEEN 20 AND 40 THEN 'inactive' ELSE 'active' END AS status,
               shard_no BETWEEN 20 AND 40 AS stopped
        FROM cust""",
    "active_shards": f"""
        WITH {PARTIES}, hit AS (
          SELECT shard FROM (SELECT shard FROM supp {_rich_sql(400000)}) WHERE shard IN (SELECT shard FROM cust))
        SELECT string_agg(shard, ',' ORDER BY shard) AS shards, CAST(count(*) AS INTEGER) AS n FROM hit""",
    "reconcile_active": f"""
        WITH old AS (SELECT DISTINCT s_suppkey % 40 AS n FROM supplier),
             new AS (SELECT DISTINCT o_custkey % 30 AS n FROM orders),
             merged AS (SELECT n, 'active' AS status FROM new
                        UNION ALL SELECT n, 'inactive' FROM old WHERE n NOT IN (SELECT n FROM new))
        SELECT {sql_label('n')} AS shard, status FROM merged
        WHERE n IN (SELECT c_custkey % 35 FROM customer)""",
    "retired_shards": f"""
        SELECT DISTINCT shard FROM (
          SELECT {sql_label('doc_id % 10000')} || list_extract({ENDINGS!r}, doc_id % 7 + 1) AS shard, doc_id % 7 AS ending
          FROM documents)
        WHERE ending IN (1, 2, 3, 5)""",
    "duplicate_active": f"""
        WITH {PARTIES}, pairs AS (
          SELECT shard, n_regionkey AS island_no FROM cust JOIN nation ON n_nationkey = shard_no
          UNION SELECT shard, (shard_no + id % 2) % 5 FROM supp)
        SELECT shard, string_agg(CAST(island_no AS VARCHAR), ',' ORDER BY island_no) AS islands
        FROM pairs GROUP BY shard HAVING count(*) > 1""",
}
