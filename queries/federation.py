"""Mounted sources, the union of all shards, and runs over every shard."""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from queries.fixtures import ORDERS, PARTIES, cents, customers, labels, nations, orders, sql_label, suppliers, table
from shardkit.functions import names
from shardkit.operators import federate
from shardkit.operators.catalog import ColumnCatalog
from shardkit.session import scratch_path
from shardkit.sources import layout, mounts


def _regions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "region").select(F.col("r_regionkey").alias("island_no"), F.col("r_name").alias("host"))


def mount_shards(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "customers")
    layout.write_placed(customers(spark, sf).drop("shard"), nations(spark, sf), path)
    # which shards an island has comes from the file listing, their rows from its directory
    regions = _regions(spark, sf).withColumn("host", F.concat("host", F.lit(".db-host:5432")))
    active = layout.stored_shards(spark, path).join(regions, "island_no")
    active = active.select("host", names.shard_name(F.col("shard_no")).alias("shard"))
    sources = {}
    for region in regions.collect():
        island = layout.island_source(spark, path, region.island_no)
        sources[region.host] = island.withColumn("shard", names.shard_name(F.col("shard_no")))
    mounted, summary = mounts.mount_shards("fdw", sources, active)
    rows = federate.union_sources(mounted.labelled()).groupBy(F.col("shard").alias("label"))
    counts = rows.agg(F.count(F.lit(1)).alias("rows"), F.sum(cents("acctbal")).alias("cents"))
    listed = mounted.manifest.select("server", "label").join(summary, "server")
    return listed.join(counts, "label").select("server", "label", "rows", "cents", F.col("shard_count").cast("bigint"))


def mounted_shards(spark: SparkSession, sf: str) -> DataFrame:
    home = nations(spark, sf).join(_regions(spark, sf), "island_no")
    first = mounts.mount_manifest("fdw", customers(spark, sf).join(home, "shard_no").select("host", "shard"))
    second = mounts.mount_manifest("fdw2", suppliers(spark, sf).join(home, "shard_no").select("host", "shard"))
    foreign = labels(table(spark, sf, "orders"), F.col("o_custkey") % 50).distinct().select(
        F.lit("other").alias("server"), F.lit("other").alias("host"), "shard",
        F.concat(F.lit("fdw_x"), "shard").alias("label"), F.lit("made by hand").alias("comment"),
    )
    found = mounts.mounted_shards(first.unionByName(second).unionByName(foreign), "fdw")
    return found.select(F.array_join("labels", ",").alias("labels"), F.size("labels").alias("n"))


def _columns(spark: SparkSession, sf: str) -> DataFrame:
    """Catalog rows; the mixed table has columns of customers in some shards, of orders in others, or both."""
    placed = orders(spark, sf).select(
        "shard", F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("total"), "shard_no"
    )
    frames = [
        ("customer", customers(spark, sf)),
        ("supplier", suppliers(spark, sf)),
        ("mixed", customers(spark, sf)),
        ("mixed", placed),
        ("bad-name", suppliers(spark, sf)),
    ]
    rows = [federate.column_rows(df, name, df.schema) for name, df in frames]
    return reduce(DataFrame.unionByName, rows).distinct()


def _joined(inventory: DataFrame) -> DataFrame:
    return inventory.select(
        "table", F.array_join("shards", ",").alias("shards"), F.array_join("columns", ",").alias("columns")
    )


def table_inventory(spark: SparkSession, sf: str) -> DataFrame:
    return _joined(federate.table_inventory(_columns(spark, sf)))


def skip_existing(spark: SparkSession, sf: str) -> DataFrame:
    views = spark.createDataFrame([("supplier",), ("unknown",)], "table string")
    return _joined(federate.skip_existing(federate.table_inventory(_columns(spark, sf)), views))


def align_columns(spark: SparkSession, sf: str) -> DataFrame:
    frames = [suppliers(spark, sf), customers(spark, sf)]
    order = federate.align_columns(frames)
    filled = federate.union_sources(frames).agg(*[F.count(c).alias(c) for c in order])
    rows = filled.unpivot([], order, "column", "filled")
    place = F.array_position(F.array(*[F.lit(c) for c in order]), F.col("column"))
    return rows.select("column", place.cast("int").alias("place"), "filled")


def _summary(whole: DataFrame) -> DataFrame:
    return whole.groupBy("shard").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(cents("acctbal")).alias("cents"), F.count("mktsegment").alias("segments")
    )


def union_shards(spark: SparkSession, sf: str) -> DataFrame:
    # shards are regions here, of customers from 0 on, of suppliers from 100 on: one branch each, reading its directory
    shards = {}
    places = _regions(spark, sf).select(F.col("island_no").alias("shard_no"), "island_no")
    for first, df in ((0, customers(spark, sf)), (100, suppliers(spark, sf))):
        path = scratch_path(spark, "parties")
        in_region = df.drop("shard").join(nations(spark, sf), "shard_no").drop("shard_no")
        layout.write_placed(in_region.withColumnRenamed("island_no", "shard_no"), places, path)
        stored = layout.read_placed(spark, path)
        for region in layout.stored_shards(spark, path).collect():
            part = stored.filter(F.col("shard_no") == region.shard_no).drop("shard_no", "island_no")
            shards[f"fdw_sh{first + region.shard_no:04d}"] = part
    return _summary(federate.union_shards(shards, "fdw"))


def union_sources(spark: SparkSession, sf: str) -> DataFrame:
    return _summary(federate.union_sources([customers(spark, sf), suppliers(spark, sf)]))


def union_stored(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "customers")
    layout.write_placed(customers(spark, sf).drop("shard"), nations(spark, sf), path)
    return _summary(federate.union_stored(layout.read_placed(spark, path)))


def strip_prefix(spark: SparkSession, sf: str) -> DataFrame:
    mounted = customers(spark, sf).select(names.mount_label(F.col("shard"), "fdw").alias("label"))
    plain = suppliers(spark, sf).select(F.col("shard").alias("label"))
    stripped = names.strip_prefix(F.col("label"), "fdw").alias("shard")
    return mounted.unionByName(plain).groupBy(stripped).agg(F.count(F.lit(1)).alias("rows"))


def refresh_if_changed(spark: SparkSession, sf: str) -> DataFrame:
    columns = _columns(spark, sf)
    # the stored manifest knows suppliers without their balance, and nothing of the mixed table
    before = columns.filter(~((F.col("table") == "supplier") & (F.col("column") == "acctbal")))
    manifest = federate.fingerprints(before.filter(F.col("table") != "mixed"))
    return federate.changed_tables(columns, manifest)


def refresh_unions(spark: SparkSession, sf: str) -> DataFrame:
    """Customers and suppliers are written by nation; then some nations' suppliers anew, with a wider key and one more column.

    The union of each table as it was rebuilt last, in the first refresh or the second.
    """
    path = scratch_path(spark, "parties")
    catalog = ColumnCatalog(spark, scratch_path(spark, "catalog"))
    parties = {"customer": customers(spark, sf).drop("shard"), "supplier": suppliers(spark, sf).drop("shard", "name")}
    parties["supplier"] = parties["supplier"].withColumn("id", F.col("id").cast("int"))
    for name, df in parties.items():
        catalog.write(name, df, path)
    unions = {}
    _, manifest = catalog.refresh(path, federate.fingerprints(catalog.columns()).limit(0), lambda name, df: unions.update({name: (1, df)}))
    catalog.write("supplier", suppliers(spark, sf).drop("shard").filter(F.col("shard_no") % 3 == 0), path)
    catalog.refresh(path, manifest, lambda name, df: unions.update({name: (2, df)}))
    found = []
    for name, (number, df) in unions.items():
        filled = F.count("name").alias("names")
        rows = df.groupBy("shard").agg(F.count(F.lit(1)).alias("rows"), F.sum("id").alias("ids"), F.sum(cents("acctbal")).alias("cents"), filled)
        found.append(rows.select(F.lit(name).alias("tab"), F.lit(number).alias("refresh"), "*"))
    return reduce(DataFrame.unionByName, found)


def _active_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Shards whose customers' balances are 4,500 or more on average."""
    shard_no = (F.col("c_custkey") % 64).cast("int").alias("shard_no")
    means = table(spark, sf, "customer").groupBy(shard_no).agg(F.sum(cents("c_acctbal")).alias("cents"), F.count(F.lit(1)).alias("n"))
    rich = means.filter(F.col("cents") >= F.col("n") * 450_000)
    return rich.select("shard_no", names.shard_name(F.col("shard_no")).alias("shard"))


def for_each_shard(spark: SparkSession, sf: str) -> DataFrame:
    """Customers who spent over a million, by shard."""

    def spenders(df: DataFrame) -> DataFrame:
        spent = df.groupBy("shard_no", "o_custkey").agg(F.sum(cents("o_totalprice")).alias("cents"))
        return spent.filter(F.col("cents") > 350_000_000)

    return federate.for_each_shard(orders(spark, sf), spenders, _active_orders(spark, sf))


def run_each_shard(spark: SparkSession, sf: str) -> DataFrame:
    """Orders, cents and the best customer of every active shard, a job group each; a row per shard."""

    def summary(df: DataFrame) -> DataFrame:
        spent = df.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum(cents("o_totalprice")).alias("cents"))
        best = F.max_by("o_custkey", F.struct("cents", "o_custkey")).alias("best")
        return spent.agg(F.sum("n").alias("orders"), F.sum("cents").alias("cents"), best)

    placed = scratch_path(spark, "orders")
    layout.write_layout(orders(spark, sf).drop("shard"), placed)
    results, counts = federate.run_each_shard(layout.read_placed(spark, placed), summary, _active_orders(spark, sf))
    return results.withColumn("shard", names.shard_name(F.col("shard_no"))).join(counts, "shard").drop("shard_no")


def map_each_shard(spark: SparkSession, sf: str) -> DataFrame:
    active = table(spark, sf, "customer").select((F.col("c_custkey") % 64).cast("int").alias("shard_no"))
    rows = orders(spark, sf).select("shard_no", "o_orderkey", "o_orderpriority")

    def urgent(part):
        return part[part["o_orderpriority"].str.startswith("1-")][["shard_no", "o_orderkey"]]

    found = federate.map_each_shard(rows, urgent, "shard_no int, o_orderkey bigint", active)
    return found.groupBy("shard_no").agg(F.count(F.lit(1)).alias("orders"), F.max("o_orderkey").alias("last"))


QUERIES = {
    f.__name__: f
    for f in (
        mount_shards, mounted_shards, table_inventory, skip_existing, align_columns, union_shards, union_sources,
        union_stored, strip_prefix, refresh_if_changed, refresh_unions, for_each_shard, run_each_shard, map_each_shard,
    )
}

_COLUMNS = f"""
{PARTIES}, {ORDERS}, cols AS (
  SELECT DISTINCT shard, 'customer' AS tab,
         unnest(['id bigint', 'name string', 'acctbal double', 'mktsegment string', 'shard_no int']) AS col FROM cust
  UNION SELECT shard, 'supplier', unnest(['id bigint', 'name string', 'acctbal double', 'shard_no int']) FROM supp
  UNION SELECT shard, 'mixed',
         unnest(['id bigint', 'name string', 'acctbal double', 'mktsegment string', 'shard_no int']) FROM cust
  UNION SELECT shard, 'mixed', unnest(['id bigint', 'total double', 'shard_no int']) FROM ord)"""

_INVENTORY = f"""
WITH {_COLUMNS}
SELECT tab AS "table", (SELECT string_agg(s, ',' ORDER BY s) FROM (SELECT DISTINCT shard AS s FROM cols c WHERE c.tab = t.tab)) AS shards,
       (SELECT string_agg(s, ',' ORDER BY s) FROM (SELECT DISTINCT split_part(col, ' ', 1) AS s FROM cols c WHERE c.tab = t.tab)) AS columns
FROM (SELECT DISTINCT tab FROM cols {{where}}) t"""

_ACTIVE_ORDERS = """
active AS (
  SELECT CAST(c_custkey % 64 AS INTEGER) AS n FROM customer GROUP BY 1
  HAVING sum(floor(c_acctbal * 100 + 0.5)) >= count(*) * 450000)"""

_SUMMARY = """
SELECT shard, count(*) AS rows, CAST(sum(floor(acctbal * 100 + 0.5)) AS BIGINT) AS cents, count(mktsegment) AS segments
FROM ({source}) GROUP BY shard"""

ORACLES = {
    "mount_shards": f"""
        WITH {PARTIES}, placed AS (
          SELECT 'fdw_' || replace(r_name, ' ', '_') || '_db_host_5432' AS server, 'fdw_' || shard AS label, acctbal
          FROM cust JOIN nation ON n_nationkey = shard_no JOIN region ON r_regionkey = n_regionkey)
        SELECT server, label, count(*) AS rows, CAST(sum(floor(acctbal * 100 + 0.5)) AS BIGINT) AS cents, any_value(shards) AS shard_count
        FROM placed JOIN (SELECT server, count(DISTINCT label) AS shards FROM placed GROUP BY 1) USING (server)
        GROUP BY 1, 2""",
    "mounted_shards": f"""
        WITH {PARTIES}
        SELECT string_agg('fdw_' || shard, ',' ORDER BY shard) AS labels, CAST(count(*) AS INTEGER) AS n
        FROM (SELECT DISTINCT shard FROM cust)""",
    "table_inventory": _INVENTORY.format(where=""),
    "skip_existing": _INVENTORY.format(where="WHERE tab <> 'supplier'"),
    "align_columns": f"""
        WITH {PARTIES}, whole AS (
          SELECT id, acctbal, mktsegment, name, shard_no FROM cust
          UNION ALL SELECT id, acctbal, NULL, name, shard_no FROM supp)
        SELECT 'id' AS "column", 1 AS place, count(id) AS filled FROM whole
        UNION ALL SELECT 'acctbal', 2, count(acctbal) FROM whole
        UNION ALL SELECT 'mktsegment', 3, count(mktsegment) FROM whole
        UNION ALL SELECT 'name', 4, count(name) FROM whole
        UNION ALL SELECT 'shard_no', 5, count(shard_no) FROM whole""",
    "union_shards": f"WITH {PARTIES} " + _SUMMARY.format(
        source=f"SELECT {sql_label('n_regionkey')} AS shard, acctbal, mktsegment FROM cust JOIN nation ON n_nationkey = shard_no "
        f"UNION ALL SELECT {sql_label('n_regionkey + 100')}, acctbal, NULL FROM supp JOIN nation ON n_nationkey = shard_no"
    ),
    "union_sources": f"WITH {PARTIES} " + _SUMMARY.format(
        source="SELECT shard, acctbal, mktsegment FROM cust UNION ALL SELECT shard, acctbal, NULL FROM supp"
    ),
    "union_stored": f"WITH {PARTIES} " + _SUMMARY.format(source="SELECT shard, acctbal, mktsegment FROM cust"),
    "strip_prefix": f"""
        WITH {PARTIES}
        SELECT shard, count(*) AS rows FROM (SELECT shard FROM cust UNION ALL SELECT shard FROM supp) GROUP BY shard""",
    "refresh_if_changed": f"""
        WITH {_COLUMNS}, per_shard AS (
          SELECT tab, shard, md5(string_agg(col, ',' ORDER BY col)) AS digest FROM cols GROUP BY 1, 2)
        SELECT tab AS "table", md5(string_agg(shard || ' ' || digest, ',' ORDER BY shard)) AS fingerprint
        FROM per_shard WHERE tab IN ('supplier', 'mixed') GROUP BY 1""",
    "refresh_unions": f"""
        WITH {PARTIES}
        SELECT 'customer' AS tab, 1 AS refresh, shard, count(*) AS rows, CAST(sum(id) AS BIGINT) AS ids,
               CAST(sum(floor(acctbal * 100 + 0.5)) AS BIGINT) AS cents, count(name) AS names FROM cust GROUP BY shard
        UNION ALL SELECT 'supplier', 2, shard, count(*), CAST(sum(id) AS BIGINT), CAST(sum(floor(acctbal * 100 + 0.5)) AS BIGINT),
               count(CASE WHEN shard_no % 3 = 0 THEN name END) FROM supp GROUP BY shard""",
    "for_each_shard": f"""
        WITH {ORDERS}, {_ACTIVE_ORDERS},
        spent AS (SELECT shard_no, o_custkey FROM ord GROUP BY 1, 2 HAVING sum(floor(o_totalprice * 100 + 0.5)) > 350000000),
        counts AS (SELECT shard_no, count(*) AS n FROM spent GROUP BY 1)
        SELECT {sql_label('a.n')} AS shard, coalesce(CAST(c.n AS VARCHAR), '') AS row_count
        FROM active a LEFT JOIN counts c ON c.shard_no = a.n WHERE a.n <> 0""",
    "run_each_shard": f"""
        WITH {ORDERS}, {_ACTIVE_ORDERS},
        spent AS (SELECT shard_no, o_custkey, count(*) AS n, CAST(sum(floor(o_totalprice * 100 + 0.5)) AS BIGINT) AS cents FROM ord GROUP BY 1, 2)
        SELECT {sql_label('shard_no')} AS shard, CAST(sum(s.n) AS BIGINT) AS orders, CAST(sum(cents) AS BIGINT) AS cents,
               arg_max(o_custkey, (cents, o_custkey)) AS best, '1' AS row_count
        FROM spent s JOIN active a ON a.n = shard_no WHERE shard_no <> 0 GROUP BY shard_no""",
    "map_each_shard": f"""
        WITH {ORDERS}
        SELECT shard_no, count(*) AS orders, max(o_orderkey) AS last FROM ord
        WHERE shard_no <> 0 AND o_orderpriority LIKE '1-%' GROUP BY 1""",
}
