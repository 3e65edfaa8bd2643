"""Stored tables, moves of shards and change streams.

Changes come from the events: key user_id, lsn event_id, op D for `error`, I for
`signup` and U otherwise. The table they change holds all customers, so that most
of its rows see no change. Its shard is the key modulo 16, its island that div 4.
"""

from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from queries.fixtures import ORDER_SHARDS, ORDERS, as_int, cents, order_islands, orders, table
from queries.planning import planned_sql
from shardkit.functions.names import shard_name
from shardkit.operators import progress, relocate
from shardkit.operators.weights import island_weights, size_weights
from shardkit.plans import rebalance as plan
from shardkit.session import scratch_path, settle
from shardkit.sources import changes, layout
from shardkit.sources.feed import PositionFeed, rows_by_shard
from shardkit.streaming import apply, positions

USER_SHARDS = 16
AT = datetime(2024, 5, 6, 7, 8, 9, tzinfo=timezone.utc)


def _placement(spark: SparkSession) -> DataFrame:
    """Islands of the orders' shards, one row per shard number."""
    island = F.when(F.col("shard_no") < 40, 0).when(F.col("shard_no") < 56, 1).otherwise(2)
    return spark.range(64).select(as_int(F.col("id")).alias("shard_no")).withColumn("island_no", island)


def _totals(df: DataFrame) -> DataFrame:
    return df.groupBy("island_no", "shard_no").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(cents("o_totalprice")).alias("cents")
    )


def write_placed(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "orders")
    layout.write_placed(orders(spark, sf), _placement(spark), path)
    return _totals(layout.read_placed(spark, path))


def as_changes(events: DataFrame) -> DataFrame:
    op = F.when(F.col("event_type") == "error", changes.DELETE).when(F.col("event_type") == "signup", changes.INSERT)
    return events.select(
        as_int(F.col("user_id") % USER_SHARDS).alias("shard_no"),
        F.col("user_id"),
        op.otherwise(changes.UPDATE).alias("op"),
        F.col("event_id").alias("lsn"),
        F.struct("event_type", "value").alias("payload"),
    )


def _feed(spark: SparkSession, sf: str) -> DataFrame:
    return as_changes(changes.change_feed(spark, sf, table(spark, sf, "events").schema, "events.parquet"))


def _users(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(
        as_int(F.col("c_custkey") % USER_SHARDS).alias("shard_no"),
        F.col("c_custkey").alias("user_id"),
        F.col("c_mktsegment").alias("event_type"),
        F.col("c_acctbal").alias("value"),
    )


def change_feed(spark: SparkSession, sf: str) -> DataFrame:
    """The whole stream, drained into a file sink and read back."""
    path, checkpoint = scratch_path(spark, "changes"), scratch_path(spark, "stream")
    writer = _feed(spark, sf).writeStream.format("parquet").option("path", path)
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path).groupBy("shard_no", "op").agg(
        F.count(F.lit(1)).alias("changes"), F.max("lsn").alias("lsn")
    )


def apply_changes(spark: SparkSession, sf: str) -> DataFrame:
    log, checkpoint = scratch_path(spark, "log"), scratch_path(spark, "stream")
    apply.apply_changes(_feed(spark, sf), log, checkpoint, ["user_id"]).awaitTermination()
    return apply.merge_changes(_users(spark, sf), apply.read_log(spark, log), ["user_id"])


def _fence(spark: SparkSession, sf: str) -> int:
    return table(spark, sf, "events").agg(F.max("event_id")).first()[0] * 2 // 3


def drain_to_fence(spark: SparkSession, sf: str) -> DataFrame:
    log, checkpoint = scratch_path(spark, "log"), scratch_path(spark, "stream")
    written = as_changes(table(spark, sf, "events"))
    logged = apply.drain_to_fence(_feed(spark, sf), written, _fence(spark, sf), log, checkpoint, ["user_id"])
    return apply.merge_changes(_users(spark, sf), logged, ["user_id"])


def replication_gap(spark: SparkSession, sf: str) -> DataFrame:
    rows = as_changes(table(spark, sf, "events"))
    target = rows.agg(F.max("lsn")).first()[0]
    done = rows.filter(F.col("lsn") <= target // 2).groupBy("shard_no").agg(F.max("lsn").alias("lsn"))
    return progress.replication_gap(done, target)


def feed_positions(spark: SparkSession, sf: str) -> DataFrame:
    """Changes taken up to a fence, then those of half of the shards, then again from earlier positions: rows of each batch."""
    feed = PositionFeed(spark, lambda: as_changes(table(spark, sf, "events")), scratch_path(spark, "positions"))
    end, taken = _fence(spark, sf), []

    def sink(batch: DataFrame, number: int) -> None:
        taken.append(rows_by_shard(batch).withColumn("batch", F.lit(number)))

    feed.step(sink, end)
    feed.step(sink, {shard: 2 * end for shard in range(0, USER_SHARDS, 2)})
    gap = settle(feed.gap())
    feed.seek({shard: end // 2 for shard in range(USER_SHARDS)})
    feed.step(sink)
    return reduce(DataFrame.unionByName, taken).join(gap, "shard_no").select("batch", "shard_no", "changes", "lsn", "gap")


def _order_moves(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1, 0, 3), (5, 0, 2), (41, 1, 0)], "shard_no int, from_island int, to_island int")


def backfill(spark: SparkSession, sf: str) -> DataFrame:
    """Every shard copied to the next island."""
    root = scratch_path(spark, "store")
    moves = _placement(spark).select(
        "shard_no", F.col("island_no").alias("from_island"), as_int((F.col("island_no") + 1) % 4).alias("to_island")
    )
    relocate.backfill({"orders": orders(spark, sf).drop("shard")}, moves, root, "c-1")
    return _totals(layout.read_placed(spark, f"{root}/orders").filter(F.col("copy") == "c-1"))


def backfill_progress(spark: SparkSession, sf: str) -> DataFrame:
    """Whole tables beside what a copy of them holds: all of one, none of others, one twice, one without the orders' last line items."""
    src = {t: table(spark, sf, t) for t in ("orders", "customer", "part", "lineitem")}
    last = Window.partitionBy("l_orderkey").orderBy(F.desc("l_linenumber"))
    dst = {
        "orders": src["orders"],
        "customer": src["customer"].unionByName(src["customer"]),
        "lineitem": src["lineitem"].withColumn("n", F.row_number().over(last)).filter("n > 1"),
    }
    src["empty"] = src["part"].limit(0)
    states = [("orders", "f"), ("customer", "s"), ("part", "i"), ("lineitem", "d"), ("empty", "x")]
    state_rows = spark.createDataFrame(states, "table string, state string")
    found = progress.backfill_progress(progress.row_counts(src), progress.row_counts(dst), state_rows)
    return found.withColumnRenamed("table", "tab")


def advance_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Ids after all tables of one place went to another that has line items of its own, and none of the customers."""
    columns = {"orders": "o_orderkey", "customer": "c_custkey", "part": "p_partkey", "lines": "l_orderkey"}
    lines = table(spark, sf, "lineitem")
    src = {"orders": table(spark, sf, "orders"), "customer": table(spark, sf, "customer"), "part": table(spark, sf, "part"),
           "lines": lines.withColumn("l_orderkey", F.col("l_orderkey") * 2)}
    dst = {"orders": lines.select(F.col("l_orderkey").alias("o_orderkey")), "customer": table(spark, sf, "customer").limit(0), "lines": lines}
    return progress.advance_ids(progress.next_ids(src, columns), progress.next_ids(dst, columns))


def _registry(spark: SparkSession, sf: str) -> DataFrame:
    copies = F.create_map(F.lit("orders"), F.lit("c-first"))
    return orders(spark, sf).select("island_no", "shard", "shard_no").distinct().select(
        F.lit(1).cast("bigint").alias("version"), "island_no", "shard", "shard_no",
        F.lit("active").alias("status"), copies.alias("copies"),
        F.lit(None).cast("map<string,array<string>>").alias("deltas"),
    )


def commit_move(spark: SparkSession, sf: str) -> DataFrame:
    registry = _registry(spark, sf)
    copies = F.create_map(F.lit("orders"), F.lit("c-1"))
    moves = _order_moves(spark).withColumn("copies", copies)
    dry = spark.createDataFrame([(60, 2, 3)], "shard_no int, from_island int, to_island int").withColumn("copies", copies)
    registry = registry.unionByName(relocate.commit_move(registry, moves, True, AT))
    registry = registry.unionByName(relocate.commit_move(registry, dry, False, AT))
    current = relocate.current_registry(registry)
    return current.select("island_no", "shard", "status", F.col("copies.orders").alias("copy"))


def _order_store(spark: SparkSession, sf: str) -> relocate.ShardStore:
    root = scratch_path(spark, "store")
    return relocate.ShardStore.create(spark, root, {"orders": orders(spark, sf).drop("shard")}, _placement(spark))


class _Stop(Exception):
    pass


def abort_move(spark: SparkSession, sf: str) -> DataFrame:
    """A move that fails before it is published leaves everything as it was."""
    store = _order_store(spark, sf)

    def fail(_: str) -> None:
        raise _Stop

    try:
        relocate.move_shards(store, _order_moves(spark), before_commit=fail)
    except _Stop:
        pass
    return _totals(store.table("orders"))


def move_shard(spark: SparkSession, sf: str) -> DataFrame:
    """Shards of the users' table moved while their changes come in; all other shards stay as stored."""
    store = _user_store(spark, _users(spark, sf))
    moves = spark.createDataFrame([(1, 0, 3), (2, 0, 2), (5, 1, 0)], "shard_no int, from_island int, to_island int")
    events = table(spark, sf, "events")
    source = relocate.ChangeSource(_feed(spark, sf), as_changes(events), ["user_id"], snapshot_lsn=-1)
    relocate.move_shards(store, moves, {"users": source}, _fence(spark, sf))
    return store.table("users").select("island_no", "shard_no", "user_id", "event_type", "value")


def _user_store(spark: SparkSession, users: DataFrame) -> relocate.ShardStore:
    placement = spark.range(USER_SHARDS).select(
        as_int(F.col("id")).alias("shard_no"), as_int(F.floor(F.col("id") / 4)).alias("island_no")
    )
    root = scratch_path(spark, "store")
    return relocate.ShardStore.create(spark, root, {"users": users}, placement, {"users": "user_id"})


def move_deltas(spark: SparkSession, sf: str) -> DataFrame:
    """Half of the changes come before the shards are copied, the others, up to the fence, after it, and stay beside the copies."""
    store = _user_store(spark, _users(spark, sf))
    moves = spark.createDataFrame([(1, 0, 3), (2, 0, 2), (5, 1, 0)], "shard_no int, from_island int, to_island int")
    events, path, end = table(spark, sf, "events"), scratch_path(spark, "events"), _fence(spark, sf)
    events.filter(F.col("event_id") <= end // 2).write.parquet(path)

    def feed() -> DataFrame:
        return as_changes(changes.change_feed(spark, path, events.schema))

    def fence() -> int:
        events.filter((F.col("event_id") > end // 2) & (F.col("event_id") <= end)).write.mode("append").parquet(path)
        source.written = as_changes(spark.read.schema(events.schema).parquet(path))
        return end

    source = relocate.ChangeSource(feed(), as_changes(spark.read.schema(events.schema).parquet(path)), ["user_id"], snapshot_lsn=-1)
    relocate.move_shards(store, moves, {"users": source}, fence)
    return store.table("users").select("island_no", "shard_no", "user_id", "event_type", "value")


def move_drifted(spark: SparkSession, sf: str) -> DataFrame:
    """Changes bring a column that the stored rows lack."""
    store = _user_store(spark, _users(spark, sf).drop("value"))
    moves = spark.createDataFrame([(1, 0, 3), (2, 0, 2), (5, 1, 0)], "shard_no int, from_island int, to_island int")
    source = relocate.ChangeSource(_feed(spark, sf), as_changes(table(spark, sf, "events")), ["user_id"], snapshot_lsn=-1)
    relocate.move_shards(store, moves, {"users": source}, _fence(spark, sf))
    return store.table("users").select("island_no", "shard_no", "user_id", "event_type", "value")


def move_concurrent(spark: SparkSession, sf: str) -> DataFrame:
    """Every shard moves to the next island, in four batches side by side."""
    store = _order_store(spark, sf)
    moves = _placement(spark).select(
        F.col("shard_no").alias("move_no"), "shard_no", F.col("island_no").alias("from_island"),
        as_int((F.col("island_no") + 1) % 4).alias("to_island"),
    )
    relocate.move_in_batches(store, moves, batches=4, at_once=4)
    return _totals(store.table("orders"))


def move_progress(spark: SparkSession, sf: str) -> DataFrame:
    """Progress of a move that stops when two of its three tables are copied."""
    placed = {
        "customer": table(spark, sf, "customer").withColumn("shard_no", as_int(F.col("c_custkey") % ORDER_SHARDS)),
        "orders": orders(spark, sf).drop("shard"),
        "parts": table(spark, sf, "part").withColumn("shard_no", as_int(F.col("p_partkey") % ORDER_SHARDS)),
    }
    store = relocate.ShardStore.create(spark, scratch_path(spark, "store"), placed, _placement(spark))
    seen = []

    def look(copy: str, name: str) -> None:
        if name == "orders":
            seen.append(settle(relocate.move_progress(store, copy)))
            raise _Stop

    try:
        relocate.move_shards(store, _order_moves(spark), after_table=look)
    except _Stop:
        pass
    return seen[0].withColumnRenamed("table", "tab")


def statistics(spark: SparkSession, sf: str) -> DataFrame:
    """Rows, bytes of values and largest ids of all active shards, after moves with and without changes and a dry run."""
    store = relocate.ShardStore.create(
        spark, scratch_path(spark, "store"), {"orders": orders(spark, sf).drop("shard")}, _placement(spark), {"orders": "o_orderkey"}
    )
    relocate.move_shards(store, _order_moves(spark))
    dry = spark.createDataFrame([(60, 2, 3)], "shard_no int, from_island int, to_island int")
    relocate.move_shards(store, dry, activate=False)
    return store.statistics().select("island_no", "shard_no", "rows", "value_bytes", "max_id")


def rebalance_by_size(spark: SparkSession, sf: str) -> DataFrame:
    """Weights in kB from the store's statistics, the plan that empties island 1, and which shards it moves."""
    store = _order_store(spark, sf)
    active = store.registry_now("active").select("island_no", "shard")
    sizes = store.statistics().select("island_no", shard_name(F.col("shard_no")).alias("shard"), "table", F.col("value_bytes").alias("bytes"))
    weights = size_weights(sizes, active, "kB", include_isolated_shard0=False)
    sources = order_islands(spark).withColumn("name", F.concat(F.lit("db"), F.col("island_no").cast("string")))
    placement, islands = plan.plan_inputs(weights, sources, active=active)
    moves, _ = plan.rebalance(placement, islands, plan.islands_named(sources, ["db1"]))
    return moves.select("shard_no", "weight", "from_island", "to_island")


def apply_positions(spark: SparkSession, sf: str) -> DataFrame:
    """A copy made half-way through one stream goes on with another that brings all changes twice, in no order."""
    events = table(spark, sf, "events")
    first, again = scratch_path(spark, "first"), scratch_path(spark, "again")
    events.filter(F.col("event_id") % 2 == 0).write.parquet(first)
    for number, files in ((1, 6), (2, 5)):
        events.repartition(files, F.xxhash64("event_id", F.lit(number))).write.mode("append").parquet(again)
    feed = lambda path: as_changes(changes.change_feed(spark, path, events.schema, max_files=3))
    users = positions.PositionedTable.create(spark, scratch_path(spark, "users"), _users(spark, sf), ["user_id"])
    users.apply(feed(first), "evens").awaitTermination()
    users.compact()
    copy = users.copy_to(scratch_path(spark, "users"))
    copy.apply(feed(again), "all").awaitTermination()
    return copy.rows()


def rebalance_store(spark: SparkSession, sf: str) -> DataFrame:
    """A store brought into balance: weights of its shards, a plan of them, and the moves of the plan."""
    store = _order_store(spark, sf)
    live = store.table("orders").withColumn("shard", shard_name(F.col("shard_no")))
    active = store.registry_now("active").select("island_no", "shard")
    weights = island_weights(live, [F.count(F.lit(1)).alias("Rows")], active, include_isolated_shard0=False)
    sources = order_islands(spark).withColumn("name", F.concat(F.lit("db"), F.col("island_no").cast("string")))
    placement, islands = plan.plan_inputs(weights, sources)
    moves, _ = plan.rebalance(placement, islands, plan.islands_named(sources, ["db1"]))
    relocate.move_shards(store, moves.select("shard_no", "from_island", "to_island"))
    return _totals(store.table("orders"))


QUERIES = {
    f.__name__: f
    for f in (
        write_placed, change_feed, feed_positions, apply_changes, drain_to_fence, replication_gap, backfill, backfill_progress,
        advance_ids, commit_move, abort_move, move_shard, move_deltas, move_drifted, move_concurrent, move_progress,
        statistics, rebalance_by_size, apply_positions, rebalance_store,
    )
}

_TOTALS = """
SELECT island_no, shard_no, count(*) AS rows, CAST(sum(floor(o_totalprice * 100 + 0.5)) AS BIGINT) AS cents
FROM ({source}) GROUP BY 1, 2"""

_CHANGES = """
chg AS (
  SELECT CAST(user_id % 16 AS INTEGER) AS shard_no, user_id, event_id AS lsn, event_type, value,
         CASE event_type WHEN 'error' THEN 'D' WHEN 'signup' THEN 'I' ELSE 'U' END AS op
  FROM events),
usr AS (
  SELECT CAST(c_custkey % 16 AS INTEGER) AS shard_no, c_custkey AS user_id, c_mktsegment AS event_type, c_acctbal AS value
  FROM customer),
fence AS (SELECT max(event_id) * 2 // 3 AS lsn FROM events)"""


def _merged(condition: str) -> str:
    return f"""
last AS (
  SELECT * FROM chg WHERE {condition} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY lsn DESC) = 1),
merged AS (
  SELECT shard_no, user_id, event_type, value FROM usr WHERE user_id NOT IN (SELECT user_id FROM last)
  UNION ALL SELECT shard_no, user_id, event_type, value FROM last WHERE op <> 'D')"""


ONE_PLAN = f"""
{ORDERS}, placed AS (
  SELECT 'all' AS plan_id, island_no, island_no AS island_ord, shard_no, shard_no AS shard_ord, count(*) AS weight
  FROM ord GROUP BY ALL),
isl AS (SELECT 'all' AS plan_id, CAST(n AS INTEGER) AS island_no, CAST(n AS INTEGER) AS island_ord FROM (SELECT unnest(range(4)) AS n))"""

# the columns of an order by their widths
_ORDER_BYTES = "8 + 8 + strlen(o_orderstatus) + 8 + 8 + strlen(o_orderpriority)"

_SIZED_PLAN = f"""
{ORDERS}, placed AS (
  SELECT 'all' AS plan_id, island_no, island_no AS island_ord, shard_no, shard_no AS shard_ord,
         CAST(round(sum({_ORDER_BYTES}) / 1024) AS BIGINT) AS weight
  FROM ord GROUP BY ALL),
isl AS (SELECT 'all' AS plan_id, CAST(n AS INTEGER) AS island_no, CAST(n AS INTEGER) AS island_ord FROM (SELECT unnest(range(4)) AS n))"""

_MOVED_USERS = f"""
WITH {_CHANGES}, last AS (
  SELECT * FROM chg WHERE lsn <= (SELECT lsn FROM fence) AND shard_no IN (1, 2, 5)
  QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY lsn DESC) = 1),
merged AS (
  SELECT shard_no, user_id, event_type, value, false AS changed FROM usr WHERE user_id NOT IN (SELECT user_id FROM last)
  UNION ALL SELECT shard_no, user_id, event_type, value, true FROM last WHERE op <> 'D')
SELECT CAST(CASE shard_no WHEN 1 THEN 3 WHEN 2 THEN 2 WHEN 5 THEN 0 ELSE shard_no // 4 END AS INTEGER) AS island_no,
       shard_no, user_id, event_type, {{value}}
FROM merged"""

_MOVED = "(shard_no = 1 OR shard_no = 5 OR shard_no = 41)"

ORACLES = {
    "write_placed": f"WITH {ORDERS} {_TOTALS.format(source='SELECT * FROM ord')}",
    "change_feed": f"WITH {_CHANGES} SELECT shard_no, op, count(*) AS changes, max(lsn) AS lsn FROM chg GROUP BY 1, 2",
    "feed_positions": f"""
        WITH {_CHANGES}, f AS (SELECT *, (SELECT lsn FROM fence) AS fence FROM chg),
        gaps AS (
          SELECT shard_no, max(lsn) - max(CASE WHEN shard_no % 2 = 0 THEN least(lsn, 2 * fence) ELSE least(lsn, fence) END) AS gap
          FROM f GROUP BY 1)
        SELECT batch, shard_no, count(*) AS changes, max(lsn) AS lsn, any_value(gap) AS gap
        FROM (SELECT 0 AS batch, * FROM f WHERE lsn <= fence
              UNION ALL SELECT 1, * FROM f WHERE lsn > fence AND lsn <= 2 * fence AND shard_no % 2 = 0
              UNION ALL SELECT 3, * FROM f WHERE lsn > fence // 2) JOIN gaps USING (shard_no)
        GROUP BY 1, 2""",
    "apply_changes": f"WITH {_CHANGES}, {_merged('true')} SELECT * FROM merged",
    "drain_to_fence": f"WITH {_CHANGES}, {_merged('lsn <= (SELECT lsn FROM fence)')} SELECT * FROM merged",
    "replication_gap": f"""
        WITH {_CHANGES}, t AS (SELECT max(lsn) AS target FROM chg)
        SELECT shard_no, greatest(max(target) - max(lsn), 0) AS gap FROM chg, t WHERE lsn <= target // 2 GROUP BY 1""",
    "backfill": f"""
        WITH {ORDERS} {_TOTALS.format(source='SELECT * REPLACE ((island_no + 1) % 4 AS island_no) FROM ord')}""",
    "backfill_progress": """
        WITH c AS (
          SELECT 'orders' AS tab, 'finished table copy' AS state, count(*) AS count_from, count(*) AS copied FROM orders
          UNION ALL SELECT 'customer', 'synchronized', count(*), 2 * count(*) FROM customer
          UNION ALL SELECT 'part', 'initializing', count(*), 0 FROM part
          UNION ALL SELECT 'lineitem', 'data is being copied', count(*), count(*) - count(DISTINCT l_orderkey) FROM lineitem
          UNION ALL SELECT 'empty', 'x', 0, 0)
        SELECT tab, state, CAST(CASE WHEN count_from = 0 THEN 100 ELSE round(least(count_from, copied) / count_from * 100) END AS INTEGER) AS percent,
               least(count_from, copied) AS count_to, count_from
        FROM c""",
    "advance_ids": """
        SELECT 'orders' AS name, greatest((SELECT max(o_orderkey) FROM orders), max(l_orderkey)) + 1001 AS next_id FROM lineitem
        UNION ALL SELECT 'lines', max(l_orderkey) * 2 + 1001 FROM lineitem
        UNION ALL SELECT 'customer', max(c_custkey) + 1001 FROM customer""",
    "commit_move": f"""
        WITH {ORDERS}, s AS (SELECT DISTINCT island_no, shard_no, shard FROM ord)
        SELECT island_no, shard, 'active' AS status, 'c-first' AS copy FROM s WHERE NOT {_MOVED}
        UNION ALL SELECT island_no, shard || 'old20240506070809', 'inactive', 'c-first' FROM s WHERE {_MOVED}
        UNION ALL SELECT CASE shard_no WHEN 1 THEN 3 WHEN 5 THEN 2 ELSE 0 END, shard, 'active', 'c-1' FROM s WHERE {_MOVED}
        UNION ALL SELECT 3, shard || 'new', 'inactive', 'c-1' FROM s WHERE shard_no = 60""",
    "abort_move": f"WITH {ORDERS} {_TOTALS.format(source='SELECT * FROM ord')}",
    "move_deltas": _MOVED_USERS.format(value="value"),
    "move_drifted": _MOVED_USERS.format(value="CASE WHEN changed THEN value END AS value"),
    "move_concurrent": f"""
        WITH {ORDERS} {_TOTALS.format(source='SELECT * REPLACE ((island_no + 1) % 4 AS island_no) FROM ord')}""",
    "move_progress": f"""
        WITH {ORDERS}, c AS (
          SELECT 'customer' AS tab, 'synchronized' AS state, count(*) AS count_from, count(*) AS count_to
          FROM customer WHERE c_custkey % 64 IN (1, 5, 41)
          UNION ALL SELECT 'orders', 'synchronized', count(*), count(*) FROM ord WHERE shard_no IN (1, 5, 41)
          UNION ALL SELECT 'parts', 'initializing', count(*), 0 FROM part WHERE p_partkey % 64 IN (1, 5, 41))
        SELECT tab, state, CAST(CASE WHEN count_from = 0 THEN 100 ELSE round(count_to / count_from * 100) END AS INTEGER) AS percent,
               count_to, count_from FROM c""",
    "statistics": f"""
        WITH {ORDERS}
        SELECT CASE shard_no WHEN 1 THEN 3 WHEN 5 THEN 2 WHEN 41 THEN 0 ELSE island_no END AS island_no, shard_no, count(*) AS rows,
               CAST(sum({_ORDER_BYTES}) AS BIGINT) AS value_bytes, max(o_orderkey) AS max_id
        FROM ord GROUP BY 1, 2""",
    "rebalance_by_size": f"""
        {planned_sql(_SIZED_PLAN, '1')}
        SELECT shard_no, weight, from_island, island_no AS to_island FROM final WHERE island_no <> from_island""",
    "apply_positions": f"WITH {_CHANGES}, {_merged('true')} SELECT * FROM merged",
    "rebalance_store": f"""
        {planned_sql(ONE_PLAN, '1')}
        SELECT f.island_no, o.shard_no, count(*) AS rows, CAST(sum(floor(o_totalprice * 100 + 0.5)) AS BIGINT) AS cents
        FROM ord o JOIN final f ON f.shard_no = o.shard_no GROUP BY 1, 2""",
    "move_shard": f"""
        WITH {_CHANGES}, {_merged('lsn <= (SELECT lsn FROM fence) AND shard_no IN (1, 2, 5)')}
        SELECT CAST(CASE shard_no WHEN 1 THEN 3 WHEN 2 THEN 2 WHEN 5 THEN 0 ELSE shard_no // 4 END AS INTEGER) AS island_no,
               shard_no, user_id, event_type, value
        FROM merged""",
}
