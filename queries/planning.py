"""Plans over the orders' shards: one plan per month of orders, with four islands each.

A shard's weight is the thousands of its orders' prices; every eighth shard
weighs next to nothing, so that plans have empty shards. Lists of islands and of
shards are in an order that differs from the one of their numbers.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from queries.fixtures import ORDERS, as_int, orders
from shardkit.operators import report
from shardkit.plans import batches
from shardkit.plans import rebalance as plan

ISLANDS = 4
GONE = [1]


def placement(spark: SparkSession, sf: str) -> DataFrame:
    light = F.when(F.col("o_totalprice") > 480000, 1).otherwise(0)
    weight = F.when(F.col("shard_no") % 8 == 0, light).otherwise(F.floor(F.col("o_totalprice") / 1000))
    return (
        orders(spark, sf)
        .groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("plan_id"), "island_no", "shard_no")
        .agg(F.sum(weight.cast("bigint")).alias("weight"))
        .withColumn("shard_ord", (F.col("shard_no") * 37 % 64).cast("bigint"))
    )


def islands(spark: SparkSession, sf: str) -> DataFrame:
    plans = orders(spark, sf).select(F.date_format("o_orderdate", "yyyy-MM").alias("plan_id")).distinct()
    numbers = F.explode(F.array(*[F.lit(n) for n in range(ISLANDS)])).alias("island_no")
    return plans.select("plan_id", numbers).withColumn("island_ord", as_int((F.col("island_no") * 3 + 1) % ISLANDS))


def _inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return placement(spark, sf), islands(spark, sf)


def island_share(spark: SparkSession, sf: str) -> DataFrame:
    return report.island_share(*_inputs(spark, sf))


def decommission(spark: SparkSession, sf: str) -> DataFrame:
    placed, listed = _inputs(spark, sf)
    after, _ = plan.decommission(plan.start(placed, listed), listed, GONE)
    return after.select("plan_id", "shard_no", "weight", "island_no")


def split_empty(spark: SparkSession, sf: str) -> DataFrame:
    rest, empty = plan.split_empty(plan.start(*_inputs(spark, sf)))
    both = rest.withColumn("is_empty", F.lit(False)).unionByName(empty.withColumn("is_empty", F.lit(True)))
    return both.select("plan_id", "shard_no", "weight", "is_empty")


def inject_uniform(spark: SparkSession, sf: str) -> DataFrame:
    placed, listed = _inputs(spark, sf)
    rest, empty = plan.split_empty(plan.start(placed, listed))
    after = plan.inject_uniform(rest, listed, empty)
    return after.select("plan_id", "shard_no", "island_no")


def balance_greedy(spark: SparkSession, sf: str) -> DataFrame:
    placed, listed = _inputs(spark, sf)
    after = plan.balance_greedy(plan.start(placed, listed), plan.island_loads(placed, listed))
    return after.select("plan_id", "shard_no", "weight", "from_island", "island_no")


def _decommission_moves(spark: SparkSession, sf: str) -> DataFrame:
    placed, listed = _inputs(spark, sf)
    after, _ = plan.decommission(plan.start(placed, listed), listed, GONE)
    return after.filter(F.col("island_no") != F.col("from_island")).withColumnRenamed("island_no", "to_island")


def diff_placements(spark: SparkSession, sf: str) -> DataFrame:
    placed, listed = _inputs(spark, sf)
    after, _ = plan.decommission(plan.start(placed, listed), listed, GONE)
    return plan.diff_placements(placed, after)


def _joined(shards: str = "shards"):
    number = F.transform(shards, lambda s: s["shard_no"].cast("string"))
    return F.array_join(number, ",").alias("shards")


def group_moves(spark: SparkSession, sf: str) -> DataFrame:
    groups = plan.group_moves(_decommission_moves(spark, sf))
    return groups.select("plan_id", "group_no", "from_island", "to_island", _joined())


def flatten_moves(spark: SparkSession, sf: str) -> DataFrame:
    return plan.flatten_moves(plan.group_moves(_decommission_moves(spark, sf)))


def balance_score(spark: SparkSession, sf: str) -> DataFrame:
    placed, listed = _inputs(spark, sf)
    first = placed.groupBy("plan_id").agg(F.min("shard_no").alias("shard_no")).withColumn("to_island", F.lit(3))
    before = plan.balance_score(placed, listed)
    after = plan.balance_score(placed, listed, first).withColumnRenamed("score", "score_after")
    return before.join(after, "plan_id")


def rebalance(spark: SparkSession, sf: str) -> DataFrame:
    moves, _ = plan.rebalance(*_inputs(spark, sf))
    groups = plan.group_moves(moves)
    return groups.select("plan_id", "group_no", "from_island", "to_island", _joined())


def rebalance_decommission(spark: SparkSession, sf: str) -> DataFrame:
    moves, _ = plan.rebalance(*_inputs(spark, sf), GONE)
    return moves.select("plan_id", "shard_no", "weight", "from_island", "to_island")


def future_placement(spark: SparkSession, sf: str) -> DataFrame:
    placed, listed = _inputs(spark, sf)
    _, after = plan.rebalance(placed, listed, GONE)
    return plan.future_placement(listed, after).select("plan_id", "island_no", "weight", _joined())


def island_share_after(spark: SparkSession, sf: str) -> DataFrame:
    placed, listed = _inputs(spark, sf)
    _, after = plan.rebalance(placed, listed)
    return report.island_share(after, listed)


def split_into_batches(spark: SparkSession, sf: str) -> DataFrame:
    moves = plan.flatten_moves(plan.group_moves(_decommission_moves(spark, sf)))
    batched = batches.split_into_batches(moves, ["move_no"], group=["plan_id"])
    return batched.select("plan_id", "move_no", "shard_no", "batch")


def split_into_batches_whole(spark: SparkSession, sf: str) -> DataFrame:
    rows = orders(spark, sf).select("o_totalprice", "o_orderkey")
    batched = batches.split_into_batches(rows, ["o_totalprice", "o_orderkey"], 7)
    return batched.groupBy("batch").agg(F.count(F.lit(1)).alias("orders"), F.sum("o_orderkey").alias("keys"))


QUERIES = {
    f.__name__: f
    for f in (
        island_share, decommission, split_empty, inject_uniform, balance_greedy, diff_placements, group_moves,
        flatten_moves, balance_score, rebalance, rebalance_decommission, future_placement, island_share_after,
        split_into_batches, split_into_batches_whole,
    )
}

_PLACED = f"""
{ORDERS}, placed AS (
  SELECT strftime(o_orderdate, '%Y-%m') AS plan_id, island_no, (island_no * 3 + 1) % 4 AS island_ord, shard_no,
         shard_no * 37 % 64 AS shard_ord,
         CAST(sum(CASE WHEN shard_no % 8 = 0 THEN (CASE WHEN o_totalprice > 480000 THEN 1 ELSE 0 END)
                  ELSE floor(o_totalprice / 1000) END) AS BIGINT) AS weight
  FROM ord GROUP BY ALL),
isl AS (
  SELECT plan_id, CAST(n AS INTEGER) AS island_no, CAST((n * 3 + 1) % 4 AS INTEGER) AS island_ord
  FROM (SELECT DISTINCT plan_id FROM placed), (SELECT unnest(range(4)) AS n))"""


def _after_decommission(gone: str) -> str:
    """placed2: the placement without the given islands; left2: the islands that stay, ranked."""
    return f"""
left2 AS (
  SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY island_ord) - 1 AS idx,
         count(*) OVER (PARTITION BY plan_id) AS n
  FROM isl WHERE island_no NOT IN ({gone})),
homeless AS (
  SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY island_ord, shard_ord) - 1 AS turn
  FROM placed WHERE island_no IN ({gone})),
placed2 AS (
  SELECT plan_id, shard_no, weight, shard_ord, island_no AS from_island, island_ord AS from_ord, island_no, island_ord,
         shard_ord AS pos
  FROM placed WHERE island_no NOT IN ({gone})
  UNION ALL
  SELECT h.plan_id, shard_no, weight, shard_ord, h.island_no, h.island_ord, l.island_no, l.island_ord, 1000000 + turn
  FROM homeless h JOIN left2 l ON l.plan_id = h.plan_id AND l.idx = h.turn % l.n)"""


_NONE = "-1"

_EMPTY = """
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY weight) AS rk, count(*) OVER (PARTITION BY plan_id) AS cnt
  FROM placed2),
judged AS (
  SELECT p.*, p.weight <= m.median * CAST(0.1 AS DOUBLE) AS is_empty
  FROM placed2 p JOIN (SELECT plan_id, weight AS median FROM ranked WHERE rk = cnt // 2 + 1) m USING (plan_id))"""

_ALL_FULL = "judged AS (SELECT *, false AS is_empty FROM placed2)"

# one step of the sequential stage per row: phase 0 looks at the heaviest shard left, phase 1 at the lightest
_GREEDY = """
heavy AS (
  SELECT plan_id, list({'no': shard_no, 'w': weight, 'isl': idx + 1} ORDER BY weight DESC, island_ord, pos) AS shards,
         sum(weight) AS total
  FROM (SELECT j.*, l.idx FROM judged j JOIN left2 l USING (plan_id, island_no)) WHERE NOT is_empty GROUP BY 1),
loads AS (
  SELECT plan_id, list(load ORDER BY idx) AS loads FROM (
    SELECT l.plan_id, l.idx, CAST(coalesce(sum(p.weight), 0) AS BIGINT) AS load
    FROM left2 l LEFT JOIN placed p USING (plan_id, island_no) GROUP BY 1, 2) GROUP BY 1),
steps AS (
  SELECT plan_id, shards, total / len(loads) AS desired, loads, 0 AS phase, 1 AS head, len(shards) AS tail,
         CAST(0 AS BIGINT) AS credit, CAST(NULL AS INTEGER) AS moved_no, CAST(NULL AS BIGINT) AS moved_to
  FROM heavy JOIN loads USING (plan_id)
  UNION ALL
  SELECT plan_id, shards, desired,
         CASE WHEN mv THEN after ELSE loads END,
         CASE WHEN phase = 0 AND NOT mv THEN 0 WHEN phase = 1 AND NOT mv THEN 0 ELSE 1 END,
         CASE WHEN phase = 0 THEN head + 1 ELSE head END,
         CASE WHEN phase = 1 AND mv THEN tail - 1 ELSE tail END,
         CASE WHEN NOT mv THEN credit WHEN phase = 0 THEN credit + s.w ELSE credit - s.w END,
         CASE WHEN mv THEN s.no END, CASE WHEN mv THEN target END
  FROM (
    SELECT *, CASE WHEN phase = 0
              THEN loads[s.isl] > desired AND (loads[target] + s.w <= desired
                   OR loads[s.isl] - loads[target] - s.w > CAST(0.75 AS DOUBLE) * s.w)
              ELSE loads[s.isl] > desired AND credit >= s.w AND loads[target] < loads[s.isl]
                   AND list_min(after) > list_min(loads) END AS mv
    FROM (
      SELECT *, list_transform(loads, lambda v, i: CASE WHEN i = s.isl THEN v - s.w WHEN i = target THEN v + s.w ELSE v END) AS after
      FROM (
        SELECT *, list_position(others, list_min(others)) AS target
        FROM (
          SELECT *, list_transform(loads, lambda v, i: CASE WHEN i = s.isl THEN 9000000000000000000 ELSE v END) AS others
          FROM (SELECT *, shards[CASE WHEN phase = 0 THEN head ELSE tail END] AS s FROM steps WHERE head <= tail)))))
),
moved AS (SELECT plan_id, moved_no AS shard_no, moved_to - 1 AS idx FROM steps WHERE moved_no IS NOT NULL),
turned AS (
  SELECT plan_id, shard_no, (row_number() OVER (PARTITION BY plan_id ORDER BY island_ord, pos) - 1) AS turn
  FROM judged WHERE is_empty),
final AS (
  SELECT j.plan_id, j.shard_no, j.weight, j.shard_ord, j.from_island, j.from_ord,
         coalesce(lm.island_no, lt.island_no, j.island_no) AS island_no
  FROM judged j
  LEFT JOIN moved m ON m.plan_id = j.plan_id AND m.shard_no = j.shard_no
  LEFT JOIN left2 lm ON lm.plan_id = m.plan_id AND lm.idx = m.idx
  LEFT JOIN turned t ON t.plan_id = j.plan_id AND t.shard_no = j.shard_no
  LEFT JOIN left2 lt ON lt.plan_id = t.plan_id AND lt.idx = t.turn % lt.n)"""


def planned_sql(placed: str, gone: str, empty: str = _EMPTY) -> str:
    """The whole plan in SQL, up to `final`, from CTEs `placed` and `isl`."""
    return f"WITH RECURSIVE {placed}, {_after_decommission(gone)}, {empty}, {_GREEDY}"


def _planned(gone: str, empty: str = _EMPTY) -> str:
    return planned_sql(_PLACED, gone, empty)


def _share(source: str) -> str:
    return f"""
SELECT plan_id, island_no, weight, shards,
       CAST(round(weight / CASE WHEN total = 0 THEN 1 ELSE total END * 100) AS INTEGER) AS percent
FROM (SELECT *, CAST(sum(weight) OVER (PARTITION BY plan_id) AS BIGINT) AS total FROM (
  SELECT i.plan_id, i.island_no, CAST(coalesce(sum(p.weight), 0) AS BIGINT) AS weight, count(p.shard_no) AS shards
  FROM isl i LEFT JOIN {source} p USING (plan_id, island_no) GROUP BY 1, 2))"""


_GONE = f"WITH {_PLACED}, {_after_decommission('1')}"

_GROUPS = """
SELECT plan_id, CAST(row_number() OVER (PARTITION BY plan_id ORDER BY first) AS INTEGER) AS group_no, from_island, to_island, shards
FROM (
  SELECT plan_id, from_island, island_no AS to_island, min(from_ord * 1000 + shard_ord) AS first,
         string_agg(CAST(shard_no AS VARCHAR), ',' ORDER BY from_ord, shard_ord) AS shards
  FROM {source} WHERE island_no <> from_island GROUP BY 1, 2, 3)"""

_MOVES = """
grouped AS (
  SELECT plan_id, from_island, island_no AS to_island, shard_no, weight, from_ord, shard_ord,
         min(from_ord * 1000 + shard_ord) OVER (PARTITION BY plan_id, from_island, island_no) AS first
  FROM placed2 WHERE island_no <> from_island),
singles AS (
  SELECT plan_id, from_island, to_island, shard_no, weight,
         row_number() OVER (PARTITION BY plan_id ORDER BY first, from_ord, shard_ord) AS move_no,
         count(*) OVER (PARTITION BY plan_id) AS cnt
  FROM grouped)"""

ORACLES = {
    "island_share": f"WITH {_PLACED} {_share('placed')}",
    "decommission": f"{_GONE} SELECT plan_id, shard_no, weight, island_no FROM placed2",
    "split_empty": f"""
        WITH {_PLACED}, {_after_decommission(_NONE)}, {_EMPTY}
        SELECT plan_id, shard_no, weight, is_empty FROM judged""",
    "inject_uniform": f"""
        WITH {_PLACED}, {_after_decommission(_NONE)}, {_EMPTY}, t AS (
          SELECT *, row_number() OVER (PARTITION BY plan_id, is_empty ORDER BY island_ord, pos) - 1 AS turn FROM judged)
        SELECT t.plan_id, shard_no, CASE WHEN is_empty THEN l.island_no ELSE t.island_no END AS island_no
        FROM t JOIN left2 l ON l.plan_id = t.plan_id AND l.idx = t.turn % l.n""",
    "balance_greedy": f"""
        {_planned(_NONE, _ALL_FULL)} SELECT plan_id, shard_no, weight, from_island, island_no FROM final""",
    "diff_placements": f"""
        {_GONE} SELECT plan_id, shard_no, from_island, island_no AS to_island FROM placed2 WHERE island_no <> from_island""",
    "group_moves": f"{_GONE} {_GROUPS.format(source='placed2')}",
    "flatten_moves": f"""
        {_GONE}, {_MOVES}
        SELECT plan_id, CAST(move_no AS INTEGER) AS move_no, from_island, to_island, shard_no, weight FROM singles""",
    "balance_score": f"""
        WITH {_PLACED}, firsts AS (SELECT plan_id, min(shard_no) AS shard_no FROM placed GROUP BY 1),
        shifted AS (
          SELECT p.plan_id, p.weight, CASE WHEN f.shard_no IS NULL THEN island_no ELSE 3 END AS island_no
          FROM placed p LEFT JOIN firsts f USING (plan_id, shard_no)),
        b AS (SELECT i.plan_id, i.island_no, coalesce(sum(weight), 0) AS w FROM isl i LEFT JOIN placed USING (plan_id, island_no) GROUP BY 1, 2),
        a AS (SELECT i.plan_id, i.island_no, coalesce(sum(weight), 0) AS w FROM isl i LEFT JOIN shifted USING (plan_id, island_no) GROUP BY 1, 2)
        SELECT plan_id, CAST(min(b.w) AS BIGINT) AS score, CAST(min(a.w) AS BIGINT) AS score_after
        FROM b JOIN a USING (plan_id, island_no) GROUP BY 1""",
    "rebalance": f"{_planned(_NONE)} {_GROUPS.format(source='final')}",
    "rebalance_decommission": f"""
        {_planned('1')}
        SELECT plan_id, shard_no, weight, from_island, island_no AS to_island FROM final WHERE island_no <> from_island""",
    "future_placement": f"""
        {_planned('1')}
        SELECT i.plan_id, i.island_no, CAST(coalesce(sum(weight), 0) AS BIGINT) AS weight,
               coalesce(string_agg(CAST(shard_no AS VARCHAR), ',' ORDER BY from_ord, shard_ord), '') AS shards
        FROM isl i LEFT JOIN final f USING (plan_id, island_no) GROUP BY 1, 2""",
    "island_share_after": f"{_planned(_NONE)} {_share('final')}",
    "split_into_batches": f"""
        {_GONE}, {_MOVES}, cut AS (SELECT *, (move_no * 3 - 1) // cnt AS raw FROM singles)
        SELECT plan_id, CAST(move_no AS INTEGER) AS move_no, shard_no,
               CAST(dense_rank() OVER (PARTITION BY plan_id ORDER BY raw) - 1 AS INTEGER) AS batch
        FROM cut""",
    "split_into_batches_whole": """
        WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS rn, count(*) OVER () AS n FROM orders)
        SELECT CAST((rn * 7 - 1) // n AS INTEGER) AS batch, count(*) AS orders, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM r GROUP BY 1""",
}
