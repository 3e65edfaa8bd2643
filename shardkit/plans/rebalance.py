"""Plans that spread shards fairly over islands, many plans at once.

A plan is one row group `plan_id` (STRING) of two frames:

  islands    (plan_id, island_no INT, island_ord INT, …), also islands without shards
  placement  (plan_id, island_no INT, shard_no INT, shard_ord INT, weight BIGINT)

Results depend on the order of islands and of the shards on an island, which
island_ord and shard_ord state. The number of shards of a plan is bounded by the
domain of shard numbers, so a window or a group per plan is small however large
the tables are that the weights come from; plans run in parallel.

Inside a plan's stages every shard keeps its first island in `from_island`, and
`pos` is its place in the present island's list.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardkit.functions.names import shard_no
from shardkit.limits import MAX_SHARDS
from shardkit.operators.weights import drop_isolated_shard0
from shardkit.plans.greedy import KERNEL_COLUMNS, RESULT_SCHEMA, balance_kernel
from shardkit.session import settle

# Fixed value: part of the median up to which a shard counts as empty.
EMPTY_FRACTION = 0.1

# Shards put on an island come behind those it had.
_APPENDED = 1 << 32

Decommission = Sequence[int] | DataFrame

_SOURCE_ORDER = ["from_ord", "shard_ord"]


def plan_inputs(
    weights: DataFrame, sources: DataFrame, plan_id: str = "all", active: DataFrame | None = None, pin_shard0: bool = False
) -> tuple[DataFrame, DataFrame]:
    """One plan's (placement, islands) from weight rows (island_no, shard_no, weight).

    sources: (island_no, name) in the order of island_no. Islands that hold nothing
    but the global shard 0 take no part, neither as source nor as target. What an island holds is told by
    `active` (island_no, shard), also by labels without a number, which have no weight; else by the weights. With
    `pin_shard0` shard 0 stays where it is, also on islands that take part, and its weight does not count.
    """
    # a few rows per shard; the tables they were computed from are read once
    weights = settle(weights.select("island_no", "shard_no", "weight"))
    held = weights if active is None else settle(active.select("island_no", shard_no(F.col("shard")).alias("shard_no")))
    # a label without a number is one more
    held = held.select("island_no", F.coalesce("shard_no", F.lit(MAX_SHARDS)).alias("shard_no"))
    isolated = held.join(drop_isolated_shard0(held), "island_no", "left_anti").select("island_no").distinct()
    rest = weights.join(isolated, "island_no", "left_anti")
    if pin_shard0:
        rest = rest.filter(F.col("shard_no") != 0)
    number = F.col("island_no").cast("int")
    islands = sources.join(isolated, "island_no", "left_anti").select(
        F.lit(plan_id).alias("plan_id"), number.alias("island_no"), number.alias("island_ord")
    )
    placement = rest.select(
        F.lit(plan_id).alias("plan_id"),
        number.alias("island_no"),
        F.col("shard_no").cast("int"),
        F.col("shard_no").cast("bigint").alias("shard_ord"),
        F.col("weight").cast("bigint"),
    )
    return placement, islands


def islands_named(sources: DataFrame, names: Sequence[str]) -> list[int]:
    """Numbers of sources by name, for the list to decommission; an unknown name fails the call."""
    known = {r.name: r.island_no for r in sources.select("name", "island_no").collect()}
    unknown = [name for name in names if name not in known]
    if unknown:
        raise ValueError(f"no such island in the list: {unknown[0]}")
    return [known[name] for name in names]


def start(placement: DataFrame, islands: DataFrame) -> DataFrame:
    """Placement with each shard's first island remembered, ready for the stages below.

    A shard on an island that its plan does not list fails the job.
    """
    order = islands.select("plan_id", "island_no", "island_ord")
    joined = placement.join(order, ["plan_id", "island_no"], "left")
    unknown = F.raise_error(F.concat(F.lit("island is not listed: "), F.col("island_no").cast("string")))
    known = F.when(F.col("island_ord").isNotNull(), F.col("island_ord")).otherwise(unknown.cast("int"))
    return joined.withColumn("island_ord", known).select(
        "plan_id",
        "shard_no",
        "weight",
        "shard_ord",
        F.col("island_no").alias("from_island"),
        F.col("island_ord").alias("from_ord"),
        "island_no",
        "island_ord",
        F.col("shard_ord").cast("bigint").alias("pos"),
    )


def island_loads(placement: DataFrame, islands: DataFrame) -> DataFrame:
    """Islands with the weight of their shards, 0 without shards."""
    loads = placement.groupBy("plan_id", "island_no").agg(F.sum("weight").alias("load"))
    return (
        islands.select("plan_id", "island_no", "island_ord")
        .join(loads, ["plan_id", "island_no"], "left")
        .withColumn("load", F.coalesce("load", F.lit(0)))
    )


def _marked(islands: DataFrame, nos: Decommission) -> DataFrame:
    if isinstance(nos, DataFrame):
        gone = nos.select("plan_id", "island_no").distinct().withColumn("gone", F.lit(True))
        marked = islands.join(gone, ["plan_id", "island_no"], "left")
        return marked.withColumn("gone", F.coalesce("gone", F.lit(False)))
    return islands.withColumn("gone", F.col("island_no").isin(list(nos)))


def remaining_islands(islands: DataFrame, nos: Decommission) -> DataFrame:
    """Islands without the decommissioned ones; a plan left without any fails the job."""
    plan = Window.partitionBy("plan_id")
    left = F.sum(F.when(F.col("gone"), 0).otherwise(1)).over(plan)
    message = F.concat(F.lit("cannot decommission all islands of plan "), F.col("plan_id"))
    keep = F.when(F.col("left") > 0, ~F.col("gone")).otherwise(F.raise_error(message).cast("boolean"))
    return _marked(islands, nos).withColumn("left", left).filter(keep).drop("left", "gone")


def _deal(shards: DataFrame, flag: str, islands: DataFrame, step: int) -> DataFrame:
    """Put flagged shards on their plan's islands in turn, the first island first, not looking at weights."""
    listed = islands.groupBy("plan_id").agg(
        F.sort_array(F.collect_list(F.struct("island_ord", "island_no"))).alias("listed")
    )
    # flagged shards come first, so they alone are counted, without another shuffle of the plan's rows
    order = Window.partitionBy("plan_id").orderBy(F.col(flag).desc(), "island_ord", "pos")
    turn = F.row_number().over(order) - 1
    dealt = (
        shards.withColumn("turn", turn)
        .join(listed, "plan_id")
        .withColumn("dealt", F.get("listed", F.col("turn") % F.size("listed")))
        .drop("listed")
    )

    def pick(new: Column, old: str) -> Column:
        return F.when(F.col(flag), new).otherwise(F.col(old))

    return dealt.withColumns(
        {
            "island_no": pick(F.col("dealt.island_no"), "island_no"),
            "island_ord": pick(F.col("dealt.island_ord"), "island_ord"),
            "pos": pick(F.col("turn") + F.lit(step * _APPENDED), "pos"),
        }
    ).drop("dealt", "turn")


def decommission(started: DataFrame, islands: DataFrame, nos: Decommission) -> tuple[DataFrame, DataFrame]:
    """Empty the given islands: (placement, remaining islands)."""
    left = remaining_islands(islands, nos)
    marks = _marked(islands, nos).select("plan_id", "island_no", "gone")
    marked = started.join(marks, ["plan_id", "island_no"], "left")
    return _deal(marked, "gone", left, 1).drop("gone"), left


def mark_empty(started: DataFrame, fraction: float = EMPTY_FRACTION) -> DataFrame:
    """Adds is_empty: the shard weighs at most `fraction` of its plan's upper median."""
    plan = Window.partitionBy("plan_id")
    ranked = started.withColumn("rank", F.row_number().over(plan.orderBy("weight"))).withColumn(
        "middle", F.floor(F.count(F.lit(1)).over(plan) / 2) + 1
    )
    median = F.max(F.when(F.col("rank") == F.col("middle"), F.col("weight"))).over(plan)
    limit = F.col("median").cast("double") * F.lit(float(fraction))
    judged = ranked.withColumn("median", median).withColumn("is_empty", F.col("weight") <= limit)
    return judged.drop("rank", "middle", "median")


def split_empty(started: DataFrame, fraction: float = EMPTY_FRACTION) -> tuple[DataFrame, DataFrame]:
    """Split off the empty shards: (rest, empty)."""
    judged = mark_empty(started, fraction)
    return judged.filter(~F.col("is_empty")).drop("is_empty"), judged.filter("is_empty").drop("is_empty")


def balance_greedy(started: DataFrame, loads: DataFrame) -> DataFrame:
    """Placement after moving large shards off overloaded islands, and small ones along.

    `loads` are the remaining islands with the weights they had at the start
    of the plan: shards put on or taken off by the stages before do not count.
    Shards marked is_empty are left out and stay where they are.
    """
    if "is_empty" not in started.columns:
        started = started.withColumn("is_empty", F.lit(False))
    kernel = balance_kernel(MAX_SHARDS, 2 * _APPENDED)
    # under new column identities, as both sides may come from one table
    islands = loads.select(*[F.col(c).alias(c) for c in ("plan_id", "island_no", "island_ord", "load")])
    pairs = started.select(*KERNEL_COLUMNS).groupBy("plan_id").cogroup(islands.groupBy("plan_id"))
    return pairs.applyInArrow(kernel, RESULT_SCHEMA)


def inject_uniform(started: DataFrame, islands: DataFrame, shards: DataFrame) -> DataFrame:
    """Placement with `shards` put on the plan's islands in turn."""
    both = started.withColumn("added", F.lit(False)).unionByName(shards.withColumn("added", F.lit(True)))
    return _deal(both, "added", islands, 3).drop("added")


def diff_placements(before: DataFrame, after: DataFrame) -> DataFrame:
    """Shards whose island differs: (plan_id, shard_no, from_island, to_island)."""
    old = before.select("plan_id", "shard_no", F.col("island_no").alias("from_island"))
    new = after.select("plan_id", "shard_no", F.col("island_no").alias("to_island"))
    return old.join(new, ["plan_id", "shard_no"]).filter(F.col("from_island") != F.col("to_island"))


def _shard(entry: Column) -> Column:
    return F.struct(entry["shard_no"].alias("shard_no"), entry["weight"].alias("weight"))


def group_moves(moves: DataFrame) -> DataFrame:
    """One row per (plan, from, to): its shards in source order, and its place among the groups.

    moves: (plan_id, from_island, to_island, from_ord, shard_ord, shard_no, weight)
    """
    place = F.struct(*_SOURCE_ORDER)
    grouped = moves.groupBy("plan_id", "from_island", "to_island").agg(
        F.min(place).alias("first"),
        F.sort_array(F.collect_list(F.struct(*_SOURCE_ORDER, "shard_no", "weight"))).alias("listed"),
    )
    return grouped.select(
        "plan_id",
        F.row_number().over(Window.partitionBy("plan_id").orderBy("first")).alias("group_no"),
        "from_island",
        "to_island",
        F.transform("listed", _shard).alias("shards"),
    )


def flatten_moves(groups: DataFrame) -> DataFrame:
    """Grouped moves as single ones, numbered in order."""
    single = groups.select("plan_id", "group_no", "from_island", "to_island", F.posexplode("shards").alias("at", "s"))
    order = Window.partitionBy("plan_id").orderBy("group_no", "at")
    return single.select(
        "plan_id", F.row_number().over(order).alias("move_no"), "from_island", "to_island", "s.shard_no", "s.weight"
    )


def future_placement(islands: DataFrame, after: DataFrame) -> DataFrame:
    """Every island, emptied ones too, with its shards in the order they had at the start."""
    entry = F.struct(*_SOURCE_ORDER, "shard_no", "weight")
    lists = after.groupBy("plan_id", "island_no").agg(
        F.sort_array(F.collect_list(entry)).alias("listed"), F.sum("weight").alias("weight")
    )
    none = F.array().cast("array<struct<shard_no:int,weight:bigint>>")
    return islands.select("plan_id", "island_no", "island_ord").join(lists, ["plan_id", "island_no"], "left").select(
        "plan_id",
        "island_no",
        "island_ord",
        F.coalesce("weight", F.lit(0)).alias("weight"),
        F.coalesce(F.transform("listed", _shard), none).alias("shards"),
    )


def balance_score(placement: DataFrame, islands: DataFrame, move: DataFrame | None = None) -> DataFrame:
    """Per plan, the weight of its lightest island: the higher, the fairer.

    `move` (plan_id, shard_no, to_island) gives the score after these moves.
    """
    if move is not None:
        targets = move.select("plan_id", "shard_no", "to_island")
        placement = placement.join(targets, ["plan_id", "shard_no"], "left").withColumn(
            "island_no", F.coalesce("to_island", "island_no")
        )
    return island_loads(placement, islands).groupBy("plan_id").agg(F.min("load").alias("score"))


def rebalance(
    placement: DataFrame,
    islands: DataFrame,
    nos: Decommission = (),
    fraction: float = EMPTY_FRACTION,
) -> tuple[DataFrame, DataFrame]:
    """Plan which shards move: (moves, placement afterwards).

    moves: one row per shard with from_island and to_island; see group_moves.
    """
    columns = ["plan_id", "island_no", "shard_no", "shard_ord", "weight"]
    # weights and islands are read once; each stage below works on these small tables
    placement = settle(placement.select(*columns))
    islands = settle(islands.select("plan_id", "island_no", "island_ord"))
    started, left = decommission(start(placement, islands), islands, nos)
    balanced = balance_greedy(mark_empty(started, fraction), island_loads(placement, left))
    after = settle(_deal(balanced, "is_empty", left, 3).drop("is_empty"))
    moves = after.filter(F.col("island_no") != F.col("from_island")).withColumnRenamed("island_no", "to_island")
    return moves, after
