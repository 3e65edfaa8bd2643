"""Properties of plans over weights made by a rule."""

import pytest
from pyspark.sql import functions as F

from shardkit.operators.report import island_share
from shardkit.plans import rebalance as plan
from shardkit.plans.batches import split_into_batches


def many_plans(spark, plans=40, shards=120, islands=6):
    """Uneven placements: weights vary by number, one shard per plan weighs 20 times as much as the others."""
    placement = (
        spark.range(plans * shards)
        .select(
            F.concat(F.lit("p"), F.floor(F.col("id") / shards)).alias("plan_id"),
            (F.col("id") % shards).cast("int").alias("shard_no"),
            F.floor(F.col("id") / shards).alias("k"),
        )
        .withColumn("island_no", F.least(F.floor(F.sqrt(F.col("shard_no") / 4)), F.lit(islands - 2)).cast("int"))
        .withColumn("shard_ord", F.col("shard_no").cast("bigint"))
        .withColumn("weight", 2_000_000 + (F.col("shard_no") * 7919 + F.col("k") * 104729) % 2_500_000)
        .withColumn("weight", F.when(F.col("shard_no") == F.col("k"), 60_000_000).otherwise(F.col("weight")).cast("bigint"))
        .withColumn("weight", F.when(F.col("shard_no") % 11 == 5, F.col("shard_no").cast("bigint")).otherwise(F.col("weight")))
        .drop("k")
    )
    numbers = F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island_no")
    listed = placement.select("plan_id").distinct().select("plan_id", numbers)
    return placement, listed.withColumn("island_ord", F.col("island_no"))


@pytest.mark.parametrize("gone", [[], [2], [0, 4]])
def test_invariants(spark, gone):
    placement, islands = many_plans(spark)
    moves, after = plan.rebalance(placement, islands, gone)
    before = {(r.plan_id, r.shard_no): (r.island_no, r.weight) for r in placement.collect()}
    now = {(r.plan_id, r.shard_no): (r.island_no, r.weight) for r in after.collect()}
    assert before.keys() == now.keys()
    assert all(before[k][1] == now[k][1] for k in before)
    assert not {no for no, _ in now.values()} & set(gone)
    moved = {(r.plan_id, r.shard_no): (r.from_island, r.to_island) for r in moves.collect()}
    assert moved == {k: (before[k][0], now[k][0]) for k in before if before[k][0] != now[k][0]}

    heaviest = lambda state: {
        p: max(sum(w for (q, _), (no, w) in state.items() if q == p and no == i) for i in range(6))
        for p in {p for p, _ in state}
    }
    if not gone:
        old, new = heaviest(before), heaviest(now)
        assert all(new[p] <= old[p] for p in old)
        assert sum(new.values()) < 0.75 * sum(old.values())


def test_shares_add_up(spark):
    placement, islands = many_plans(spark, 3)
    _, after = plan.rebalance(placement, islands)
    rows = island_share(after, islands).collect()
    assert len(rows) == 18
    for p in ("p0", "p1", "p2"):
        mine = [r for r in rows if r.plan_id == p]
        assert 97 <= sum(r.percent for r in mine) <= 103
        assert sum(r.shards for r in mine) == 120


def test_share_of_a_plan_without_weight(spark):
    placement = spark.createDataFrame([("p", 0, 1, 0, 0)], "plan_id string, island_no int, shard_no int, shard_ord bigint, weight bigint")
    islands = spark.createDataFrame([("p", 0, 0), ("p", 1, 1)], "plan_id string, island_no int, island_ord int")
    rows = {r.island_no: (r.percent, r.weight, r.shards) for r in island_share(placement, islands).collect()}
    assert rows == {0: (0, 0, 1), 1: (0, 0, 0)}


def test_upper_median_counts(spark):
    rows = [("p", 0, n, n, w) for n, w in enumerate([1, 20, 10, 400])]
    placement = spark.createDataFrame(rows, "plan_id string, island_no int, shard_no int, shard_ord bigint, weight bigint")
    islands = spark.createDataFrame([("p", 0, 0)], "plan_id string, island_no int, island_ord int")
    rest, empty = plan.split_empty(plan.start(placement, islands))
    # the upper median of 1, 10, 20, 400 is 20, so 2 is the limit; with the lower one it would be 1
    assert [r.weight for r in empty.collect()] == [1]
    assert sorted(r.weight for r in rest.collect()) == [10, 20, 400]


def test_too_many_shards_in_a_plan_fail(spark):
    from shardkit.plans.greedy import balance_kernel

    import pyarrow as pa

    columns = {
        "plan_id": pa.array(["p", "p"]), "shard_no": pa.array([0, 1], pa.int32()), "weight": pa.array([1, 2]),
        "shard_ord": pa.array([0, 1]), "from_island": pa.array([0, 0], pa.int32()),
        "from_ord": pa.array([0, 0], pa.int32()), "island_no": pa.array([0, 0], pa.int32()),
        "island_ord": pa.array([0, 0], pa.int32()), "pos": pa.array([0, 1]), "is_empty": pa.array([False, False]),
    }
    islands = pa.table({"island_no": [0], "island_ord": [0], "load": [3]})
    with pytest.raises(ValueError, match="more shards"):
        balance_kernel(1, 0)(pa.table(columns), islands)


@pytest.mark.parametrize("count, n, sizes", [
    (10, 3, [3, 3, 4]), (2, 3, [1, 1]), (0, 3, []), (1, 1, [1]), (61, 7, None), (15, 11, None), (1000, 13, None),
])
@pytest.mark.parametrize("grouped", [True, False])
def test_batches_lose_nothing(spark, count, n, sizes, grouped):
    rows = spark.range(count).withColumn("g", F.lit("all")).repartition(3)
    got = split_into_batches(rows, ["id"], n, ["g"] if grouped else None).orderBy("id").collect()
    assert [r.id for r in got] == list(range(count))
    batches = [r.batch for r in got]
    assert batches == sorted(batches)
    lengths = [batches.count(b) for b in range(max(batches, default=-1) + 1)]
    assert all(lengths) and len(lengths) == min(n, count)
    assert not lengths or max(lengths) - min(lengths) <= 1
    if sizes is not None:
        assert lengths == sizes


def test_inputs_leave_out_islands_with_only_shard_0(spark):
    weights = spark.createDataFrame(
        [(0, 0, 5), (1, 1, 10), (1, 2, 10), (2, 0, 1), (2, 3, 1)], "island_no int, shard_no int, weight bigint"
    )
    sources = spark.createDataFrame([(n, f"db{n}") for n in range(4)], "island_no int, name string")
    placement, islands = plan.plan_inputs(weights, sources)
    assert sorted(r.island_no for r in islands.collect()) == [1, 2, 3]
    assert sorted((r.island_no, r.shard_no) for r in placement.collect()) == [(1, 1), (1, 2), (2, 0), (2, 3)]
    assert plan.islands_named(sources, ["db2", "db0"]) == [2, 0]
    with pytest.raises(ValueError, match="db9"):
        plan.islands_named(sources, ["db9"])


def test_decommissioning_an_island_left_out_does_nothing(spark):
    weights = spark.createDataFrame([(0, 0, 5), (1, 1, 10), (2, 2, 10)], "island_no int, shard_no int, weight bigint")
    sources = spark.createDataFrame([(n, f"db{n}") for n in range(3)], "island_no int, name string")
    moves, _ = plan.rebalance(*plan.plan_inputs(weights, sources), [0])
    assert moves.collect() == []
