"""Plans and file layouts that hold at scale: pruning, partial aggregation, and shards of uneven size."""

import glob
import io
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from shardkit import limits
from shardkit.limits import broadcast_within
from shardkit.operators import relocate
from shardkit.operators import weights as wts
from shardkit.operators.registry import missing_shards
from shardkit.plans.batches import split_into_batches
from shardkit.session import scratch_path
from shardkit.sources.layout import read_placed, write_placed
from shardkit.streaming.apply import latest_changes, merge_changes


def plan_of(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain()
    return out.getvalue()


@pytest.fixture
def small_partitions(spark):
    """Sizes at which a few MB of test rows behave like a shard that is too large for one task."""
    changed = {
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "700000",
        "spark.sql.shuffle.partitions": "64",
    }
    before = {k: spark.conf.get(k) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def skewed(spark, rows=200_000):
    """A third of all rows in shard 3, the rest over 30 shards."""
    number = F.when(F.col("id") % 3 == 0, 3).otherwise(10 + F.floor(F.col("id") / 3) % 30).cast("int")
    text = F.sha2(F.col("id").cast("string"), 256)
    return spark.range(0, rows, 1, 8).select(number.alias("shard_no"), "id", text.alias("v"))


def test_hot_shard_is_written_by_many_tasks(spark, small_partitions):
    path = scratch_path(spark, "skewed")
    df = skewed(spark)
    places = spark.range(64).select(F.col("id").cast("int").alias("shard_no"), (F.col("id") % 4).cast("int").alias("island_no"))
    write_placed(df, places, path)
    files = {n: len(glob.glob(f"{path}/island_no=*/shard_no={n}/*.parquet")) for n in (3, 10, 20)}
    assert files[3] >= 4
    assert files[10] <= 2 and files[20] <= 2
    stored = read_placed(spark, path)
    assert stored.count() == 200_000
    assert stored.filter("shard_no = 3").agg(F.count_distinct("id")).first()[0] == df.filter("shard_no = 3").count()


def test_shard_filter_selects_directories(spark):
    path = scratch_path(spark, "pruned")
    places = spark.range(64).select(F.col("id").cast("int").alias("shard_no"), F.lit(0).alias("island_no"))
    write_placed(skewed(spark, 1000), places, path)
    plan = plan_of(read_placed(spark, path).filter("shard_no = 12 AND id > 5").select("id"))
    assert "PartitionFilters: [isnotnull(shard_no" in plan
    assert "PushedFilters: [IsNotNull(id), GreaterThan(id,5)]" in plan
    assert "ReadSchema: struct<id:bigint>" in plan


def test_weights_aggregate_before_the_shuffle(spark):
    df = skewed(spark, 1000).withColumn("shard", F.col("shard_no").cast("string"))
    active = spark.createDataFrame([("3",)], "shard string")
    plan = plan_of(wts.custom_weights(df, [F.count(F.lit(1)).alias("n"), F.sum("id").alias("s")], active))
    assert "partial_count(1), partial_sum(id" in plan
    existing = df.select(F.concat(F.lit("sh"), F.lpad("shard", 4, "0")).alias("shard"))
    plan = plan_of(missing_shards(existing, 0, 50))
    below = plan[plan.index("HashAggregate"):]
    assert below.index("Exchange hashpartitioning") < below.rindex("HashAggregate")


def test_hot_key_of_a_change_stream(spark):
    """A third of all changes on one key end as one row, combined before the shuffle."""
    key = F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id"))
    changes = spark.range(30_000).select(
        F.lit(1).alias("shard_no"), key.alias("key"), F.lit("U").alias("op"), F.col("id").alias("lsn"),
        F.struct(F.col("id").cast("string").alias("v")).alias("payload"),
    )
    latest = latest_changes(changes, ["key"])
    assert "partial_max_by" in plan_of(latest)
    assert latest.filter("key = 0").first().lsn == 29_997
    base = spark.range(10).select(F.lit(1).alias("shard_no"), F.col("id").alias("key"), F.lit("old").alias("v"))
    merged = merge_changes(base, changes, ["key"])
    assert merged.count() == 10 + 20_000 - 6
    assert merged.filter("key = 0").first().v == "29997"


def test_broadcast_only_within_its_bound(spark):
    lookup = spark.range(50)
    big = spark.range(1000).withColumn("v", F.lit(1))
    hint = lambda df: df._jdf.queryExecution().logical().toString()
    assert "broadcast" in hint(broadcast_within(lookup, 50))
    assert "broadcast" not in hint(broadcast_within(lookup, 49))
    assert big.join(broadcast_within(lookup, 49), "id").count() == 50


def test_whole_table_batches_do_not_use_one_task(spark):
    rows = spark.range(0, 5000, 1, 8).withColumn("k", F.lit("same"))
    batched = split_into_batches(rows, ["k", "id"], 9)
    assert "Window" not in plan_of(batched)
    counts = [r["count"] for r in batched.groupBy("batch").count().orderBy("batch").collect()]
    assert len(counts) == 9 and sum(counts) == 5000 and max(counts) - min(counts) <= 1


def test_moved_rows_are_not_shuffled(spark):
    """Shards of the stored layout are copied by the tasks that read them, from their directories only."""
    places = spark.range(64).select(F.col("id").cast("int").alias("shard_no"), (F.col("id") % 4).cast("int").alias("island_no"))
    store = relocate.ShardStore.create(spark, scratch_path(spark, "store"), {"t": skewed(spark, 1000)}, places)
    moves = spark.createDataFrame([(3, 3, 0), (12, 0, 1)], "shard_no int, from_island int, to_island int")
    own = [r for r in store.registry_now("active").collect() if r.shard_no in (3, 12)]
    rows = relocate.moved_rows(store.rows_of("t", own), moves, "c-x")
    rows.collect()
    plan = plan_of(rows)
    main = [line for line in plan[: plan.index("Initial Plan")].split("\n") if "Subquery" not in line]
    scan = next(i for i, line in enumerate(main) if "Scan parquet" in line and "v#" in line)
    above = [line for line in main[:scan] if "Exchange hashpartitioning" in line]
    assert not above
    folders = {f.rsplit("/", 3)[1] + "/" + f.rsplit("/", 3)[2] for f in rows.inputFiles() if "/t/copy=" in f}
    assert folders == {"island_no=3/shard_no=3", "island_no=0/shard_no=12"}


@pytest.mark.parametrize("bound", [10, 10_000])
def test_changes_merge_the_same_with_and_without_broadcast(spark, monkeypatch, bound):
    from shardkit.streaming import apply

    monkeypatch.setattr(apply, "fits", lambda df: df.count() <= bound)
    base = spark.range(500).select((F.col("id") % 4).cast("int").alias("shard_no"), F.col("id").alias("key"), F.lit("old").alias("v"))
    changes = spark.range(0, 600, 2).select(
        (F.col("id") % 4).cast("int").alias("shard_no"), F.col("id").alias("key"),
        F.when(F.col("id") % 3 == 0, "D").otherwise("U").alias("op"), F.col("id").alias("lsn"),
        F.struct(F.lit("new").alias("v")).alias("payload"),
    )
    got = {r.key: r.v for r in merge_changes(base, changes, ["key"]).collect()}
    want = {k: "old" for k in range(1, 500, 2)} | {k: "new" for k in range(0, 600, 2) if k % 3}
    assert got == want


def test_broadcasts_are_bounded_in_bytes(spark):
    keys = spark.range(1_000).select(F.lpad(F.col("id").cast("string"), 100, "x").alias("key"))
    assert limits.fits(keys)
    assert limits.fits(keys, max_bytes=100_000)
    assert not limits.fits(keys, max_bytes=99_999)
