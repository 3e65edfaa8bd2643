import pytest
from pyspark.sql import functions as F

from shardkit.functions.names import shard_name, shard_no
from shardkit.operators import registry as reg

PREFIX = "test_shard"


def names(df):
    return [r.shard for r in df.select("shard").orderBy("shard").collect()]


def shards(*numbers):
    return [f"{PREFIX}{n:04d}" for n in numbers]


def frame(spark, labels, status=None):
    if status is None:
        return spark.createDataFrame([(x,) for x in labels], "shard string")
    return spark.createDataFrame([(x, status) for x in labels], "shard string, status string")


def test_life_of_shards(spark):
    existing, registry = frame(spark, []), frame(spark, [], "active")
    active = lambda: reg.active_shards(registry, existing).first().shards
    assert active() == []
    for lo, hi in ((0, 1), (10, 11)):
        made = reg.missing_shards(existing, lo, hi, PREFIX)
        assert [r.shard for r in made.collect()] == shards(lo, hi)
        existing = existing.unionByName(made)
    assert reg.missing_shards(existing, 0, 1, PREFIX).collect() == []
    assert active() == []
    listed, registry = reg.activate_shards(registry, existing, 0, 1, PREFIX)
    assert names(listed) == shards(0, 1) == active()
    listed, registry = reg.activate_shards(registry, existing, 10, 11, PREFIX)
    assert names(listed) == shards(10, 11)
    assert active() == shards(0, 1, 10, 11)
    gone, registry = reg.drop_shards(registry, existing, frame(spark, []), 11, 1000, PREFIX)
    assert names(gone) == shards(11)
    existing = frame(spark, shards(0, 1, 10))
    assert active() == shards(0, 1, 10)
    assert names(registry.filter("status = 'active'")) == shards(0, 1, 10)
    stopped, registry = reg.deactivate_shards(registry, 1, 1, PREFIX)
    assert names(stopped) == shards(1)
    assert active() == shards(0, 10)
    for number in (0, 10):
        stopped, registry = reg.deactivate_shards(registry, number, prefix=PREFIX)
        assert names(stopped) == shards(number)
    assert active() == []


def test_activating_again_returns_the_whole_range(spark):
    existing, registry = frame(spark, shards(0, 1)), frame(spark, shards(0), "active")
    listed, registry = reg.activate_shards(registry, existing, 0, 1, PREFIX)
    assert names(listed) == shards(0, 1)
    assert registry.count() == 2


def test_activating_what_does_not_exist_fails(spark):
    with pytest.raises(ValueError, match="0002"):
        reg.activate_shards(frame(spark, [], "active"), frame(spark, shards(0, 1)), 0, 3, PREFIX)


def test_dropping_a_filled_shard_fails(spark):
    existing = frame(spark, shards(0, 1))
    with pytest.raises(ValueError, match="not empty"):
        reg.drop_shards(frame(spark, [], "active"), existing, frame(spark, shards(1, 1)), 0, 5, PREFIX)


@pytest.mark.parametrize("lo, hi", [(-1, 3), (0, 10000)])
def test_numbers_outside_the_domain_fail(spark, lo, hi):
    existing = frame(spark, [])
    with pytest.raises(ValueError):
        reg.missing_shards(existing, lo, hi)
    with pytest.raises(ValueError):
        reg.droppable_shards(existing, existing, lo, hi)


def test_inverted_ranges(spark):
    existing = frame(spark, shards(3, 4, 5))
    assert reg.shard_range(spark, 5, 3).collect() == []
    assert reg.missing_shards(existing, 5, 3, PREFIX).collect() == []
    with pytest.raises(ValueError):
        reg.droppable_shards(existing, existing, 5, 3, PREFIX)


def test_single_number_range(spark):
    assert [(r.shard_no, r.shard) for r in reg.shard_range(spark, 7).collect()] == [(7, "sh0007")]


def test_labels(spark):
    rows = spark.createDataFrame([(0,), (17,), (12345,)], "n int").select(shard_name(F.col("n")).alias("s"))
    assert [r.s for r in rows.collect()] == ["sh0000", "sh0017", "sh1234"]
    texts = ["sh0012", "a1b2", "none", "", None, "sh0001old20230109070954"]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select(shard_no(F.col("t")).alias("n"))
    assert [r.n for r in found.collect()] == [12, 1, None, None, None, 1]


def test_retired_labels(spark):
    retired = ["sh0101old20230109070954", "sh0001old", "sh0001old_5", "sh0002new"]
    kept = ["sh0001", "sh0001older", "xsh0001new"]
    assert names(reg.retired_shards(frame(spark, retired + kept))) == sorted(retired)


def test_reconcile(spark):
    registry = spark.createDataFrame([("a", "active"), ("b", "inactive"), ("c", "active")], "shard string, status string")
    existing = frame(spark, ["a", "b", "d"])
    state = lambda df: sorted((r.shard, r.status) for r in df.collect())
    assert state(reg.reconcile_active(registry, existing)) == [("a", "active"), ("b", "inactive")]
    new = reg.reconcile_active(registry, existing, frame(spark, ["d", "e"]))
    assert state(new) == [("a", "inactive"), ("b", "inactive"), ("d", "active")]


def test_duplicates(spark):
    rows = spark.createDataFrame([("a", 2), ("a", 1), ("a", 1), ("b", 1), ("b", 1)], "shard string, island_no int")
    assert [(r.shard, r.islands) for r in reg.duplicate_active(rows).collect()] == [("a", [1, 2])]


def test_allocation(spark):
    existing, registry = frame(spark, shards(1)), frame(spark, [], "active")
    created, existing, registry = reg.allocate_shards(registry, existing, 0, 2, False, PREFIX)
    assert names(created) == shards(0, 2) and names(existing) == shards(0, 1, 2)
    assert registry.collect() == []
    created, existing, registry = reg.allocate_shards(registry, existing, 0, 2, True, PREFIX)
    assert created.collect() == [] and names(registry) == shards(0, 1, 2)
