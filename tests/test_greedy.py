"""Properties of the sequential stage on single plans, without Spark."""

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from shardkit.plans.greedy import KERNEL_COLUMNS, balance_kernel

MOVED = 1 << 20

plans = st.lists(
    st.lists(st.one_of(st.integers(0, 20), st.integers(0, 10**12)), max_size=12), min_size=1, max_size=6
)


def run(lists, empty=frozenset()):
    rows = [(i, w) for i, weights in enumerate(lists) for w in weights]
    count = len(rows)
    island = pa.array([i for i, _ in rows], pa.int32())
    shards = pa.table({
        "plan_id": pa.array(["p"] * count, pa.string()),
        "shard_no": pa.array(range(count), pa.int32()),
        "weight": pa.array([w for _, w in rows], pa.int64()),
        "shard_ord": pa.array(range(count), pa.int64()),
        "from_island": island, "from_ord": island, "island_no": island, "island_ord": island,
        "pos": pa.array(range(count), pa.int64()),
        "is_empty": pa.array([n in empty for n in range(count)], pa.bool_()),
    })
    islands = pa.table({
        "island_no": pa.array(range(len(lists)), pa.int32()),
        "island_ord": pa.array(range(len(lists)), pa.int32()),
        "load": pa.array([sum(weights) for weights in lists], pa.int64()),
    })
    return shards, balance_kernel(10_000, MOVED)(shards, islands)


def loads(table, count):
    sums = [0] * count
    for island, weight in zip(table["island_no"].to_pylist(), table["weight"].to_pylist()):
        sums[island] += weight
    return sums


@settings(max_examples=300, deadline=None)
@given(plans)
def test_no_island_ends_heavier_or_lighter_than_the_extremes(lists):
    before, after = run(lists)
    old, new = loads(before, len(lists)), loads(after, len(lists))
    assert sum(old) == sum(new)
    assert max(new) <= max(old) and min(new) >= min(old)


@settings(max_examples=300, deadline=None)
@given(plans)
def test_shards_stay_whole_and_move_once(lists):
    before, after = run(lists)
    assert after.schema == before.schema and after.column_names == KERNEL_COLUMNS
    same = [c for c in KERNEL_COLUMNS if c not in ("island_no", "island_ord", "pos")]
    assert after.select(same) == before.select(same)
    moved = [p - MOVED for p in after["pos"].to_pylist() if p >= MOVED]
    assert sorted(moved) == list(range(len(moved)))
    changed = [a != b for a, b in zip(before["island_no"].to_pylist(), after["island_no"].to_pylist())]
    assert sum(changed) == len(moved)


@settings(max_examples=100, deadline=None)
@given(plans, st.sets(st.integers(0, 71)))
def test_empty_shards_stay_where_they_are(lists, empty):
    before, after = run(lists, empty)
    for number, old, new in zip(before["shard_no"].to_pylist(), before["island_no"].to_pylist(), after["island_no"].to_pylist()):
        assert number not in empty or old == new


@given(st.lists(st.integers(0, 100), max_size=10))
def test_one_island_has_nowhere_to_move_to(weights):
    before, after = run([weights])
    assert before == after
