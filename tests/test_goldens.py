"""Plans with known moves, all computed as one set of plans."""

import pytest

from shardkit.plans.rebalance import future_placement, group_moves, rebalance

# Name -> (islands with the weights of their shards, decommissioned islands, moves, islands afterwards).
CASES = {
    "no-op, one island": ({"m1": [1]}, [], [], {"m1": [1]}),
    "no-op, first filled": ({"m1": [1], "m2": []}, [], [], {"m1": [1], "m2": []}),
    "no-op, second filled": ({"m1": [], "m2": [1]}, [], [], {"m1": [], "m2": [1]}),
    "smallest out": ({"m1": [1, 2], "m2": []}, [], [("m1", "m2", [1])], {"m1": [2], "m2": [1]}),
    "largest out": ({"m1": [1, 2, 3, 6], "m2": []}, [], [("m1", "m2", [6])], {"m1": [1, 2, 3], "m2": [6]}),
    "many small": ({"m1": [1, 2, 3, 7], "m2": []}, [], [("m1", "m2", [7])], {"m1": [1, 2, 3], "m2": [7]}),
    "huge shards": (
        {"m1": [10000, 100, 1, 2, 3, 4, 5], "m2": [], "m3": [], "m4": [], "m5": []},
        [],
        [("m1", "m2", [100]), ("m1", "m5", [1, 2, 3]), ("m1", "m4", [4]), ("m1", "m3", [5])],
        {"m1": [10000], "m2": [100], "m3": [5], "m4": [4], "m5": [1, 2, 3]},
    ),
    "zero weights": (
        {"m1": [0] * 10, "m2": [], "m3": [], "m4": []},
        [],
        [("m1", "m2", [0, 0, 0]), ("m1", "m3", [0, 0]), ("m1", "m4", [0, 0])],
        {"m1": [0, 0, 0], "m2": [0, 0, 0], "m3": [0, 0], "m4": [0, 0]},
    ),
    "zero and other weights": (
        {"m1": [1, 2, 3, 4, 5, 6, 0, 0, 0, 0, 0], "m2": [], "m3": [], "m4": []},
        [],
        [("m1", "m4", [1, 2, 3, 0]), ("m1", "m3", [5, 0]), ("m1", "m2", [6, 0])],
        {"m1": [4, 0, 0], "m2": [6, 0], "m3": [5, 0], "m4": [1, 2, 3, 0]},
    ),
    "decommission one": (
        {"m1": [1, 2], "m2": [3, 4], "m3": [5, 6]},
        ["m2"],
        [("m2", "m1", [3]), ("m2", "m3", [4]), ("m3", "m1", [6])],
        {"m1": [1, 2, 3, 6], "m2": [], "m3": [4, 5]},
    ),
    "decommission two": (
        {"m1": [1, 2], "m2": [3, 4], "m3": [5, 6]},
        ["m1", "m2"],
        [("m1", "m3", [1, 2]), ("m2", "m3", [3, 4])],
        {"m1": [], "m2": [], "m3": [1, 2, 3, 4, 5, 6]},
    ),
    "two zero, two equal": (
        {"m1": [0, 134, 134, 0], "m2": [], "m3": [], "m4": []},
        [],
        [("m1", "m2", [134, 0])],
        {"m1": [0, 134], "m2": [134, 0], "m3": [], "m4": []},
    ),
}


def frames(spark, cases):
    islands, placement, gone = [], [], []
    for plan, (lists, nos, *_) in cases.items():
        number = 0
        for at, (name, weights) in enumerate(lists.items()):
            islands.append((plan, at, at, name))
            gone += [(plan, at)] if name in nos else []
            for order, weight in enumerate(weights):
                placement.append((plan, at, number, order, weight))
                number += 1
    return (
        spark.createDataFrame(placement, "plan_id string, island_no int, shard_no int, shard_ord bigint, weight bigint"),
        spark.createDataFrame(islands, "plan_id string, island_no int, island_ord int, name string"),
        spark.createDataFrame(gone, "plan_id string, island_no int"),
    )


@pytest.fixture(scope="module")
def planned(spark):
    placement, islands, gone = frames(spark, CASES)
    moves, after = rebalance(placement, islands, gone)
    groups = {}
    for r in group_moves(moves).orderBy("plan_id", "group_no").collect():
        names = list(CASES[r.plan_id][0])
        groups.setdefault(r.plan_id, []).append(
            (names[r.from_island], names[r.to_island], [s.weight for s in r.shards])
        )
    future = {}
    for r in future_placement(islands, after).orderBy("plan_id", "island_ord").collect():
        name = list(CASES[r.plan_id][0])[r.island_no]
        future.setdefault(r.plan_id, {})[name] = [s.weight for s in r.shards]
    return groups, future


@pytest.mark.parametrize("name", CASES)
def test_moves_and_future(planned, name):
    groups, future = planned
    assert groups.get(name, []) == CASES[name][2]
    assert future[name] == CASES[name][3]


def test_no_islands_no_plan(spark):
    placement, islands, gone = frames(spark, {"empty": ({}, [])})
    moves, after = rebalance(placement, islands, gone)
    assert moves.collect() == [] and after.collect() == []


def test_decommissioning_all_islands_fails(spark):
    placement, islands, gone = frames(spark, {"all": ({"m1": [1, 2], "m2": [3, 4]}, ["m1", "m2"])})
    with pytest.raises(Exception, match="all islands"):
        rebalance(placement, islands, gone)


def test_numbers_outside_the_list_are_ignored(spark):
    placement, islands, _ = frames(spark, {"x": ({"m1": [1, 2, 3, 6], "m2": []}, [])})
    moves, _ = rebalance(placement, islands, [7])
    assert [(r.shard_no, r.to_island) for r in moves.collect()] == [(3, 1)]


def test_unlisted_island_fails(spark):
    placement, islands, _ = frames(spark, {"x": ({"m1": [1], "m2": [2]}, [])})
    with pytest.raises(Exception, match="not listed"):
        rebalance(placement, islands.filter("island_no = 0"))
