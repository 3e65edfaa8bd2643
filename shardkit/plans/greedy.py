"""The sequential stage of a plan: moving shards off overloaded islands."""

from collections.abc import Callable

import pyarrow as pa

# Fixed value: a shard may overload its new island if the old one stays heavier
# than that by more than this part of the shard's weight.
OVERLOADED_TO_OVERLOADED = 0.75

RESULT_SCHEMA = (
    "plan_id string, shard_no int, weight bigint, shard_ord bigint, from_island int, from_ord int, "
    "island_no int, island_ord int, pos bigint, is_empty boolean"
)
KERNEL_COLUMNS = [column.split()[0] for column in RESULT_SCHEMA.split(", ")]


def balance_kernel(max_shards: int, moved_pos: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The function for one plan: its shards (KERNEL_COLUMNS) and its islands (island_no, island_ord, load).

    Returns the shards, with new islands for those that move. Nested, so that it
    travels to tasks by value. A plan has at most one row per shard number, so
    its size is bounded.
    """
    factor = OVERLOADED_TO_OVERLOADED
    columns = list(KERNEL_COLUMNS)

    def run(shards: pa.Table, islands: pa.Table) -> pa.Table:
        import numpy as np
        import pyarrow as pa

        def column(table: pa.Table, name: str) -> np.ndarray:
            return table.column(name).to_numpy(zero_copy_only=False)

        shards = shards.select(columns)
        count = shards.num_rows
        if count > max_shards:
            raise ValueError(f"a plan has more shards than there are shard numbers: {count}")
        if count == 0 or islands.num_rows == 0:
            return shards
        by_order = np.argsort(column(islands, "island_ord"), kind="stable")
        numbers = column(islands, "island_no")[by_order]
        orders = column(islands, "island_ord")[by_order]
        loads = column(islands, "load")[by_order].astype(np.int64).tolist()
        at = {number: i for i, number in enumerate(numbers.tolist())}

        weight, pos = column(shards, "weight"), column(shards, "pos").copy()
        island = np.array([at[number] for number in column(shards, "island_no").tolist()])
        full = np.flatnonzero(~column(shards, "is_empty").astype(bool))
        # heaviest first; ties in island order, then in the order of the island's list
        queue = full[np.lexsort((pos[full], island[full], -weight[full]))].tolist()
        weights = weight.tolist()
        home = island.tolist()
        desired = sum(weights[s] for s in queue) / len(loads)
        targets: dict[int, int] = {}

        def lightest_but(source: int) -> int | None:
            others = [i for i in range(len(loads)) if i != source]
            return min(others, key=loads.__getitem__) if others else None

        def move(shard: int, target: int) -> None:
            loads[home[shard]] -= weights[shard]
            loads[target] += weights[shard]
            targets[shard] = target

        def lightest_after(shard: int, target: int) -> int:
            changed = {home[shard]: -weights[shard], target: weights[shard]}
            return min(load + changed.get(i, 0) for i, load in enumerate(loads))

        head, tail, credit = 0, len(queue), 0
        while head < tail:
            # one large shard off an overloaded island
            while head < tail:
                shard = queue[head]
                head += 1
                source, size = home[shard], weights[shard]
                target = lightest_but(source) if loads[source] > desired else None
                if target is None:
                    continue
                load = loads[target] + size
                if load <= desired or loads[source] - load > factor * size:
                    move(shard, target)
                    credit += size
                    break
            # then small ones of about the same weight in all, as long as the lightest island gains
            while head < tail:
                shard = queue[tail - 1]
                source, size = home[shard], weights[shard]
                if loads[source] <= desired or credit < size:
                    break
                target = lightest_but(source)
                if target is None or loads[target] >= loads[source] or lightest_after(shard, target) <= min(loads):
                    break
                tail -= 1
                move(shard, target)
                credit -= size

        for turn, (shard, target) in enumerate(targets.items()):
            island[shard] = target
            pos[shard] = moved_pos + turn
        for name, values in (("island_no", numbers[island]), ("island_ord", orders[island]), ("pos", pos)):
            place = columns.index(name)
            kind = shards.schema.field(name).type
            shards = shards.set_column(place, name, pa.array(values, kind))
        return shards

    return run
