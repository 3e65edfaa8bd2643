"""Shards by vector bin packing: bytes, tokens and rows balanced jointly, equal texts together.

Rows with equal texts form a group with a size in each of three dimensions. Groups
go to the shard where the dot product of their size with the shard's residual capacity is highest, both
as parts of the whole; large groups first. The groups that are large against the
total, of which there can only be a bounded number, are placed on the driver. All
others are dealt over tasks by their hash; each task places its own, against its part of
what the large ones have left of each shard's capacity. So every task's groups spread evenly,
and with them all. A group larger than a shard's whole capacity is cut into lots
of rows, which are groups of their own, as no shard could hold it within the law.

Law: `bytes`. Sizes of shards are near equal. Defined results: a null text has no bytes and is a
group of its own, apart from empty texts; both have size 8 and checksum 0. Repeated rows keep a
slot each. Ties go to the smaller shard. An empty table gives no rows. Columns besides
doc_id and text are left out.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardkit.llm.common import gapless, stored, task_number
from shardkit.limits import broadcast_within
from shardkit.session import settle

SHARDS = 24
LAW = "bytes"
ROW_BYTES = 8
# A group is large from this part of any shard's capacity on: at most SHARDS x 1000 x dimensions of them.
LARGE = 1 / 1000
# Groups placed by one task.
TASK_GROUPS = 200_000
_DIMENSIONS = ["bytes", "tokens", "rows"]


def place(sizes: np.ndarray, residual: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A shard for each row of sizes; residual (shards x dimensions) is used up. Both in parts of a shard's capacity.

    A shard that a group fits into goes before one that it would fill beyond its capacity.
    """
    out = np.zeros(len(sizes), dtype=np.int32)
    residual = residual.copy()
    for i in np.argsort(-sizes.max(axis=1, initial=0), kind="stable"):
        size = sizes[i]
        worth = residual @ size
        fits = (residual >= size).all(axis=1)
        if fits.any():
            worth = np.where(fits, worth, -np.inf)
        best = int(worth.argmax())
        out[i] = best
        residual[best] -= size
    return out, residual


def mend(sizes: np.ndarray, chosen: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Placement of groups by which shards are more equal in bytes; `held` are bytes of shards besides.

    The fullest shard gives a group to the emptiest one, or swaps one for a smaller one, whichever comes nearest to half of what is
    between them, until no such step makes them more equal.
    """
    chosen = chosen.copy()
    total = held + np.bincount(chosen, weights=sizes, minlength=len(held)) if len(sizes) else held
    for _ in range(20 * len(sizes)):
        full, empty = int(total.argmax()), int(total.argmin())
        wanted = (total[full] - total[empty]) / 2
        own, theirs = np.nonzero(chosen == full)[0], np.nonzero(chosen == empty)[0]
        if not len(own) or wanted < 1:
            break
        # swaps: for each group of the fullest, the one of the emptiest that leaves the wanted difference, or none
        given = np.concatenate([[0], np.sort(sizes[theirs])])
        at = np.clip(np.searchsorted(given, sizes[own] - wanted), 1, len(given)) - 1
        options = [(np.abs(sizes[own] - given[np.minimum(at + step, len(given) - 1)] - wanted), np.minimum(at + step, len(given) - 1)) for step in (0, 1)]
        off, step = min((o.min(), i) for i, (o, _) in enumerate(options))
        if off >= wanted:
            break
        i = int(options[step][0].argmin())
        back = int(options[step][1][i])
        moved = sizes[own[i]] - given[back]
        chosen[own[i]] = empty
        if back:
            chosen[theirs[np.argsort(sizes[theirs], kind="stable")[back - 1]]] = full
        total[full] -= moved
        total[empty] += moved
    return chosen


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, n_tokens (words between white space), shard, slot of every row of docs.

    Texts are read once; what is shuffled are keys and sizes.
    """
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    rows = stored(
        docs.select(
            F.col("doc_id").cast("bigint").alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("bigint").alias("size"),
            F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("bigint").alias("text_crc32"),
            F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")).cast("bigint").alias("n_tokens"),
            F.unhex(F.coalesce(F.md5(text.cast("binary")), F.lit(""))).alias("group"),
        ),
        "sized",
    )
    totals = rows.agg(F.sum("size"), F.sum("n_tokens"), F.count(F.lit(1))).first()
    whole = np.array([float(x or 0) for x in totals])
    capacity = np.maximum(whole / shards, 1.0)
    # Lots of a group that is larger than a shard: rows of it are dealt by their ids.
    summed = settle(
        rows.groupBy("group").agg(F.sum("size").alias("bytes"), F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"))
    )
    over = summed.where(F.col("bytes") > F.lit(float(capacity[0])))
    wide = {
        bytes(r["group"]): math.ceil(16 * r["bytes"] / capacity[0]) for r in over.collect()  # fewer than `shards` of them
    }
    lots = F.lit(1)
    for key, n in wide.items():
        lots = F.when(F.col("group") == F.lit(key), F.lit(n)).otherwise(lots)
    lot = F.when(lots > 1, F.pmod(F.xxhash64("doc_id", "group"), lots)).otherwise(0).cast("int")
    groups = summed.withColumn("lot", F.lit(0))
    if wide:
        cut = rows.where(lots > 1).groupBy("group", lot.alias("lot")).agg(
            F.sum("size").alias("bytes"), F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")
        )
        groups = groups.where(lots == 1).unionByName(cut.select(groups.columns))
        groups = settle(groups)
    is_large = F.lit(False)
    for name, most in zip(_DIMENSIONS, capacity):
        is_large = is_large | (F.col(name) >= F.lit(float(most * LARGE)))
    full = np.ones((shards, len(_DIMENSIONS)))
    large = sorted(groups.where(is_large).collect(), key=lambda r: (bytes(r["group"]), r["lot"]))
    sizes = np.array([[r[x] for x in _DIMENSIONS] for r in large], dtype=float).reshape(-1, 3) / capacity
    chosen, residual = place(sizes, full)
    residual = np.maximum(residual, 0)
    left = spark.sparkContext.broadcast((residual, capacity))

    def fill(batches):
        keys, lot_numbers, values = [], [], []
        for batch in batches:
            keys.extend(batch.column(0).to_pylist())
            lot_numbers.extend(batch.column(1).to_pylist())
            values.append(np.column_stack([batch.column(i).to_numpy() for i in (2, 3, 4)]).astype(float))
        if not keys:
            return
        residual, capacity = left.value
        own = np.concatenate(values)
        # this task's part of the residual: in proportion, so that it sums up to what the task has to place
        room = residual / np.maximum(residual.sum(axis=0), 1e-12) * own.sum(axis=0)
        scale = np.maximum(own.sum(axis=0) / len(room), 1e-12)
        order = sorted(range(len(keys)), key=lambda i: (keys[i], lot_numbers[i]))
        found, _ = place(own[order] / scale, room / scale)
        yield pa.RecordBatch.from_pydict(
            {"group": [keys[i] for i in order], "lot": pa.array([lot_numbers[i] for i in order], pa.int32()), "shard": found}
        )

    small = groups.where(~is_large).select("group", "lot", *_DIMENSIONS)
    tasks = max(1, math.ceil(summed.count() / TASK_GROUPS))
    placed = stored(small.repartition(tasks, "group", "lot").mapInArrow(fill, "group binary, lot int, shard int"), "placed-small")
    # how full the small groups make each shard, before the large ones are mended
    held = np.zeros(shards)
    for r in placed.join(small, ["group", "lot"]).groupBy("shard").agg(F.sum("bytes").alias("bytes")).collect():
        held[r["shard"]] = r["bytes"]
    chosen = mend(np.array([r["bytes"] for r in large], dtype=np.int64), chosen, held)
    placed_large = spark.createDataFrame(
        [(bytes(r["group"]), r["lot"], int(s)) for r, s in zip(large, chosen)], "group binary, lot int, shard int"
    )
    placed = placed.unionByName(placed_large)
    placed = stored(placed, "placed")

    def number(batches):
        part, seen = task_number(), np.zeros(shards, dtype=np.int64)
        for batch in batches:
            shard = batch.column(batch.schema.get_field_index("shard")).to_numpy()
            local = np.zeros(len(shard), dtype=np.int64)
            order = np.argsort(shard, kind="stable")
            kinds, first, n = np.unique(shard[order], return_index=True, return_counts=True)
            for kind, a, m in zip(kinds, first, n):
                local[order[a : a + m]] = seen[kind] + np.arange(m)
                seen[kind] += m
            batch = batch.append_column("part", pa.array(np.full(len(shard), part, dtype=np.int32)))
            yield batch.append_column("local", pa.array(local))

    fields = "doc_id bigint, size bigint, text_crc32 bigint, n_tokens bigint, shard int"
    located = rows.withColumn("lot", lot).join(broadcast_within(placed), ["group", "lot"])
    located = located.select("doc_id", "size", "text_crc32", "n_tokens", "shard")
    numbered = stored(located.mapInArrow(number, fields + ", part int, local bigint"), "located")
    return gapless(numbered, "shard", shards - 1, "slot").drop("part", "local")
