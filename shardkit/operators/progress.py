"""How far a move has come."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# States of a table that is being copied, and the one that ends it.
STATE_NAMES = {
    "i": "initializing",
    "d": "data is being copied",
    "f": "finished table copy",
    "s": "synchronized",
    "r": "ready",
}
READY = "r"

# Fixed value: distance kept from ids given out on either side.
ID_MARGIN = 1000


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, rows) of several tables."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(t).alias("table"), "rows") for t, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def backfill_progress(src: DataFrame, dst: DataFrame, states: DataFrame) -> DataFrame:
    """Tables not ready yet: state, rows copied (at most those of the source), rows, whole percent.

    src, dst: (table, rows); states: (table, state). An empty source counts as done.
    """
    names = F.create_map(*[F.lit(x) for pair in STATE_NAMES.items() for x in pair])
    counts = (
        states.filter(F.col("state") != READY)
        .join(src.select("table", F.col("rows").alias("count_from")), "table", "left")
        .join(dst.select("table", F.col("rows").alias("copied")), "table", "left")
        .withColumn("count_from", F.coalesce("count_from", F.lit(0)))
        .withColumn("count_to", F.least("count_from", F.coalesce("copied", F.lit(0))))
    )
    percent = F.round(F.col("count_to") / F.col("count_from") * 100).cast("int")
    return counts.select(
        "table",
        F.coalesce(F.try_element_at(names, F.col("state")), F.col("state")).alias("state"),
        F.when(F.col("count_from") == 0, F.lit(100)).otherwise(percent).alias("percent"),
        "count_to",
        "count_from",
    )


def replication_gap(positions: DataFrame, target: int | DataFrame) -> DataFrame:
    """(shard_no, gap): how far the position of each shard is behind the target; 0 means caught up.

    positions: (shard_no, lsn); target: one lsn, or (shard_no, target), where a
    shard without a position is behind by its whole target.
    """
    if isinstance(target, DataFrame):
        positions = target.join(positions, "shard_no", "left")
        goal = F.col("target")
    else:
        goal = F.lit(target).cast("bigint")
    gap = F.greatest(goal - F.coalesce("lsn", F.lit(0)), F.lit(0).cast("bigint"))
    return positions.select("shard_no", gap.alias("gap"))


def next_ids(tables: dict[str, DataFrame], id_columns: dict[str, str]) -> DataFrame:
    """(name, next_id) of tables: one above the highest id, 1 for an empty table."""
    parts = [
        df.agg((F.coalesce(F.max(id_columns[t]), F.lit(0)) + 1).cast("bigint").alias("next_id"))
        .select(F.lit(t).alias("name"), "next_id")
        for t, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def advance_ids(src: DataFrame, dst: DataFrame, margin: int = ID_MARGIN) -> DataFrame:
    """(name, next_id) the destination goes on with, for names both sides have."""
    theirs = src.select("name", F.col("next_id").alias("src_id"))
    ours = dst.select("name", F.col("next_id").alias("dst_id"))
    ahead = F.greatest("dst_id", "src_id") + F.lit(margin)
    return ours.join(theirs, "name").select("name", ahead.cast("bigint").alias("next_id"))
