"""Near-equal contiguous batches of an ordered list."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shardkit.session import kept_rows

# Fixed value: sequences of moves that run side by side.
DEFAULT_BATCHES = 3


def positions(df: DataFrame, order: list[str]) -> DataFrame:
    """Rows with their 0-based `position` in the order of all rows, and the `total`.

    A window over everything would pass all rows through one task. Here the sorted
    rows are stored once, numbered within their partition, and shifted by the
    partitions' sizes, of which there are only as many as partitions. `order`
    should tell any two rows apart.
    """
    tag = F.monotonically_increasing_id()
    stored = kept_rows(df.orderBy(*order).withColumn("_tag", tag), "sorted")
    # the tag holds the partition in its upper bits and the row within it in the lower 33
    part, row = F.shiftright("_tag", 33), F.col("_tag").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = stored.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size")).collect()
    offsets, total = [], 0
    for size in sorted(sizes):
        offsets.append((size["_part"], total))
        total += size["_size"]
    starts = df.sparkSession.createDataFrame(offsets, "_part bigint, _start bigint")
    return (
        stored.withColumn("_part", part)
        .join(F.broadcast(starts), "_part")
        .withColumn("position", F.col("_start") + row)
        .withColumn("total", F.lit(total).cast("bigint"))
        .drop("_tag", "_part", "_start")
    )


def split_into_batches(
    df: DataFrame, order: list[str], n: int = DEFAULT_BATCHES, group: list[str] | None = None
) -> DataFrame:
    """Rows with their batch 0, 1, …; batches are contiguous in the order and none is empty.

    `group` splits each group's rows on their own; a group must be small, such as
    a plan's moves. Without it rows of any number are split as one list.
    """
    if group:
        whole = Window.partitionBy(*group)
        numbered = df.withColumn("position", F.row_number().over(whole.orderBy(*order)).cast("bigint") - 1)
        numbered = numbered.withColumn("total", F.count(F.lit(1)).over(whole))
    else:
        numbered = positions(df, order)
    share = F.expr(f"((position + 1) * {int(n)} - 1) div total")
    # with fewer rows than batches every row is a batch of its own
    batch = F.when(F.col("total") < n, F.col("position")).otherwise(share)
    return numbered.withColumn("batch", batch.cast("int")).drop("position", "total")
