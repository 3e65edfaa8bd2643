"""Catching a copied shard up with the changes made since its snapshot.

Changes are rows (shard_no, op, lsn, <key columns>, payload STRUCT). They are
not applied to the copy one micro-batch at a time, which would rewrite it over
and over. Each micro-batch appends its latest change per key to a log, sorted by shard and key. The
log is merged with the copy when that is written, or when it is read. The latest change of a key is
the one of the highest lsn in the whole log, so replayed and out-of-order files
are harmless; changes at or below the snapshot's lsn are left out.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shardkit.limits import broadcast_within, fits
from shardkit.operators.progress import replication_gap
from shardkit.session import kept_rows
from shardkit.sources.changes import DELETE


def latest_changes(changes: DataFrame, keys: list[str]) -> DataFrame:
    """The change of the highest lsn of every key; combined on the map side, so hot keys are cheap."""
    rest = F.struct("op", "payload", "lsn")
    latest = changes.groupBy("shard_no", *keys).agg(F.max_by(rest, "lsn").alias("last"))
    return latest.select("shard_no", *keys, "last.op", "last.payload", "last.lsn")


def apply_changes(
    feed: DataFrame,
    log: str,
    checkpoint: str,
    keys: list[str],
    shards: DataFrame | None = None,
    after_lsn: int | None = None,
    fence_lsn: int | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Start copying a change stream into a log, of the given shards and lsn range only.

    A micro-batch that is run again replaces its own part of the log.
    """
    if after_lsn is not None:
        feed = feed.filter(F.col("lsn") > after_lsn)
    if fence_lsn is not None:
        feed = feed.filter(F.col("lsn") <= fence_lsn)
    if shards is not None:
        feed = feed.join(broadcast_within(shards.select("shard_no").distinct()), "shard_no", "left_semi")

    def store(batch: DataFrame, batch_id: int) -> None:
        latest = latest_changes(batch, keys).sortWithinPartitions("shard_no", *keys)
        latest.write.mode("overwrite").parquet(f"{log}/batch={batch_id}")

    writer = feed.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_log(spark: SparkSession, log: str) -> DataFrame:
    """Changes logged so far; `batch` is the micro-batch that brought them."""
    return spark.read.parquet(log)


def log_now(
    feed: DataFrame,
    written: DataFrame,
    log: str,
    checkpoint: str,
    keys: list[str],
    shards: DataFrame | None = None,
    after_lsn: int | None = None,
    fence_lsn: int | None = None,
) -> DataFrame:
    """Log what the feed has now and return the log."""
    # a part without rows, so that the log can be read even if no change arrives
    latest_changes(written.limit(0), keys).write.mode("overwrite").parquet(f"{log}/batch=-1")
    apply_changes(feed, log, checkpoint, keys, shards, after_lsn, fence_lsn).awaitTermination()
    return read_log(feed.sparkSession, log)


def merge_changes(base: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the copy after the changes: changed keys replaced, deleted ones gone, new ones added.

    payload fields are the row's columns besides shard and key; with others the
    call fails, as values of a row would be lost. Keys are unique
    in the copy. Few changed keys are broadcast, and rows of the copy stay in the
    tasks that read them; many are joined by sorting. Either way the result
    comes by shard, as write_layout(clustered=True) needs it.
    """
    given = set(changes.schema["payload"].dataType.names)
    wanted = set(base.columns) - {"shard_no", *keys}
    if given != wanted:
        raise ValueError(f"changes and rows differ in columns: {', '.join(sorted(given ^ wanted))}")
    latest = kept_rows(latest_changes(changes, keys), "latest-changes")
    return with_changes(base, latest, keys, fits(latest.select("shard_no", *keys)))


def with_changes(base: DataFrame, latest: DataFrame, keys: list[str], few: bool) -> DataFrame:
    """Rows after the latest change of each key. `few` changes are broadcast, which the caller has counted."""
    on = ["shard_no", *keys]
    touched = latest.select(*on)
    if few:
        kept = base.join(F.broadcast(touched), on, "left_anti")
    else:
        kept = base.join(touched, on, "left_anti").hint("rebalance", "shard_no")
    written = latest.filter(F.col("op") != DELETE).select(*on, "payload.*").hint("rebalance", "shard_no")
    return kept.unionByName(written)


def drain_to_fence(
    feed: DataFrame,
    written: DataFrame,
    fence_lsn: int,
    log: str,
    checkpoint: str,
    keys: list[str],
    shards: DataFrame | None = None,
    after_lsn: int | None = None,
) -> DataFrame:
    """Log every change up to the fence and return the log; fails if one is still missing.

    `written` is the change table as a batch frame, from which the end position
    of every shard is read. Continue behind the fence with lsn > fence_lsn and a
    checkpoint of its own, as this one has consumed what lies there.
    """
    logged = log_now(feed, written, log, checkpoint, keys, shards, after_lsn, fence_lsn)
    ends = written.filter(F.col("lsn") <= fence_lsn)
    if after_lsn is not None:
        ends = ends.filter(F.col("lsn") > after_lsn)
    if shards is not None:
        ends = ends.join(broadcast_within(shards.select("shard_no").distinct()), "shard_no", "left_semi")
    ends = ends.groupBy("shard_no").agg(F.max("lsn").alias("target"))
    done = logged.groupBy("shard_no").agg(F.max("lsn").alias("lsn"))
    behind = replication_gap(done, ends).filter(F.col("gap") > 0).orderBy("shard_no").first()
    if behind is not None:
        raise RuntimeError(f"shard {behind.shard_no} is {behind.gap} positions behind the fence")
    return logged
