"""What several operators here need: scratch tables, gapless numbers, connected components."""

import gc
import hashlib
import threading
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shardkit.limits import broadcast_within
from shardkit.session import scratch_path, settle


# Links that a task handles in a round of components().
LINKS_PER_TASK = 50_000


_KEPT = threading.local()


def release(spark: SparkSession) -> None:
    """Have Spark remove the shuffle files of frames that nothing refers to any more.

    It does so when the driver collects garbage, of which one with little to do has none for long.
    """
    gc.collect()
    spark._jvm.System.gc()


@contextmanager
def scratch_removed(spark: SparkSession):
    """Scratch tables that are made inside are removed at the end: for callers that have written what they made of them.

    Gives a function like stored(), whose tables stay as if they were made outside.
    """
    outer, own = getattr(_KEPT, "paths", None), []

    def stays(df: DataFrame, label: str) -> DataFrame:
        now, _KEPT.paths = _KEPT.paths, outer
        try:
            return stored(df, label)
        finally:
            _KEPT.paths = now

    _KEPT.paths = own
    try:
        yield stays
    finally:
        paths, _KEPT.paths = own, outer
        for path in paths:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(target, True)
        release(spark)


def scratch(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder."""
    path = scratch_path(spark, label)
    if getattr(_KEPT, "paths", None) is not None:
        _KEPT.paths.append(path)
    return path


def stored(df: DataFrame, label: str) -> DataFrame:
    """df written once as Parquet below the shared folder, and read from there.

    Later jobs, and tasks that run again after a lost executor, see the same rows.
    """
    path = scratch(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def task_number() -> int:
    return TaskContext.get().partitionId()


def digest(text: str | None) -> bytes:
    """16 bytes that stand for a text."""
    return hashlib.md5((text or "").encode("utf-8", "surrogatepass")).digest()


def arrow_schema(ddl: list[tuple[str, pa.DataType]]) -> pa.Schema:
    return pa.schema(ddl)


def text_slices(texts: pa.Array, most: int):
    """Index ranges of consecutive values of about so many bytes, at least one value."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield at, to
        at = to


def numbered(keys: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """The number of each among those of its key, from `seen` on, which is brought up to date."""
    order = np.argsort(keys, kind="stable")
    of = keys[order]
    out = np.empty(len(keys), dtype=np.int64)
    out[order] = np.arange(len(of)) - np.searchsorted(of, of) + seen[of]
    seen += np.bincount(keys, minlength=len(seen))
    return out


def gapless(table: DataFrame, key: str, most: int, name: str) -> DataFrame:
    """Adds `name`: a number from 0 without gaps among the rows with equal `key`, a whole number from 0 to `most`.

    `table` is a stored table with `part` (the task that wrote a row) and `local` (the
    row's number among those with its key in that task). Only counts per task and key are shuffled, so a key that holds a third
    of all rows is no one's burden. A task's first numbers of all keys come as one row, so that the rows themselves
    cross no exchange while a row per task can be broadcast.
    """
    counts = settle(table.groupBy("part", key).agg(F.count(F.lit(1)).alias("_n")))
    before = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", F.col(key).cast("int").alias("_key"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    per_task = bases.groupBy("part").agg(F.collect_list(F.struct("_key", "_base")).alias("_listed"))

    def dense(batches):
        for batch in batches:
            out = []
            for listed in batch.column(1):
                own = np.zeros(most + 1, dtype=np.int64)
                own[listed.values.field(0).to_numpy()] = listed.values.field(1).to_numpy()
                out.append(own)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, type=pa.list_(pa.int64()))], names=["part", "_bases"])

    per_task = settle(per_task.mapInArrow(dense, "part int, _bases array<bigint>"))
    joined = table.join(broadcast_within(per_task), "part")
    return joined.withColumn(name, F.col("local") + F.get("_bases", F.col(key).cast("int"))).drop("_bases")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id reachable over `edges` (a, b: bigint), for each id in an edge.

    Alternates two steps that replace a node's links by links to the smallest node
    it knows of, until nothing changes. Links stay as many as they were. Each step
    is a partial aggregation and a join, which adaptive execution splits where one
    node has very many links. Each round is settled in the checkpoint folder.
    """
    links = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct()
    links = settle(links)
    count = links.count()
    # links only get fewer; tasks in proportion, as a round has many small stages
    tasks = max(8, count // LINKS_PER_TASK)
    links, known = links.coalesce(tasks), None
    for _ in range(max_rounds):
        # every larger neighbour, and the node itself, links to the node's smallest neighbour
        both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = settle(large.where("u > v").coalesce(tasks))
        # then every smaller neighbour, and the node itself
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v"))
        )
        links = settle(small.where("u > v").coalesce(tasks).distinct().coalesce(tasks))
        state = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == known:
            break
        known = state
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = links.select(F.col("v").alias("id")).distinct()
    return links.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        roots.select("id", F.col("id").alias("component"))
    )
