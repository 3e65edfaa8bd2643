"""One table over all shards, although their columns may have drifted apart."""

from __future__ import annotations

import threading
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from typing import TYPE_CHECKING

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shardkit.functions.names import shard_name, strip_prefix
from shardkit.limits import broadcast_within
from shardkit.session import scratch_path

if TYPE_CHECKING:  # tasks that do not need it are spared its memory
    import pandas as pd

# Table names taken into the union.
TABLE_NAME_RE = "(?i)^[a-zA-Z0-9_]+$"


def column_rows(shards: DataFrame, table: str, schema: T.StructType) -> DataFrame:
    """Catalog rows (shard, table, column, type) of a table's distinct shards."""
    fields = [
        F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"))
        for f in schema.fields
        if f.name != "shard"
    ]
    return (
        shards.select("shard").distinct()
        .select("shard", F.lit(table).alias("table"), F.explode(F.array(*fields)).alias("f"))
        .select("shard", "table", "f.column", "f.type")
    )


def table_inventory(columns: DataFrame) -> DataFrame:
    """Per table: the shards it is in and the columns it has in any of them."""
    return (
        columns.filter(F.col("table").rlike(TABLE_NAME_RE))
        .groupBy("table")
        .agg(
            F.sort_array(F.collect_set("shard")).alias("shards"),
            F.sort_array(F.collect_set("column")).alias("columns"),
        )
    )


def skip_existing(inventory: DataFrame, existing_views: DataFrame) -> DataFrame:
    """Inventory without tables that already have a view in the destination."""
    return inventory.join(existing_views.select("table").distinct(), "table", "left_anti")


def column_order(name: Column) -> list[Column]:
    """Sort keys of the union's columns: `id` first, the rest by name."""
    return [(name != "id").asc(), name.asc()]


def align_columns(frames: list[DataFrame]) -> list[str]:
    """Columns of the union, without the shard column: `id` first, the rest by name."""
    names = {c for df in frames for c in df.columns if c != "shard"}
    return sorted(names, key=lambda c: (c != "id", c))


def union_sources(frames: list[DataFrame]) -> DataFrame:
    """Bag union of frames that carry a shard column; columns matched by name.

    One frame may hold any number of shards, so that the plan has one branch per
    source rather than per shard. A column of different types becomes text.
    """
    columns = align_columns(frames)
    types: dict[str, set[str]] = {c: set() for c in columns}
    for df in frames:
        for field in df.schema.fields:
            if field.name != "shard":
                types[field.name].add(field.dataType.simpleString())
    clashing = {c for c, found in types.items() if len(found) > 1}

    def branch(df: DataFrame) -> DataFrame:
        present = [c for c in columns if c in df.columns]
        return df.select("shard", *[F.col(c).cast("string").alias(c) if c in clashing else F.col(c) for c in present])

    branches = [branch(df) for df in frames]
    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), branches)
    return whole.select("shard", *columns)


def union_shards(shards: dict[str, DataFrame], prefix: str | None = None) -> DataFrame:
    """Union of single shards given by label, mount labels without their prefix.

    Fits up to some hundred shards, as every shard is a branch of the plan; use
    union_sources, or the stored layout, beyond that.
    """
    if not shards:
        raise ValueError("no shards to unite")
    return union_sources(
        [df.withColumn("shard", strip_prefix(F.lit(label), prefix)) for label, df in shards.items()]
    )


def union_stored(stored: DataFrame) -> DataFrame:
    """Union of the shards of a stored table, which is one scan: its rows under their shard's label.

    A filter on the label selects directories, as the label is made from the
    directory's shard number.
    """
    inner = [c for c in stored.columns if c not in ("shard_no", "island_no", "copy", "shard")]
    labelled = stored.withColumn("shard", shard_name(F.col("shard_no")))
    return labelled.select("shard", *sorted(inner, key=lambda c: (c != "id", c)))


def fingerprints(columns: DataFrame) -> DataFrame:
    """Per table, a digest of its (shard, column, type) rows.

    Digests per shard come first, so no group holds more than one shard's
    columns or one table's shards.
    """
    part = F.concat_ws(" ", "column", "type")
    per_shard = columns.groupBy("table", "shard").agg(
        F.md5(F.array_join(F.sort_array(F.collect_list(part)), ",")).alias("digest")
    )
    entry = F.concat_ws(" ", "shard", "digest")
    return per_shard.groupBy("table").agg(
        F.md5(F.array_join(F.sort_array(F.collect_list(entry)), ",")).alias("fingerprint")
    )


def changed_tables(columns: DataFrame, manifest: DataFrame) -> DataFrame:
    """Tables whose digest differs from the one in the manifest (table, fingerprint)."""
    stored = manifest.select("table", F.col("fingerprint").alias("stored"))
    return (
        fingerprints(columns).join(stored, "table", "left")
        .filter(~F.col("fingerprint").eqNullSafe(F.col("stored")))
        .select("table", "fingerprint")
    )


def refresh_if_changed(
    spark: SparkSession,
    tables: dict[str, list[DataFrame]],
    manifest: DataFrame,
    rebuild: Callable[[str, DataFrame], None] | None = None,
) -> tuple[list[str], DataFrame]:
    """Rebuild the union of every table whose columns changed.

    Returns the names rebuilt and the new manifest. `rebuild` stores or
    registers a union; by default it becomes a temporary view.
    """
    rebuild = rebuild or (lambda name, df: df.createOrReplaceTempView(name))
    rows = [column_rows(df, name, df.schema) for name, frames in tables.items() for df in frames]
    changed = {r.table: r.fingerprint for r in changed_tables(reduce(DataFrame.unionByName, rows), manifest).collect()}
    for name in sorted(changed):
        rebuild(name, union_sources(tables[name]))
    new = spark.createDataFrame(sorted(changed.items()), "table string, fingerprint string")
    kept = manifest.select("table", "fingerprint").join(new, "table", "left_anti")
    return sorted(changed), kept.unionByName(new)


def for_each_shard(df: DataFrame, fn: Callable[[DataFrame], DataFrame], active: DataFrame) -> DataFrame:
    """Run one query on every active shard but shard 0: (shard, row_count).

    `fn` gets all these shards in one frame and must keep the shard_no column; one
    failing shard fails the call. The count is text, and empty for no rows.
    """
    targets = active.filter(F.col("shard_no") != 0).select("shard_no", "shard").distinct()
    listed = broadcast_within(targets.select("shard_no"))
    counts = fn(df.join(listed, "shard_no", "left_semi")).groupBy("shard_no").count()
    text = F.coalesce(F.col("count").cast("string"), F.lit(""))
    return targets.join(counts, "shard_no", "left").select("shard", text.alias("row_count"))


def run_each_shard(
    df: DataFrame, fn: Callable[[DataFrame], DataFrame], active: DataFrame, at_once: int = 4
) -> tuple[DataFrame, DataFrame]:
    """Run any DataFrame code on the whole rows of every active shard but shard 0, `at_once` shards at a time.

    Each shard is a job group of its own, and its rows are spread over as many tasks as they need. `fn` gets a shard's rows,
    in a frame that is pruned to its directory where the table is stored by shard, and returns rows of one schema. Returns the
    results under their shards, and (shard, row_count): counts are text, empty for no rows. The first shard that fails
    cancels the jobs of the others and is named by the error.
    """
    spark = df.sparkSession
    context, path = spark.sparkContext, scratch_path(spark, "each-shard")
    group = path.rsplit("/", 1)[-1]
    # one row per shard
    targets = active.filter(F.col("shard_no") != 0).select("shard_no", "shard").distinct().orderBy("shard_no").collect()
    stop = threading.Event()

    @inheritable_thread_target(spark)
    def run(number: int, label: str) -> int | None:
        if stop.is_set():
            return None
        context.setJobGroup(f"{group}-{number}", f"shard {label}", True)
        try:
            counted = Observation()
            found = fn(df.filter(F.col("shard_no") == number)).observe(counted, F.count(F.lit(1)).alias("rows"))
            found.drop("shard_no").write.parquet(f"{path}/shard_no={number}")
            return counted.get["rows"]
        except Exception as error:
            if stop.is_set():  # cancelled
                return None
            stop.set()
            for other in targets:
                if other.shard_no != number:
                    context.cancelJobGroup(f"{group}-{other.shard_no}")
            raise RuntimeError(f"error on shard {label}: {error}") from error

    with ThreadPoolExecutor(at_once) as pool:
        running = [pool.submit(run, r.shard_no, r.shard) for r in targets]
    counts = [(r.shard, str(n) if (n := future.result()) else "") for r, future in zip(targets, running)]
    schema = T.StructType([f for f in fn(df).schema if f.name != "shard_no"])
    schema.add("shard_no", T.IntegerType())
    if targets:
        results = spark.read.schema(schema).parquet(path)
    else:
        results = spark.createDataFrame([], schema)
    return results, spark.createDataFrame(counts, "shard string, row_count string")


def map_each_shard(
    df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, active: DataFrame
) -> DataFrame:
    """Run a Python function over the rows of every active shard but shard 0.

    `fn` sees batches that each belong to one shard, never a whole shard, so a
    shard of any size is spread over many tasks. A failure names its shard.
    """
    targets = broadcast_within(active.filter(F.col("shard_no") != 0).select("shard_no").distinct())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for number, part in batch.groupby("shard_no", sort=False):
                try:
                    yield fn(part)
                except Exception as error:
                    raise RuntimeError(f"error on shard {number}: {error}") from error

    return df.join(targets, "shard_no", "left_semi").mapInPandas(run, schema)
