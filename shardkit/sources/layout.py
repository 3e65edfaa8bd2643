"""Stored layout of sharded tables: one directory per island and shard."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardkit.limits import MAX_SHARD_NO, MIN_SHARD_NO, broadcast_within
from shardkit.session import settle

PARTITIONS = ["island_no", "shard_no"]


def place_rows(df: DataFrame, placement: DataFrame) -> DataFrame:
    """Rows with the island of their shard; a row whose shard has no place fails the job."""
    # one row per shard number; read for the checks here and the join
    places = settle(placement.select("shard_no", "island_no"))
    twice = places.groupBy("shard_no").count().filter(F.col("count") > 1).first()
    if twice is not None:
        raise ValueError(f"shard {twice.shard_no} has more than one island")
    known = F.col("shard_no").between(MIN_SHARD_NO, MAX_SHARD_NO)
    beyond = places.filter(F.col("shard_no").isNull() | ~known).first()
    if beyond is not None:
        # its label would be another shard's
        raise ValueError(f"no such shard number: {beyond.shard_no}")
    places = broadcast_within(places)
    placed = df.drop("island_no").join(places, "shard_no", "left")
    label = F.coalesce(F.col("shard_no").cast("string"), F.lit("null"))
    unknown = F.raise_error(F.concat(F.lit("no island for shard "), label)).cast("int")
    known = F.when(F.col("island_no").isNull(), unknown).otherwise(F.col("island_no"))
    return placed.withColumn("island_no", known)


def write_layout(df: DataFrame, path: str, partitions: list[str] | None = None, clustered: bool = False) -> None:
    """Write rows by partition directory, replacing only the directories that get rows.

    The rebalance hint brings a shard's rows together, so that small shards give
    few files, and lets adaptive execution split a shard that is too large for
    one task over several tasks and files. Rows that are read from the layout
    come by shard already: `clustered` writes them without a shuffle.
    """
    partitions = partitions or PARTITIONS
    rows = df if clustered else df.hint("rebalance", *partitions)
    (
        rows.write.partitionBy(*partitions)
        .option("partitionOverwriteMode", "dynamic")
        .mode("overwrite")
        .parquet(path)
    )


def write_placed(df: DataFrame, placement: DataFrame, path: str) -> None:
    """Store a sharded table by island and shard. placement: (shard_no, island_no), one row per shard.

    A table may be written anew, but not with a shard that it has on another
    island: rows there would stay, and be read as well.
    """
    if exists(df.sparkSession, path):
        places = placement.select("shard_no", F.col("island_no").alias("new_island"))
        stored = stored_shards(df.sparkSession, path).join(places, "shard_no")
        moved = stored.filter(F.col("island_no") != F.col("new_island")).first()
        if moved is not None:
            raise ValueError(f"shard {moved.shard_no} is stored on island {moved.island_no}")
    write_layout(place_rows(df, placement), path)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(target)


def read_placed(spark: SparkSession, path: str, drifting: bool = False) -> DataFrame:
    """A stored table; filters on island_no and shard_no select directories.

    With `drifting` the columns of all files are united, which opens every file's
    footer; leave it off where shards have the same columns.
    """
    return spark.read.option("mergeSchema", drifting).parquet(path)


def island_source(spark: SparkSession, path: str, island_no: int) -> DataFrame:
    """One island's directory of a stored table."""
    return spark.read.option("basePath", path).parquet(f"{path.rstrip('/')}/island_no={island_no}")


def stored_shards(spark: SparkSession, path: str) -> DataFrame:
    """The (island_no, shard_no) a stored table has files for, from its file listing; no file is opened."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    return files.select(*PARTITIONS).distinct()
