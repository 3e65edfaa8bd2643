"""Shards of several sources under one set of labels."""

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardkit.functions.names import mount_label, source_label
from shardkit.limits import broadcast_within
from shardkit.session import settle

# Marks labels made by this toolkit among others of the same prefix.
MARKER = "shardkit:"


@dataclass
class Mounts:
    """Mounted shards: one frame per source, and a manifest (server, host, shard, label, comment)."""

    frames: dict[str, DataFrame]
    manifest: DataFrame
    prefix: str

    def labels(self) -> list[str]:
        return [r.label for r in self.manifest.select("label").orderBy("label").collect()]

    def shard(self, label: str) -> DataFrame:
        """One mounted shard; reads only what its source keeps for it."""
        row = self.manifest.filter(F.col("label") == label).first()
        if row is None:
            raise KeyError(label)
        return self.frames[row.host].filter(F.col("shard") == row.shard).drop("shard")

    def all_shards(self) -> dict[str, DataFrame]:
        """Every mounted shard by label; for some hundred shards at most, else use frames."""
        rows = self.manifest.select("label", "host", "shard").orderBy("label").collect()
        return {r.label: self.frames[r.host].filter(F.col("shard") == r.shard).drop("shard") for r in rows}

    def labelled(self) -> list[DataFrame]:
        """One frame per source with its mounted (that is, active) shards under their mount labels."""
        out = []
        for host, df in self.frames.items():
            mounted = broadcast_within(self.manifest.filter(F.col("host") == host).select("shard"))
            active = df.join(mounted, "shard", "left_semi")
            out.append(active.withColumn("shard", mount_label(F.col("shard"), self.prefix)))
        return out


def mount_manifest(prefix: str, active: DataFrame) -> DataFrame:
    """Manifest rows of active (host, shard) pairs."""
    return active.select("host", "shard").distinct().select(
        source_label(F.col("host"), prefix).alias("server"),
        "host",
        "shard",
        mount_label(F.col("shard"), prefix).alias("label"),
        F.concat(F.lit(MARKER), F.col("host")).alias("comment"),
    )


def mount_shards(
    prefix: str, sources: dict[str, DataFrame], active: DataFrame | None = None
) -> tuple[Mounts, DataFrame]:
    """Mount the active shards of every source: (mounts, summary of server and shard_count).

    A source is a frame with a shard label column: stored Parquet, or a JDBC table.
    `active` lists (host, shard); without it every shard a source holds is
    active. A shard that would be mounted twice fails the call.
    """
    if active is None:
        found = [df.select("shard").distinct().select(F.lit(host).alias("host"), "shard") for host, df in sources.items()]
        active = reduce(DataFrame.unionByName, found)
    manifest = mount_manifest(prefix, active.filter(F.col("host").isin(list(sources))))
    # bounded by shards times sources, and read several times from here on
    manifest = settle(manifest)
    twice = manifest.groupBy("label").count().filter(F.col("count") > 1).select("label").first()
    if twice is not None:
        raise ValueError(f"shard is already mounted: {twice.label}")
    hosts = manifest.sparkSession.createDataFrame([(h,) for h in sources], "host string")
    hosts = hosts.select(source_label(F.col("host"), prefix).alias("server"))
    shared = hosts.groupBy("server").count().filter(F.col("count") > 1).first()
    if shared is not None:
        raise ValueError(f"sources share a label: {shared.server}")
    counts = manifest.groupBy("server").agg(F.count_distinct("shard").alias("shard_count"))
    summary = hosts.join(counts, "server", "left").select(
        "server", F.coalesce("shard_count", F.lit(0)).alias("shard_count")
    )
    return Mounts(dict(sources), manifest, prefix), summary


def mounted_shards(manifest: DataFrame, prefix: str) -> DataFrame:
    """One row with the ordered array of marked labels of a prefix; empty when there are none."""
    marked = F.col("comment").contains(MARKER)
    return manifest.filter(F.col("label").startswith(prefix + "_") & marked).agg(
        F.sort_array(F.collect_set("label")).alias("labels")
    )


def jdbc_shard(spark: SparkSession, url: str, schema: str, table: str, **options: str) -> DataFrame:
    """A shard's table in a database, as a source frame; needs the database's driver on the class path.

    Pass partitionColumn, lowerBound, upperBound and numPartitions to read in parallel.
    """
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", f'"{schema}"."{table}"')
    return reader.options(**options).load().withColumn("shard", F.lit(schema))
