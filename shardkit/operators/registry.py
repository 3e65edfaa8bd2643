"""Which shards exist, which are active, and what may be created or dropped.

"Exists" means present in a frame with a `shard` label column: a sharded table,
or a manifest. Such frames are reduced to their distinct labels first, which
combines on the map side, so a whole fact table may be passed.

A registry is a frame (shard STRING, status STRING) with the statuses below. New
registries are a row per shard and are returned evaluated, so that a sequence of
changes does not pile up in one plan.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardkit.functions.names import DEFAULT_PREFIX, retired_pattern, shard_name
from shardkit.limits import MAX_SHARD_NO, MIN_SHARD_NO
from shardkit.session import settle

ACTIVE = "active"
INACTIVE = "inactive"


def existing_shards(df: DataFrame) -> DataFrame:
    return df.select("shard").distinct()


def shard_range(spark: SparkSession, lo: int, hi: int | None = None, prefix: str = DEFAULT_PREFIX) -> DataFrame:
    """The shards lo..hi (inclusive); an inverted range is empty."""
    hi = lo if hi is None else hi
    numbers = spark.range(lo, max(hi, lo - 1) + 1)
    return numbers.select(
        F.col("id").cast("int").alias("shard_no"), shard_name(F.col("id"), prefix).alias("shard")
    )


def missing_shards(existing: DataFrame, lo: int, hi: int | None = None, prefix: str = DEFAULT_PREFIX) -> DataFrame:
    """Shards of the range that do not exist yet, in order: those to create."""
    hi = lo if hi is None else hi
    if lo < MIN_SHARD_NO or hi > MAX_SHARD_NO:
        raise ValueError(f"shard numbers must lie in {MIN_SHARD_NO}..{MAX_SHARD_NO}: {lo}..{hi}")
    wanted = shard_range(existing.sparkSession, lo, hi, prefix)
    return wanted.join(existing_shards(existing), "shard", "left_anti").select("shard").orderBy("shard")


def droppable_shards(
    existing: DataFrame, data: DataFrame, lo: int, hi: int | None = None, prefix: str = DEFAULT_PREFIX
) -> DataFrame:
    """Shards of the range that exist, in order, and whether they are empty; only empty ones may go."""
    hi = lo if hi is None else hi
    if lo < MIN_SHARD_NO or hi > MAX_SHARD_NO or lo > hi:
        raise ValueError(f"shard numbers must lie in {MIN_SHARD_NO}..{MAX_SHARD_NO}, in order: {lo}..{hi}")
    wanted = shard_range(existing.sparkSession, lo, hi, prefix).select("shard")
    filled = existing_shards(data).withColumn("filled", F.lit(True))
    return (
        wanted.join(existing_shards(existing), "shard", "left_semi")
        .join(filled, "shard", "left")
        .select("shard", F.col("filled").isNull().alias("is_empty"))
        .orderBy("shard")
    )


def drop_shards(
    registry: DataFrame,
    existing: DataFrame,
    data: DataFrame,
    lo: int,
    hi: int | None = None,
    prefix: str = DEFAULT_PREFIX,
) -> tuple[DataFrame, DataFrame]:
    """Drop a range: (shards dropped, registry without them). A shard with rows fails the call."""
    found = droppable_shards(existing, data, lo, hi, prefix)
    filled = found.filter(~F.col("is_empty")).select("shard").first()
    if filled is not None:
        raise ValueError(f"shard is not empty: {filled.shard}")
    gone = found.select("shard")
    left = existing_shards(existing).join(gone, "shard", "left_anti")
    return gone, reconcile_active(registry, left)


def activate_shards(
    registry: DataFrame, existing: DataFrame, lo: int, hi: int | None = None, prefix: str = DEFAULT_PREFIX
) -> tuple[DataFrame, DataFrame]:
    """Activate a range: (all shards of the range, new registry). A shard that does not exist fails the call."""
    wanted = shard_range(existing.sparkSession, lo, hi, prefix).select("shard")
    known = existing_shards(existing)
    unknown = wanted.join(known, "shard", "left_anti").orderBy("shard").first()
    if unknown is not None:
        raise ValueError(f"no such shard: {unknown.shard}")
    added = wanted.withColumn("status", F.lit(ACTIVE))
    others = registry.join(wanted, "shard", "left_anti").select("shard", "status")
    return wanted.orderBy("shard"), reconcile_active(others.unionByName(added), known)


def allocate_shards(
    registry: DataFrame, existing: DataFrame, lo: int, hi: int | None = None, activate: bool = True,
    prefix: str = DEFAULT_PREFIX,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Create what is missing of a range and activate all of it: (created, existing, registry)."""
    created = missing_shards(existing, lo, hi, prefix)
    existing = existing_shards(existing).unionByName(created)
    if activate:
        registry = activate_shards(registry, existing, lo, hi, prefix)[1]
    return created, existing, registry


def deactivate_shards(
    registry: DataFrame, lo: int, hi: int | None = None, prefix: str = DEFAULT_PREFIX
) -> tuple[DataFrame, DataFrame]:
    """Deactivate a range: (shards that were active, new registry)."""
    wanted = shard_range(registry.sparkSession, lo, hi, prefix).select("shard")
    active = registry.filter(F.col("status") == ACTIVE)
    stopped = active.join(wanted, "shard", "left_semi").select("shard").orderBy("shard")
    named = registry.join(wanted.withColumn("wanted", F.lit(True)), "shard", "left")
    status = F.when(F.col("wanted"), F.lit(INACTIVE)).otherwise(F.col("status"))
    return stopped, settle(named.select("shard", status.alias("status")))


def active_shards(registry: DataFrame, existing: DataFrame) -> DataFrame:
    """One row with the ordered array of shards that are active and exist; empty when none are."""
    return active_rows(registry, existing).agg(F.sort_array(F.collect_set("shard")).alias("shards"))


def active_rows(registry: DataFrame, existing: DataFrame) -> DataFrame:
    """The active shards that exist, one per row."""
    active = registry.filter(F.col("status") == ACTIVE).select("shard").distinct()
    return active.join(existing_shards(existing), "shard", "left_semi")


def reconcile_active(registry: DataFrame, existing: DataFrame, new: DataFrame | None = None) -> DataFrame:
    """Registry without shards that do not exist; `new`, if given, replaces the set of active shards."""
    if new is not None:
        listed = new.select("shard").distinct()
        rest = (
            registry.select("shard").distinct().join(listed, "shard", "left_anti")
            .withColumn("status", F.lit(INACTIVE))
        )
        registry = listed.withColumn("status", F.lit(ACTIVE)).unionByName(rest)
    return settle(registry.select("shard", "status").join(existing_shards(existing), "shard", "left_semi"))


def retired_shards(names: DataFrame, base_re: str = DEFAULT_PREFIX + r"\d+") -> DataFrame:
    """Labels that moves left behind, for removal."""
    return names.filter(F.col("shard").rlike(retired_pattern(base_re))).select("shard").distinct()


def duplicate_active(active_by_island: DataFrame) -> DataFrame:
    """Shards active on more than one island, with those islands in order."""
    islands = F.sort_array(F.collect_set("island_no"))
    return (
        active_by_island.select("shard", "island_no").distinct()
        .groupBy("shard").agg(islands.alias("islands"))
        .filter(F.size("islands") > 1)
    )
