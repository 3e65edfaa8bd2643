"""Weights of shards: stored size, or any aggregate over their rows."""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shardkit.functions.names import shard_no
from shardkit.functions.numbers import number_text, parse_weight, weight_text

# Name of a weight column without a name of its own.
DEFAULT_WEIGHT_NAME = "Weight"
UNNAMED_MARK = "?"
# Bytes of a unit that sizes can be given in.
SIZE_UNITS = {"B": 1, "kB": 1 << 10, "MB": 1 << 20, "GB": 1 << 30, "TB": 1 << 40}


def row_bytes(schema: T.StructType) -> Column:
    """Width of a row as an aggregate: fixed-width values by their type, the rest by their bytes."""
    parts = []
    for field in schema.fields:
        col = F.col(field.name)
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            parts.append(F.coalesce(F.sum(F.octet_length(col)), F.lit(0)))
        elif isinstance(field.dataType, (T.BooleanType, T.ByteType)):
            parts.append(F.count(col))
        elif isinstance(field.dataType, T.ShortType):
            parts.append(F.count(col) * 2)
        elif isinstance(field.dataType, (T.IntegerType, T.FloatType, T.DateType)):
            parts.append(F.count(col) * 4)
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            parts.append(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(col)))), F.lit(0)))
        else:
            parts.append(F.count(col) * 8)
    return reduce(lambda a, b: a + b, parts)


def table_sizes(tables: dict[str, DataFrame], key: str = "shard") -> DataFrame:
    """(shard, table, bytes) from the rows of each table, aggregated before anything is united."""
    parts = [
        df.groupBy(key).agg(
            row_bytes(T.StructType([f for f in df.schema.fields if f.name != key])).alias("bytes")
        ).select(key, F.lit(name).alias("table"), "bytes")
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def stored_sizes(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """(shard_no, table, bytes) of stored tables from their file sizes; no file is opened."""
    parts = [
        spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
        .groupBy("shard_no").agg(F.sum("length").alias("bytes"))
        .select("shard_no", F.lit(name).alias("table"), "bytes")
        for name, path in paths.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def default_weights(sizes: DataFrame, active: DataFrame, key: str | list[str] = "shard", unit: str = "MB") -> DataFrame:
    """Per active shard: size in whole megabytes, or another of SIZE_UNITS, with its unit, and the number of tables.

    A shard without tables has no size (null) and 0 tables. With `key` (island_no, shard) the rows can feed a plan.
    """
    keys = [key] if isinstance(key, str) else key
    whole = F.round(F.sum("bytes").cast("decimal(38,10)") / SIZE_UNITS[unit])
    per_shard = sizes.groupBy(*keys).agg(
        F.concat(whole.cast("decimal(38,0)").cast("string"), F.lit(f" {unit}")).alias("Size"),
        F.count_distinct("table").alias("Tables"),
    )
    return (
        active.select(*keys).distinct().join(per_shard, keys, "left")
        .select(*keys, "Size", F.coalesce("Tables", F.lit(0)).alias("Tables"))
    )


def size_weights(sizes: DataFrame, active: DataFrame, unit: str = "MB", include_isolated_shard0: bool = True) -> DataFrame:
    """Weight rows of the shards of all islands by their size: (island_no, shard, table, bytes) rows, active (island_no, shard)."""
    keys = ["island_no", "shard"]
    return _numbered(weight_rows(default_weights(sizes, active, keys, unit), keys), include_isolated_shard0)


def custom_weights(df: DataFrame, aggs: list[Column], active: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row per active shard with the given aggregates over its rows; the first is the weight.

    Shards without rows get what the aggregates give over no rows (a count of 0, a null sum).
    """
    keys = keys or ["shard"]
    found = df.groupBy(*keys).agg(*aggs)
    names = [c for c in found.columns if c not in keys]
    nothing = df.sparkSession.createDataFrame([], df.schema).agg(*aggs).first()
    found = found.withColumn("present", F.lit(True))
    values = [
        (F.col(c) if nothing[c] is None else F.when(F.col("present"), F.col(c)).otherwise(F.lit(nothing[c]))).alias(c)
        for c in names
    ]
    listed = active.select(*keys).distinct()
    return listed.join(found, keys, "left").select(*keys, *values)


def other_measures(df: DataFrame, weight_col: str, keys: list[str]) -> Column:
    """All columns but keys and weight as a map from name to text; a missing value is the text 'null'."""
    pairs = []
    for field in df.schema.fields:
        if field.name not in keys and field.name != weight_col:
            pairs += [F.lit(field.name), F.coalesce(number_text(F.col(field.name), field.dataType), F.lit("null"))]
    return F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")


def weight_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """Output of a weight query as (keys, weight_name, weight, unit, other); its first column is the weight."""
    names = [c for c in df.columns if c not in keys]
    if not names:
        raise ValueError("a weight query needs at least one output column")
    weight_col = names[0]
    parsed = parse_weight(weight_text(F.col(weight_col), df.schema[weight_col].dataType))
    shown = DEFAULT_WEIGHT_NAME if weight_col.startswith(UNNAMED_MARK) else weight_col
    return df.select(
        *keys,
        F.lit(shown).alias("weight_name"),
        parsed["weight"].alias("weight"),
        parsed["unit"].alias("unit"),
        other_measures(df, weight_col, keys).alias("other"),
    )


def drop_isolated_shard0(weights: DataFrame) -> DataFrame:
    """Leave out islands whose only active shard is the global shard 0."""
    isolated = (
        weights.groupBy("island_no")
        .agg(F.count(F.lit(1)).alias("shards"), F.max("shard_no").alias("last"))
        .filter((F.col("shards") == 1) & (F.col("last") == 0))
    )
    return weights.join(isolated, "island_no", "left_anti")


def island_weights(
    df: DataFrame, aggs: list[Column], active: DataFrame, include_isolated_shard0: bool = True
) -> DataFrame:
    """Weights of the shards of all islands in one job.

    df holds (island_no, shard, …) rows, active lists (island_no, shard). Labels
    without a number are dropped, after they counted for isolation.
    """
    keys = ["island_no", "shard"]
    return _numbered(weight_rows(custom_weights(df, aggs, active, keys), keys), include_isolated_shard0)


def _numbered(rows: DataFrame, include_isolated_shard0: bool) -> DataFrame:
    rows = rows.withColumn("shard_no", shard_no(F.col("shard")))
    if not include_isolated_shard0:
        rows = drop_isolated_shard0(rows)
    return rows.filter(F.col("shard_no").isNotNull())
