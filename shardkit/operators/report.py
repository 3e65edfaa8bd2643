"""Shares and totals of weights.

Works on weight rows (island_no, shard_no, weight, unit, other): at most 10,000
per island, however large the tables behind them are.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shardkit.functions.numbers import leading_double, leading_number, number_text, percent_text


def shard_share(weights: DataFrame) -> DataFrame:
    """Adds each shard's ratio of its island's weight, and that as text; '-' on an island of weight 0."""
    total = F.sum("weight").over(Window.partitionBy("island_no"))
    ratio = F.when(total != 0, F.col("weight").cast("double") / total.cast("double"))
    return weights.withColumn("ratio", ratio).withColumn(
        "share", F.coalesce(percent_text(F.col("ratio")), F.lit("-"))
    )


def island_totals(weights: DataFrame) -> DataFrame:
    """Per island: weight, unit of its first shard, number of shards."""
    return weights.groupBy("island_no").agg(
        F.sum("weight").alias("weight"),
        F.min_by("unit", "shard_no").alias("unit"),
        F.count(F.lit(1)).alias("shards"),
    )


def other_totals(weights: DataFrame) -> DataFrame:
    """Per island and measure of its first shard: the sum of the leading numbers.

    Zeros and text without a number do not count; with nothing left the total is null. Sums are exact up to 28 digits before
    and 10 behind the point; where a number or the sum has more, it is a sum of doubles.
    """
    names = weights.groupBy("island_no").agg(F.min_by("other", "shard_no").alias("first"))
    names = names.select("island_no", F.explode(F.map_keys("first")).alias("measure"))
    numbers = (
        weights.select("island_no", F.explode("other").alias("measure", "text"))
        .select("island_no", "measure", leading_number(F.col("text")).alias("exact"), leading_double(F.col("text")).alias("near"))
        .filter(F.col("near") != 0)
        .groupBy("island_no", "measure").agg(
            F.try_sum("exact").alias("number"),
            F.sum("near").alias("near"),
            # also numbers that the decimal rounds
            F.bool_and(F.coalesce(F.col("exact").cast("double") == F.col("near"), F.lit(False))).alias("fits"),
        )
    )
    exact = number_text(F.col("number"), T.DecimalType(38, 10))
    near = number_text(F.col("near"), T.DoubleType())
    text = F.when(F.col("fits") & F.col("number").isNotNull(), exact).otherwise(near)
    return names.join(numbers, ["island_no", "measure"], "left").select("island_no", "measure", text.alias("total"))


def totals(weights: DataFrame, islands: DataFrame) -> DataFrame:
    """island_totals and grand_total in one aggregation: a row per island with shards, and one of all (`is_total`), island_no null.

    The unit of an island is that of its first shard, of all the first one there is. `islands` counts the listed ones.
    """
    listed = islands.select("island_no").distinct().select("island_no", F.lit(1).alias("listed"))
    rows = weights.select("island_no", "shard_no", "weight", "unit", F.lit(1).alias("shard"))
    place = F.struct("island_no", "shard_no")
    found = rows.unionByName(listed, allowMissingColumns=True).rollup("island_no").agg(
        F.grouping("island_no").alias("all"),
        F.coalesce(F.sum("weight"), F.lit(0)).alias("weight"),
        F.min_by("unit", F.when(F.col("shard") == 1, place)).alias("first"),
        F.min_by("unit", F.when(F.col("unit") != "", place)).alias("given"),
        F.count("listed").alias("islands"),
        F.count("shard").alias("shards"),
    )
    is_total = F.col("all") == 1
    unit = F.when(is_total, F.col("given")).otherwise(F.col("first")).alias("unit")
    return found.filter(is_total | (F.col("shards") > 0)).select(
        "island_no", is_total.alias("is_total"), "weight", unit, "islands", "shards"
    )


def grand_total(weights: DataFrame, islands: DataFrame) -> DataFrame:
    """One row: weight of everything, first unit there is, numbers of islands and shards."""
    return totals(weights, islands).filter("is_total").select("weight", "unit", "islands", "shards")


def island_share(placement: DataFrame, islands: DataFrame) -> DataFrame:
    """Each island's whole percentage of its plan's weight, its weight and number of shards.

    Islands without shards stay; a plan of weight 0 counts as weight 1.
    """
    per_island = placement.groupBy("plan_id", "island_no").agg(
        F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("shards")
    )
    rows = islands.select("plan_id", "island_no").join(per_island, ["plan_id", "island_no"], "left").select(
        "plan_id",
        "island_no",
        F.coalesce("weight", F.lit(0)).alias("weight"),
        F.coalesce("shards", F.lit(0)).alias("shards"),
    )
    total = F.sum("weight").over(Window.partitionBy("plan_id"))
    whole = F.coalesce(F.nullif(total, F.lit(0)), F.lit(1)).cast("double")
    percent = F.round(F.col("weight").cast("double") / whole * 100).cast("int")
    return rows.withColumn("percent", percent)
