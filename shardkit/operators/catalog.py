"""Which columns each shard of a table has, by version, and tables whose shards have drifted apart.

A catalog is fed by writes: whoever writes shards records their columns with them. The newest record of a table's shard
tells its columns; older versions can be read as well. A table's union has one branch per set of columns, however many
shards share it, and a column of different types is given in the least type that holds them all.
"""

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shardkit.functions.names import shard_name
from shardkit.limits import broadcast_within
from shardkit.operators.federate import changed_tables, fingerprints
from shardkit.session import settle
from shardkit.sources.commits import CommitLog
from shardkit.sources.layout import write_layout

_ROWS = "version bigint, table string, shard_no int, schema string"
# Digits of whole numbers.
_DIGITS = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 19}
_MOST_DIGITS = 38


def widest(types: list[T.DataType]) -> T.DataType:
    """The least type that holds all values of some types exactly; text if there is none.

    Whole numbers widen to longer ones and to decimals, up to 38 digits; floats, and whole numbers of 10 digits or fewer beside them, to doubles.
    """
    kinds = list(dict.fromkeys(types))
    if len(kinds) == 1:
        return kinds[0]
    whole = [t for t in kinds if type(t) in _DIGITS]
    if len(whole) == len(kinds):
        return max(whole, key=lambda t: _DIGITS[type(t)])
    decimals = [t for t in kinds if isinstance(t, T.DecimalType)]
    if len(whole) + len(decimals) == len(kinds):
        scale = max(t.scale for t in decimals)
        digits = max([t.precision - t.scale for t in decimals] + [_DIGITS[type(t)] for t in whole])
        return T.DecimalType(digits + scale, scale) if digits + scale <= _MOST_DIGITS else T.StringType()
    floats = [t for t in kinds if isinstance(t, (T.FloatType, T.DoubleType))]
    if len(whole) + len(floats) == len(kinds) and not any(isinstance(t, T.LongType) for t in whole):
        return T.DoubleType()
    return T.StringType()


class ColumnCatalog:
    """Columns per table, shard and version below a folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.log = CommitLog(spark, f"{root}/versions")

    def record(self, table: str, shards: list[int], schema: T.StructType) -> int:
        """Record the columns of some shards of a table; returns the version. Shards without columns are gone."""
        text = json.dumps(T.StructType([T.StructField(f.name, f.dataType) for f in schema]).jsonValue())

        def change(version: int, content: dict) -> dict:
            part = uuid.uuid4().hex
            rows = self.spark.createDataFrame([(version + 1, table, s, text) for s in shards], _ROWS)
            rows.coalesce(1).write.parquet(f"{self.root}/rows/part={part}")
            return {"parts": [*content.get("parts", []), part]}

        return self.log.commit(change)

    def shards(self, version: int | None = None) -> DataFrame:
        """(table, shard_no, schema) as JSON, of every shard, now or at a version."""
        paths = [f"{self.root}/rows/part={p}" for p in self.log.head()[1].get("parts", [])]
        if not paths:
            return self.spark.createDataFrame([], _ROWS).drop("version")
        rows = self.spark.read.schema(_ROWS).parquet(*paths)
        if version is not None:
            rows = rows.filter(F.col("version") <= version)
        newest = rows.groupBy("table", "shard_no").agg(F.max_by("schema", "version").alias("schema"))
        return newest.filter(F.size(F.get(F.array(F.from_json("schema", "fields array<struct<name: string>>")), 0)["fields"]) > 0)

    def columns(self, version: int | None = None) -> DataFrame:
        """Catalog rows (shard, table, column, type), for table_inventory and fingerprints."""
        # types as JSON: one row per set of columns becomes names and types here
        kinds = [r.schema for r in self.shards(version).select("schema").distinct().collect()]
        fields = [(k, f.name, f.dataType.simpleString()) for k in kinds for f in T.StructType.fromJson(json.loads(k))]
        named = self.spark.createDataFrame(fields, "schema string, column string, type string")
        return self.shards(version).join(broadcast_within(named), "schema").select(
            shard_name(F.col("shard_no")).alias("shard"), "table", "column", "type"
        )

    def write(self, table: str, df: DataFrame, path: str) -> int:
        """Write shards of a table (shard_no, columns) below a path, in place of what these shards had; records their columns."""
        seen = Observation()
        rows = df.observe(seen, F.collect_set("shard_no").alias("shards"))
        write_layout(rows, f"{path}/{table}", ["shard_no"])
        return self.record(table, sorted(seen.get["shards"]), T.StructType([f for f in df.schema if f.name != "shard_no"]))

    def union(self, table: str, path: str) -> DataFrame:
        """Rows of all shards of a table under their labels: `shard`, `id` if there is one, and the other columns by name."""
        known = self.shards().filter(F.col("table") == table).groupBy("schema").agg(F.collect_set("shard_no").alias("shards")).collect()
        if not known:
            raise ValueError(f"no such table: {table}")
        schemas = [T.StructType.fromJson(json.loads(r.schema)) for r in known]
        types: dict[str, list[T.DataType]] = {}
        for schema in schemas:
            for f in schema:
                types.setdefault(f.name, []).append(f.dataType)
        columns = sorted(types, key=lambda c: (c != "id", c))
        shard = shard_name(F.col("shard_no")).alias("shard")
        whole = T.StructField("shard_no", T.IntegerType())

        def branch(schema: T.StructType, shards: list[int]) -> DataFrame:
            rows = self.spark.read.schema(T.StructType([*schema, whole])).option("basePath", f"{path}/{table}")
            rows = rows.parquet(*[f"{path}/{table}/shard_no={s}" for s in sorted(shards)])
            have = set(schema.names)
            return rows.select(shard, *[(F.col(f"`{c}`") if c in have else F.lit(None)).cast(widest(types[c])).alias(c) for c in columns])

        return reduce(DataFrame.unionByName, [branch(s, r.shards) for s, r in zip(schemas, known)])

    def refresh(self, path: str, manifest: DataFrame, rebuild: Callable[[str, DataFrame], None]) -> tuple[list[str], DataFrame]:
        """Rebuild the union of every table of which some shard's columns changed; (names, new manifest) as refresh_if_changed."""
        columns = settle(self.columns())
        changed = sorted(r.table for r in changed_tables(columns, manifest).select("table").collect())
        for name in changed:
            rebuild(name, self.union(name, path))
        return changed, settle(fingerprints(columns))


