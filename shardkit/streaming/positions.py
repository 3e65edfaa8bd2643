"""A table kept current by changes, with the position of the last change of every key.

Rows of a shard are stored with the lsn of the change they come from; keys whose last change is a delete are
stored with its lsn as tombstones. A change counts only if its lsn is above its key's. So changes may come in any order,
any number of times and over any number of streams: replays change nothing, an insert that
is older than its key's delete does not bring the row back, and a copy may be made at any time, as each of
its rows knows what it has seen.

Micro-batches append the latest change of each of their keys to a log, sorted by shard and key; the log is merged
with the rows when they are read. `compact` writes rows and tombstones anew as the next generation.
Which generation counts, and which batches are part of it, is one small file created only if absent.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from shardkit.limits import broadcast_within, fits
from shardkit.sources.changes import DELETE, UPDATE
from shardkit.sources.commits import CommitLog, delete, names
from shardkit.sources.layout import exists
from shardkit.streaming.apply import latest_changes

# Position of rows that were there before any change.
FIRST = -(1 << 63)


class PositionedTable:
    """Rows (shard_no, key columns, other columns) below one folder, by shard, with their positions."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.versions = CommitLog(spark, f"{root}/_versions")
        content = self.versions.head()[1]
        if not content:
            raise ValueError(f"no table there: {root}")
        self.keys = content["keys"]
        self.schema = T.StructType.fromJson(content["schema"])

    @classmethod
    def create(
        cls,
        spark: SparkSession,
        root: str,
        rows: DataFrame,
        keys: list[str],
        positions: str | None = None,
        tombstones: DataFrame | None = None,
    ) -> "PositionedTable":
        """Store rows that have shard_no and the key columns.

        `positions` names their column of lsns, which is stored apart from the other columns; without it any change is
        newer. tombstones: (shard_no, keys, lsn) of deleted keys.
        """
        if exists(spark, f"{root}/_versions"):
            raise ValueError(f"there is a table already: {root}")
        columns = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema if f.name not in ("shard_no", positions)])
        lsn = F.lit(FIRST) if positions is None else F.coalesce(F.col(positions).cast("bigint"), F.lit(FIRST))
        others = [f.name for f in columns if f.name not in keys]
        current = rows.select("shard_no", *keys, F.lit(UPDATE).alias("op"), F.struct(*others).alias("payload"), lsn.alias("lsn"))
        if tombstones is not None:
            current = current.unionByName(tombstones.select("shard_no", *keys, "lsn", F.lit(DELETE).alias("op")), allowMissingColumns=True)
        generation = _write_generation(current, root, keys)
        content = {"keys": keys, "schema": columns.jsonValue(), "generation": generation, "folded": []}
        CommitLog(spark, f"{root}/_versions").commit(lambda version, before: _first(before, content))
        return cls(spark, root)

    def apply(
        self,
        feed: DataFrame,
        stream: str,
        shards: DataFrame | None = None,
        fence_lsn: int | None = None,
        available_now: bool = True,
    ) -> StreamingQuery:
        """Start logging a stream of changes (shard_no, op, lsn, keys, payload) under a name of its own.

        A stream that is started again under its name goes on where it stopped; a batch that is run again replaces its part.
        Streams may be several, and may bring the same changes.
        """
        if fence_lsn is not None:
            feed = feed.filter(F.col("lsn") <= fence_lsn)
        if shards is not None:
            feed = feed.join(broadcast_within(shards.select("shard_no").distinct()), "shard_no", "left_semi")
        payload = [f.name for f in self.schema if f.name not in self.keys]
        given = feed.schema["payload"].dataType.names
        if set(given) != set(payload):
            raise ValueError(f"changes and rows differ in columns: {', '.join(sorted(set(given) ^ set(payload)))}")

        def store(batch: DataFrame, batch_id: int) -> None:
            latest = latest_changes(batch.withColumn("payload", F.struct(*[f"payload.{c}" for c in payload])), self.keys)
            if latest.first() is None:
                return
            latest = latest.sortWithinPartitions("shard_no", *self.keys)
            latest.write.mode("overwrite").parquet(f"{self.root}/_log/part={stream}-{batch_id}")

        writer = feed.writeStream.foreachBatch(store).option("checkpointLocation", f"{self.root}/_streams/{stream}")
        return (writer.trigger(availableNow=True) if available_now else writer).start()

    def _state(self) -> tuple[DataFrame, DataFrame | None, list[str]]:
        """Rows and tombstones of the generation, changes logged since or None, and the names of their parts."""
        content = self.versions.head()[1]
        current = self.spark.read.parquet(f"{self.root}/generation={content['generation']}")
        folded = set(content["folded"])
        parts = [p for p in names(self.spark, f"{self.root}/_log") if p.startswith("part=") and p.removeprefix("part=") not in folded]
        # a part that is being written has no mark yet
        parts = [p for p in parts if exists(self.spark, f"{self.root}/_log/{p}/_SUCCESS")]
        if not parts:
            return current, None, []
        logged = self.spark.read.schema(current.schema).parquet(*[f"{self.root}/_log/{p}" for p in parts])
        return current, logged, [p.removeprefix("part=") for p in parts]

    def _merged(self) -> DataFrame:
        """The last change of every key, rows and tombstones."""
        current, logged, _ = self._state()
        if logged is None:
            return current
        on = ["shard_no", *self.keys]
        latest = latest_changes(logged, self.keys)
        touched = latest.select(*on)
        # counted are changes; rows whose key has none stay in the tasks that read them
        if fits(logged.select(*on)):
            touched = F.broadcast(touched)
        rest = current.join(touched, on, "left_anti")
        both = current.join(touched, on, "left_semi").unionByName(latest)
        return rest.unionByName(latest_changes(both, self.keys))

    def rows(self) -> DataFrame:
        """Rows after all changes logged so far."""
        live = self._merged().filter(F.col("op") != DELETE)
        return live.select("shard_no", *self.keys, "payload.*").select("shard_no", *[f.name for f in self.schema])

    def positions(self) -> DataFrame:
        """(shard_no, keys, lsn, deleted) of every key that ever had a row or a change; lsn null for rows without a change."""
        lsn = F.when(F.col("lsn") != FIRST, F.col("lsn"))
        return self._merged().select("shard_no", *self.keys, lsn.alias("lsn"), (F.col("op") == DELETE).alias("deleted"))

    def compact(self, forget_through: int | None = None) -> None:
        """Write rows and tombstones anew, with all changes logged so far.

        With `forget_through`, tombstones up to that lsn go: only for feeds that never bring changes that old again.
        """
        before = self.versions.head()[1]["generation"]
        _, _, parts = self._state()
        merged = self._merged()
        if forget_through is not None:
            merged = merged.filter((F.col("op") != DELETE) | (F.col("lsn") > forget_through))
        generation = _write_generation(merged, self.root, self.keys)

        def next_content(_: int, content: dict) -> dict:
            if content["generation"] != before:
                raise RuntimeError("another writer has compacted the table meanwhile")
            # a part that stays behind its deletion, or comes again, changes nothing
            return {**content, "generation": generation, "folded": parts}

        try:
            self.versions.commit(next_content)
        except BaseException:
            delete(self.spark, f"{self.root}/generation={generation}")
            raise
        for old in [f"generation={before}", *[f"_log/part={p}" for p in parts]]:
            delete(self.spark, f"{self.root}/{old}")

    def copy_to(self, root: str, shards: DataFrame | None = None) -> "PositionedTable":
        """A second copy, of some shards only if given, that can go on with any stream of the same changes."""
        merged = self._merged()
        if shards is not None:
            merged = merged.join(broadcast_within(shards.select("shard_no").distinct()), "shard_no", "left_semi")
        generation = _write_generation(merged, root, self.keys)
        content = {"keys": self.keys, "schema": self.schema.jsonValue(), "generation": generation, "folded": []}
        CommitLog(self.spark, f"{root}/_versions").commit(lambda version, before: _first(before, content))
        return PositionedTable(self.spark, root)


def _first(before: dict, content: dict) -> dict:
    if before:
        raise ValueError("there is a table already")
    return content


def _write_generation(current: DataFrame, root: str, keys: list[str]) -> str:
    generation = uuid.uuid4().hex
    rows = current.select("shard_no", *keys, "op", "payload", "lsn").hint("rebalance", "shard_no")
    rows.sortWithinPartitions("shard_no", *keys).write.parquet(f"{root}/generation={generation}")
    return generation
