"""Changes read by position: offsets are positions per shard.

A feed knows how far each shard's changes have been taken. A batch is what lies between these positions and an end: the
latest ones, or a fence, one for all shards or one for each. It is a Spark job over the change files, to whose scan the range of positions is
pushed down. The sink is called with the batch and its number, and the positions are committed behind it; a batch whose
commit is lost is given again under its number, with the same end. A feed can be set to any positions, and goes on from there.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardkit.limits import broadcast_within
from shardkit.operators.progress import replication_gap
from shardkit.session import settle
from shardkit.sources.commits import CommitLog

_POSITIONS = "shard_no int, lsn bigint"


class PositionFeed:
    """Changes (shard_no, lsn, …) of a frame, which is read anew for each batch, with positions below `state`."""

    def __init__(self, spark: SparkSession, changes: Callable[[], DataFrame], state: str):
        self.spark, self.changes = spark, changes
        self.log = CommitLog(spark, state)

    def _known(self) -> dict[int, int]:
        return {int(shard): lsn for shard, lsn in self.log.head()[1].get("positions", {}).items()}

    def _frame(self, positions: dict[int, int]) -> DataFrame:
        # one row per shard
        return self.spark.createDataFrame(sorted(positions.items()), _POSITIONS)

    def committed(self) -> DataFrame:
        """(shard_no, lsn): how far each shard's changes have been taken."""
        return self._frame(self._known())

    def latest(self) -> DataFrame:
        """(shard_no, lsn): the last position there is of each shard; two columns are read, and combined in tasks first."""
        return self.changes().groupBy("shard_no").agg(F.max("lsn").alias("lsn"))

    def gap(self, fence: int | dict[int, int] | None = None) -> DataFrame:
        """(shard_no, gap): how far each shard is behind its latest position, or behind a fence."""
        target = self._frame(self._end(fence)).withColumnRenamed("lsn", "target")
        return replication_gap(self.committed(), target)

    def _end(self, fence: int | dict[int, int] | None) -> dict[int, int]:
        if isinstance(fence, dict):
            return fence
        latest = {r.shard_no: r.lsn for r in self.latest().collect()}
        return latest if fence is None else {shard: min(lsn, fence) for shard, lsn in latest.items()}

    def between(self, start: dict[int, int], end: dict[int, int]) -> DataFrame:
        """Changes behind the start positions, up to the end positions; shards without an end have none."""
        wider = {shard: (start.get(shard, -1), lsn) for shard, lsn in end.items() if lsn > start.get(shard, -1)}
        rows = [(shard, after, lsn) for shard, (after, lsn) in sorted(wider.items())]
        ranges = self.spark.createDataFrame(rows, "shard_no int, _after bigint, _to bigint")
        low, high = min([r[1] for r in rows], default=0), max([r[2] for r in rows], default=0)
        # the whole range prunes files and their parts, each shard's own is compared by row
        found = self.changes().filter((F.col("lsn") > low) & (F.col("lsn") <= high))
        found = found.join(broadcast_within(ranges), "shard_no")
        return found.filter((F.col("lsn") > F.col("_after")) & (F.col("lsn") <= F.col("_to"))).drop("_after", "_to")

    def step(self, sink: Callable[[DataFrame, int], None], fence: int | dict[int, int] | None = None) -> bool:
        """Give what lies up to the end, as one batch; False if there is nothing.

        The end is noted before the sink is called, so that a batch that is given again is the same. A sink that writes
        under the batch's number, in place of what is there, gets each change once.
        """
        version, content = self.log.head()
        start, batch = self._known(), content.get("batch", 0)
        end = {int(shard): lsn for shard, lsn in content.get("end", {}).items()}
        if not end:
            end = {shard: lsn for shard, lsn in self._end(fence).items() if lsn > start.get(shard, -1)}
            if not end:
                return False
            version = self._commit(version, {"positions": start, "batch": batch, "end": end})
        sink(self.between(start, end), batch)
        self._commit(version, {"positions": start | end, "batch": batch + 1})
        return True

    def seek(self, positions: dict[int, int]) -> None:
        """Go on from other positions, of all shards; a batch that was begun is given up."""
        version, content = self.log.head()
        self._commit(version, {"positions": positions, "batch": content.get("batch", 0) + 1})

    def _commit(self, version: int, content: dict) -> int:
        def change(newest: int, _: dict) -> dict:
            if newest != version:
                raise RuntimeError("another reader goes on with these positions")
            return content

        return self.log.commit(change)


def rows_by_shard(batch: DataFrame) -> DataFrame:
    """(shard_no, changes, lsn) of a batch, evaluated."""
    return settle(batch.groupBy("shard_no").agg(F.count(F.lit(1)).alias("changes"), F.max("lsn").alias("lsn")))
