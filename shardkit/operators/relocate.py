"""Moving shards between islands of a store (operators/store.py).

A move is published by one commit, and a failed one by none. The columns of a table are widened by the commit of the move
whose changes bring new ones, and rows stored before have nulls there. Changes that are there when a copy
is made are merged into it. Those that come later stay beside it, sorted, and are merged when the shard is
read: so what is written behind the fence depends on the late changes only, and not on the shard. A later move of the shard, or
`ShardStore.compact`, makes them part of a copy.

Moves may run side by side. Each commit looks at the state it meets: a shard that another writer has changed meanwhile
fails the move, which is then undone; otherwise it goes on from there.
"""

import json
import uuid
from collections.abc import Callable
from concurrent.futures import FIRST_EXCEPTION, ThreadPoolExecutor, wait
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Observation, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shardkit.functions.names import new_label, old_label, shard_name
from shardkit.limits import broadcast_within
from shardkit.operators.progress import advance_ids, backfill_progress, next_ids
from shardkit.operators.registry import ACTIVE, INACTIVE
from shardkit.operators.store import (
    ABSENT,
    COPY_PARTITIONS,
    REGISTRY_COLUMNS,
    REGISTRY_SCHEMA,
    MoveConflict,
    ShardStore,
    current_registry,
    next_version,
    unchanged,
)
from shardkit.plans.batches import DEFAULT_BATCHES, split_into_batches
from shardkit.session import settle
from shardkit.sources.layout import write_layout
from shardkit.streaming.apply import drain_to_fence, log_now, merge_changes

__all__ = [
    "ABSENT", "REGISTRY_SCHEMA", "ChangeSource", "MoveConflict", "ShardStore", "abort_move", "backfill", "commit_move",
    "current_registry", "move_in_batches", "move_progress", "move_shards", "moved_rows", "next_version",
]

# Catching up before the fence is called ends after so many rounds, or with one that finds nothing.
ROUNDS = 3


def moved_rows(df: DataFrame, moves: DataFrame, copy: str) -> DataFrame:
    """Rows of the moved shards (shard_no, from_island, to_island) under their new islands."""
    lookup = moves.select("shard_no", F.col("from_island").alias("island_no"), "to_island")
    moved = df.join(broadcast_within(lookup), ["island_no", "shard_no"])
    return moved.withColumn("island_no", F.col("to_island")).drop("to_island").withColumn("copy", F.lit(copy))


def backfill(tables: dict[str, DataFrame], moves: DataFrame, root: str, copy: str, clustered: bool = False) -> dict[str, int]:
    """Copy all rows of the moved shards of every table to their new islands, as an unpublished copy.

    One job per table, not per shard; without a shuffle for `clustered` tables,
    which are read from the stored layout. Returns the rows written of each, which the writing job counts.
    """
    return {name: _write(moved_rows(df, moves, copy), f"{root}/{name}", clustered) for name, df in tables.items()}


def _write(rows: DataFrame, path: str, clustered: bool) -> int:
    written = Observation()
    write_layout(rows.observe(written, F.count(F.lit(1)).alias("rows")), path, COPY_PARTITIONS, clustered)
    return written.get["rows"]


def commit_move(registry: DataFrame, moves: DataFrame, activate: bool, at: datetime) -> DataFrame:
    """Registry rows that publish moves: (shard_no, from_island, to_island, copies, and deltas if there are any).

    With `activate`, the shard becomes active on its new island, and what it
    leaves behind is inactive under an old label; both in the same rows. Without
    it (a dry run) the copy gets a new label, in place of an older one, and
    the shard stays where it is.
    """
    version = next_version(registry)
    stamp = F.lit(at.astimezone(timezone.utc).replace(tzinfo=None).strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp_ntz")
    # a shard that left the island within the same second has that label
    left = F.try_to_timestamp(F.regexp_extract("shard", r"old(\d{14})$", 1), F.lit("yyyyMMddHHmmss"))
    earlier = registry.groupBy(F.col("island_no").alias("from_island"), "shard_no").agg(
        (F.max(left.cast("timestamp_ntz")) + F.expr("INTERVAL 1 SECOND")).alias("free")
    )
    sources = current_registry(registry).select(
        F.col("island_no").alias("from_island"), "shard_no", "shard", "status",
        F.col("copies").alias("old_copies"), F.col("deltas").alias("old_deltas"),
    )
    if "deltas" not in moves.columns:
        moves = moves.withColumn("deltas", F.lit(None).cast("map<string,array<string>>"))
    label = shard_name(F.col("shard_no"))
    named = moves.join(sources.filter(F.col("status") == ACTIVE), ["from_island", "shard_no"])
    named = named.join(earlier, ["from_island", "shard_no"], "left")
    stamp = F.greatest(stamp, F.col("free"))

    def row(island: str, shard: Column, status: str, kept: str = "") -> Column:
        return F.struct(
            F.lit(version).cast("bigint").alias("version"),
            F.col(island).alias("island_no"),
            shard.alias("shard"),
            F.col("shard_no"),
            F.lit(status).alias("status"),
            F.col(f"{kept}copies").alias("copies"),
            F.col(f"{kept}deltas").alias("deltas"),
        )

    if activate:
        rows = [
            row("from_island", F.col("shard"), ABSENT, "old_"),
            row("from_island", old_label(F.col("shard"), stamp), INACTIVE, "old_"),
            row("to_island", F.col("shard"), ACTIVE),
        ]
    else:
        rows = [row("to_island", new_label(label), INACTIVE)]
    return named.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


@dataclass
class ChangeSource:
    """Changes of one table: as a stream, as a batch frame, its key columns and the snapshot position.

    Read the position before the move starts: changes at or below it are in the copied rows already, and an
    older change must not replace a newer row.
    """

    feed: DataFrame
    written: DataFrame
    keys: list[str]
    snapshot_lsn: int


def abort_move(store: ShardStore, copy: str) -> None:
    """Drop the partial copies of a failed move; the source was never touched."""
    store.drop_copy(copy)
    store.unmark(copy)


def move_shards(
    store: ShardStore,
    moves: DataFrame,
    changes: dict[str, ChangeSource] | None = None,
    fence_lsn: int | Callable[[], int] | None = None,
    activate: bool = True,
    at: datetime | None = None,
    id_columns: dict[str, str] | None = None,
    before_commit: Callable[[str], None] | None = None,
    after_table: Callable[[str, str], None] | None = None,
) -> DataFrame | None:
    """Move shards (shard_no, from_island, to_island): copy, catch up, stop at the fence, publish.

    All shards of the moves go through one job per table. Changes that are there
    when the copy starts are merged into it; those that come meanwhile are logged in short rounds. Then the fence is
    called, which stops writers and returns the last position, and what is still missing up to it is logged. The log becomes a
    part of the shards it has changes of. A number in place of the fence leaves out what lies behind it from the start.

    `after_table` is called with the copy's name and a table when that is copied; move_progress tells then how far the move is.
    Returns the ids the new islands go on with, if id_columns names the id column
    of tables. On any failure before publishing the partial copy is dropped and
    the error raised; MoveConflict if another writer has changed one of the shards.
    """
    if changes and fence_lsn is None:
        raise ValueError("a move with changes needs the position up to which they belong to it")
    copy = f"c-{uuid.uuid4().hex}"
    # bounded by the number of shards; read by every step below
    moves = settle(moves.select("shard_no", "from_island", "to_island"))
    rows = _check_moves(moves, store.registry())
    progress = _Progress(store, copy, [r.shard_no for r in rows], [r.island_no for r in rows])
    try:
        catch_ups = {t: _CatchUp(store, t, source, moves, rows, copy) for t, source in (changes or {}).items()}
        known = None if callable(fence_lsn) else fence_lsn
        for table in store.tables:
            progress.note(table, "d")
            if table in catch_ups:
                written = catch_ups[table].first(known)
            else:
                written = backfill({table: store.rows_of(table, rows)}, moves, store.root, copy, clustered=True)[table]
            progress.note(table, "f" if table in catch_ups else "s", written)
            if after_table is not None:
                after_table(copy, table)
        for _ in range(ROUNDS if callable(fence_lsn) else 0):
            if not any([catch_up.round(known) for catch_up in catch_ups.values()]):
                break
        if catch_ups:
            fence = fence_lsn() if callable(fence_lsn) else fence_lsn
            for table, catch_up in catch_ups.items():
                catch_up.last(fence)
                progress.note(table, "s")
        stats = _add_stats(store, moves, rows, copy, catch_ups)
        copies = F.create_map(*[F.lit(x) for table in store.tables for x in (table, copy)])
        copied = moves.withColumn("copies", copies)
        for table, catch_up in catch_ups.items():
            copied = copied.join(broadcast_within(catch_up.late()), "shard_no", "left")
        # an entry for each table with changes behind the copy
        entries = [F.when(F.col(f"late_{t}"), F.struct(F.lit(t), F.array(F.lit(copy)))) for t in catch_ups]
        deltas = F.map_from_entries(F.array_compact(F.array(*entries))) if entries else F.lit(None)
        copied = settle(copied.withColumn("deltas", deltas.cast("map<string,array<string>>")))
        ids = settle(_ids_after(store, moves, copy, id_columns, catch_ups, stats)) if id_columns else None
        if before_commit is not None:
            before_commit(copy)

        def publication(registry: DataFrame) -> DataFrame:
            unchanged(registry, rows)
            return settle(commit_move(registry, copied, activate, at or datetime.now(timezone.utc)))

        store.commit(publication, {t: c.declared for t, c in catch_ups.items() if c.declared}, stats)
    except BaseException:
        # also when interrupted
        abort_move(store, copy)
        raise
    for table, catch_up in catch_ups.items():
        # changes that are part of the copy
        store.drop_log(table, copy, None if catch_up.late().first() is None else catch_up.seen)
    store.unmark(copy)
    return ids


class _Progress:
    """What a running move has done, with the mark that it runs."""

    def __init__(self, store: ShardStore, copy: str, shards: list[int], islands: list[int]):
        self.store, self.copy = store, copy
        self.state = {"shards": shards, "islands": islands, "tables": {t: {"state": "i", "rows": 0} for t in store.tables}}
        self._save()

    def note(self, table: str, state: str, rows: int | None = None) -> None:
        self.state["tables"][table]["state"] = state
        if rows is not None:
            self.state["tables"][table]["rows"] = rows
        self._save()

    def _save(self) -> None:
        self.store.mark(self.copy, json.dumps(self.state))


def move_progress(store: ShardStore, copy: str) -> DataFrame:
    """Progress of a running move, as backfill_progress gives it: nothing is counted again.

    Rows to copy come from the statistics of the shards' copies, rows copied from what each table's writing job has counted.
    """
    spark, state = store.spark, store.running()[copy]
    places = spark.createDataFrame(list(zip(state["shards"], state["islands"])), "shard_no int, island_no int")
    own = store.statistics().join(broadcast_within(places), ["shard_no", "island_no"], "left_semi")
    src = own.groupBy("table").agg(F.sum("rows").alias("rows"))
    tables = state["tables"].items()
    dst = spark.createDataFrame([(t, s["rows"]) for t, s in tables], "table string, rows bigint")
    states = spark.createDataFrame([(t, s["state"]) for t, s in tables], "table string, state string")
    return backfill_progress(src, dst, states)


class _CatchUp:
    """A table's copy in a move, and the log of changes that go with it.

    Changes of batches up to `seen` are part of the copy. `declared` holds the table's columns if the changes bring new ones.
    """

    def __init__(self, store: ShardStore, table: str, source: ChangeSource, moves: DataFrame, rows: list[Row], copy: str):
        self.store, self.table, self.source, self.moves, self.rows, self.copy = store, table, source, moves, rows, copy
        self.log = f"{store.root}/_changes/{table}/log={copy}"
        self.stream = f"{store.root}/_streams/{table}/{copy}"
        self.seen, self.logged = -1, -1
        self.schema = self._widened()
        self.declared = None
        if self.schema != store.declared(table):
            self.declared = {"schema": self.schema.jsonValue()}

    def _widened(self) -> T.StructType:
        """Columns with those that changes bring; a type that differs from the declared one is refused."""
        declared = self.store.declared(self.table)
        types = {f.name: f.dataType for f in declared}
        payload = self.source.written.schema["payload"].dataType
        other = [f.name for f in payload if f.name in types and types[f.name] != f.dataType]
        if other:
            raise ValueError(f"changes have other types than rows: {', '.join(other)}")
        lost = set(types) - set(payload.names) - {*self.source.keys}
        if lost:
            raise ValueError(f"changes and rows differ in columns: {', '.join(sorted(lost))}")
        new = [T.StructField(f.name, f.dataType) for f in payload if f.name not in types]
        return T.StructType([*declared, *new])

    def _catch_up(self, fence: int | None) -> DataFrame:
        """Log what has come, up to the fence if it is known."""
        source = self.source
        return log_now(
            source.feed, source.written, self.log, self.stream, source.keys, self.moves, source.snapshot_lsn, fence
        )

    def first(self, fence: int | None) -> int:
        """The copy itself, with the changes that are there; returns its rows."""
        log = self._catch_up(fence)
        base = moved_rows(self.store.rows_of(self.table, self.rows, self.schema), self.moves, self.copy).drop("copy", "island_no")
        islands = broadcast_within(self.moves.select("shard_no", F.col("to_island").alias("island_no")))
        merged = merge_changes(base, log.drop("batch"), self.source.keys).join(islands, "shard_no")
        written = _write(merged.withColumn("copy", F.lit(self.copy)), f"{self.store.root}/{self.table}", True)
        self.seen = self.logged = _last_batch(log)
        return written

    def round(self, fence: int | None) -> bool:
        """Log changes that came since; False if there are none."""
        before, self.logged = self.logged, _last_batch(self._catch_up(fence))
        return self.logged > before

    def last(self, fence: int) -> None:
        source = self.source
        log = drain_to_fence(
            source.feed, source.written, fence, self.log, self.stream, source.keys, self.moves, source.snapshot_lsn
        )
        beyond = log.agg(F.max("lsn")).first()[0]
        if beyond is not None and beyond > fence:
            raise RuntimeError(f"position {beyond} lies behind the fence and is copied already")
        self._late = settle(log.filter(F.col("batch") > self.seen).select("shard_no").distinct())

    def late(self) -> DataFrame:
        """Shards with changes that are not part of the copy."""
        return self._late.withColumn(f"late_{self.table}", F.lit(True))


def _last_batch(log: DataFrame) -> int:
    return log.agg(F.max("batch")).first()[0]


def _add_stats(store: ShardStore, moves: DataFrame, rows: list[Row], copy: str, catch_ups: dict[str, _CatchUp]) -> list[str]:
    """Parts with the statistics of a move's copies and logs; a copy without changes has those of the copies it was made of."""
    islands = moves.select("shard_no", F.col("to_island").alias("island_no"))
    found = []
    for table in store.tables:
        if table in catch_ups:
            found.append(store.measured(table, [copy], catch_ups[table].schema))
            found.append(store.measured_changes(table, copy, islands, catch_ups[table].seen))
        elif any((r.deltas or {}).get(table) for r in rows):
            found.append(store.measured(table, [copy]))
        else:
            found.append(store.inherited(table, copy, moves))
    return [store.add_stats(part) for part in found]


def move_in_batches(
    store: ShardStore,
    moves: DataFrame,
    order: str = "move_no",
    batches: int = DEFAULT_BATCHES,
    at_once: int = 1,
    **options,
) -> None:
    """Move shards in contiguous batches of an ordered list, each published on its own, `at_once` of them side by side.

    A batch that fails is undone and ends the call: those that run beside it finish, later ones do not start, and
    what is published stays moved.
    """
    whole = moves.withColumn("plan_id", F.lit("all"))
    batched = settle(split_into_batches(whole, [order], batches, ["plan_id"]))
    numbers = sorted(r.batch for r in batched.select("batch").distinct().collect())
    if at_once == 1:
        for number in numbers:
            move_shards(store, batched.filter(F.col("batch") == number), **options)
        return

    @inheritable_thread_target(store.spark)
    def move(number: int) -> None:
        move_shards(store, batched.filter(F.col("batch") == number), **options)

    with ThreadPoolExecutor(at_once) as pool:
        running = [pool.submit(move, number) for number in numbers]
        done, later = wait(running, return_when=FIRST_EXCEPTION)
        for batch in later:
            batch.cancel()
    for batch in running:
        if not batch.cancelled():
            batch.result()


def _check_moves(moves: DataFrame, registry: DataFrame) -> list[Row]:
    """The current registry rows of the shards; those that cannot be moved fail."""
    twice = moves.groupBy("shard_no").count().filter(F.col("count") > 1).first()
    if twice is not None:
        raise ValueError(f"shard {twice.shard_no} is to be moved more than once")
    live = current_registry(registry).filter(F.col("status") == ACTIVE)
    places = moves.select("shard_no", F.col("from_island").alias("island_no"))
    found = live.join(broadcast_within(places), ["shard_no", "island_no"], "left_semi").select(*REGISTRY_COLUMNS).collect()
    known = {(r.shard_no, r.island_no) for r in found}
    for r in places.collect():
        if (r.shard_no, r.island_no) not in known:
            raise ValueError(f"shard {r.shard_no} is not active on island {r.island_no}")
    return found


def _ids_after(
    store: ShardStore,
    moves: DataFrame,
    copy: str,
    id_columns: dict[str, str],
    catch_ups: dict[str, _CatchUp],
    stats: list[str],
) -> DataFrame:
    """From statistics where they have the ids; else rows are read, of the islands that shards leave or come to only."""
    islands = sorted({i for r in moves.select("from_island", "to_island").distinct().collect() for i in r})
    if all(store.id_column(t) == c for t, c in id_columns.items()):
        next_id = (F.coalesce(F.max("max_id"), F.lit(0)) + 1).alias("next_id")
        name = F.col("table").alias("name")
        wanted = F.col("table").isin(list(id_columns))
        src = store.statistics().filter(wanted & F.col("island_no").isin(islands)).groupBy(name).agg(next_id)
        dst = store.stats_of(stats).filter(wanted).groupBy(name).agg(next_id)
        return advance_ids(src, dst)
    src = {t: store.table(t).filter(F.col("island_no").isin(islands)) for t in id_columns}
    dst = {}
    for table, column in id_columns.items():
        own = store.stored(table, [copy], catch_ups[table].schema if table in catch_ups else None).select(column)
        if table in catch_ups:
            log = store.changes(table, [copy])
            own = own.unionByName(log.select(F.col(column if column in log.columns else f"payload.{column}").alias(column)))
        dst[table] = own
    return advance_ids(next_ids(src, id_columns), next_ids(dst, id_columns))
