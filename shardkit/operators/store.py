"""Tables of shards below one root folder, with a registry of which copies and changes belong to a shard.

A store keeps every table below `<root>/<table>/copy=…/island_no=…/shard_no=…`, and changes that came
after a copy was made below `<root>/_changes/<table>/log=…/batch=…`, sorted. The registry (REGISTRY_SCHEMA)
is a log of rows; the newest row of an island and label is its state: `copies` tells which copy of each
table belongs to it, `deltas` which logs of changes are merged with that copy when it is read. A copy or log that no
current row names is invisible.

All that is known of a store, which parts of the registry count and the columns of its tables, is one small file per
version, created only if absent. So a commit appears at once, and writers that run side by side notice
each other: the one that comes second looks at the new state and tries again, or fails if the other
changed what it built on. What a running move has written is marked, and left alone by cleanups.

Statistics (rows, bytes and the largest id of every copy, island, shard and table, and of every log) are written with each
publication, so that weights by size, and ids, need neither scans nor listings.
"""

import json
import uuid
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shardkit.functions.names import shard_name
from shardkit.limits import broadcast_within, fits
from shardkit.operators.registry import ACTIVE, INACTIVE, activate_shards, deactivate_shards, retired_shards
from shardkit.operators.weights import row_bytes
from shardkit.session import settle
from shardkit.sources.commits import CommitLog, delete, names, read_text, write_text
from shardkit.sources.layout import exists, place_rows, write_layout
from shardkit.streaming.apply import latest_changes, with_changes

ABSENT = "absent"

REGISTRY_SCHEMA = (
    "version bigint, island_no int, shard string, shard_no int, status string, copies map<string,string>, "
    "deltas map<string,array<string>>"
)
REGISTRY_COLUMNS = [column.split()[0] for column in REGISTRY_SCHEMA.split(", ")]
COPY_PARTITIONS = ["copy", "island_no", "shard_no"]
STATS_SCHEMA = (
    "table string, copy string, island_no int, shard_no int, rows bigint, value_bytes bigint, bytes bigint, max_id bigint, "
    "changes boolean"
)
# Beyond so many parts the registry is written anew as one.
MOST_PARTS = 32
# Up to so many shards are read by naming their directories, more by those of their copies.
MOST_NAMED = 500


class MoveConflict(ValueError):
    """Another writer changed a shard meanwhile."""


def current_registry(registry: DataFrame) -> DataFrame:
    """The newest row of every (island, label), without those that are gone."""
    rest = F.struct("version", "shard_no", "status", "copies", "deltas")
    newest = registry.groupBy("island_no", "shard").agg(F.max_by(rest, "version").alias("s"))
    return newest.select("island_no", "shard", "s.*").filter(F.col("status") != ABSENT).select(*REGISTRY_COLUMNS)


def next_version(registry: DataFrame) -> int:
    return (registry.agg(F.max("version")).first()[0] or 0) + 1


def log_names(table: str) -> Column:
    """The logs of changes of a registry row for a table; an empty array if it has none."""
    return F.coalesce(F.try_element_at("deltas", F.lit(table)), F.array().cast("array<string>"))


class ShardStore:
    """Tables and registry below one root folder."""

    def __init__(self, spark: SparkSession, root: str, tables: list[str] | None = None):
        self.spark, self.root = spark, root
        self.log = CommitLog(spark, f"{root}/_registry/versions")
        self.tables = tables or list(self.log.head()[1]["tables"])

    @classmethod
    def create(
        cls,
        spark: SparkSession,
        root: str,
        tables: dict[str, DataFrame],
        placement: DataFrame,
        id_columns: dict[str, str] | None = None,
    ) -> "ShardStore":
        """Store tables with a shard_no column by a placement (shard_no, island_no); all shards become active.

        `id_columns` names tables' columns of ids, of which the largest are kept with the statistics.
        """
        store = cls(spark, root, list(tables))
        if exists(spark, f"{root}/_registry"):
            raise ValueError(f"there is a store already: {root}")
        copy, declared = "c-first", {}
        for name, df in tables.items():
            placed = place_rows(df, placement).withColumn("copy", F.lit(copy))
            write_layout(placed, f"{root}/{name}", COPY_PARTITIONS)
            columns = T.StructType([T.StructField(f.name, f.dataType) for f in df.schema if f.name not in COPY_PARTITIONS])
            declared[name] = {"schema": columns.jsonValue(), "id": (id_columns or {}).get(name)}
        copies = F.create_map(*[F.lit(x) for name in tables for x in (name, copy)])
        rows = placement.select(
            F.lit(1).cast("bigint").alias("version"),
            F.col("island_no").cast("int").alias("island_no"),
            shard_name(F.col("shard_no")).alias("shard"),
            F.col("shard_no").cast("int").alias("shard_no"),
            F.lit(ACTIVE).alias("status"),
            copies.alias("copies"),
        )
        store.commit(lambda _: rows, declared)
        store.commit(lambda registry: registry.limit(0), stats=[store.add_stats(store.measured(name, [copy])) for name in tables])
        return store

    # what is known

    def _parts(self, content: dict) -> DataFrame:
        folder = f"{self.root}/_registry/rows"
        paths = [f"{folder}/part={p}" for p in content.get("parts", [])]
        if not paths:
            return self.spark.createDataFrame([], REGISTRY_SCHEMA)
        return self.spark.read.schema(REGISTRY_SCHEMA).parquet(*paths)

    def registry(self) -> DataFrame:
        return self._parts(self.log.head()[1])

    def registry_now(self, status: str | None = None) -> DataFrame:
        """Current registry rows, of one status if given."""
        current = current_registry(self.registry())
        return current if status is None else current.filter(F.col("status") == status)

    def commit(
        self, change: Callable[[DataFrame], DataFrame], declared: dict[str, dict] | None = None, stats: Iterable[str] = ()
    ) -> int:
        """Append the registry rows that `change` makes of the registry, all at once; again if others were faster.

        `change` raises MoveConflict if the new state rules its rows out. `declared` widens tables' columns with it, and
        `stats` are parts of statistics that count from now on. Returns the number of the version.
        """

        def next_content(_: int, content: dict) -> dict:
            registry = self._parts(content)
            rows = change(registry)
            if "deltas" not in rows.columns:
                rows = rows.withColumn("deltas", F.lit(None).cast("map<string,array<string>>"))
            rows = rows.select(*REGISTRY_COLUMNS).withColumn("version", F.col("version").cast("bigint"))
            parts = content.get("parts", [])
            if len(parts) >= MOST_PARTS:
                rows, parts = registry.unionByName(rows), []
            part = uuid.uuid4().hex
            # a few rows per shard
            rows.coalesce(1).write.parquet(f"{self.root}/_registry/rows/part={part}")
            return {
                "parts": [*parts, part],
                "tables": _widened(content.get("tables", {}), declared or {}),
                "stats": [*self._fewer_stats(content.get("stats", []), registry), *stats],
            }

        return self.log.commit(next_content)

    def publish(self, rows: DataFrame) -> None:
        """Append registry rows that do not depend on the registry's state."""
        self.commit(lambda _: rows)

    def _table(self, table: str) -> dict:
        return self.log.head()[1]["tables"][table]

    def declared(self, table: str) -> T.StructType:
        """Columns of a table besides its partition columns."""
        return T.StructType.fromJson(self._table(table)["schema"])

    def id_column(self, table: str) -> str | None:
        return self._table(table).get("id")

    # rows

    def stored(self, table: str, copies: Iterable[str] | None = None, schema: T.StructType | None = None) -> DataFrame:
        """Rows of all copies, or of some, with the declared columns, whatever those of a file are."""
        base = f"{self.root}/{table}"
        paths = [base] if copies is None else [f"{base}/copy={c}" for c in copies]
        return self._read(table, paths, schema)

    def _read(self, table: str, paths: list[str], schema: T.StructType | None = None) -> DataFrame:
        parts = "copy string, island_no int, shard_no int"
        schema = T.StructType([*(schema or self.declared(table)), *T.StructType.fromDDL(parts)])
        paths = [p for p in paths if exists(self.spark, p)]  # a copy of a table without rows has none
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/{table}").parquet(*paths)

    def _named(self, table: str, rows: list[Row], schema: T.StructType | None = None) -> DataFrame:
        """Stored rows of the copies of some registry rows; only their directories are listed."""
        found = [(r.copies[table], r.island_no, r.shard_no) for r in rows if table in r.copies]
        base = f"{self.root}/{table}"
        if len(found) <= MOST_NAMED:
            return self._read(table, [f"{base}/copy={c}/island_no={i}/shard_no={s}" for c, i, s in found], schema)
        stored = self._read(table, [f"{base}/copy={c}" for c in sorted({c for c, *_ in found})], schema)
        live = self.spark.createDataFrame(found, "copy string, island_no int, shard_no int")
        return stored.join(broadcast_within(live), COPY_PARTITIONS, "left_semi")

    def table(self, table: str) -> DataFrame:
        """Rows of the active shards, with the changes that came after their copies were made."""
        return self.rows_of(table, self.registry_now(ACTIVE).collect())

    def rows_of(self, table: str, rows: list[Row], schema: T.StructType | None = None) -> DataFrame:
        """Rows of a table that belong to some current registry rows, of which there is one per shard."""
        logs = {r.shard_no: list((r.deltas or {}).get(table) or []) for r in rows}
        plain = self._named(table, [r for r in rows if not logs[r.shard_no]], schema).drop("copy")
        layered = [r for r in rows if logs[r.shard_no]]
        if not layered:
            return plain
        base = self._named(table, layered, schema).drop("copy")
        changes = self.changes(table, sorted({x for r in layered for x in logs[r.shard_no]}))
        wanted = [(r.shard_no, r.island_no, x) for r in layered for x in logs[r.shard_no]]
        wanted = self.spark.createDataFrame(wanted, "shard_no int, island_no int, log string")
        changes = changes.join(broadcast_within(wanted), ["shard_no", "log"])
        keys = [c for c in changes.columns if c not in ("shard_no", "island_no", "op", "lsn", "payload", "log", "batch")]
        latest = latest_changes(changes, ["island_no", *keys])
        # what is counted are changes, never the rows of the copy
        few = fits(changes.select("shard_no", "island_no", *keys))
        merged = with_changes(base, _as_declared(latest, schema or self.declared(table), keys), ["island_no", *keys], few)
        return plain.unionByName(merged.select(*plain.columns))

    def changes(self, table: str, logs: list[str]) -> DataFrame:
        """Logged changes, sorted within files by shard and key; `log` and `batch` tell where from."""
        base = f"{self.root}/_changes/{table}"
        return self.spark.read.option("mergeSchema", True).option("basePath", base).parquet(*[f"{base}/log={x}" for x in logs])

    # statistics

    def measured(self, table: str, copies: list[str], schema: T.StructType | None = None) -> DataFrame:
        """Statistics of stored copies: values are read once, sizes come from the listing of these copies."""
        schema = schema or self.declared(table)
        rows = self.stored(table, copies, schema)
        largest = self._largest(F.col(f"`{c}`") if (c := self.id_column(table)) else None)
        found = rows.groupBy(*COPY_PARTITIONS).agg(F.count(F.lit(1)).alias("rows"), row_bytes(schema).alias("value_bytes"), largest)
        sized = self.listed(table, copies=copies).drop("table")
        return found.join(sized, COPY_PARTITIONS, "left").withColumns({"table": F.lit(table), "changes": F.lit(False)})

    @staticmethod
    def _largest(column: Column | None) -> Column:
        return F.max(F.lit(None) if column is None else column).cast("bigint").alias("max_id")

    def inherited(self, table: str, copy: str, moves: DataFrame) -> DataFrame:
        """Statistics of a copy that was made without changes, from those of the copies it was made of."""
        places = moves.select("shard_no", F.col("from_island").alias("island_no"), "to_island")
        own = self.statistics().filter((F.col("table") == table) & (F.col("delta_changes") == 0))
        own = own.join(broadcast_within(places), ["shard_no", "island_no"]).withColumn("island_no", F.col("to_island"))
        sized = self.listed(table, copies=[copy]).select("island_no", "shard_no", F.col("bytes").alias("written"))
        found = own.join(broadcast_within(settle(sized)), ["island_no", "shard_no"], "left").withColumn("bytes", F.col("written"))
        return found.withColumns({"copy": F.lit(copy), "changes": F.lit(False)})

    def measured_changes(self, table: str, log: str, island: DataFrame, after: int) -> DataFrame:
        """Statistics of a log of changes behind a batch; (shard_no, island_no) tells the shards' islands."""
        changes = self.changes(table, [log]).filter(F.col("batch") > after)
        name = self.id_column(table)
        ids = None
        if name is not None:
            ids = F.col(f"payload.`{name}`") if name not in changes.columns else F.col(f"`{name}`")
        width = F.sum(F.octet_length(F.to_json(F.struct("payload"))))
        found = changes.groupBy("shard_no").agg(F.count(F.lit(1)).alias("rows"), width.alias("value_bytes"), self._largest(ids))
        placed = found.join(broadcast_within(island), "shard_no")
        return placed.withColumns(
            {"table": F.lit(table), "copy": F.lit(log), "bytes": F.lit(None).cast("bigint"), "changes": F.lit(True)}
        )

    def add_stats(self, rows: DataFrame) -> str:
        """Write statistics; the name of their part, by which a commit makes them count."""
        columns = [F.col(f.name).cast(f.dataType) for f in T.StructType.fromDDL(STATS_SCHEMA)]
        part = uuid.uuid4().hex
        rows.select(*columns).coalesce(1).write.parquet(f"{self.root}/_registry/stats/part={part}")
        return part

    def stats_of(self, parts: list[str]) -> DataFrame:
        """Statistics of copies and logs, published or not."""
        paths = [f"{self.root}/_registry/stats/part={p}" for p in parts]
        return self.spark.read.schema(STATS_SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], STATS_SCHEMA)

    def _fewer_stats(self, parts: list[str], registry: DataFrame) -> list[str]:
        """Many parts as one, without the statistics of what no registry row names any more."""
        if len(parts) < MOST_PARTS:
            return parts
        current = current_registry(registry)
        named = current.select(F.explode("copies").alias("table", "copy")).unionByName(
            current.select(F.explode("deltas").alias("table", "logs")).select("table", F.explode("logs").alias("copy"))
        )
        return [self.add_stats(self.stats_of(parts).join(named.distinct(), ["table", "copy"], "left_semi"))]

    def statistics(self) -> DataFrame:
        """(island_no, shard_no, table, rows, value_bytes, bytes, max_id, delta_changes) of active shards.

        From the statistics that were written with publications. Rows and bytes are those of the copy; as
        long as changes are merged on read, `delta_changes` tells how many, and `max_id` counts them in.
        """
        stats = self.stats_of(self.log.head()[1].get("stats", []))
        live = settle(self.registry_now(ACTIVE).select("island_no", "shard_no", "copies", "deltas"))
        of_copies = live.select("island_no", "shard_no", F.explode("copies").alias("table", "copy"))
        of_logs = live.select("island_no", "shard_no", F.explode("deltas").alias("table", "copies"))
        of_logs = of_logs.select("island_no", "shard_no", "table", F.explode("copies").alias("copy"))
        on = ["table", "copy", "island_no", "shard_no"]
        keys = ["island_no", "shard_no", "table"]
        base = stats.filter(~F.col("changes")).join(broadcast_within(of_copies), on, "left_semi")
        logs = stats.filter("changes").join(broadcast_within(of_logs), on, "left_semi")
        later = logs.groupBy(*keys).agg(F.sum("rows").alias("delta_changes"), F.max("max_id").alias("later_id"))
        return base.join(later, keys, "left").select(
            *keys, "rows", "value_bytes", "bytes", F.greatest("max_id", "later_id").alias("max_id"),
            F.coalesce("delta_changes", F.lit(0)).alias("delta_changes"),
        )

    def listed(self, *tables: str, copies: list[str] | None = None) -> DataFrame:
        """(table, copy, island_no, shard_no, bytes) of stored directories, from file listings; no file is opened.

        All directories of the tables, or those of some copies.
        """
        parts = []
        for table in tables or self.tables:
            base = f"{self.root}/{table}"
            paths = [base] if copies is None else [f"{base}/copy={c}" for c in copies]
            paths = [p for p in paths if exists(self.spark, p)]
            files = None
            if paths:
                reader = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("basePath", base)
                files = reader.load(paths)
            if files is None or "copy" not in files.columns:  # a table without rows
                files = self.spark.createDataFrame([], "length bigint, copy string, island_no int, shard_no int")
            sizes = files.groupBy(*COPY_PARTITIONS).agg(F.sum("length").alias("bytes"))
            parts.append(sizes.select(F.lit(table).alias("table"), *COPY_PARTITIONS, "bytes"))
        return reduce(DataFrame.unionByName, parts)

    def sizes(self) -> DataFrame:
        """(island_no, shard_no, table, bytes) of active shards: of the copies that the registry names, from file listings."""
        rows = self.registry_now(ACTIVE)
        live = rows.select("island_no", "shard_no", F.explode("copies").alias("table", "copy"))
        found = self.listed().join(broadcast_within(settle(live)), ["table", *COPY_PARTITIONS], "left_semi")
        return found.select("island_no", "shard_no", "table", "bytes")

    # states of shards

    def activate(self, island_no: int, lo: int, hi: int | None = None) -> DataFrame:
        """Activate a range of shards that the island has; returns the whole range."""
        return self._change_status(island_no, ACTIVE, lambda current: activate_shards(current, current, lo, hi)[0])

    def deactivate(self, island_no: int, lo: int, hi: int | None = None) -> DataFrame:
        """Deactivate a range of shards on an island; returns those that were active."""
        return self._change_status(island_no, INACTIVE, lambda current: deactivate_shards(current, lo, hi)[0])

    def _change_status(self, island_no: int, status: str, choose: Callable[[DataFrame], DataFrame]) -> DataFrame:
        chosen = []

        def change(registry: DataFrame) -> DataFrame:
            current = settle(current_registry(registry).filter(F.col("island_no") == island_no))
            chosen[:] = [choose(current.select("shard", "status"))]
            rows = current.join(chosen[0].select("shard"), "shard", "left_semi").withColumn("status", F.lit(status))
            return rows.withColumn("version", F.lit(next_version(registry)))

        self.commit(change)
        return chosen[0]

    def retired(self) -> DataFrame:
        """Current registry rows of what moves left behind."""
        return _retired(self.registry())

    # changes beside copies

    def compact(self, table: str, least_changes: int = 1, copy: str | None = None) -> list[int]:
        """Write copies of active shards anew that have at least so many changes merged on read; returns their numbers.

        A shard that another writer changed meanwhile fails the call, and nothing is published.
        """
        counted = self.statistics().filter((F.col("table") == table) & (F.col("delta_changes") >= least_changes))
        chosen = {(r.island_no, r.shard_no) for r in counted.select("island_no", "shard_no").collect()}
        rows = [r for r in self.registry_now(ACTIVE).collect() if (r.island_no, r.shard_no) in chosen]
        if not rows:
            return []
        copy = copy or f"c-{uuid.uuid4().hex}"
        self.mark(copy)
        try:
            merged = self.rows_of(table, rows).withColumn("copy", F.lit(copy))
            write_layout(merged, f"{self.root}/{table}", COPY_PARTITIONS)
            stats = [self.add_stats(self.measured(table, [copy]))]
            self.commit(lambda registry: _compacted(registry, rows, table, copy), stats=stats)
        except BaseException:
            delete(self.spark, f"{self.root}/{table}/copy={copy}")
            raise
        finally:
            self.unmark(copy)
        return sorted(r.shard_no for r in rows)

    # what is being written, and what is left behind

    def mark(self, copy: str, state: str = "{}") -> None:
        """Note that a copy is being written; cleanups leave it alone."""
        write_text(self.spark, f"{self.root}/_registry/running/{copy}", state)

    def unmark(self, copy: str) -> None:
        delete(self.spark, f"{self.root}/_registry/running/{copy}")

    def running(self) -> dict[str, dict]:
        """Copies that are being written, or were when their writer died (then abort_move ends them), and what is known of them."""
        folder = f"{self.root}/_registry/running"
        found = [n for n in names(self.spark, folder) if not n.startswith(".")]
        return {n: json.loads(read_text(self.spark, f"{folder}/{n}")) for n in found}

    def cleanup(self) -> list[str]:
        """Remove what moves left behind; returns its labels.

        The registry rows go first, so nothing refers to the directories that are
        then deleted: all that no current row names, also those of moves that
        were interrupted or of dry runs that others replaced. What is marked as being written stays.
        """
        gone_names = []

        def change(registry: DataFrame) -> DataFrame:
            gone = settle(_retired(registry))
            gone_names[:] = sorted(r.shard for r in gone.select("shard").collect())
            return gone.withColumn("status", F.lit(ABSENT)).withColumn("version", F.lit(next_version(registry)))

        if self.retired().first() is not None:
            self.commit(change)
        running = list(self.running())
        self.delete_unnamed(self.listed(), running)
        current = current_registry(self.registry()).select(F.explode("deltas").alias("table", "logs"))
        kept = {(r.table, x) for r in current.collect() for x in r.logs} | {(t, c) for t in self.tables for c in running}
        for table in self.tables:
            for folder, prefix in (("_changes", "log="), ("_streams", "")):
                for name in names(self.spark, f"{self.root}/{folder}/{table}"):
                    if (table, name.removeprefix(prefix)) not in kept:
                        self._delete(f"{folder}/{table}/{name}")
        return gone_names

    def delete_unnamed(self, listed: DataFrame, running: Iterable[str] = ()) -> None:
        """Delete directories that no current registry row names; a copy of which none is named, as a whole.

        Comes to the driver with a row per directory or copy: some per shard.
        """
        rows = current_registry(self.registry())
        named = rows.select("island_no", "shard_no", F.explode("copies").alias("table", "copy")).distinct()
        whole = listed.filter(~F.col("copy").isin(list(running)))
        whole = whole.join(named.withColumn("kept", F.lit(True)), ["table", *COPY_PARTITIONS], "left")
        gone = F.collect_list(F.when(F.col("kept").isNull(), F.struct("island_no", "shard_no")))
        for r in whole.groupBy("table", "copy").agg(F.count("kept").alias("kept"), gone.alias("gone")).collect():
            path = f"{r.table}/copy={r.copy}"
            for path in [f"{path}/island_no={x.island_no}/shard_no={x.shard_no}" for x in r.gone] if r.kept else [path]:
                self._delete(path)

    def drop_copy(self, copy: str) -> None:
        """Remove an unpublished copy's directories, and the log and stream state of its changes."""
        used = F.array_contains(F.map_values("copies"), copy)
        if self.registry().filter(used).select("version").first() is not None:
            raise ValueError(f"copy is published: {copy}")
        for table in self.tables:
            self._delete(f"{table}/copy={copy}")
            self.drop_log(table, copy)

    def drop_log(self, table: str, copy: str, through: int | None = None) -> None:
        """Remove a log of changes and its stream's state, or only the batches up to one."""
        if through is None:
            self._delete(f"_changes/{table}/log={copy}")
        else:
            for name in names(self.spark, f"{self.root}/_changes/{table}/log={copy}"):
                if name.startswith("batch=") and int(name.removeprefix("batch=")) <= through:
                    self._delete(f"_changes/{table}/log={copy}/{name}")
        self._delete(f"_streams/{table}/{copy}")

    def _delete(self, path: str) -> None:
        delete(self.spark, f"{self.root}/{path}")


def _retired(registry: DataFrame) -> DataFrame:
    current = current_registry(registry)
    return current.join(retired_shards(current), "shard", "left_semi").filter(F.col("status") != ACTIVE)


def _widened(tables: dict, declared: dict) -> dict:
    """Declared tables, with more columns for some; a type that another writer declared otherwise is a conflict."""
    out = dict(tables)
    for name, new in declared.items():
        before = out.get(name, {"schema": {"type": "struct", "fields": []}, "id": new.get("id")})
        known = {f["name"]: f for f in before["schema"]["fields"]}
        for field in new["schema"]["fields"]:
            if known.setdefault(field["name"], field)["type"] != field["type"]:
                raise MoveConflict(f"column {field['name']} of {name} has another type now")
        out[name] = {"schema": {"type": "struct", "fields": list(known.values())}, "id": before.get("id") or new.get("id")}
    return out


def _as_declared(latest: DataFrame, schema: T.StructType, keys: list[str]) -> DataFrame:
    """Changes with all declared columns in their payload, null where a log lacks some."""
    have = set(latest.schema["payload"].dataType.names)
    fields = [
        (F.col(f"payload.`{f.name}`") if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema if f.name not in keys
    ]
    return latest.withColumn("payload", F.struct(*fields))


def unchanged(registry: DataFrame, rows: list[Row]) -> DataFrame:
    """Current registry; a conflict if one of these rows, all current once, is not any more."""
    current = current_registry(registry)
    now = {(r.island_no, r.shard): r.version for r in current.select("island_no", "shard", "version").collect()}
    for r in rows:
        if now.get((r.island_no, r.shard)) != r.version:
            raise MoveConflict(f"shard {r.shard_no} on island {r.island_no} was changed meanwhile")
    return current


def _compacted(registry: DataFrame, rows: list[Row], table: str, copy: str) -> DataFrame:
    """Registry rows by which the shards have a new copy of a table and no changes beside it."""
    current = unchanged(registry, rows)
    own = registry.sparkSession.createDataFrame([(r.island_no, r.shard) for r in rows], "island_no int, shard string")
    copies = F.map_concat(F.map_filter("copies", lambda k, _: k != table), F.create_map(F.lit(table), F.lit(copy)))
    left = F.map_filter("deltas", lambda k, _: k != table)
    changed = current.join(broadcast_within(own), ["island_no", "shard"], "left_semi").withColumns({"copies": copies, "deltas": left})
    return changed.withColumn("version", F.lit(next_version(registry)))
