from datetime import datetime, timezone
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from shardkit.operators import progress, relocate
from shardkit.session import scratch_path
from shardkit.sources.changes import change_feed
from shardkit.sources.layout import read_placed, write_placed
from shardkit.streaming import apply

MOVES = "shard_no int, from_island int, to_island int"
CHANGE = "lsn bigint, op string, shard_no int, key bigint, payload struct<v: string>"
AT = datetime(2023, 1, 9, 7, 9, 54, tzinfo=timezone.utc)


def write_changes(spark, path, rows):
    spark.createDataFrame(rows, CHANGE).coalesce(1).write.mode("append").parquet(path)


def merged(spark, base, log, keys=("key",)):
    df = spark.createDataFrame(base, "shard_no int, key bigint, v string")
    return sorted(tuple(r) for r in apply.merge_changes(df, log, list(keys)).select("shard_no", "key", "v").collect())


def test_order_replays_and_fence(spark):
    """Files out of order, one of them twice, a delete before an insert, and a change behind the fence."""
    path, log, check = (scratch_path(spark, n) for n in ("feed", "log", "stream"))
    late = [(5, "U", 1, 10, ("five",)), (6, "D", 1, 11, None), (9, "U", 1, 10, ("behind",))]
    early = [(1, "I", 1, 12, ("one",)), (2, "D", 1, 12, None), (3, "I", 1, 12, ("three",)), (4, "U", 1, 11, ("four",))]
    for rows in (late, early, late):
        write_changes(spark, path, rows)
    feed = change_feed(spark, path, CHANGE, max_files=1)
    logged = apply.drain_to_fence(feed, spark.read.schema(CHANGE).parquet(path), 8, log, check, ["key"])
    base = [(1, 10, "old"), (1, 11, "old"), (1, 13, "kept")]
    assert merged(spark, base, logged) == [(1, 10, "five"), (1, 12, "three"), (1, 13, "kept")]

    # the next owner goes on behind the fence with a checkpoint of its own
    write_changes(spark, path, [(10, "D", 1, 13, None)])
    log2, check2 = scratch_path(spark, "log"), scratch_path(spark, "stream")
    apply.apply_changes(feed, log2, check2, ["key"], after_lsn=8).awaitTermination()
    rest = merged(spark, [(1, 10, "five"), (1, 12, "three"), (1, 13, "kept")], apply.read_log(spark, log2))
    assert rest == [(1, 10, "behind"), (1, 12, "three")]


def test_stream_goes_on_where_it_stopped(spark):
    path, log, check = (scratch_path(spark, n) for n in ("feed", "log", "stream"))
    write_changes(spark, path, [(1, "I", 1, 1, ("a",))])
    feed = change_feed(spark, path, CHANGE)
    for lsn in (2, 3):
        apply.apply_changes(feed, log, check, ["key"]).awaitTermination()
        write_changes(spark, path, [(lsn, "U", 1, 1, (f"v{lsn}",))])
    apply.apply_changes(feed, log, check, ["key"]).awaitTermination()
    logged = apply.read_log(spark, log)
    assert sorted(r.lsn for r in logged.collect()) == [1, 2, 3]
    assert merged(spark, [], logged) == [(1, 1, "v3")]


def test_snapshot_position_and_other_shards(spark):
    path, log, check = (scratch_path(spark, n) for n in ("feed", "log", "stream"))
    write_changes(spark, path, [(1, "U", 1, 1, ("before",)), (2, "U", 2, 2, ("other",)), (3, "I", 1, 3, ("new",))])
    shards = spark.createDataFrame([(1,)], "shard_no int")
    written = spark.read.schema(CHANGE).parquet(path)
    logged = apply.drain_to_fence(change_feed(spark, path, CHANGE), written, 3, log, check, ["key"], shards, after_lsn=1)
    assert merged(spark, [(1, 1, "snapshot")], logged) == [(1, 1, "snapshot"), (1, 3, "new")]


def test_no_changes_at_all(spark):
    path, log, check = (scratch_path(spark, n) for n in ("feed", "log", "stream"))
    write_changes(spark, path, [(5, "U", 1, 1, ("late",))])
    written = spark.read.schema(CHANGE).parquet(path)
    logged = apply.drain_to_fence(change_feed(spark, path, CHANGE), written, 3, log, check, ["key"])
    assert merged(spark, [(1, 1, "a")], logged) == [(1, 1, "a")]


def test_missing_changes_are_noticed(spark):
    path, log, check = (scratch_path(spark, n) for n in ("feed", "log", "stream"))
    write_changes(spark, path, [(1, "U", 1, 1, ("a",))])
    written = spark.createDataFrame([(1, "U", 1, 1, ("a",)), (2, "U", 1, 1, ("b",))], CHANGE)
    with pytest.raises(RuntimeError, match="shard 1 is 1 positions"):
        apply.drain_to_fence(change_feed(spark, path, CHANGE), written, 3, log, check, ["key"])


def store_of(spark, shards=4, rows=400):
    data = spark.range(rows).select(
        (F.col("id") % shards).cast("int").alias("shard_no"), F.col("id").alias("key"), F.lit("old").alias("v")
    )
    placement = spark.range(shards).select(
        F.col("id").cast("int").alias("shard_no"), F.floor(F.col("id") / 2).cast("int").alias("island_no")
    )
    notes = data.filter("key < 8").select("shard_no", "key", F.lit("note").alias("note"))
    return relocate.ShardStore.create(spark, scratch_path(spark, "store"), {"data": data, "notes": notes}, placement)


def content(store, table="data"):
    return sorted(tuple(r) for r in store.table(table).select("island_no", "shard_no", "key").collect())


def states(store):
    return {(r.island_no, r.shard): r.status for r in relocate.current_registry(store.registry()).collect()}


def copies(store, table="data"):
    return {r.copy for r in store.stored(table).select("copy").distinct().collect()}


def files(store):
    """(table, copy, island, shard) of all stored directories, and whether logs or stream state remain."""
    found = set()
    for path in Path(store.root.removeprefix("file:")).rglob("*.parquet"):
        parts = path.relative_to(store.root.removeprefix("file:")).parts
        if parts[0] in store.tables:
            found.add((parts[0], *[p.split("=")[1] for p in parts[1:4]]))
        elif parts[0] not in ("_registry", "_schemas"):
            found.add(parts[:2])
    return found


def leftovers(store):
    """What is stored beyond what current registry rows name."""
    named = {
        (table, copy, str(r.island_no), str(r.shard_no))
        for r in relocate.current_registry(store.registry()).collect() for table, copy in r.copies.items()
    }
    return files(store) - named


def test_move_all_tables_of_shards(spark):
    store = store_of(spark)
    before = content(store)
    moves = spark.createDataFrame([(0, 0, 1), (3, 1, 2)], MOVES)
    ids = relocate.move_shards(store, moves, at=AT, id_columns={"data": "key"})
    target = {0: 1, 3: 2}
    assert content(store) == sorted((target.get(s, i), s, k) for i, s, k in before)
    assert {(i, s) for i, s, _ in content(store, "notes")} == {(1, 0), (0, 1), (1, 2), (2, 3)}
    state = states(store)
    assert state[(1, "sh0000")] == state[(2, "sh0003")] == "active"
    assert state[(0, "sh0000old20230109070954")] == "inactive"
    assert (0, "sh0000") not in state
    assert [(r.name, r.next_id) for r in ids.collect()] == [("data", 1400)]


def test_move_twice_and_back(spark):
    store = store_of(spark)
    before = content(store)
    relocate.move_shards(store, spark.createDataFrame([(0, 0, 1)], MOVES))
    relocate.move_shards(store, spark.createDataFrame([(0, 1, 0)], MOVES))
    assert content(store) == before
    assert states(store)[(0, "sh0000")] == "active"


def test_dry_run_leaves_the_source_live(spark):
    store = store_of(spark)
    before = content(store)
    moves = spark.createDataFrame([(0, 0, 1)], MOVES)
    for _ in range(2):
        relocate.move_shards(store, moves, activate=False)
    assert content(store) == before
    state = states(store)
    assert state[(1, "sh0000new")] == "inactive" and state[(0, "sh0000")] == "active"


def test_failed_move_leaves_nothing(spark):
    store = store_of(spark)
    before, labels, kept = content(store), states(store), copies(store)

    def fail(copy):
        assert copy in copies(store)
        raise KeyError("stop")

    with pytest.raises(KeyError):
        relocate.move_shards(store, spark.createDataFrame([(1, 0, 1)], MOVES), before_commit=fail)
    assert (content(store), states(store), copies(store)) == (before, labels, kept)


def test_wrong_moves_fail_before_anything_is_copied(spark):
    store = store_of(spark)
    kept = copies(store)
    for rows, message in (
        ([(0, 1, 0)], "shard 0 is not active on island 1"),
        ([(9, 0, 1)], "shard 9 is not active"),
        ([(0, 0, 1), (0, 0, 2)], "more than once"),
    ):
        with pytest.raises(ValueError, match=message):
            relocate.move_shards(store, spark.createDataFrame(rows, MOVES))
    assert copies(store) == kept


def test_batches_of_moves(spark):
    store = store_of(spark)
    rows = [(1, 3, 1, 2), (2, 0, 0, 1), (3, 2, 1, 0), (4, 1, 0, 2)]
    relocate.move_in_batches(store, spark.createDataFrame(rows, f"move_no int, {MOVES}"), batches=3)
    assert {(i, s) for i, s, _ in content(store)} == {(2, 3), (1, 0), (0, 2), (2, 1)}
    # shards of one batch share their copy: one shard, one shard, two shards
    sizes = [r.n for r in store.stored("data").filter("copy <> 'c-first'").groupBy("copy")
             .agg(F.count_distinct("shard_no").alias("n")).collect()]
    assert sorted(sizes) == [1, 1, 2]


def test_published_copies_cannot_be_dropped(spark):
    store = store_of(spark)
    with pytest.raises(ValueError, match="published"):
        store.drop_copy("c-first")


def test_move_with_changes(spark):
    store = store_of(spark)
    path = scratch_path(spark, "feed")
    rows = [(1, "U", 0, 0, ("new",)), (2, "D", 0, 4, None), (3, "I", 0, 1000, ("born",)), (4, "U", 0, 0, ("late",)),
            (2, "U", 1, 1, ("elsewhere",))]
    write_changes(spark, path, rows)
    source = relocate.ChangeSource(change_feed(spark, path, CHANGE), spark.read.schema(CHANGE).parquet(path), ["key"], snapshot_lsn=-1)
    moves = spark.createDataFrame([(0, 0, 1), (2, 1, 0)], MOVES)
    relocate.move_shards(store, moves, {"data": source}, 3)
    values = {r.key: (r.island_no, r.v) for r in store.table("data").filter("shard_no = 0").collect()}
    assert len(values) == 100 and 4 not in values
    assert values[0] == (1, "new") and values[1000] == (1, "born") and values[8] == (1, "old")
    assert store.table("data").filter("shard_no = 2").select("island_no").distinct().collect() == [(0,)]
    assert store.table("data").filter("shard_no = 1 AND v <> 'old'").count() == 0
    # changes that are there at the start go into the copy itself: one new copy, and nothing else is left
    assert len(copies(store)) == 2
    assert leftovers(store) == set()


def test_row_without_place_fails(spark):
    rows = spark.createDataFrame([(1, 1), (9, 1)], "shard_no int, v int")
    places = spark.createDataFrame([(1, 0)], "shard_no int, island_no int")
    with pytest.raises(Exception, match="no island for shard 9"):
        write_placed(rows, places, scratch_path(spark, "bad"))


def test_writing_again_replaces_only_touched_shards(spark):
    path = scratch_path(spark, "placed")
    places = spark.createDataFrame([(1, 0), (2, 0)], "shard_no int, island_no int")
    write_placed(spark.createDataFrame([(1, 1), (2, 1)], "shard_no int, v int"), places, path)
    write_placed(spark.createDataFrame([(2, 7)], "shard_no int, v int"), places, path)
    assert sorted((r.shard_no, r.v) for r in read_placed(spark, path).collect()) == [(1, 1), (2, 7)]


def test_progress(spark):
    src = spark.createDataFrame([("a", 200), ("b", 0), ("c", 5), ("d", 3)], "table string, rows bigint")
    dst = spark.createDataFrame([("a", 1), ("c", 9)], "table string, rows bigint")
    states = spark.createDataFrame([("a", "d"), ("b", "i"), ("c", "?"), ("d", "r")], "table string, state string")
    got = {r.table: tuple(r)[1:] for r in progress.backfill_progress(src, dst, states).collect()}
    assert got == {
        "a": ("data is being copied", 1, 1, 200), "b": ("initializing", 100, 0, 0), "c": ("?", 100, 5, 5),
    }


def test_gaps(spark):
    done = spark.createDataFrame([(1, 5), (2, 12)], "shard_no int, lsn bigint")
    assert {r.shard_no: r.gap for r in progress.replication_gap(done, 10).collect()} == {1: 5, 2: 0}
    target = spark.createDataFrame([(1, 5), (3, 4)], "shard_no int, target bigint")
    assert {r.shard_no: r.gap for r in progress.replication_gap(done, target).collect()} == {1: 0, 3: 4}


def test_cleanup_removes_what_moves_left(spark):
    store = store_of(spark)
    relocate.move_shards(store, spark.createDataFrame([(0, 0, 1)], MOVES), at=AT)
    relocate.move_shards(store, spark.createDataFrame([(3, 1, 0)], MOVES), activate=False)
    before = content(store)
    parts = lambda: {
        (r.island_no, r.shard_no) for r in store.stored("data").select("island_no", "shard_no").distinct().collect()
    }
    assert parts() == {(0, 0), (0, 1), (1, 2), (1, 3), (1, 0), (0, 3)}
    assert store.cleanup() == ["sh0000old20230109070954", "sh0003new"]
    assert parts() == {(0, 1), (1, 2), (1, 3), (1, 0)}
    assert content(store) == before
    assert set(states(store)) == {(0, "sh0001"), (1, "sh0002"), (1, "sh0003"), (1, "sh0000")}
    assert store.cleanup() == []


def test_inactive_shards_are_not_read(spark):
    store = store_of(spark)
    assert [r.shard for r in store.deactivate(0, 0, 5).collect()] == ["sh0000", "sh0001"]
    assert {s for _, s, _ in content(store)} == {2, 3}
    with pytest.raises(ValueError, match="sh0002"):
        store.activate(0, 1, 2)
    store.activate(0, 1)
    assert {s for _, s, _ in content(store)} == {1, 2, 3}
    assert states(store)[(0, "sh0000")] == "inactive"


def test_shard_with_two_places_fails(spark):
    rows = spark.createDataFrame([(1, 1)], "shard_no int, v int")
    places = spark.createDataFrame([(1, 0), (1, 2)], "shard_no int, island_no int")
    with pytest.raises(ValueError, match="more than one island"):
        write_placed(rows, places, scratch_path(spark, "bad"))


def test_changes_with_other_columns_are_refused(spark):
    """A payload without a column of the row would set it to null."""
    base = spark.createDataFrame([(1, 10, "old", 7)], "shard_no int, key bigint, v string, w int")
    changes = spark.createDataFrame([(5, "U", 1, 10, ("new",))], CHANGE)
    with pytest.raises(ValueError, match="differ in columns: w"):
        apply.merge_changes(base, changes, ["key"])


def test_shard_is_not_written_to_a_second_island(spark):
    """Its rows on the first island would stay and be read as well."""
    path = scratch_path(spark, "placed")
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "shard_no int, v string")
    at = lambda *places: spark.createDataFrame(places, "shard_no int, island_no int")
    write_placed(rows, at((1, 0), (2, 1)), path)
    write_placed(rows, at((1, 0), (2, 1)), path)
    with pytest.raises(ValueError, match="shard 2 is stored on island 1"):
        write_placed(rows, at((1, 0), (2, 0)), path)
    assert read_placed(spark, path).count() == 2


def test_late_fence(spark):
    """Changes go on while the copy is made; behind the fence only late changes are written, beside the copy."""
    store = store_of(spark)
    path = scratch_path(spark, "feed")
    write_changes(spark, path, [(1, "U", 0, 0, ("early",)), (2, "U", 1, 1, ("early",))])
    spark.createDataFrame([], CHANGE).coalesce(1).write.mode("append").parquet(path)
    written = spark.read.schema(CHANGE).parquet(path)
    source = relocate.ChangeSource(change_feed(spark, path, CHANGE), written, ["key"], snapshot_lsn=0)
    seen = {}

    def fence():
        seen["before"] = copies(store) - {"c-first"}
        write_changes(spark, path, [(3, "U", 0, 0, ("late",)), (4, "D", 0, 4, None), (5, "I", 0, 1000, ("born",))])
        source.written = spark.read.schema(CHANGE).parquet(path)
        return 5

    def look(copy):
        rows = store.stored("data").filter(F.col("copy").startswith(copy))
        seen["after"] = {(r.copy != copy, r.shard_no) for r in rows.select("copy", "shard_no").distinct().collect()}

    moves = spark.createDataFrame([(0, 0, 1), (1, 0, 2)], MOVES)
    relocate.move_shards(store, moves, {"data": source}, fence, before_commit=look)
    assert len(seen["before"]) == 1
    assert seen["after"] == {(False, 0), (False, 1)}
    values = {r.key: (r.island_no, r.v) for r in store.table("data").filter("shard_no < 2").collect()}
    assert values[0] == (1, "late") and values[1] == (2, "early") and values[1000] == (1, "born") and 4 not in values
    assert len(values) == 200 and leftovers(store) == {("_changes", "data")}


def test_columns_that_changes_bring_stay(spark):
    """A payload with a new column, then three more moves; files without it have nulls there."""
    store = store_of(spark)
    path = scratch_path(spark, "feed")
    wide = "lsn bigint, op string, shard_no int, key bigint, payload struct<v: string, w: int>"
    spark.createDataFrame([(1, "U", 0, 0, ("new", 7))], wide).write.parquet(path)
    source = relocate.ChangeSource(
        change_feed(spark, path, wide), spark.read.schema(wide).parquet(path), ["key"], snapshot_lsn=0
    )
    relocate.move_shards(store, spark.createDataFrame([(0, 0, 1)], MOVES), {"data": source}, 1)
    for i, j in ((1, 2), (2, 0), (0, 1)):
        relocate.move_shards(store, spark.createDataFrame([(0, i, j)], MOVES))
        rows = {r.key: (r.v, r.w) for r in store.table("data").collect()}
        assert rows[0] == ("new", 7) and rows[4] == ("old", None) and rows[1] == ("old", None) and len(rows) == 400
    narrow = relocate.ChangeSource(
        change_feed(spark, path, CHANGE), spark.read.schema(CHANGE).parquet(path), ["key"], snapshot_lsn=0
    )
    before = files(store)
    with pytest.raises(ValueError, match="differ in columns: w"):
        relocate.move_shards(store, spark.createDataFrame([(0, 1, 0)], MOVES), {"data": narrow}, 1)
    assert files(store) == before


def test_nothing_is_left_behind(spark):
    """After a move with changes, two dry runs, two moves within a second, an abort and a cleanup."""
    store = store_of(spark)
    path = scratch_path(spark, "feed")
    write_changes(spark, path, [(1, "U", 0, 0, ("new",))])
    source = relocate.ChangeSource(change_feed(spark, path, CHANGE), spark.read.schema(CHANGE).parquet(path), ["key"], snapshot_lsn=0)
    there, back = (spark.createDataFrame([m], MOVES) for m in ((0, 0, 1), (0, 1, 0)))
    relocate.move_shards(store, there, {"data": source}, 1, at=AT)
    relocate.move_shards(store, back, at=AT)
    relocate.move_shards(store, there, at=AT)
    assert {label for (i, label) in states(store) if i == 0 and "old" in label} == {
        "sh0000old20230109070954", "sh0000old20230109070955"
    }

    def fail(_):
        raise KeyError("stop")

    dry = spark.createDataFrame([(3, 1, 0)], MOVES)
    for _ in range(2):
        relocate.move_shards(store, dry, activate=False)
    with pytest.raises(KeyError):
        relocate.move_shards(store, back, {"data": source}, 1, before_commit=fail)
    before = content(store)
    # the first dry run's copy is named by no one, and cleanup finds it
    assert {table for table, *_ in leftovers(store)} == {"data", "notes"} and len({c for _, c, *_ in leftovers(store)}) == 1
    store.cleanup()
    assert leftovers(store) == set() and content(store) == before


def test_sizes_count_live_copies_only(spark):
    store = store_of(spark)
    root = Path(store.root.removeprefix("file:"))

    def on_disk():
        found = {}
        for r in store.registry_now("active").collect():
            for table, copy in r.copies.items():
                folder = root / table / f"copy={copy}" / f"island_no={r.island_no}" / f"shard_no={r.shard_no}"
                found[r.island_no, r.shard_no, table] = sum(f.stat().st_size for f in folder.glob("*.parquet"))
        return found

    def listed():
        return {(r.island_no, r.shard_no, r.table): r.bytes for r in store.sizes().collect()}

    assert listed() == on_disk() and len(listed()) == 8
    relocate.move_shards(store, spark.createDataFrame([(0, 0, 1)], MOVES))
    relocate.move_shards(store, spark.createDataFrame([(3, 1, 0)], MOVES), activate=False)
    assert listed() == on_disk() and (1, 0, "data") in listed() and (0, 0, "data") not in listed()
