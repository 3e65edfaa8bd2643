import io
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from shardkit.functions.names import source_label, strip_prefix
from shardkit.operators import federate
from shardkit.session import scratch_path
from shardkit.sources import layout, mounts


def plan_of(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_mount_and_union(spark):
    """Two active shards, of which only one has the table's rows."""
    source = spark.createDataFrame([("sh0001", 7), ("sh0001", 7)], "shard string, id bigint")
    active = spark.createDataFrame([("localhost", "sh0000"), ("localhost", "sh0001")], "host string, shard string")
    mounted, summary = mounts.mount_shards("fdw", {"localhost": source}, active)
    assert [(r.server, r.shard_count) for r in summary.collect()] == [("fdw_localhost", 2)]
    assert mounted.labels() == ["fdw_sh0000", "fdw_sh0001"]
    assert mounted.shard("fdw_sh0001").columns == ["id"] and mounted.shard("fdw_sh0000").count() == 0
    whole = federate.union_shards(mounted.all_shards(), "fdw")
    assert whole.columns == ["shard", "id"]
    assert [(r.shard, r.id) for r in whole.collect()] == [("sh0001", 7)] * 2
    assert mounts.mounted_shards(mounted.manifest, "fdw").first().labels == mounted.labels()
    assert mounts.mounted_shards(mounted.manifest, "fd").first().labels == []


def test_mounting_a_shard_twice_fails(spark):
    one = spark.createDataFrame([("sh0001", 1)], "shard string, id bigint")
    with pytest.raises(ValueError, match="fdw_sh0001"):
        mounts.mount_shards("fdw", {"a": one, "b": one})


def test_source_without_active_shards_is_reported(spark):
    one = spark.createDataFrame([("sh0001", 1)], "shard string, id bigint")
    active = spark.createDataFrame([("a", "sh0001")], "host string, shard string")
    _, summary = mounts.mount_shards("fdw", {"a": one, "b": one}, active)
    assert {r.server: r.shard_count for r in summary.collect()} == {"fdw_a": 1, "fdw_b": 0}


def test_labels(spark):
    rows = spark.createDataFrame([("pg-1.example.com:5432",)], "h string").select(source_label(F.col("h"), "x"))
    assert rows.first()[0] == "x_pg_1_example_com_5432"
    texts = ["fdw_sh0001", "sh0001", "fdwx_sh0001"]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select(strip_prefix(F.col("t"), "fdw"))
    assert [r[0] for r in found.collect()] == ["sh0001", "sh0001", "_sh0001"]


def test_columns_in_order_and_missing_ones_null(spark):
    a = spark.createDataFrame([(1, "x", 2)], "z bigint, b string, id bigint")
    b = spark.createDataFrame([(3, True)], "id bigint, c boolean")
    whole = federate.union_shards({"s1": a, "s2": b})
    assert whole.columns == ["shard", "id", "b", "c", "z"]
    assert sorted(tuple(r) for r in whole.collect()) == [("s1", 2, "x", None, 1), ("s2", 3, None, True, None)]


def test_columns_of_clashing_types_become_text(spark):
    a = spark.createDataFrame([(1, 5)], "id bigint, v bigint")
    b = spark.createDataFrame([(2, "x")], "id bigint, v string")
    rows = sorted(tuple(r) for r in federate.union_shards({"s1": a, "s2": b}).collect())
    assert rows == [("s1", 1, "5"), ("s2", 2, "x")]


def test_filter_on_shard_leaves_one_scan(spark):
    path = scratch_path(spark, "pruning")
    rows = spark.range(100).select("id", (F.col("id") % 5).cast("int").alias("shard_no"), F.lit("v").alias("v"))
    places = spark.range(5).select(F.col("id").cast("int").alias("shard_no"), F.lit(0).alias("island_no"))
    layout.write_placed(rows, places, path)
    stored = layout.read_placed(spark, path)
    parts = {f"sh{n:04d}": stored.filter(F.col("shard_no") == n).drop("shard_no", "island_no") for n in range(5)}
    one = federate.union_shards(parts).filter("shard = 'sh0003' AND id > 50").select("id")
    plan = plan_of(one)
    assert plan.count("Scan parquet") == 2  # once in the tree, once in its details
    assert "GreaterThan(id,50)" in plan and "ReadSchema: struct<id:bigint>" in plan
    assert sorted(r.id for r in one.collect()) == [n for n in range(51, 100) if n % 5 == 3]


def test_stored_union_selects_directories_by_label(spark):
    path = scratch_path(spark, "labels")
    rows = spark.range(100).select(F.lit("v").alias("a"), "id", (F.col("id") % 5).cast("int").alias("shard_no"))
    places = spark.range(5).select(F.col("id").cast("int").alias("shard_no"), F.lit(0).alias("island_no"))
    layout.write_placed(rows, places, path)
    whole = federate.union_stored(layout.read_placed(spark, path))
    assert whole.columns == ["shard", "id", "a"]
    one = whole.filter("shard = 'sh0003'")
    assert one.count() == 20 and len(one.inputFiles()) >= 1
    assert "lpad(cast(shard_no" in plan_of(one).split("PartitionFilters:")[1].split("\n")[0]
    found = layout.stored_shards(spark, path).collect()
    assert sorted((r.island_no, r.shard_no) for r in found) == [(0, n) for n in range(5)]


def test_inventory_leaves_out_odd_names(spark):
    rows = [("s2", "t", "b", "int"), ("s1", "t", "a", "int"), ("s1", "bad name", "a", "int"), ("s1", "T_2", "a", "int")]
    columns = spark.createDataFrame(rows, "shard string, table string, column string, type string")
    found = {r.table: (r.shards, r.columns) for r in federate.table_inventory(columns).collect()}
    assert found == {"t": (["s1", "s2"], ["a", "b"]), "T_2": (["s1"], ["a"])}


def test_only_changed_unions_are_rebuilt(spark):
    a = spark.createDataFrame([("s1", 1)], "shard string, id bigint")
    b = spark.createDataFrame([("s2", 2, "x")], "shard string, id bigint, v string")
    manifest = spark.createDataFrame([], "table string, fingerprint string")
    names, manifest = federate.refresh_if_changed(spark, {"t1": [a], "t2": [a, b]}, manifest)
    assert names == ["t1", "t2"]
    assert spark.table("t2").columns == ["shard", "id", "v"]
    names, manifest = federate.refresh_if_changed(spark, {"t1": [a], "t2": [b, a]}, manifest)
    assert names == []
    names, manifest = federate.refresh_if_changed(spark, {"t1": [a, b], "t2": [a, b]}, manifest)
    assert names == ["t1"]
    assert manifest.count() == 2 and spark.table("t1").count() == 2


def _sharded(spark):
    rows = [(0, 1), (1, 2), (1, 3), (2, 9), (3, 4)]
    active = spark.createDataFrame([(0, "sh0000"), (1, "sh0001"), (2, "sh0002"), (5, "sh0005")], "shard_no int, shard string")
    return spark.createDataFrame(rows, "shard_no int, v int"), active


def test_query_on_each_shard(spark):
    df, active = _sharded(spark)
    got = federate.for_each_shard(df, lambda d: d.filter("v < 9"), active)
    assert {r.shard: r.row_count for r in got.collect()} == {"sh0001": "2", "sh0002": "", "sh0005": ""}


def test_function_on_each_shard(spark):
    df, active = _sharded(spark)
    got = federate.map_each_shard(df, lambda p: p.assign(v=p["v"] * 10), "shard_no int, v int", active)
    assert sorted((r.shard_no, r.v) for r in got.collect()) == [(1, 20), (1, 30), (2, 90)]


def test_failure_names_its_shard(spark):
    df, active = _sharded(spark)

    def fail(part):
        if (part["v"] == 9).any():
            raise ValueError("bad row")
        return part

    with pytest.raises(Exception, match="error on shard 2: bad row"):
        federate.map_each_shard(df, fail, "shard_no int, v int", active).collect()


def test_labelled_leaves_inactive_shards_out(spark):
    from shardkit.sources.mounts import mount_shards

    rows = spark.createDataFrame([("sh0001", 1), ("sh0002", 2)], "shard string, v int")
    active = spark.createDataFrame([("a", "sh0001"), ("b", "sh0002")], "host string, shard string")
    mounts, _ = mount_shards("fdw", {"a": rows, "b": rows}, active)
    got = sorted((r.shard, r.v) for df in mounts.labelled() for r in df.collect())
    assert got == [("fdw_sh0001", 1), ("fdw_sh0002", 2)]
    with pytest.raises(ValueError, match="share a label"):
        mount_shards("fdw", {"a.b": rows, "a-b": rows}, active)


def test_numbers_beyond_a_label_have_no_place(spark):
    rows = spark.createDataFrame([(1, 1)], "shard_no int, v int")
    for number in (12345, -1, None):
        places = spark.createDataFrame([(1, 0), (number, 0)], "shard_no int, island_no int")
        with pytest.raises(ValueError, match="no such shard number"):
            layout.place_rows(rows, places)


def test_a_used_root_is_refused(spark):
    from shardkit.operators.relocate import ShardStore

    rows = spark.createDataFrame([(1, 1)], "shard_no int, v int")
    places = spark.createDataFrame([(1, 0)], "shard_no int, island_no int")
    root = scratch_path(spark, "store")
    ShardStore.create(spark, root, {"t": rows}, places)
    with pytest.raises(ValueError, match="a store already"):
        ShardStore.create(spark, root, {"t": rows}, places)
