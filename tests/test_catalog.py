"""Columns per shard, widening types, feeds by position, work on whole shards, numbers and texts of any size."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shardkit.functions.numbers import number_text
from shardkit.functions.text import redact_credentials
from shardkit.operators.catalog import ColumnCatalog, widest
from shardkit.operators.endpoints import EndpointDefaults, normalize_endpoints
from shardkit.operators.federate import fingerprints, run_each_shard, table_inventory
from shardkit.operators.report import grand_total, island_totals, other_totals, totals
from shardkit.session import scratch_path
from shardkit.sources.feed import PositionFeed, rows_by_shard
from tests.test_scale import plan_of

INT, LONG, DOUBLE, TEXT = T.IntegerType(), T.LongType(), T.DoubleType(), T.StringType()


@pytest.mark.parametrize("types, least", [
    ([INT], INT), ([INT, LONG], LONG), ([T.ByteType(), T.ShortType()], T.ShortType()), ([LONG, T.DecimalType(10, 2)], T.DecimalType(21, 2)),
    ([T.DecimalType(10, 4), T.DecimalType(12, 2)], T.DecimalType(14, 4)), ([LONG, T.DecimalType(38, 30)], TEXT), ([INT, DOUBLE], DOUBLE),
    ([T.FloatType(), DOUBLE], DOUBLE), ([LONG, DOUBLE], TEXT), ([T.DateType(), T.TimestampType()], TEXT), ([INT, TEXT], TEXT),
])
def test_least_types(types, least):
    assert widest(types) == widest(types[::-1]) == least


def test_drift_inside_a_source_is_noticed(spark):
    path, catalog = scratch_path(spark, "tables"), ColumnCatalog(spark, scratch_path(spark, "catalog"))
    rows = spark.range(40).select((F.col("id") % 4).cast("int").alias("shard_no"), "id", F.col("id").cast("int").alias("v"))
    first = catalog.write("t", rows, path)
    catalog.write("other", rows.select("shard_no", "id"), path)
    seen = []
    changed, manifest = catalog.refresh(path, fingerprints(catalog.columns()).limit(0), lambda name, df: seen.append((name, df)))
    assert changed == ["other", "t"]
    assert catalog.refresh(path, manifest, lambda *_: None)[0] == []
    # one shard of the source gets a wider type and one more column
    wide = rows.filter("shard_no = 2").select("shard_no", "id", (F.col("v") + (1 << 40)).alias("v"), F.lit("x").alias("w"))
    catalog.write("t", wide, path)
    changed, _ = catalog.refresh(path, manifest, lambda name, df: seen.append((name, df)))
    assert changed == ["t"]
    union = seen[-1][1]
    assert union.dtypes == [("shard", "string"), ("id", "bigint"), ("v", "bigint"), ("w", "string")]
    got = {r.id: (r.shard, r.v, r.w) for r in union.collect()}
    assert len(got) == 40 and got[2] == ("sh0002", 2 + (1 << 40), "x") and got[1] == ("sh0001", 1, None)
    told = {(r.shard, r.column): r.type for r in catalog.columns().filter("table = 't'").collect()}
    assert told["sh0002", "v"] == "bigint" and told["sh0001", "v"] == "int" and ("sh0001", "w") not in told
    assert {r.type for r in catalog.columns(first).filter("column = 'v'").collect()} == {"int"}
    inventory = {r.table: list(r.columns) for r in table_inventory(catalog.columns()).collect()}
    assert inventory == {"t": ["id", "v", "w"], "other": ["id"]}
    # a branch per set of columns
    assert plan_of(union).count("FileScan") == 2


def test_shards_without_columns_are_gone(spark):
    catalog = ColumnCatalog(spark, scratch_path(spark, "catalog"))
    assert catalog.columns().collect() == []
    catalog.record("t", [1, 2], T.StructType([T.StructField("a", INT)]))
    catalog.record("t", [2], T.StructType())
    assert [(r.shard, r.column) for r in catalog.columns().collect()] == [("sh0001", "a")]
    with pytest.raises(ValueError, match="no such table: u"):
        catalog.union("u", "nowhere")


# feeds by position


def fed(spark, state=None):
    path = scratch_path(spark, "changes")
    rows = [(lsn % 3, lsn, f"v{lsn}") for lsn in range(1, 31)]
    random.Random(1).shuffle(rows)
    schema = "shard_no int, lsn bigint, v string"
    for i in range(0, 30, 10):
        spark.createDataFrame(rows[i : i + 10], schema).coalesce(1).write.mode("append").parquet(path)
    return path, PositionFeed(spark, lambda: spark.read.schema(schema).parquet(path), state or scratch_path(spark, "state")), rows


def test_a_feed_goes_on_from_any_positions(spark):
    path, feed, rows = fed(spark)
    got = {}

    def sink(batch, number):
        got[number] = sorted((r.shard_no, r.lsn) for r in batch.collect())

    assert {r.shard_no: r.gap for r in feed.gap().collect()} == {0: 30, 1: 28, 2: 29}
    assert feed.step(sink, 10) and not feed.step(sink, 10)
    assert feed.step(sink, {0: 30, 1: 13})
    assert {r.shard_no: r.gap for r in feed.gap().collect()} == {0: 0, 1: 15, 2: 19}
    assert {r.shard_no: r.lsn for r in feed.committed().collect()} == {0: 30, 1: 13, 2: 10}
    assert feed.step(sink) and not feed.step(sink)
    assert sorted(x for batch in got.values() for x in batch) == sorted((s, lsn) for s, lsn, _ in rows)
    assert got[1] == [(s, lsn) for s, lsn, _ in sorted(rows) if (s == 0 and lsn > 9) or (s == 1 and 10 < lsn <= 13)]
    feed.seek({0: 21, 1: 28, 2: 2})
    again = PositionFeed(spark, feed.changes, feed.log.path)
    assert again.step(sink)
    assert got[max(got)] == [(s, lsn) for s, lsn, _ in sorted(rows) if (s == 0 and lsn > 21) or (s == 2 and lsn > 2)]


def test_a_batch_whose_commit_is_lost_comes_again(spark):
    path, feed, rows = fed(spark)
    seen = []

    def fails(batch, number):
        seen.append((number, rows_by_shard(batch).count()))
        raise KeyError("lost")

    with pytest.raises(KeyError):
        feed.step(fails, 12)
    # more changes and another fence make no difference to the batch that was begun
    again = PositionFeed(spark, feed.changes, feed.log.path)
    assert again.step(lambda batch, number: seen.append((number, batch.agg(F.max("lsn")).first()[0])))
    assert seen == [(0, 3), (0, 12)]


def test_two_readers_of_one_state(spark):
    path, feed, rows = fed(spark)
    other = PositionFeed(spark, feed.changes, feed.log.path)
    with pytest.raises(RuntimeError, match="another reader"):
        feed.step(lambda *_: other.seek({0: 1}) and None)


def test_the_range_of_positions_reaches_the_scan(spark):
    path, feed, rows = fed(spark)
    plan = plan_of(feed.between({0: 3}, {0: 9}))
    assert "GreaterThan(lsn,3)" in plan and "LessThanOrEqual(lsn,9)" in plan


# work on whole shards


def sharded(spark):
    rows = spark.range(1000).select((F.col("id") % 5).cast("int").alias("shard_no"), "id")
    active = spark.createDataFrame([(n, f"sh{n:04d}") for n in (0, 1, 3, 4, 7)], "shard_no int, shard string")
    return rows, active


@pytest.mark.parametrize("batch", [7, 10_000])
def test_an_aggregate_per_shard_is_one_row(spark, batch):
    rows, active = sharded(spark)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        sums = lambda df: df.agg(F.sum("id").alias("total"), F.count(F.lit(1)).alias("n"))
        results, counts = run_each_shard(rows, sums, active, at_once=3)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert {r.shard_no: (r.total, r.n) for r in results.collect()} == {
        **{n: (sum(range(n, 1000, 5)), 200) for n in (1, 3, 4)}, 7: (None, 0)
    }
    assert {r.shard: r.row_count for r in counts.collect()} == {f"sh{n:04d}": "1" for n in (1, 3, 4, 7)}
    some, counts = run_each_shard(rows, lambda df: df.filter("id > 997"), active)
    assert sorted(r.id for r in some.collect()) == [998, 999]
    assert {r.shard: r.row_count for r in counts.collect()} == {"sh0001": "", "sh0003": "1", "sh0004": "1", "sh0007": ""}


def test_the_shard_that_fails_is_named_and_the_others_end(spark):
    rows, active = sharded(spark)

    def fails(df):
        bad = F.when(F.col("shard_no") == 3, F.raise_error(F.lit("broken row"))).otherwise(F.lit(0))
        return df.select("shard_no", "id", bad.cast("int").alias("x"))

    with pytest.raises(RuntimeError, match="error on shard sh0003.*broken row"):
        run_each_shard(rows, fails, active, at_once=2)
    none, counts = run_each_shard(rows, lambda df: df, active.limit(0))
    assert none.collect() == [] and counts.collect() == []


# totals, numbers, texts


def weights_of(spark, rows):
    return spark.createDataFrame(rows, "island_no int, shard_no int, weight bigint, unit string, other map<string,string>")


def test_totals_in_one_pass(spark):
    weights = weights_of(spark, [(0, 5, 10, "MB", {}), (0, 2, 7, None, {}), (1, 1, 3, "", {}), (2, 9, 1, "kB", {})])
    islands = spark.createDataFrame([(n,) for n in range(4)], "island_no int")
    found = totals(weights, islands)
    # both kinds of totals come from one aggregation over the weights
    assert plan_of(found).count("Expand") == 1
    got = {r.island_no: tuple(r)[1:] for r in found.collect()}
    assert got == {
        0: (False, 17, None, 1, 2), 1: (False, 3, "", 1, 1), 2: (False, 1, "kB", 1, 1), None: (True, 21, "MB", 4, 4)
    }
    assert {r.island_no: (r.weight, r.unit, r.shards) for r in island_totals(weights).collect()} == {
        k: (v[1], v[2], v[4]) for k, v in got.items() if k is not None
    }
    assert tuple(grand_total(weights, islands).first()) == (21, "MB", 4, 4)
    assert tuple(grand_total(weights.limit(0), islands).first()) == (0, None, 4, 0)


def test_numbers_of_any_size(spark):
    values = [1e30, -4e22, 1e21, 123456789012345680000.0, 1.5, 0.0, 1e-12, 3e-20, float("inf"), None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = [r.t for r in df.orderBy("i").select(number_text(F.col("v"), DOUBLE).alias("t")).collect()]
    assert got == ["1e+30", "-4e+22", "1e+21", "123456789012345680000", "1.5", "0", "0.000000000001", "3e-20", "Infinity", None]


@pytest.mark.parametrize("texts, total", [
    (["1e30", "2e30 rows"], "3e+30"), (["1e-12", "2e-12"], "0.000000000003"), (["0.1", "0.2", "x"], "0.3"),
    (["9" * 27, "1"], "1" + "0" * 27), (["9" * 28, "1"], "1e+28"), (["5e27"] * 3, "15" + "0" * 27), (["0", "none"], None), (["7", "1e30"], "1e+30"),
])
def test_sums_of_numbers_of_any_size(spark, texts, total):
    rows = [(0, n, 1, "", {"m": t}) for n, t in enumerate(texts)]
    [found] = other_totals(weights_of(spark, rows)).collect()
    assert found.total is not None if total else found.total is None
    assert found.total == total or float(found.total) == pytest.approx(float(total))


_PLAIN = re.compile(r"(\w+\\?://[^:]+\\?):[^\\@]+\\?@", re.S | re.A)


def test_redaction_equals_the_plain_pattern(spark):
    rng = random.Random(3)
    parts = ["a", "b1", "://", ":", "@", "\\", "\\://", "\\:", "\\@", " ", "//", "x", "\n", "a://u:p@h "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 16))) for _ in range(40_000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", redact_credentials(F.col("t")).alias("out")).collect():
        assert r.out == _PLAIN.sub(r"\1@", r.t), repr(r.t)


@pytest.mark.parametrize("text", [
    "see https://example.com/page and " * 31_000 + "\\ @", "a://b c:d e " * 83_000 + "\\x@", "a://b:" * 166_000 + "\\x@", "a://u:p@h " * 100_000,
    ("a://" + "b:" * 5 + "\\") * 66_000 + "@", "w" * 1_000_000 + "://u:p@h",
])
def test_redaction_of_a_megabyte(spark, text):
    df = spark.createDataFrame([(text,)], "t string").select(F.length(redact_credentials(F.col("t"))))
    df.collect()
    start = time.time()
    df.collect()
    assert time.time() - start < 1


def test_addresses_are_compared_within_their_row(spark):
    df = spark.createDataFrame([(1, "h/a,h/b,h/a,bad:1,bad:1 ,other")], "id int, listed string")
    found = normalize_endpoints(df, "listed", "id", EndpointDefaults("u", "p"))
    plan = plan_of(found)
    assert "Exchange" not in plan
    # the pattern of an address's parts is in the plan as often as it is in one parse
    one = plan_of(spark.range(1).select(F.lit("x").alias("a")))
    assert plan.count("transform(") == 1 and "transform(" not in one
    assert [(r.position, r.endpoint, r.missing) for r in found.orderBy("position").collect()] == [
        (0, "postgresql://u:p@h/a", None), (1, "postgresql://u:p@h/b", None), (3, None, "database"), (5, None, "database"),
    ]
