from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from shardkit.functions.numbers import leading_number, number_text, parse_weight, percent_text, weight_text
from shardkit.operators import report
from shardkit.operators import weights as wts

# Text of a weight, its number and unit.
WEIGHT_TEXTS = [
    ("12 MB", 12, "MB"),
    ("12.5 MB", 12, ".5 MB"),
    ("7", 7, ""),
    ("0 MB", 0, "MB"),
    ("-3 MB", 0, None),
    ("abc", 0, None),
    (None, 0, None),
    ("", 0, None),
    ("5 a\nb\u00a0", 5, "a\nb"),
]


def test_weight_texts(spark):
    df = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(WEIGHT_TEXTS)], "i int, t string")
    got = df.select("i", parse_weight(F.col("t")).alias("p")).orderBy("i").collect()
    assert [(r.p.weight, r.p.unit) for r in got] == [(w, u) for _, w, u in WEIGHT_TEXTS]


def test_weight_beyond_bigint_fails(spark):
    df = spark.createDataFrame([("99999999999999999999 MB",)], "t string")
    with pytest.raises(Exception):
        df.select(parse_weight(F.col("t"))).collect()


@pytest.mark.parametrize("type_name, values, texts", [
    ("double", [12.5, 123456789.0, 1e15, -3.0, 0.0], ["12.5", "123456789", "1000000000000000", "-3", "0"]),
    ("bigint", [12, 0], ["12", "0"]),
    ("decimal(20,4)", [Decimal("12.5000"), Decimal("100.0000"), Decimal("0.0000")], ["12.5", "100", "0"]),
    ("string", ["0", "x"], ["0", "x"]),
])
def test_number_texts(spark, type_name, values, texts):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {type_name}")
    dtype = df.schema["v"].dataType
    rows = df.select("i", number_text(F.col("v"), dtype).alias("t"), weight_text(F.col("v"), dtype).alias("w"))
    rows = rows.orderBy("i").collect()
    assert [r.t for r in rows] == texts
    zero = "" if type_name != "string" else "0"
    assert [r.w for r in rows] == [zero if t == "0" else t for t in texts]


def test_percentages_round_the_binary_value(spark):
    pairs = [(w, t) for t in (3, 7, 100, 400, 999, 2000, 40000) for w in range(0, t + 1, max(1, t // 150))]
    pairs += [(145, 10000), (9995, 10000), (1, 10**9)]
    df = spark.createDataFrame([(float(w), float(t)) for w, t in pairs], "w double, t double")
    for r in df.select("w", "t", percent_text(F.col("w") / F.col("t")).alias("p")).collect():
        exact = Decimal(r.w / r.t * 100).quantize(Decimal("0.1"), ROUND_HALF_UP)
        assert r.p == f"{exact}%", (r.w, r.t)


def test_leading_numbers(spark):
    texts = ["12 x", " -3.5", "+4e2", ".5", "x1", "", None, "7."]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.n for r in df.select("i", leading_number(F.col("t")).alias("n")).orderBy("i").collect()]
    assert [None if n is None else float(n) for n in got] == [12, -3.5, 400, 0.5, None, None, None, 7]


def test_custom_weights_of_shards_without_rows(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2)], "shard string, v int")
    active = spark.createDataFrame([("a",), ("b",)], "shard string")
    aggs = [F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"), F.collect_list("v").alias("all")]
    got = {r.shard: (r.n, r.s, sorted(r.all)) for r in wts.custom_weights(df, aggs, active).collect()}
    assert got == {"a": (2, 3, [1, 2]), "b": (0, None, [])}


def test_weight_rows(spark):
    df = spark.createDataFrame([("a", "5 MB", 2, None), ("b", None, 0, "x")], "shard string, `?column?` string, n int, t string")
    rows = {r.shard: r for r in wts.weight_rows(df, ["shard"]).collect()}
    assert rows["a"].weight_name == "Weight"
    assert (rows["a"].weight, rows["a"].unit, rows["a"].other) == (5, "MB", {"n": "2", "t": "null"})
    assert (rows["b"].weight, rows["b"].unit, rows["b"].other) == (0, None, {"n": "0", "t": "x"})


def test_default_weights(spark):
    sizes = spark.createDataFrame([("a", "t1", 3 << 19), ("a", "t2", 1 << 20), ("b", "t1", 10)], "shard string, table string, bytes bigint")
    active = spark.createDataFrame([("a",), ("b",), ("c",)], "shard string")
    got = {r.shard: (r.Size, r.Tables) for r in wts.default_weights(sizes, active).collect()}
    assert got == {"a": ("3 MB", 2), "b": ("0 MB", 1), "c": (None, 0)}


def rows(spark, values):
    return spark.createDataFrame(values, "island_no int, shard_no int, weight bigint, unit string, other map<string,string>")


def test_isolated_global_shard(spark):
    df = rows(spark, [(0, 0, 1, "", {}), (1, 0, 1, "", {}), (1, 1, 1, "", {}), (2, 5, 1, "", {})])
    kept = wts.drop_isolated_shard0(df).collect()
    assert sorted((r.island_no, r.shard_no) for r in kept) == [(1, 0), (1, 1), (2, 5)]


def test_label_without_number_counts_for_isolation(spark):
    df = spark.createDataFrame([(0, "sh0000", 1)], "island_no int, shard string, v int")
    active = spark.createDataFrame([(0, "sh0000"), (0, "misc")], "island_no int, shard string")
    got = wts.island_weights(df, [F.count(F.lit(1)).alias("n")], active, False).collect()
    assert [(r.shard_no, r.weight) for r in got] == [(0, 1)]


def test_reports(spark):
    df = rows(spark, [
        (0, 1, 0, None, {"a": "0", "b": "x"}),
        (0, 2, 0, "MB", {"a": "0.0", "b": "2 y", "c": "9"}),
        (1, 3, 3, "kB", {"a": "1.5"}),
        (1, 4, 1, "MB", {"a": "2.25 z"}),
    ])
    shares = {(r.island_no, r.shard_no): r.share for r in report.shard_share(df).collect()}
    assert shares == {(0, 1): "-", (0, 2): "-", (1, 3): "75.0%", (1, 4): "25.0%"}
    totals = {r.island_no: (r.weight, r.unit, r.shards) for r in report.island_totals(df).collect()}
    assert totals == {0: (0, None, 2), 1: (4, "kB", 2)}
    others = {(r.island_no, r.measure): r.total for r in report.other_totals(df).collect()}
    assert others == {(0, "a"): None, (0, "b"): "2", (1, "a"): "3.75"}
    islands = spark.createDataFrame([(0,), (1,), (2,)], "island_no int")
    assert tuple(report.grand_total(df, islands).first()) == (4, "MB", 3, 4)
    assert tuple(report.grand_total(df.filter("false"), islands).first()) == (0, None, 3, 0)
