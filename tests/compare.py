"""Compare queries with their SQL on DuckDB: python -m tests.compare SF_DIR [name ...]"""

import datetime
import decimal
import sys
import time

import duckdb

from __spark_entry__ import oracle_sql, queries

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def kind(type_name: str) -> str:
    name = type_name.lower()
    for family, names in {
        "int": ("int",), "int64": ("bigint", "long"), "double": ("double",), "text": ("string", "varchar"),
        "bool": ("boolean",), "decimal": ("decimal", "hugeint"),
    }.items():
        if any(name.startswith(n) for n in names):
            return family
    return name


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


def check(spark, sf: str, name: str) -> tuple[bool, str]:
    df = queries()[name](spark, sf)
    got = rows_of(df.columns, df.collect())
    sql = oracle_sql().get(name)
    if sql is None:
        return True, f"{len(got)} rows, no SQL"
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf}/{table}.parquet')")
    described = con.execute(f"DESCRIBE {sql}").fetchall()
    names = [d[0] for d in described]
    want = rows_of(names, con.execute(sql).fetchall())
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(names)}"
    types = dict(df.dtypes)
    differing = {d[0]: (types[d[0]], d[1]) for d in described if kind(types[d[0]]) != kind(d[1])}
    if got != want:
        diff = [(a, b) for a, b in zip(got, want) if a != b][:3]
        return False, f"{len(got)} vs {len(want)} rows, first differences {diff}; types {differing}"
    if differing:
        return False, f"types differ: {differing}"
    return True, f"{len(got)} rows"


def main(sf: str, names: list[str]) -> int:
    from shardkit.session import local_session

    spark = local_session()
    spark.sparkContext.setLogLevel("OFF")
    bad = 0
    for name in names or queries():
        start = time.time()
        try:
            ok, note = check(spark, sf, name)
        except Exception as error:
            ok, note = False, f"{type(error).__name__}: {str(error)[:1500]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:28s} {time.time() - start:6.2f}s  {note}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(min(main(sys.argv[1], sys.argv[2:]), 1))
