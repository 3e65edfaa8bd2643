import pytest
from pyspark.sql import functions as F

from shardkit.functions.text import from_to_label, redact_credentials, short_location
from shardkit.operators.endpoints import EndpointDefaults, normalize_endpoints


def one(spark, values, *columns):
    names = [f"c{i}" for i in range(len(values[0]))]
    df = spark.createDataFrame([(i, *v) for i, v in enumerate(values)], ", ".join(["i int", *[f"{n} string" for n in names]]))
    return [tuple(r)[1:] for r in df.select("i", *[c(*[F.col(n) for n in names]) for c in columns]).orderBy("i").collect()]


def test_passwords_are_taken_out(spark):
    texts = {
        "psql postgresql://me:secret@h/db": "psql postgresql://me@h/db",
        "a://u:p@h b://v:q@g": "a://u@h b://v@g",
        "escaped postgresql\\://me\\:secret\\@h": "escaped postgresql\\://me\\@h",
        "http://h:80/x": "http://h:80/x",
        "none": "none",
    }
    got = one(spark, [(t,) for t in texts], redact_credentials)
    assert [g[0] for g in got] == list(texts.values())


def test_locations(spark):
    urls = {
        "postgresql://u:p@h1:5432/db?x=1": "h1/db",
        "postgresql://u@h_2": "h_2",
        "http://Host.example.com?q": "host.example.com/",
        "https://h/a/b#c": "h/a/b",
    }
    assert [g[0] for g in one(spark, [(u,) for u in urls], short_location)] == list(urls.values())
    pairs = [("pg://h1/a", "pg://h2/b"), ("pg://u:p@h1/a", "pg://h1:1/b")]
    assert [g[0] for g in one(spark, pairs, from_to_label)] == ["from h1 to h2", "from h1/a to h1/b"]


DEFAULTS = EndpointDefaults("user", "pass", "", "5432", "database")


def endpoints(spark, text, defaults=DEFAULTS, **options):
    df = spark.createDataFrame([(1, text)], "id int, listed string")
    rows = normalize_endpoints(df, "listed", "id", defaults, **options).orderBy("position").collect()
    return [(r.endpoint, r.missing) for r in rows]


def test_list_with_defaults(spark):
    got = endpoints(spark, "postgresql://u:p@h1/db, h1:5432/db\nh2/db h1:5432/db ,,")
    assert got == [
        ("postgresql://u:p@h1:5432/db", None),
        ("postgresql://user:pass@h1:5432/db", None),
        ("postgresql://user:pass@h2:5432/db", None),
    ]


@pytest.mark.parametrize("text, defaults, missing", [
    ("h/db", EndpointDefaults(password="p"), "username"),
    ("h/db", EndpointDefaults(user="u"), "password"),
    ("u:p@/db", EndpointDefaults(), "hostname"),
    ("u:p@h", EndpointDefaults(), "database"),
])
def test_missing_parts(spark, text, defaults, missing):
    assert endpoints(spark, text, defaults) == [(None, missing)]


@pytest.mark.parametrize("text, want", [
    ("x://", "postgresql://user:pass@fallback:5432/database"),
    ("x://H1", "postgresql://user:pass@h1:5432/database"),
    ("h:443/d", "postgresql://user:pass@h:5432/d"),
    ("u@h/d", "postgresql://u:pass@h:5432/d"),
    ("h/d?x", "postgresql://user:pass@h:5432/d%3Fx"),
])
def test_forms(spark, text, want):
    defaults = EndpointDefaults("user", "pass", "fallback", "5432", "database")
    assert endpoints(spark, text, defaults) == [(want, None)]


def test_mode_is_appended_even_when_present(spark):
    defaults = EndpointDefaults("u", "p", port="1", sslmode="prefer")
    assert endpoints(spark, "x://h/d?sslmode=require", defaults)[0][0] == "postgresql://u:p@h:1/d?sslmode=require&sslmode=prefer"


def test_numbers_and_primaries(spark):
    roles = spark.createDataFrame(
        [("postgresql://user:pass@b:5432/x", "primary"), ("postgresql://user:pass@c:5432/x", "replica")],
        "endpoint string, role string",
    )
    assert endpoints(spark, "1,0,7", numbered=["a/x", "b/x"]) == [
        ("postgresql://user:pass@b:5432/x", None), ("postgresql://user:pass@a:5432/x", None),
    ]
    assert endpoints(spark, "a/x,b/x,c/x", roles=roles) == [("postgresql://user:pass@b:5432/x", None)]


def test_redaction_is_linear_in_the_number_of_links(spark):
    import time

    from pyspark.sql import functions as F

    from shardkit.functions.text import redact_credentials

    link = "see https://example.com/some/page and "
    rows = [(link * 27_000,), ("db://u:pw@h " + link * 27_000,)]
    df = spark.createDataFrame(rows, "text string").withColumn("out", redact_credentials(F.col("text")))
    start = time.time()
    out = [r.out for r in df.collect()]
    assert time.time() - start < 30
    assert out[0] == rows[0][0] and out[1].startswith("db://u@h see")
