"""Credentials, locations and addresses in text columns."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from queries.fixtures import table
from shardkit.functions import text as txt
from shardkit.operators import endpoints


def redact_credentials(spark: SparkSession, sf: str) -> DataFrame:
    """Whole documents, each with an address and its password put in its middle and at its end."""
    address = F.concat(F.lit("postgresql://"), "source", F.lit(":p"), F.col("doc_id").cast("string"), F.lit("w@db/x "))
    half = (F.length("text") / 2).cast("int")
    filled = F.concat(
        F.substring("text", F.lit(1), half), F.lit(" "), address,
        F.substring("text", half + 1, F.length("text")), F.lit(" "), address,
    )
    redacted = txt.redact_credentials(filled)
    return table(spark, sf, "documents").select(
        "doc_id", F.md5(redacted).alias("digest"), F.length(redacted).alias("chars")
    )


def short_location(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    return pages.select("page_id", txt.short_location(F.col("url")).alias("location"))


def from_to_label(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    host = F.regexp_extract("url", "^https?://([^/]*)", 1)
    same = F.concat(F.lit("postgresql://u:p@"), host, F.lit(":5432/db"))
    other = F.lit("postgresql://u:p@elsewhere.example.com/db")
    target = F.when(F.col("page_id") % 2 == 0, same).otherwise(other)
    return pages.select("page_id", txt.from_to_label(F.col("url"), target).alias("label"))


def _host(col: str = "url"):
    return F.regexp_extract(col, "^https?://([^/]*)", 1)


def normalize_endpoints(spark: SparkSession, sf: str) -> DataFrame:
    host = _host()
    listed = F.concat(
        host, F.lit(":6000/db1, postgresql://me:secret@"), host, F.lit("/db2?x=1 "), host, F.lit(",\n"),
        host, F.lit(":6000/db1 , /lost,1 postgresql://"),
    )
    defaults = endpoints.EndpointDefaults("u", "p w", "fallback", "5432", "main", "prefer")
    rows = table(spark, sf, "pages").select("page_id", listed.alias("listed"))
    return endpoints.normalize_endpoints(rows, "listed", "page_id", defaults, numbered=["zero/z", "one:1/z"])


def normalize_endpoints_primaries(spark: SparkSession, sf: str) -> DataFrame:
    host = _host()
    rows = table(spark, sf, "pages").select(
        "page_id", F.concat(host, F.lit("/a,"), host, F.lit("/b,"), host, F.lit("/c")).alias("listed")
    )
    name = F.concat(F.lit("postgresql://u:p@"), host, F.lit(":1/"))
    roles = table(spark, sf, "pages").select(
        F.concat(name, F.when(F.col("page_id") % 2 == 0, "b").otherwise("c")).alias("endpoint"),
        F.when(F.col("page_id") % 5 == 0, "replica").otherwise("primary").alias("role"),
    )
    defaults = endpoints.EndpointDefaults("u", "p", port="1")
    found = endpoints.normalize_endpoints(rows, "listed", "page_id", defaults, roles)
    return found.select("page_id", "position", "endpoint")


QUERIES = {
    f.__name__: f
    for f in (redact_credentials, short_location, from_to_label, normalize_endpoints, normalize_endpoints_primaries)
}

_HOST = "regexp_extract(url, '^https?://([^/]*)', 1)"

ORACLES = {
    "redact_credentials": """
        WITH d AS (
          SELECT doc_id, text[1:len(text) // 2] || ' postgresql://' || source || '@db/x ' || text[len(text) // 2 + 1:]
                 || ' postgresql://' || source || '@db/x ' AS t
          FROM documents)
        SELECT doc_id, md5(t) AS digest, CAST(length(t) AS INTEGER) AS chars FROM d""",
    "short_location": r"""
        SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '')
               || CASE WHEN url LIKE '%//%/%' THEN '' ELSE '/' END AS location
        FROM pages""",
    "from_to_label": rf"""
        SELECT page_id, CASE WHEN page_id % 2 = 0
               THEN 'from ' || regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') || ' to ' || {_HOST} || '/db'
               ELSE 'from ' || {_HOST} || ' to elsewhere.example.com' END AS label
        FROM pages""",
    "normalize_endpoints": f"""
        WITH h AS (SELECT page_id, {_HOST} AS host FROM pages)
        SELECT page_id, 0 AS position, 'postgresql://u:p%20w@' || host || ':6000/db1?sslmode=prefer' AS endpoint, NULL AS missing FROM h
        UNION ALL SELECT page_id, 1, 'postgresql://me:secret@' || host || ':5432/db2?x=1&sslmode=prefer', NULL FROM h
        UNION ALL SELECT page_id, 2, 'postgresql://u:p%20w@' || host || ':5432/main?sslmode=prefer', NULL FROM h
        UNION ALL SELECT page_id, 4, NULL, 'hostname' FROM h
        UNION ALL SELECT page_id, 5, 'postgresql://u:p%20w@one:1/z?sslmode=prefer', NULL FROM h
        UNION ALL SELECT page_id, 6, 'postgresql://u:p%20w@fallback:5432/main?sslmode=prefer', NULL FROM h""",
    "normalize_endpoints_primaries": f"""
        WITH h AS (SELECT page_id, {_HOST} AS host FROM pages),
        r AS (
          SELECT DISTINCT 'postgresql://u:p@' || host || ':1/' || CASE WHEN page_id % 2 = 0 THEN 'b' ELSE 'c' END AS endpoint
          FROM h WHERE page_id % 5 <> 0),
        e AS (
          SELECT page_id, unnest([0, 1, 2]) AS position,
                 'postgresql://u:p@' || host || ':1/' || unnest(['a', 'b', 'c']) AS endpoint FROM h)
        SELECT page_id, position, endpoint FROM e WHERE endpoint IN (SELECT endpoint FROM r)""",
}
