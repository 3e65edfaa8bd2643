"""A query per operator over the documents or embeddings of a data folder, and SQL where SQL can say it."""

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardkit.llm import (
    bpe_tree,
    cost_packing,
    embedding_lsh,
    hamming_index,
    language,
    line_runs,
    order_minhash,
    packing,
    periodic_runs,
    secret_ledger,
    sharding,
    token_alignment,
    token_store,
)
from shardkit.session import scratch_path


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/embeddings.parquet")


def token_ids(spark: SparkSession, sf: str) -> DataFrame:
    store = scratch_path(spark, "token-store")
    token_store.write_store(documents(spark, sf), store, public_tokenizers.path("byte_bpe_50k.json"))
    return token_store.read_store(spark, store).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").cast("bigint").alias("ids_crc32")
    )


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def languages(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    model = language.learn(docs.where(~held_out()))
    out = language.label(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


def shards(spark: SparkSession, sf: str) -> DataFrame:
    out = sharding.shard_documents(documents(spark, sf))
    return out.select(
        "doc_id", "size", "text_crc32", F.lit(sharding.LAW).alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "n_tokens",
    )


def word_bpe(spark: SparkSession, sf: str) -> DataFrame:
    out = bpe_tree.encode_documents(documents(spark, sf), public_tokenizers.path("word_bpe_49k.json"))
    return out.select(
        "doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def packed(spark: SparkSession, sf: str) -> DataFrame:
    out = packing.pack_documents(documents(spark, sf), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select(
        "doc_id", "piece", "start", "length", F.crc32("ids").cast("bigint").alias("ids_crc32"), "sequence_id", "offset"
    )


def secrets(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    ledger = secret_ledger.SecretLedger(spark, scratch_path(spark, "secret-ledger"))
    ledger.update(docs)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    joined = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    return ledger.findings(docs).select(
        "doc_id", *[count(kind).alias(f"n_{kind}") for kind, *_ in secret_ledger.RULES],
        F.sha2(joined.cast("binary"), 256).alias("base_sha256"), joined.alias("spans"),
    )


def lines(spark: SparkSession, sf: str) -> DataFrame:
    out = line_runs.drop_lines(documents(spark, sf))
    kept = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_lines", "n_dropped", kept.alias("kept_sha256"))


def near_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return embedding_lsh.link_vectors(embeddings(spark, sf))


def nearest_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return hamming_index.nearest(embeddings(spark, sf), k=5, every=50)


def near_texts(spark: SparkSession, sf: str) -> DataFrame:
    return order_minhash.near_duplicates(documents(spark, sf))


def with_periods(docs: DataFrame) -> DataFrame:
    """In one text of ten by crc32(doc_id), the words from some place on repeat with some period."""

    def repeat(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for i, h in enumerate(batch.column(2).to_pylist()):
                words = (texts[i] or "").encode("utf-8", "surrogatepass").split()
                if h is None or h % 10 or not words:
                    continue
                g, n = h // 10, len(words)
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                words[a:] = [words[a + k % p] for k in range(n - a)]
                texts[i] = b" ".join(words).decode("utf-8", "surrogatepass")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, type=pa.string())], names=["doc_id", "text"])

    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), h.alias("h"))
    return rows.mapInArrow(repeat, "doc_id bigint, text string")


def periodic(spark: SparkSession, sf: str) -> DataFrame:
    out = periodic_runs.collapse_runs(with_periods(documents(spark, sf)))
    # the longest; ties: smallest start, then period
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], -r["start"], -r["period"]))).alias("best")
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    out = out.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), best, "collapsed", listed.alias("listed"), "n_words")
    length, period = F.col("best.length"), -F.col("best.col3")
    return out.select(
        "doc_id", "n_runs", (-F.col("best.col2")).alias("start"), length.alias("length"), period.alias("period"),
        F.floor(length * 1000 / period).cast("bigint").alias("exponent_milli"),
        F.sha2(F.col("listed").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"), "n_words",
    )


def packed_by_cost(spark: SparkSession, sf: str) -> DataFrame:
    out = cost_packing.pack_documents(documents(spark, sf), public_tokenizers.path("word_bpe_49k.json"))
    return out.select(
        "doc_id", "start", "length", F.crc32("ids").cast("bigint").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset",
        cost_packing.cost(F.col("length")).alias("cost"),
    )


def aligned_tokens(spark: SparkSession, sf: str) -> DataFrame:
    out = token_alignment.align(
        documents(spark, sf), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    )
    n_links = (F.octet_length("links") / 4).cast("bigint")
    return token_alignment.with_scores(out).select(
        "doc_id", "n_a", "n_b", (F.col("n_a") + F.col("n_b") - n_links).alias("n_groups"), n_links.alias("n_links"),
        "n_best", "count_sum", "groups_sha256",
    )


QUERIES = {
    "op1_token_store": token_ids,
    "op2_language": languages,
    "op3_sharding": shards,
    "op4_word_bpe": word_bpe,
    "op5_packing": packed,
    "op6_secret_ledger": secrets,
    "op7_line_runs": lines,
    "op8_vector_links": near_vectors,
    "op9_hamming_index": nearest_vectors,
    "op10_order_minhash": near_texts,
    "op11_periodic_runs": periodic,
    "op12_cost_packing": packed_by_cost,
    "op13_token_alignment": aligned_tokens,
}

_STRIPPED = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_PATTERNS = {
    "assign": (
        "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
        "|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"
    ),
    # a run is matched whole, so those of the least length are found by asking for it
    "access": "AKIA[A-Z0-9]{14,}",
    "hex": "[0-9a-f]{16,}",
}
# A match is long enough if this holds for its text m.
_LONG = {
    "assign": "length(regexp_extract(m, '" + _PATTERNS["assign"] + "', 2)) >= 12",
    "access": "length(m) >= 18",
    "hex": "length(m) >= 16",
}


def _spans_sql() -> str:
    """Positions come from the lengths of all matches and of what is between them."""
    kinds = []
    for rank, (kind, pattern) in enumerate(_PATTERNS.items()):
        kinds.append(f"""
        SELECT doc_id, {rank} AS rank, '{kind}' AS kind, starts AS s, starts + length(m) AS e FROM (
          SELECT doc_id, unnest(ms) AS m, unnest(list_transform(range(1, len(ms) + 1), lambda i:
            coalesce(list_sum(list_transform(gaps[1:i], lambda g: length(g))), 0)
            + coalesce(list_sum(list_transform(ms[1:i-1], lambda g: length(g))), 0)))::BIGINT AS starts
          FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS ms, regexp_split_to_array(text, '{pattern}') AS gaps
                FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents))
        ) WHERE {_LONG[kind]}""")
    return " UNION ALL ".join(kinds)


ORACLES = {
    "op6_secret_ledger": f"""
      WITH found AS ({_spans_sql()}),
      by_doc AS (SELECT doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access,
                   count(*) FILTER (rank = 2) AS n_hex,
                   string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans
                 FROM found GROUP BY doc_id)
      SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access,
        coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
      FROM documents d LEFT JOIN by_doc b ON d.doc_id = b.doc_id""",
    "op7_line_runs": f"""
      WITH lines AS (
        SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
      keyed AS (SELECT *, translate(trim(line, {_STRIPPED}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
                FROM lines),
      repeated AS (SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 40
                   GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
      marked AS (SELECT k.doc_id, k.line, k.pos, r.key IS NOT NULL AND k.doc_id <> r.last AS lost
                 FROM keyed k LEFT JOIN repeated r ON k.key = r.key)
      SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
        sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
      FROM marked GROUP BY doc_id""",
}
