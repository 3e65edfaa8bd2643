"""Token store, packing and word BPE against the tokenizers library itself."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from shardkit.llm import bpe_tree, packing, token_store
from shardkit.llm.token_store import KeyIndex
from shardkit.session import scratch_path

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"


def raw(ids):
    return np.array(ids, dtype="<u4").tobytes()


@pytest.fixture(scope="module")
def tables(spark, odd_docs, no_docs):
    return {"odd": odd_docs, "none": no_docs, "documents": spark.read.parquet(f"{SF}/documents.parquet")}


@pytest.mark.parametrize("name", ["odd", "none", "documents"])
def test_store_reads_back_what_the_library_gives(spark, tables, name):
    docs, library = tables[name], Tokenizer.from_file(BYTES)
    path = scratch_path(spark, "store")
    token_store.write_store(docs, path, BYTES, shard_ids=500)
    got = [(r.doc_id, r.start, r.n_tokens, bytes(r.ids)) for r in token_store.read_store(spark, path).collect()]
    rows = docs.select("doc_id", "text").collect()
    want = Counter((r.doc_id, raw(library.encode(r.text or "", add_special_tokens=False).ids + [2])) for r in rows)
    assert Counter((k, ids) for k, _, _, ids in got) == want
    start = 0
    for key, at, n, ids in sorted(got, key=lambda r: r[1]):
        assert at == start and 4 * n == len(ids)
        start += n
    order = [(k is not None, k or 0) for k, *_ in sorted(got, key=lambda r: r[1])]
    assert order == sorted(order)


def test_lookup_finds_all_rows_of_known_keys(spark, tables):
    path = scratch_path(spark, "store")
    token_store.write_store(tables["odd"], path, BYTES, shard_ids=500)
    asked = spark.createDataFrame([(6,), (4,), (99,), (-5,), (None,)], "doc_id bigint")
    found = Counter(r.doc_id for r in token_store.lookup(spark, path, asked).collect())
    assert found == {6: 2, 4: 1}


def test_lookup_reads_hit_shards_only(spark, tables):
    path = scratch_path(spark, "store")
    token_store.write_store(tables["documents"], path, BYTES, shard_ids=500)
    ids = sorted(r.doc_id for r in tables["documents"].select("doc_id").collect())
    asked = spark.createDataFrame([(ids[0],), (ids[-1],), (ids[-1] + 10,)], "doc_id bigint")
    found = token_store.lookup(spark, path, asked)
    assert sorted(r.doc_id for r in found.collect()) == [ids[0], ids[-1]]
    shards = spark.read.parquet(path).count()
    read = found._jdf.queryExecution().executedPlan().toString()
    assert shards > 10 and "LeftSemi" in read


def test_rows_of_one_id_go_to_several_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    docs = spark.createDataFrame([(None if i % 2 else 7, f"text {i} " * 20) for i in range(4000)], "doc_id bigint, text string").repartition(8)
    path = scratch_path(spark, "store")
    token_store.write_store(docs, path, BYTES, shard_ids=5000)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = spark.read.parquet(path).groupBy("part").count().count()
    assert parts > 2
    rows = token_store.read_store(spark, path).collect()
    assert Counter(r.doc_id for r in rows) == {None: 2000, 7: 2000}
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    found = token_store.lookup(spark, path, spark.createDataFrame([(7,)], "doc_id bigint"))
    assert found.count() == 2000


def test_packed_ids_cross_no_exchange(tables):
    packed = packing.pack_documents(tables["documents"], BYTES)
    plan = packed._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "SortMergeJoin" not in plan


def test_key_index_is_minimal_and_knows_strangers():
    keys = np.unique(np.random.default_rng(1).integers(-(1 << 60), 1 << 60, 50_000))
    index = KeyIndex.of(keys)
    stored = index.stored()
    again = KeyIndex.read(stored)
    assert np.array_equal(np.sort(again.find(keys)), np.arange(len(keys)))
    assert (again.find(keys + 1)[~np.isin(keys + 1, keys)] == -1).all()
    assert len(KeyIndex.of(keys[:0]).find(keys)) == len(keys)


@pytest.mark.parametrize("name", ["odd", "none", "documents"])
def test_packing_covers_every_document_once(tables, name):
    docs, library = tables[name], Tokenizer.from_file(BYTES)
    got = packing.pack_documents(docs, BYTES).collect()
    rows = docs.select("doc_id", "text").collect()
    want = Counter()
    for r in rows:
        ids = library.encode(r.text or "", add_special_tokens=False).ids + [2]
        first = (len(ids) - 1) % 1024 + 1
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[r.doc_id, i, a, b - a, raw(ids[a:b])] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, bytes(r.ids)) for r in got) == want
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024
    if got:
        assert len(sequences) <= 1.05 * -(-sum(r.length for r in got) // 1024) + 1


def test_two_smaller_pieces_replace_the_smallest():
    # 700 + 200 leave 124; 160 + 164 fill the place of 200 and the gap exactly
    assert packing.fillings({700: 1, 200: 1, 164: 1, 160: 1})[0] == ((700, 164, 160), 1)


def test_fillings_use_all_pieces():
    rng = np.random.default_rng(3)
    for _ in range(20):
        counts = Counter(rng.integers(1, 65, 400).tolist())
        used = Counter()
        for lengths, times in packing.fillings(counts, 64):
            assert sum(lengths) <= 64
            for length in lengths:
                used[length] += times
        assert used == counts


@pytest.mark.parametrize("name", ["odd", "none", "documents"])
@pytest.mark.parametrize("leaf", [40, bpe_tree.LEAF_CHARS])
def test_word_bpe_is_what_the_library_gives(tables, name, leaf):
    docs, library = tables[name], Tokenizer.from_file(WORDS)
    got = Counter((r.doc_id, bytes(r.ids), r.decoded) for r in bpe_tree.encode_documents(docs, WORDS, leaf).collect())
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id, raw(ids), library.decode(ids, skip_special_tokens=False)] += 1
    assert got == want


def test_joins_are_exact_wherever_the_cut_is():
    encoder = bpe_tree.TreeEncoder(open(WORDS, encoding="utf-8").read())
    rng = np.random.default_rng(5)
    alphabets = ["ab", "abcdefghijklmnop", "thein ", "a'srevlmd ", "!?.-_", "a1b2 !", "éàçñ", "漢字かな", "aé漢😀", "l've're'll'd's "]
    for alphabet in alphabets:
        for n in (60, 700, 3000):
            text = "".join(rng.choice(list(alphabet), n))
            want = encoder.plain.encode(text, add_special_tokens=False).ids
            for most in (37, 500):
                parts = encoder.leaves(text, most)
                got = encoder.tree(parts, [encoder.tokens(p) for p in parts])
                assert got.ids.tolist() == want, (alphabet, n, most)


def test_one_endless_word_is_settled_by_pairs(monkeypatch):
    encoder = bpe_tree.TreeEncoder(open(WORDS, encoding="utf-8").read())
    text = "".join(np.random.default_rng(6).choice(list("abcdeinost"), 40_000))
    parts = encoder.leaves(text, 10_000)
    seen, tokens = [], encoder.tokens
    made = [tokens(p) for p in parts]
    monkeypatch.setattr(encoder, "tokens", lambda t, middle=False: seen.append(len(t)) or tokens(t, middle))
    assert encoder.tree(parts, made).ids.tolist() == encoder.plain.encode(text, add_special_tokens=False).ids
    assert max(seen) < 5_000


def test_crc_of_ids_is_that_of_zlib(spark):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([(raw([1, 70000, 2]),)], "ids binary").select(F.crc32("ids")).first()
    assert row[0] == zlib.crc32(raw([1, 70000, 2]))
