import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from shardkit.llm import sharding


def held(rows, want_rows, shards=24):
    assert len(rows) == want_rows
    slots, size = defaultdict(list), Counter()
    for r in rows:
        assert 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
        size[r.shard] += r["size"]
    for own in slots.values():
        assert sorted(own) == list(range(len(own)))
    return size


def test_bytes_are_near_equal_and_equal_texts_together(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    rows = sharding.shard_documents(docs).collect()
    size = held(rows, len(texts))
    mean = sum(size.values()) / 24
    assert max(size.values()) < 1.01 * mean and min(size.values()) > 0.99 * mean
    where = defaultdict(set)
    for r in rows:
        assert r["size"] == len(texts[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode())
        where[texts[r.doc_id]].add(r.shard)
    assert all(len(s) == 1 for s in where.values())
    n_rows = Counter(r.shard for r in rows)
    assert max(n_rows.values()) < 1.05 * len(rows) / 24


@pytest.mark.parametrize("sf, most", [("sf0.001", 1.02), ("sf0.01", 1.005)])
def test_bytes_of_small_tables(spark, sf, most):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    size = held(sharding.shard_documents(docs).collect(), docs.count())
    mean = sum(size.values()) / 24
    # no better than the largest text allows
    largest = max(len(r.text.encode()) + 8 for r in docs.select("text").collect())
    assert max(size.values()) <= max(most * mean, 1.001 * largest) and min(size.values()) >= (2 - most) * mean


def brute_mended(sizes, chosen, held):
    """Any single move or swap that lowers the difference of fullest and emptiest."""
    total = held + np.bincount(chosen, weights=sizes, minlength=len(held))
    full, empty = total.argmax(), total.argmin()
    between = total[full] - total[empty]
    own, theirs = sizes[chosen == full], np.concatenate([[0], sizes[chosen == empty]])
    return any(abs(between - 2 * (a - b)) < between and a > b for a in own for b in theirs)


@pytest.mark.parametrize("seed", range(5))
def test_mended_placements_cannot_be_mended_by_one_step(seed):
    rng = np.random.default_rng(seed)
    sizes = (rng.lognormal(5, 1.5, 150) + 8).astype(np.int64)
    chosen, held = rng.integers(0, 6, 150).astype(np.int32), rng.integers(0, 500, 6).astype(float)
    got = sharding.mend(sizes, chosen, held)
    assert sorted(sizes) == sorted(sizes[np.argsort(got, kind="stable")])
    assert not brute_mended(sizes, got, held)
    before, after = (held + np.bincount(x, weights=sizes, minlength=6) for x in (chosen, got))
    assert after.max() - after.min() <= before.max() - before.min()


def test_odd_rows(spark, odd_docs, no_docs):
    rows = sharding.shard_documents(odd_docs, 3).collect()
    held(rows, odd_docs.count(), 3)
    assert {(r["size"], r.text_crc32) for r in rows if r.doc_id in (1, 3)} == {(8, 0)}
    assert sharding.shard_documents(no_docs).count() == 0


def test_a_group_larger_than_a_shard_is_cut(spark):
    docs = spark.createDataFrame([(i, "x" * 300 if i % 3 == 0 else f"{i} " * 60) for i in range(3000)], "doc_id bigint, text string")
    rows = sharding.shard_documents(docs).collect()
    size = held(rows, 3000)
    mean = sum(size.values()) / 24
    assert max(size.values()) < 1.05 * mean


def test_the_largest_dot_product_wins():
    sizes = np.array([[0.5, 0.1, 0.1]])
    residual = np.array([[0.6, 0.2, 0.2], [0.55, 0.9, 0.9]])
    assert sharding.place(sizes, residual)[0].tolist() == [1]
    residual[1, 0] = 0.4  # does not fit there
    assert sharding.place(sizes, residual)[0].tolist() == [0]
