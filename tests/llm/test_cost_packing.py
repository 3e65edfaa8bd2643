"""Cost-balanced packing: whole coverage, no padding, the plan against one piece at a time."""

import heapq
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from shardkit import limits
from shardkit.llm import common, cost_packing

WORDS = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"


def laid_out(lengths, capacity, linear=2048):
    """Parts (piece, before, length, sequence, offset) that a plan gives."""
    lengths = np.array(lengths, dtype=np.int64)
    number = cost_packing.numbered(lengths, np.zeros(capacity + 1, dtype=np.int64))
    plan = cost_packing.Plan(dict(Counter(lengths.tolist())), capacity, linear)
    return list(zip(*[x.tolist() for x in cost_packing.places(plan.layers, lengths, number)])) if plan.layers else []


def check_sequences(parts, capacity):
    """Gapless and without padding: full, or one for each power of two at most."""
    held = defaultdict(list)
    for _, _, length, sequence, offset in parts:
        held[sequence].append((offset, length))
    sizes = []
    for own in held.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        sizes.append(at)
    short = [n for n in sizes if n != capacity]
    assert all(n < capacity and n & (n - 1) == 0 for n in short) and len(short) == len(set(short))


@settings(max_examples=200, deadline=None)
@given(st.sampled_from([4, 16, 64]).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=300))))
def test_plans_place_every_piece_without_padding(case):
    capacity, lengths = case
    parts = laid_out(lengths, capacity)
    check_sequences(parts, capacity)
    by_piece = defaultdict(int)
    for piece, before, length, *_ in parts:
        assert before == by_piece[piece]
        by_piece[piece] += length
    assert [by_piece[i] for i in range(len(lengths))] == lengths


def one_by_one(lengths, capacity, linear):
    """Costs of sequences if each piece in turn goes to the one of lowest cost that has room; stops where none has."""
    total = sum(lengths)
    open_ = [[0, -capacity, i] for i in range(total // capacity)]
    rest = [k for k in range(capacity.bit_length()) if total % capacity >> k & 1]
    open_ += [[0, -(1 << k), len(open_) + i] for i, k in enumerate(rest)]
    costs, whole = Counter(), 0
    for length in sorted(lengths, reverse=True):
        fitting = [x for x in open_ if -x[1] >= length]
        if fitting:
            best = min(fitting)
            best[0] += cost_packing.cost(length, linear)
            best[1] += length
            whole += 1
    return Counter(x[0] for x in open_), whole


@pytest.mark.parametrize("seed", range(6))
def test_whole_pieces_go_where_cost_is_lowest(seed):
    rng = np.random.default_rng(seed)
    capacity, linear = 64, int(rng.integers(0, 100))
    lengths = np.minimum(capacity, rng.geometric(0.08, 400)).tolist()
    parts = laid_out(lengths, capacity, linear)
    cut = {p[0] for p in parts if p[1] > 0}
    whole = [p for p in parts if p[0] not in cut and p[2] == lengths[p[0]]]
    costs, n = one_by_one(lengths, capacity, linear)
    assert len(whole) >= n > 0
    # costs of sequences from the pieces of the first pass, whatever their numbers
    plan = cost_packing.Plan(dict(Counter(lengths)), capacity, linear)
    spent = Counter()
    for piece, _, m, before, take, sequence, _, step in plan.rows[: plan.whole_rows]:
        assert before == 0 and step == 0 and take == piece
        for i in range(m):
            spent[sequence + i] += cost_packing.cost(piece, linear)
    n_sequences = sum(costs.values())
    assert Counter([spent[i] for i in range(n_sequences)]) == costs


def test_plan_does_not_grow_with_rows():
    lengths = np.minimum(2048, np.random.default_rng(1).lognormal(5.8, 1.1, 200_000).astype(int) + 1)
    counts = Counter(lengths.tolist())
    small, large = cost_packing.Plan(counts), cost_packing.Plan({k: n * 10_000 for k, n in counts.items()})
    assert len(large.rows) < 2 * len(small.rows)
    assert heapq.nlargest(1, [row[2] for row in large.rows])[0] > 10_000


@pytest.fixture(scope="module")
def tables(spark, odd_docs, no_docs):
    return {"odd": odd_docs, "none": no_docs, "documents": spark.read.parquet(f"{SF}/documents.parquet")}


@pytest.mark.parametrize("name", ["odd", "none", "documents"])
@pytest.mark.parametrize("rows", [limits.MAX_BROADCAST_ROWS, 0])
def test_every_id_lies_in_one_piece(tables, name, rows, monkeypatch):
    monkeypatch.setattr(common, "broadcast_within", lambda df: limits.broadcast_within(df, rows))
    docs, library = tables[name].repartition(5), Tokenizer.from_file(WORDS)
    got = cost_packing.pack_documents(docs, WORDS, capacity=256).collect()
    check_sequences([(None, r.start, r.length, r.sequence_id, r.offset) for r in got], 256)
    assert all(len(r.ids) == 4 * r.length for r in got)
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids + [1]
        want[r.doc_id, len(ids)] += np.array(ids).sum()
    have, length = Counter(), Counter()
    for r in got:
        have[r.doc_id, r.doc_tokens] += np.frombuffer(r.ids, "<u4").sum()
        length[r.doc_id, r.doc_tokens] += r.length
    assert have == want and all(n % key[1] == 0 for key, n in length.items())


def test_pieces_in_a_row_are_the_document(tables):
    library = Tokenizer.from_file(WORDS)
    docs = {r.doc_id: r.text for r in tables["documents"].collect()}
    parts = defaultdict(list)
    for r in cost_packing.pack_documents(tables["documents"], WORDS).collect():
        parts[r.doc_id].append((r.start, bytes(r.ids)))
    for doc_id, own in parts.items():
        ids = library.encode(docs[doc_id] or "", add_special_tokens=False).ids + [1]
        assert b"".join(x for _, x in sorted(own)) == np.array(ids, dtype="<u4").tobytes()
        at = 0
        for start, x in sorted(own):
            assert start == at
            at += len(x) // 4
    assert len(parts) == len(docs)


def test_ids_cross_no_exchange(tables):
    packed = cost_packing.pack_documents(tables["documents"], WORDS)
    plan = packed._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "hashpartitioning" not in plan and "BroadcastHashJoin" in plan


def test_odd_capacity_is_refused(no_docs):
    with pytest.raises(ValueError, match="power of two"):
        cost_packing.pack_documents(no_docs, WORDS, capacity=1000)
