"""Runs against all periods of all words."""

import re
import zlib
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from shardkit.llm import periodic_runs, queries

SF = "/root/testdata/sf0.001"


def brute_runs(words):
    """(start, length, period), by trying every period."""
    words, found = np.unique(np.array(words, dtype=object), return_inverse=True)[1] if len(words) else np.array([]), {}
    n = len(words)
    for q in range(1, n // 4 + 1):
        same = np.concatenate([[0], words[q:] == words[:-q], [0]]).astype(int)
        turns = np.diff(same)
        for s, e in zip(np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)):
            if e + q - s >= max(6, 4 * q):
                found.setdefault((int(s), int(e + q - s)), q)  # the smallest period comes first
    return sorted((s, length, q) for (s, length), q in found.items())


def brute_row(doc_id, text, plant):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if plant and doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = brute_runs(words)
    kept = [w for i, w in enumerate(words) if not any(s + q <= i < s + length for s, length, q in runs)]
    return n, runs, " ".join(kept)


def found_runs(docs):
    sizes = np.array([len(d) for d in docs])
    words = np.array([w for d in docs for w in d], dtype=np.int64)
    out = [[] for _ in docs]
    for i, *run in zip(*[x.tolist() for x in periodic_runs.find_runs(words, sizes)]):
        out[i].append(tuple(run))
    return out


pieces = st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=9), st.integers(1, 9)), max_size=6)


@settings(max_examples=300, deadline=None)
@given(st.lists(pieces, min_size=1, max_size=4))
def test_runs_of_repeated_pieces(made):
    docs = [[w for piece, times in doc for w in piece * times] for doc in made]
    assert found_runs(docs) == [brute_runs(d) for d in docs]


@pytest.mark.parametrize("letters", [1, 2, 3, 30])
def test_runs_of_random_words(letters):
    rng = np.random.default_rng(letters)
    docs = [rng.integers(0, letters, rng.integers(0, 300)).tolist() for _ in range(200)]
    assert found_runs(docs) == [brute_runs(d) for d in docs]


def test_nested_and_neighbouring_runs():
    inner = ([1] * 9 + [2, 3]) * 7
    fibonacci, last = [0, 1], [0]
    while len(fibonacci) < 500:
        fibonacci, last = fibonacci + last, fibonacci
    docs = [inner, inner + [3] + inner, fibonacci, [5] * 5000, ([7] * 40 + [8]) * 30, [], [1], [1] * 5, [1] * 6]
    assert found_runs(docs) == [brute_runs(d) for d in docs]


def test_places_compared_in_blocks(monkeypatch):
    monkeypatch.setattr(periodic_runs, "PAIRS_AT_ONCE", 3)
    docs = [([1] * 40 + [2] * 17) * 6, list(range(30)) * 5]
    assert found_runs(docs) == [brute_runs(d) for d in docs]


def test_a_nonterminal_of_a_repeated_passage_is_worked_on_once():
    passage = np.random.default_rng(1).permutation(3000).tolist()
    names = periodic_runs.Names(np.array(passage * 8 + [-1]), np.zeros(24001, dtype=np.int64))
    grammar = periodic_runs.Grammar(names)
    # 2,999 rules for the passage and some for its copies; rounds in proportion to the logarithm
    assert len(np.unique(grammar.rule)) < 3010 and grammar.rounds < 60
    assert found_runs([passage * 8]) == [[(0, 24000, 3000)]]


def test_rows_of_odd_tables(odd_docs, no_docs, odd_rows):
    got = Counter((r.doc_id, r.n_words, tuple(map(tuple, r.runs)), r.collapsed) for r in periodic_runs.collapse_runs(odd_docs).collect())
    want = Counter()
    for doc_id, text, _ in odd_rows:
        n, runs, kept = brute_row(doc_id, text, False)
        want[doc_id, n, tuple(runs), kept] += 1
    assert got == want
    assert periodic_runs.collapse_runs(no_docs).count() == 0


def test_query_on_the_test_table(spark):
    docs = queries.documents(spark, SF).select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries.periodic(spark, SF).collect()}
    assert len(got) == len(docs) and any(r.n_runs for r in got.values())
    for r in docs:
        n, runs, kept = brute_row(r.doc_id, r.text, True)
        best = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=None)
        first = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
        listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
        row = got[r.doc_id]
        assert (row.n_runs, row.start, row.length, row.period, row.exponent_milli) == (len(runs), *first)
        assert row.runs_sha256 == sha256(listed.encode()).hexdigest()
        assert row.collapsed_sha256 == sha256(kept.encode("utf-8", "surrogatepass")).hexdigest()
