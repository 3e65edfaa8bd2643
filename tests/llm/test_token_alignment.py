"""Alignment of two tokenizers against a plain walk over both libraries' tokens."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from shardkit.llm import queries, token_alignment
from shardkit.llm.token_alignment import EMPTY, Fragment, Open, fragment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tool():
    with open(A, encoding="utf-8") as a, open(B, "rb") as b:
        return token_alignment.Aligner(a.read(), b.read())


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def byte_of():
    """Fixed rule of byte-level vocabularies: printable bytes stand for themselves, the others follow from 256 on."""
    prints = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in prints]
    return {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(others)}


BYTE_OF = byte_of()


def brute(text, libraries):
    """(A ids, B ids, groups, links) of whole texts, byte by byte."""
    a_lib, b_lib = libraries
    if not text:
        return 0, 0, [], []
    a = [(t.id, bytes(BYTE_OF[c] for c in t.value)) for t in map_tokens(a_lib, " " + text)]
    b = []
    for i in b_lib.encode(text):
        piece = b_lib.id_to_piece(i)
        b.append((i, bytes([int(piece[3:-1], 16)]) if b_lib.is_byte(i) else piece.replace("▁", " ").encode()))
    raw = (" " + text).encode("utf-8", "surrogatepass")
    if b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
        return 0, 0, [], []
    groups, links, i, j, of_a, of_b = [], [], 0, 0, 0, 0
    own_a, own_b = [], []
    for at in range(1, len(raw) + 1):
        links.append((i, j))
        of_a, of_b = of_a + 1, of_b + 1
        end_a, end_b = of_a == len(a[i][1]), of_b == len(b[j][1])
        if end_a:
            own_a.append(a[i][0])
            i, of_a = i + 1, 0
        if end_b:
            own_b.append(b[j][0])
            j, of_b = j + 1, 0
        if end_a and end_b:
            groups.append((own_a, own_b))
            own_a, own_b = [], []
    links = [(a[x][0], b[y][0]) for x, y in dict.fromkeys(links)]
    return len(a), len(b), groups, links


def map_tokens(library, text):
    class T:
        def __init__(self, i, value):
            self.id, self.value = i, value

    encoding = library.encode(text, add_special_tokens=False)
    return [T(i, t) for i, t in zip(encoding.ids, encoding.tokens)]


def text_of(groups):
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)


def sha(groups):
    return hashlib.sha256(text_of(groups).encode()).hexdigest() if groups else ""


def random_text(rng, n):
    parts = ["the", "cat", "Straße", "naïve", " ", "  ", "\n", "\t", "'s", "don't", "漢字", "🙂", "...", "12345", "<|endoftext|>", "<s>", "<0x41>",
             "▁", "\x1c", " ", " ", "é", "é", "aaaaaaa", "ﬁ", "\r\n", "x", ",", " \n ", "​", "ل", "</s>", "\0"]
    return "".join(rng.choice(parts) + rng.choice(["", " ", " ", "\n"]) for _ in range(n))


def test_texts_against_the_libraries(tool, libraries):
    rng = random.Random(5)
    texts = [random_text(rng, rng.randint(0, 30)) for _ in range(3000)] + ["", None, " ", "\n", "a", " a ", "\0", "a\0b"]
    for text, got in zip(texts, [x for i in range(0, len(texts), 50) for x in tool.align(texts[i : i + 50])], strict=True):
        n_a, n_b, groups, links = brute(text, libraries)
        assert got[:2] == (n_a, n_b), repr(text)
        assert got[3].decode() == text_of(groups), repr(text)
        assert np.frombuffer(got[2], "<u4").tolist() == [a * 32768 + b for a, b in links]


TEXTS = token_alignment._Texts(200, 200)


def plain(f: Fragment):
    links = [x for part in f.links for x in part.tolist()]
    opens = [[x.tolist() for x in o.parts()] for o in (f.prefix, f.suffix)]
    return opens, f.closed, b"".join(f.groups), links, f.n_a, f.n_b, f.fine


ends = st.lists(st.integers(1, 60), unique=True, max_size=40).map(lambda x: np.array(sorted({*x, 60})))


@settings(max_examples=200, deadline=None)
@given(ends, ends, st.lists(st.integers(0, 60), min_size=1, max_size=6), st.randoms(use_true_random=False))
def test_fragments_are_a_monoid(a_ends, b_ends, cuts, rng):
    """Any cuts of the bytes, put together in any order of neighbours, give the whole."""
    tokens = Open(np.arange(len(a_ends)), a_ends, 100 + np.arange(len(b_ends)), b_ends)
    one = lambda x: plain(x.whole(TEXTS))

    def within(lo, hi):
        a, b = ((lo < x) & (x <= hi) for x in (a_ends, b_ends))
        return fragment(Open(tokens.a[a], a_ends[a], tokens.b[b], b_ends[b]), TEXTS)

    bounds = sorted({0, 60, *cuts})
    parts = [within(lo, hi) for lo, hi in zip(bounds, bounds[1:])]
    want = one(fragment(tokens, TEXTS))
    while len(parts) > 1:
        i = rng.randrange(len(parts) - 1)
        parts[i : i + 2] = [parts[i].then(parts[i + 1], TEXTS)]
    assert one(parts[0]) == want
    assert plain(EMPTY.then(parts[0], TEXTS)) == plain(parts[0].then(EMPTY, TEXTS)) == plain(parts[0])
    assert want[0] == [[[], [], [], []]] * 2


def brute_table(rows, libraries):
    found = [brute(text, libraries) for _, text in rows]
    counts = Counter(pair for *_, links in found for pair in set(links))
    most = defaultdict(int)
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    out = Counter()
    for (doc_id, _), (n_a, n_b, groups, links) in zip(rows, found):
        best = sum(counts[x] == most[x[0]] for x in links)
        out[doc_id, n_a, n_b, len(groups), len(links), best, sum(counts[x] for x in links), sha(groups)] += 1
    return out


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def table(docs, **options):
    most = options.pop("most_known", token_alignment.MOST_KNOWN_PAIRS)
    out = token_alignment.with_scores(token_alignment.align(docs, A, B, **options), most)
    out = out.selectExpr("*", "octet_length(links) div 4 as n_links").selectExpr("*", "n_a + n_b - n_links as n_groups")
    return Counter(tuple(r) for r in out.select(COLUMNS).collect())


@pytest.mark.parametrize("options", [{}, {"long_chars": 60, "chunk": 16, "most_known": 4}, {"long_chars": 0, "chunk": 1000, "most_known": 0}])
def test_odd_tables(odd_docs, no_docs, odd_rows, libraries, options):
    assert table(odd_docs, **options) == brute_table([r[:2] for r in odd_rows], libraries)
    assert table(no_docs, **options) == Counter()


def test_long_texts_over_many_tasks(spark, libraries):
    rng = random.Random(7)
    texts = [random_text(rng, 400) for _ in range(6)] + ["z" * 3000, "漢" * 2000, "a b" * 900, "x▁y " * 300 + "end"]
    rows = [(i % 7, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert table(docs, long_chars=100, chunk=64) == brute_table(rows, libraries)


def test_query_on_the_test_table(spark, libraries):
    rows = [(r.doc_id, r.text) for r in queries.documents(spark, SF).collect()]
    got = Counter(tuple(r) for r in queries.aligned_tokens(spark, SF).select(COLUMNS).collect())
    assert got == brute_table(rows, libraries)
    assert any(len(t or "") > 1000 for _, t in rows)
