"""Secret ledger, line runs and near duplicates on small and odd tables."""

import random
from collections import Counter

import numpy as np
import pytest

from shardkit.llm import line_runs, order_minhash
from shardkit.llm.secret_ledger import RULES, SecretLedger, compiled, find
from shardkit.session import scratch_path


def ledger_of(spark, rules=RULES, root=None):
    return SecretLedger(spark, root or scratch_path(spark, "ledger"), rules)


def test_findings_of_odd_rows(spark, odd_docs, no_docs):
    ledger = ledger_of(spark)
    ledger.update(odd_docs)
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in ledger.findings(odd_docs).collect()}
    assert ledger.findings(odd_docs).count() == odd_docs.count()
    assert got[13] == [("assign", 0, 28), ("hex", 12, 12)][:1]
    assert got[3] == got[1] == []
    masked = {r.doc_id: r for r in ledger.redact(odd_docs).collect()}
    assert masked[13].text == "[SECRET]'" and masked[13].n_chars == 9
    assert masked[3].text is None and masked[1].text == "" and ledger.redact(odd_docs).columns == odd_docs.columns
    empty = ledger_of(spark)
    empty.update(no_docs)
    assert empty.findings(no_docs).count() == 0 and empty.redact(no_docs).count() == 0


def test_only_unseen_blobs_and_versions_are_scanned(spark):
    docs = spark.createDataFrame([(i, f"text {i % 4} AKIA{'A' * 20}") for i in range(12)], "doc_id bigint, text string")
    ledger = ledger_of(spark)
    ledger.update(docs.where("doc_id < 3"))
    assert ledger.scanned().count() == 3
    ledger.update(docs)
    assert ledger.scanned().count() == 4
    newer = ledger_of(spark, RULES[1:], ledger.root)
    assert newer.scanned().count() == 0
    newer.update(docs)
    assert newer.scanned().count() == 4 and ledger.scanned().count() == 4
    assert {len(r.spans) for r in newer.findings(docs).collect()} == {1}


def test_an_unchanged_corpus_shuffles_no_text(spark):
    docs = spark.createDataFrame([(i, f"text {i % 40} AKIA{'A' * 20} " + "x" * 500) for i in range(120)], "doc_id bigint, text string")
    ledger = ledger_of(spark)
    ledger.update(docs, "1")
    plan = ledger._unseen(docs)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert ledger._unseen(docs).count() == 0
    ledger.update(docs, "2")
    assert ledger.scanned().count() == 40


def test_findings_of_all_paths_and_versions(spark):
    old = spark.createDataFrame([(1, f"AKIA{'A' * 20}"), (2, "clean"), (3, f"AKIA{'A' * 20}")], "doc_id bigint, text string")
    new = spark.createDataFrame([(1, "clean"), (2, f"AKIA{'B' * 20}"), (4, None)], "doc_id bigint, text string")
    ledger = ledger_of(spark)
    assert ledger.history().count() == 0
    ledger.update(old, "old")
    again = ledger_of(spark, root=ledger.root)
    again.update(new, "new")
    got = {(r.corpus_version, r.doc_id): len(r.spans) for r in again.history().collect()}
    assert got == {("old", 1): 1, ("old", 2): 0, ("old", 3): 1, ("new", 1): 0, ("new", 2): 1, ("new", 4): 0}
    assert again.scanned().count() == 4


def test_short_matches_hide_what_they_cover():
    patterns = compiled(RULES)
    assert find("password: secret: abcdefghijklmnop", patterns) == []
    text = "API_KEY=0123456789abcdef0123 é AKIAABCDEFGHIJKLMN"
    assert [(s["kind"], s["start"], s["end"]) for s in find(text, patterns)] == [
        ("assign", 0, 28), ("hex", 8, 28), ("access", 31, 49),
    ]
    assert find("toKen=abcdefghijklmnop paſſword=abcdefghijklmnop", patterns) == []


def plain_lines(rows, least_chars=40, least_docs=5):
    docs = {}
    key = lambda line: line.strip(line_runs.STRIPPED).translate(str.maketrans(line_runs.UPPER, line_runs.LOWER))
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least_chars:
                docs.setdefault(key(line), set()).add(-(1 << 63) if doc_id is None else doc_id)
    out = Counter()
    for doc_id, text in rows:
        at, kept, lines = -(1 << 63) if doc_id is None else doc_id, [], (text or "").split("\n")
        for line in lines:
            own = docs.get(key(line), ())
            if len(own) < least_docs or max(own) == at:
                kept.append(line)
        out[doc_id, "\n".join(kept), len(lines), len(lines) - len(kept)] += 1
    return out


def lines_of(docs, **options):
    rows = line_runs.drop_lines(docs, **options).selectExpr("row.doc_id", "text", "n_lines", "n_dropped").collect()
    return Counter((r.doc_id, r.text or "", r.n_lines, r.n_dropped) for r in rows)


def test_lines_of_odd_rows(odd_docs, odd_rows, no_docs):
    assert lines_of(odd_docs) == plain_lines([r[:2] for r in odd_rows])
    assert lines_of(no_docs) == Counter()
    kept = {r.doc_id: r for r in line_runs.deduped(odd_docs).collect()}
    assert kept[3].text is None and kept[9].n_chars == len(kept[9].text) and line_runs.deduped(odd_docs).columns == odd_docs.columns


@pytest.mark.parametrize("batches, fanout", [(1, 2), (5, 2), (7, 3)])
def test_batches_and_levels_do_not_change_the_lines(spark, batches, fanout):
    rng = random.Random(4)
    rows = []
    for i in range(300):
        lines = [f"{' ' * rng.randint(0, 2)}{'Line' if rng.random() < 0.5 else 'line'} {int(rng.expovariate(0.03))} {'x' * 40}" for _ in range(rng.randint(0, 8))]
        rows.append((rng.randint(0, 250), "\n".join(lines)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert lines_of(docs, batches=batches, fanout=fanout) == plain_lines(rows)


def test_runs_opened_again_go_on(spark):
    """A store of runs that is opened for each batch gives the same lines; replaced runs are gone."""
    rng, seen = random.Random(6), Counter()
    root, last = scratch_path(spark, "runs"), {}
    for batch in range(7):
        rows = [(bytes([rng.randint(0, 60)]), 1000 - 100 * batch - rng.randint(0, 90)) for _ in range(80)]
        line_runs.LineRuns(spark, root).add(spark.createDataFrame(rows, "line binary, doc_id bigint"))
        for line, doc_id in set(rows):
            seen[line] += 1
            last[line] = max(doc_id, last.get(line, doc_id))
    store = line_runs.LineRuns(spark, root)
    got = {bytes(r.line): r.last_doc for r in store.repeated().collect()}
    assert got == {line: last[line] for line, n in seen.items() if n >= 5}
    from shardkit.sources.commits import names

    assert sorted(n for level in store.levels for n in level) == names(spark, f"{root}/runs")
    assert len(names(spark, f"{root}/runs")) <= 3


COMMON = "a line that stands in exactly as many documents as it takes"


@pytest.mark.parametrize("ids", [
    [None, 10, 20, 30, 40],  # the null id is the deciding fifth document
    [0, 1_999_999, 4_000_000, 6_000_000, 7_999_999],
    [0, 100_000, 10**11, 5 * 10**11, 10**12],
    [1, 2, 3, 4, 5, 10**12],
    [-(1 << 63), -1, 0, 1, (1 << 63) - 1],
    [None] * 3,
])
def test_every_document_counts_whatever_its_id(spark, ids):
    rows = [(i, f"{COMMON}\nand one of document {i} that is long enough to be counted") for i in ids]
    assert lines_of(spark.createDataFrame(rows, "doc_id bigint, text string")) == plain_lines(rows)


def test_one_outlier_id_leaves_the_others_counted(spark):
    rows = [(i, f"{COMMON} {i % 20}") for i in [*range(100), 10**12]]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert lines_of(docs) == plain_lines(rows)
    assert sum(r.n_dropped for r in line_runs.drop_lines(docs).collect()) == 81


def test_few_lost_lines_are_joined_as_many_are(spark):
    """Texts cross one exchange at any size, so that the disk needed grows as the input."""
    docs = spark.createDataFrame([(i, f"{COMMON}\nown line {i}") for i in range(30)], "doc_id bigint, text string")
    out = line_runs.drop_lines(docs)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert sum(r.n_dropped for r in out.collect()) == 29


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_alignment_is_exact():
    rng = np.random.default_rng(8)
    for _ in range(400):
        a = rng.integers(0, rng.integers(2, 12), rng.integers(0, 60)).astype(np.uint64)
        b = a.copy() if rng.random() < 0.7 else rng.integers(0, 8, rng.integers(0, 60)).astype(np.uint64)
        for _ in range(rng.integers(0, 12)):
            i = int(rng.integers(0, len(b) + 1))
            b = np.concatenate([b[:i], rng.integers(0, 8, rng.integers(0, 3)).astype(np.uint64), b[i + int(rng.integers(0, 3)) :]])
        want, most = edits(a.tolist(), b.tolist()), int(rng.integers(0, 40))
        got = order_minhash.edits_within(a, b, most)
        assert got == (want if want <= most else None), (a, b, want, most, got)


def plain_classes(rows, least=0.8, near=None):
    texts = {}
    for doc_id, text in rows:
        if doc_id is not None:
            texts.setdefault(text or "", []).append(doc_id)
    keys = list(texts)
    words = [t.split() for t in keys]
    root = list(range(len(keys)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(keys)):
        for j in range(i):
            longest = max(len(words[i]), len(words[j]))
            bag = sum((Counter(words[i]) & Counter(words[j])).values())
            if not words[i] or not words[j] or bag < least * longest:
                continue
            if near(words[i], words[j]) if near else edits(words[i], words[j]) <= (1 - least) * longest + 1e-9:
                root[top(i)] = top(j)
    names = {}
    for i, k in enumerate(keys):
        names[top(i)] = min(names.get(top(i), 1 << 62), *texts[k])
    return {k: names[top(i)] for i, k in enumerate(keys)}


def test_near_duplicates_of_the_test_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    # brute force by the library's alignment, which has a test of its own against plain edits
    want = plain_classes(rows, near=lambda a, b: order_minhash.similar(numbers(a), numbers(b)))
    got = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(docs).collect()}
    assert got == {d: want[t or ""] for d, t in rows}


def numbers(words):
    return np.array([hash(w) & 0xFFFFFFFFFFFFFFFF for w in words], dtype=np.uint64)


def test_near_duplicates_of_odd_rows(spark, odd_docs, no_docs):
    got = Counter((r.doc_id, r.class_id, r.kept) for r in order_minhash.near_duplicates(odd_docs).collect())
    assert sum(got.values()) == odd_docs.count()
    assert got[6, 6, True] == 2 and got[8, 6, False] == 1 and got[11, 6, False] == 1 and got[3, 1, False] == 1
    assert got[5, 4, False] == 1 and got[None, None, True] == 1
    kept = order_minhash.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([None, 1, 2, 4, 6, 12, 13, 14])
    assert order_minhash.near_duplicates(no_docs).count() == 0 and order_minhash.one_of_each(no_docs).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_no_similar_pair_is_ruled_out(seed):
    """Texts of many lengths, with edits around the bound, moved parts and words that repeat."""
    rng, made = random.Random(seed), []
    for _ in range(60):
        n = rng.choice([1, 2, 5, 20, 60, 127, 129, 200])
        made.append([rng.randint(0, rng.choice([5, 100, 10**6])) for _ in range(n)])
        made.append([abs(w) for w in edited(rng, made[-1], rng.randint(0, max(1, n // 4)), False)] or [1])
        at = rng.randrange(n)
        made.append(made[-2][at:] + made[-2][:at])
    words = [np.array(w, dtype=np.uint64) for w in made]
    maps, lengths = [order_minhash.text_maps(w) for w in words], np.array([len(w) for w in words])
    found = set(order_minhash.close_pairs(lengths, maps, np.arange(len(words)), None, 0.8))
    found |= {(j, i) for i, j in found}
    near = {(i, j) for i in range(len(words)) for j in range(i) if order_minhash.similar(words[i], words[j])}
    assert near and near <= found and len(found) < 0.2 * len(words) ** 2
    sides = np.arange(len(words)) % 2
    groups = np.arange(len(words)) // 3
    across = set(order_minhash.close_pairs(lengths, maps, groups, sides, 0.8))
    want = {(i, j) for i, j in found if sides[i] != sides[j] and groups[i] != groups[j]}
    assert across | {(j, i) for i, j in across} == want


def test_blocks_do_not_change_classes(spark, monkeypatch):
    rng = random.Random(5)
    base = [[f"w{rng.randint(0, 400)}" for _ in range(60)] for _ in range(4)]
    rows = []
    for i in range(160):
        words = list(base[i % 4])
        for _ in range(rng.randint(0, 4)):
            words[rng.randrange(60)] = f"w{rng.randint(0, 400)}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    monkeypatch.setattr(order_minhash, "BLOCK_TEXTS", 10)
    monkeypatch.setattr(order_minhash, "LEADERS", 1)
    got = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(docs).collect()}
    assert got == {i: i % 4 for i in range(160)}


def test_maps_rule_out_texts_that_are_a_little_too_far(spark):
    """Of pairs with a quarter of 170 words replaced, where a fifth may be, few are left to align."""
    rng = random.Random(12)
    base = [rng.getrandbits(60) for _ in range(170)]
    texts = [np.array(w, dtype=np.uint64) for w in [base, *[edited(rng, base, 42, True) for _ in range(60)]]]
    maps, lengths = [order_minhash.text_maps(w) for w in texts], np.full(len(texts), 170)
    groups = np.minimum(np.arange(len(texts)), 1)
    assert not any(order_minhash.similar(texts[0], t) for t in texts[1:])
    assert len(order_minhash.close_pairs(lengths, maps, groups, None, 0.8)) <= 6


def test_a_text_meets_one_leader_of_each_chosen_bucket(spark):
    rng = random.Random(13)
    rows = [(b, n, 40) for b in range(72) for n in rng.sample(range(60), 40)]
    met = spark.createDataFrame(rows, "bucket bigint, node bigint, n bigint")
    pairs = order_minhash._leader_pairs(met).collect()
    assert max(Counter(p.node for p in pairs).values()) <= order_minhash.CHOSEN + 2
    leaders = {b: {n for x, n, _ in rows if x == b} for b in range(72)}
    assert all(any({p.node, p.leader} <= held for held in leaders.values()) for p in pairs)


def test_kept_texts_are_joined_alike_at_any_size(spark):
    docs = spark.createDataFrame([(i, f"text number {i // 2} of some words") for i in range(20)], "doc_id bigint, text string")
    kept = order_minhash.one_of_each(docs)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    got = sorted(r.doc_id for r in kept.collect())
    assert got == [0]


def edited(rng, words, n_edits, evenly):
    """words with so many of them replaced, deleted or preceded by a new one; evenly: replaced, at equal distances."""
    words = list(words)
    if evenly:
        for i in range(n_edits):
            words[(2 * i + 1) * len(words) // (2 * n_edits)] = rng.getrandbits(60)
        return words
    for _ in range(n_edits):
        at, kind = rng.randrange(len(words)), rng.random()
        words[at : at + (kind < 0.8)] = [] if kind < 0.2 else [rng.getrandbits(60)]
    return words


def values(words):
    words = np.array(words, dtype=np.uint64)
    return {*order_minhash.sketch(words).tolist(), *order_minhash.segments(words).tolist()}


def recall(n_words, similarity, evenly, pairs=200):
    """The part of pairs, similar by the brute-force count, that are candidates."""
    rng, met, all_ = random.Random(n_words), 0, 0
    for _ in range(pairs):
        a = [rng.getrandbits(60) for _ in range(n_words)]
        b = edited(rng, a, int((1 - similarity) * n_words + 1e-9), evenly)
        if edits(a, b) <= 0.2 * max(len(a), len(b)) + 1e-9:
            all_ += 1
            met += bool(values(a) & values(b))
    return met / all_


@pytest.mark.parametrize("evenly", [False, True])
@pytest.mark.parametrize("n_words", [5, 10, 14, 20, 32])
def test_short_similar_texts_always_meet(n_words, evenly):
    assert recall(n_words, 0.8, evenly) == 1


@pytest.mark.parametrize("n_words, similarity, evenly, least", [
    (200, 0.8, False, 0.99), (200, 0.8, True, 0.97), (200, 0.85, True, 0.99), (60, 0.8, False, 0.99), (60, 0.8, True, 0.95),
])
def test_long_similar_texts_meet(n_words, similarity, evenly, least):
    assert recall(n_words, similarity, evenly, 100) >= least


def test_near_duplicates_of_short_texts(spark):
    rng = random.Random(9)
    rows = [(0, "one two three four five"), (1, "one two three four six"), (2, "a b c d e f g h i j"), (3, "a b c d X f g h i j")]
    for i in range(4, 260):
        rows.append((i, " ".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(1, 24)))))
        if i % 2:
            rows[-1] = (i, " ".join(str(w) for w in edited(rng, rows[rng.randrange(i)][1].split(), rng.randint(0, 2), False)))
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").selectExpr("doc_id + 1000 doc_id", "text").collect()
    rows += [(r.doc_id, r.text) for r in table if len((r.text or "").split()) < 40]
    want = plain_classes(rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.class_id for r in order_minhash.near_duplicates(docs).collect()}
    assert got == {d: want[t or ""] for d, t in rows}
    assert got[1] == 0 and got[3] == 2


def test_a_pair_comes_from_its_first_shared_bucket_only():
    words = np.arange(40, dtype=np.uint64)
    row = {"side": 0, "n_words": 40, "bits": order_minhash.text_maps(words)}
    a, b = row | {"node": 1, "component": 1, "shared": [7, 3, 9]}, row | {"node": 2, "component": 2, "shared": [9, 7]}
    assert order_minhash.cell_pairs([a, b], 7, False, 0.8) == [(1, 2)]
    assert order_minhash.cell_pairs([b, a, a], 9, False, 0.8) == []


def test_pairs_that_share_many_buckets_come_once(spark):
    met = spark.createDataFrame([(b, n, 3) for b in range(-4, 5) for n in range(3)], "bucket bigint, node bigint, n bigint")
    of_node = spark.createDataFrame([], "node bigint, component bigint")
    bits = order_minhash.text_maps(np.arange(40, dtype=np.uint64))
    traits = spark.createDataFrame([(n, 40, bits) for n in range(3)], "node bigint, n_words int, bits binary")
    across = order_minhash._across(met, of_node, traits, 0.8)
    assert sorted(map(tuple, across.collect())) == [(0, 1), (0, 2), (1, 2)]
    # nothing has to take repeats away behind the comparison
    plan = across._jdf.queryExecution().executedPlan().toString()
    assert plan.index("MapInArrow") < plan.index("HashAggregate")


def test_tables_that_nothing_needs_any_more_are_removed(spark, odd_docs):
    import glob

    from shardkit.session import shared_dir

    base = shared_dir(spark).removeprefix("file:")
    kinds = ("sketches", "buckets", "traits", "words", "line-hashes", "line-runs")
    before = {path for kind in kinds for path in glob.glob(f"{base}/{kind}-*")}
    found = [order_minhash.near_duplicates(odd_docs), line_runs.deduped(odd_docs)]
    assert {path for kind in kinds for path in glob.glob(f"{base}/{kind}-*")} <= before
    assert [df.count() for df in found] == [odd_docs.count()] * 2
