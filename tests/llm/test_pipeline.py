"""The whole pipeline, and each stage, against brute-force versions on small tables with odd rows."""

import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from shardkit.llm import language
from shardkit.llm.secret_ledger import MASK, RULES, compiled, find
from tests.llm.test_texts import plain_classes, plain_lines

BYTES = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def rows(spark, odd_rows):
    """Odd rows, a part of the test documents, and copies with edits, secrets and common lines."""
    rng = random.Random(8)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").collect()
    out = [(100 + r.doc_id, r.text, r.lang) for r in docs if len(r.text) < 3000]
    common = ["a line of some length that is found in many of the documents", "Another such line, in not quite so many documents, 12345"]
    for i in range(60):
        words = out[rng.randrange(40)][1].split()
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = rng.choice(["edited", "password=abcdefgh1234", "AKIA" + "B" * 16])
        lines = [" ".join(words), *rng.sample(common, rng.randint(0, 2))]
        out.append((1000 + i, "\n".join(lines), "en" if i % 2 else None))
    # the odd rows' long texts are of one word, which brute force would align for long
    return out + [r for r in odd_rows if len(r[1] or "") < 1000]


@pytest.fixture(scope="module")
def docs(spark, rows):
    made = [(*r, "s", len(r[1] or ""), 2, b"k", [1]) for r in rows]
    return spark.createDataFrame(made, "doc_id bigint, text string, lang string, source string, n_chars bigint, part int, key binary, row array<int>").repartition(3)


def known(rows, model):
    found = model.label([t or "" for _, t, *_ in rows])
    return [r for r, (lang, score, _) in zip(rows, found) if lang != language.UNKNOWN and score >= corpus_pipeline.LEAST_LANGUAGE_SCORE]


def fresh(rows):
    left = defaultdict(list)
    for (doc_id, text, *_), n in plain_lines([r[:2] for r in rows]).items():
        left[doc_id] += [text] * n
    # rows of one id keep their order: equal texts give equal texts
    by_text = {}
    for doc_id, text, *_ in rows:
        [(_, kept, _, _)] = plain_of(rows, doc_id, text)
        by_text[doc_id, text] = kept
    return [(d, None if t is None else by_text[d, t], lang) for d, t, lang in rows]


def plain_of(rows, doc_id, text):
    """plain_lines of all rows, of one of them."""
    own = plain_lines([(doc_id, text)], least_docs=1 << 60)
    [(_, whole, n_lines, _)] = own
    lost = _lost(tuple(r[:2] for r in rows)).get(doc_id, ())
    lines = [x for x in whole.split("\n") if _key(x) not in lost]
    return [(doc_id, "\n".join(lines), n_lines, 0)]


def _key(line):
    from shardkit.llm import line_runs

    return line.strip(line_runs.STRIPPED).translate(str.maketrans(line_runs.UPPER, line_runs.LOWER))


_LOST = {}


def _lost(rows):
    """Keys of lines that each document loses."""
    if rows not in _LOST:
        held = defaultdict(set)
        for doc_id, text in rows:
            for line in (text or "").split("\n"):
                if len(_key(line)) >= 40:
                    held[_key(line)].add(-(1 << 63) if doc_id is None else doc_id)
        lost = defaultdict(set)
        for key, ids in held.items():
            if len(ids) >= 5:
                for doc_id in ids - {max(ids)}:
                    lost[None if doc_id == -(1 << 63) else doc_id].add(key)
        _LOST[rows] = lost
    return _LOST[rows]


def one_each(rows):
    """The document with the smallest id of each class; rows without an id stay."""
    named = [r for r in rows if r[0] is not None]
    classes = plain_classes([r[:2] for r in named])
    out, seen = [r for r in rows if r[0] is None], set()
    for r in sorted(named, key=lambda r: r[0]):
        name = classes[r[1] or ""]
        if r[0] == name and name not in seen:
            seen.add(name)
            out.append(r)
    return out


def masked(rows):
    patterns, out = compiled(RULES), []
    for doc_id, text, lang in rows:
        if text is not None:
            parts, at = [], 0
            for s in find(text, patterns):
                if s["start"] >= at:
                    parts += [text[at : s["start"]], MASK]
                at = max(at, s["end"])
            text = "".join([*parts, text[at:]])
        out.append((doc_id, text, lang))
    return out


def texts(frame):
    return Counter((r.doc_id, r.text, r.lang) for r in frame.select("doc_id", "text", "lang").collect())


def plain_stages(rows, model):
    out = [known(rows, model)]
    for stage in (fresh, one_each, masked):
        out.append(stage(out[-1]))
    return out


def check_packed(got, rows):
    library = Tokenizer.from_file(BYTES)
    want = Counter()
    for doc_id, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        first = (len(ids) - 1) % 1024 + 1
        cuts = [0, *range(first, len(ids) + 1, 1024)]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[doc_id, i, a, np.array(ids[a:b], dtype="<u4").tobytes()] += 1
    assert Counter((r.doc_id, r.piece, r.start, bytes(r.ids)) for r in got) == want
    ends = defaultdict(list)
    for r in got:
        ends[r.sequence_id].append((r.offset, r.length))
    for own in ends.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 1024


def test_each_stage_on_what_is_left(spark, docs, rows):
    """The stages in a row; columns stay, and every one has something to do."""
    model = language.learn(docs)
    want, before, current = plain_stages(rows, model), texts(docs), docs
    for (name, stage), wanted in zip(corpus_pipeline.STAGES, want):
        current = stage(spark, current, "unused")
        assert current.columns == docs.columns, name
        got = texts(current)
        assert got == Counter(wanted), name
        assert got != before, name
        before = got
    check_packed(corpus_pipeline.STAGES[-1][1](spark, current, "unused").collect(), want[-1])


def test_run_equals_the_stages(spark, docs, rows, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    stored = spark.read.parquet(f"{tmp_path}/documents.parquet")
    check_packed(corpus_pipeline.run(spark, str(tmp_path)).collect(), plain_stages(rows, language.learn(stored))[-1])


def test_stages_of_no_rows(spark, docs):
    none = docs.where("1 = 0")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, "unused").count() == 0, name


def test_what_stages_were_made_of_is_removed(spark, docs, tmp_path, monkeypatch):
    from shardkit.llm import common
    from shardkit.sources.layout import exists

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    made, scratch = [], common.scratch_path
    monkeypatch.setattr(common, "scratch_path", lambda spark, label: made.append(scratch(spark, label)) or made[-1])
    out = corpus_pipeline.run(spark, str(tmp_path))
    left = [p.rsplit("/", 1)[-1].rsplit("-", 1)[0] for p in made if exists(spark, p)]
    assert left == ["pieces"] and out.count() > 0
