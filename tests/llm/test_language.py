import random

import pytest

from shardkit.llm import language
from shardkit.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    out = QUERIES["op2_language"](spark, SF).join(docs, "doc_id").where("held_out").collect()
    right = sum(r.lang_pred == r.lang for r in out)
    assert len(out) > 150 and right / len(out) > 0.97
    assert all(0 <= r.score <= 1 for r in out)


@pytest.fixture(scope="module")
def model(spark):
    return language.learn(spark.read.parquet(f"{SF}/documents.parquet"))


def test_spans_of_mixed_text(spark, model):
    docs = {r.lang: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").where("n_chars between 300 and 900").collect()}
    (en, de), n = (docs["en"], docs["de"]), len(docs["en"])
    lang, score, spans = model.label([en + "\n" + de])[0]
    assert [s[2] for s in spans] == ["en", "de"]
    assert abs(spans[0][1] - n) < 40 and 0.2 < score < 0.9


def test_paths_are_the_best(model):
    import itertools

    import numpy as np

    rng = np.random.default_rng(2)
    sizes = [4, 0, 1, 6]
    scores = rng.normal(0, 12, (sum(sizes), 3)).astype(np.float32)
    got, at = model.best_path(scores, np.cumsum([0, *sizes])), 0
    for n in sizes:
        def worth(path):
            return sum(scores[at + i, x] for i, x in enumerate(path)) - model.penalty * sum(a != b for a, b in zip(path, path[1:]))

        best = max(itertools.product(range(3), repeat=n), key=worth)
        assert abs(worth(best) - worth(got[at : at + n].tolist())) < 1e-3
        at += n


def test_odd_rows(spark, odd_docs, no_docs, model):
    got = {(r.doc_id, r.lang_pred) for r in language.label(odd_docs, model).collect()}
    assert {(3, "und"), (1, "und"), (2, "und")} <= got and (4, "und") not in got
    assert language.label(odd_docs, model).count() == odd_docs.count()
    assert language.learn(no_docs) is None
    assert {r.lang_pred for r in language.label(odd_docs, None).collect()} == {"und"}
    assert language.label(no_docs, model).count() == 0
    kept = language.keep_known(odd_docs, model, 0.0)
    assert kept.columns == odd_docs.columns and kept.where("doc_id in (1, 2, 3)").count() == 0


def test_scripts_narrow_candidates(spark):
    rows = [("это русский текст о погоде", "ru"), ("this is english text", "en")] * 3
    model = language.learn(spark.createDataFrame(rows, "text string, lang string"))
    lang, score, spans = model.label(["погода zzzz"])[0]
    assert [s[2] for s in spans] in (["ru", "en"], ["ru"], ["en"]) and not model.scripts[:, 0].tolist() == model.scripts[:, 1].tolist()


def test_two_hundred_languages(spark):
    """More languages than an eight-bit number tells apart, each of words of its own."""
    rng = random.Random(3)
    words = {f"l{i:03d}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(6)] for i in range(200)}
    rows = [(i, " ".join(rng.choice(own) for _ in range(30)), lang) for lang, own in words.items() for i in range(2)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language.learn(docs)
    assert len(model.langs) == 200
    found = model.label([t for _, t, _ in rows])
    assert sum(lang == want for (lang, *_), (_, _, want) in zip(found, rows)) >= 0.98 * len(rows)


def test_a_language_of_one_text_with_many_copies_is_learned(spark):
    rows = [(i, "eins zwei drei vier", "de") for i in range(400)] + [(i, "uno dos tres cuatro", "es") for i in range(400, 800)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert language.learn(docs, learned_docs=20).langs == ["de", "es"]


def test_texts_labelled_together_take_little_memory():
    import tracemalloc

    import numpy as np

    rng = random.Random(2)
    logs = np.random.default_rng(1).random((language.BUCKETS, 4), dtype=np.float32)
    model = language.LanguageModel(list("abcd"), logs, np.ones((len(language.SCRIPTS), 4), dtype=bool), 0, language.SWITCH_PENALTY)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(2000)]
    texts = [" ".join(rng.choices(words, k=rng.choice([20, 100, 300, 300, 1500]))) for _ in range(1500)]
    whole, parts = model.label(texts), []
    tracemalloc.start()
    try:
        for a, b in language.slices(texts, language.CHARS_AT_ONCE):
            model.label(texts[a:b])
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    for a, b in language.slices(texts, language.CHARS_AT_ONCE):
        parts += model.label(texts[a:b])
    assert peak < 30_000_000 and parts == whole
