"""Language of whole texts, word by word, with spans for mixed texts.

A word (a run of letters) has a script by its first letter; only languages that were learned in that
script stand as candidates. Each letter with its neighbours scores the candidates by
the log of how often the language has that triple; a word's score is their sum. Viterbi's algorithm
finds the labels of all words of a text with the largest sum of scores, where each
change of language costs a penalty. Neighbouring words of one label form a span.

Defined results: texts that are null or have no letter get `und`, score 0 and no spans; so does
every text if nothing could be learned. Ties go to the language first in order. A text whose
words are all in scripts that no language was learned in gets the language with most
letters learned. Repeated rows get equal results. Columns besides doc_id and text are left out.
"""

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardkit.llm.encoder import slices

UNKNOWN = "und"
# Documents learned from, per language, at most in expectation: chosen by a hash of their texts.
LEARNED_DOCS = 20_000
# Cost of a change of language, in units of log likelihood.
SWITCH_PENALTY = 12.0
# A language counts as written in a script if so large a part of its letters is.
SCRIPT_SHARE = 0.002
# Letter triples are counted in so many buckets.
BUCKETS = 1 << 16

# First and last code point of scripts' main ranges.
SCRIPT_RANGES = [
    (0x0041, 0x024F, "Latin"), (0x1E00, 0x1EFF, "Latin"), (0x0370, 0x03FF, "Greek"), (0x1F00, 0x1FFF, "Greek"),
    (0x0400, 0x052F, "Cyrillic"), (0x0530, 0x058F, "Armenian"), (0x0590, 0x05FF, "Hebrew"), (0x0600, 0x077F, "Arabic"),
    (0x0900, 0x097F, "Devanagari"), (0x0980, 0x09FF, "Bengali"), (0x0A00, 0x0A7F, "Gurmukhi"), (0x0A80, 0x0AFF, "Gujarati"),
    (0x0B80, 0x0BFF, "Tamil"), (0x0C00, 0x0C7F, "Telugu"), (0x0C80, 0x0CFF, "Kannada"), (0x0D00, 0x0D7F, "Malayalam"),
    (0x0E00, 0x0E7F, "Thai"), (0x10A0, 0x10FF, "Georgian"), (0x1100, 0x11FF, "Hangul"), (0xAC00, 0xD7AF, "Hangul"),
    (0x1200, 0x139F, "Ethiopic"), (0x1780, 0x17FF, "Khmer"), (0x3040, 0x309F, "Hiragana"), (0x30A0, 0x30FF, "Katakana"),
    (0x3400, 0x4DBF, "Han"), (0x4E00, 0x9FFF, "Han"), (0x20000, 0x2FA1F, "Han"),
]
SCRIPTS = ["other"] + list(dict.fromkeys(name for _, _, name in SCRIPT_RANGES))


@lru_cache(maxsize=1)
def _characters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: itself in lower case if it is a letter, else 0; and its script."""
    lower = np.zeros(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            small = x.lower()
            lower[c] = ord(small) if len(small) == 1 else c
    script = np.zeros(0x110000, dtype=np.uint8)
    for first, last, name in SCRIPT_RANGES:
        script[first : last + 1] = SCRIPTS.index(name)
    return lower, script


@dataclass
class Words:
    """The words of some texts in a row: where they start and end, their scripts, their letters' buckets."""

    starts: np.ndarray
    ends: np.ndarray
    scripts: np.ndarray
    buckets: np.ndarray  # of all letters, in a row
    first_letter: np.ndarray  # of each word, in buckets
    text_starts: np.ndarray
    first_word: np.ndarray  # of each text, and the number of words


def words_of(texts: list[str]) -> Words:
    lower, script = _characters()
    points = np.frombuffer(("\n" + "\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letters = lower[points]
    at = np.nonzero(letters)[0]
    gaps = np.nonzero(np.diff(at) > 1)[0]
    first = np.concatenate([[0], gaps + 1]) if len(at) else np.zeros(0, dtype=np.int64)
    last = np.concatenate([gaps, [len(at) - 1]]) if len(at) else np.zeros(0, dtype=np.int64)
    h = letters[at - 1] * np.uint32(0x9E3779B1) + letters[at] * np.uint32(0x85EBCA77) + letters[at + 1 if len(at) else at] * np.uint32(0xC2B2AE3D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    starts = at[first]
    text_starts = np.cumsum([1] + [len(t) + 1 for t in texts])
    return Words(
        starts, at[last] + 1, script[points[starts]], (h >> np.uint32(16)).astype(np.int64), first,
        text_starts, np.searchsorted(starts, text_starts),
    )


# Characters of texts labelled together, at least one text; a task holds some 80 bytes for each.
CHARS_AT_ONCE = 500_000
# Labels of words are 16-bit numbers.
MOST_LANGUAGES = 32_000


@dataclass
class LanguageModel:
    """Log likelihoods per bucket and language, the scripts of each language, the penalty."""

    langs: list[str]
    logs: np.ndarray  # BUCKETS x languages
    scripts: np.ndarray  # scripts x languages: whether learned in it
    fallback: int
    penalty: float

    def scores(self, words: Words) -> np.ndarray:
        if not len(words.starts):
            return np.zeros((0, len(self.langs)), dtype=np.float32)
        out = np.add.reduceat(self.logs[words.buckets], words.first_letter, axis=0)
        out -= out.max(axis=1, keepdims=True)
        open_ = self.scripts[words.scripts]
        known = open_.any(axis=1)
        out[~known] = 0  # nobody's script says nothing
        out[known & ~open_.all(axis=1)] -= 1000 * ~open_[known & ~open_.all(axis=1)]
        return out

    def best_path(self, scores: np.ndarray, first_word: np.ndarray) -> np.ndarray:
        """A label per word; all texts advance together, by one word each."""
        n = np.diff(first_word)
        order = np.argsort(-n, kind="stable")
        n, first = n[order], first_word[:-1][order]
        steps = int(n[0]) if len(n) else 0
        active = np.searchsorted(-n, -np.arange(steps), side="left")  # texts with more than t words
        total = np.zeros((len(n), scores.shape[1]), dtype=np.float64)
        came = np.zeros(scores.shape, dtype=np.int16)
        for t in range(steps):
            a = active[t]
            now, row = total[:a], first[:a] + t
            best = now.argmax(axis=1)
            switched = now[np.arange(a), best][:, None] - self.penalty
            came[row] = np.where(now >= switched, -1, best[:, None])
            total[:a] = np.maximum(now, switched) + scores[row]
        labels, label = np.zeros(len(scores), dtype=np.int16), total.argmax(axis=1)
        for t in range(steps - 1, -1, -1):
            a = active[t]
            row = first[:a] + t
            labels[row] = label[:a]
            before = came[row, label[:a]]
            label[:a] = np.where(before < 0, label[:a], before)
        return labels

    def label(self, texts: list[str]) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
        """Language, share of the letters' words in it, and spans (start, end, language) by code points."""
        words = words_of(texts)
        scores = self.scores(words)
        labels = self.best_path(scores, words.first_word).astype(np.int64)
        unknown = ~self.scripts[words.scripts].any(axis=1)
        sizes = words.ends - words.starts
        out = []
        for i, (a, b) in enumerate(zip(words.first_word[:-1].tolist(), words.first_word[1:].tolist())):
            if a == b:
                out.append((UNKNOWN, 0.0, []))
                continue
            own, size = labels[a:b], sizes[a:b]
            if unknown[a:b].all():
                own = np.full(b - a, self.fallback)
            share = np.bincount(own, weights=size, minlength=len(self.langs))
            lang = int(share.argmax())
            cuts = np.concatenate([[0], np.nonzero(np.diff(own))[0] + 1, [b - a]])
            base = words.text_starts[i]
            spans = [
                (int(words.starts[a + x] - base), int(words.ends[a + y - 1] - base), self.langs[own[x]])
                for x, y in zip(cuts[:-1], cuts[1:])
            ]
            out.append((self.langs[lang], float(share[lang] / share.sum()), spans))
        return out


def learn(docs: DataFrame, learned_docs: int = LEARNED_DOCS, penalty: float = SWITCH_PENALTY) -> LanguageModel | None:
    """A model from the rows of docs (text, lang) whose lang is not null; None if there is no letter to learn from.

    Counts are summed on Spark; one row per language, kind and bucket comes to the driver, however many documents.
    """
    # copies of a text are drawn each on its own, so that a language of few texts is learned too
    drawn = F.xxhash64("text", *(["doc_id"] if "doc_id" in docs.columns else []))
    rows = docs.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), drawn.alias("drawn"))
    rows = rows.where("text is not null and lang is not null")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    if not langs:
        return None
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(f"{len(langs)} languages; up to {MOST_LANGUAGES} can be told apart")
    parts = F.create_map(*[F.lit(x) for lang in langs for x in (lang, min(1.0, learned_docs / sizes[lang]))])
    chosen = rows.where(F.pmod("drawn", F.lit(1_000_000)) < parts[F.col("lang")] * 1_000_000).select("text", "lang")

    def count(batches):
        found = {}
        for batch in batches:
            texts, own = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in set(own):
                mine = [t for t, x in zip(texts, own) if x == lang]
                for a, b in slices(mine):
                    words = words_of(mine[a:b])
                    sums = found.setdefault(lang, np.zeros(BUCKETS + len(SCRIPTS), dtype=np.int64))
                    sums[:BUCKETS] += np.bincount(words.buckets, minlength=BUCKETS)
                    sums[BUCKETS:] += np.bincount(
                        words.scripts, weights=words.ends - words.starts, minlength=len(SCRIPTS)
                    ).astype(np.int64)
        for lang, sums in found.items():
            at = np.nonzero(sums)[0]
            yield pa.RecordBatch.from_pydict({"lang": [lang] * len(at), "slot": at.astype(np.int32), "n": sums[at]})

    counts = chosen.mapInArrow(count, "lang string, slot int, n bigint").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    sums = np.zeros((BUCKETS + len(SCRIPTS), len(langs)))
    for row in counts.collect():
        sums[row["slot"], langs.index(row["lang"])] = row["n"]
    per_lang = sums[:BUCKETS].sum(axis=0)
    if not per_lang.any():
        return None
    seen = per_lang > 0
    langs, sums, per_lang = [x for x, s in zip(langs, seen) if s], sums[:, seen], per_lang[seen]
    logs = np.log(sums[:BUCKETS] + 0.5) - np.log(per_lang + 0.5 * BUCKETS)
    scripts = sums[BUCKETS:] >= SCRIPT_SHARE * per_lang
    return LanguageModel(langs, logs.astype(np.float32), scripts, int(per_lang.argmax()), penalty)


_LABELS = "doc_id bigint, lang_pred string, score double, spans array<struct<start: bigint, end: bigint, lang: string>>"


def label(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """doc_id, lang_pred, score and spans of every whole text of docs; the text alone decides. No shuffle."""
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return rows.select("doc_id", _labels(docs, model)("text").alias("_l")).select("doc_id", "_l.*")


def _labels(docs: DataFrame, model: LanguageModel | None):
    held = docs.sparkSession.sparkContext.broadcast(model)  # languages x BUCKETS numbers

    @F.pandas_udf("struct<lang_pred: string, score: double, spans: array<struct<start: bigint, end: bigint, lang: string>>>")
    def labels(texts):
        import pandas as pd

        model, whole, out = held.value, [t or "" for t in texts], []
        if model is None:
            out = [(UNKNOWN, 0.0, [])] * len(whole)
        else:
            for a, b in slices(whole, CHARS_AT_ONCE):
                out.extend(model.label(whole[a:b]))
        frame = pd.DataFrame({"lang_pred": [x[0] for x in out], "score": [x[1] for x in out]})
        frame["spans"] = [[{"start": s, "end": e, "lang": lang} for s, e, lang in x[2]] for x in out]
        return frame

    return labels


def keep_known(docs: DataFrame, model: LanguageModel | None, least_score: float) -> DataFrame:
    """Rows of docs, with all their columns, in a language that was learned, with at least that score."""
    held = docs.select(F.struct("*").alias("row"), _labels(docs, model)(F.col("text").cast("string")).alias("found"))
    return held.where((F.col("found.lang_pred") != UNKNOWN) & (F.col("found.score") >= least_score)).select("row.*")
