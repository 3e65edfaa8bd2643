"""Token ids of whole texts by the tokenizers library, with repeated pieces of text remembered.

A text is cut before a space or line feed that stands between two characters that
are no white space. No pre-tokenizer pattern used here matches across such a place,
so the ids of the parts, in a row, are the ids of the text. Texts in which white
space follows white space go to the library as they are.
"""

import json
import os
import re
import sys
from array import array
from functools import lru_cache

import numpy as np
from pyspark.sql import SparkSession

# Pieces remembered by a worker at most; bounds its memory.
REMEMBERED = 900_000
# Longer pieces are not remembered.
LONGEST_REMEMBERED = 48
_TWO_SPACES = re.compile(r"\s\s")


def tokenizer_text(spark: SparkSession, path: str):
    """The tokenizer file at `path`, broadcast to the tasks: a vocabulary, whose size the data do not change."""
    with open(path, encoding="utf-8") as file:
        return spark.sparkContext.broadcast(file.read())


def library_tokenizer(json_text: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks already run side by side
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_str(json_text)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


# Latin letters, which no version of Unicode classes otherwise; marks that no alternative of the pattern joins to letters.
_WORD = re.compile("(\n?)( ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([.,;:!?]*)")
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if it prints, else one from 256 on."""
    prints = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + i) for i, b in enumerate(others)}


class Remembered:
    """Results by text. When full, those not asked for lately are forgotten."""

    def __init__(self, most: int = REMEMBERED):
        self.half, self.now, self.before = most // 2, {}, {}

    def missing(self, texts: set[str]) -> set[str]:
        """Those of texts that are not known; the others are, in `now`, until the next call."""
        if len(self.now) > self.half:
            self.now, self.before = {}, self.now
        # asked text by text: set operations with a dictionary would walk through all of it
        new = {text for text in texts if text not in self.now}
        for text in [text for text in new if text in self.before]:
            self.now[text] = self.before[text]
            new.discard(text)
        return new


@lru_cache(maxsize=2)
def shared(kind: type, json_text: str):
    """A worker's encoder of that kind, for all its tasks, with what it remembers."""
    return kind(json_text)


class Learned(dict):
    """Results by text, worked out when first asked for. When full, those not asked for lately are forgotten."""

    def __init__(self, learn, most: int = REMEMBERED):
        super().__init__()
        self.learn, self.half, self.before = learn, most // 2, {}

    def __missing__(self, text: str):
        found = self.before.get(text)
        if found is None:
            found = self.learn(text)
        if len(self) > self.half:
            self.before = dict(self)
            self.clear()
        if len(text) <= LONGEST_REMEMBERED:
            self[text] = found
        return found


class Encoder:
    """ids(texts) as little-endian unsigned 32-bit integers, one bytes object per text.

    A word of Latin letters, with or without a space before it, is one pre-token of a byte-level tokenizer, and so
    are the marks behind it: the library's model is asked for these directly.
    """

    def __init__(self, json_text: str):
        self.tokenizer = library_tokenizer(json_text)
        # an attribute of the library's that is a new object each time
        self.tokenize = self.tokenizer.model.tokenize
        self.known = Learned(self._learn)
        config, self.letters = json.loads(json_text), byte_letters()
        before = config["pre_tokenizer"] or {}
        self.direct = (
            config["normalizer"] is None
            and {k: before.get(k) for k in _BYTE_LEVEL} == _BYTE_LEVEL
            and not config["model"].get("dropout")
            and not any(_WORD.search(part) for t in config["added_tokens"] for part in [t["content"][:1], t["content"][-1:]])
        )

    def _encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn(self, piece: str) -> bytes:
        found = _WORD.fullmatch(piece) if self.direct else None
        if found is None:
            return self._encode(piece)
        line, word, marks = found.groups()
        if line or marks:
            return b"".join([self.known[x] for x in (line, word, marks) if x])
        # of the characters of such a word in ASCII, only the space is spelled by another
        spelled = (
            word.replace(" ", self.letters[32]) if word.isascii()
            else word.encode("utf-8").decode("latin-1").translate(self.letters)
        )
        ids = array("I", [t.id for t in self.tokenize(spelled)])
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def ids(self, texts: list[str]) -> list[bytes]:
        out = []
        for text in texts:
            if "\0" in text or _TWO_SPACES.search(text):
                out.append(self._encode(text))
                continue
            pieces = text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")
            out.append(b"".join(map(self.known.__getitem__, pieces)))
        return out


def slices(texts: list[str], most_chars: int = 2_000_000):
    """Index ranges of consecutive texts of about most_chars characters."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= most_chars:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
