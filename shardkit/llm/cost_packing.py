"""Packing of documents into sequences of nearly equal attention cost, without padding.

A piece of n tokens costs `linear` * n + n * n: its share of the layers, and each token's attention
to those of its own piece. Documents longer than a sequence are cut into pieces of nearly equal
length. Then pieces go, longest first, to the sequence of lowest cost that has room for them.

There are as many sequences as the tokens fill: full ones, and for the rest at most one of each
power of two, so that none is padded. Pieces that find no room as a whole are cut to fill what is left,
the longest first, again from the sequence of lowest cost on.

Lengths are whole numbers up to the capacity, so all this is decided on the counts per length: sequences that
hold the same lengths are one entry with a number of copies, and what is decided for a
piece holds for as many pieces of its length as there are copies. The plan covers the whole corpus and its size depends on
lengths, not on rows. Pieces find their places by their number among those of their length; the ids
themselves stay in the tasks that read them.

Defined results: null and empty texts are one piece with the end id alone. Documents with
equal ids, and rows that repeat, are packed each on its own. An empty table gives no
rows. Columns besides doc_id and text are left out.
"""

import heapq
import json
import sys
from array import array
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardkit.llm.bpe_tree import _SPLIT
from shardkit.llm.common import gapless, numbered, stored, task_number, text_slices
from shardkit.llm.encoder import Learned, library_tokenizer, shared

CAPACITY = 2048
END_ID = 1
# Cost of a token besides its attention, in units of one token's attention to one other.
LINEAR = 2048
# Pieces remembered by a worker at most; bounds its memory.
REMEMBERED = 500_000
# Bytes of texts worked on together, at least one text.
BYTES_AT_ONCE = 2_000_000
# Marks that no alternative of the pre-tokenizer's pattern joins to letters, and that run on with each other.
_MARKS = ".,;:!?$%&*"

_PIECES = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, ids binary, part int, local bigint"


class WordIds:
    """Ids of texts by a word vocabulary; pieces between spaces are worked out when first seen."""

    def __init__(self, model: tuple[str, bool]):
        json_text, self.direct = model
        self.library = library_tokenizer(json_text)
        # an attribute of the library's that is a new object each time
        self.tokenize = self.library.model.tokenize
        self.known = Learned(self._learn, REMEMBERED)

    def _learn(self, piece: str) -> bytes:
        word = piece.rstrip(_MARKS)
        if not self.direct or not (word.isascii() and word.isalpha()):
            return array("I", self.library.encode(piece, add_special_tokens=False).ids).tobytes()
        low = word.lower()
        if low == piece:
            # one pre-token, spelled by its own letters: the library's model is asked directly
            return array("I", [t.id for t in self.tokenize(low)]).tobytes()
        return self.known[low] + self.known[piece[len(word) :]]

    def ids(self, text: str) -> list[bytes]:
        return list(map(self.known.__getitem__, text.replace("\n", " ").split(" ")))


def word_model(path: str) -> tuple[str, bool]:
    """A tokenizer file and whether its words can be asked for directly, which tasks need not work out again."""
    with open(path, encoding="utf-8") as file:
        text = file.read()
    return text, lower_cases_words(json.loads(text))


def lower_cases_words(config: dict) -> bool:
    """Whether a run of letters in ASCII is one pre-token, in lower case, and so are the marks behind it."""
    steps = lambda part, name: (config[part] or {}).get(name) or []
    parts = steps("pre_tokenizer", "pretokenizers")
    return (
        sys.byteorder == "little"
        and [n["type"] for n in steps("normalizer", "normalizers")] == ["NFC", "Replace", "Lowercase"]
        and [p.get("pattern", {}).get("Regex") for p in parts] == [_SPLIT, None]
        and parts[1]["type"] == "ByteLevel"
        and not parts[1]["add_prefix_space"]
        and not parts[1]["use_regex"]
        and not config["model"].get("dropout")
    )


def cut_evenly(tokens: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length) of pieces of at most `capacity`, of nearly equal length within a document."""
    parts = -(-tokens // capacity)
    doc = np.repeat(np.arange(len(tokens)), parts)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)
    base, longer = (tokens // parts)[doc], (tokens % parts)[doc]
    return doc, number * base + np.minimum(number, longer), base + (number < longer)


def cut_into_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Whole texts as pieces of at most `capacity` ids, numbered by length within each task (`part`, `local`)."""
    # a vocabulary, whose size the data do not change
    model = docs.sparkSession.sparkContext.broadcast(word_model(tokenizer_path))
    end = int(end_id).to_bytes(4, "little")

    def cut(batches):
        encoder, part, seen = shared(WordIds, model.value), task_number(), np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            for a, b in text_slices(batch.column(1), BYTES_AT_ONCE):
                rows = []
                for text in batch.column(1).slice(a, b - a).to_pylist():
                    found = encoder.ids(text or "")
                    found.append(end)
                    rows.append(b"".join(found))
                tokens = np.array([len(x) // 4 for x in rows], dtype=np.int64)
                doc, start, length = cut_evenly(tokens, capacity)
                ends = np.concatenate([[0], np.cumsum(4 * length)]).astype(np.int32)
                # pieces lie one behind the other, as the documents do
                ids = pa.BinaryArray.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(ends), pa.py_buffer(b"".join(rows))])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a).take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(tokens[doc]),
                        ids, pa.array(np.full(len(length), part, dtype=np.int32)), pa.array(numbered(length, seen)),
                    ],
                    names=["doc_id", "start", "length", "doc_tokens", "ids", "part", "local"],
                )

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return rows.mapInArrow(cut, _PIECES)


def cost(length, linear: int = LINEAR):
    """Estimated cost of a piece; also of a column."""
    return length * linear + length * length


class Plan:
    """Which sequences the pieces of each length go to, from their counts."""

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY, linear: int = LINEAR):
        self.linear = linear
        total = sum(length * n for length, n in counts.items())
        # sequences of one kind: (cost, -room, first number, copies, size)
        self.open, self.full = [], defaultdict(list)
        self.rows = []  # piece length, first piece, pieces, ids of the piece before, length, first sequence, offset, step
        full, rest = divmod(total, capacity)
        number = 0
        for size, copies in [(capacity, full), *[(1 << k, rest >> k & 1) for k in range(capacity.bit_length() - 1, -1, -1)]]:
            if copies:
                self.open.append((0, -size, number, copies, size))
                number += copies
        heapq.heapify(self.open)
        left = []
        for length in sorted(counts, reverse=True):
            for room in [r for r in self.full if r >= length]:
                for kind in self.full.pop(room):
                    heapq.heappush(self.open, kind)
            first = self._place(length, 0, counts[length])
            if first < counts[length]:
                left.append((-length, length, first, counts[length] - first, 0, 0))
        self.whole_rows = len(self.rows)
        for kinds in self.full.values():
            self.open += kinds
        heapq.heapify(self.open)
        heapq.heapify(left)
        while left:
            _, piece, first, n, before, step = heapq.heappop(left)
            kind = self.open[0]
            m, take = min(n, kind[3]), min(piece - before, -kind[1])
            self._fill(piece, first, m, before, take, step)
            if take < piece - before:
                heapq.heappush(left, (before + take - piece, piece, first, m, before + take, step + 1))
            if m < n:
                heapq.heappush(left, (before - piece, piece, first + m, n - m, before, step))
        self.layers = self._layers()

    def _place(self, length: int, first: int, n: int) -> int:
        """Whole pieces to the sequences of lowest cost that have room; the number of the first that finds none."""
        while first < n and self.open:
            if -self.open[0][1] < length:
                kind = heapq.heappop(self.open)
                self.full[-kind[1]].append(kind)
                continue
            m = min(n - first, self.open[0][3])
            self._fill(length, first, m, 0, length, 0)
            first += m
        return first

    def _fill(self, piece: int, first: int, m: int, before: int, take: int, step: int) -> None:
        """`take` ids of m pieces go to as many sequences of the kind of lowest cost."""
        spent, room, number, copies, size = heapq.heappop(self.open)
        if m < copies:
            heapq.heappush(self.open, (spent, room, number + m, copies - m, size))
        self.rows.append((piece, first, m, before, take, number, size + room, step))
        if -room > take:
            heapq.heappush(self.open, (spent + cost(take, self.linear), room + take, number, m, size))

    def _layers(self) -> list[tuple[np.ndarray, ...]]:
        """Per step of cutting, sorted: key of the first piece, pieces, ids before, length, first sequence, offset."""
        if not self.rows:
            return []
        rows = np.array(self.rows, dtype=np.int64)
        out = []
        for step in range(int(rows[:, 7].max()) + 1):
            own = rows[rows[:, 7] == step]
            own = own[np.lexsort((own[:, 1], own[:, 0]))]
            out.append(((own[:, 0] << 48) + own[:, 1], *own[:, 2:7].T.copy()))
        return out


def places(layers: list[tuple[np.ndarray, ...]], length: np.ndarray, number: np.ndarray):
    """(row, ids before, length, sequence, offset) of all parts of pieces, by row and place in it."""
    found = []
    key = (length << 48) + number
    for keys, pieces, before, take, sequence, offset in layers:
        i = np.maximum(np.searchsorted(keys, key, side="right") - 1, 0)
        by = key - keys[i]
        row = np.flatnonzero((by >= 0) & (by < pieces[i]))
        i, by = i[row], by[row]
        found.append((row, before[i], take[i], sequence[i] + by, offset[i]))
    row, *rest = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((rest[0], row))
    return row[order], *[x[order] for x in rest]


def pack(pieces: DataFrame, capacity: int = CAPACITY, linear: int = LINEAR) -> DataFrame:
    """Places of a stored table of pieces; the ids cross no exchange while one row per task can be broadcast.

    The counts per length come to the driver: at most `capacity` rows, whatever the input.
    """
    spark = pieces.sparkSession
    total = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    layers = spark.sparkContext.broadcast(Plan(total, capacity, linear).layers)

    @F.arrow_udf("array<struct<before: bigint, length: bigint, sequence_id: bigint, offset: bigint>>")
    def place(length: pa.Array, number: pa.Array) -> pa.Array:
        row, *columns = places(layers.value, length.to_numpy(), number.to_numpy())
        offsets = np.searchsorted(row, np.arange(len(length) + 1)).astype(np.int32)
        fields = pa.StructArray.from_arrays([pa.array(x) for x in columns], ["before", "length", "sequence_id", "offset"])
        return pa.ListArray.from_arrays(pa.array(offsets), fields)

    found = gapless(pieces, "length", capacity, "_number")
    found = found.select("doc_id", "start", "doc_tokens", "ids", F.explode(place("length", "_number")).alias("at"))
    # a part of the piece's ids: substring counts bytes, from 1
    own = F.substring("ids", (F.col("at.before") * 4 + 1).cast("int"), (F.col("at.length") * 4).cast("int"))
    return found.select(
        "doc_id", (F.col("start") + F.col("at.before")).alias("start"), F.col("at.length").alias("length"), own.alias("ids"),
        "doc_tokens", F.col("at.sequence_id").alias("sequence_id"), F.col("at.offset").alias("offset"),
    )


def pack_documents(
    docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, linear: int = LINEAR
) -> DataFrame:
    """doc_id, start, length, ids (unsigned 32-bit), doc_tokens, sequence_id, offset of every piece of docs.

    `capacity` is a power of two.
    """
    if capacity & (capacity - 1):
        raise ValueError(f"not a power of two: {capacity}")
    return pack(stored(cut_into_pieces(docs, tokenizer_path, capacity, end_id), "pieces"), capacity, linear)
