"""Best-two-fit packing of documents into sequences of at most so many tokens.

Sequences are filled one after the other: the longest piece that is left, then the longest that
fits, and so on. Then the smallest piece of the sequence gives way to two unpacked
pieces if they fill its place and the gap more tightly. As lengths are whole numbers up to the
capacity, all this is decided on the counts per length, of which there are at most
`capacity`: a filling that is decided once holds for as many sequences as there are
pieces for. So the plan covers all pieces of the corpus at once, however many,
and pieces find their place by their number among the pieces of their length.

Defined results: null and empty texts are one piece with the end id alone. Documents with
equal ids, and rows that repeat, are packed each on its own. An empty table gives no
rows. Columns besides doc_id and text are left out.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardkit.llm.common import gapless, numbered, stored, task_number, text_slices
from shardkit.llm.encoder import Encoder, shared, tokenizer_text

CAPACITY = 1024
END_ID = 2

# Bytes of texts worked on together, at least one text.
BYTES_AT_ONCE = 2_000_000

_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids binary, part int, local bigint"


def cut_into_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Whole texts as pieces of at most `capacity` ids; of longer documents the first piece may be shorter.

    Also numbers the pieces of equal length within each task (`part`, `local`).
    """
    model = tokenizer_text(docs.sparkSession, tokenizer_path)
    end = int(end_id).to_bytes(4, "little")

    def cut(batches):
        encoder, part, seen = shared(Encoder, model.value), task_number(), np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            for a, b in text_slices(batch.column(1), BYTES_AT_ONCE):
                rows = encoder.ids([t or "" for t in batch.column(1).slice(a, b - a).to_pylist()])
                tokens = np.array([len(x) // 4 + 1 for x in rows], dtype=np.int64)
                pieces = -(-tokens // capacity)
                doc = np.repeat(np.arange(len(rows)), pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                first = ((tokens - 1) % capacity + 1)[doc]
                length = np.where(piece == 0, first, capacity)
                start = np.where(piece == 0, 0, first + (piece - 1) * capacity)
                # pieces lie one behind the other, as the documents do
                ends = np.concatenate([[0], np.cumsum(4 * length)]).astype(np.int32)
                ids = pa.BinaryArray.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(ends), pa.py_buffer(end.join([*rows, b""]))])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length),
                        ids, pa.array(np.full(len(doc), part, dtype=np.int32)), pa.array(numbered(length, seen)),
                    ],
                    names=["doc_id", "piece", "start", "length", "ids", "part", "local"],
                )

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    return rows.mapInArrow(cut, _PIECES)


def fillings(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of the pieces in a sequence, number of such sequences), from the counts per length."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] += n
    out = []
    while left.any():
        chosen, gap = [], capacity
        while gap:
            fitting = np.nonzero(left[: gap + 1])[0]
            if not len(fitting):
                break
            chosen.append(int(fitting[-1]))
            left[chosen[-1]] -= 1
            gap -= chosen[-1]
        if gap and (pair := _two_for(left, gap + chosen[-1], chosen[-1])):
            left[chosen.pop()] += 1
            chosen += pair
            for length in pair:
                left[length] -= 1
        # as many more of the same as there are pieces for
        kinds, need = np.unique(chosen, return_counts=True)
        more = int((left[kinds] // need).min())
        left[kinds] -= more * need
        out.append((tuple(chosen), more + 1))
    return out


def _two_for(left: np.ndarray, room: int, smallest: int) -> list[int] | None:
    """The two lengths at hand with the largest sum up to `room`, if it is more than `smallest`."""
    at_hand = np.nonzero(left[: room + 1])[0]
    at_hand = at_hand[at_hand > 0]
    if not len(at_hand):
        return None
    partner = np.searchsorted(at_hand, room - at_hand, side="right") - 1
    a, b = at_hand, at_hand[np.maximum(partner, 0)]
    fine = (partner >= 0) & (a <= room) & ((a != b) | (left[a] > 1))
    # where only one piece of a length is at hand, the next shorter one is its partner
    lone = (partner > 0) & (a == b) & (left[a] == 1)
    b = np.where(lone, at_hand[np.maximum(partner - 1, 0)], b)
    fine |= lone
    total = np.where(fine, a + b, -1)
    best = int(total.argmax())
    return [int(max(a[best], b[best])), int(min(a[best], b[best]))] if total[best] > smallest else None


def places(plan: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, ...]:
    """Sorted by length and number: from which number on the pieces of a length go to which sequences, and at which offset."""
    next_number, rows, sequence = {}, [], 0
    for lengths, times in plan:
        offset = 0
        for length in lengths:
            number = next_number.get(length, 0)
            rows.append(((length << 48) + number, sequence, offset))
            next_number[length] = number + times
            offset += length
        sequence += times
    return tuple(np.array(x, dtype=np.int64) for x in zip(*sorted(rows)))


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to a stored table of pieces (length, part, local).

    The counts per length come to the driver: at most `capacity` rows, whatever the
    input. The places they give are at most some thousand intervals.
    """
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    where = pieces.sparkSession.sparkContext.broadcast(places(fillings(counts, capacity)))

    @F.arrow_udf("struct<sequence_id: bigint, offset: bigint>")
    def place(length: pa.Array, number: pa.Array) -> pa.Array:
        starts, to, at = where.value
        key = (length.to_numpy() << 48) + number.to_numpy()
        i = np.searchsorted(starts, key, side="right") - 1
        return pa.StructArray.from_arrays([pa.array(to[i] + key - starts[i]), pa.array(at[i])], ["sequence_id", "offset"])

    placed = gapless(pieces, "length", capacity, "_number").withColumn("_place", place("length", "_number"))
    placed = placed.withColumn("sequence_id", F.col("_place.sequence_id")).withColumn("offset", F.col("_place.offset"))
    return placed.drop("_place", "_number", "part", "local")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids (unsigned 32-bit), sequence_id, offset of every piece of docs."""
    return pack(stored(cut_into_pieces(docs, tokenizer_path, capacity, end_id), "pieces"), capacity)
