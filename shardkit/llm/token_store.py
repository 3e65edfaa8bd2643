"""Token ids in shards with a minimal perfect hash index from document keys to shard offsets.

A store is a folder of Parquet files whose rows are shards: a run of consecutive
documents in ascending key order, with their ids in a row as one raw payload (two bytes
an id where they fit, else four). Beside it lies the shard's index: levels of bit
maps that send each key to a slot of its own without gaps, and for each slot a
fingerprint of the key, its first document and how many documents carry the key.
A key is found in constant time, and an unknown one is told by its fingerprint.

Defined results: null and empty texts are documents with the end id alone. Documents
with a null key come first and are found by scans only. Repeated keys stay separate
documents, in the order of a hash of their texts; a lookup returns all of them. An
empty table gives a store without shards. Columns besides key and text are left out.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardkit.limits import MAX_BROADCAST_ROWS, broadcast_within, fits
from shardkit.llm.common import task_number
from shardkit.llm.encoder import Encoder, shared, slices, tokenizer_text
from shardkit.session import settle

END_ID = 2
# Ids after which a shard is closed.
SHARD_IDS = 1 << 19

_FIELDS = [
    ("part", pa.int32()), ("shard", pa.int32()), ("first_key", pa.int64()), ("last_key", pa.int64()),
    ("n_docs", pa.int64()), ("n_null", pa.int64()), ("n_ids", pa.int64()), ("before", pa.int64()),
    ("level_bits", pa.list_(pa.int64())), ("levels", pa.binary()), ("fingerprints", pa.binary()),
    ("first_doc", pa.binary()), ("same_key", pa.binary()), ("ends", pa.binary()), ("keys", pa.binary()),
    ("width", pa.int32()), ("payload", pa.binary()),
]
_STORE = (
    "part int, shard int, first_key bigint, last_key bigint, n_docs bigint, n_null bigint, n_ids bigint, before bigint, "
    "level_bits array<bigint>, levels binary, fingerprints binary, first_doc binary, same_key binary, ends binary, "
    "keys binary, width int, payload binary"
)
_DOCS = "doc_id bigint, start bigint, n_tokens bigint, ids binary"


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """64 well mixed bits of each key, other ones for each seed."""
    x = keys + np.uint64(((seed + 1) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class KeyIndex:
    """A minimal perfect hash of distinct 64-bit keys, by levels of bit maps.

    On each level the keys that meet no other one set their bit; the rest go to the next
    level. A key's slot is the number of bits before its own.
    """

    FINGERPRINT = 1 << 20  # the seed of fingerprints; no level comes near it

    def __init__(self, maps: list[np.ndarray], fingerprints: np.ndarray):
        self.maps, self.fingerprints = maps, fingerprints
        self.ranks = [np.cumsum(m) - 1 for m in maps]
        self.bases = np.cumsum([0] + [int(m.sum()) for m in maps])

    @classmethod
    def of(cls, keys: np.ndarray) -> "KeyIndex":
        rest, maps = keys.astype(np.uint64), []
        while len(rest):
            size = 64 * (len(rest) // 40 + 1)
            at = (_mixed(rest, len(maps)) % np.uint64(size)).astype(np.int64)
            met = np.bincount(at, minlength=size)
            maps.append(met == 1)
            rest = rest[met[at] > 1]
        index = cls(maps, np.zeros(len(keys), dtype="<u4"))
        index.fingerprints[index._slots(keys)] = cls.mark(keys)
        return index

    @classmethod
    def mark(cls, keys: np.ndarray) -> np.ndarray:
        return (_mixed(keys.astype(np.uint64), cls.FINGERPRINT) >> np.uint64(32)).astype("<u4")

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        keys, slots = keys.astype(np.uint64), np.full(len(keys), -1, dtype=np.int64)
        for level, bits in enumerate(self.maps):
            open_ = np.nonzero(slots < 0)[0]
            if not len(open_):
                break
            at = (_mixed(keys[open_], level) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            slots[open_[hit]] = self.bases[level] + self.ranks[level][at[hit]]
        return slots

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slots, -1 for keys whose fingerprint differs from the stored one."""
        slots = self._slots(keys)
        known = slots >= 0
        known[known] = self.fingerprints[slots[known]] == self.mark(keys[known])
        return np.where(known, slots, -1)

    def stored(self) -> dict:
        bits = [np.packbits(m) for m in self.maps]
        return {
            "level_bits": [len(m) for m in self.maps],
            "levels": b"".join(b.tobytes() for b in bits),
            "fingerprints": self.fingerprints.tobytes(),
        }

    @classmethod
    def read(cls, row: dict) -> "KeyIndex":
        maps, at = [], 0
        raw = np.frombuffer(row["levels"], dtype=np.uint8)
        for size in row["level_bits"]:
            maps.append(np.unpackbits(raw[at : at + size // 8]).astype(bool))
            at += size // 8
        return cls(maps, np.frombuffer(row["fingerprints"], dtype="<u4"))


def _shard(part: int, number: int, before: int, keys: list, payloads: list[bytes]) -> dict:
    lengths = np.array([len(p) // 4 for p in payloads], dtype=np.int64)
    n_null = sum(k is None for k in keys)
    known = np.array(keys[n_null:], dtype="<i8")
    distinct, first, same = np.unique(known, return_index=True, return_counts=True)
    index = KeyIndex.of(distinct)
    slots = index.find(distinct)
    first_doc, same_key = np.zeros(len(distinct), dtype="<u4"), np.zeros(len(distinct), dtype="<u4")
    first_doc[slots], same_key[slots] = first + n_null, same
    ids = np.frombuffer(b"".join(payloads), dtype="<u4")
    width = 2 if not len(ids) or ids.max() < 1 << 16 else 4
    return index.stored() | {
        "part": part, "shard": number, "n_docs": len(keys), "n_null": n_null, "n_ids": len(ids), "before": before,
        "first_key": int(known[0]) if len(known) else None, "last_key": int(known[-1]) if len(known) else None,
        "first_doc": first_doc.tobytes(), "same_key": same_key.tobytes(),
        "ends": np.cumsum(lengths).astype("<i8").tobytes(), "keys": known.tobytes(),
        "width": width, "payload": ids.astype(f"<u{width}").tobytes(),
    }


def write_store(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID, shard_ids: int = SHARD_IDS):
    """Encodes the whole texts of docs (doc_id, text) and writes them to a new store at `path`.

    One shuffle, by ranges of keys; a task closes a shard whenever it is full, so it
    holds one shard and one batch of texts at a time.
    """
    model = tokenizer_text(docs.sparkSession, tokenizer_path)
    end = int(end_id).to_bytes(4, "little")

    def encode(batches):
        encoder, part = shared(Encoder, model.value), task_number()
        keys, payloads, size, number, before = [], [], 0, 0, 0

        def close():
            nonlocal keys, payloads, size, number, before
            row = _shard(part, number, before, keys, payloads)
            before, number = before + row["n_ids"], number + 1
            keys, payloads, size = [], [], 0
            return pa.RecordBatch.from_pylist([row], schema=pa.schema(_FIELDS))

        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in slices(texts):
                for key, ids in zip(doc_ids[a:b], encoder.ids(texts[a:b])):
                    keys.append(key)
                    payloads.append(ids + end)
                    size += len(ids) // 4 + 1
                    if size >= shard_ids:
                        yield close()
        if keys:
            yield close()

    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    # rows of one id, or without one, go to several tasks by their texts
    rows = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    rows = rows.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    rows.mapInArrow(encode, _STORE).write.option("compression", "zstd").parquet(path)


def _with_starts(spark: SparkSession, path: str) -> DataFrame:
    """Shards with `base`: the ids of all shards of earlier parts. One row per part comes to the driver."""
    shards = spark.read.schema(_STORE).parquet(path)
    sizes = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()
    bases, total = [], 0
    for row in sorted(sizes):
        bases.append((row["part"], total))
        total += row["n"]
    starts = spark.createDataFrame(bases, "part int, base bigint")
    return shards.join(F.broadcast(starts), "part")


def _documents(row: dict, wanted: np.ndarray | None) -> dict:
    """The documents of a shard whose keys are wanted (None: all), found through its index."""
    ends = np.frombuffer(row["ends"], dtype="<i8")
    keys, n_null = np.frombuffer(row["keys"], dtype="<i8"), row["n_null"]
    index = KeyIndex.read(row)
    first, same = np.frombuffer(row["first_doc"], dtype="<u4"), np.frombuffer(row["same_key"], dtype="<u4")
    asked = np.unique(keys) if wanted is None else wanted
    slots = index.find(asked)
    at = [] if wanted is not None else [(None, i) for i in range(n_null)]
    for key, slot in zip(asked.tolist(), slots.tolist()):
        if slot >= 0:
            at.extend((key, int(first[slot]) + i) for i in range(int(same[slot])))
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    width = row["width"]
    payload = memoryview(row["payload"])
    out = {"doc_id": [], "start": [], "n_tokens": [], "ids": []}
    for key, i in at:
        a, b = int(starts[i]), int(ends[i])
        out["doc_id"].append(key)
        out["start"].append(row["base"] + row["before"] + a)
        out["n_tokens"].append(b - a)
        out["ids"].append(np.frombuffer(payload[a * width : b * width], dtype=f"<u{width}").astype("<u4").tobytes())
    return out


_DOC_FIELDS = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())]


def _read(shards: DataFrame, wanted=None) -> DataFrame:
    def read(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                asked = None
                if wanted is not None:
                    asked = wanted.value
                    if row["first_key"] is None:
                        continue
                    asked = asked[(asked >= row["first_key"]) & (asked <= row["last_key"])]
                yield pa.RecordBatch.from_pydict(_documents(row, asked), schema=pa.schema(_DOC_FIELDS))

    return shards.mapInArrow(read, _DOCS)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids (unsigned 32-bit) of all documents; no shuffle."""
    return _read(_with_starts(spark, path))


def lookup(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """The same for the documents whose keys are in `keys` (doc_id); unknown keys give nothing.

    Up to MAX_BROADCAST_ROWS keys, counted first, are compared with the shards' ranges of keys, and only
    shards whose range holds one are read and answer from their index. More keys are joined with a scan.
    """
    keys = keys.select(F.col("doc_id").cast("bigint").alias("doc_id")).where("doc_id is not null").distinct()
    if not fits(keys, MAX_BROADCAST_ROWS):
        return read_store(spark, path).join(keys, "doc_id", "left_semi")
    asked = np.array(sorted(r[0] for r in keys.collect()), dtype="<i8")
    held = spark.sparkContext.broadcast(asked)

    @F.arrow_udf("boolean")
    def has_one(first: pa.Array, last: pa.Array) -> pa.Array:
        a = np.searchsorted(held.value, first.fill_null(1).to_numpy(), side="left")
        b = np.searchsorted(held.value, last.fill_null(0).to_numpy(), side="right")
        return pa.array(a < b)

    # two small columns tell which shards are wanted; their numbers select the others' rows
    ranges = spark.read.schema(_STORE).parquet(path).select("part", "shard", "first_key", "last_key")
    wanted = settle(ranges.where(has_one("first_key", "last_key")).select("part", "shard"))
    return _read(_with_starts(spark, path).join(broadcast_within(wanted), ["part", "shard"], "left_semi"), held)
