"""Nearest vectors by multi-index hashing of learned binary codes.

A rotation learned on a bounded sample turns a vector into 64 bits, the signs of its rotated
components. Codes are split into eight substrings of eight bits, each with an index of its own. If
two codes differ in at most R bits, one of their substrings differs in at most R/8: so probing, in each
index, all values that near to the query's retrieves every code within radius R. Those are
reranked by cosine in double precision.

R is learned too: the distance in bits within which the sample's own nearest neighbours
lie (by brute force over the sample). Neighbours among all rows are nearer than in the sample, so
that R finds them as well or better. Where fewer than k codes lie within R, a block's radius grows
until there are k, or all.

The index is a stored table of blocks: ids, vectors, codes, and for each substring the rows by value. Vectors of each
length have blocks and codes of their own. Queries are gathered by the thousand, and each such set meets each block of its length once;
a block returns k rows per query, and the best k of all blocks stay.

Defined results: vectors that are null, empty, zero, with null or non-finite components, or without an
id take no part. Vectors of different lengths have no cosine: a query's candidates are those of its own length. Rows that repeat an id are candidates of
their own, also for each other. Ties go to the smaller vec_id. With fewer candidates than k all
are returned. Columns besides vec_id and embedding are left out.
"""

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shardkit.llm.common import stored, task_number
from shardkit.llm.embedding_lsh import usable

# Vectors that the rotation and the radius are learned on, at most.
SAMPLE = 8_192
# Of the sample's nearest neighbours, the part that must lie within the radius.
COVERED = 0.995
ROUNDS = 30
BITS, PARTS = 64, 8
BLOCK = 8_192
# Queries that meet a block together.
QUERIES = 4_096
SEED = 7

_VALUES = np.arange(256, dtype=np.uint8)
_APART = np.bitwise_count(_VALUES[:, None] ^ _VALUES[None, :])


class Codes:
    """The learned rotation: mean, projection to BITS dimensions, and the radius."""

    def __init__(self, mean, projection, radius):
        self.mean, self.projection, self.radius = mean, projection, radius

    def of(self, x: np.ndarray) -> np.ndarray:
        """Codes as rows of PARTS bytes."""
        unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
        return np.packbits((unit - self.mean) @ self.projection > 0, axis=1)

    @classmethod
    def learned(cls, sample: np.ndarray, k: int) -> "Codes":
        """Principal directions, then rotations that bring components near their signs, by turns."""
        rng = np.random.default_rng(SEED)
        unit = sample / np.sqrt((sample * sample).sum(axis=1, keepdims=True))
        mean = unit.mean(axis=0)
        centred, d = unit - mean, unit.shape[1]
        _, axes = np.linalg.eigh(centred.T @ centred)
        axes = axes[:, ::-1][:, :BITS]
        if d < BITS:  # more bits than dimensions: random directions for the rest
            axes = np.hstack([axes, rng.standard_normal((d, BITS - d)) / np.sqrt(d)])
        flat = centred @ axes
        rotation, _ = np.linalg.qr(rng.standard_normal((BITS, BITS)))
        for _ in range(ROUNDS):
            signs = np.where(flat @ rotation > 0, 1.0, -1.0)
            a, _, b = np.linalg.svd(signs.T @ flat)
            rotation = (a @ b).T
        codes = cls(mean, axes @ rotation, BITS)
        bits = codes.of(sample)
        apart = []
        for i in range(0, len(unit), 512):
            near = unit[i : i + 512] @ unit.T
            near[np.arange(len(near)), np.arange(i, i + len(near))] = -2
            top = np.argsort(-near, axis=1)[:, : min(k, len(unit) - 1)]
            apart.append(np.bitwise_count(bits[i : i + 512, None, :] ^ bits[top]).sum(axis=2).ravel())
        apart = np.concatenate(apart) if apart else np.zeros(0)
        codes.radius = int(np.quantile(apart, COVERED, method="higher")) if len(apart) else BITS
        return codes


_INDEX = "size int, block int, n int, ids binary, vectors binary, codes binary, by_value binary, offsets binary"


def build(vectors: DataFrame, k: int, sample: int = SAMPLE, block: int = BLOCK) -> tuple[DataFrame, dict[int, Codes]]:
    """The stored index over all usable rows of vectors, and the codes of each length."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where(usable("embedding") & F.col("vec_id").isNotNull())
    # lengths that a table has, a few
    sizes = {r["size"]: r["count"] for r in rows.groupBy(F.size("embedding").alias("size")).count().collect()}
    codes = {}
    for size in sorted(sizes):
        own = rows.where(F.size("embedding") == size)
        chosen = own.orderBy(F.xxhash64("vec_id", "embedding")).limit(sample).select("embedding").toArrow()
        codes[size] = Codes.learned(np.array(chosen["embedding"].to_pylist(), dtype=np.float64), k)
    held = spark.sparkContext.broadcast(codes)

    def index(batches):
        ids, parts = [], []
        for batch in batches:
            ids.append(batch.column(0).to_numpy())
            parts.append(np.array(batch.column(1).to_pylist(), dtype=np.float64))
        if not ids:
            return
        ids, x = np.concatenate(ids), np.concatenate(parts)
        bits = held.value[x.shape[1]].of(x)
        order = [np.argsort(bits[:, j], kind="stable").astype("<u4") for j in range(PARTS)]
        offsets = [np.searchsorted(bits[o, j], np.arange(257)).astype("<u4") for j, o in enumerate(order)]
        yield pa.RecordBatch.from_pylist(
            [{
                "size": x.shape[1], "block": task_number(), "n": len(ids), "ids": ids.astype("<i8").tobytes(),
                "vectors": x.astype("<f8").tobytes(), "codes": bits.tobytes(), "by_value": np.stack(order).tobytes(),
                "offsets": np.stack(offsets).tobytes(),
            }],
            schema=pa.schema([(c, pa.int32()) for c in ("size", "block", "n")] + [(c, pa.binary()) for c in ("ids", "vectors", "codes", "by_value", "offsets")]),
        )

    # dealt out evenly, a block per task
    parts = [
        rows.where(F.size("embedding") == size).repartition(max(1, -(-n // block))).mapInArrow(index, _INDEX) for size, n in sorted(sizes.items())
    ]
    empty = spark.createDataFrame([], _INDEX)
    return stored(reduce(DataFrame.unionByName, parts, empty), "hamming-index"), codes


class Block:
    """One block of the index, read."""

    def __init__(self, row: dict):
        n = row["n"]
        self.ids = np.frombuffer(row["ids"], dtype="<i8")
        self.vectors = np.frombuffer(row["vectors"], dtype="<f8").reshape(n, -1)
        self.codes = np.frombuffer(row["codes"], dtype=np.uint8).reshape(n, PARTS)
        self.by_value = np.frombuffer(row["by_value"], dtype="<u4").reshape(PARTS, n)
        self.offsets = np.frombuffer(row["offsets"], dtype="<u4").reshape(PARTS, 257)
        self.norms = np.sqrt((self.vectors * self.vectors).sum(axis=1))
        self.words = np.ascontiguousarray(self.codes).view(np.uint64)[:, 0]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Rows whose codes differ in at most `radius` bits, all of them."""
        seen = np.zeros(len(self.ids), dtype=bool)
        for part in range(PARTS):
            near = np.nonzero(_APART[code[part]] <= radius // PARTS)[0]
            first, last = self.offsets[part, near], self.offsets[part, near + 1]
            rows = self.by_value[part]
            for a, b in zip(first.tolist(), last.tolist()):
                seen[rows[a:b]] = True
        rows = np.nonzero(seen)[0]
        word = np.ascontiguousarray(code).view(np.uint64)[0]
        return rows[np.bitwise_count(self.words[rows] ^ word) <= radius]

    def nearest(self, vector: np.ndarray, code: np.ndarray, own: int, radius: int, k: int):
        """The k rows of largest cosine among those retrieved; `own` is the query's row here, or -1."""
        while True:
            rows = self.within(code, radius)
            rows = rows[rows != own]
            if len(rows) >= k or radius >= BITS:
                break
            radius = min(BITS, radius + PARTS)
        # row by row in the same order of additions, so that equal vectors score equal
        score = (self.vectors[rows] * vector).sum(axis=1) / (self.norms[rows] * np.sqrt((vector * vector).sum()))
        best = np.lexsort((self.ids[rows], -score))[:k]
        return self.ids[rows[best]], score[best]


_QUERIES = "size int, from_block int, row bigint, query_id bigint, query binary, code binary"


def search(index: DataFrame, codes: dict[int, Codes], k: int, every: int, at_once: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: for rows of the index whose id is divisible by `every`, the k nearest other rows."""
    held = index.sparkSession.sparkContext.broadcast({size: own.radius for size, own in codes.items()})
    fields = [("size", pa.int32()), ("from_block", pa.int32()), ("row", pa.int64()), ("query_id", pa.int64()), ("query", pa.binary()), ("code", pa.binary())]

    def ask(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                block = Block(row)
                at = np.nonzero(block.ids % every == 0)[0]
                columns = [
                    [row["size"]] * len(at), [row["block"]] * len(at), at, block.ids[at],
                    [x.tobytes() for x in block.vectors[at]], [x.tobytes() for x in block.codes[at]],
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields)], schema=pa.schema(fields))

    asked = stored(index.mapInArrow(ask, _QUERIES), "queries")
    counts = {r["size"]: r["count"] for r in asked.groupBy("size").count().collect()}
    blocks = {r["size"]: r["blocks"] for r in index.groupBy("size").agg(F.collect_list("block").alias("blocks")).collect()}
    sets = [("size", pa.int32()), ("blocks", pa.list_(pa.int32())), ("from_blocks", pa.binary()), ("rows", pa.binary()), ("query_ids", pa.binary()), ("queries", pa.binary()), ("query_codes", pa.binary())]

    def gather(batches):
        """A task's queries as one row."""
        own = pa.Table.from_batches(list(batches)) if (batches := list(batches)) else None
        if own is None or not own.num_rows:
            return
        size = own["size"][0].as_py()
        yield pa.RecordBatch.from_pylist(
            [{
                "size": size, "blocks": blocks[size], "from_blocks": own["from_block"].to_numpy().astype("<i4").tobytes(),
                "rows": own["row"].to_numpy().astype("<i8").tobytes(), "query_ids": own["query_id"].to_numpy().astype("<i8").tobytes(),
                "queries": b"".join(own["query"].to_pylist()), "query_codes": b"".join(own["code"].to_pylist()),
            }],
            schema=pa.schema(sets),
        )

    shape = "size int, blocks array<int>, from_blocks binary, rows binary, query_ids binary, queries binary, query_codes binary"
    gathered = [
        asked.where(F.col("size") == size).repartition(max(1, -(-n // at_once))).mapInArrow(gather, shape) for size, n in sorted(counts.items())
    ]
    empty = index.sparkSession.createDataFrame([], shape)
    # each set of queries meets each block of its length
    asking = reduce(DataFrame.unionByName, gathered, empty).withColumn("block", F.explode("blocks")).drop("blocks")
    answers = [
        ("from_block", pa.int32()), ("row", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())
    ]

    def answer(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                block, radius = Block(row), held.value[row["size"]]
                homes, at = np.frombuffer(row["from_blocks"], dtype="<i4"), np.frombuffer(row["rows"], dtype="<i8")
                ids = np.frombuffer(row["query_ids"], dtype="<i8")
                queries = np.frombuffer(row["queries"], dtype="<f8").reshape(len(at), -1)
                bits = np.frombuffer(row["query_codes"], dtype=np.uint8).reshape(len(at), PARTS)
                columns = [[], [], [], [], []]
                for home, q, vector, code, query_id in zip(homes.tolist(), at.tolist(), queries, bits, ids.tolist()):
                    found, score = block.nearest(vector, code, q if home == row["block"] else -1, radius, k)
                    for column, values in zip(columns, ([home] * len(found), [q] * len(found), [query_id] * len(found), found.tolist(), score.tolist())):
                        column.extend(values)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, answers)], schema=pa.schema(answers))

    pairs = asking.join(index.drop("size").hint("merge"), "block")
    found = pairs.mapInArrow(answer, "from_block int, row bigint, query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("from_block", "row").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """The k nearest of each row of vectors whose vec_id is divisible by `every`, among all other rows."""
    return search(*build(vectors, k), k, every)
