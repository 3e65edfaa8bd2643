"""Near duplicates among vectors of one label: p-stable hashing, then exact cosines.

Vectors are brought to length 1, where cosine and Euclidean distance say the same. A table's
hash is a row of `projections` quantised Gaussian projections, floor((a.x + b) / width); near vectors often
share all of them, far ones hardly ever. Vectors that share label and hash in some
table are compared by cosine in double precision.

Equal vectors of a label are one class beforehand, with a number of its own, so copies are neither hashed nor compared. How many
projections a hash has follows from the classes of a label, so that unrelated vectors that meet by chance are a bounded number
for each, however many there are; how many tables follows from that and the chance of missing a pair right at the threshold.
The vectors of one bucket are compared in blocks, each pair of blocks (a cell) in one place; a task goes through the cells it
has got in order. A pair that meets in several tables counts in the first. Tasks return a row per vector: its links, and where its component starts.

Defined results: vectors with a null label or id, null, empty, zero, or with null or non-finite
components link with nothing, as do vectors of different length. Rows that repeat an id
are vectors of their own. Ties do not arise. Columns besides vec_id, label and embedding are left out.
"""

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardkit.limits import broadcast_within
from shardkit.llm.common import components, stored
from shardkit.session import settle

THRESHOLD = 0.93
WIDTH = 2.0
# Chance that two vectors right at the threshold meet in no table.
MISSED = 1e-4
# Unrelated vectors that a vector meets in one table, on average.
CHANCE = 30
SEED = 20_240_607
# Vectors of a bucket that one task compares with as many others.
BLOCK = 2_000


def usable(embedding):
    """Whether a vector can have a cosine."""
    x = F.col(embedding)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return x.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(x, lambda v: v != 0)


def _share(distance: float, width: float) -> float:
    """Chance that two vectors so far apart fall into one interval of a quantised projection."""
    x = width / distance
    below = 0.5 * math.erfc(x / math.sqrt(2))  # of a normal number beyond x
    return 1 - 2 * below - 2 / (math.sqrt(2 * math.pi) * x) * (1 - math.exp(-x * x / 2))


def parameters(classes: int, threshold: float = THRESHOLD, missed: float = MISSED, width: float = WIDTH) -> tuple[int, int]:
    """(tables, projections) for a label of so many classes."""
    near, far = _share(math.sqrt(2 - 2 * threshold), width), _share(math.sqrt(2), width)
    projections = max(2, math.ceil(math.log(max(classes, 1) / CHANCE) / -math.log(far)))
    return math.ceil(math.log(missed) / math.log1p(-(near**projections))), projections


def _signatures(unit: np.ndarray, tables: int, projections: int, width: float) -> np.ndarray:
    """A 64-bit hash per vector and table."""
    rng = np.random.default_rng([SEED, unit.shape[1], projections])
    directions = rng.standard_normal((unit.shape[1], tables * projections))
    offsets = rng.uniform(0, width, tables * projections)
    steps = np.floor((unit @ directions + offsets) / width).astype(np.int64).reshape(len(unit), tables, projections)
    factors = rng.integers(1, 1 << 62, projections, dtype=np.int64) | 1
    h = (steps * factors).sum(axis=2).astype(np.uint64)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(32))).astype(np.int64)


def _units(column) -> np.ndarray:
    """The vectors of a column scaled to length 1, filled up with zeros where others are longer."""
    lengths = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    x = np.zeros((len(lengths), lengths.max()))
    x[np.arange(x.shape[1]) < lengths[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _links(rows: pa.Table, threshold: float):
    """Batches (rep, links, root): links found in whole cells of rows, and the smallest vector reachable in the cell."""
    rows = rows.combine_chunks()
    bucket, low, high, table, side, size, reps, weight = (
        rows[c].to_numpy() for c in ("bucket", "low", "high", "table", "side", "size", "rep", "n")
    )
    unit = _units(rows["embedding"].combine_chunks())
    listed = rows["signs"].combine_chunks()
    tables = pc.list_value_length(listed).to_numpy(zero_copy_only=False)
    # labels have numbers of tables of their own; within a cell they are equal
    signs = np.zeros((len(reps), tables.max()), dtype=np.int64)
    signs[np.arange(signs.shape[1]) < tables[:, None]] = listed.flatten().to_numpy()
    ends = np.nonzero((bucket[1:] != bucket[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1]))[0] + 1
    out = {"rep": [], "links": [], "root": []}
    for begin, end in zip([0, *ends.tolist()], [*ends.tolist(), len(reps)]):
        own = unit[begin:end]
        links, root = {}, {}

        def top(i):
            while root.setdefault(i, i) != i:
                root[i] = root.setdefault(root[i], root[i])
                i = root[i]
            return i

        for i in range(0, end - begin, 256):
            near = np.argwhere(own[i : i + 256] @ own.T >= threshold - 1e-9)
            if len(near) <= min(256, end - begin - i):
                continue  # each is near itself alone
            a, b = near[:, 0] + i + begin, near[:, 1] + begin
            once = (reps[a] < reps[b]) & ((side[a] != side[b]) | (low[begin] == high[begin])) & (size[a] == size[b])
            a, b = a[once], b[once]
            exact = (unit[a] * unit[b]).sum(axis=1) >= threshold
            earlier = (signs[a, : table[begin]] == signs[b, : table[begin]]).any(axis=1)
            a, b = a[exact & ~earlier], b[exact & ~earlier]
            for x, y in zip(a.tolist(), b.tolist()):
                links[x] = links.get(x, 0) + int(weight[y])
                links[y] = links.get(y, 0) + int(weight[x])
                x, y = top(x), top(y)
                if x != y:
                    x, y = (x, y) if reps[x] < reps[y] else (y, x)
                    root[y] = x
        for i, n in links.items():
            out["rep"].append(int(reps[i]))
            out["links"].append(n)
            out["root"].append(int(reps[top(i)]))
    if out["rep"]:
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema([(c, pa.int64()) for c in out]))


def link_vectors(
    vectors: DataFrame, threshold: float = THRESHOLD, missed: float = MISSED, width: float = WIDTH, block: int = BLOCK
) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of vectors (vec_id, label, embedding)."""
    rows = vectors.select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("string").alias("label"), "embedding"
    )
    fine = usable("embedding") & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    # 128 bits that stand for label and vector
    keys = [F.when(fine, F.xxhash64(F.lit(i), "label", "embedding")).alias(f"k{i}") for i in (1, 2)]
    rows = rows.withColumns({"k1": keys[0], "k2": keys[1]})
    classes = rows.where("k1 is not null").groupBy("k1", "k2").agg(
        F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("n"), F.first("label").alias("label"),
        F.first("embedding").cast("array<double>").alias("embedding"),
    )
    # numbers of classes, which ids are not: two classes may share their smallest; they stay as they are once stored
    classes = stored(classes.withColumn("rep", F.monotonically_increasing_id()), "vector-kinds")
    of_label = settle(classes.groupBy("label").agg(F.count(F.lit(1)).alias("of_label")))

    def sign(batches):
        for batch in batches:
            embedding = batch.column(2)
            lengths = pc.list_value_length(embedding).to_numpy(zero_copy_only=False)
            kinds = [(length, *parameters(n, threshold, missed, width)) for length, n in zip(lengths.tolist(), batch.column(4).to_pylist())]
            for kind in sorted(set(kinds)):
                length, tables, projections = kind
                own = batch.filter(pa.array([x == kind for x in kinds]))
                signs = _signatures(_units(own.column(2)), tables, projections, width)
                yield pa.RecordBatch.from_arrays(
                    [own.column(0), own.column(1), own.column(2), own.column(3),
                     pa.array([length] * own.num_rows, pa.int32()), pa.array(signs.tolist(), pa.list_(pa.int64()))],
                    names=["rep", "n", "embedding", "label", "size", "signs"],
                )

    counted = classes.select("rep", "n", "embedding", "label").join(broadcast_within(of_label), "label")
    signed = stored(
        counted.select("rep", "n", "embedding", "label", "of_label").mapInArrow(
            sign, "rep bigint, n bigint, embedding array<double>, label string, size int, signs array<bigint>"
        ),
        "signed-vectors",
    )
    met = signed.select("rep", "label", "size", F.posexplode("signs").alias("table", "sign"))
    met = met.select("rep", "table", F.xxhash64("label", "size", "table", "sign").alias("bucket"))
    # buckets of one vector need no more thought; blocks for those of many
    sizes = met.groupBy("bucket").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    blocks = F.ceil(F.col("_n") / block).cast("int")
    met = met.join(sizes, "bucket").withColumn("_blocks", blocks)
    met = met.withColumn("side", F.pmod(F.xxhash64("rep", "bucket"), F.col("_blocks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    met = met.select("rep", "bucket", "table", "side", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"))
    met = met.join(signed.select("rep", "n", "embedding", "size", "signs"), "rep")

    def compare(batches):
        """Each cell (bucket, low, high) comes in a row, though over several batches perhaps."""
        begun = []
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("bucket", "low", "high")], axis=1)
            ends = np.nonzero((keys[1:] != keys[:-1]).any(axis=1))[0] + 1
            if begun and batch.num_rows and (keys[0] != begun[0]).any():
                yield from _links(pa.Table.from_batches(begun[1:]), threshold)
                begun = []
            if len(ends):
                # all but the last cell are whole
                yield from _links(pa.Table.from_batches([*begun[1:], batch.slice(0, ends[-1])]), threshold)
                begun = []
            if batch.num_rows:
                start = int(ends[-1]) if len(ends) else 0
                begun = [*(begun or [keys[start]]), batch.slice(start)]
        if begun:
            yield from _links(pa.Table.from_batches(begun[1:]), threshold)

    # one pass over the cells of a task: most hold two vectors that met by chance, too few for a group of their own
    cells = met.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high")
    found = cells.mapInArrow(compare, "rep bigint, links bigint, root bigint")
    found = stored(found, "vector-links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    component = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    of_class = (
        classes.select("k1", "k2", "rep", "n", "first_id")
        .join(links, "rep", "left")
        .join(component.withColumnRenamed("id", "rep"), "rep", "left")
        .select("k1", "k2", "first_id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "rep").alias("component"))
    )
    of_class = stored(of_class, "vector-classes")
    # a component has the name of its smallest id
    named = of_class.groupBy("component").agg(F.min("first_id").alias("component_id"))
    of_class = stored(of_class.join(named, "component").select("k1", "k2", "links", "component_id"), "named-classes")
    out = rows.select("vec_id", "k1", "k2").join(broadcast_within(of_class), ["k1", "k2"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
        F.col("vec_id").eqNullSafe(component).alias("kept"),
    )
