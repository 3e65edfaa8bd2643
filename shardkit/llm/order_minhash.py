"""Near duplicates of texts by Order MinHash, verified by banded alignment.

A text is the list of its words between white space; its k-mers are runs of three words, each labelled with how
often the same run occurred before. For each of many hash functions the two k-mers with the
smallest hashes are sampled and kept in the order in which they stand in the text: a sketch value. Texts
that share one are candidates. Order makes the sample sensitive to edits, not
only to shared content. Texts of up to 32 words need no luck: of two with at most e edits, one of the e + 1 segments
of the longer stands unchanged in the other, so they are candidates by their segments. Candidates are verified by aligning their words in a band: they are
linked if 1 - edits / words of the longer one is at least 0.8.

Equal texts are one node beforehand. Texts that share a value are a bucket. First, each text is compared with the
leaders of some of its buckets, and, if it is still apart, with one text of the component that most of a bucket's are of: this joins
nearly all of a group of copies at the cost of a few comparisons each. Then the texts of a bucket that are
still of different components are compared all with all, in blocks, each pair of blocks (a cell) in one place: by their lengths and by
bit maps of their words and pairs of neighbouring words, whose bounds no alignment can beat. What passes is aligned. So
every pair that shares a value is either of one component already, or ruled out by the bound, or aligned: no link that joins components is lost.

Defined results: null and empty texts are equal. Texts without words link with equal ones only; a text of
fewer than four words has one k-mer, all its words. Rows with a null doc_id take no part and
have no class. Ties do not matter: a class is named by its smallest doc_id. Rows that repeat keep
their class. Columns besides doc_id and text are left out, but for one_of_each(), which keeps all.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardkit.limits import broadcast_within
from shardkit.llm.common import components, release, scratch_removed, stored, task_number

WORDS, SIMILARITY = 3, 0.8
# Chance that two texts share a sketch value, by the part of k-mers they share: 0.999 at 0.3, 0.99 at 0.25.
SKETCHES = 72
# Texts of up to so many words meet all that are similar to them.
SHORT = 32
SEED = 11
# Texts of a bucket that are compared with as many others in one place.
BLOCK_TEXTS = 1_500
# Texts of a bucket that others are compared with first, and buckets of a text, besides its largest and smallest, for that.
LEADERS, CHOSEN = 1, 5
# Bits of a text's map: eight times its words, within these.
LEAST_BITS, MOST_BITS = 512, 65_536
_REMEMBERED = 400_000
_MAX = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes:
    """64-bit hashes of the words of a text, remembered by word."""

    def __init__(self):
        self.known: dict[str, int] = {}

    def of(self, text: str) -> np.ndarray:
        words = text.split()
        new = set(words).difference(self.known)
        if len(self.known) > _REMEMBERED:
            self.known, new = {}, set(words)
        for word in new:
            raw = word.encode("utf-8", "surrogatepass")
            self.known[word] = int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little")
        return np.fromiter(map(self.known.__getitem__, words), dtype=np.uint64, count=len(words))


def labelled_kmers(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of runs of k words, different for each occurrence of the same run."""
    n = max(1, len(words) - k + 1)
    h = np.zeros(n, dtype=np.uint64)
    for j in range(min(k, len(words))):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[j : j + n]
    order = np.argsort(h, kind="stable")
    run = h[order]
    first = np.concatenate([[True], run[1:] != run[:-1]])
    at = np.arange(n)
    occurrence = np.empty(n, dtype=np.uint64)
    occurrence[order] = at - np.maximum.accumulate(np.where(first, at, 0))
    return _mixed(h + occurrence * np.uint64(0xD6E8FEB86659FD93))


_SEEDS = np.random.default_rng(SEED).integers(0, 1 << 63, (2, 4096), dtype=np.uint64)


def sketch(words: np.ndarray, k: int = WORDS, sketches: int = SKETCHES) -> np.ndarray:
    """A value per hash function: the two sampled k-mers in text order. Empty without words."""
    if not len(words):
        return np.zeros(0, dtype=np.int64)
    kmers = labelled_kmers(words, k)
    turn, factor = _SEEDS[0, :sketches, None], _SEEDS[1, :sketches, None] | np.uint64(1)
    out = np.empty(sketches, dtype=np.uint64)
    step = max(1, 1_000_000 // len(kmers))
    for t in range(0, sketches, step):
        h = (kmers[None, :] ^ turn[t : t + step]) * factor[t : t + step]
        h ^= h >> np.uint64(32)
        row = np.arange(len(h))
        one = h.argmin(axis=1)
        two = one
        if len(kmers) > 1:
            h[row, one] = _MAX
            two = h.argmin(axis=1)
        early, late = kmers[np.minimum(one, two)], kmers[np.maximum(one, two)]
        out[t : t + step] = _mixed(early * np.uint64(3) + late + turn[t : t + step, 0])
    return out.view(np.int64)


def _most(n_words: int, least: float) -> int:
    """Edits that texts may have of which the longer one has n_words."""
    return int((1 - least) * n_words + 1e-9)


def segments(words: np.ndarray, least: float = SIMILARITY, short: int = SHORT) -> np.ndarray:
    """Values of which any two similar texts, the shorter of up to `short` words, share one.

    A text of n words is cut into one segment more than it may have edits. Texts that are shorter look
    for them where edits may have shifted them to. Empty without words, and for texts too long.
    """
    m, found = len(words), set()
    own, n = words.tolist(), m
    while m and n - _most(n, least) <= min(m, short) and (n == m or m <= short):
        most, fewer = _most(n, least), n - m
        left, right = ((most + fewer) // 2, (most - fewer) // 2) if m <= short else (0, 0)
        ends = [n * i // (most + 1) for i in range(most + 2)]
        for i, (start, end) in enumerate(zip(ends, ends[1:])):
            for at in range(max(0, start - left), min(m - end + start, start + right) + 1):
                found.add(hash((n, i, *own[at : at + end - start])))
        n += 1
    return np.array(sorted(found), dtype=np.int64)


def edits_within(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """Edits (insert, delete, replace a word) from a to b, or None if more than `most`.

    Aligns in a band around the diagonal, first a narrow one and then wider ones. A column of
    the band is kept as two integers whose bits say where the count rises and falls.
    """
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return None
    n = len(b)
    differs = np.nonzero(a[:n] != b)[0]
    head = int(differs[0]) if len(differs) else n
    a, b = a[head:], b[head:]
    n = len(b)
    differs = np.nonzero(a[len(a) - n :][::-1] != b[::-1])[0] if n else differs[:0]
    tail = int(differs[0]) if len(differs) else n
    a, b = a[: len(a) - tail], b[: n - tail]
    if not len(b):
        return len(a) if len(a) <= most else None
    places: dict[int, int] = {}
    for i, word in enumerate(a.tolist()):
        places[word] = places.get(word, 0) | 1 << i
    longer = len(a) - len(b)
    band = min(most, max(16, 2 * longer))
    while True:
        edits = _in_band(places, b.tolist(), longer, band)
        if edits is not None and edits <= band:
            return edits
        if band >= most:
            return None
        band = min(most, 4 * band)


def _in_band(places: dict[int, int], b: list[int], longer: int, band: int) -> int | None:
    """Edits if there are at most `band`. Bit t of a column j stands for row j - band + t of the table."""
    mask = (1 << (2 * band + 1)) - 1
    middle, top = 1 << band, 1 << (2 * band)
    # rows up to 0 fall by one each, rows from 1 on rise
    down = (1 << (band + 1)) - 1
    up = mask & ~down
    count = 0
    for j, word in enumerate(b, 1):
        up, down = up >> 1 | top, down >> 1
        shift = j - band - 1
        at = places.get(word, 0)
        match = (at >> shift if shift >= 0 else at << -shift) & mask
        same = ((((match & up) + up) ^ up) | match | down) & mask
        rise, fall = (down | ~(same | up)) & mask, same & up
        if not same & middle:
            count += 1
            if count - longer > band:
                return None
        rise, fall = (rise << 1 | 1) & mask, fall << 1 & mask
        up, down = (fall | ~(same | rise)) & mask, rise & same
    below = ((1 << longer) - 1) << (band + 1)
    return count + (up & below).bit_count() - (down & below).bit_count()


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    longest = max(len(a), len(b))
    return edits_within(a, b, _most(longest, least)) is not None


def text_maps(words: np.ndarray) -> bytes:
    """Two bit maps of a text, of its words and of its pairs of neighbouring words, each labelled with how often it occurred before.

    A bit that one text has and another lacks stands for a word, or pair, that only the one has. An edit takes away one word
    and two pairs at most, and adds as many: so of texts that are up to e edits apart, and d words in length, the maps of words
    differ in 2 e - d bits at most, those of pairs in 4 e. A map is as long as a power of two; folded to half its
    length it says the same of fewer bits.
    """
    n_bits = LEAST_BITS
    while n_bits < 8 * len(words) and n_bits < MOST_BITS:
        n_bits *= 2
    out = np.zeros((2, n_bits), dtype=bool)
    for row, k in enumerate((1, 2)):
        if len(words) >= k:
            out[row, (labelled_kmers(words, k) % np.uint64(n_bits)).astype(np.int64)] = True
    return np.packbits(out, axis=1).tobytes()


def _read_maps(maps: list) -> np.ndarray:
    """(text, kind of map, 64 bits of it); maps of one length."""
    return np.frombuffer(b"".join(maps), dtype=np.uint64).reshape(len(maps), 2, -1)


def _folded(maps: np.ndarray) -> np.ndarray:
    half = maps.shape[2] // 2
    return maps[:, :, :half] | maps[:, :, half:]


def _within(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, least: float) -> np.ndarray:
    """Whether texts may be similar, by lengths and maps, pair by pair."""
    apart = np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)
    most = ((1 - least) * np.maximum(n_a, n_b) + 1e-9).astype(np.int64)
    return (apart[..., 0] <= 2 * most - np.abs(n_a - n_b)) & (apart[..., 1] <= 4 * most)


def close_pairs(lengths: np.ndarray, maps: list[bytes], groups: np.ndarray, sides: np.ndarray | None, least: float) -> list[tuple[int, int]]:
    """Pairs of different groups, and sides if given, that lengths and maps do not rule out."""
    sizes = np.array([len(m) for m in maps])
    by_size = {size: np.nonzero(sizes == size)[0] for size in np.unique(sizes).tolist()}
    held = {size: _read_maps([maps[i] for i in at]) for size, at in by_size.items()}
    out = []
    for size, at in by_size.items():
        # similar texts have maps of one size, or of twice the size
        others = [(at, held[size], True)]
        if 2 * size in by_size:
            others.append((by_size[2 * size], _folded(held[2 * size]), False))
        for to, wide, same in others:
            step = max(1, 4_000_000 // (len(to) * wide.shape[2]))
            for first in range(0, len(at), step):
                i, own = at[first : first + step], held[size][first : first + step]
                n_i, n_to = lengths[i][:, None], lengths[to][None, :]
                most = ((1 - least) * np.maximum(n_i, n_to) + 1e-9).astype(np.int64)
                fine = (np.abs(n_i - n_to) <= most) & (groups[i][:, None] != groups[to][None, :])
                if same:
                    fine &= i[:, None] < to[None, :]
                if sides is not None:
                    fine &= sides[i][:, None] != sides[to][None, :]
                if not fine.any():
                    continue
                apart = np.bitwise_count(own[:, None, 0] ^ wide[None, :, 0]).sum(axis=2, dtype=np.int32)
                x, y = np.nonzero(fine & (apart <= 2 * most - np.abs(n_i - n_to)))
                good = _within(own[x], wide[y], lengths[i[x]], lengths[to[y]], least)
                out += list(zip(i[x[good]].tolist(), to[y[good]].tolist()))
    return out


_FEATURES = "doc_id bigint, key binary, at bigint, n_words int, sketch array<bigint>, bits binary"


def _keyed(docs: DataFrame, *more) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.unhex(F.md5(text.cast("binary"))).alias("key"),
        text.alias("text"), *more,
    )


def classes(docs: DataFrame, k: int = WORDS, least: float = SIMILARITY, sketches: int = SKETCHES) -> tuple[DataFrame, DataFrame]:
    """Two stored tables: (doc_id, key) of every row, and (key, rep, component, class_id) of every text."""

    def features(batches):
        hashes, at = WordHashes(), task_number() << 40
        for batch in batches:
            # copies in a row are worked on once
            known: dict[bytes, tuple] = {}
            found = []
            for key, text in zip(batch.column(1).to_pylist(), batch.column(2)):
                if key not in known:
                    words = hashes.of(text.as_py())
                    # texts up to SHORT words meet by segments
                    values = [segments(words, least)] + ([sketch(words, k, sketches)] if len(words) > SHORT else [])
                    known[key] = (len(words), np.concatenate(values), text_maps(words))
                found.append(known[key])
            n_words, values, bits = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.arange(at, at + len(found))), pa.array(n_words, pa.int32()),
                 pa.array(list(values), pa.list_(pa.int64())), pa.array(bits, pa.binary())],
                names=["doc_id", "key", "at", "n_words", "sketch", "bits"],
            )
            at += len(found)

    spark = docs.sparkSession
    with scratch_removed(spark) as result:
        # sketches are removed once buckets and traits are there, all other tables with the last step
        with scratch_removed(spark) as later:
            rows = stored(_keyed(docs).mapInArrow(features, _FEATURES), "sketches")
            ids = result(rows.select("doc_id", "key"), "keys")
            # a text's node is the number of one of its rows
            first = rows.where("doc_id is not null").groupBy("key").agg(F.min(F.struct("doc_id", "at")).alias("m"))
            nodes = later(first.select("key", F.col("m.doc_id").alias("rep"), F.col("m.at").alias("node")), "texts")
            # merged at any size, as a broadcast would end at some size and the disk needed rise there at once
            one_each = rows.withColumnRenamed("at", "node").join(nodes.select("node").hint("merge"), "node", "left_semi")
            # values differ by hash function already
            met = one_each.select("node", F.explode("sketch").alias("bucket"))
            shared = met.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
            met = later(met.join(shared, "bucket").select("bucket", "node", "n"), "buckets")
            in_buckets = later(met.select("node").distinct(), "candidates")
            traits = later(
                rows.withColumnRenamed("at", "node").join(broadcast_within(in_buckets), "node", "left_semi").select("node", "n_words", "bits"), "traits"
            )
        words = _words(docs, in_buckets.join(nodes, "node"))
        release(spark)
        links = stored(_aligned(_ruled(_leader_pairs(met), traits, least), words, least), "leader-links")
        release(spark)
        of_node = stored(components(links).select(F.col("id").alias("node"), "component"), "leader-components")
        # those still apart, with a leader of the component that most of a bucket's texts are of
        links = stored(links.unionByName(_aligned(_ruled(_main_pairs(met, of_node), traits, least), words, least)), "main-links")
        of_node = stored(components(links).select(F.col("id").alias("node"), "component"), "main-components")
        release(spark)
        more = stored(_aligned(_across(met, of_node, traits, least), words, least), "further-links")
        # components of components
        of_component = components(
            more.join(of_node.select(F.col("node").alias("a"), F.col("component").alias("ca")), "a", "left")
            .join(of_node.select(F.col("node").alias("b"), F.col("component").alias("cb")), "b", "left")
            .select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
        )
        final = nodes.join(of_node, "node", "left").withColumn("component", F.coalesce("component", "node"))
        final = final.join(of_component.select(F.col("id").alias("component"), F.col("component").alias("whole")), "component", "left")
        final = stored(final.select("key", "rep", F.coalesce("whole", "component").alias("component")), "linked")
        names = final.groupBy("component").agg(F.min("rep").alias("class_id"))
        return ids, result(final.join(names, "component").select("key", "rep", "component", "class_id"), "classes")


def _words(docs: DataFrame, members: DataFrame) -> DataFrame:
    """(node, words): hashes of the words of texts that share a bucket with another."""

    def read(batches):
        hashes = WordHashes()
        for batch in batches:
            words = [hashes.of(t.as_py()).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.binary())], names=["node", "words"])

    wanted = members.select("key", F.col("rep").alias("doc_id"), "node")
    texts = _keyed(docs).join(broadcast_within(wanted), ["key", "doc_id"]).select("node", "text")
    # rows may repeat id and text; then a node is there more than once
    return stored(texts.mapInArrow(read, "node bigint, words binary"), "words")


def _leader_pairs(met: DataFrame) -> DataFrame:
    """(node, leader): texts with the leaders of some of their buckets."""
    chosen = [F.min_by("node", F.xxhash64("node", F.lit(r))).alias(f"l{r}") for r in range(LEADERS)]
    leaders = met.groupBy("bucket").agg(F.array_distinct(F.array(*chosen)).alias("leaders"))
    # the largest bucket of a text, the smallest, where near ones are among themselves, and some by their hashes: texts that
    # share most buckets choose the same ones, and so the same leaders
    size = F.struct("n", "bucket")
    some = [F.min_by("bucket", F.xxhash64("bucket", F.lit(r))) for r in range(CHOSEN)]
    own = met.groupBy("node").agg(F.array_distinct(F.array(F.max(size)["bucket"], F.min(size)["bucket"], *some)).alias("own"))
    own = own.select("node", F.explode("own").alias("bucket"))
    return own.join(leaders, "bucket").select("node", F.explode("leaders").alias("leader"))


def _grouped(met: DataFrame, of_node: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bucket, node, component), and (bucket, n, of_main, main) of buckets with texts of several components, main being that of most."""
    grouped = met.join(of_node, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    sizes = grouped.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("c"))
    mixed = sizes.groupBy("bucket").agg(
        F.sum("c").alias("n"), F.max("c").alias("of_main"), F.max_by("component", F.struct("c", "component")).alias("main")
    )
    return grouped, mixed.where("n > of_main")


def _main_pairs(met: DataFrame, of_node: DataFrame) -> DataFrame:
    """(node, leader): texts of a bucket that are not of its main component, with one that is."""
    grouped, mixed = _grouped(met, of_node)
    held = grouped.join(mixed.where("of_main > 1").select("bucket", "main"), "bucket")
    in_main = F.col("component") == F.col("main")
    leaders = held.where(in_main).groupBy("bucket").agg(F.min_by("node", F.xxhash64("node")).alias("leader"))
    return held.where(~in_main).join(leaders, "bucket").select("node", "leader")


def _ruled(pairs: DataFrame, traits: DataFrame, least: float) -> DataFrame:
    """(a, b): pairs (node, leader), each once, that lengths and maps do not rule out."""
    pairs = pairs.where("node <> leader")
    pairs = pairs.select(F.least("node", "leader").alias("a"), F.greatest("node", "leader").alias("b")).distinct()
    for side in ("a", "b"):
        pairs = pairs.join(traits.select(F.col("node").alias(side), F.col("n_words").alias(f"n_{side}"), F.col("bits").alias(f"bits_{side}")), side)
    most = F.floor((1 - least) * F.greatest("n_a", "n_b") + 1e-9)
    pairs = pairs.where(F.abs(F.col("n_a") - F.col("n_b")) <= most)

    def bounded(batches):
        for batch in batches:
            a, b, n_a, n_b, x, y = (batch.column(c) for c in ("a", "b", "n_a", "n_b", "bits_a", "bits_b"))
            fine = np.zeros(batch.num_rows, dtype=bool)
            for i, (p, q) in enumerate(zip(n_a.to_numpy(), n_b.to_numpy())):
                maps = [_read_maps([v[i].as_py()]) for v in (x, y)]
                if maps[0].shape != maps[1].shape:
                    wide = int(maps[1].shape[2] > maps[0].shape[2])
                    maps[wide] = _folded(maps[wide])
                # similar texts have maps of one size, or of twice the size
                fine[i] = maps[0].shape == maps[1].shape and _within(maps[0][0], maps[1][0], p, q, least)
            keep = pa.array(fine)
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], names=["a", "b"])

    return pairs.mapInArrow(bounded, "a bigint, b bigint")


def cell_pairs(rows: list[dict], bucket: int, two_sides: bool, least: float) -> list[tuple[int, int]]:
    """Pairs of nodes of a cell that lengths and maps do not rule out, of those whose first shared bucket is this one.

    `shared` has all buckets in which a node meets others. Two nodes that share several are compared in each, as they
    are of different components in each, so a pair that is left to its first bucket is found there.
    """
    own = sorted({r["node"]: r for r in rows}.values(), key=lambda r: r["node"])
    sides = np.array([r["side"] for r in own]) if two_sides else None
    lengths, groups = np.array([r["n_words"] for r in own]), np.array([r["component"] for r in own])
    earlier = [{x for x in r["shared"] if x < bucket} for r in own]
    found = close_pairs(lengths, [r["bits"] for r in own], groups, sides, least)
    return [(own[i]["node"], own[j]["node"]) for i, j in found if earlier[i].isdisjoint(earlier[j])]


def _across(met: DataFrame, of_node: DataFrame, traits: DataFrame, least: float) -> DataFrame:
    """(a, b): texts of a bucket that are of different components, and not ruled out by the bound. Each pair comes once."""
    grouped, mixed = _grouped(met, of_node)
    # texts of a bucket's main component meet the others only; a bucket of one component has no others
    few = F.col("n") <= BLOCK_TEXTS
    blocks = F.ceil(F.when(few, F.col("n")).otherwise(F.col("n") - F.col("of_main")) / BLOCK_TEXTS).cast("int")
    main_blocks = F.when(few, 0).otherwise(F.ceil(F.col("of_main") / BLOCK_TEXTS)).cast("int")
    mixed = mixed.select("bucket", F.when(~few, F.col("main")).alias("main"), blocks.alias("_blocks"), main_blocks.alias("_main_blocks"))
    in_main = F.coalesce(F.col("component") == F.col("main"), F.lit(False))
    number = F.xxhash64("node", "bucket")
    side = F.when(in_main, F.col("_blocks") + F.pmod(number, F.greatest("_main_blocks", F.lit(1)))).otherwise(F.pmod(number, F.col("_blocks")))
    dealt = grouped.join(mixed, "bucket").withColumn("side", side.cast("int"))
    shared = dealt.groupBy("node").agg(F.collect_set("bucket").alias("shared"))
    last = F.col("_blocks") + F.when(in_main, 0).otherwise(F.col("_main_blocks")) - 1
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), last)))
    cell = ["bucket", "low", "high"]
    dealt = dealt.select(
        "node", "component", "side", "bucket", F.least("side", "_other").alias("low"), F.greatest("side", "_other").alias("high")
    )
    gathered = dealt.join(traits, "node").join(shared, "node").repartition(*cell).sortWithinPartitions(*cell)

    def compare(batches):
        """Each cell comes in a row, though over several batches perhaps."""
        held, at = [], None

        out = []
        for batch in batches:
            for row in batch.to_pylist():
                key = tuple(row[c] for c in cell)
                if key != at and held:
                    out += cell_pairs(held, at[0], at[1] != at[2], least)
                    held = []
                at = key
                held.append(row)
            if out:
                yield _pairs(out)
                out = []
        if held:
            yield _pairs(cell_pairs(held, at[0], at[1] != at[2], least))

    return gathered.mapInArrow(compare, "a bigint, b bigint").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[x] for p in found], pa.int64()) for x in (0, 1)], names=["a", "b"])


def _aligned(pairs: DataFrame, words: DataFrame, least: float) -> DataFrame:
    """Those of the pairs that are similar. Only words of texts in pairs are brought together."""
    pairs = stored(pairs, "pairs")
    needed = stored(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "paired")
    words = words.join(broadcast_within(needed), "node", "left_semi").dropDuplicates(["node"])
    for side in ("a", "b"):
        pairs = pairs.join(words.select(F.col("node").alias(side), F.col("words").alias(f"words_{side}")), side)

    def align(batches):
        for batch in batches:
            fine = [similar(*(np.frombuffer(batch.column(f"words_{side}")[i].as_buffer(), dtype=np.uint64) for side in ("a", "b")), least) for i in range(batch.num_rows)]
            keep = pa.array(fine, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(side).filter(keep) for side in ("a", "b")], names=["a", "b"])

    return pairs.mapInArrow(align, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """doc_id, class_id (smallest doc_id of the class) and kept of every row of docs."""
    rows, texts = classes(docs, **options)
    out = rows.join(broadcast_within(texts), "key", "left")
    class_id = F.when(F.col("doc_id").isNotNull(), F.col("class_id"))
    return out.select("doc_id", class_id.alias("class_id"), F.col("doc_id").eqNullSafe(class_id).alias("kept"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """Rows of docs with all their columns, one of each class: that with the smallest doc_id. Null ids stay."""
    rows, texts = classes(docs, **options)
    # where the smallest id of a class stands for several of its texts, one of them stays
    stay = texts.where(F.col("rep") == F.col("class_id")).groupBy("component").agg(
        F.min("key").alias("key"), F.min("rep").alias("doc_id")
    )
    stay = stored(stay.select("key", "doc_id"), "kept")
    whole = docs.select(F.struct("*").alias("row"))
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    keyed = whole.select("row", F.col("row.doc_id").cast("bigint").alias("doc_id"), F.unhex(F.md5(text.cast("binary"))).alias("key"))
    # most texts stay, so they cross an exchange at any size
    kept = keyed.join(stay.hint("merge"), ["doc_id", "key"], "left_semi")
    again = rows.join(broadcast_within(stay), ["doc_id", "key"], "left_semi").groupBy("doc_id", "key").count().where("count > 1")
    if again.count():  # rows that repeat id and text; else nothing needs to be brought together
        kept = kept.dropDuplicates(["doc_id", "key"])
    return kept.unionByName(keyed.where("doc_id is null")).select("row.*")

