"""Encoding with a word BPE by tree concatenation, and decoding.

A long text is halved until its leaves are short, wherever that cuts it; leaves are encoded in parallel, as
rows of their own. Then neighbours are joined, up the tree. Around each join a window is encoded
anew and grows until both sides agree exactly:

* on the left it starts where a pre-token of the left side starts that ends too early to
  see the cut. The pattern of the pre-tokenizer looks only forward, so all before stays as it is;
* on the right it ends where a pre-token starts both in the window and in the right side, early enough not to see the
  window's end. From there on both are matched alike, so all behind stays as it is.
* A run of one kind of characters that spans the window is one pre-token, however long. Inside it, tokens are
  settled by pairs: a list of tokens is the encoding of its text if each two neighbours are the
  encoding of theirs. So the window may start and end with whole tokens of either side that it
  reproduces; it is then encoded as a word's middle, without the mark of a word's end.

Short texts are encoded by the library as they are, cut at spaces with repeated pieces remembered: a space
always ends a pre-token. Normalisation is done on whole segments before cutting; special tokens, which
the library finds before it, part segments.

Defined results: a null text is empty and has no ids. Copies of a long text are encoded once. Repeated
rows get equal results. An empty table gives no rows. Columns besides doc_id and text are left out.
"""

import json
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shardkit.limits import broadcast_within
from shardkit.llm.common import stored
from shardkit.llm.encoder import LONGEST_REMEMBERED, Remembered, byte_letters, library_tokenizer, shared, slices, tokenizer_text

# Texts of more characters are halved until no leaf has more.
LEAF_CHARS = 16_384
# How far any alternative of the pattern can look ahead of where it starts to match, at least.
LOOK_AHEAD = 16
WINDOW = 256
# Pieces of leaves that a worker remembers with their tokens' places.
REMEMBERED_PARTS = 200_000
# Fixed value: the pattern of the vocabulary's pre-tokenizer.
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
# By it two pre-tokens: letters that are composed already, and marks none of which starts another alternative.
_WORD = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,;:!?$%&*]*)")


@dataclass
class Tokens:
    """Encoding of a stretch of normalised text: ids, their character spans from the stretch's start, and word numbers."""

    ids: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    firsts: np.ndarray  # whether a token starts a pre-token

    def part(self, a: int, b: int) -> "Tokens":
        return Tokens(self.ids[a:b], self.starts[a:b], self.ends[a:b], self.firsts[a:b])

    def moved(self, by: int) -> "Tokens":
        return Tokens(self.ids, self.starts + by, self.ends + by, self.firsts)

    @staticmethod
    def row(*parts: "Tokens") -> "Tokens":
        return Tokens(*(np.concatenate([getattr(p, x) for p in parts]) for x in ("ids", "starts", "ends", "firsts")))


class TreeEncoder:
    """The library's tokenizer, and two of its parts: without normaliser, and without the mark of a word's end."""

    def __init__(self, json_text: str):
        self.whole = library_tokenizer(json_text)
        config = json.loads(json_text)
        self.special = {t["content"]: t["id"] for t in config["added_tokens"]}
        self.marker = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.pre_tokens, self.letters = {}, byte_letters()
        steps = lambda part, name: (config[part] or {}).get(name) or []
        self.direct = (
            [n["type"] for n in steps("normalizer", "normalizers")] == ["NFC", "Replace", "Lowercase"]
            and [p.get("pattern", {}).get("Regex") for p in steps("pre_tokenizer", "pretokenizers")] == [_SPLIT, None]
            and steps("pre_tokenizer", "pretokenizers")[1]["type"] == "ByteLevel"
            and not steps("pre_tokenizer", "pretokenizers")[1]["add_prefix_space"]
            and not steps("pre_tokenizer", "pretokenizers")[1]["use_regex"]
            and not config["model"].get("dropout")
        )
        config |= {"normalizer": None, "added_tokens": [], "post_processor": None, "truncation": None, "padding": None}
        self.plain = library_tokenizer(json.dumps(config))
        config["model"]["end_of_word_suffix"] = None
        self.middle = library_tokenizer(json.dumps(config))
        self.known, self.known_parts = Remembered(), Remembered(REMEMBERED_PARTS)

    # short texts

    def ids(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split, new = [], set()
        for text in texts:
            pieces = [p for p in text.replace("\n", " ").split(" ") if p]
            split.append(pieces)
            new.update(pieces)
        new, known, once = self.known.missing(new), self.known.now, {}
        rest = []
        for piece in new:
            word = _WORD.fullmatch(piece) if self.direct else None
            if word and len(piece) <= LONGEST_REMEMBERED:
                known[piece] = b"".join([self._pre_token(x.lower()) for x in word.groups() if x])
            else:
                rest.append(piece)
        for piece, found in zip(rest, self.whole.encode_batch_fast(rest, add_special_tokens=False)):
            ids = np.array(found.ids, dtype="<u4").tobytes()
            (known if len(piece) <= LONGEST_REMEMBERED else once)[piece] = ids
        get = known.__getitem__ if not once else lambda p: known[p] if p in known else once[p]
        return [b"".join(map(get, pieces)) for pieces in split]

    def _pre_token(self, text: str) -> bytes:
        """Ids of a normalised pre-token, from the library's model."""
        if (found := self.pre_tokens.get(text)) is None:
            if len(self.pre_tokens) >= REMEMBERED_PARTS:
                self.pre_tokens.clear()
            tokens = self.whole.model.tokenize(text.encode("utf-8").decode("latin-1").translate(self.letters))
            found = self.pre_tokens[text] = np.array([t.id for t in tokens], dtype="<u4").tobytes()
        return found

    def decode(self, ids: bytes) -> str:
        return self.whole.decode(np.frombuffer(ids, dtype="<u4").tolist(), skip_special_tokens=False)

    # long texts

    def segments(self, text: str) -> list[tuple[int | None, str]]:
        """A text parted at special tokens: (id, "") for such a token, (None, normalised text) for what is between."""
        out = []
        for piece in self.marker.split(text) if self.special else [text]:
            if piece in self.special:
                out.append((self.special[piece], ""))
            elif piece:
                normalizer = self.whole.normalizer
                out.append((None, normalizer.normalize_str(piece) if normalizer else piece))
        return out

    @staticmethod
    def leaves(text: str, most: int = LEAF_CHARS) -> list[str]:
        """The leaves of a text's tree, left to right: 2^h of nearly equal length."""
        n = 1
        while len(text) > n * most:
            n *= 2
        cuts = [len(text) * i // n for i in range(n + 1)]
        return [text[a:b] for a, b in zip(cuts, cuts[1:])]

    def tokens(self, text: str, middle: bool = False) -> Tokens:
        encoding = (self.middle if middle else self.plain).encode(text, add_special_tokens=False)
        n = len(encoding.ids)
        spans = np.array(encoding.offsets, dtype=np.int64).reshape(n, 2)
        words = np.array(encoding.word_ids, dtype=np.int64)
        firsts = np.ones(n, dtype=bool)
        firsts[1:] = words[1:] != words[:-1]
        return Tokens(np.array(encoding.ids, dtype=np.int64), spans[:, 0], spans[:, 1], firsts)

    def leaf(self, text: str) -> Tokens:
        """tokens() of a leaf, of which pieces between spaces are remembered."""
        pieces = text.split(" ")
        new, once = list(self.known_parts.missing(set(pieces))), {}
        known = self.known_parts.now
        if new:
            # in a row: a space ends a pre-token, so each is encoded as if alone
            t = self.tokens(" ".join(new))
            begins = np.cumsum([0] + [len(p) + 1 for p in new])
            cuts = np.searchsorted(t.starts, begins)
            by = np.repeat(begins[:-1], np.diff(cuts))
            places = np.stack([t.ids, t.starts - by, t.ends - by, t.firsts], axis=1).astype("<i4").tobytes()
            for piece, x, y in zip(new, (cuts * 16).tolist(), (cuts[1:] * 16).tolist()):
                (known if len(piece) <= LONGEST_REMEMBERED else once)[piece] = places[x:y]
        found = [known[p] if p in known else once[p] for p in pieces]
        ids, starts, ends, firsts = np.frombuffer(b"".join(found), "<i4").reshape(-1, 4).T.astype(np.int64)
        begins = np.cumsum([0] + [len(p) + 1 for p in pieces[:-1]])
        by = np.repeat(begins, [len(x) // 16 for x in found])
        return Tokens(ids, starts + by, ends + by, firsts.astype(bool))

    def joined(self, left_text: str, left: Tokens, right_text: str, right: Tokens) -> Tokens:
        """The encoding of both texts in a row, from those of each."""
        cut, text = len(left_text), left_text + right_text
        starts = np.nonzero(left.firsts & (left.starts <= cut - LOOK_AHEAD))[0]
        keep = int(starts[-1]) if len(starts) else 0  # tokens of the left side before the window
        begin = int(left.starts[keep]) if len(starts) else 0
        size = WINDOW
        while True:
            if cut - begin > 4 * size and (found := self._inside(text, cut, left, keep, right, size)) is not None:
                return found
            end = min(len(right_text), size)
            window = self.tokens(text[begin : cut + end]).moved(begin)
            if end == len(right_text):
                return Tokens.row(left.part(0, keep), window)
            near = right.part(0, int(np.searchsorted(right.starts, end)))
            agreed = np.intersect1d(
                window.starts[window.firsts & (window.starts >= cut) & (window.starts <= cut + end - LOOK_AHEAD)],
                near.starts[near.firsts] + cut,
            )
            if len(agreed):
                x = agreed[0]
                a = int(np.nonzero(window.firsts & (window.starts == x))[0][0])
                b = int(np.nonzero(right.firsts & (right.starts == x - cut))[0][0])
                return Tokens.row(left.part(0, keep), window.part(0, a), right.part(b, len(right.ids)).moved(cut))
            if (found := self._inside(text, cut, left, keep, right, size)) is not None:
                return found
            size *= 2

    def _inside(self, text: str, cut: int, left: Tokens, keep: int, right: Tokens, size: int) -> Tokens | None:
        """The join where it lies deep inside one pre-token, of which both sides hold much; else None."""
        n = len(left.ids)
        later = np.nonzero(right.firsts[1:])[0]
        until = int(later[0]) + 1 if len(later) else len(right.ids)  # tokens of the right side's first pre-token
        if until < 4 or n - keep < 4 or right.starts[0] != 0 or left.ends[-1] != cut:
            return None
        near = text[cut - LOOK_AHEAD : cut + LOOK_AHEAD]
        if len(self.plain.pre_tokenizer.pre_tokenize_str(near)) != 1 or not (near.isalpha() or not any(c.isalnum() or c.isspace() or c == "'" for c in near)):
            return None
        # tokens that begin or end on whole characters, about `size` characters away; not the last of a pre-token
        whole = np.concatenate([[True], left.starts[1:] >= left.ends[:-1]])
        a = [i for i in np.nonzero(whole)[0].tolist() if keep < i < n - 2 and left.starts[i] <= cut - size]
        ends = np.concatenate([right.starts[1:] >= right.ends[:-1], [True]])
        b = [i for i in np.nonzero(ends)[0].tolist() if 1 < i < until - 2 and right.ends[i] >= size]
        if not a or not b:
            return None
        first, last = a[-1], b[0]
        window = self.tokens(text[int(left.starts[first]) : cut + int(right.ends[last])], middle=True)
        if window.firsts.sum() != 1 or window.ids[0] != left.ids[first] or window.ids[-1] != right.ids[last]:
            return None
        window = window.moved(int(left.starts[first]))
        window.firsts[0] = left.firsts[first]
        return Tokens.row(left.part(0, first), window, right.part(last + 1, len(right.ids)).moved(cut))

    def tree(self, texts: list[str], parts: list[Tokens]) -> Tokens:
        """Neighbours joined by pairs, level by level."""
        while len(parts) > 1:
            pairs = range(0, len(parts), 2)
            parts = [self.joined(texts[i], parts[i], texts[i + 1], parts[i + 1]) for i in pairs]
            texts = [texts[i] + texts[i + 1] for i in pairs]
        return parts[0]


def _pack(numbers: np.ndarray) -> bytes:
    """32-bit integers, compressed by byte: those of higher rank are nearly all alike."""
    return zstandard.ZstdCompressor().compress(numbers.astype("<i4").view("u1").reshape(-1, 4).T.tobytes())


def _unpack(packed: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), "u1")
    return np.ascontiguousarray(raw.reshape(4, -1).T).view("<i4").ravel().astype(np.int64)


def pack_tokens(t: Tokens) -> tuple[bytes, bytes, bytes, bytes]:
    """Ids, gaps before tokens, their widths and first tokens of words, each compressed."""
    gaps = t.starts - np.concatenate([[0], t.ends[:-1]])[: len(t.starts)]
    return _pack(t.ids), _pack(gaps), _pack(t.ends - t.starts), _pack(t.firsts)


def unpack_tokens(ids: bytes, gaps: bytes, widths: bytes, firsts: bytes) -> Tokens:
    gaps, widths = _unpack(gaps), _unpack(widths)
    ends = np.cumsum(gaps + widths)
    return Tokens(_unpack(ids), ends - widths, ends, _unpack(firsts).astype(bool))


_OUT = "doc_id bigint, ids binary, decoded string"
# texts of leaves and what is known of their tokens are compressed, as they go through shuffles
_LEAVES = "key binary, segment int, special bigint, leaf int, text binary"
_ENCODED = _LEAVES + ", ids binary, gaps binary, widths binary, firsts binary"


def encode_documents(docs: DataFrame, tokenizer_path: str, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """doc_id, ids (unsigned 32-bit) and their decoded text for every row of docs."""
    model = tokenizer_text(docs.sparkSession, tokenizer_path)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    is_long = F.length("text") > leaf_chars

    def whole(batches):
        encoder = shared(TreeEncoder, model.value)
        for batch in batches:
            doc_ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in slices(texts):
                ids = encoder.ids(texts[a:b])
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.slice(a, b - a), pa.array(ids, pa.binary()), pa.array([encoder.decode(x) for x in ids], pa.string())],
                    names=["doc_id", "ids", "decoded"],
                )

    def split(batches):
        encoder, press = shared(TreeEncoder, model.value), zstandard.ZstdCompressor()
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out = []
                for number, (special, segment) in enumerate(encoder.segments(text)):
                    parts = encoder.leaves(segment, leaf_chars)
                    out += [(key, number, special, i, press.compress(part.encode())) for i, part in enumerate(parts)]
                if out:
                    kinds = [pa.binary(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
                    names = ["key", "segment", "special", "leaf", "text"]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    def encode(batches):
        encoder, press = shared(TreeEncoder, model.value), zstandard.ZstdDecompressor()
        for batch in batches:
            found = []
            for text, special in zip(batch.column(4).to_pylist(), batch.column(2).to_pylist()):
                nothing = Tokens(*[np.zeros(0, dtype=np.int64)] * 4)
                found.append(pack_tokens(encoder.leaf(press.decompress(text).decode()) if special is None else nothing))
            columns = [pa.array(c, pa.binary()) for c in zip(*found)] if found else [pa.array([], pa.binary())] * 4
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "ids", "gaps", "widths", "firsts"])

    def join(group: pa.Table) -> pa.Table:
        encoder, press = shared(TreeEncoder, model.value), zstandard.ZstdDecompressor()
        segments: dict[int, list[dict]] = {}
        for row in sorted(group.to_pylist(), key=lambda r: (r["segment"], r["leaf"])):
            segments.setdefault(row["segment"], []).append(row)
        ids = []
        for own in segments.values():
            if own[0]["special"] is not None:
                ids.append(np.array([own[0]["special"]], dtype=np.int64))
                continue
            parts = [unpack_tokens(r["ids"], r["gaps"], r["widths"], r["firsts"]) for r in own]
            ids.append(encoder.tree([press.decompress(r["text"]).decode() for r in own], parts).ids)
        raw = np.concatenate(ids).astype("<u4").tobytes()
        return pa.table({"key": pa.array([group["key"][0].as_py()], pa.binary()), "ids": pa.array([raw], pa.binary()), "decoded": [encoder.decode(raw)]})

    short = rows.where(~is_long).mapInArrow(whole, _OUT)
    long = rows.where(is_long).select("doc_id", F.unhex(F.md5(F.col("text").cast("binary"))).alias("key"), "text")
    # copies of a text have the same leaves, of which one is kept where it is encoded
    leaves = long.select("key", "text").mapInArrow(split, _LEAVES)
    leaves = leaves.groupBy("key", "segment", "leaf").agg(F.first(F.struct("special", "text")).alias("of"))
    encoded = leaves.select("key", "segment", "of.special", "leaf", "of.text").mapInArrow(encode, _ENCODED)
    trees = stored(encoded.groupBy("key").applyInArrow(join, "key binary, ids binary, decoded string"), "trees")
    # keys of 16 bytes are sent to where the trees lie, if they are few
    keys = broadcast_within(stored(long.select("doc_id", "key"), "tree-keys"))
    return short.unionByName(trees.join(keys, "key").select("doc_id", "ids", "decoded"))
