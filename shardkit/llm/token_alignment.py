"""Alignment of the tokens of two tokenizers over the bytes of each text.

A byte-level vocabulary (A) and a sentence-piece vocabulary with byte fallback (B) cut the same bytes, a space and the
text, into tokens. Where tokens of both end, a group ends; tokens whose bytes overlap are linked.

A Fragment is what a range of bytes knows of this: tokens before its first common end (open
prefix), groups that are closed, tokens behind its last common end (open suffix). Two neighbouring fragments make one:
the suffix of the left and the prefix of the right are the group between, or stay open. This
is associative, so that ranges can be put together in any tree.

* Most texts are worked on in one task. Both vocabularies end a token before a space or line feed
  between characters that are no white space; what lies between such places is a fragment without open parts, and is remembered.
* Of a very long text, stretches are encoded as rows of their own. Their tokens are dealt to chunks of so many
  bytes by where they end, wherever that cuts them; each chunk is a fragment, and neighbours are put together
  level by level, a bounded number in a group, until one is left.

How many documents hold a pair of ids linked is counted over the corpus, pre-aggregated in tasks. The
most frequent pairs, as many as a bound allows, go to all tasks; links of other pairs are joined to their counts.

Defined results: texts that are null or empty, and those that the vocabularies do not give back byte for byte, have no
tokens. Special tokens in a text are plain text. Equal ids and repeated rows are documents of their own.
An empty table gives no rows. Columns besides doc_id and text are left out.
"""

import gc
import hashlib
import re
import sys
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shardkit.limits import broadcast_within
from shardkit.llm.common import stored, text_slices
from shardkit.llm.encoder import _WORD, LONGEST_REMEMBERED, Learned, Remembered, byte_letters, library_tokenizer
from shardkit.session import settle

# Texts of more characters are encoded by stretches, and aligned by chunks of so many bytes.
LONG_CHARS = 32_768
CHUNK_BYTES = 16_384
# Neighbouring fragments that one group puts together.
FAN = 4
# Pairs of which every task has the count; a pair takes 13 bytes.
MOST_KNOWN_PAIRS = 1_000_000
# Pieces between spaces that a worker remembers.
REMEMBERED = 250_000
# Bytes of texts worked on together, at least one text.
BYTES_AT_ONCE = 300_000
_SPACE = "▁"
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
_TWO_SPACES = re.compile(r"\s\s")
_NONE = np.empty(0, dtype=np.int64)


def pair_key(a, b):
    """Ids of both as one number; ids of B are below 2^15."""
    return a * 32768 + b


class _Texts:
    """Texts of tokens in a list of groups, by id, side and whether the token is its group's last of its side."""

    def __init__(self, n_a: int, n_b: int):
        self.rows = [b"%d%s" % (i, mark) for n, marks in ((n_a, (b",", b"|")), (n_b, (b",", b";"))) for mark in marks for i in range(n)]
        self.n_a, self.n_b = n_a, n_b

    def of(self, a: np.ndarray, a_last: np.ndarray, b: np.ndarray, b_last: np.ndarray, a_at: np.ndarray, b_at: np.ndarray) -> list[bytes]:
        row = np.empty(len(a) + len(b), dtype=np.int64)
        row[a_at] = a + a_last * self.n_a
        row[b_at] = b + b_last * self.n_b + 2 * self.n_a
        return list(map(self.rows.__getitem__, row.tolist()))


@dataclass
class Open:
    """Consecutive tokens of both vocabularies: ids, and at which bytes they end."""

    a: np.ndarray
    a_ends: np.ndarray
    b: np.ndarray
    b_ends: np.ndarray

    def then(self, other: "Open") -> "Open":
        return Open(*(np.concatenate(x) for x in zip(self.parts(), other.parts())))

    def parts(self) -> tuple[np.ndarray, ...]:
        return self.a, self.a_ends, self.b, self.b_ends

    def any(self) -> bool:
        return len(self.a) + len(self.b) > 0

    def cut(self, i: int, j: int) -> tuple["Open", "Open"]:
        """The first i tokens of A and j of B, and the others."""
        return (
            Open(self.a[:i], self.a_ends[:i], self.b[:j], self.b_ends[:j]),
            Open(self.a[i:], self.a_ends[i:], self.b[j:], self.b_ends[j:]),
        )


NOTHING = Open(_NONE, _NONE, _NONE, _NONE)


@dataclass
class Groups:
    """Groups of tokens whose last ones end together: texts of the tokens in order, and keys of the linked pairs."""

    texts: list[bytes]
    links: np.ndarray
    at: np.ndarray  # byte at which each link's overlap ends
    token_at: np.ndarray  # byte up to which the group of each text reaches


def grouped(tokens: Open, texts: _Texts) -> Groups:
    """All in whole arrays, by flags for the bytes where tokens end."""
    if not tokens.any():
        return Groups([], _NONE, _NONE, _NONE)
    low = int(min(tokens.a_ends[0], tokens.b_ends[0]))
    a_ends, b_ends = tokens.a_ends - low, tokens.b_ends - low
    n = int(a_ends[-1]) + 1
    of_a, of_b = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    of_a[a_ends] = of_b[b_ends] = True
    ends = np.flatnonzero(of_a | of_b)
    # how many tokens of a side end before a byte: the number of the one that holds it
    a_before, b_before = (np.cumsum(x, dtype=np.int32) - x for x in (of_a, of_b))
    links = pair_key(tokens.a[a_before[ends]], tokens.b[b_before[ends]])
    both = of_a & of_b
    group = np.cumsum(both, dtype=np.int32) - both
    close = np.flatnonzero(both)
    a_to, b_to = a_before[close] + 1, b_before[close] + 1
    a_group, b_group = group[a_ends], group[b_ends]
    # a group's tokens of A come before those of B
    b_first = np.concatenate([[0], b_to[:-1]])
    a_at = np.arange(len(a_ends)) + b_first[a_group]
    b_at = np.arange(len(b_ends)) + a_to[b_group]
    found = texts.of(tokens.a, a_to[a_group] == np.arange(1, len(a_ends) + 1), tokens.b, both[b_ends], a_at, b_at)
    token_at = np.empty(len(found), dtype=np.int64)
    token_at[a_at], token_at[b_at] = close[a_group], close[b_group]
    return Groups(found, links, ends + low, token_at + low)


@dataclass
class Fragment:
    """A range of bytes: `prefix` up to the first common end, closed groups, `suffix` behind the last.

    Without a common end (`closed` false) all is prefix.
    """

    prefix: Open
    closed: bool
    groups: list[bytes]  # texts of groups, each with a mark behind it
    links: list[np.ndarray]
    n_a: int  # tokens of closed groups
    n_b: int
    suffix: Open
    fine: bool = True

    def then(self, other: "Fragment", texts: _Texts) -> "Fragment":
        """This range and the one behind it."""
        fine = self.fine and other.fine
        if not self.closed:
            prefix = self.prefix.then(other.prefix)
            return Fragment(prefix, other.closed, other.groups, other.links, other.n_a, other.n_b, other.suffix, fine)
        if not other.closed:
            suffix = self.suffix.then(other.prefix)
            return Fragment(self.prefix, True, self.groups, self.links, self.n_a, self.n_b, suffix, fine)
        between = self.suffix.then(other.prefix)
        found = grouped(between, texts)
        return Fragment(
            self.prefix, True, [*self.groups, *found.texts, *other.groups], [*self.links, found.links, *other.links],
            self.n_a + len(between.a) + other.n_a, self.n_b + len(between.b) + other.n_b, other.suffix, fine,
        )

    def whole(self, texts: _Texts) -> "Fragment":
        """As of a whole text, which starts with a common end of its own."""
        return START.then(self, texts)


START = Fragment(NOTHING, True, [], [], 0, 0, NOTHING)
EMPTY = Fragment(NOTHING, False, [], [], 0, 0, NOTHING)


def fragment(tokens: Open, texts: _Texts) -> Fragment:
    """Of a range's tokens: those that end in it, with their ends."""
    common = np.intersect1d(tokens.a_ends, tokens.b_ends, assume_unique=True)
    if not len(common):
        return Fragment(tokens, False, [], [], 0, 0, NOTHING)
    to = lambda end: (int(np.searchsorted(tokens.a_ends, end)) + 1, int(np.searchsorted(tokens.b_ends, end)) + 1)
    (i, j), (k, m) = to(common[0]), to(common[-1])
    prefix, rest = tokens.cut(i, j)
    inside, suffix = rest.cut(k - i, m - j)
    found = grouped(inside, texts)
    return Fragment(prefix, True, [b"".join(found.texts)], [found.links], len(inside.a), len(inside.b), suffix)


class Aligner:
    """Both tokenizers; ids of pieces between spaces are worked out when first seen."""

    def __init__(self, a_json: str, b_model: bytes):
        import sentencepiece

        self.a = library_tokenizer(a_json)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        self.letters = byte_letters()
        byte_of = {letter: byte for byte, letter in self.letters.items()}
        special = {i: t.content.encode() for i, t in self.a.get_added_tokens_decoder().items()}
        by_id = {i: t for t, i in self.a.get_vocab().items()}
        # a special token's string is spelled as it is; ids that the vocabulary leaves out are never given
        a_bytes = [special.get(i) or bytes(byte_of.get(c, 0) for c in by_id.get(i, "")) for i in range(max(by_id) + 1)]
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_SPACE, " ").encode()
            for i, p in enumerate(self.b.id_to_piece(i) for i in range(len(self.b)))
        ]
        self.a_bytes = a_bytes
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in found], dtype=np.int64) for found in (a_bytes, self.b_bytes))
        self.space = self.b.piece_to_id(_SPACE)
        self.texts = _Texts(len(a_bytes), len(self.b_bytes))
        # an attribute of the library's that is a new object each time
        self.tokenize = self.a.model.tokenize
        # with a letter for each byte, nothing of a text is left out
        self.all_bytes = all(self.a.token_to_id(letter) is not None for letter in self.letters.values())
        self.known = Remembered(REMEMBERED)
        self.words = Learned(self._word, REMEMBERED // 8)

    def _word(self, word: str) -> list[int]:
        """Ids of A of one pre-token of Latin letters, perhaps with a space before it, or of marks."""
        spelled = word.replace(" ", self.letters[32]) if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        return [t.id for t in self.tokenize(spelled)]

    def _a_ids(self, piece: str) -> list[int]:
        found = _WORD.fullmatch(piece)
        if found is None or found[1]:
            return self.a.encode(piece, add_special_tokens=False).ids
        ids = self._word(found[2])
        return ids + self.words[found[3]] if found[3] else ids

    def _b_ids(self, pieces: list[str]) -> list[list[int]]:
        """Ids of stretches of text as they are inside it, where the library would put a space before each."""
        found = self.b.encode([p.removeprefix(" ") for p in pieces], num_threads=1)
        return [ids if p.startswith(" ") and p != " " else [self.space] if p == " " else ids[1:] for p, ids in zip(pieces, found)]

    def token_ids(self, pieces: list[str]) -> tuple[np.ndarray, ...]:
        """Ids of stretches that start with a space or line feed, end to end: of A, of B, where each stretch's end, and which are fine.

        Stretches whose bytes are not given back are not fine.
        """
        a, b = [self._a_ids(p) for p in pieces], self._b_ids(pieces)
        raw = [p.encode() for p in pieces]
        sizes = np.array([len(x) for x in raw], dtype=np.int64)
        rows, fine = [], np.ones(len(pieces), dtype=bool)
        for ids, known, known_sizes in ((a, self.a_bytes, self.a_sizes), (b, self.b_bytes, self.b_sizes)):
            flat = np.array(list(chain.from_iterable(ids)), dtype=np.int64)
            to = np.cumsum(np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)))
            rows += [flat, to]
            if ids is a and self.all_bytes:
                continue
            total = np.concatenate([[0], np.cumsum(known_sizes[flat])])
            fine &= np.diff(total[np.concatenate([[0], to])]) == sizes
            # of equal length each: all are given back if their row is
            if b"".join([known[i] for i in flat.tolist()]) != b"".join(raw):
                fine &= np.array([b"".join([known[i] for i in x]) == y for x, y in zip(ids, raw)], dtype=bool)
        a, a_to, b, b_to = rows
        return a, a_to, b, b_to, fine

    def tokens(self, a: np.ndarray, b: np.ndarray, start: int = 0) -> Open:
        return Open(a, start + np.cumsum(self.a_sizes[a]), b, start + np.cumsum(self.b_sizes[b]))

    def _learned(self, pieces: list[str]) -> list[tuple[bytes, bytes, int, int] | None]:
        """(text of groups, keys of links, tokens of A, tokens of B) of each stretch; None for those not given back."""
        a, a_to, b, b_to, fine = self.token_ids(pieces)
        n_a, n_b = np.diff(a_to, prepend=0), np.diff(b_to, prepend=0)
        a, b = a[np.repeat(fine, n_a)], b[np.repeat(fine, n_b)]
        n_a, n_b = n_a * fine, n_b * fine
        tokens = self.tokens(a, b)
        groups = grouped(tokens, self.texts)
        # all stretches end with a common end
        ends = np.concatenate([[0], tokens.a_ends])[np.cumsum(n_a)]
        links, links_to = groups.links.astype("<u4").tobytes(), (4 * np.searchsorted(groups.at, ends, side="right")).tolist()
        to = np.cumsum(n_a + n_b).tolist()
        return [
            (b"".join(groups.texts[i:j]), links[x:y], n, m) if good else None
            for i, j, x, y, n, m, good in zip([0, *to], to, [0, *links_to], links_to, n_a.tolist(), n_b.tolist(), fine.tolist())
        ]

    @staticmethod
    def stretches(text: str) -> list[str]:
        """Cut before a space or line feed between characters that are no white space; a text that starts with a space."""
        if "\0" in text or _TWO_SPACES.search(text):
            return _CUT.split(text)
        return text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")

    def align(self, texts: list[str | None]) -> list[tuple[int, int, bytes, bytes]]:
        """(n_a, n_b, keys of links in order, text of groups) of each text."""
        # nothing here refers to itself, and collections would walk through all that is remembered
        collecting = gc.isenabled()
        gc.disable()
        try:
            return self._align(texts)
        finally:
            if collecting:
                gc.enable()

    def _align(self, texts: list[str | None]) -> list[tuple[int, int, bytes, bytes]]:
        split = [self.stretches(" " + t) if t else [""] for t in texts]
        new, known, once = [p for p in self.known.missing(set(chain.from_iterable(split))) if p], self.known.now, {}
        known[""] = (b"", b"", 0, 0)
        for piece, found in zip(new, self._learned(new) if new else ()):
            (known if len(piece) <= LONGEST_REMEMBERED else once)[piece] = found
        get = known.__getitem__ if not once else lambda p: known[p] if p in known else once[p]
        out = []
        for pieces in split:
            found = list(map(get, pieces))
            if None in found:
                out.append((0, 0, b"", b""))
                continue
            groups, links, n_a, n_b = zip(*found)
            out.append((sum(n_a), sum(n_b), b"".join(links), b"".join(groups)[:-1]))
        return out

    def stretch(self, text: str, start: int) -> Open | None:
        """Tokens of a stretch of a long text, from byte `start` on; None if its bytes are not given back."""
        pieces = [p for p in self.stretches(text) if p]
        known = list(dict.fromkeys(pieces))
        a, a_to, b, b_to, fine = self.token_ids(known)
        if not fine.all():
            return None
        number = {p: i for i, p in enumerate(known)}
        order = np.array([number[p] for p in pieces], dtype=np.int64)
        return self.tokens(_in_order(a, a_to, order), _in_order(b, b_to, order), start)


def _in_order(ids: np.ndarray, to: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Ids of stretches, which lie end to end up to `to`, in another order and repeated."""
    sizes = np.diff(to, prepend=0)
    own = sizes[order]
    ends = np.cumsum(own)
    return ids[np.arange(ends[-1]) + np.repeat((to - sizes)[order] - (ends - own), own)]


_ALIGNERS = {}


def aligner(model: tuple[str, bytes]) -> Aligner:
    """A worker's aligner, for all its tasks."""
    if _ALIGNERS.get("model") is not model:
        # each task has the broadcast files as objects of its own
        key = hashlib.md5(model[0].encode() + model[1]).digest()
        if _ALIGNERS.get("key") != key:
            _ALIGNERS["tool"] = Aligner(*model)
        _ALIGNERS.update(key=key, model=model)
    return _ALIGNERS["tool"]


def vocabularies(spark: SparkSession, a_path: str, b_path: str):
    """Both files, broadcast: their size does not depend on the data."""
    with open(a_path, encoding="utf-8") as a, open(b_path, "rb") as b:
        return spark.sparkContext.broadcast((a.read(), b.read()))


_ALIGNED = "part int, row bigint, doc_id bigint, n_a bigint, n_b bigint, links binary, groups_sha256 string"
_FOUND = [("n_a", pa.int64()), ("n_b", pa.int64()), ("links", pa.binary()), ("groups_sha256", pa.string())]


def _found_arrays(found: list) -> list[pa.Array]:
    """Of (n_a, n_b, keys of links, text of groups)."""
    n_a, n_b, links, groups = zip(*found)
    sha = [hashlib.sha256(g).hexdigest() if g else "" for g in groups]
    return [pa.array(x, type=t) for x, (_, t) in zip((n_a, n_b, links, sha), _FOUND)]


def _short(rows: DataFrame, model) -> DataFrame:
    def run(batches):
        tool = aligner(model.value)
        for batch in batches:
            for a, b in text_slices(batch.column("text"), BYTES_AT_ONCE):
                part = batch.slice(a, b - a)
                found = _found_arrays(tool.align(part.column("text").to_pylist()))
                ids = [part.column(name) for name in ("part", "row", "doc_id")]
                yield pa.RecordBatch.from_arrays(ids + found, names=["part", "row", "doc_id"] + [n for n, _ in _FOUND])

    return rows.mapInArrow(run, _ALIGNED)


_STRETCHES = "part int, row bigint, doc_id bigint, stretch int, start bigint, text string"
_TOKENS = "part int, row bigint, doc_id bigint, chunk bigint, stretch int, fine boolean, a binary, a_ends binary, b binary, b_ends binary"
_FRAGMENTS = (
    "part int, row bigint, doc_id bigint, node bigint, fine boolean, closed boolean, prefix array<binary>, suffix array<binary>, "
    "groups binary, links binary, n_a bigint, n_b bigint"
)


def _cut_stretches(rows: DataFrame, chunk: int) -> DataFrame:
    """Long texts as rows of consecutive stretches of at least `chunk` characters, where a cut is to be had."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                part, row, doc_id, text = (batch.column(n)[i].as_py() for n in ("part", "row", "doc_id", "text"))
                out, at, start, text = [], 0, 0, " " + text
                while at < len(text):
                    cut = _CUT.search(text, at + chunk) if at + chunk < len(text) else None
                    to = cut.start() if cut else len(text)
                    out.append((part, row, doc_id, len(out), start, text[at:to]))
                    start += len(text[at:to].encode("utf-8", "surrogatepass"))
                    at = to
                columns = [pa.array(x, type=t) for x, t in zip(zip(*out), _STRETCH_TYPES)]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _STRETCHES.split(", ")])

    return rows.mapInArrow(run, _STRETCHES)


_STRETCH_TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string()]


def _raw(x: np.ndarray) -> bytes:
    return x.astype("<i8").tobytes()


def _ints(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype="<i8")


def _chunk_tokens(stretches: DataFrame, model, chunk: int) -> DataFrame:
    """Tokens of each stretch, dealt to chunks of bytes by where they end."""

    def run(batches):
        tool = aligner(model.value)
        for batch in batches:
            for part, row, doc_id, stretch, start, text in zip(*(c.to_pylist() for c in batch.columns)):
                tokens = tool.stretch(text, start)
                if tokens is None:
                    out = [(part, row, doc_id, start // chunk, stretch, False, b"", b"", b"", b"")]
                else:
                    out = []
                    last = int(tokens.a_ends[-1] - 1) // chunk
                    for c in range(start // chunk, last + 1):
                        i, j = (int(np.searchsorted(x, (c + 1) * chunk, side="right")) for x in (tokens.a_ends, tokens.b_ends))
                        own, tokens = tokens.cut(i, j)
                        if own.any():
                            out.append((part, row, doc_id, c, stretch, True, *map(_raw, own.parts())))
                columns = [pa.array(x, type=t) for x, t in zip(zip(*out), _TOKEN_TYPES)]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _TOKENS.split(", ")])

    return stretches.mapInArrow(run, _TOKENS)


_TOKEN_TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), *[pa.binary()] * 4]


def _of_row(r: dict) -> Fragment:
    prefix, suffix = (Open(*map(_ints, x)) for x in (r["prefix"], r["suffix"]))
    return Fragment(prefix, r["closed"], [r["groups"]], [np.frombuffer(r["links"], "<u4")], r["n_a"], r["n_b"], suffix, r["fine"])


_FRAGMENT_FIELDS = pa.schema(
    [("part", pa.int32()), ("row", pa.int64()), ("doc_id", pa.int64()), ("node", pa.int64()), ("fine", pa.bool_()), ("closed", pa.bool_()),
     ("prefix", pa.list_(pa.binary())), ("suffix", pa.list_(pa.binary())), ("groups", pa.binary()), ("links", pa.binary()),
     ("n_a", pa.int64()), ("n_b", pa.int64())]
)


def _to_row(key: tuple, f: Fragment) -> pa.Table:
    """A fragment under its key (part, row, doc_id, node)."""
    prefix, suffix = ([_raw(x) for x in o.parts()] for o in (f.prefix, f.suffix))
    links = np.concatenate([np.empty(0, dtype="<u4"), *f.links]).astype("<u4").tobytes()
    values = (*[k.as_py() for k in key], f.fine, f.closed, prefix, suffix, b"".join(f.groups), links, f.n_a, f.n_b)
    return pa.table([pa.array([v], t) for v, t in zip(values, _FRAGMENT_FIELDS.types)], schema=_FRAGMENT_FIELDS)


def _chunk_fragments(model):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        """A fragment of each chunk, from the tokens that end in it, of the stretches it lies in; neighbours as one."""
        texts, whole, held = aligner(model.value).texts, EMPTY, {}
        for r in rows.sort_by([("chunk", "ascending"), ("stretch", "ascending")]).to_pylist():
            held.setdefault(r["chunk"], []).append(r)
        for own in held.values():
            f = fragment(Open(*(_ints(b"".join(r[c] for r in own)) for c in ("a", "a_ends", "b", "b_ends"))), texts)
            f.fine = all(r["fine"] for r in own)
            whole = whole.then(f, texts)
        return _to_row(key, whole)

    return run


def _put_together(model):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        """Neighbouring fragments as one."""
        texts, f = aligner(model.value).texts, EMPTY
        # the number of a fragment's group hides its own
        for r in rows.sort_by("at").to_pylist():
            f = f.then(_of_row(r), texts)
        return _to_row(key, f)

    return run


def _long(rows: DataFrame, model, chunk: int) -> DataFrame:
    """As _short, for very long texts: over many tasks each."""
    stretches = stored(_cut_stretches(rows, chunk), "stretches")
    spread = stretches.repartition("part", "row", "stretch")
    nodes = _chunk_tokens(spread, model, chunk).groupBy("part", "row", "doc_id", F.floor(F.col("chunk") / FAN).alias("node"))
    nodes = settle(nodes.applyInArrow(_chunk_fragments(model), _FRAGMENTS))
    most = nodes.agg(F.max("node")).first()[0] or 0
    while most > 0:
        groups = nodes.withColumnRenamed("node", "at").groupBy("part", "row", "doc_id", F.floor(F.col("at") / FAN).alias("node"))
        nodes = groups.applyInArrow(_put_together(model), _FRAGMENTS)
        most //= FAN

    def run(batches):
        texts = aligner(model.value).texts
        for batch in batches:
            for i in range(batch.num_rows):
                own = batch.slice(i, 1)
                f = _of_row(own.to_pylist()[0]).whole(texts)
                whole = (f.n_a, f.n_b, np.concatenate([_NONE, *f.links]).astype("<u4").tobytes(), b"".join(f.groups)[:-1])
                found = _found_arrays([whole if f.fine else (0, 0, b"", b"")])
                ids = [own.column(name) for name in ("part", "row", "doc_id")]
                yield pa.RecordBatch.from_arrays(ids + found, names=["part", "row", "doc_id"] + [n for n, _ in _FOUND])

    return nodes.mapInArrow(run, _ALIGNED)


def _numbered(docs: DataFrame) -> DataFrame:
    """Rows with a number of their own: the task and the place in it."""
    number = F.monotonically_increasing_id()
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), number.alias("_id"))
    return rows.select(
        F.shiftright("_id", 33).cast("int").alias("part"), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)).alias("row"), "doc_id", "text"
    )


def align(docs: DataFrame, a_path: str, b_path: str, long_chars: int = LONG_CHARS, chunk: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_a, n_b, links (pair keys, unsigned 32-bit, in order), groups_sha256 of every row, and its number (part, row).

    A stored table. `groups_sha256` is of the groups' ids as a1,a2|b1;a3|b2, and '' without tokens.
    """
    spark = docs.sparkSession
    model = vocabularies(spark, a_path, b_path)
    rows = _numbered(docs)
    is_long = F.coalesce(F.length("text") > long_chars, F.lit(False))
    short = stored(_short(rows.where(~is_long), model), "aligned")
    # stored, as their numbers depend on the tasks that read them; below 0, apart from those of the short ones
    long = stored(rows.where(is_long).withColumn("part", -1 - F.col("part")), "long-texts")
    if long.first() is None:
        return short
    return short.unionByName(stored(_long(long, model, chunk), "aligned-long"))


def _link_slices(links: pa.Array):
    """Parts of a column of links, of some hundred thousand each."""
    for a, b in text_slices(links, BYTES_AT_ONCE):
        yield links.slice(a, b - a)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(key, n): how many documents hold each pair of ids linked. Counted in tasks first."""

    def run(batches):
        # what the worker remembers is needed no more; it refers to itself, so that only a collection frees it
        _ALIGNERS.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        held_keys, held = _NONE, _NONE
        for links in (part for batch in batches for part in _link_slices(batch.column(0))):
            offsets = np.frombuffer(links.buffers()[1], dtype=np.int32)[links.offset : links.offset + len(links) + 1]
            keys = np.frombuffer(links.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]].view("<u4").astype(np.int64)
            doc = np.repeat(np.arange(len(links)), np.diff(offsets) // 4)
            once = np.unique(doc << 32 | keys) & 0xFFFFFFFF
            keys, n = np.unique(once, return_counts=True)
            held_keys, at = np.unique(np.concatenate([held_keys, keys]), return_inverse=True)
            held = np.bincount(at, weights=np.concatenate([held, n]), minlength=len(held_keys)).astype(np.int64)
            if len(held_keys) > 2 * MOST_KNOWN_PAIRS:
                yield pa.RecordBatch.from_arrays([pa.array(held_keys), pa.array(held)], names=["key", "n"])
                held_keys, held = _NONE, _NONE
        yield pa.RecordBatch.from_arrays([pa.array(held_keys), pa.array(held)], names=["key", "n"])

    counted = aligned.select("links").mapInArrow(run, "key bigint, n bigint")
    return stored(counted.groupBy("key").agg(F.sum("n").alias("n")), "pair-counts")


def with_scores(aligned: DataFrame, most_known: int = MOST_KNOWN_PAIRS) -> DataFrame:
    """Adds n_best and count_sum: links of the most frequent partner of their A id, and the counts of all links' pairs."""
    spark = aligned.sparkSession
    counts = pair_counts(aligned)
    best = counts.groupBy(F.shiftright("key", 15).alias("a")).agg(F.max("n").alias("most"))
    scored = counts.withColumn("a", F.shiftright("key", 15)).join(broadcast_within(settle(best)), "a")
    scored = settle(scored.select("key", "n", (F.col("n") == F.col("most")).cast("int").alias("best")))
    # the least count of which all pairs together are within the bound: by powers of two
    by_size = scored.groupBy(F.floor(F.log2("n")).cast("int").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    least, known = 1 << 62, 0
    for r in sorted(by_size.collect(), key=lambda r: -r.k):
        known += r.n
        if known > most_known:
            break
        least = 1 << r.k
    frequent = scored.where(F.col("n") >= least).toArrow().sort_by("key")
    table = spark.sparkContext.broadcast(tuple(frequent[c].to_numpy() for c in ("key", "n", "best")))

    @F.arrow_udf("struct<n_best: bigint, count_sum: bigint, rest: array<struct<key: bigint, times: bigint>>>")
    def score(links: pa.Array) -> pa.Array:
        keys, n, is_best = table.value
        n_best, count_sum, rest, offsets = [], [], [], [0]
        for value in links:
            own = np.frombuffer(value.as_buffer(), dtype="<u4").astype(np.int64)
            if len(keys):
                at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                found = keys[at] == own
                at, unknown = at[found], own[~found]
            else:
                at, unknown = _NONE, own
            n_best.append(int(is_best[at].sum())), count_sum.append(int(n[at].sum()))
            rest.append(np.unique(unknown, return_counts=True))
            offsets.append(offsets[-1] + len(rest[-1][0]))
        key, times = (np.concatenate([_NONE, *x]) for x in (zip(*rest) if rest else ((), ())))
        pairs = pa.StructArray.from_arrays([pa.array(key, pa.int64()), pa.array(times, pa.int64())], ["key", "times"])
        listed = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs)
        return pa.StructArray.from_arrays(
            [pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64()), listed], ["n_best", "count_sum", "rest"]
        )

    found = aligned.withColumn("_s", score("links")).select(*aligned.columns, "_s.*")
    if least <= 1:  # every pair is known
        return found.drop("rest")
    rest = found.select("part", "row", F.explode("rest").alias("r")).select("part", "row", "r.*")
    rare = rest.join(scored.where(F.col("n") < least), "key").groupBy("part", "row").agg(
        F.sum(F.col("times") * F.col("best")).alias("more_best"), F.sum(F.col("times") * F.col("n")).alias("more_sum")
    )
    both = found.drop("rest").join(rare, ["part", "row"], "left")
    add = lambda name, more: F.col(name) + F.coalesce(more, F.lit(0))
    return both.select(*aligned.columns, add("n_best", "more_best").alias("n_best"), add("count_sum", "more_sum").alias("count_sum"))
