"""Runs of words that repeat with a period, found on a grammar of each document.

The word ids of a document are compressed by Re-Pair: pairs of neighbouring symbols that
occur again are replaced by a new symbol, the more frequent ones first. Pairs that do
not touch each other are replaced in one round: an occurrence goes if its pair is more frequent than those it overlaps.
A pair that occurs once is never replaced, nor any that would grow from it. So the words of all
documents of a slice go through a few vectorised rounds, which soon work on what repeats only.

A run lies in the expansion of some lowest nonterminal, or in the document as a whole, and
crosses its boundary. As it has at least four periods, two of them lie on one side: there the
expansion has a square at the boundary. Squares are looked for once per nonterminal, at its first
place, and at each boundary between symbols that stay. Names of all stretches of 1, 2, 4, ... words that occur
again in their document tell whether stretches are equal, exactly; they also give how far a square goes on.
What a nonterminal has is translated to all its places, and intervals of equal period that share a period are merged.

Defined results: null and empty texts have no words and no runs. Words are parted by ASCII white space only. Equal ids
and repeated rows are documents of their own. An empty table gives no rows. A document is
worked on by one task, in memory in proportion to its words times the logarithm of its longest
repeated stretch. Columns besides doc_id and text are left out.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A run has at least so many words, and so many periods.
LEAST_WORDS = 6
LEAST_PERIODS = 4
# Words of the documents that are worked on together, at least one document.
WORDS_AT_ONCE = 400_000
# Places of stretches that are compared at once.
PAIRS_AT_ONCE = 4_000_000
# Periods below 2 to this power are tried one by one, longer ones where a stretch occurs again.
_SHORT = 3
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _named(keys: np.ndarray) -> np.ndarray:
    """A number from 0 for each key that occurs more than once; -1 for the others."""
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    again = counts > 1
    names = np.where(again, np.cumsum(again) - 1, -1)
    return names[inverse].astype(np.int32)


class Names:
    """names[j][i]: equal numbers for equal stretches of 2^j words of one document, -1 where it has no other such stretch."""

    def __init__(self, words: np.ndarray, doc: np.ndarray):
        """words: ids, -1 between documents; doc: the number of each word's document."""
        n = len(words)
        self.n, self.levels, self._places = n, [], {}
        first = np.full(n + 1, -1, dtype=np.int32)
        inside = np.flatnonzero(words >= 0)
        if len(inside):
            width = int(words.max()) + 1
            first[inside] = _named(doc[inside] * width + words[inside])
        step = 1
        while (first >= 0).any():
            self.levels.append(first)
            at = np.flatnonzero(first[: n - step] >= 0) if step < n else np.empty(0, dtype=np.int64)
            at = at[first[at + step] >= 0]
            later = np.full(n + 1, -1, dtype=np.int32)
            if len(at):
                later[at] = _named(first[at].astype(np.int64) << 32 | first[at + step])
            first, step = later, 2 * step

    def same(self, j: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        names = self.levels[j]
        found = names[x]
        return (found >= 0) & (found == names[y])

    def places(self, j: int) -> np.ndarray:
        """Sorted: name * (n + 1) + place of each stretch."""
        if j not in self._places:
            at = np.flatnonzero(self.levels[j] >= 0)
            self._places[j] = np.sort(self.levels[j][at].astype(np.int64) * (self.n + 1) + at)
        return self._places[j]

    def forward(self, x: np.ndarray, y: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How many words from x on equal those from y on; y, the later place, stays below end."""
        t = np.zeros_like(x)
        for j in range(len(self.levels) - 1, -1, -1):
            inside = y + t + (1 << j) <= end
            fine = inside & self.same(j, np.where(inside, x + t, 0), np.where(inside, y + t, self.n))
            t += fine.astype(t.dtype) << j
        return t

    def backward(self, x: np.ndarray, y: np.ndarray, start: np.ndarray) -> np.ndarray:
        """How many words before x equal those before y; x, the earlier place, stays from start on."""
        t = np.zeros_like(x)
        for j in range(len(self.levels) - 1, -1, -1):
            to = x - t - (1 << j)
            inside = to >= start
            fine = inside & self.same(j, np.where(inside, to, 0), np.where(inside, y - t - (1 << j), self.n))
            t += fine.astype(t.dtype) << j
        return t


class Grammar:
    """Re-Pair over words whose pairs are named: every replaced place as (rule, start, middle, end)."""

    def __init__(self, names: Names):
        n = names.n
        self.joined = np.zeros(n + 1, dtype=bool)  # boundaries inside a nonterminal
        found, self.rounds = [], 0
        keys, symbols = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        if len(names.levels) > 1:
            pair = names.levels[1][:n] >= 0
            begin = np.flatnonzero(pair | np.concatenate([[False], pair[:-1]]))
            symbol, length = names.levels[0][begin].astype(np.int64), np.ones(len(begin), dtype=np.int64)
            glue, free = pair[begin], int(names.levels[0].max()) + 1
        else:
            begin = symbol = length = np.empty(0, dtype=np.int64)
            glue, free = np.empty(0, dtype=bool), 0
        while glue.any():
            self.rounds += 1
            at = np.flatnonzero(glue)
            key = symbol[at] << 32 | symbol[at + 1]
            kinds, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
            count = counts[inverse]
            glue[at[count < 2]] = False  # and neither will a pair that grows from it occur again
            at, key, inverse, count = (x[count > 1] for x in (at, key, inverse, count))
            if not len(at):
                break
            # ties by a mixed number, as numbers in order of place would let one pair win at a time
            tie = np.argsort(np.argsort(kinds.astype(np.uint64) * _MIX))
            rank = np.full(len(glue) + 2, -1, dtype=np.int64)
            rank[at + 1] = count * len(kinds) + tie[inverse]
            own = rank[at + 1]
            best = np.flatnonzero((own >= rank[at]) & (own >= rank[at + 2]))
            # neighbours that both win are of one pair: every second one goes
            winners = at[best]
            fresh = np.concatenate([[True], np.diff(winners) != 1])
            order = np.arange(len(winners))
            best = best[(order - np.maximum.accumulate(np.where(fresh, order, 0))) % 2 == 0]
            at, key = at[best], key[best]
            wanted = np.unique(key)
            new = wanted[~np.isin(wanted, keys, assume_unique=True)]
            keys, symbols = np.concatenate([keys, new]), np.concatenate([symbols, free + np.arange(len(new))])
            free += len(new)
            by_key = np.argsort(keys)
            keys, symbols = keys[by_key], symbols[by_key]
            rule = symbols[np.searchsorted(keys, key)]
            middle, end = begin[at + 1], begin[at + 1] + length[at + 1]
            self.joined[middle] = True
            found.append((rule, begin[at], middle, end))
            symbol[at], glue[at] = rule, glue[at + 1]
            length[at] += length[at + 1]
            stay = np.ones(len(glue), dtype=bool)
            stay[at + 1] = False
            glue_left = glue[stay]
            near = glue_left | np.concatenate([[False], glue_left[:-1]])
            stay = np.flatnonzero(stay)[near]
            symbol, length, begin, glue = symbol[stay], length[stay], begin[stay], glue[stay]
        none = [np.empty(0, dtype=np.int64)] * 4
        self.rule, self.start, self.middle, self.end = (np.concatenate(x) for x in zip(none, *found))


def _exploded(first: np.ndarray, last: np.ndarray):
    """(row, number) of all numbers first <= number < last of each row, in blocks."""
    counts = np.maximum(last - first, 0)
    total = np.cumsum(counts)
    at = 0
    while at < len(counts):
        before = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, before + PAIRS_AT_ONCE, side="right")))
        own = counts[at:to]
        if n := int(own.sum()):
            row = np.repeat(np.arange(at, to), own)
            yield row, np.arange(n) - np.repeat(total[at:to] - own - before, own) + first[row]
        at = to


def _crossing(names: Names, lo: np.ndarray, b: np.ndarray, hi: np.ndarray):
    """(row, start, end, period) of runs at the boundaries b of the stretches lo to hi, by their squares there."""
    rows, froms, periods = [], [], []

    def keep(row: np.ndarray, x: np.ndarray, q: np.ndarray) -> None:
        rows.append(row), froms.append(x), periods.append(q)

    for j in range(len(names.levels)):
        step, level = 1 << j, names.levels[j]
        right = np.flatnonzero(b + 2 * step <= hi)
        right = right[level[b[right]] >= 0]
        left = np.flatnonzero(b - 2 * step >= lo)
        left = left[level[b[left] - step] >= 0]
        if j < _SHORT:
            for q in range(step, 2 * step):
                row = right[b[right] + 2 * q <= hi[right]]
                x = b[row]
                fine = names.same(j, x, x + q)
                row, x = row[fine], x[fine]
                fine = names.same(j, x + q - step, x + 2 * q - step)
                keep(row[fine], x[fine], np.full(int(fine.sum()), q))
                row = left[b[left] - 2 * q >= lo[left]]
                x = b[row] - q
                fine = names.same(j, x - step, x + q - step)
                row, x = row[fine], x[fine]
                fine = names.same(j, x - q, x)
                keep(row[fine], x[fine], np.full(int(fine.sum()), q))
            continue
        places, wide = names.places(j), names.n + 1
        # right: the stretch at b again, from b + step on, so that two periods fit
        at = level[b[right]].astype(np.int64) * wide
        most = np.minimum(b[right] + 2 * step, (b[right] + hi[right]) // 2 + 1)
        first, last = np.searchsorted(places, at + b[right] + step), np.searchsorted(places, at + most)
        for k, number in _exploded(first, last):
            row, again = right[k], places[number] % wide
            x, q = b[row], again - b[row]
            fine = names.same(j, x + q - step, x + 2 * q - step)
            keep(row[fine], x[fine], q[fine])
        # left: the stretch that ends at b, earlier
        ends = b[left] - step
        at = level[ends].astype(np.int64) * wide
        least = np.maximum(ends - 2 * step + 1, (b[left] + lo[left] + 1) // 2 - step)
        first, last = np.searchsorted(places, at + least), np.searchsorted(places, at + ends - step, side="right")
        for k, number in _exploded(first, last):
            row, again = left[k], places[number] % wide
            q = b[row] - step - again
            x = b[row] - q
            fine = names.same(j, x - q, x)
            keep(row[fine], x[fine], q[fine])
    none = np.empty(0, dtype=np.int64)
    row, x, q = (np.concatenate([none, *parts]) for parts in (rows, froms, periods))
    s = x - names.backward(x, x + q, lo[row])
    e = x + q + names.forward(x, x + q, hi[row])
    fine = e - s >= np.maximum(LEAST_WORDS, LEAST_PERIODS * q)
    return row[fine], s[fine], e[fine], q[fine]


def _merged(s: np.ndarray, e: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of equal period that share at least a period become one; of equal intervals the smallest period stays."""
    if not len(s):
        return s, e, q
    order = np.lexsort((e, s, q))
    s, e, q = s[order], e[order], q[order]
    kind = np.cumsum(np.concatenate([[0], np.diff(q) != 0])) * (int(e.max()) + 1)
    reach = np.maximum.accumulate(kind + e) - kind
    first = np.concatenate([[True], (q[1:] != q[:-1]) | (s[1:] + q[1:] > reach[:-1])])
    at = np.flatnonzero(first)
    s, e, q = s[at], np.maximum.reduceat(e, at), q[at]
    order = np.lexsort((q, e, s))
    s, e, q = s[order], e[order], q[order]
    first = np.concatenate([[True], (s[1:] != s[:-1]) | (e[1:] != e[:-1])])
    return s[first], e[first], q[first]


def find_runs(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length, period) of all runs, in this order, of documents of `sizes` words each."""
    n_docs = len(sizes)
    # a place between documents belongs to none
    doc = np.repeat(np.arange(n_docs), sizes + 1)
    begins = np.concatenate([[0], np.cumsum(sizes + 1)])
    spread = np.full(len(doc), -1, dtype=np.int64)
    inside = np.ones(len(doc), dtype=bool)
    inside[begins[1:] - 1] = False
    spread[inside] = words
    names = Names(spread, doc)
    grammar = Grammar(names)
    kinds, first = np.unique(grammar.rule, return_index=True)
    # boundaries that stay, of documents in which something repeats
    stays = ~grammar.joined[: len(doc)] & inside
    stays[begins[:-1]] = False
    stays = np.flatnonzero(stays)
    lo = np.concatenate([grammar.start[first], begins[doc[stays]]])
    b = np.concatenate([grammar.middle[first], stays])
    hi = np.concatenate([grammar.end[first], begins[doc[stays] + 1] - 1])
    row, s, e, q = _crossing(names, lo, b, hi)
    # runs of a nonterminal, at all its places
    own = row < len(kinds)
    order = np.argsort(grammar.rule, kind="stable")
    place, sorted_rules = grammar.start[order], grammar.rule[order]
    rule = kinds[row[own]]
    parts = [(s[~own], e[~own], q[~own])]
    until = np.searchsorted(sorted_rules, rule, side="right")
    for k, number in _exploded(np.searchsorted(sorted_rules, rule), until):
        by = place[number] - lo[row[own][k]]
        parts.append(_merged(s[own][k] + by, e[own][k] + by, q[own][k]))
    s, e, q = _merged(*(np.concatenate(x) for x in zip(*parts)))
    order = np.lexsort((q, s))
    s, e, q = s[order], e[order], q[order]
    return doc[s], s - begins[doc[s]], e - s, q


def word_numbers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all words of the texts, equal for equal words, and the words of each text."""
    # a mark at both ends, so that white space there parts no empty word
    marked = pc.binary_join_element_wise("|", pc.fill_null(texts, ""), "|", " ")
    split = pc.ascii_split_whitespace(marked)
    sizes = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    numbers = split.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    inside = np.ones(len(numbers), dtype=bool)
    inside[ends - 1] = inside[ends - sizes] = False
    return numbers[inside], sizes - 2


_OUT = "doc_id bigint, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
_FIELDS = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", _RUNS), ("collapsed", pa.string())])


def _collapsed(texts: list[str], sizes: np.ndarray, found) -> list[str]:
    """Words joined by a space, without those that a run has after its first period."""
    doc, start, length, period = found
    out = [None] * len(texts)
    bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
    for i, text in enumerate(texts):
        # the same white space that parts the words
        words = text.encode("utf-8", "surrogatepass").split()
        a, b = bounds[i], bounds[i + 1]
        if a < b:
            step = np.zeros(len(words) + 1, dtype=np.int64)
            np.add.at(step, start[a:b] + period[a:b], 1)
            np.add.at(step, start[a:b] + length[a:b], -1)
            words = [words[k] for k in np.flatnonzero(np.cumsum(step[:-1]) == 0).tolist()]
        out[i] = b" ".join(words).decode("utf-8", "surrogatepass")
    return out


def collapse_runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (start, length and period in words, by start, then period), collapsed text of every row."""

    def runs(batches):
        for batch in batches:
            for a, b in _word_slices(batch.column(1)):
                texts = batch.column(1).slice(a, b - a)
                words, sizes = word_numbers(texts)
                found = find_runs(words, sizes)
                doc, *columns = found
                offsets = np.searchsorted(doc, np.arange(b - a + 1)).astype(np.int32)
                fields = [pa.array(x, type=pa.int64()) for x in columns]
                listed = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(fields, ["start", "length", "period"]))
                plain = [t or "" for t in texts.to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(sizes), listed, pa.array(_collapsed(plain, sizes, found))], schema=_FIELDS
                )

    rows = docs.select(F.col("doc_id").cast("bigint"), F.coalesce(F.col("text").cast("string"), F.lit("")))
    return rows.mapInArrow(runs, _OUT)


def _word_slices(texts: pa.Array):
    """Index ranges of consecutive texts of about WORDS_AT_ONCE words, guessed by bytes."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start, size = 0, 0
    for i, n in enumerate((sizes // 6).tolist()):
        size += n
        if size >= WORDS_AT_ONCE:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes)
