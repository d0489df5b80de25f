"""Benchmark decontamination: suffix arrays over shards of the training text, searched for every suffix of the tests."""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import shielded, small_batches

WINDOW = 10
#: Bytes of test items that are sent to the executors at once; more items take further passes over the documents. As
#: numbers of words and a list of distinct words they are smaller than as text.
TEST_BYTES = 8 << 20
#: Words of a shard. A longer document is a shard of its own.
SHARD_WORDS = 200_000
#: Pairs of places in tests and documents whose matches are measured at once.
PAIRS = 1 << 21
#: Lower-cases A-Z and turns what no word holds into spaces: all below x80 but digits and letters.
_TABLE = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in bytes(range(256)).lower())


def split_words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TABLE).split()


@dataclass
class Tests:
    """Test items: their words by number from 1, end to end, and the place of each item's first word."""

    size: int
    vocabulary: dict[bytes, int] = field(default_factory=dict)
    words: array = field(default_factory=lambda: array("i"))
    starts: array = field(default_factory=lambda: array("q"))
    items: list[str] = field(default_factory=list)

    def add(self, item: str, text: bytes | None) -> None:
        self.starts.append(len(self.words))
        self.items.append(item)
        self.words.extend(self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in split_words(text))

    def packed(self) -> tuple:
        """What is sent: arrays, and words and items in one string each."""
        return self.size, b" ".join(self.vocabulary), np.frombuffer(self.words, np.int32).copy(), np.frombuffer(self.starts, np.int64).copy(), self.items


class Search:
    """The suffixes of test items, cut to the window size, in order: each distinct one with its places in the tests."""

    def __init__(self, size: int, vocabulary: bytes, words: np.ndarray, starts: np.ndarray, items: list[str]) -> None:
        self.size, self.items, self.starts = size, items, starts
        self.vocabulary = {w: i for i, w in enumerate(vocabulary.split(), 1)}
        self.bits = max(1, len(self.vocabulary).bit_length())
        ends = np.append(starts[1:], len(words))
        number = np.repeat(np.arange(len(starts)), np.where(ends > starts, np.maximum(1, ends - starts - size + 1), 0))
        place = np.arange(len(number)) - np.searchsorted(number, number) + starts[number]
        length = np.minimum(size, ends[number] - place)
        at = np.arange(size)
        whole = np.where(at < length[:, None], np.concatenate((words, np.zeros(size, np.int32)))[place[:, None] + at], 0).astype(np.int64)
        low = _packed(whole.T, self.bits)
        order = np.lexsort((length, *low[::-1])) if len(place) else np.zeros(0, np.int64)
        key = np.stack([*low, length])[:, order]
        new = np.nonzero(np.concatenate(([True], (np.diff(key) != 0).any(axis=0))))[0] if len(order) else order
        self.lengths = length[order][new]
        self.low = [c[order][new] for c in low]
        top = np.where(at < self.lengths[:, None], whole[order][new], (1 << self.bits) - 1)
        self.high = _packed(top.T, self.bits)
        self.place, self.number, self.first = place[order], number[order], np.append(new, len(order))

    @staticmethod
    def of(sent: tuple) -> Search:
        """The search of what was sent; built once in each worker."""
        if _built.get("of") is not sent:
            _built.update(of=sent, search=Search(*sent))
        return _built["search"]


_built: dict = {}


def _packed(words, bits: int) -> list[np.ndarray]:
    """Columns of words as few columns of 63-bit numbers in the same order."""
    per = 63 // bits
    out = []
    for at in range(0, len(words), per):
        key = np.zeros(len(words[0]), np.int64)
        for k in range(at, at + per):
            key = (key << bits) | (words[k] if k < len(words) else 0)
        out.append(key)
    return out


def _bound(suffixes: list[np.ndarray], wanted: list[np.ndarray], lo: np.ndarray, hi: np.ndarray, right: bool) -> np.ndarray:
    """Binary search of rows of wanted in the rows lo to hi of suffixes, which are in order."""
    lo, hi = lo.copy(), hi.copy()
    while (open_ := lo < hi).any():
        mid = (lo + hi) >> 1
        at = np.minimum(mid, len(suffixes[0]) - 1)
        less = np.zeros(len(lo), bool)
        same = np.ones(len(lo), bool)
        for s, w in zip(suffixes, wanted, strict=True):
            less |= same & (s[at] < w)
            same &= s[at] == w
        if right:
            less |= same
        lo = np.where(open_ & less, mid + 1, lo)
        hi = np.where(open_ & ~less, mid, hi)
    return lo


def suffix_array(ids: np.ndarray, starts: np.ndarray, size: int, bits: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The starts in order of the size words from each on, and those words, packed, in that order."""
    columns = _packed([ids[starts + k] for k in range(size)], bits)
    order = np.lexsort(columns[::-1])
    return starts[order], [c[order] for c in columns]


def occurrences(suffixes: list[np.ndarray], tests: Search) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(test suffix, first, end) of those test suffixes that the suffix array holds, and where."""
    lo = np.searchsorted(suffixes[0], tests.low[0], "left")
    hi = np.searchsorted(suffixes[0], tests.high[0], "right")
    some = np.nonzero(hi > lo)[0]
    pick = lambda columns: [c[some] for c in columns]
    first = _bound(suffixes, pick(tests.low), lo[some], hi[some], False)
    end = _bound(suffixes, pick(tests.high), lo[some], hi[some], True)
    found = end > first
    return some[found], first[found], end[found]


def longest_matches(which: np.ndarray, places: list[np.ndarray], begins: np.ndarray, tests: Search) -> dict[tuple[int, int], tuple[int, int]]:
    """(start, length) of the longest verbatim match of each (document, item), the first of ties, from the places of the
    test suffixes which. Occurrences of following suffixes at following places are one match."""
    counts = np.diff(tests.first)[which]
    sizes = np.array([len(p) for p in places], np.int64)
    flat = np.concatenate(places)
    begin = np.cumsum(sizes) - sizes
    suffix = np.repeat(np.arange(len(which)), counts)  # a row for each test place
    row = np.arange(len(suffix)) - np.repeat(np.cumsum(counts) - counts, counts) + tests.first[which][suffix]
    by_item = np.argsort(tests.number[row], kind="stable")
    suffix, row = suffix[by_item], row[by_item]
    pairs = np.cumsum(sizes[suffix])
    number = tests.number[row]
    edges = np.nonzero(np.concatenate(([True], np.diff(number) != 0)))[0]
    best: dict[tuple[int, int], tuple[int, int]] = {}
    at = 0
    while at < len(edges):  # whole items, of some PAIRS pairs
        limit = (pairs[edges[at] - 1] if edges[at] else 0) + PAIRS
        to = at + 1
        while to < len(edges) and pairs[edges[to] - 1] <= limit and pairs[(edges[to + 1] if to + 1 < len(edges) else len(row)) - 1] <= limit:
            to += 1
        part = slice(edges[at], edges[to] if to < len(edges) else len(row))
        n = sizes[suffix[part]]
        p = flat[np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[suffix[part]], n)]
        t, item, length = (np.repeat(x, n) for x in (tests.place[row[part]], number[part], tests.lengths[which[suffix[part]]]))
        order = np.lexsort((p, p - t, item))
        p, t, item, length = p[order], t[order], item[order], length[order]
        new = np.concatenate(([True], (np.diff(p) != 1) | (np.diff(t) != 1) | (np.diff(item) != 0)))
        first = np.nonzero(new)[0]
        last = np.append(first[1:], len(p)) - 1
        doc, size = np.searchsorted(begins, p[first], "right") - 1, p[last] - p[first] + length[last]
        for d, i, start, size_ in zip(doc.tolist(), item[first].tolist(), (p[first] - begins[doc]).tolist(), size.tolist(), strict=True):
            old = best.get((d, i))
            if old is None or (size_, -start) > (old[1], -old[0]):
                best[d, i] = start, size_
        at = to
    return best


def search_shard(texts: list[list[bytes]], tests: Search) -> list[tuple[np.ndarray, dict[str, tuple[int, int]]]]:
    """For each document, given as words: whether each word is hit, and the items of which a window occurs, each with the
    first word and the length of its longest match."""
    get = tests.vocabulary.get
    sizes = np.array([len(t) for t in texts], np.int64)
    begins = np.concatenate(([0], np.cumsum(sizes + 1)[:-1])).astype(np.int64)
    ids = np.zeros(int(sizes.sum()) + len(texts) + tests.size, np.int64)  # a 0, which no window holds, after each text
    for t, at in zip(texts, begins.tolist(), strict=True):
        ids[at : at + len(t)] = [get(w, 0) for w in t]
    starts = np.nonzero(ids)[0]  # no test suffix starts with another word
    found: list[dict[str, tuple[int, int]]] = [{} for _ in texts]
    marks = np.zeros(len(ids) + 1, np.int64)
    if len(starts) and len(tests.lengths):
        order, suffixes = suffix_array(ids, starts, tests.size, tests.bits)
        which, lo, hi = occurrences(suffixes, tests)
        places = [order[a:b] for a, b in zip(lo, hi, strict=True)]
        for w, at in zip(which, places, strict=True):
            np.add.at(marks, at, 1)
            np.add.at(marks, at + tests.lengths[w], -1)
        if len(which):
            for (d, i), (start, length) in longest_matches(which, places, begins, tests).items():
                old = found[d].get(tests.items[i])
                if old is None or (length, -start) > (old[1], -old[0]):
                    found[d][tests.items[i]] = start, length
    hit = np.cumsum(marks) > 0
    return [(hit[b : b + s], f) for b, s, f in zip(begins, sizes, found, strict=True)]


def _test_blocks(benchmark: DataFrame, id_col: str, text_col: str, size: int, block: int) -> Iterator[Tests]:
    tests, held = Tests(size), 0
    rows = benchmark.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("i"), F.col(f"`{text_col}`").cast("binary").alias("t"))
    for r in rows.toLocalIterator():
        held += len(r["t"] or b"")
        tests.add(r["i"], bytes(r["t"]) if r["t"] is not None else None)
        if held >= block:
            yield tests
            tests, held = Tests(size), 0
    yield tests


@shielded
def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    keep: list[str] | None = None,
    size: int = WINDOW,
    only_clean: bool = False,
    block: int = TEST_BYTES,
) -> DataFrame:
    """Columns of keep (all by default) and __n_words, __n_hit, __items, __spans, __matches for each row.

    A window is size consecutive words of an item, or all words of a shorter one. __items has the items of which a
    window occurs in the text, in order of their ids as strings; __spans the stretches of text that occurrences cover, as
    first words and ends; __n_hit their words; __matches, for each of the items in that order, its longest verbatim
    match: item, first word in the text and number of words. With only_clean rows with a hit go.

    Nulls: a null text has no words, a null item text no windows; a null item id counts as an empty string. Items of
    equal text are all named. Repeated rows are judged alike. Empty tables give no rows or no hits.

    Documents don't move: each task sorts the suffixes of a bounded number of words at a time and searches them for all
    suffixes of the tests. The tests are sent in blocks of bounded size, one pass over the documents for each.
    """
    small_batches(docs.sparkSession)
    keep = docs.columns if keep is None else keep
    out = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").cast("binary").alias("__bytes"))
    fields = [docs.schema[c] for c in keep]
    carried = T.StructType([*fields, T.StructField("__bytes", T.BinaryType()), T.StructField("__n_words", T.LongType()), T.StructField("__items", T.ArrayType(T.StringType())), T.StructField("__spans", T.ArrayType(T.IntegerType())), T.StructField("__places", T.ArrayType(T.IntegerType()))])
    for k, tests in enumerate(_test_blocks(benchmark, item_col, item_text_col, size, block)):
        sent = docs.sparkSession.sparkContext.broadcast(tests.packed())  # at most a block

        def search(batches: Iterator[pa.RecordBatch], sent=sent, first=k == 0) -> Iterator[pa.RecordBatch]:
            width, tests = len(keep) + 1, Search.of(sent.value)
            for batch in batches:
                at = 0
                while at < batch.num_rows:
                    texts, held, end = [], 0, at
                    while end < batch.num_rows and held < SHARD_WORDS:
                        texts.append(split_words(batch.column(width - 1)[end].as_py()))
                        held += len(texts[-1])
                        end += 1
                    part = batch.slice(at, end - at)
                    items, spans, places = [], [], []
                    for j, (hit, found) in enumerate(search_shard(texts, tests)):
                        if not first:
                            old, before, at_ = (part.column(width + k)[j].as_py() for k in (2, 1, 3))
                            for i, start, length in zip(before, at_[::2], at_[1::2], strict=True):
                                found[i] = max((start, length), found.get(i, (0, 0)), key=lambda x: (x[1], -x[0]))
                            for a, b in zip(old[::2], old[1::2], strict=True):
                                hit[a:b] = True
                        edges = np.nonzero(np.diff(np.concatenate(([0], hit, [0])).astype(np.int8)))[0] if hit.any() else []
                        items.append(sorted(found))
                        spans.append([int(e) for e in edges])
                        places.append([int(x) for i in sorted(found) for x in found[i]])
                    arrays = [part.column(i) for i in range(width)]
                    arrays += [pa.array([len(t) for t in texts], pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.int32())), pa.array(places, pa.list_(pa.int32()))]
                    made = pa.RecordBatch.from_arrays(arrays, names=carried.names)
                    if only_clean:
                        made = made.filter(pa.array([not s for s in spans], pa.bool_()))
                    yield made
                    at = end

        out = out.mapInArrow(search, carried)
    hit_words = F.aggregate(F.transform("__spans", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0), lambda a, b: a + b)
    match = F.transform("__items", lambda x, i: F.struct(x.alias("item"), F.get("__places", 2 * i).alias("start"), F.get("__places", 2 * i + 1).alias("length")))
    return out.select(*[F.col(f"`{c}`") for c in keep], "__n_words", hit_words.cast("long").alias("__n_hit"), "__items", "__spans", match.alias("__matches"))
