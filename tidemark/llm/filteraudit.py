"""Filter interaction audit: what each filter of a chain removes, in every order of the filters.

Four filters look at one text; the fifth fails a text that a document with a smaller id has as well. Equal texts are found
by compressed tries: texts are dealt to ranges of adaptive prefixes, each range's texts are put whole into a radix trie
whose terminals hold the smallest id, and a traversal returns the documents that are no duplicates. Every document then
has a mask of the filters it fails; masks are counted for each part, and all orders follow from the counts.
"""

from __future__ import annotations

import itertools
import json
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, shielded, small_batches

FILTERS = "ABCDE"
MIN_WORDS = 50
MIN_DISTINCT_PERCENT = 65
MAX_UPPER_PERCENT = 5
SIGNS = b"#$%&*|"
#: Bytes of texts that a range is to have, and the most ranges: with more text, ranges grow.
RANGE_BYTES = 32 << 20
MOST_RANGES = 65_536
#: Bytes by which a prefix grows in a round, and those beyond it that are searched for more that its texts share (eight
#: times as many in each further round).
STEP = 4
REACH = 64
#: Bytes of all bounds; they are sent to all tasks.
BOUNDS_BYTES = 8 << 20
#: Bytes of texts that a trie, or a task's table of equal texts, holds.
HELD_BYTES = 32 << 20
_SLICE = 1 << 20

_UPPER = bytes(range(65, 91))
_FOLLOWING = bytes(range(128, 192))  # of a code point, the bytes after the first
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def failures(text: bytes) -> int:
    """Mask of the filters A to D (bits 0 to 3) that a text fails."""
    n, distinct, at = 0, set(), 0
    while at < len(text):
        stop = _BLANK.search(text, at + _SLICE) if at + _SLICE < len(text) else None
        end = stop.start() if stop else len(text)
        words = text[at:end].split()  # at x20 and x09 to x0D
        n, at = n + len(words), end
        distinct.update(words)
    points = len(text.translate(None, _FOLLOWING))
    upper = len(text) - len(text.translate(None, _UPPER))
    fails = (n < MIN_WORDS, 100 * len(distinct) < MIN_DISTINCT_PERCENT * n, 100 * upper > MAX_UPPER_PERCENT * points, len(text.translate(None, SIGNS)) < len(text))
    return sum(1 << k for k, bad in enumerate(fails) if bad)


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    most, low, step = min(len(a), len(b)), 0, 16
    while low < most and a[low : low + step] == b[low : low + step]:
        low, step = min(most, low + step), 2 * step
    high = min(most, low + step)
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


class Trie:
    """Compressed trie of byte strings; a terminal holds the least of the values put there."""

    __slots__ = ("edges", "least")

    def __init__(self) -> None:
        self.edges: dict[int, tuple[bytes, Trie]] = {}
        self.least = None

    def insert(self, text: bytes, value) -> None:
        node, at = self, 0
        while at < len(text):
            label, child = node.edges.get(text[at], (b"", None))
            if child is None:
                child = Trie()
                node.edges[text[at]], node, at = (text[at:], child), child, len(text)
            elif text.startswith(label, at):
                node, at = child, at + len(label)
            else:
                n = common(label, text[at : at + len(label)])
                fork = Trie()
                fork.edges[label[n]] = (label[n:], child)
                node.edges[text[at]], node, at = (label[:n], fork), fork, at + n
        node.least = value if node.least is None else min(node.least, value)

    def terminals(self) -> Iterator:
        """Values of all terminals, in the order of their strings."""
        stack = [self]
        while stack:
            node = stack.pop()
            if node.least is not None:
                yield node.least
            stack += [node.edges[c][1] for c in sorted(node.edges, reverse=True)]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's mask, and the sizes and common prefixes of texts with the same first bytes."""
    heads = _Heads({0: 0}, [], REACH)
    for batch in batches:
        masks = []
        for text in batch.column("text").to_pylist():
            masks.append(failures(text))
            heads.add(text)
        none = pa.nulls(len(masks))
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("part"), batch.column("print"), pa.array(masks, pa.int32()), *[none.cast(t) for t in _HEAD_TYPES]], ["id", "part", "print", "mask", *_HEAD_NAMES])
    kinds = [batch.schema.field(c).type for c in ("id", "part", "print")] if "batch" in locals() else None
    if kinds and (rows := heads.rows()):
        yield pa.RecordBatch.from_arrays([*[pa.nulls(len(rows), k) for k in kinds], pa.nulls(len(rows), pa.int32()), *[pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _HEAD_TYPES, strict=True)]], ["id", "part", "print", "mask", *_HEAD_NAMES])


_HEAD_NAMES = ("range", "head", "bytes", "shared", "longest")
_HEAD_TYPES = (pa.int32(), pa.binary(), pa.int64(), pa.binary(), pa.int64())
_HEADS = "range int, head binary, bytes long, shared binary, longest long"


class _Heads:
    """Of the texts in heavy ranges ({range: depth}), one entry for each prefix that is STEP bytes longer than depth.
    Equal texts of a task count once, as they leave it once."""

    def __init__(self, heavy: dict[int, int], bounds: list[bytes], reach: int) -> None:
        self.heavy, self.bounds, self.reach, self.seen, self.found = heavy, bounds, reach, set(), {}

    def add(self, text: bytes) -> None:
        part = bisect_right(self.bounds, text)
        if part not in self.heavy or (mark := hash(text)) in self.seen:
            return
        self.seen.add(mark)
        depth = self.heavy[part]
        head, start = text[: depth + STEP], text[: depth + STEP + self.reach]
        size, shared, longest = self.found.get((part, head), (0, start, 0))
        self.found[part, head] = (size + len(text) + 1, shared[: common(shared, start)], max(longest, len(text)))

    def rows(self) -> list[tuple]:
        return [(p, h, *x) for (p, h), x in self.found.items()]


def _refine(heavy: dict[int, int], bounds: list[bytes], reach: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads = _Heads(heavy, bounds, reach)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                heads.add(text)
        if rows := heads.rows():
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _HEAD_TYPES, strict=True)], _HEAD_NAMES)

    return run


def _pack(target: int):
    """Cuts a run of prefixes into ranges of about target bytes; a heavier prefix is a range by itself, with the depth up
    to which its texts agree (null where they are one text)."""

    def run(table: pa.Table) -> pa.Table:
        out, held = [], None
        for r in sorted(table.to_pylist(), key=lambda r: r["head"]):
            shared = r["low"][: common(r["low"], r["high"])]
            heavy = r["bytes"] > target
            if heavy or held is None or held[1] + r["bytes"] > target:
                held = [r["head"], 0, len(shared) if heavy and r["longest"] > len(shared) else None]
                out.append(held)
            held[1] += r["bytes"]
            held = None if heavy else held
        return pa.table({"head": pa.array([x[0] for x in out], pa.binary()), "bytes": pa.array([x[1] for x in out], pa.int64()), "depth": pa.array([x[2] for x in out], pa.int64())})

    return run


def _packed(heads: DataFrame, target: int) -> list[tuple]:
    """Ranges of heads, packed by heavy range and the next byte of the prefix, neighbours joined up to target."""
    sums = heads.groupBy("range", "head").agg(F.sum("bytes").alias("bytes"), F.min("shared").alias("low"), F.max("shared").alias("high"), F.max("longest").alias("longest"))
    runs = sums.withColumn("run", F.substring(F.col("head"), F.length("head") - STEP + 1, F.lit(1)))
    found = runs.groupBy("range", "run").applyInArrow(_pack(target), "head binary, bytes long, depth long").collect()
    out: list[tuple] = []
    for r in sorted(found, key=lambda r: bytes(r["head"])):
        if out and out[-1][2] is None and r["depth"] is None and out[-1][1] + r["bytes"] <= target:
            out[-1] = (out[-1][0], out[-1][1] + r["bytes"], None)
        else:
            out.append((bytes(r["head"]), r["bytes"], r["depth"]))
    return out


def prefix_bounds(texts: DataFrame, heads: DataFrame) -> list[bytes]:
    """Sorted bounds of the ranges: prefixes grow only where texts weigh more than a range should, and jump over what they
    all share. heads are those of the first bytes. Each round reads the texts again; there are none but the first where
    no prefix of STEP bytes is heavy.
    """
    total = heads.agg(F.sum("bytes")).first()[0] or 0
    target = max(RANGE_BYTES, total // MOST_RANGES)
    found, reach, bounds = _packed(heads, target), REACH, []
    while True:
        bounds = sorted({*bounds, *(head for head, _, _ in found)} - {b""})
        heavy = {bisect_right(bounds, head): depth for head, _, depth in found if depth is not None}
        if not heavy or sum(map(len, bounds)) > BOUNDS_BYTES:
            return bounds
        reach *= 8
        found = _packed(cut(texts.select("text").mapInArrow(_refine(heavy, bounds, reach), _HEADS)), target)


def _combined(bounds: list[bytes]):
    """Equal texts of a task as one row with the least id, and the range it goes to."""

    def out(held: dict[bytes, tuple], kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
        texts = list(held)
        for k in range(0, len(texts), 1000):
            some = texts[k : k + 1000]
            yield pa.RecordBatch.from_arrays([pa.array([bisect_right(bounds, t) for t in some], pa.int32()), pa.array(some, pa.binary()), *[pa.array([held[t][i] for t in some], kinds[i]) for i in range(2)]], ["range", "text", "id", "print"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, kinds = {}, 0, []
        for batch in batches:
            kinds = [batch.schema.field(c).type for c in ("id", "print")]
            for text, value in zip(batch.column("text").to_pylist(), zip(batch.column("id").to_pylist(), batch.column("print").to_pylist(), strict=True), strict=True):
                if text in held:
                    held[text] = min(held[text], value)
                    continue
                held[text], size = value, size + len(text) + 100
                if size > HELD_BYTES:
                    yield from out(held, kinds)
                    held, size = {}, 0
        yield from out(held, kinds)

    return run


def _tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The least value of each text, from tries of sorted texts. A full trie is traversed once another text follows."""
    trie, size, last, kinds, done = Trie(), 0, None, [], []
    for batch in batches:
        kinds = [batch.schema.field(c).type for c in ("id", "print")]
        for text, i, mark in zip(*(batch.column(c).to_pylist() for c in ("text", "id", "print")), strict=True):
            if text != last:
                if size > HELD_BYTES:
                    done, trie, size = [*trie.terminals()], Trie(), 0
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*done, strict=True), kinds, strict=True)], ["id", "print"])
                last, size = text, size + len(text) + 200
            trie.insert(text, (i, mark))
    if done := [*trie.terminals()]:
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*done, strict=True), kinds, strict=True)], ["id", "print"])


def first_copies(texts: DataFrame, bounds: list[bytes]) -> DataFrame:
    """Rows (id, print) of the smallest id of each text; texts has id, print and text (binary)."""
    id_kind = texts.schema["id"].dataType.simpleString()
    rows = texts.filter("id IS NOT NULL").mapInArrow(_combined(bounds), f"range int, text binary, id {id_kind}, print long")
    dealt = rows.repartitionById(len(bounds) + 1, "range").sortWithinPartitions("text")
    return dealt.select("text", "id", "print").mapInArrow(_tries, f"id {id_kind}, print long")


@shielded
def failure_masks(docs: DataFrame, text: str = "text", key: str = "doc_id", part: str = "source", keep: list[str] | None = None) -> DataFrame:
    """Rows (__id, __part, __mask): a bit for each of the filters A to E that a document fails.

    Null texts are empty ones and null parts the empty part. A null id is smaller than none and fails E never; rows with
    the same id and text are no duplicates of each other. Texts of any length are taken whole. Of a hot text each task
    sends one row (one more for each HELD_BYTES of other texts). An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    texts = docs.select(F.col(f"`{key}`").alias("id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), F.xxhash64(body).alias("print"), body.alias("text"))
    id_kind = texts.schema["id"].dataType.simpleString()
    scanned = cut(texts.mapInArrow(_scan, f"id {id_kind}, part string, print long, mask int, {_HEADS}"))
    bounds = prefix_bounds(texts, scanned.filter("mask IS NULL").select(*_HEAD_NAMES))
    firsts = first_copies(texts.select("id", "print", "text"), bounds).withColumn("first", F.lit(True))
    masks = scanned.filter("mask IS NOT NULL").select("id", "part", "print", "mask").join(firsts, ["id", "print"], "left")
    copy = F.when(F.col("id").isNotNull() & F.col("first").isNull(), 16).otherwise(0)
    return masks.select(F.col("id").alias("__id"), F.col("part").alias("__part"), F.col("mask").bitwiseOR(copy).alias("__mask"))


def mask_counts(masks: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows (part, mask, n, good, toxic). A document is good, or toxic, where a row of labels for its id says so."""
    known = labels.groupBy(F.col(f"`{key}`").alias("__id")).agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("__good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("__toxic"))
    rows = masks.join(known, "__id", "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return rows.groupBy(F.col("__part").alias("part"), F.col("__mask").alias("mask")).agg(F.count(F.lit(1)).alias("n"), total("__good").alias("good"), total("__toxic").alias("toxic"))


def all_orders(counts: DataFrame) -> DataFrame:
    """For each part, order of the filters and step, the counts of the filter of that step.

    counts has 32 rows a part at the most. A filter's Shapley share of a document is the number of orders in which it is
    the first of those that the document fails: all orders over the number of its failures.
    """
    steps = []
    for order in itertools.permutations(range(len(FILTERS))):
        before = 0
        for k, f in enumerate(order):
            steps.append({"o": "".join(FILTERS[x] for x in order), "k": k + 1, "bit": 1 << f, "before": before})
            before |= 1 << f
    orders = F.from_json(F.lit(json.dumps(steps)), "array<struct<o: string, k: int, bit: int, before: int>>")
    rows = counts.select("*", F.explode(orders).alias("s")).withColumn("fails", F.col("mask").bitwiseAND(F.col("s.bit")) != 0).withColumn("gone", F.col("mask").bitwiseAND(F.col("s.before")) != 0)
    here = F.col("fails") & ~F.col("gone")
    count = lambda when, value="n": F.sum(F.when(when, F.col(value)).otherwise(0)).cast("long")
    n_orders = len(steps) // len(FILTERS)
    return rows.groupBy("part", F.col("s.o").alias("filter_order"), F.col("s.k").alias("step")).agg(
        count(~F.col("fails") & ~F.col("gone")).alias("kept"), count(here).alias("removed"), count(F.col("fails") & F.col("gone")).alias("redundant"),
        count(F.col("mask") == F.col("s.bit")).alias("unique_fails"), count(here, "good").alias("good_lost"), count(here, "toxic").alias("toxic_lost"),
        F.sum(F.when(F.col("fails"), F.col("n") * F.expr(f"{n_orders} div bit_count(mask)")).otherwise(0)).cast("long").alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", part: str = "source") -> DataFrame:
    """What each filter does in every order, for each part (see failure_masks, mask_counts, all_orders).

    Repeated rows of labels for an id count once, labels of unknown or null ids not at all. No documents give no rows.
    """
    return all_orders(mask_counts(failure_masks(docs, text, key, part), labels, key))
