"""Documents of similar shingles: a prefix filter finds every pair at or over a Jaccard similarity; each is verified."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import cut, small_batches
from tidemark.llm.components import components

#: Members of a key's group that are compared in one task (twice as many at most); pairs of one text verified in one task.
BLOCK = 2048
PAIRS = 1024
#: Members of a key's group over which its rows carry bitmaps, which tell most dissimilar pairs without their texts; and the
#: least and most bits of a bitmap, which has four or more for each shingle up to the most.
HOT = 32
LEAST_BITS, MOST_BITS = 1 << 8, 1 << 14
#: Times that the nearest pairs of large groups are verified before all others.
ROUNDS = 2
#: Hashes of which sets with the same least one are compared first, and rows of one key that are held back in a task.
MIN_HASHES = 4
HELD = 1 << 14
#: Nodes that are sent to all tasks at once; more are joined by a shuffle.
SENT_NODES = 2_000_000
#: Bits of the sketch that orders shingles by frequency, and counters of it that are summed at once.
_BITS = 20
_CHUNK = 1 << 11
_P = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes, size: int = 5) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct shingles; of all its words if there are fewer than size."""
    w = text.lower().split()  # of bytes: A-Z alone, and x20 and x09 to x0D
    if not w:
        return np.zeros(0, np.uint64)
    words = np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, len(w))
    n = max(1, len(w) - size + 1)
    h = np.zeros(n, np.uint64)
    for k in range(min(size, len(w))):
        h = (h ^ h >> np.uint64(29)) * _P + words[k : k + n]
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return np.unique(h ^ h >> np.uint64(31))


def _node(s: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(s.tobytes())).astype(np.int64))


def nodes_of(texts: list[bytes | None], size: int) -> list[int]:
    """Hash of each text's set of shingles."""
    return [_node(shingles(t or b"", size)) for t in texts]


def fingerprint(s: np.ndarray) -> int:
    """SimHash of a set of hashes, as a signed number: a bit is set if over half of the hashes set it."""
    bits = np.unpackbits(s.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(s), bitorder="little").view("<i8")[0])


def _sets(narrow: DataFrame, kind: T.DataType, size: int) -> DataFrame:
    """Stored rows (id, node, place, fp, mins, packed): each row's hash of its set of shingles; and where a task sees a set
    for the first time, its size in the upper half of place, its SimHash, its least hashes and the text, compressed."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        pack = zstandard.ZstdCompressor()
        for batch in batches:
            nodes, places, fps, mins, packed = [], [], [], [], []
            for t in batch.column(1).to_pylist():
                s = shingles(t or b"", size)
                nodes.append(node := _node(s))
                new = len(s) > 0 and node not in seen
                seen.add(node)
                places.append(len(s) << 32 if new else None)
                fps.append(fingerprint(s) if new else None)
                mins.append([int(x) for x in np.array([((s * (_P * np.uint64(2 * k + 1))) ^ np.uint64(k)).min() for k in range(1, MIN_HASHES + 1)], np.uint64).view(np.int64)] if new else None)
                packed.append(pack.compress(t) if new else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes, pa.int64()), pa.array(places, pa.int64()), pa.array(fps, pa.int64()), pa.array(mins, pa.list_(pa.int64())), pa.array(packed, pa.binary())], ["id", "node", "place", "fp", "mins", "packed"])

    fields = [T.StructField("id", kind), *[T.StructField(n, T.LongType()) for n in ("node", "place", "fp")], T.StructField("mins", T.ArrayType(T.LongType())), T.StructField("packed", T.BinaryType())]
    return cut(narrow.mapInArrow(hashed, T.StructType(fields)))


def _rarity(sets: DataFrame, size: int) -> np.ndarray:
    """A level for each value of a hash's upper bits that rises with the number of shingles there. It only orders
    shingles, the rare ones first; results don't depend on it."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, unpack = np.zeros(1 << _BITS, np.int64), zstandard.ZstdDecompressor()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                np.add.at(counts, (shingles(unpack.decompress(t), size) >> np.uint64(64 - _BITS)).astype(np.int64), 1)
        if counts.any():
            parts = np.minimum(counts, 65535).astype("<u2").reshape(-1, _CHUNK)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], ["part", "counts"])

    def summed(table: pa.Table) -> pa.Table:
        total = np.zeros(_CHUNK, np.int64)
        for c in table.column("counts").to_pylist():
            total += np.frombuffer(c, "<u2")
        return pa.table([table.column("part").slice(0, 1), pa.array([np.minimum(255, 8 * np.log2(1 + total)).astype(np.uint8).tobytes()], pa.binary())], ["part", "levels"])

    rows = sets.select("packed").mapInArrow(counted, "part int, counts binary").groupBy("part").applyInArrow(summed, "part int, levels binary").collect()  # 1 MB
    return np.frombuffer(b"".join(r["levels"] for r in sorted(rows, key=lambda r: r["part"])), np.uint8) if rows else np.zeros(1 << _BITS, np.uint8)


def _may_reach(x: np.ndarray, y: np.ndarray, least: Fraction) -> np.ndarray:
    """Whether sets can be similar enough of which x and y are the places of the first common shingle: the size in the
    upper half, the rank in order in the lower."""
    n, i, m, j = x >> 32, x & 0xFFFFFFFF, y >> 32, y & 0xFFFFFFFF
    most = np.minimum(n - i, m - j)
    return most * least.denominator >= least.numerator * (n + m - most)


def parities(s: np.ndarray) -> bytes:
    """For each bit whether an odd number of the set's hashes fall on it. A shingle in one of two sets turns one bit, so
    the sets differ in as many shingles as their bitmaps differ in bits, or in more."""
    bits = min(max(LEAST_BITS, 1 << (4 * len(s) - 1).bit_length()), MOST_BITS)
    return np.packbits(np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


class _Bitmaps:
    """The bitmaps of rows, None where a row has none, folded to the widths at which pairs are compared."""

    def __init__(self, bits: list[bytes | None]):
        self.width = np.array([len(b or b"") for b in bits], np.int64)
        self.at: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for w in np.unique(self.width[self.width > 0]).tolist():
            rows = np.nonzero((self.width == w) | (self.width == 2 * w))[0]
            place = np.full(len(bits), -1)
            place[rows] = np.arange(len(rows))
            self.at[w] = place, np.stack([np.bitwise_xor.reduce(np.frombuffer(bits[r], np.uint64).reshape(-1, w // 8), axis=0) for r in rows.tolist()])

    def differ(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The shingles that differ at least between the sets of rows x and y. Sets so different in size that their widths
        differ by more than a factor of two are not asked for."""
        low, out = np.minimum(self.width[x], self.width[y]), np.zeros(len(x), np.int64)
        for w, (place, words) in self.at.items():
            mine = np.nonzero(low == w)[0]
            out[mine] = np.bitwise_count(words[place[x[mine]]] ^ words[place[y[mine]]]).sum(axis=1, dtype=np.int64)
        return out


def _spanning(x: np.ndarray, y: np.ndarray, far: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Which pairs of rows x and y, nearest first, join all roots that the pairs join: fewer than there are roots."""
    order, top = np.argsort(far, kind="stable"), np.unique(root, return_inverse=True)[1]
    ends, parent, kept = np.stack([top[x[order]], top[y[order]]], axis=1), np.arange(len(root)), []

    def find(v: int) -> int:
        while (p := parent[v]) != v:
            parent[v] = v = parent[p]
        return v

    while True:
        apart = parent[ends[:, 0]] != parent[ends[:, 1]]
        order, ends = order[apart], ends[apart]
        if not len(order):
            return np.array(kept, np.int64)
        for e in np.unique(np.unique(parent[ends].ravel(), return_index=True)[1] // 2).tolist():  # each tree's nearest pair
            if (a := find(int(ends[e, 0]))) != (b := find(int(ends[e, 1]))):
                parent[max(a, b)] = min(a, b)
                kept.append(int(order[e]))
        while (parent[parent] != parent).any():
            parent[:] = parent[parent]


def _emit(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    pairs = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], axis=1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(pairs.min(axis=1)), pa.array(pairs.max(axis=1))], ["a", "b"])


def _columns(batch: pa.RecordBatch, n: int) -> np.ndarray:
    return np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(n)])


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, node, place, root) in order of key, root and node those whose key has several roots; each once.
    Where a key's rows of one root are more than a batch they pass as they are."""
    names, held, passed = ["key", "node", "place", "root"], None, None
    pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(x) for x in rows], names)
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = _columns(batch, 4)
        if held is not None:
            rows = np.concatenate((held, rows), axis=1)
        rows = rows[:, np.concatenate(([True], (np.diff(rows[:2]) != 0).any(axis=0)))]
        starts = np.nonzero(np.concatenate(([True], np.diff(rows[0]) != 0)))[0]
        many = rows.shape[1] - starts[-1] >= HELD
        last = rows.shape[1] - 1 if many else starts[-1]  # the last key waits for the next batch, or its last row
        held, rows, starts = rows[:, last:], rows[:, :last], starts[starts < last]
        if rows.shape[1]:
            ends = np.append(starts[1:], rows.shape[1]) - 1
            keep = (rows[3][starts] != rows[3][ends]) | (rows[0][starts] == passed if passed is not None else False)
            keep[-1] |= many
            yield pack(rows[:, np.repeat(keep, ends - starts + 1)])
        passed = held[0, 0] if many or held[0, 0] == passed else None
    if held is not None and (held[3, 0] != held[3, -1] or held[0, 0] == passed):
        yield pack(held)


def _stars(least: Fraction):
    """From rows (key, node, place) or (key, node, place, root), in order of key and node or of key, root and node: the
    pairs of each group's first member and the others, or of its first root's first member and those of other roots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _columns(batch, batch.num_columns)
            fresh = np.ones(rows.shape[1], bool)  # a root's first row of the key, or any row
            if len(rows) > 3:
                fresh = np.concatenate(([last is None or last[0] != rows[0, 0] or last[3] != rows[3, 0]], (np.diff(rows[[0, 3]]) != 0).any(axis=0)))
                last = rows[:, -1].copy()
            if first is not None:
                rows, fresh = np.concatenate((first, rows), axis=1), np.concatenate(([False], fresh))
            starts = np.concatenate(([True], np.diff(rows[0]) != 0))
            head = rows[:, np.maximum.accumulate(np.where(starts, np.arange(len(starts)), 0))]
            first = head[:, -1:]
            ok = ~starts & fresh & (rows[1] != head[1]) & _may_reach(head[2], rows[2], least)
            if ok.any():
                yield _emit([head[1][ok]], [rows[1][ok]])

    return run


def _cross(least: Fraction, spanning: bool = False):
    """From rows (group, node, place, root, bits) in order of group: pairs of different roots that can be similar enough;
    or of those only as many as join what all of them join, the nearest."""

    def pairs(rows: np.ndarray, bits: list[bytes | None]) -> Iterator[pa.RecordBatch]:
        group, node, place, root = rows
        maps, at, d, found, size = _Bitmaps(bits), np.arange(len(group)), 1, [], 0
        while True:
            at = at[at + d < len(group)]
            at = at[group[at] == group[at + d]]
            if len(at):
                x = at[(root[at] != root[at + d]) & _may_reach(place[at], place[at + d], least)]
                y, differ = x + d, maps.differ(x, x + d)
                sizes = (place[x] >> 32) + (place[y] >> 32)
                ok = (least.denominator + least.numerator) * differ <= (least.denominator - least.numerator) * sizes
                found.append((x[ok], y[ok], differ[ok] / sizes[ok]))
                size += len(found[-1][0])
                d += 1
            if size > 1 << 18 or size and not len(at):
                x, y, far = (np.concatenate(v) for v in zip(*found, strict=True))
                if spanning:
                    near = _spanning(x, y, far, root)
                    x, y, far = x[near], y[near], far[near]
                found, size = ([(x, y, far)] if spanning and len(at) else []), 0
                if not found:
                    yield _emit([node[x]], [node[y]])
            if not len(at):
                break

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, bits = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = _columns(batch, 4)
            bits += batch.column(4).to_pylist()
            if held is not None:
                rows = np.concatenate((held, rows), axis=1)
            whole = int(np.searchsorted(rows[0], rows[0, -1]))
            held = rows[:, whole:]
            yield from pairs(rows[:, :whole], bits[:whole])
            bits = bits[whole:]
        if held is not None:
            yield from pairs(held, bits)

    return run


def _verify(size: int, least: Fraction):
    """From rows (a, p, b, text) in order of a, p and b, where a's own has no b: the pairs that are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine, unpack = np.zeros(0, np.uint64), zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for a, b, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                own = shingles(unpack.decompress(text), size)
                if b is None:
                    mine = own
                    continue
                both = len(np.intersect1d(mine, own, assume_unique=True))
                if both * least.denominator >= least.numerator * (len(mine) + len(own) - both):
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def _stored(df: DataFrame) -> DataFrame:
    """Stored rows; Spark's cleaner may drop the shuffle files of steps that led to stored ones before."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return cut(df)


def _min_keys(sets: DataFrame, least: Fraction) -> DataFrame:
    """Pairs (a, b) of sets that share one of a few least hashes: of each such group its first member with the others.
    Most near copies are joined by them, at a few pairs for each set."""
    keys = sets.select(F.explode("mins").alias("key"), "node", "place")
    return keys.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_stars(least), "a long, b long")


def _close_prints(sets: DataFrame, search: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Pairs (a, b) of sets that the search finds by their SimHashes, and of sets of one SimHash the first with the others."""
    prints = sets.groupBy("node").agg(F.min("fp").alias("fp"))
    first = prints.groupBy("fp").agg(F.min("node").alias("a"))
    same = prints.join(first, "fp").filter("a <> node").select("a", F.col("node").alias("b"))
    return search(first.select(F.col("a").alias("node"), F.array("fp").alias("fps"))).select("a", "b").unionByName(same)


def _shared_keys(sets: DataFrame, roots: DataFrame, size: int, least: Fraction) -> DataFrame:
    """Stored rows (key, node, place, root) of the first shingles of each set that sets of other components have among
    theirs. A function of its own, as are the next ones: the frames that lead to a stored table keep its shuffle files."""
    levels = sets.sparkSession.sparkContext.broadcast(_rarity(sets, size))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = list(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
            for at in range(0, len(rows), 512):
                keys, nodes, places, tops = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
                for node, t, root in rows[at : at + 512]:
                    s = shingles(unpack.decompress(t), size)
                    part = len(s) - -(-least.numerator * len(s) // least.denominator) + 1
                    order = np.argsort(levels.value[(s >> np.uint64(64 - _BITS)).astype(np.int64)], kind="stable")
                    keys.append(s[order[:part]].view(np.int64))
                    nodes.append(np.full(part, node))
                    places.append(np.int64(len(s)) << 32 | np.arange(part))
                    tops.append(np.full(part, root))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, nodes, places, tops)], ["key", "node", "place", "root"])

    sent = F.broadcast(roots) if roots.limit(SENT_NODES + 1).count() <= SENT_NODES else roots
    rooted = sets.select("node", "packed").join(sent, "node", "left").select("node", "packed", F.coalesce("root", "node").alias("root"))
    keys = rooted.mapInArrow(hashed, "key long, node long, place long, root long")
    return _stored(keys.repartition("key").sortWithinPartitions("key", "root", "node").mapInArrow(_shared, "key long, node long, place long, root long"))


def _texts(sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """Stored rows (node, s): a compressed text of each of the nodes, which may repeat."""
    needed = cut(nodes.distinct())
    sent = F.broadcast(needed) if needed.count() <= SENT_NODES else needed
    return _stored(sets.select("node", F.col("packed").alias("s")).join(sent, "node", "left_semi").groupBy("node").agg(F.first("s").alias("s")))


def _bitmaps(sets: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """Rows (node, bits): the bitmap of each of the nodes."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            bits = [parities(shingles(unpack.decompress(t), size)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.binary())], ["node", "bits"])

    return _texts(sets, nodes).mapInArrow(made, "node long, bits binary")


def _verified(sets: DataFrame, pairs: DataFrame, size: int, least: Fraction) -> DataFrame:
    """Stored pairs (a, b) that are similar enough, of rows (a, b)."""
    pairs = _stored(pairs.distinct())
    texts = _texts(sets, pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))))
    tasks = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PAIRS).alias("k"))
    dealt = pairs.join(tasks, "a").select("a", F.pmod(F.xxhash64("b"), F.col("k")).cast("long").alias("p"), "b")
    own = dealt.select("a", "p").distinct().join(texts.withColumnRenamed("node", "a"), "a").select("a", "p", F.lit(None).cast("long").alias("b"), "s")
    rows = own.unionByName(dealt.join(texts.withColumnRenamed("node", "b"), "b").select("a", "p", "b", "s"))
    return _stored(rows.repartition("a", "p").sortWithinPartitions("a", "p", F.asc_nulls_first("b")).mapInArrow(_verify(size, least), "a long, b long"))


def _hot_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The keys that more than HOT rows have, of rows (key) in order."""
    last, n = None, 0
    for batch in batches:
        if batch.num_rows:
            keys, counts = np.unique(batch.column(0).to_numpy(zero_copy_only=False), return_counts=True)
            counts[0] += n if keys[0] == last else 0
            hot = keys[counts > HOT]
            if len(hot) and hot[0] == last and n > HOT:
                hot = hot[1:]  # given out with a batch before
            last, n = keys[-1], counts[-1]
            yield pa.RecordBatch.from_arrays([pa.array(hot)], ["key"])


def _hot_rows(sets: DataFrame, shared: DataFrame, hot: DataFrame, size: int) -> DataFrame:
    """Stored rows (key, node, place, root, bits) of the hot keys."""
    rows = shared.join(hot, "key", "left_semi")
    return _stored(rows.join(_bitmaps(sets, rows.select("node"), size), "node").select("key", "node", "place", "root", "bits"))


def _cross_pairs(rows: DataFrame, roots: DataFrame, least: Fraction, spanning: bool = False) -> DataFrame:
    """Pairs (a, b) of a key that are in different components, or as many as may join these; of rows (key, node, place,
    root, bits)."""
    moved = roots.toDF("root", "top")
    rooted = rows.join(F.broadcast(moved) if moved.limit(SENT_NODES + 1).count() <= SENT_NODES else moved, "root", "left").select("key", "node", "place", F.coalesce("top", "root").alias("root"), "bits")
    groups = rooted.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("k"), F.min("root").alias("r"), F.max("root").alias("q")).filter("r <> q").drop("r", "q")
    own = rooted.join(groups, "key").withColumn("p", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    own = own.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("k") - 1))).withColumn("group", F.when(F.col("k") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("p", "q"), F.greatest("p", "q"))))
    return own.select("group", "node", "place", "root", "bits").repartition("group").sortWithinPartitions("group").mapInArrow(_cross(least, spanning), "a long, b long")


def similar_documents(docs: DataFrame, search: Callable[[DataFrame], DataFrame], id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """Rows (id, __node, __component, __keeper) of all documents: the hash of the text's set of shingles, the smallest id
    of the group, and of that id's sets in the group the smallest hash.

    Documents are linked if the Jaccard similarity of their sets of shingles is similarity or more, and grouped over any
    number of links. No such pair is missed: in any one order of all shingles, the first ones of both sets, by as many as
    may differ, hold a common one. Rare shingles are the first, so that groups of a key are small. Every link is verified
    on the whole sets.

    Documents of equal sets are one vertex. Pairs whose SimHashes search finds close, of rows (node, fps), are compared
    first, with sets that have a least hash in common (MIN_HASHES of them), one of each group with the others, so that
    large groups of near copies are joined at a few pairs for each. What SimHash can't find the prefix filter does: keys
    count only where they have members of different components: first one member of each, then, in large groups, the
    nearest pairs that may join them, a few times, then all that still differ. In large groups bitmaps tell pairs that differ
    too much, so that texts just below the similarity don't give the square of their number in pairs; no similar pair is
    rejected by them. At 0.8, sets of more than 36,864 shingles aren't told by them: their pairs are all verified.

    Nulls: a null text has no shingles and is linked to other texts without; a row with a null id is grouped, but no
    group takes its name from it. Repeated rows are each returned. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    kind, least = docs.schema[id_col].dataType, Fraction(str(similarity))
    narrow = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("t"))

    base = _sets(narrow, kind, shingle)
    prints, sets = base.select("id", "node"), base.filter("packed IS NOT NULL")
    links = _verified(sets, _close_prints(sets, search).unionByName(_min_keys(sets, least)), shingle, least)
    near = components(links, store=_stored)
    shared = _shared_keys(sets, near, shingle, least)
    more = _verified(sets, shared.mapInArrow(_stars(least), "a long, b long"), shingle, least)  # partitions keep their order
    name = lambda links, end: links.join(near.toDF(end, f"{end}r"), end, "left").withColumn(end, F.coalesce(f"{end}r", end)).drop(f"{end}r")
    tops = components(name(name(more, "a"), "b"), store=_stored)  # of components
    keys = cut(shared.select("key").mapInArrow(_hot_keys, "key long"))
    keys = F.broadcast(keys) if keys.count() <= SENT_NODES else keys
    hot = _hot_rows(sets, shared, keys, shingle)
    for _ in range(ROUNDS if hot.limit(1).count() else 0):
        new = _verified(sets, _cross_pairs(hot, tops, least, spanning=True), shingle, least)
        if not new.limit(1).count():
            break
        more = more.unionByName(new)
        tops = components(name(name(more, "a"), "b"), store=_stored)
    rest = hot.unionByName(shared.join(keys, "key", "left_anti").withColumn("bits", F.lit(None).cast("binary")))
    links = links.unionByName(more).unionByName(_verified(sets, _cross_pairs(rest, tops, least), shingle, least))
    roots = components(links, store=_stored)
    nodes = prints.groupBy("node").agg(F.min("id").alias("first")).join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    keepers = nodes.filter("first IS NOT NULL").groupBy("root").agg(F.min(F.struct("first", "node")).alias("k"))
    named = nodes.join(keepers, "root", "left").select("node", F.col("k.first").alias("__component"), F.col("k.node").alias("__keeper"))
    return prints.join(named, "node").select(F.col("id").alias(id_col), F.col("node").alias("__node"), "__component", "__keeper")
