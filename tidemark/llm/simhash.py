"""SimHash near-duplicates: Golay-code keys over segments of the fingerprint find every pair within three bits."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import cut, small_batches
from tidemark.llm.components import components
from tidemark.llm.similar import nodes_of, similar_documents

DISTANCE = 3
#: Members of a key's group that are compared in one task; larger groups are compared block by block.
BLOCK = 4096
_CHUNK = 1 << 15
_GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 makes the (23, 12) Golay code


def _rehash(h: np.ndarray, table: int) -> np.ndarray:
    """The shingle hashes of a further table; table 0 has XXH64 itself."""
    if not table:
        return h
    h = h + np.uint64(table * 0x9E3779B97F4A7C15 % 2**64)
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def fingerprints(text: bytes, size: int = 3, tables: int = 1) -> list[int]:
    """SimHashes of a text in UTF-8, one for each table: a bit is set if over half of the shingles' hashes set it; 0
    without words."""
    w = text.lower().split()  # of bytes: A-Z alone, and x20 and x09 to x0D
    if not w:
        return [0] * tables
    n = max(1, len(w) - size + 1)
    counts = np.zeros((tables, 64), np.int64)
    for start in range(0, n, _CHUNK):
        part = w[start : start + _CHUNK + size - 1]
        shingles = map(b" ".join, zip(*(part[k:] for k in range(size)), strict=False)) if len(w) >= size else [b" ".join(w)]
        h = np.array([xxhash.xxh64_intdigest(s, 42) for s in shingles], dtype="<u8")
        for t in range(tables):
            counts[t] += np.unpackbits(_rehash(h, t).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > n, axis=1, bitorder="little").view("<u8")[:, 0].tolist()


def fingerprint(text: bytes, size: int = 3) -> int:
    """The first table's SimHash."""
    return fingerprints(text, size)[0]


def _remainders() -> np.ndarray:
    """Of each value of a word's upper 12 bits, moved up by 11, after division by the generator."""
    r = np.arange(1 << 12, dtype=np.int64) << 11
    for bit in range(22, 10, -1):
        r = np.where(r >> bit & 1, r ^ (_GENERATOR << (bit - 11)), r)
    return r


_REMAINDER = _remainders()


def _syndrome(v: np.ndarray) -> np.ndarray:
    return _REMAINDER[v >> 11] ^ (v & 0x7FF)


def _error_patterns() -> np.ndarray:
    """For each syndrome the error patterns of weight up to 3, or of weight 3 and 4 where 3 is the least; -1 fills up."""
    out = np.full((1 << 11, 6), -1, np.int64)
    filled = np.zeros(1 << 11, np.int64)
    least = np.full(1 << 11, 9)
    for weight in range(5):
        for bits in combinations(range(23), weight):
            e = sum(1 << b for b in bits)
            s = int(_syndrome(np.array([e]))[0])
            if weight <= 3 and not filled[s] or weight == 4 and least[s] == 3:
                least[s] = min(least[s], weight)
                out[s, filled[s]] = e
                filled[s] += 1
    return out


_ERRORS: np.ndarray | None = None


def golay_indices(v: np.ndarray) -> np.ndarray:
    """Six columns: the 12-bit indices of the codewords near each 23-bit word, -1 where there are fewer.

    A word within 2 bits of a codeword has that one; any other word has the one at 3 bits and the five at 4 bits. Two
    words that differ in 2 bits or fewer have one in common.
    """
    global _ERRORS
    if _ERRORS is None:
        _ERRORS = _error_patterns()
    e = _ERRORS[_syndrome(v)]
    return np.where(e >= 0, (v[:, None] ^ e) >> 11, -1)


def search_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of fingerprints and the position each belongs to; two within 3 bits have a key in common.

    Segments: s of 23 bits, r of 21, t of 20; r and t have halves. Of 3 errors at most, by the pigeonhole:
    t or r has none and s at most 2 (kinds 0, 1), s alone has them (kind 2), or r and t have one each at least: then s
    has none and r at most 2 (kind 3), or each has one, so a half of r and a half of t have none (kinds 4 to 7).
    """
    fp = fp.astype(np.uint64)
    s = (fp & np.uint64(0x7FFFFF)).astype(np.int64)
    r = (fp >> np.uint64(23) & np.uint64(0x1FFFFF)).astype(np.int64)
    t = (fp >> np.uint64(44)).astype(np.int64)
    gs, gr = golay_indices(s), golay_indices(r)
    keys, owners, at = [], [], np.arange(len(fp))

    def add(kind: int, exact: np.ndarray, code: np.ndarray | None) -> None:
        base = (np.int64(kind) << 60) | exact
        if code is None:
            keys.append(base)
            owners.append(at)
            return
        rows, cols = np.nonzero(code >= 0)
        keys.append(base[rows] | (code[rows, cols] << 44))
        owners.append(rows)

    add(0, r, gs)
    add(1, t, gs)
    add(2, r << 20 | t, None)
    add(3, s, gr)
    for kind, (a, b) in enumerate(((x, y) for x in (r & 0x7FF, r >> 11) for y in (t & 0x3FF, t >> 10)), 4):
        add(kind, a << 10 | b, gs)
    return np.concatenate(keys), np.concatenate(owners)


def _links(members: np.ndarray, most: int) -> list[tuple[int, int]]:
    """From rows (fingerprint, node): links of nodes that connect whatever the pairs within the distance connect; fewer
    than there are rows."""
    left, nodes, out = members[:, 0].view(np.uint64), members[:, 1], []  # bits of a signed number count by its absolute value
    while len(left) > 1:
        queue, left, nodes = [(left[0], int(nodes[0]))], left[1:], nodes[1:]
        while queue and len(left):
            u, name = queue.pop()
            near = np.bitwise_count(left ^ u) <= most
            if near.any():
                found = nodes[near].tolist()
                out += [(name, v) for v in found]
                queue += list(zip(left[near], found, strict=True))
                left, nodes = left[~near], nodes[~near]
    return out


def _compare(most: int):
    """From rows (key, fp, node) in order of key: links (a, b), and the members of groups over BLOCK as (a, b, key)."""

    def emit(a, b, k):
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(k, pa.int64())], ["a", "b", "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key0, kept, hot = None, [], False
        close = lambda parts: _links(np.ascontiguousarray(np.concatenate(parts)), most) if sum(map(len, parts)) > 1 else []
        for batch in batches:
            key = batch.column(0).to_numpy(zero_copy_only=False)
            rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2)], axis=1)
            if not len(key):
                continue
            starts = np.concatenate(([0], np.nonzero(np.diff(key))[0] + 1, [len(key)]))
            links: list[tuple[int, int]] = []
            last = len(starts) - 2
            for g in sorted({0, last, *np.nonzero(np.diff(starts) > 1)[0].tolist()}):
                part = rows[starts[g] : starts[g + 1]]
                if key[starts[g]] == key0:
                    kept.append(part)
                else:
                    if not hot:
                        links += close(kept) if kept else []
                    key0, kept, hot = key[starts[g]], [part], False
                if hot or sum(map(len, kept)) > BLOCK:
                    hot = True
                    for m in kept:
                        yield emit(m[:, 0], m[:, 1], np.full(len(m), key0))
                    kept = []
                elif g != last:
                    links += close(kept)
                    kept = []
            if links:
                a, b = zip(*links, strict=True)
                yield emit(a, b, [None] * len(a))
        if not hot and kept and (links := close(kept)):
            a, b = zip(*links, strict=True)
            yield emit(a, b, [None] * len(a))

    return run


def _compare_blocks(most: int):
    def run(table: pa.Table) -> pa.Table:
        members = np.stack([table.column(c).to_numpy() for c in ("fp", "node")], axis=1)
        links = _links(np.ascontiguousarray(members), most)
        a, b = zip(*links, strict=True) if links else ((), ())
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def links(prints: DataFrame, most: int = DISTANCE) -> DataFrame:
    """Links (a, b) between nodes of prints(node, fps), one row each, of which one table's fingerprints share a key and
    differ in most bits or fewer; enough to connect all of them. Within three bits all pairs share a key."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column(0).to_numpy(zero_copy_only=False)
            if not len(nodes):
                continue
            fps = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(nodes), -1)
            for at in range(0, len(nodes), 2048):
                for t in range(fps.shape[1]):
                    part = np.ascontiguousarray(fps[at : at + 2048, t])
                    keys, owner = search_keys(part.view(np.uint64))
                    keys = _rehash(keys.view(np.uint64), t).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[owner]), pa.array(nodes[at : at + 2048][owner])], ["key", "fp", "node"])

    keys = prints.mapInArrow(keyed, "key long, fp long, node long")
    found = cut(keys.repartition("key").sortWithinPartitions("key").mapInArrow(_compare(most), "a long, b long, key long"))
    plain, hot = found.filter("key IS NULL").select("a", "b"), found.filter("key IS NOT NULL").select("key", F.col("a").alias("fp"), F.col("b").alias("node"))
    blocks = hot.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("n"))
    own = hot.join(blocks, "key").withColumn("p", F.pmod(F.xxhash64("node"), F.col("n")).cast("int"))
    pairs = own.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select("key", F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q"), "fp", "node")
    return plain.unionByName(pairs.groupBy("key", "p", "q").applyInArrow(_compare_blocks(most), "a long, b long"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, tables: int = 1, distance: int = DISTANCE) -> DataFrame:
    """Rows (id, __fp, __component) of all documents: fingerprint as a long and the smallest id of the group.

    Documents are linked if the fingerprints of any table differ in distance bits at most, and grouped over any number
    of links. Up to three bits no such pair is missed; beyond, a pair must share a key, which it does with a chance
    that falls with the bits (0.78 at four, 0.53 at five). Documents of equal fingerprints in the first table are one
    vertex, so copies cost no comparisons; groups of a key are compared in full, by blocks where they are large, and
    give fewer links than they have members.

    Nulls: a null text has no words, so fingerprint 0, and is linked to other such texts; a row with a null id is
    grouped, but no group takes its name from it. Repeated rows are each returned. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprints(t or b"", shingle, tables) for t in batch.column(1).to_pylist()], np.uint64).reshape(-1, tables).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints[:, 0]), pa.array(list(prints), pa.list_(pa.int64()))], ["id", "fp", "fps"])

    narrow = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("t"))
    prints = cut(narrow.mapInArrow(hashed, T.StructType([T.StructField("id", kind), T.StructField("fp", T.LongType()), T.StructField("fps", T.ArrayType(T.LongType()))])))
    firsts = prints.groupBy("fp").agg(F.min("id").alias("first"), F.min("fps").alias("fps"))
    roots = components(links(firsts.select("fp", "fps"), distance))
    rooted = firsts.join(roots, firsts.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    names = rooted.groupBy("root").agg(F.min("first").alias("__component"))
    named = rooted.join(names, "root").select("fp", "__component")
    return prints.join(named, "fp").select(F.col("id").alias(id_col), F.col("fp").alias("__fp"), "__component")


#: Ids of documents to drop that are sent to all tasks at once; more are joined by a shuffle of the documents.
SENT_IDS = 2_000_000


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The documents, with all their columns, of which each group keeps the one with the smallest id.

    SimHash fingerprints of the sets of shingles, found within DISTANCE bits by the same search keys as those of
    near_duplicates, give the first candidates. Most texts at 0.8 differ in some 10 of 64 bits, too many for search keys;
    similar_documents completes them, and verifies each link: every pair that shares similarity or more of its shingles is
    linked, and no other.

    Rows with a null id stay. Where an id repeats, each of its texts is judged by itself: a group keeps the text of its
    smallest id, of several such texts the one whose set of shingles has the smallest hash, then that of the smallest
    SHA-256, and of equal rows one.
    """
    found = cut(similar_documents(docs, links, id_col, text_col, shingle, similarity))
    if found.filter(F.col(id_col).isNotNull()).groupBy(id_col).count().filter("count > 1").limit(1).count():
        return _drop_rows(docs, found, id_col, text_col, shingle)
    gone = found.filter(F.col(id_col) != F.col("__component")).select(id_col)
    gone = F.broadcast(gone) if gone.limit(SENT_IDS + 1).count() <= SENT_IDS else gone
    return docs.join(gone, id_col, "left_anti").select(*docs.columns)


def _drop_rows(docs: DataFrame, found: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """As drop_near_duplicates, for ids that repeat: rows are told by id and set of shingles."""
    keep = found.filter((F.col(id_col) == F.col("__component")) & (F.col("__node") == F.col("__keeper"))).select(F.col(id_col).alias("__id"), F.col("__node").alias("__keep")).distinct()
    cols = [f"c{i}" for i in range(len(docs.columns))]
    fields = [T.StructField(c, f.dataType) for c, f in zip(cols, docs.schema, strict=True)]

    def noded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = pa.array(nodes_of(batch.column(len(cols)).to_pylist(), shingle), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], nodes], [*cols, "__node"])

    id_, text = (cols[docs.columns.index(c)] for c in (id_col, text_col))
    rows = docs.toDF(*cols).withColumn("__t", F.col(text).cast("binary")).mapInArrow(noded, T.StructType([*fields, T.StructField("__node", T.LongType())]))
    named = rows.filter(F.col(id_).isNotNull()).join(keep, (F.col(id_) == F.col("__id")) & (F.col("__node") == F.col("__keep")), "left_semi")
    order = Window.partitionBy(id_, "__node").orderBy(F.sha2(F.coalesce(F.col(text).cast("binary"), F.lit(b"")), 256), F.to_json(F.struct(*cols)))
    one = named.withColumn("__k", F.row_number().over(order)).filter("__k = 1").select(*cols)
    return one.unionByName(rows.filter(F.col(id_).isNull()).select(*cols)).toDF(*docs.columns)
