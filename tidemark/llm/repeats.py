"""Removal of repeated byte strings: common-prefix intervals of enhanced suffix arrays over the places texts share."""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, small_batches

LEAST = 50
GRAM = 20
SIDE = LEAST - GRAM
WIDTH = LEAST + SIDE  # bytes of an anchor's context, at most
#: Bytes of text in a range, of text whose anchors are found at once, and of text or context for each bucket of anchors.
RANGE = 16 << 20
SLICE = 2 << 20
BUCKET_TEXT = 16 << 20
BUCKET_CONTEXT = 8 << 20
#: Contexts whose suffixes are sorted at once, unless one anchor has more; places from which on an anchor is split.
CHUNK = 1 << 14
HOT = 50_000
HOT_LIST = 1_000_000
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_PLACE_BITS = np.uint64(22)  # of a position in a slice


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM bytes from each position on, by doubling."""
    h = (data.astype(np.uint64) + np.uint64(1)) * _MIX
    powers = {1: h}
    width, p = 1, _MULTIPLIER
    while width < 16:
        h = h[:-width] * p + h[width:]
        p = np.uint64(int(p) ** 2 % 2**64)
        width *= 2
        powers[width] = h
    n = len(data) - GRAM + 1
    h = powers[16][:n] * _MULTIPLIER + powers[4][16 : 16 + n]
    h ^= h >> np.uint64(29)
    h *= _MIX
    return h ^ (h >> np.uint64(32))


def _row_hashes(rows: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of bytes."""
    padded = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    padded[:, : rows.shape[1]] = rows
    h = np.zeros(len(rows), np.uint64)
    for column in padded.view("<u8").T:
        h = ((h ^ h >> np.uint64(29)) * _MULTIPLIER + column) * _MIX
    return h ^ h >> np.uint64(32)


def _pieces(texts: list[bytes]) -> Iterator[list[tuple[int, int, bytes]]]:
    """Texts as (number, offset, bytes) in lists of about SLICE bytes; each window lies in one piece of a long text."""
    held, out = 0, []
    for i, text in enumerate(texts):
        for at in range(0, max(1, len(text) - LEAST + 1), SLICE):
            piece = text[at : at + SLICE + LEAST - 1]
            if held + len(piece) > SLICE and out:
                yield out
                held, out = 0, []
            out.append((i, at, piece))
            held += len(piece)
    if out:
        yield out


def anchors(pieces: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
    """(hash, text number, position, first window, last window) of anchors: of each LEAST bytes (a window, named by its
    start) the GRAM bytes of the least hash, the leftmost of ties.

    Equal windows have their anchors at equal places, and each window of a text has one anchor.
    """
    sizes = np.array([len(p[2]) for p in pieces], np.int64)
    data = np.frombuffer(b"".join(p[2] for p in pieces) + bytes(LEAST), np.uint8)
    begins = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(np.int64)
    owner = np.repeat(np.arange(len(pieces)), sizes)
    h = gram_hashes(data)
    places = np.arange(len(h), dtype=np.uint64)
    low = (h >> _PLACE_BITS << _PLACE_BITS) | places
    have = 1
    while 2 * have <= SIDE + 1:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    n = len(h) - SIDE
    low = np.minimum(low[:n], low[SIDE + 1 - have : SIDE + 1 - have + n])
    starts = np.arange(min(n, len(owner)))
    starts = starts[starts + LEAST <= (begins + sizes)[owner[starts]]]
    at = (low[starts] & ((np.uint64(1) << _PLACE_BITS) - np.uint64(1))).astype(np.int64)
    new = np.nonzero(np.concatenate(([True], at[1:] != at[:-1])))[0] if len(at) else np.zeros(0, np.int64)
    last = np.append(new[1:], len(at))[: len(new)] - 1
    place = at[new]
    own = owner[place]
    shift = np.array([p[1] for p in pieces], np.int64)[own] - begins[own]
    number = np.array([p[0] for p in pieces], np.int64)[own]
    return h[place], number, place + shift, starts[new] + shift, starts[last] + shift


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of any kind in one compressed frame."""
    raw = b"".join(len(a := np.ascontiguousarray(x).tobytes()).to_bytes(4, "little") + a for x in arrays)
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _unpack(blob: bytes, *kinds) -> list[np.ndarray]:
    raw, out, at = zstandard.ZstdDecompressor().decompress(blob), [], 0
    for kind in kinds:
        n = int.from_bytes(raw[at : at + 4], "little")
        out.append(np.frombuffer(raw[at + 4 : at + 4 + n], kind))
        at += 4 + n
    return out


def _by_key(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each key with its positions, in order."""
    order = np.argsort(keys, kind="stable")
    edges = np.nonzero(np.diff(keys[order]))[0] + 1
    for part in np.split(order, edges) if len(order) else ():
        yield int(keys[part[0]]), part


def _blobs(rows: list[tuple[int, bytes, int]], name: str) -> pa.RecordBatch:
    """Rows (key, blob, number of places in it)."""
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.int64()))], [name, "blob", "n"])


def _once_in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (sha, id, text): each text of a task once, compressed, with an id; and at the end its smallest id."""
    sent: dict[bytes, int] = {}
    least: dict[bytes, int] = {}
    squeeze = zstandard.ZstdCompressor(level=3).compress
    names = ["sha", "id", "packed"]
    for batch in batches:
        out = []
        for i, (sha, id_) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            if sha not in sent:
                sent[sha] = id_
                out.append((sha, id_, squeeze(batch.column(2)[i].as_py())))
            elif id_ < least.get(sha, sent[sha]):
                least[sha] = id_
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.binary(), pa.int64(), pa.binary()))], names)
    yield pa.RecordBatch.from_arrays([pa.array(list(least), pa.binary()), pa.array(list(least.values()), pa.int64()), pa.nulls(len(least), pa.binary())], names)


def _as_range(table: pa.Table) -> pa.Table:
    """One range's texts as one row: their hashes, smallest ids and, in one frame, bytes; in order of the hashes."""
    first: dict[bytes, int] = {}
    packed: dict[bytes, bytes] = {}
    for sha, id_, text in zip(*(table.column(c).to_pylist() for c in ("sha", "id", "packed")), strict=True):
        first[sha] = min(id_, first.get(sha, id_))
        if text is not None:
            packed[sha] = text
    unpack, order = zstandard.ZstdDecompressor().decompress, sorted(first)
    texts = [unpack(packed[s]) for s in order]
    whole = zstandard.ZstdCompressor(level=3).compress(b"".join(texts))
    return pa.table({
        "range": table.column("range").slice(0, 1), "shas": pa.array([b"".join(order)], pa.binary()), "firsts": pa.array([np.array([first[s] for s in order], np.int64).tobytes()], pa.binary()),
        "sizes": pa.array([np.array([len(t) for t in texts], np.int64).tobytes()], pa.binary()), "whole": pa.array([whole], pa.binary()),
    })


def _texts(sizes: bytes, whole: bytes) -> list[bytes]:
    ends = np.cumsum(np.frombuffer(sizes, np.int64)).tolist()
    raw = zstandard.ZstdDecompressor().decompress(whole)
    return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]


_PLACES = (np.int32, np.int32, np.int16)  # text number, position, windows: those before it, of first and last


def _code(pos: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return ((pos - lo) * 32 + (pos - hi)).astype(np.int16)


def _find_anchors(buckets: int):
    """From rows (range, sizes, whole): anchors by bucket. Those that two texts of a slice share are known; of them only
    the hash and the number travel, and their places, in a group of the range's own (a negative bucket)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, sizes, whole in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                for part in _pieces(_texts(sizes, whole)):
                    h, number, pos, lo, hi = anchors(part)
                    order = np.argsort(h, kind="stable")
                    new = np.concatenate(([True], np.diff(h[order]) != 0)) if len(h) else np.zeros(0, bool)
                    starts, group = np.nonzero(new)[0], np.cumsum(new) - 1
                    many = np.zeros(len(starts), bool)
                    many[group[number[order] != number[order][starts][group]]] = True
                    counts = np.diff(np.append(starts, len(h)))
                    known = np.zeros(len(h), bool)
                    known[order] = many[group]
                    reps, times = h[order][starts[many]], counts[many]
                    rows = [(-1 - r, _pack(number[known].astype(np.int32), pos[known].astype(np.int32), _code(pos, lo, hi)[known]), int(known.sum()))] if known.any() else []
                    single = np.nonzero(~known)[0]
                    singles, heads = dict(_by_key(_bucket(h[single], buckets))), dict(_by_key(_bucket(reps, buckets)))
                    none = np.zeros(0, np.int64)
                    for b in singles.keys() | heads.keys():
                        at, rep = single[singles.get(b, none)], heads.get(b, none)
                        low = np.concatenate((h[at], reps[rep])).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
                        rows.append((b, _pack(low, number[at].astype(np.int32), np.diff(pos[at], prepend=0).astype(np.int32), _code(pos[at], lo[at], hi[at]), times[rep].astype(np.int32), np.int64([r])), len(at)))
                    yield _blobs(rows, "bucket")

    return run


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return (h >> np.uint64(40)).astype(np.int64) % buckets


def _anchor_key(h: np.ndarray, buckets: int) -> np.ndarray:
    """An anchor by bucket and the lower 40 bits of its hash."""
    return _bucket(h, buckets) << 40 | (h & np.uint64(2**40 - 1)).astype(np.int64)


def _as_it_is(table: pa.Table) -> pa.Table:
    """Rows of a range's own group."""
    return pa.table({"range": pc.subtract(-1, table.column("bucket")), "blob": table.column("blob"), "n": table.column("n")})


def _shared(hot: int):
    """Of one bucket's anchors the places of those that two texts at least hold, by range; at range -1 the keys of
    anchors with hot places or more."""

    def run(table: pa.Table) -> pa.Table:
        bucket, blobs = table.column("bucket")[0].as_py(), table.column("blob").to_pylist()
        if bucket < 0:
            return _as_it_is(table)
        h, text, place, times = [], [], [], []
        for blob in blobs:
            low, number, pos, code, reps, r = _unpack(blob, np.uint8, np.int32, np.int32, np.int16, np.int32, np.int64)
            wide = np.zeros((len(low) // 5, 8), np.uint8)
            wide[:, :5] = low.reshape(-1, 5)
            h.append(wide.reshape(-1).view("<u8").astype(np.int64))
            text.append(np.concatenate((r[0] << 32 | number.astype(np.int64), np.full(len(reps), -1))))
            place.append(np.concatenate((np.stack((np.cumsum(pos), code.astype(np.int64)), axis=1).reshape(-1, 2), np.zeros((len(reps), 2), np.int64))))
            times.append(np.concatenate((np.ones(len(number), np.int64), reps)))
        h, text, place, times = (np.concatenate(x) for x in (h, text, place, times))
        order = np.argsort(h, kind="stable")
        h, text, place, times = h[order], text[order], place[order], times[order]
        new = np.concatenate(([True], np.diff(h) != 0)) if len(h) else np.zeros(0, bool)
        starts, group = np.nonzero(new)[0], np.cumsum(new) - 1
        many = np.zeros(len(starts), bool)
        many[group[(text != text[starts][group]) | (text == -1)]] = True
        keep = np.nonzero(many[group] & (text >= 0))[0]
        rows = []
        for r, at in _by_key(text[keep] >> 32):
            at = keep[at]
            at = at[np.lexsort((place[at, 0], text[at]))]
            rows.append((r, _pack((text[at] & 0xFFFFFFFF).astype(np.int32), place[at, 0].astype(np.int32), place[at, 1].astype(np.int16)), len(at)))
        over = np.nonzero(np.add.reduceat(times, starts) >= hot)[0] if len(h) else []
        if len(over):
            rows.append((-1, (np.int64(bucket) << 40 | h[starts[over]]).tobytes(), 0))
        return pa.Table.from_batches([_blobs(rows, "range")])

    return run


_ENTRIES = (np.uint8, np.uint8, np.int8, np.int64, np.int64, np.int32, np.int32)


def _contexts(buckets: int, anchor_buckets: int, hot, every: bool):
    """From rows (range, firsts, sizes, whole, places of shared anchors): contexts by bucket of the anchor. A context
    runs from the byte before the first window to the end of the last.

    Of equal contexts of a range only those in the smallest document travel; the rest is known to be repeated, and goes
    to a group of the range's own (a negative bucket). With every all travel. Contexts of hot anchors are split: each
    window is a context, in the bucket of its bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, firsts, sizes, whole, blobs in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                first, size = np.frombuffer(firsts, np.int64), np.frombuffer(sizes, np.int64)
                data = np.frombuffer(bytes(1) + zstandard.ZstdDecompressor().decompress(whole) + bytes(WIDTH), np.uint8)
                begin = np.concatenate(([1], 1 + np.cumsum(size)[:-1]))
                number, pos, code = (np.concatenate(x).astype(np.int64) for x in zip(*(_unpack(b, *_PLACES) for b in blobs), strict=True))
                lo, span = pos - code // 32, code // 32 - code % 32 + 1  # first window, number of windows
                anchor = code // 32
                if len(hot.value):
                    grams = data[(begin[number] + pos)[:, None] + np.arange(GRAM)]
                    is_hot = np.isin(_anchor_key(gram_hashes(grams.reshape(-1))[::GRAM], anchor_buckets), hot.value)
                    each = np.where(is_hot, span, 1)
                    owner = np.repeat(np.arange(len(pos)), each)
                    nth = np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each)
                    number, lo, span, anchor = number[owner], lo[owner] + nth, np.where(is_hot, 1, span)[owner], np.where(is_hot, -1, anchor)[owner]
                for at in np.array_split(np.arange(len(lo)), max(1, len(lo) >> 17)):
                    ctx = data[(begin[number[at]] + lo[at] - 1)[:, None] + np.arange(WIDTH + 1)]
                    ctx[np.arange(WIDTH + 1) > span[at, None] + LEAST - 1] = 0
                    edge = lo[at] == 0
                    ctx[edge, 0] = 0
                    yield from _dealt(r, ctx, edge, span[at], anchor[at], first[number[at]], number[at], lo[at])

    def _dealt(r, ctx, edge, span, anchor, doc, number, lo):
        rows = []
        send = np.ones(len(lo), bool)
        if not every:
            of, least = _distinct(ctx, edge, span, doc)
            send = doc == least[of]
            if (~send).any():
                rows.append((-1 - r, _pack(number[~send].astype(np.int32), lo[~send].astype(np.int32), ((1 << span[~send]) - 1).astype(np.int32)), int((~send).sum())))
        go = np.nonzero(send)[0]
        bucket = (_groups(ctx[go], anchor[go]) >> np.uint64(33)).astype(np.int64) % buckets
        for b, at in _by_key(bucket):
            at = go[at]
            rows.append((b, _pack(ctx[at], span[at].astype(np.uint8) | edge[at].astype(np.uint8) << 7, anchor[at].astype(np.int8), doc[at], np.int64([r]), number[at].astype(np.int32), lo[at].astype(np.int32)), len(at)))
        yield _blobs(rows, "bucket")

    return run


def _groups(ctx: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Hash of each context's anchor; of its window where anchor is -1."""
    out = _row_hashes(ctx[:, 1 : LEAST + 1])
    own = np.nonzero(anchor >= 0)[0]
    out[own] = _row_hashes(ctx[own[:, None], 1 + anchor[own, None].astype(np.int64) + np.arange(GRAM)])
    return out


def _distinct(ctx: np.ndarray, edge: np.ndarray, span: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each row's distinct context, and the smallest document of each. Rows of equal hashes are compared."""
    h = _row_hashes(np.concatenate((ctx, edge[:, None].astype(np.uint8), span[:, None].astype(np.uint8)), axis=1))
    order = np.argsort(h, kind="stable")
    new = np.ones(len(h), bool)
    a, b = order[1:], order[:-1]
    same = np.nonzero(h[a] == h[b])[0]
    new[1 + same] = (ctx[a[same]] != ctx[b[same]]).any(axis=1) | (edge[a[same]] != edge[b[same]]) | (span[a[same]] != span[b[same]])
    of = np.empty(len(h), np.int64)
    of[order] = np.cumsum(new) - 1
    return of, np.minimum.reduceat(doc[order], np.nonzero(new)[0]) if len(h) else doc


def interval_tree(lcp: list[int], least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(depth, first, last, top) of the intervals of at least the least common prefix, by a scan with a stack.

    lcp[i] is the common prefix of suffixes i - 1 and i, lcp[0] is 0. Intervals nest; top ones lie in no other.
    """
    depths, firsts, lasts, tops = [], [], [], []
    stack: list[tuple[int, int]] = []  # depth and first suffix, ever deeper
    for i, d in enumerate([*lcp[1:], 0], 1):
        first = i - 1
        while stack and stack[-1][0] > d:
            depth, first = stack.pop()
            depths.append(depth)
            firsts.append(first)
            lasts.append(i - 1)
            tops.append(not stack and d < least)
        if d >= least and (not stack or stack[-1][0] < d):
            stack.append((d, first))
    return np.array(depths, np.int64), np.array(firsts, np.int64), np.array(lasts, np.int64), np.array(tops, bool)


def suffix_array(ctx: np.ndarray, edge: np.ndarray, span: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(context, window, common prefix with the one before, left byte, length) of the suffixes that start at contexts'
    windows, in order. Suffixes whose first LEAST bytes no other has are left out. Left bytes at text starts all differ."""
    owner = np.repeat(np.arange(len(ctx)), span)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(span) - span, span)
    padded = np.zeros((len(ctx), 2 * WIDTH), np.uint8)
    padded[:, : WIDTH + 1] = ctx
    flat, base = padded.reshape(-1), owner * 2 * WIDTH + nth + 1
    columns = np.lib.stride_tricks.as_strided(flat, (len(flat) - 7, 8), (1, 1))
    h = np.zeros(len(owner), np.uint64)
    for k in (0, 8, 16, 24, 32, 40, 42):  # the window's bytes
        h = ((h ^ h >> np.uint64(29)) * _MULTIPLIER + columns[base + k].view("<u8")[:, 0]) * _MIX
    order = np.argsort(h)
    same = np.diff(h[order]) == 0
    keep = np.sort(order[np.concatenate((same, [False])) | np.concatenate(([False], same))])
    owner, nth, base = owner[keep], nth[keep], base[keep]
    words = [columns[base + k].view(">u8")[:, 0].astype(np.uint64) for k in range(0, WIDTH, 8)]
    order = np.lexsort(words[::-1])
    owner, nth, base = owner[order], nth[order], base[order]
    rows = np.stack(words, axis=1)[order].astype(">u8").view(np.uint8).reshape(-1, WIDTH)
    length = LEAST + span[owner] - 1 - nth
    lcp = np.zeros(len(owner), np.int64)
    if len(owner) > 1:
        differ = rows[1:] != rows[:-1]
        lcp[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), WIDTH)
        lcp[1:] = np.minimum(lcp[1:], np.minimum(length[1:], length[:-1]))
    left = flat[base - 1].astype(np.int64)
    start = edge[owner] & (nth == 0)
    left[start] = 256 + np.nonzero(start)[0]
    return owner, nth, lcp, left, length


def repeats_of(ctx: np.ndarray, edge: np.ndarray, span: np.ndarray, doc: np.ndarray, groups: bool = True) -> tuple[np.ndarray, list[tuple[np.ndarray, ...]]]:
    """(smallest document of each distinct context's windows, maximal groups) of distinct contexts with their smallest
    documents. A group is (length, whether it ends with a context, contexts, windows)."""
    smallest = np.broadcast_to(doc[:, None], (len(doc), SIDE + 1)).copy()
    owner, nth, lcp, left, length = suffix_array(ctx, edge, span)
    depth, first, last, top = interval_tree(lcp.tolist())
    if not len(depth):
        return smallest, []
    sizes = (last - first + 1)[top]
    starts = np.cumsum(sizes) - sizes
    members = np.arange(int(sizes.sum())) + np.repeat(first[top] - starts, sizes)
    mins = np.minimum.reduceat(doc[owner[members]], starts)
    smallest[owner[members], nth[members]] = np.repeat(mins, sizes)
    if not groups:
        return smallest, []
    changes = np.cumsum(np.concatenate(([0], np.diff(left) != 0)))
    diverse = changes[last] > changes[first]
    return smallest, [(int(depth[k]), bool(length[first[k] : last[k] + 1].min() == depth[k]), owner[first[k] : last[k] + 1], nth[first[k] : last[k] + 1]) for k in np.nonzero(diverse)[0]]


def _entries(table: pa.Table) -> Iterator[tuple[np.ndarray, ...]]:
    """(context, text start, windows, document, range, text number, first window) of a bucket's rows, in chunks that hold
    all rows of an anchor."""
    parts: list[list[np.ndarray]] = [[] for _ in range(8)]
    for blob in table.column("blob").to_pylist():
        ctx, marks, anchor, doc, r, number, lo = _unpack(blob, *_ENTRIES)
        ctx = ctx.reshape(-1, WIDTH + 1)
        for to, x in zip(parts, (ctx, marks >> 7 == 1, (marks & 127).astype(np.int64), doc, np.full(len(doc), r[0]), number, lo, _groups(ctx, anchor)), strict=True):
            to.append(x)
    columns = [np.concatenate(x) for x in parts]
    for _, at in _by_key((columns[7] >> np.uint64(12)).astype(np.int64) % max(1, len(columns[0]) // CHUNK)):
        yield tuple(c[at] for c in columns)


def _marks(table: pa.Table) -> pa.Table:
    """Of one bucket's contexts the windows that a smaller document holds: by range (text number, first window, bits)."""
    if table.column("bucket")[0].as_py() < 0:
        return _as_it_is(table)
    found: list[list[np.ndarray]] = [[], [], [], []]
    for ctx, edge, span, doc, r, number, lo, group in _entries(table):
        of, least = _distinct(ctx, edge, span, doc)
        rep = np.empty(len(least), np.int64)
        rep[of] = np.arange(len(of))
        _, which, counts = np.unique(group[rep], return_inverse=True, return_counts=True)
        smallest = np.broadcast_to(least[:, None], (len(least), SIDE + 1)).copy()
        many = np.nonzero(counts[which] > 1)[0]  # an anchor with one context has one string
        if len(many):
            smallest[many] = repeats_of(ctx[rep[many]], edge[rep[many]], span[rep[many]], least[many], groups=False)[0]
        nth = np.arange(SIDE + 1)
        bits = (((doc[:, None] > smallest[of]) & (nth < span[:, None])) << nth).sum(axis=1)
        at = np.nonzero(bits)[0]
        for to, x in zip(found, (r[at], number[at], lo[at], bits[at].astype(np.int32)), strict=True):
            to.append(x)
    r, number, lo, bits = (np.concatenate(x) for x in found)
    return pa.Table.from_batches([_blobs([(k, _pack(number[at], lo[at], bits[at]), len(at)) for k, at in _by_key(r)], "range")])


def _groups_of(table: pa.Table) -> pa.Table:
    """Of one bucket's contexts the maximal groups, a row for each occurrence."""
    names = ["group", "length", "open", "range", "number", "start"]
    out: list[list] = [[] for _ in names]
    for ctx, edge, span, doc, r, number, lo, _ in _entries(table):
        for length, more, who, nth in repeats_of(ctx, edge, span, doc)[1]:
            name = hashlib.sha256(ctx[who[0], 1 + nth[0] : 1 + nth[0] + length].tobytes()).hexdigest()
            for to, x in zip(out, ([name] * len(who), [length] * len(who), [more] * len(who), r[who].tolist(), number[who].tolist(), (lo[who] + nth).tolist()), strict=True):
                to += x
    kinds = (pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64())
    return pa.table([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names)


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (range, shas, firsts, sizes, whole, marks): a row for each text."""
    names = ["sha", "first", "n_removed", "n_spans", "kept_sha256", "kept"]
    for batch in batches:
        for shas, firsts, sizes, whole, blobs in zip(*(batch.column(i).to_pylist() for i in range(1, 6)), strict=True):
            texts = _texts(sizes, whole)
            size, first = np.frombuffer(sizes, np.int64), np.frombuffer(firsts, np.int64)
            begin = np.cumsum(size) - size
            cover = np.zeros(int(size.sum()) + 1, np.int32)
            for blob in blobs or []:
                number, lo, bits = _unpack(blob, np.int32, np.int32, np.int32)
                for nth in range(SIDE + 1):
                    on = np.nonzero(bits >> nth & 1)[0]
                    at = begin[number[on]] + lo[on] + nth
                    np.add.at(cover, at, 1)
                    np.add.at(cover, at + LEAST, -1)
            gone = np.cumsum(cover[:-1], dtype=np.int32) > 0
            rows = []
            for i, text in enumerate(texts):
                mine = gone[begin[i] : begin[i] + size[i]]
                n = int(np.count_nonzero(mine))
                kept = np.frombuffer(text, np.uint8)[~mine].tobytes() if n else None
                spans = int(np.count_nonzero(np.diff(mine.astype(np.int8), prepend=0) == 1)) if n else 0
                rows.append((shas[32 * i : 32 * i + 32], int(first[i]), n, spans, hashlib.sha256(kept).hexdigest() if n else None, kept))
            for at in range(0, len(rows), 4096):
                kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows[at : at + 4096]], t) for k, t in enumerate(kinds)], names)


def _release(df: DataFrame) -> None:
    """Lets Spark's cleaner drop the shuffle files of steps whose results are stored."""
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.unhex(F.sha2(text, 256)).alias("sha"), F.octet_length(text).cast("long").alias("n"), text.alias("text"))


def _ranges(source: DataFrame, total: int) -> DataFrame:
    """Stored rows (range, shas, firsts, sizes, whole) of the distinct texts. A function of its own, as are the next
    ones: the frames that lead to a stored table keep its shuffle files."""
    ranges = max(1, -(-total // RANGE))
    once = source.filter(F.col("id").isNotNull() & (F.col("n") >= LEAST)).select("sha", "id", "text").mapInArrow(_once_in_task, "sha binary, id long, packed binary")
    dealt = once.withColumn("range", F.pmod(F.xxhash64("sha"), F.lit(ranges)))
    return cut(dealt.groupBy("range").applyInArrow(_as_range, "range long, shas binary, firsts binary, sizes binary, whole binary"))


def _places(texts: DataFrame, buckets: int, hot: int) -> DataFrame:
    """Stored rows (range, blob, n) of the places of shared anchors, and at range -1 the hot anchors."""
    found = texts.select("range", "sizes", "whole").mapInArrow(_find_anchors(buckets), "bucket long, blob binary, n long")
    return cut(found.groupBy("bucket").applyInArrow(_shared(hot), "range long, blob binary, n long"))


def _dealt_contexts(texts: DataFrame, places: DataFrame, buckets: int, every: bool) -> DataFrame:
    spark = texts.sparkSession
    keys = b"".join(bytes(r[0]) for r in places.filter("range = -1").select("blob").collect())  # HOT_LIST keys at most
    hot = spark.sparkContext.broadcast(np.frombuffer(keys, np.int64))
    of = places.filter("range >= 0")
    n = of.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    lists = of.groupBy("range").agg(F.collect_list("blob").alias("blobs"))  # places of one range
    joined = texts.join(lists, "range").select("range", "firsts", "sizes", "whole", "blobs")
    return joined.mapInArrow(_contexts(max(1, -(-n * (WIDTH + 1) // BUCKET_CONTEXT)), buckets, hot, every), "bucket long, blob binary, n long")


def _shared_contexts(source: DataFrame, total: int, every: bool) -> tuple[DataFrame, DataFrame]:
    texts = _ranges(source, total)
    _release(texts)
    buckets = max(1, -(-total // BUCKET_TEXT))
    places = _places(texts, buckets, max(HOT, total // 8 // HOT_LIST))
    _release(texts)
    return texts, _dealt_contexts(texts, places, buckets, every)


def repeat_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (group, length, open, id, start) of the maximal repeats of LEAST bytes or more, one for each occurrence.

    A group is a common-prefix interval of the suffixes of which not all have the same byte before them: longer strings
    to the left are not common to all, and none of more bytes to the right. The suffixes of an anchor end with the
    windows that are its own (WIDTH bytes at most); a group that reaches that end is open: the repeat goes on, and
    the next anchor's groups have what follows. Repeats that lie in one text alone are left out; copies of a text count
    as the one of the smallest id. group is the SHA-256 of the string; start counts bytes.
    """
    source = _source(docs, id_col, text_col)
    total = source.filter(F.col("id").isNotNull()).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    texts, contexts = _shared_contexts(source, total, True)
    found = contexts.groupBy("bucket").applyInArrow(_groups_of, "group string, length long, open boolean, range long, number long, start long")

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r, firsts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.frombuffer(firsts, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), r)), pa.array(np.arange(len(ids))), pa.array(ids)], ["range", "number", "id"])

    ids = texts.select("range", "firsts").mapInArrow(named, "range long, number long, id long")
    return found.join(ids, ["range", "number"]).select("group", "length", "open", F.col("id").alias(id_col), "start")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Rows (id, __n_bytes, __n_removed, __n_spans, __kept_sha256), with_text also __kept (bytes), of all documents.

    A byte goes if LEAST bytes that hold it also start in a document with a smaller id; matches overlap, never cross
    documents, and are found in the texts as they are given.

    Distinct texts are dealt to ranges of a fixed size. Anchors (one of some sixteen places) travel first, then the
    contexts of those that two texts share, to buckets of a fixed size. There an enhanced suffix array is scanned for its
    common-prefix intervals of LEAST bytes or more; each names the smallest document of its occurrences.

    Nulls: a null text is empty; a row with a null id neither loses nor takes anything. Rows that repeat an id don't
    count against each other, and copies of a text are the text of the smallest id. Texts under LEAST bytes stay whole.
    An empty table gives no rows. Ids are integers. Other columns are not read.
    """
    small_batches(docs.sparkSession)
    source = _source(docs, id_col, text_col)
    rows = cut(source.select("id", "sha", "n"))
    total = rows.filter(F.col("id").isNotNull()).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    texts, contexts = _shared_contexts(source, total, False)
    marks = contexts.groupBy("bucket").applyInArrow(_marks, "range long, blob binary, n long")
    marked = texts.join(marks.groupBy("range").agg(F.collect_list("blob").alias("marks")), "range", "left")
    kinds = "sha binary, first long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    cleaned = marked.select("range", "shas", "firsts", "sizes", "whole", "marks").mapInArrow(_remove, kinds)
    base = rows.join(cleaned if with_text else cleaned.drop("kept"), "sha", "left")
    copy, own = (F.col("id") > F.col("first")) & (F.col("n") >= LEAST), (F.col("id") == F.col("first")) & (F.col("n_removed") > 0)
    pick = lambda all_, ours, none: F.when(copy, all_).when(own, ours).otherwise(none)
    whole = [pick(F.lit(b""), F.col("kept"), F.lit(None)).alias("__kept")] if with_text else []
    return base.select(
        F.col("id").alias(id_col), F.col("n").alias("__n_bytes"), pick(F.col("n"), F.col("n_removed"), F.lit(0)).cast("long").alias("__n_removed"),
        pick(F.lit(1), F.col("n_spans"), F.lit(0)).cast("long").alias("__n_spans"), pick(F.sha2(F.lit(""), 256), F.col("kept_sha256"), F.lower(F.hex("sha"))).alias("__kept_sha256"), *whole,
    )
