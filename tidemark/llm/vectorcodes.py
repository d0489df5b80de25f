"""Vector code compression: product codes with integer codebooks, searched by an integer Walsh-Hadamard transform.

Components become integers, floor(256 * x). A vector is cut into equal parts, and each part is named by the nearest entry
of its position's codebook. Parts and entries are padded with zeros to P, a power of two, and transformed; since the
transform is orthogonal but for a factor, the squared differences of coefficients sum to P times the squared distance.
They are summed in sequency order (smooth patterns first), and an entry is left out as soon as its sum passes the full
sum of an entry already known. All of it is integer arithmetic: sums that could pass 64 bits are done in Python's own
integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, shielded

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: Vectors that are worked on at once: a table of (vectors, entries) is held for one position.
SLICE = 4096
#: Labels whose sums are sent to all tasks; more are joined by a shuffle.
SENT_LABELS = 100_000
#: Sums leave a task in digits of so many bits, each with the sum's sign, so that Spark adds them up as longs.
DIGIT = 40


def integers(values: np.ndarray) -> np.ndarray:
    """floor(256 * x) of finite floats, exact: as int64, or as Python's integers where one is too large for that."""
    with np.errstate(over="ignore"):
        scaled = values.astype(np.float64) * SCALE  # a power of two: exact unless it overflows
    if np.abs(scaled).max(initial=0) < 2.0**62:
        return np.floor(scaled).astype(np.int64)
    return np.array([n * SCALE // d for n, d in (float(x).as_integer_ratio() for x in values.tolist())], dtype=object)


def sequency(size: int) -> np.ndarray:
    """Order of a transform's coefficients by the sign changes of their patterns; size is a power of two."""
    rows = np.ones((1, 1), np.int8)
    while len(rows) < size:
        rows = np.block([[rows, rows], [rows, -rows]])
    return np.argsort((np.diff(rows, axis=1) != 0).sum(1), kind="stable")


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform over the last axis, padded with zeros to a power of two, in sequency order."""
    size = 1 << max(0, x.shape[-1] - 1).bit_length()
    pad = np.zeros((*x.shape[:-1], size - x.shape[-1]), x.dtype)
    out, half = np.concatenate([x, pad], axis=-1), 1
    while half < size:
        pairs = out.reshape(*x.shape[:-1], size // (2 * half), 2, half)
        a, b = pairs[..., 0, :], pairs[..., 1, :]
        out, half = np.stack([a + b, a - b], axis=-2).reshape(*x.shape[:-1], size), 2 * half
    return out[..., sequency(size)]


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each transformed part the nearest transformed entry (the lowest index on ties) and P times its squared distance.

    Pairs (part, entry) are dropped as soon as their sum passes the part's bound, the full sum of the entry that led
    when 1, 2, 4, ... coefficients were in.
    """
    size = parts.shape[1]

    def full(entry: np.ndarray) -> np.ndarray:
        return ((parts - entries[entry]) ** 2).sum(axis=1)

    sums = (parts[:, :1] - entries[:, 0]) ** 2
    bound = full(sums.argmin(axis=1))
    row, entry = np.nonzero(sums <= bound[:, None])
    sums = sums[row, entry]
    for c in range(1, size):
        sums = sums + (parts[row, c] - entries[entry, c]) ** 2
        alive = sums <= bound[row]
        row, entry, sums = row[alive], entry[alive], sums[alive]
        if c & (c - 1) == 0 and c + 1 < size:
            bound = np.minimum(bound, full(entry[_first_least(row, sums)]))
    best = _first_least(row, sums)
    return entry[best], sums[best]


def _first_least(row: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Of each run of equal rows the place of its least sum, the first one on ties. Every row has a run."""
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    least = np.minimum.reduceat(sums, starts)
    hits = np.flatnonzero(sums == least[row])
    return hits[np.r_[True, row[hits][1:] != row[hits][:-1]]]


class Codebooks:
    """The entries of each part position, as integers of shape (PARTS, entries, length of a part)."""

    def __init__(self, seeds: list[list[int]], width: int, parts: int = PARTS) -> None:
        self.parts, self.length = parts, -(-width // parts)
        flat = np.zeros((len(seeds), parts * self.length), dtype=object)
        for k, vector in enumerate(seeds):
            flat[k, : len(vector)] = vector
        self.set(flat.reshape(len(seeds), parts, self.length).transpose(1, 0, 2))

    def set(self, entries: np.ndarray) -> None:
        self.most = max((abs(int(x)) for x in entries.flat), default=0)
        self.entries = entries.astype(np.int64) if self.most < 2**62 else entries
        self.coefficients = hadamard(entries) if self.most >= self._safe() else hadamard(self.entries)

    def _safe(self) -> int:
        """Components below this keep every sum over all parts within 63 bits."""
        size = 1 << max(0, self.length - 1).bit_length()
        return int((2**62 // (4 * size * max(1, self.length) * self.parts)) ** 0.5)

    def cut(self, column: pa.Array) -> np.ndarray:
        """Integer parts (rows, PARTS, length) of an array of vectors; shorter vectors are padded with zeros."""
        lengths, flat = np.asarray(pc.list_value_length(column), np.int64), integers(np.asarray(column.flatten()))
        width = self.parts * self.length
        out = np.zeros((len(lengths), width), flat.dtype)
        out[np.arange(width) < lengths[:, None]] = flat
        return out.reshape(len(lengths), self.parts, self.length)

    def assign(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes (rows, PARTS) and the squared distances summed over the parts."""
        small = max(self.most, max((abs(int(x)) for x in (parts.min(), parts.max())), default=0) if parts.size else 0) < self._safe()
        kind = np.int64 if small else object
        given, entries = hadamard(parts.astype(kind)), self.coefficients.astype(kind)
        codes, error = np.zeros(parts.shape[:2], np.int64), np.zeros(len(parts), kind)
        for j in range(self.parts if len(parts) and self.length else 0):
            codes[:, j], far = nearest(given[:, j], entries[j])
            error = error + far
        return codes, error // max(1, given.shape[-1])

    def sha_text(self) -> str:
        return ",".join(str(int(x)) for x in self.entries.flat)


def _slices(column: pa.Array) -> Iterator[pa.Array]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return (column.slice(k, SLICE) for k in range(0, len(column), SLICE))


_SUMS = "part int, entry int, place int, digit int, value long"


def _sums(books: Codebooks):
    """For each task, the sums of the parts given to each entry, in digits; place -1 has their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = books.entries.shape[1]
        count = np.zeros((books.parts, k), np.int64)
        total = np.zeros((books.parts, k, books.length), dtype=object)
        for batch in batches:
            for vectors in _slices(batch.column(0)):
                parts = books.cut(vectors)
                codes, _ = books.assign(parts)
                wide = parts.dtype == object or int(np.abs(parts).max(initial=0)) >= 2**48
                for j in range(books.parts):
                    count[j] += np.bincount(codes[:, j], minlength=k)
                    add = np.zeros((k, books.length), dtype=object if wide else np.int64)
                    np.add.at(add, codes[:, j], parts[:, j].astype(add.dtype))
                    total[j] += add
        rows = [(j, e, -1, 0, int(count[j, e])) for j, e in np.ndindex(count.shape) if count[j, e]]
        for j, e, p in np.ndindex(total.shape):
            left, sign, digit = abs(int(total[j, e, p])), 1 if total[j, e, p] > 0 else -1, 0
            while left:
                rows.append((j, e, p, digit, sign * (left & ((1 << DIGIT) - 1))))
                left, digit = left >> DIGIT, digit + 1
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, [pa.int32()] * 4 + [pa.int64()], strict=True)], ["part", "entry", "place", "digit", "value"])

    return run


def _coded(books: Codebooks):
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            names, errors = [], []
            for vectors in _slices(column):
                codes, error = books.assign(books.cut(vectors))
                names += [bytes(x).hex() for x in codes.astype(np.uint8)]
                errors += [int(x) if x < 2**63 else None for x in error.tolist()]
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(errors, pa.int64())], ["code", "error"])

    return run


def usable(vector: str) -> Column:
    """Whether a vector is there and all of its components are finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce(F.forall(F.col(vector), finite), F.lit(False))


def train(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks of the usable vectors; None where there are none.

    They start from the vectors with the smallest keys (nulls last; equal keys by the vectors themselves; all of them
    where there are fewer than entries). The driver holds entries * width numbers and their sums, whatever the rows are.
    """
    kept = vectors.filter(usable(vector))
    width = kept.agg(F.max(F.size(vector)).alias("w")).first()["w"]
    if width is None:
        return None
    first = kept.orderBy(F.col(key).asc_nulls_last(), vector).select(vector).limit(entries).collect()
    books = Codebooks([integers(np.asarray(r[0], np.float64)).tolist() for r in first], width, parts)
    for _ in range(rounds):
        found = kept.select(vector).mapInArrow(_sums(books), _SUMS).groupBy("part", "entry", "place", "digit").agg(F.sum("value").alias("value")).collect()
        count = np.zeros(books.entries.shape[:2], dtype=object)
        total = np.zeros(books.entries.shape, dtype=object)
        for r in found:
            if r["place"] < 0:
                count[r["part"], r["entry"]] = r["value"]
            else:
                total[r["part"], r["entry"], r["place"]] += r["value"] << (DIGIT * r["digit"]) if r["value"] >= 0 else -(-r["value"] << (DIGIT * r["digit"]))
        moved = books.entries.astype(object)
        for j, e in np.ndindex(count.shape):
            if count[j, e]:
                moved[j, e] = [int(x) // count[j, e] for x in total[j, e]]
        books.set(moved)
    return books


@shielded
def product_codes(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, keep: list[str] | None = None) -> DataFrame:
    """Rows with a usable vector, with __code, __error, __label_error and __codebooks (SHA-256 of the final entries).

    Rows whose vector is null, or holds a null or a component that isn't finite, go. Vectors shorter than the longest, or
    whose width isn't a multiple of parts, are padded with zeros at the end, an empty one wholly. Repeated rows are rows;
    null labels are one label; an error beyond a long is null, and so are the sums that hold it; an empty table gives no
    rows. At most 256 entries. Widths and components of any size are exact; the table is read rounds + 3 times, and only
    codebook sums and labels' sums are shuffled.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits: 1 to 256 entries")
    keep = vectors.columns if keep is None else keep
    names = [F.col(f"`{c}`") for c in keep]
    books = train(vectors, vector, key, parts, entries, rounds)
    if books is None:
        return vectors.filter("false").select(*names, F.lit("").alias("__code"), F.lit(0).cast("long").alias("__error"), F.lit(0).cast("long").alias("__label_error"), F.lit("").alias("__codebooks"))
    import hashlib

    digest = hashlib.sha256(books.sha_text().encode()).hexdigest()
    coder = F.arrow_udf(_coded(books), "struct<code: string, error: long>")
    coded = vectors.filter(usable(vector)).select(*names, F.col(f"`{label}`").alias("__group"), coder(F.col(vector)).alias("__coded"))
    coded = cut(coded.withColumn("__code", F.col("__coded.code")).withColumn("__error", F.col("__coded.error")).drop("__coded"))
    whole = F.when(F.count("__error") == F.count(F.lit(1)), F.try_sum("__error")).alias("__label_error")
    sums = coded.groupBy(F.col("__group").alias("__g")).agg(whole)
    if coded.select("__group").distinct().limit(SENT_LABELS + 1).count() <= SENT_LABELS:
        sums = F.broadcast(sums)
    return coded.join(sums, F.col("__group").eqNullSafe(F.col("__g"))).drop("__group", "__g").withColumn("__codebooks", F.lit(digest))
