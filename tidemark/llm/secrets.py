"""Secret scans over an incremental ledger of blobs: each distinct text is scanned once for each version of the rules."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import shielded, small_batches

#: Rules by version: kind, pattern, the group whose length counts, the least length. Ledgers name the versions; a
#: changed rule is a new version.
RULES: dict[int, list[tuple[str, re.Pattern, int, int]]] = {
    1: [
        ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII), 2, 12),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
        ("hex", re.compile(r"[0-9a-f]{16,}"), 0, 16),  # maximal runs, so those of [0-9a-f]+ that are long enough
    ],
    2: [
        ("github", re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}"), 0, 40),
        ("slack", re.compile(r"xox[abprs]-[A-Za-z0-9-]{10,}"), 0, 15),
        ("jwt", re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"), 0, 29),
        ("pem", re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"), 0, 27),
    ],
}
KINDS = [kind for rules in RULES.values() for kind, *_ in rules]
BASE_KINDS = ("assign", "access", "hex")
_SPANS = "array<struct<start:int,rank:int,stop:int,kind:string>>"
LEDGER = f"blob binary, version int, spans {_SPANS}"


def scan_text(text: str, version: int) -> list[tuple[int, int, int, str]]:
    """Spans (start, rank of the kind, end, kind) of one version's rules, in code points, in order."""
    out = []
    for kind, pattern, group, least in RULES[version]:
        out += [(m.start(), KINDS.index(kind), m.end(), kind) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(out)


def _first_in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each blob of a task, its text compressed, so that copies don't travel."""
    seen: set[bytes] = set()
    squeeze = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        blobs, texts = [], []
        for i, blob in enumerate(batch.column(0).to_pylist()):
            if blob not in seen:
                seen.add(blob)
                blobs.append(blob)
                texts.append(squeeze(batch.column(1)[i].as_py()))
        yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.binary()), pa.array(texts, pa.binary())], ["blob", "packed"])


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The stored rows (blob, version, spans) at path; none where nothing was stored yet."""
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], LEDGER)


def scan(docs: DataFrame, text_col: str = "text", ledger: DataFrame | None = None, versions: tuple[int, ...] = tuple(RULES)) -> DataFrame:
    """Rows (blob, version, spans) for the distinct texts and versions that the ledger lacks; append them to it.

    A blob is the SHA-256 of a text in UTF-8 (null: of no bytes). Blobs without findings get rows too, so that they are
    not scanned again.
    """
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")
    blobs = docs.select(F.unhex(F.sha2(text, 256)).alias("blob"), text.alias("text")).mapInArrow(_first_in_task, "blob binary, packed binary")
    seen = None if ledger is None else ledger.groupBy("blob").agg(F.collect_set("version").alias("seen"))  # few versions
    if seen is not None:
        blobs = blobs.join(seen, "blob", "left").filter(F.size(F.array_except(F.array(*[F.lit(v) for v in versions]), F.coalesce("seen", F.array().cast("array<int>")))) > 0)
        blobs = blobs.select("blob", "packed", F.coalesce("seen", F.array().cast("array<int>")).alias("seen"))

    def scan_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[bytes] = set()
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            rows: dict[str, list] = {"blob": [], "version": [], "spans": []}
            for i, blob in enumerate(batch.column(0).to_pylist()):
                if blob in done:
                    continue
                done.add(blob)
                past = batch.column(2)[i].as_py() if batch.num_columns > 2 else ()
                content = unpack(batch.column(1)[i].as_py()).decode()
                for v in versions:
                    if v not in past:
                        rows["blob"].append(blob)
                        rows["version"].append(v)
                        rows["spans"].append([dict(zip(("start", "rank", "stop", "kind"), s, strict=True)) for s in scan_text(content, v)])
            kinds = pa.list_(pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("stop", pa.int32()), ("kind", pa.string())]))
            yield pa.RecordBatch.from_arrays([pa.array(rows["blob"], pa.binary()), pa.array(rows["version"], pa.int32()), pa.array(rows["spans"], kinds)], ["blob", "version", "spans"])

    return blobs.repartition("blob").mapInArrow(scan_once, LEDGER)


@shielded
def find_secrets(docs: DataFrame, ledger: str, text_col: str = "text", keep: list[str] | None = None, versions: tuple[int, ...] = tuple(RULES)) -> DataFrame:
    """Columns of keep (all by default), __blob and __spans (start, rank, stop, kind; in order) for each row.

    ledger is the path of a Parquet table that all executors share. Each row of docs is one version of some path, of
    which only the content counts. Blobs that the ledger lacks for a version of the rules are scanned and appended to it;
    findings are read from it and go to every row of their blob. A further run, over the same or a later state of the
    paths, scans only what is new, and a new version of rules scans each blob once more for those rules alone. One run
    at a time writes a ledger; if one is lost half-way, its appended rows count as scanned, and repeated rows don't count.

    Nulls: a null text is an empty one. Repeated rows and copies share findings. An empty table gives no rows.
    """
    spark, keep = docs.sparkSession, docs.columns if keep is None else keep
    scan(docs, text_col, read_ledger(spark, ledger), versions).write.mode("append").parquet(ledger)
    known = read_ledger(spark, ledger).filter(F.col("version").isin(list(versions)) & (F.size("spans") > 0))
    found = known.groupBy(F.col("blob").alias("__b")).agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("__spans"))  # a row for each version
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")
    paths = docs.select(*[F.col(f"`{c}`") for c in keep], F.unhex(F.sha2(text, 256)).alias("__blob"))
    joined = paths.join(found, F.col("__blob") == F.col("__b"), "left")
    return joined.select(*[F.col(f"`{c}`") for c in keep], "__blob", F.coalesce("__spans", F.array().cast(_SPANS)).alias("__spans"))
