"""Helpers shared by the text operators: word splitting, lineage cuts and salted running sums."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space, the separators of a word in most contracts: x20 and x09 to x0D.
SPACE = " \t\n\x0b\f\r"
SPACES = r"[\x20\x09-\x0D]+"


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; only where the session names none (tests), a temporary one is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(folder)
        return folder
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        current = tempfile.mkdtemp(prefix="tidemark-checkpoint-")
        spark.sparkContext.setCheckpointDir(current)
    return current


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder; survives the loss of executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of an Arrow batch where rows hold whole texts.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of the session, where they are as large as Spark has them by default, so that a task holds
    few texts at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def written(df: DataFrame) -> DataFrame:
    """The table, written as compressed Parquet in the shared folder and read again column by column."""
    names = [f"c{i}" for i in range(len(df.columns))]
    void = {c for c, k in df.dtypes if k == "void"}
    path = f"{checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.select(*[F.col(f"`{c}`").cast("string" if c in void else df.schema[c].dataType).alias(n) for c, n in zip(df.columns, names, strict=True)]).write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path).select(*[(F.lit(None) if c in void else F.col(n)).alias(c) for c, n in zip(df.columns, names, strict=True)])


def words(text: Column) -> Column:
    """Array of the maximal runs of non-space characters; empty for null."""
    trimmed = F.btrim(text, F.lit(SPACE))
    return F.when(text.isNull() | (trimmed == ""), F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES))


def word_count(text: Column) -> Column:
    """Number of maximal runs of non-space characters; 0 for null."""
    trimmed = F.btrim(text, F.lit(SPACE))
    return F.when(text.isNull() | (trimmed == ""), F.lit(0)).otherwise(F.size(F.split(trimmed, SPACES))).cast("long")


def shuffle_key(*cols: Column, seed: str = "tidemark") -> Column:
    """Hex digest that orders rows at random, but alike in every run and engine."""
    return F.md5(F.concat_ws(":", F.lit(seed), *[F.coalesce(c.cast("string"), F.lit("\\N")) for c in cols]))


def hash_bucket(key: Column, buckets: int) -> Column:
    """Bucket from 0 that rises with a hex digest."""
    return F.floor(F.conv(F.substring(key, 1, 8), 16, 10).cast("long") * F.lit(buckets) / F.lit(1 << 32)).cast("int")


def bucket_count(rows: int, per_bucket: int = 4096) -> int:
    """Buckets so that each group of a window holds about per_bucket rows, however many rows there are."""
    return max(1, -(-rows // per_bucket))


def offsets(totals: DataFrame, group: list[str], bucket: str, value: str, out: str) -> DataFrame:
    """For each (group, bucket) the sum of value over the group's earlier buckets. totals has one row for each of them."""
    w = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumn(out, F.coalesce(F.sum(value).over(w), F.lit(0)).cast("long"))


def shielded(op: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Lets the table of an operator hold columns with the operator's own names, which all begin with two underscores.

    They are renamed meanwhile. Where the operator makes a column of that name, the result has the operator's.
    """

    @functools.wraps(op)
    def run(docs: DataFrame, *args, keep: list[str] | None = None, **named) -> DataFrame:
        keep = docs.columns if keep is None else keep
        used = {x for x in (*args, *named.values()) if isinstance(x, str)}
        hidden = {c: f"hidden{i}{c}" for i, c in enumerate(docs.columns) if c.startswith("__") and c not in used}
        if not hidden:
            return op(docs, *args, keep=keep, **named)
        out = op(docs.withColumnsRenamed(hidden), *args, keep=[hidden.get(c, c) for c in keep], **named)
        back, made = {h: c for c, h in hidden.items()}, set(out.columns)
        return out.select(*[F.col(f"`{c}`").alias(back.get(c, c)) for c in out.columns if back.get(c) not in made])

    return run
