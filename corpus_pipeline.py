"""Training-corpus pipeline: quality rules, near-duplicates, decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written and read again as the next
stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import checkpoint_dir
from tidemark.llm.decontaminate import contamination
from tidemark.llm.mixing import mix
from tidemark.llm.quality import quality
from tidemark.llm.sharding import kd_shards
from tidemark.llm.simhash import drop_near_duplicates
from tidemark.session import ship

SHARDS = 16


def _apply(docs: DataFrame, op: Callable[[DataFrame], DataFrame], added: dict[str, str] | None = None) -> DataFrame:
    """The columns of docs that op(docs) returns, and those added (new name: op's name). Operators name what they make
    with two underscores; columns of docs with such names, or with those added, don't stand in their way."""
    ship(docs.sparkSession)
    own = {c: f"hidden{i}" for i, c in enumerate(docs.columns) if c.startswith("__")}
    out = op(docs.withColumnsRenamed(own))
    kept = [F.col(f"`{own.get(c, c)}`").alias(c) for c in docs.columns if c not in (added or {})]
    return out.select(*kept, *[F.col(old).alias(new) for new, old in (added or {}).items()])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the divergence rule; rows are judged one by one.

    A null or empty text has no words and goes; long texts are judged whole; repeated rows are judged alike; no
    documents give none.
    """
    return _apply(docs, lambda d: quality(d).filter("__kept"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id (five words, a similarity of 0.8).

    Null, empty and blank texts are one group; rows with a null id stay; where an id repeats, its texts are judged one by
    one; of equal rows one stays; no documents give none.
    """
    return _apply(docs, drop_near_duplicates)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item.

    A null or empty text holds none and stays, as does every document where there are no items; repeated rows are judged
    alike; no documents give none.
    """
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _apply(docs, lambda d: contamination(d, benchmark, only_clean=True))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    Documents without words stay once; a null source is a source; repeated rows queue one by one; no documents give none.
    """
    copies = F.explode(F.sequence(F.lit(1), F.col("__copies"))).alias("__copy")
    return _apply(docs, lambda d: mix(d).filter("__copies > 0").select("*", copies))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with shard and slot, which replace columns of that name.

    Null texts are one text, of size 1; repeated rows get a slot each; no documents give none.
    """
    return _apply(docs, lambda d: kd_shards(d, shards=SHARDS), {"shard": "__shard", "slot": "__slot"})


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
    ("shard", shard),
]

#: SimHash has no SQL form; the stages are held against brute force in tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what is between them lies in the shared checkpoint folder."""
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 == len(STAGES):
            return out
        out.write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
