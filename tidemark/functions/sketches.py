"""Sketches stored by series and day, and merged for any span of days: quantiles (KLL) and distinct counts (HLL, theta).

Exact quantiles and counts are in quantiles.py; sketches answer questions about spans without reading the rows again.
A KLL sketch of size k is off by a rank of about 2.3 / k ** 0.9 at most, with 99 % confidence; HLL with 2 ** lg buckets by a
relative 1.04 / sqrt(2 ** lg), one standard deviation; theta with 2 ** lg entries by 1 / sqrt(2 ** lg).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.schema import DAY_US, VIEW, Roles

KLL_K = 400
LG = 12


def rank_error(k: int = KLL_K) -> float:
    """Bound on the share of values by which a quantile's rank is off."""
    return 2.3 / k**0.9


def daily(rows: DataFrame, value: str, item: str, r: Roles = VIEW, k: int = KLL_K, lg: int = LG) -> DataFrame:
    """Rows (series, day, n, low, high, values, items, keys): a day's number of values, extremes and sketches. Partial
    sketches are made where the rows are; a row for each series and day is what there is to store. item is a column of
    whole numbers or strings."""
    d = rows.withColumn("day", F.floor(F.col(r.us) / DAY_US)).withColumn("_v", F.col(value).cast("double"))
    return d.groupBy(r.series, "day").agg(
        F.count("_v").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"), F.kll_sketch_agg_double("_v", k).alias("values"),
        F.hll_sketch_agg(item, lg).alias("items"), F.theta_sketch_agg(item, lg).alias("keys"),
    )


def spans(stored: DataFrame, first: Column, last: Column, by: list[str], k: int = KLL_K, lg: int = LG) -> DataFrame:
    """Sketches of the days first to last, merged by the columns named: only stored rows are read."""
    d = stored.filter((F.col("day") >= first) & (F.col("day") <= last))
    merged = d.groupBy(*by).agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.kll_merge_agg_double("values", k).alias("values"), F.hll_union_agg("items", True).alias("items"), F.theta_union_agg("keys", lg).alias("keys"))
    return merged


def answers(merged: DataFrame, probs: tuple[float, ...]) -> DataFrame:
    """Adds q, the values at probs, n_items by HLL, and n_keys by theta. q is null without values."""
    q = F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("values", F.array(*[F.lit(float(p)) for p in probs])))
    return merged.withColumn("q", q).withColumn("n_items", F.hll_sketch_estimate("items")).withColumn("n_keys", F.theta_sketch_estimate("keys")).drop("values", "items", "keys")
