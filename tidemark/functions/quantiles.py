"""Exact quantiles and ranks from range partitions of values: no value's group and no column meets in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.storage import stored


def range_parts(df: DataFrame, order: list[str]) -> DataFrame:
    """The table, stored, with _part: all rows of a part come before those of the next in the order."""
    return stored(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))


def _before(parts: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """For each part (and keys) the weight of the parts before; a row for each."""
    w = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.groupBy(*keys, "_part").agg(F.sum(weight).alias("_w"))
    return sums.select(*keys, "_part", F.coalesce(F.sum("_w").over(w), F.lit(0)).alias("_before"))


def counted(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows (keys, value, _n, _upto): each distinct value, its number, and that of values up to it, within the keys."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    parts = range_parts(counts, [*keys, value])
    before = _before(parts, keys, "_n").withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)}).withColumnRenamed("_part", "_p")
    same = F.col("_part") == F.col("_p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    upto = F.sum("_n").over(Window.partitionBy(*keys, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    return parts.withColumn("_upto", upto).join(before, same).select(*keys, value, "_n", (F.col("_before") + F.col("_upto")).alias("_upto"))


def running_sums(df: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """Adds, for each of columns, {column}_upto: its sum over the keys' rows up to this one in the order, by range parts.
    No two rows of the keys are equal in the order; keys and columns have no nulls."""
    parts = range_parts(df, [*keys, order])
    sums = parts.groupBy(*keys, "_part").agg(*[F.sum(c).alias(f"_w_{c}") for c in columns])
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*keys, "_part", *[F.coalesce(F.sum(f"_w_{c}").over(earlier), F.lit(0)).alias(f"_b_{c}") for c in columns])  # a row for each part
    within = Window.partitionBy(*keys, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    own = parts.withColumns({f"{c}_upto": F.sum(c).over(within) for c in columns})
    d = own.join(before, [*keys, "_part"])
    return d.withColumns({f"{c}_upto": F.col(f"{c}_upto") + F.col(f"_b_{c}") for c in columns}).drop("_part", *[f"_b_{c}" for c in columns])


def quantiles(df: DataFrame, keys: list[str], value: str, probs: tuple[float, ...]) -> DataFrame:
    """Rows (keys, q): for each keys the exact quantiles at probs, interpolated, of the values that aren't null.

    Values are counted first; of the counts only those at the sought places meet, a few for each keys.
    """
    counts = stored(counted(df, keys, value))
    groups = [F.col(k) for k in keys]
    total = counts.groupBy(*keys).agg(F.sum("_n").alias("_all"), F.array(*[F.lit(p) for p in probs]).alias("_ps"))
    names = total.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
    same = F.lit(True)
    for i, k in enumerate(groups):
        same = same & k.eqNullSafe(F.col(f"_k{i}"))
    d = counts.join(names, same) if keys else counts.crossJoin(F.broadcast(total))  # one row
    at = F.transform("_ps", lambda p: p * (F.col("_all") - 1))
    hit = F.exists(at, lambda a: ((F.floor(a) >= F.col("_upto") - F.col("_n")) & (F.floor(a) < F.col("_upto"))) | ((F.ceil(a) >= F.col("_upto") - F.col("_n")) & (F.ceil(a) < F.col("_upto"))))
    found = d.filter(hit).groupBy(*keys).agg(F.first("_all").alias("_all"), F.first("_ps").alias("_ps"), F.sort_array(F.collect_list(F.struct("_upto", F.col(value).alias("_v")))).alias("_rows"))  # two for each of probs at most
    pick = lambda i: F.element_at(F.filter("_rows", lambda r: r["_upto"] > i), 1)["_v"]
    between = lambda a: F.when(F.floor(a) == F.ceil(a), pick(F.floor(a))).otherwise((F.ceil(a) - a) * pick(F.floor(a)) + (a - F.floor(a)) * pick(F.ceil(a)))
    return found.select(*keys, F.transform(F.transform("_ps", lambda p: p * (F.col("_all") - 1)), between).alias("q"))


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds the row's number in the order, from 0; order tells all rows apart."""
    parts = range_parts(df, order)
    before = _before(parts.withColumn("_one", F.lit(1)), [], "_one")
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parts.withColumn(name, own).join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col(name) - 1).drop("_part", "_before")  # a row for each part
