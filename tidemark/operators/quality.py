"""Data-quality checks; each is a row (check, passed, detail).

Checks of order need the previous row; all others are aggregates, which share one pass or are observed while a table is
written.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tidemark.functions.stats import modal_interval
from tidemark.operators.timeline import lagged
from tidemark.schema import VIEW, Roles


class QualityError(RuntimeError):
    """Raised with the failed checks."""


def increasing(df: DataFrame, r: Roles = VIEW) -> DataFrame:
    """Times rise strictly in the order of ingestion (the sequence column)."""
    by_seq = Roles(series=r.series, us=r.seq, seq=r.seq)
    prev = lagged(df.select(r.series, r.seq, r.us), {r.us: "_before"}, by_seq, bucket_us=1 << 20)
    bad = F.count_if(F.col(r.us) <= F.col("_before"))
    return prev.agg(bad.alias("n")).select(F.lit("timestamps_increasing").alias("check"), (F.col("n") == 0).alias("passed"), F.col("n").cast("double").alias("detail"))


def modal(lags: DataFrame, expected_us: int) -> DataFrame:
    return modal_interval(lags).select(F.lit("modal_interval").alias("check"), (F.col("modal_us") == expected_us).alias("passed"), (F.col("modal_us") / 1e6).alias("detail"))


class Check(NamedTuple):
    """A check without order: aggregates of the table, and the row (check, passed, detail) made of their values."""

    measures: list[Column]
    verdict: Column


def _verdict(check: str, passed: Column, detail: Column) -> Column:
    return F.struct(F.lit(check).alias("check"), passed.alias("passed"), detail.cast("double").alias("detail"))


def binary_check(signals: list[str]) -> Check:
    bad = F.lit(0)
    for c in signals:
        bad = bad + F.count_if(~F.col(c).isin(0, 1) | F.col(c).isNull())
    return Check([bad.alias("not_binary")], _verdict("digitals_binary", F.col("not_binary") == 0, F.col("not_binary")))


def twin_check(a: str, b: str, eps: float, most: float) -> Check:
    apart = F.abs(F.col(a) - F.col(b))
    return Check([F.avg(apart).alias("twin_mean"), F.max(apart).alias("twin_most")], _verdict("twin_sensors", (F.col("twin_mean") < eps) & (F.col("twin_most") < most), F.col("twin_mean")))


def antiphase_check(eps: float, r: Roles = VIEW) -> Check:
    return Check([F.avg(F.col(r.idle) + F.col(r.load)).alias("phase_sum")], _verdict("valve_antiphase", F.abs(F.col("phase_sum") - 1) < eps, F.col("phase_sum")))


def range_check(limits: dict[str, tuple[float, float]], sensors: list[str]) -> Check:
    """Values out of range; sensors without limits and limits without a sensor count as failures too."""
    drift = len(set(limits) ^ set(sensors))
    n = F.lit(0)
    for c in (c for c in sensors if c in limits):
        n = n + F.count_if((F.col(c) < limits[c][0]) | (F.col(c) > limits[c][1]))
    return Check([n.alias("out_of_range")], _verdict("analog_ranges", (F.col("out_of_range") == 0) & F.lit(drift == 0), F.col("out_of_range") + drift))


def in_one_pass(df: DataFrame, checks: list[Check]) -> DataFrame:
    """Rows of all checks from one aggregate over the table."""
    return _judged(df.agg(*[m for c in checks for m in c.measures]), checks)


def _judged(measured: DataFrame, checks: list[Check]) -> DataFrame:
    return measured.select(F.explode(F.array(*[c.verdict for c in checks])).alias("c")).select("c.*")


def watched(df: DataFrame, checks: list[Check]) -> tuple[DataFrame, Callable[[], DataFrame]]:
    """The table, and a function that gives the rows of the checks once the table has been written (or otherwise run as a
    whole): they are measured on the way, without a scan of their own."""
    measures = [m for c in checks for m in c.measures]
    observation = Observation()
    schema = df.agg(*measures).schema
    return df.observe(observation, *measures), lambda: _judged(df.sparkSession.createDataFrame([tuple(observation.get[n] for n in schema.names)], schema), checks)


def binary(df: DataFrame, signals: list[str]) -> DataFrame:
    return in_one_pass(df, [binary_check(signals)])


def twins(df: DataFrame, a: str, b: str, eps: float, most: float) -> DataFrame:
    return in_one_pass(df, [twin_check(a, b, eps, most)])


def antiphase(df: DataFrame, eps: float, r: Roles = VIEW) -> DataFrame:
    return in_one_pass(df, [antiphase_check(eps, r)])


def ranges(df: DataFrame, limits: dict[str, tuple[float, float]], sensors: list[str]) -> DataFrame:
    return in_one_pass(df, [range_check(limits, sensors)])


def run_checks(checks: list[DataFrame], on_fail: str = "raise") -> DataFrame:
    """All checks as one table; with raise a failed one stops the job, with warn it is only told."""
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    if on_fail in ("raise", "warn"):
        failed = [f"{x['check']}: {x['detail']}" for x in out.filter("NOT passed").collect()]  # a row for each check
        if failed and on_fail == "raise":
            raise QualityError("; ".join(failed))
        if failed:
            import warnings

            warnings.warn("; ".join(failed), stacklevel=2)
    return out
