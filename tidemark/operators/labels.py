"""Interval labels by priority, window labels, and the fixture intervals of the sensor view."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.schema import HOUR_US


def us(text: str | None) -> int | None:
    """Microseconds of a UTC time like 2024-01-08 00:00."""
    return None if text is None else int(datetime.fromisoformat(text).replace(tzinfo=timezone.utc).timestamp() * 1_000_000)


@dataclass(frozen=True)
class Failure:
    failure_id: str
    fault_type: str
    start: int
    end: int
    maintenance: int | None


#: Known events of the sensor view.
FAILURES = (
    Failure("F1", "air_leak", us("2024-01-08 00:00"), us("2024-01-08 23:59"), None),
    Failure("F2", "air_leak", us("2024-01-14 23:30"), us("2024-01-15 06:00"), us("2024-01-10 12:00")),
    Failure("F3", "air_leak", us("2024-01-19 10:00"), us("2024-01-21 14:30"), us("2024-01-22 16:00")),
    Failure("F4", "air_leak", us("2024-01-26 14:30"), us("2024-01-26 19:00"), us("2024-01-27 00:00")),
)
DEGRADED = ((us("2024-01-08 00:00"), us("2024-01-12 00:00")),)
INVALID = ((us("2024-01-09 04:45"), us("2024-01-10 01:30")),)


def failure_table(spark: SparkSession, failures=FAILURES) -> DataFrame:
    return spark.createDataFrame([(f.failure_id, f.fault_type, f.start, f.end, f.maintenance) for f in failures], "failure_id string, fault_type string, start long, end long, maintenance long")


def label(at: Column, failures=FAILURES, degraded=DEGRADED, invalid=INVALID, prefail_us: int = 48 * HOUR_US, postrepair_us: int = 24 * HOUR_US) -> Column:
    """Label of a time; later rules win: healthy, prefail, infail, postrepair, degraded, invalid."""
    anchor = [f.maintenance if f.maintenance is not None else f.end for f in failures]
    rules = [("invalid", [(at >= lo) & (at <= hi) for lo, hi in invalid]), ("degraded", [(at >= lo) & (at <= hi) for lo, hi in degraded])]
    rules += [("postrepair", [(at > a) & (at <= a + postrepair_us) for a in anchor]), ("infail", [(at >= f.start) & (at <= f.end) for f in failures]), ("prefail", [(at >= f.start - prefail_us) & (at < f.start) for f in failures])]
    out = None
    for name, hits in rules:
        for hit in hits:
            out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.lit("healthy") if out is None else out.otherwise("healthy")


def majority(column: str, n: Column) -> Column:
    """Label of a window from its rows: empty without any, invalid if any is, else the most frequent, the first of ties."""
    return F.when(n == 0, "empty").when(F.max(F.when(F.col(column) == "invalid", 1).otherwise(0)) == 1, "invalid").otherwise(F.mode(column, True))


def relabel_prefail(label_column: Column, at: Column, failures=FAILURES, hours: int = 168) -> Column:
    """Healthy windows up to so many hours before a failure become prefail."""
    near = F.lit(False)
    for f in failures:
        near = near | ((at >= f.start - hours * HOUR_US) & (at < f.start))
    return F.when((label_column == "healthy") & near, "prefail").otherwise(label_column)
