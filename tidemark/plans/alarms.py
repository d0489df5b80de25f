"""Status of each window and alarms at rising severity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.labels import FAILURES
from tidemark.operators.timeline import lagged, lagged_many, running_count
from tidemark.plans.scoring import BY_TIME, MONTH_US
from tidemark.schema import DAY_US, HOUR_US

LEVELS = ("healthy", "watch", "alert", "critical")
#: What a driver suggests, and what any other does.
FAULTS = {
    "tp3_decay_slope": "air leak (pressure decaying during idle)",
    "oil_median": "overwork heating (compensating for a leak)",
    "oil_std": "unstable thermal behavior",
    "oil_trend": "rising oil temperature",
    "duty": "abnormal load (compressor overworking)",
    "cycles_per_hour": "abnormal cycling rate",
    "cycle_dur_cv": "erratic cycling (short-cycling)",
    "longest_load_stretch": "sustained load without rest",
    "antiphase_share": "valve/pressure signal anomaly",
}
OTHER_FAULT = "abnormal behavior"


def indexed(scored: DataFrame) -> DataFrame:
    """Adds idx, the window's position in its series, from 0."""
    return running_count(scored, F.lit(True), "idx", BY_TIME, MONTH_US).withColumn("idx", F.col("idx") - 1)


def status(scored: DataFrame, t_watch: Column, t_alert: Column, persist: int = 3) -> DataFrame:
    """Adds status: untrusted, else critical (persist windows in a row at alert), alert, watch, healthy."""
    d = scored.withColumn("_high", F.col("zmax") >= t_alert)
    d = lagged_many(d, ["_high"], persist - 1, "_past", BY_TIME, MONTH_US) if persist > 1 else d.withColumn("_past", F.array().cast("array<struct<_high:boolean>>"))
    held = F.col("_high") & (F.size("_past") == persist - 1) & F.forall("_past", lambda x: x["_high"])
    return d.withColumn("status", F.when(F.col("quality_bad"), "untrusted").when(held, "critical").when(F.col("_high"), "alert").when(F.col("zmax") >= t_watch, "watch").otherwise("healthy")).drop("_high", "_past")


def severity(column: str = "status") -> Column:
    """Rank of a status; untrusted ranks with healthy."""
    return F.when(F.col(column) == "watch", 1).when(F.col(column) == "alert", 2).when(F.col(column) == "critical", 3).otherwise(0)


def alarms(with_status: DataFrame, up_to: int | None = None) -> DataFrame:
    """Windows at which the severity rises, with their position idx in the series; of a replay, those up to a position."""
    d = lagged(indexed(with_status).withColumn("_now", severity()), {"_now": "_before"}, BY_TIME, MONTH_US)
    d = d if up_to is None else d.filter(F.col("idx") <= up_to)
    return d.filter(F.col("_now") > F.coalesce("_before", F.lit(0))).select("series_id", "idx", "ws", "win", F.col("status").alias("level"), "zmax", "driver")


def alarm_counts(events: DataFrame) -> DataFrame:
    """Adds n_events and n_alerts: alarms, and those of alert or worse, up to each."""
    d = running_count(events, F.lit(True), "n_events", BY_TIME, MONTH_US)
    return running_count(d, F.col("level").isin("alert", "critical"), "n_alerts", BY_TIME, MONTH_US)


def grouped_by_failure(events: DataFrame, failures=FAILURES, lead_days: int = 14) -> DataFrame:
    """Adds failure: the earliest whose [start - lead, end] holds the alarm, else other."""
    out = None
    for f in sorted(failures, key=lambda f: f.start):
        hit = (F.col("ws") >= f.start - lead_days * DAY_US) & (F.col("ws") <= f.end)
        out = F.when(hit, f.failure_id) if out is None else out.when(hit, f.failure_id)
    return events.withColumn("failure", F.lit("other") if out is None else out.otherwise("other"))


def suspected_fault(driver: Column) -> Column:
    """What a driver suggests."""
    table = F.create_map(*[F.lit(x) for pair in FAULTS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, driver), F.lit(OTHER_FAULT))


def recent_alerts(scored: DataFrame, t_alert: Column, up_to: int, n: int = 8) -> DataFrame:
    """The newest n windows at alert up to a position."""
    return indexed(scored).filter((F.col("idx") <= up_to) & (F.col("zmax") >= t_alert)).orderBy(F.desc("idx")).limit(n).select("idx", "ws", "zmax", "driver")


def tail_view(scored: DataFrame, now: int, n: int = 14 * 24) -> DataFrame:
    """The windows of the positions now - n to now."""
    return indexed(scored).filter((F.col("idx") >= now - n) & (F.col("idx") <= now))


def gauge(with_status: DataFrame, now: int, t_watch: Column, t_alert: Column) -> DataFrame:
    """One row for each series at a position: value, its scale's end and the limits of its bands."""
    top = F.greatest(1.6 * t_alert, 1.25 * F.col("zmax"), F.lit(15.0))
    return indexed(with_status).filter(F.col("idx") == now).select("series_id", "ws", "status", F.least("zmax", top).alias("value"), top.alias("vmax"), t_watch.alias("watch_from"), t_alert.alias("alert_from"))


def timeline_view(with_status: DataFrame, t_alert: Column, now: int, n: int = 14 * 24) -> DataFrame:
    """The tail's windows, which of them is now, which raise an alarm, and the height of the chart."""
    tail = tail_view(with_status, now, n)
    top = tail.agg((F.greatest(F.max("zmax"), F.max(t_alert)) * 1.15).alias("top"))
    raised = alarms(with_status).select("series_id", "ws", F.col("level").alias("alarm"))
    return tail.join(raised, ["series_id", "ws"], "left").crossJoin(F.broadcast(top)).select("series_id", "idx", "ws", "zmax", (F.col("idx") == now).alias("is_now"), "alarm", "top")  # one row


def band(z: Column) -> Column:
    """Magnitude of a driver, from 0 to 3."""
    return F.when(F.abs(z) >= 3, 3).when(F.abs(z) >= 2, 2).when(F.abs(z) >= 1, 1).otherwise(0)


def first_crossing(scored: DataFrame, failures=FAILURES, before_days: int = 3, after_hours: int = 6) -> DataFrame:
    """For each failure the windows from some days before its start to some hours after its end, the first at alert before
    the start, and its lead in hours."""
    spans = F.array(*[F.struct(F.lit(f.failure_id).alias("failure"), F.lit(f.start).alias("start"), F.lit(f.end).alias("end")) for f in failures])
    d = scored.withColumn("f", F.explode(spans)).filter((F.col("ws") >= F.col("f.start") - before_days * DAY_US) & (F.col("ws") <= F.col("f.end") + after_hours * HOUR_US))
    first = F.min(F.when(F.col("alert") & (F.col("ws") < F.col("f.start")), F.col("ws")))
    return d.groupBy("f.failure").agg(F.count(F.lit(1)).alias("n"), F.max("zmax").alias("peak"), first.alias("first_alert"), ((F.max("f.start") - first) / HOUR_US).alias("lead_h"))
