"""Episodes of a state: coarse scan with fine refinement, and exact runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.timeline import lagged, running_count
from tidemark.schema import HOUR_US, VIEW, Roles


def mostly_off(signal: str, share: float = 0.5) -> Column:
    """Predicate of a slice: the signal is 0 for more than the share; False without rows."""
    return F.coalesce(F.avg((F.col(signal) == 0).cast("int")) > share, F.lit(False))


def stuck_instrument(r: Roles = VIEW, var_eps: float = 1e-4, anti_eps: float = 0.5) -> Column:
    """Predicate of a slice: the motor reading doesn't vary and the valves are out of phase."""
    return F.coalesce((F.var_samp(r.motor) < var_eps) & (F.avg((F.col(r.idle) + F.col(r.load) == 1).cast("int")) < anti_eps), F.lit(False))


def state_episodes(df: DataFrame, predicate: Column, lo: int, hi: int, coarse_us: int = 6 * HOUR_US, fine_us: int = HOUR_US // 4, r: Roles = VIEW) -> DataFrame:
    """Episodes (series, episode_start, episode_end) of [lo, hi) in which the predicate holds, for each series.

    Slices of coarse length tell where the state flips; a flip is placed at the first fine slice, from the start of the
    coarse slice before it on, whose state is the new one, never before the flip that precedes it. Episodes without
    length are dropped. coarse_us is a multiple of fine_us.
    """
    if coarse_us % fine_us:
        raise ValueError("the coarse step must be a multiple of the fine step")
    s, rows = r.series, df.filter((F.col(r.us) >= lo) & (F.col(r.us) < hi))

    def states(step: int) -> DataFrame:
        seen = rows.groupBy(s, F.floor((F.col(r.us) - lo) / step).alias("k")).agg(predicate.alias("_state"))
        last = -(-(hi - lo) // step) - 1
        every = rows.select(s).distinct().withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long"))))
        return every.join(seen, [s, "k"], "left").select(s, "k", F.coalesce("_state", F.lit(False)).alias("state"))

    # A series has as many slices as the span has steps; they don't grow with the rows.
    order = Window.partitionBy(s).orderBy("k")
    flips = states(coarse_us).withColumn("before", F.coalesce(F.lag("state").over(order), F.lit(False))).filter("state <> before").select(s, "k", "state")
    ratio = coarse_us // fine_us
    fine = states(fine_us).withColumnRenamed("k", "f").withColumnRenamed("state", "fine_state").withColumn("c", F.floor(F.col("f") / ratio))
    near = flips.withColumn("c", F.explode(F.array(F.col("k") - 1, F.col("k")))).join(fine, [s, "c"]).filter("fine_state = state")
    first = near.groupBy(s, "k").agg(F.min("f").alias("f"))
    at = flips.join(first, [s, "k"], "left").select(s, "k", "state", F.coalesce(F.lit(lo) + F.col("f") * fine_us, F.lit(lo) + F.col("k") * coarse_us).alias("at"))
    clamped = at.withColumn("at", F.max("at").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    paired = clamped.withColumn("next", F.coalesce(F.lead("at").over(order), F.lit(hi))).filter("state AND next > at")
    return paired.select(s, F.col("at").alias("episode_start"), F.col("next").alias("episode_end"))


def run_episodes(df: DataFrame, signal: str, state: int, least_us: int = 0, r: Roles = VIEW) -> DataFrame:
    """Exact episodes: runs of a state from their first to their last row, that last at least so long."""
    prev = lagged(df, {signal: "_prev"}, r)
    runs = running_count(prev, ~F.col(signal).eqNullSafe(F.col("_prev")), "run", r)
    spans = runs.filter(F.col(signal) == state).groupBy(r.series, "run").agg(F.min(r.us).alias("episode_start"), F.max(r.us).alias("episode_end"), F.count(F.lit(1)).alias("n"))
    return spans.filter(F.col("episode_end") - F.col("episode_start") >= least_us).drop("run")
