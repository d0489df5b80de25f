"""Order-dependent operators over time series: lags, gaps, segments, window grids, islands.

No window runs over a whole series: rows are dealt to buckets of time, each bucket is ordered by itself, and a small
table with a row for each bucket carries values and counts over the edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.quantiles import quantiles
from tidemark.schema import DAY_US, HOUR_US, VIEW, Roles


def lagged(df: DataFrame, columns: dict[str, str], roles: Roles = VIEW, bucket_us: int = DAY_US) -> DataFrame:
    """Adds, for each {column: name}, the column's value in the series' previous row as name; null in the first."""
    s, us, seq = roles.series, roles.us, roles.seq
    d = df.withColumn("_bucket", F.floor(F.col(us) / bucket_us))
    within = Window.partitionBy(s, "_bucket").orderBy(us, seq)
    last = d.groupBy(s, "_bucket").agg(F.max_by(F.struct(*columns), F.struct(us, seq)).alias("_last"))
    carry = last.select(s, "_bucket", F.lag("_last").over(Window.partitionBy(s).orderBy("_bucket")).alias("_carry"))
    d = d.join(carry, [s, "_bucket"]).withColumn("_first", F.row_number().over(within) == 1)
    for c, name in columns.items():
        d = d.withColumn(name, F.when(F.col("_first"), F.col(f"_carry.{c}")).otherwise(F.lag(c).over(within)))
    return d.drop("_bucket", "_carry", "_first")


def lagged_many(df: DataFrame, columns: list[str], k: int, name: str, roles: Roles = VIEW, bucket_us: int = DAY_US) -> DataFrame:
    """Adds name: the structs of columns of the series' k previous rows, the latest first; fewer at the start."""
    s, us, seq = roles.series, roles.us, roles.seq
    d = df.withColumn("_bucket", F.floor(F.col(us) / bucket_us)).withColumn("_it", F.struct(*columns))
    latest = F.slice(F.sort_array(F.collect_list(F.struct(us, seq, F.col("_it"))), asc=False), 1, k)  # of one bucket
    last = d.groupBy(s, "_bucket").agg(F.transform(latest, lambda x: x["_it"]).alias("_last"))
    before = Window.partitionBy(s).orderBy(F.desc("_bucket")).rowsBetween(1, k)  # each bucket has a row at least
    carry = last.select(s, "_bucket", F.slice(F.flatten(F.collect_list("_last").over(before)), 1, k).alias("_carry"))
    within = Window.partitionBy(s, "_bucket").orderBy(F.desc(us), F.desc(seq)).rowsBetween(1, k)
    d = d.join(carry, [s, "_bucket"]).withColumn(name, F.slice(F.concat(F.collect_list("_it").over(within), "_carry"), 1, k))
    return d.drop("_bucket", "_carry", "_it")


def running_count(df: DataFrame, flag: Column, name: str, roles: Roles = VIEW, bucket_us: int = DAY_US) -> DataFrame:
    """Adds the number of rows of the series up to this one for which flag holds."""
    s, us, seq = roles.series, roles.us, roles.seq
    d = df.withColumn("_bucket", F.floor(F.col(us) / bucket_us)).withColumn("_flag", F.when(flag, 1).otherwise(0))
    totals = d.groupBy(s, "_bucket").agg(F.sum("_flag").alias("_n"))
    before = Window.partitionBy(s).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(s, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(s, "_bucket").orderBy(us, seq).rowsBetween(Window.unboundedPreceding, 0)
    return d.join(totals, [s, "_bucket"]).withColumn(name, (F.col("_before") + F.sum("_flag").over(within)).cast("long")).drop("_bucket", "_flag", "_before")


def range_frame(df: DataFrame, span_us: int, aggregates: dict[str, Column], roles: Roles = VIEW, bucket_us: int | None = None) -> DataFrame:
    """Adds, for each {name: aggregate}, the aggregate of the series' rows in (t - span, t].

    Rows are dealt to buckets of time (four spans long unless given, one span at least); those in the last span of a
    bucket go to the next one as well, where they are seen but not given out. Each frame lies in its bucket.
    """
    s, us = roles.series, roles.us
    size = max(bucket_us or 4 * span_us, span_us)
    own = F.floor(F.col(us) / size)
    reach = F.floor((F.col(us) + span_us - 1) / size)
    d = df.withColumn("_own", own).withColumn("_bucket", F.explode(F.sequence(own, reach)))
    frame = Window.partitionBy(s, "_bucket").orderBy(us).rangeBetween(-(span_us - 1), 0)
    return d.withColumns({name: a.over(frame) for name, a in aggregates.items()}).filter("_bucket = _own").drop("_own", "_bucket")


def range_totals(df: DataFrame, span_us: int, totals: dict[str, tuple[str, str | Column]], roles: Roles = VIEW) -> DataFrame:
    """Adds, for each {name: (count, sum, min or max, column)}, its value over the series' rows in (t - span, t].

    What range_frame gives, without going through each frame: rows are totalled by time, and a frame is the end of one
    block of time, a span long, and the beginning of the next. Both are running totals of a block, one from its last row
    backwards. Rows without a time are a frame of their own.
    """
    s, us = roles.series, F.col(roles.us)
    more = {n: {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}[f] for n, (f, _) in totals.items()}
    at = df.groupBy(s, us.alias("_us")).agg(*[getattr(F, f)(c).alias(f"_{n}") for n, (f, c) in totals.items()])
    at = at.withColumn("_block", F.col("_us") - F.pmod("_us", F.lit(span_us)))
    so_far = lambda order: Window.partitionBy(s, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    begun = at.withColumns({f"_begun_{n}": f(f"_{n}").over(so_far("_us")) for n, f in more.items()})
    asked = begun.select(s, "_us", F.lit(True).alias("_asks"), (F.col("_block") - span_us).alias("_block"), (-2 * (F.col("_us") - span_us) - 1).alias("_back"), *[f"_begun_{n}" for n in more])
    both = asked.unionByName(at.withColumn("_back", -2 * F.col("_us")).drop("_us"), allowMissingColumns=True)
    both = both.withColumns({f"_ended_{n}": f(f"_{n}").over(so_far("_back")) for n, f in more.items()}).filter("_asks")

    def whole(n: str) -> Column:
        a, b = F.col(f"_begun_{n}"), F.when(F.col("_us").isNotNull(), F.col(f"_ended_{n}"))
        if totals[n][0] in ("count", "sum"):
            return F.coalesce(a + b, a, b)
        return F.least(a, b) if totals[n][0] == "min" else F.greatest(a, b)

    frames = both.select(F.col(s).alias("_s"), "_us", *[whole(n).alias(n) for n in more])
    return df.join(frames, F.col(s).eqNullSafe(F.col("_s")) & us.eqNullSafe(F.col("_us"))).drop("_s", "_us")


def with_lag(df: DataFrame, roles: Roles = VIEW) -> DataFrame:
    """Adds prev_us and dus, the time since the previous row."""
    return lagged(df, {roles.us: "prev_us"}, roles).withColumn("dus", F.col(roles.us) - F.col("prev_us"))


def median_lag(lags: DataFrame) -> float:
    """Median time between rows: one number, on the driver."""
    found = quantiles(lags.select(F.col("dus").cast("double").alias("dus")), [], "dus", (0.5,)).first()
    return found["q"][0] if found and found["q"] else None


def gaps(lags: DataFrame, threshold_us: float, roles: Roles = VIEW) -> DataFrame:
    """Recording gaps: where the time since the previous row is over the threshold."""
    return lags.filter(F.col("dus") > threshold_us).select(roles.series, F.col("prev_us").alias("gap_start"), F.col(roles.us).alias("gap_end"), (F.col("dus") / 60e6).alias("gap_minutes"))


def segmented(lags: DataFrame, threshold_us: float, roles: Roles = VIEW) -> DataFrame:
    """Adds seg, from 0: a gap over the threshold begins a new segment."""
    return running_count(lags, F.col("dus") > threshold_us, "seg", roles)


def segments(rows: DataFrame, roles: Roles = VIEW) -> DataFrame:
    """First and last time of each segment, and its rows."""
    return rows.groupBy(roles.series, "seg").agg(F.min(roles.us).alias("seg_start"), F.max(roles.us).alias("seg_end"), F.count(F.lit(1)).alias("n"))


def grid(segs: DataFrame, width_us: int = HOUR_US, roles: Roles = VIEW) -> DataFrame:
    """Whole windows of each segment from its start on; the rest at its end has none."""
    n = F.floor((F.col("seg_end") - F.col("seg_start")) / width_us).cast("int")
    tiles = segs.filter(F.col("seg_end") - F.col("seg_start") >= width_us).withColumn("win", F.explode(F.sequence(F.lit(0), n - 1)))
    start = F.col("seg_start") + F.col("win").cast("long") * width_us
    return tiles.select(roles.series, "seg", "win", start.alias("ws"), (start + width_us).alias("we"))


def windowed(rows: DataFrame, segs: DataFrame, width_us: int = HOUR_US, roles: Roles = VIEW) -> DataFrame:
    """Rows that lie in a whole window, with win and ws: by arithmetic, without a range join."""
    us = F.col(roles.us)
    d = rows.join(segs.select(roles.series, "seg", "seg_start", "seg_end"), [roles.series, "seg"])
    d = d.withColumn("win", F.floor((us - F.col("seg_start")) / width_us).cast("int")).withColumn("ws", F.col("seg_start") + F.col("win").cast("long") * width_us)
    return d.filter(F.col("ws") + width_us <= F.col("seg_end")).drop("seg_start", "seg_end")


def islands(df: DataFrame, keys: list[str], state: str, order: list[str], name: str = "run") -> DataFrame:
    """Adds the number of the run of equal states within the keys, from 1."""
    w = Window.partitionBy(*keys).orderBy(*order)
    changed = F.when(F.col(state).eqNullSafe(F.lag(state).over(w)) & F.lag(F.lit(1)).over(w).isNotNull(), 0).otherwise(1)
    return df.withColumn("_new", changed).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def series_runs(df: DataFrame, signals: list[str], roles: Roles = VIEW) -> DataFrame:
    """Runs (series, signal, run, state, n) of each signal over each whole series."""
    prev = lagged(df, {c: f"_prev_{c}" for c in signals}, roles)
    out = None
    for c in signals:
        numbered = running_count(prev, ~F.col(c).eqNullSafe(F.col(f"_prev_{c}")), "run", roles)
        one = numbered.groupBy(roles.series, "run").agg(F.min(c).alias("state"), F.count(F.lit(1)).alias("n")).withColumn("signal", F.lit(c))
        out = one if out is None else out.unionByName(one)
    return out
