"""Feature families per window. Families are aggregates of one grouping, or of runs and cycles inside the windows."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import registry
from tidemark.functions.quantiles import quantiles
from tidemark.operators.joins import lookback
from tidemark.operators.labels import label, majority
from tidemark.operators.timeline import grid, islands, lagged, segmented, segments, windowed, with_lag
from tidemark.schema import HOUR_US, VIEW, Roles
from tidemark.storage import stored

#: Columns that are scored, in the order in which ties between drivers are resolved.
SCORED = ("duty", "frac_off", "frac_offloaded", "tp3_decay_slope", "cycles_per_hour", "oil_median", "oil_trend", "oil_std", "tp3_std", "duty_std", "cycle_dur_cv", "cycle_dur_trend", "longest_load_stretch", "antiphase_share", "oil_residual")
#: Columns that may be null and are filled with a median of healthy windows.
FILLED = ("duty", "frac_off", "frac_offloaded", "frac_loaded", "tp3_decay_slope", "oil_median", "oil_trend", "oil_std", "tp3_std", "duty_std", "cycle_dur_cv", "cycle_dur_trend", "frac_continuous_load", "antiphase_share", "oil_residual")


def share(condition: Column) -> Column:
    """Share of rows for which the condition holds; null without rows."""
    return F.avg(condition.cast("int"))


def seconds(r: Roles) -> Column:
    """Seconds since the window's start."""
    return (F.col(r.us) - F.col("ws")) / 1e6


def duty_family(r: Roles = VIEW) -> list[Column]:
    m = F.col(r.motor)
    return [F.avg(r.load).alias("duty"), share(m < r.off_max).alias("frac_off"), share((m >= r.off_max) & (m < r.offloaded_max)).alias("frac_offloaded"), share(m >= r.offloaded_max).alias("frac_loaded")]


def thermal_family(r: Roles = VIEW) -> list[Column]:
    return [F.percentile(r.oil, 0.5).alias("oil_median"), F.when(F.count(r.oil) >= 10, F.regr_slope(r.oil, seconds(r))).alias("oil_trend")]


def variability_family(r: Roles = VIEW) -> list[Column]:
    return [F.stddev_samp(r.oil).alias("oil_std"), F.stddev_samp(r.pressure).alias("tp3_std"), F.stddev_samp(r.load).alias("duty_std"), F.avg(r.load).alias("frac_continuous_load")]


def instrument_family(r: Roles = VIEW, eps: float = 1e-6) -> list[Column]:
    frozen = lambda c: F.coalesce(F.var_samp(c) < eps, F.lit(False))
    return [share(F.col(r.idle) + F.col(r.load) == 1).alias("antiphase_share"), frozen(r.motor).alias("motor_frozen"), frozen(r.pressure).alias("tp3_frozen")]


def keys(r: Roles) -> list[str]:
    return [r.series, "seg", "win"]


def decay_slopes(rows: DataFrame, r: Roles = VIEW, least: int = 5) -> DataFrame:
    """Median over a window's idle runs of the slope of the pressure over seconds."""
    runs = islands(rows, keys(r), r.idle, [r.us, r.seq]).filter(F.col(r.idle) == 1)
    per_run = runs.groupBy(*keys(r), "run").agg(F.count(F.lit(1)).alias("n"), F.regr_slope(r.pressure, seconds(r)).alias("slope")).filter(F.col("n") >= least)
    return per_run.groupBy(*keys(r)).agg(F.percentile("slope", 0.5).alias("tp3_decay_slope"))


def load_cycles(rows: DataFrame, partition: list[str], r: Roles = VIEW) -> DataFrame:
    """Durations between consecutive rising edges of the load signal within the partition, numbered from 0."""
    w = Window.partitionBy(*partition).orderBy(r.us, r.seq)
    edges = rows.withColumn("_up", F.col(r.load) - F.lag(r.load).over(w) == 1).filter("_up")
    at = Window.partitionBy(*partition).orderBy(r.us, r.seq)
    timed = edges.withColumn("dur", (F.col(r.us) - F.lag(r.us).over(at)) / 1e6).withColumn("idx", F.row_number().over(at) - 2)
    return timed.select(*partition, "dur", "idx", F.lit(1).alias("edge"))


def cycle_stats(cycles: DataFrame, partition: list[str], suffix: str = "", least: int = 3) -> DataFrame:
    enough = F.count("dur") >= least
    return cycles.groupBy(*partition).agg(
        F.sum("edge").alias(f"rising_edges{suffix}"),
        F.when(enough, F.stddev_samp("dur") / F.avg("dur")).alias(f"cycle_dur_cv{suffix}"),
        F.when(enough, F.regr_slope("dur", "idx")).alias(f"cycle_dur_trend{suffix}"),
    )


def load_stretches(rows: DataFrame, r: Roles = VIEW) -> DataFrame:
    """Longest run under load of a window, in minutes of samples."""
    runs = islands(rows, keys(r), r.load, [r.us, r.seq]).filter(F.col(r.load) == 1).groupBy(*keys(r), "run").agg(F.count(F.lit(1)).alias("n"))
    return runs.groupBy(*keys(r)).agg((F.max("n") * r.sample_seconds / 60).alias("longest_load_stretch"))


def window_table(view: DataFrame, gap_us: float, width_us: int = HOUR_US, r: Roles = VIEW) -> tuple[DataFrame, DataFrame]:
    """(grid, rows in windows). Rows are dealt by window once; the families' groupings and windows reuse that."""
    rows = segmented(with_lag(view, r), gap_us, r)
    segs = segments(rows, r)
    return grid(segs, width_us, r), windowed(rows, segs, width_us, r)


def base_features(tiles: DataFrame, rows: DataFrame, r: Roles = VIEW, **known) -> DataFrame:
    """All families for each window, registered ones included, of empty windows too, and the windows' labels. known:
    failures and intervals of the labels."""
    rows = rows.withColumn("_label", label(F.col(r.us), **known)).repartition(*keys(r))
    extra = [c for family in registry.registered("family").values() for c in family(r)]
    simple = rows.groupBy(*keys(r)).agg(F.count(F.lit(1)).alias("n_samples"), F.sum(r.load).alias("cycles_per_hour"), *duty_family(r), *thermal_family(r), *variability_family(r), *instrument_family(r), majority("_label", F.count(F.lit(1))).alias("label"), *extra)
    out = tiles.join(simple, keys(r), "left")
    for part in (decay_slopes(rows, r), cycle_stats(load_cycles(rows, keys(r), r), keys(r)), load_stretches(rows, r)):
        out = out.join(part, keys(r), "left")
    zero = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("n_samples", "cycles_per_hour", "rising_edges", "longest_load_stretch")}
    false = {c: F.coalesce(F.col(c), F.lit(False)) for c in ("motor_frozen", "tp3_frozen")}
    return out.withColumns(zero | false | {"label": F.coalesce("label", F.lit("empty"))})


def quadratic_fit(features: DataFrame, x: str, y: str, where: Column) -> DataFrame:
    """One row (b0, b1, b2, mx) of y = b0 + b1 d + b2 d^2 with d = x - mx: normal equations, solved by Cramer's rule."""
    used = features.filter(where & F.col(x).isNotNull() & F.col(y).isNotNull())
    centred = used.crossJoin(F.broadcast(used.agg(F.avg(x).alias("mx")))).withColumn("d", F.col(x) - F.col("mx"))  # one row
    s = centred.agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.pow("d", F.lit(k))).alias(f"s{k}") for k in (1, 2, 3, 4)], *[F.sum(F.pow("d", F.lit(k)) * F.col(y)).alias(f"t{k}") for k in (0, 1, 2)], F.max("mx").alias("mx"))
    det = lambda a, b, c, d, e, f, g, h, i: f"({a}*({e}*{i}-{f}*{h})-{b}*({d}*{i}-{f}*{g})+{c}*({d}*{h}-{e}*{g}))"
    whole = det("n", "s1", "s2", "s1", "s2", "s3", "s2", "s3", "s4")
    return s.selectExpr(
        f"try_divide({det('t0', 's1', 's2', 't1', 's2', 's3', 't2', 's3', 's4')}, {whole}) AS b0",
        f"try_divide({det('n', 't0', 's2', 's1', 't1', 's3', 's2', 't2', 's4')}, {whole}) AS b1",
        f"try_divide({det('n', 's1', 't0', 's1', 's2', 't1', 's2', 's3', 't2')}, {whole}) AS b2", "mx",
    )


def oil_fit(features: DataFrame, scope: Column | None = None) -> DataFrame:
    """One row: the quadratic of the oil temperature in the duty, fitted on healthy windows (or on scope)."""
    return quadratic_fit(features, "duty", "oil_median", (F.col("label") == "healthy") if scope is None else scope)


def with_oil_residual(features: DataFrame, scope: Column | None = None, fit: DataFrame | None = None) -> DataFrame:
    """Adds the oil temperature's distance from its quadratic in the duty, fitted here or before."""
    fit = oil_fit(features, scope) if fit is None else fit
    d = F.col("duty") - F.col("mx")
    return features.crossJoin(F.broadcast(fit)).withColumn("oil_residual", F.col("oil_median") - (F.col("b0") + F.col("b1") * d + F.col("b2") * d * d)).drop("b0", "b1", "b2", "mx")  # one row


def with_regime(features: DataFrame, min_cycles: int = 3, locked: float = 0.8, idle: float = 0.05) -> DataFrame:
    """Adds the cycling regime; a window with too few loaded samples is locked, whatever its duty."""
    return features.withColumn("cycling_regime", F.when((F.col("duty") > locked) | (F.col("cycles_per_hour") < min_cycles), "locked").when(F.col("duty") < idle, "idle").otherwise("cycling"))


def prepared(features: DataFrame, scope: Column | None = None) -> DataFrame:
    """Adds {column}_missing and fills nulls with the median of healthy windows (or of scope)."""
    where = (F.col("label") == "healthy") if scope is None else scope
    long = features.filter(where).select(*[F.col(c).cast("double").alias(c) for c in FILLED]).unpivot([], list(FILLED), "name", "value")
    found = F.map_from_entries(F.collect_list(F.struct("name", F.get("q", 0))))  # an entry for each column
    medians = quantiles(long, ["name"], "value", (0.5,)).agg(found.alias("_m")).select(*[F.try_element_at("_m", F.lit(c)).alias(f"_m_{c}") for c in FILLED])
    d = features.crossJoin(F.broadcast(medians))  # one row
    d = d.withColumns({f"{c}_missing": F.col(c).isNull().cast("int") for c in FILLED})
    return d.withColumns({c: F.coalesce(F.col(c), F.col(f"_m_{c}")) for c in FILLED}).drop(*[f"_m_{c}" for c in FILLED])


def build(view: DataFrame, gap_us: float, width_us: int = HOUR_US, r: Roles = VIEW, strict: bool = False, **known) -> DataFrame:
    """The feature table: families, oil residual, regime. Strict raises if a scored column has no value at all."""
    tiles, rows = window_table(view, gap_us, width_us, r)
    base = stored(base_features(tiles, rows, r, **known))  # a row for each window; the raw rows are read once
    out = with_regime(with_oil_residual(base))
    guard(out, SCORED if strict else ())
    return out


def guard(features: DataFrame, columns) -> None:
    """Raises if a column appears twice, or if one of columns is null in all of the rows that there are."""
    twice = sorted({c for c in features.columns if features.columns.count(c) > 1})
    if twice:
        raise ValueError(f"columns that appear twice: {twice}")
    row = features.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(c).alias(c) for c in columns]).first()  # one row
    empty = [c for c in columns if row["_rows"] and not row[c]]
    if empty:
        raise ValueError(f"columns without any value: {empty}")


def multiscale_cycles(view: DataFrame, tiles: DataFrame, span_us: int = 6 * HOUR_US, r: Roles = VIEW) -> DataFrame:
    """Cycle statistics over (end - span, end] of each window; the look-back crosses gaps.

    Rising edges are found once; only they are spread over the windows that look back on them. An edge counts if the row
    before it lies in the look-back too.
    """
    rows = lagged(view.select(r.series, r.us, r.seq, r.load), {r.load: "_load", r.us: "_us"}, r)
    edges = rows.filter(F.col(r.load) - F.col("_load") == 1)
    seen = lookback(edges, tiles.select(r.series, "seg", "win", "we"), [r.series], r.us, span_us).filter(F.col("_us") > F.col("we") - span_us)
    at = Window.partitionBy(*keys(r)).orderBy(r.us, r.seq)
    timed = seen.withColumn("dur", (F.col(r.us) - F.lag(r.us).over(at)) / 1e6).withColumn("idx", F.row_number().over(at) - 2).withColumn("edge", F.lit(1))
    return tiles.join(cycle_stats(timed, keys(r), "_6h").drop("rising_edges_6h"), keys(r), "left")


def spectral(rows: DataFrame, r: Roles = VIEW, least: int = 30, n: int = 200) -> DataFrame:
    """dominant_freq and spectral_entropy of each window's load signal: Lomb-Scargle power with a floating mean at n
    frequencies from one an hour to one a minute; null with fewer rows than least or a constant signal.

    A window's sums of sines and cosines are formed where its rows lie; a window holds an hour of one series.
    """
    freq = np.linspace(1 / 3600, 1 / 60, n)

    def run(table: pa.Table) -> pa.Table:
        key = table.slice(0, 1)
        order = np.argsort(table.column(r.us).to_numpy(), kind="stable")
        t, y = table.column(r.us).to_numpy()[order] / 1e6, table.column(r.load).to_numpy()[order].astype(float)
        best = entropy = None
        if len(y) >= least and y.std() > 0:
            y = y - y.mean()
            angle = 2 * np.pi * freq[:, None] * (t - t[0])
            c, s = np.cos(angle), np.sin(angle)
            cm, sm = c - c.mean(axis=1, keepdims=True), s - s.mean(axis=1, keepdims=True)  # the mean floats
            cc, ss, cs, yc, ys = (cm * cm).sum(axis=1), (sm * sm).sum(axis=1), (cm * sm).sum(axis=1), cm @ y, sm @ y
            power = (ss * yc**2 - 2 * cs * yc * ys + cc * ys**2) / ((cc * ss - cs**2) * (y @ y))
            p = power / power.sum()
            best, entropy = float(freq[np.argmax(power)]), float(-(p * np.log(p + 1e-12)).sum())
        return pa.table([*[key.column(k) for k in keys(r)], pa.array([best], pa.float64()), pa.array([entropy], pa.float64())], [*keys(r), "dominant_freq", "spectral_entropy"])

    given = rows.select(*keys(r), r.us, r.load)
    kinds = ", ".join(f"{k} {t}" for k, t in given.select(*keys(r)).dtypes)
    return given.groupBy(*keys(r)).applyInArrow(run, f"{kinds}, dominant_freq double, spectral_entropy double")


def calendar(features: DataFrame) -> DataFrame:
    """Hour and weekday as points on a circle, and the duty beyond what healthy windows have at that hour."""
    at = F.timestamp_micros("ws")
    turn = lambda x, n: x * F.lit(2 * math.pi / n)
    d = features.withColumns({"hour": F.hour(at), "dow": F.weekday(at)})
    base = d.filter("label = 'healthy'").groupBy("hour").agg(F.avg("duty").alias("_base"))  # 24 rows
    d = d.join(F.broadcast(base), "hour", "left")
    circle = {"hour_sin": F.sin(turn(F.col("hour"), 24)), "hour_cos": F.cos(turn(F.col("hour"), 24)), "dow_sin": F.sin(turn(F.col("dow"), 7)), "dow_cos": F.cos(turn(F.col("dow"), 7))}
    return d.withColumns(circle | {"duty_residual": F.col("duty") - F.col("_base")}).drop("_base")
