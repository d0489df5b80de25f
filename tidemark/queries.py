"""Registered queries of the engine over the driver's tables. Each takes (spark, sf_dir); doubles are rounded."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import sketches, stats
from tidemark.operators import episodes, joins, labels, quality, timeline
from tidemark.operators.labels import FAILURES, failure_table
from tidemark.functions.quantiles import quantiles
from tidemark.plans import alarms, evaluation, features, models, scorers, scoring, views
from tidemark.schema import DAY_US, HOUR_US, SensorSchema, sensor_view
from tidemark.session import ship
from tidemark.sources import files
from tidemark.storage import checkpoint_folder, stored
from tidemark.streaming import streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
#: Gap thresholds of the sensor view, as multiples of the median lag: for window grids, and for the gap inventory.
GRID_FACTOR, GAP_FACTOR = 10, 6
SENSORS, SIGNALS = ["a1", "a2"], ["dv", "comp"]


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def view(spark: SparkSession, d: str) -> DataFrame:
    return sensor_view(table(spark, d, "events"))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


_kept: dict[tuple, DataFrame] = {}


def kept(make: Query) -> Query:
    """Stores a table once for each application and state of the input files: a changed file makes it anew."""

    @functools.wraps(make)
    def run(spark: SparkSession, d: str) -> DataFrame:
        state = table(spark, d, "events").select("_metadata.file_path", "_metadata.file_modification_time", "_metadata.file_size").distinct().collect()
        key = (spark.sparkContext.applicationId, d, make.__name__, tuple(sorted(map(tuple, state))))
        if key not in _kept:
            _kept[key] = stored(make(spark, d))
        return _kept[key]

    return run


def forget() -> None:
    """Drops the stored tables."""
    _kept.clear()


@kept
def grid_gap(spark: SparkSession, d: str) -> DataFrame:
    """One row: the median lag."""
    lags = timeline.with_lag(view(spark, d).select("series_id", "us", "event_id"))
    return spark.createDataFrame([(timeline.median_lag(lags),)], "lag double")


@kept
def feature_table(spark: SparkSession, d: str) -> DataFrame:
    return features.build(view(spark, d), GRID_FACTOR * grid_gap(spark, d).first()["lag"])


@kept
def score_table(spark: SparkSession, d: str) -> DataFrame:
    return scoring.scored(feature_table(spark, d))


@kept
def tiles_table(spark: SparkSession, d: str) -> DataFrame:
    lags = timeline.with_lag(view(spark, d))
    return timeline.grid(timeline.segments(timeline.segmented(lags, GRID_FACTOR * grid_gap(spark, d).first()["lag"])))


def found_gaps(spark: SparkSession, d: str) -> DataFrame:
    lags = timeline.with_lag(view(spark, d).select("series_id", "us", "event_id"))
    return timeline.gaps(lags, GAP_FACTOR * grid_gap(spark, d).first()["lag"])


def labelled(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d).withColumn("label", labels.label(F.col("us")))


# --- scans, projections, profiles


@query
def p2_range_scan(spark, d):
    v = view(spark, d).filter((F.col("ts") >= F.lit("2024-01-08 00:00:00").cast("timestamp_ntz")) & (F.col("ts") < F.lit("2024-01-09 00:00:00").cast("timestamp_ntz")))
    return v.select("event_id", "us", "a1", "a2", "dv", "comp")


@query
def p3_closed_range(spark, d):
    return stats.between(view(spark, d), FAILURES[2].start, FAILURES[2].end + 1).filter((F.col("us") >= FAILURES[2].start) & (F.col("us") <= FAILURES[2].end)).select("event_id", "us", "a1")


@query
def p11_around_peak(spark, d):
    """Rows up to three before and after the largest reading."""
    v = view(spark, d)
    peak = v.agg(F.max_by(F.col("us"), F.struct("a1", -F.col("us"))).alias("peak"))
    d2 = v.crossJoin(F.broadcast(peak))  # one row
    before = d2.filter("us <= peak").orderBy(F.desc("us"), F.desc("event_id")).limit(4)
    after = d2.filter("us > peak").orderBy("us", "event_id").limit(3)
    return before.unionByName(after).select("event_id", "us", "a1")


@query
def p12_distinct_states(spark, d):
    return view(spark, d).select("event_type", "dv", "comp").dropDuplicates()


@query
def a1_profile(spark, d):
    v = timeline.with_lag(view(spark, d))
    base = v.agg(F.count(F.lit(1)).alias("n_rows"), F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.count_distinct("event_type").alias("n_types"))
    return rounded(base.crossJoin(stats.modal_interval(v)))  # one row each


@query
def a2_interval_histogram(spark, d):
    return stats.interval_distribution(timeline.with_lag(view(spark, d)).withColumn("dus", F.floor(F.col("dus") / 60_000_000)))


@query
def a4_describe(spark, d):
    return rounded(stats.describe(view(spark, d), SENSORS))


@query
def a5_null_counts(spark, d):
    return stats.null_counts(view(spark, d), [*SENSORS, *SIGNALS])


@query
def a6_digital_summary(spark, d):
    return stats.digital_summary(view(spark, d), SIGNALS)


@query
def a7_duty_and_antiphase(spark, d):
    """Duty, antiphase share and conditional motor mean of named spans."""
    v = stats.between(view(spark, d), min(f.start for f in FAILURES) - 2 * DAY_US, max(f.end for f in FAILURES))
    spans = F.array(*[F.struct(F.lit(f.failure_id).alias("span"), F.lit(f.start - 2 * DAY_US).alias("lo"), F.lit(f.end).alias("hi")) for f in FAILURES])
    rows = v.withColumn("s", F.explode(spans)).filter("us >= s.lo AND us < s.hi")
    return rounded(rows.groupBy(F.col("s.span").alias("span")).agg(F.count(F.lit(1)).alias("n"), F.avg("dv").alias("duty"), features.share(F.col("dv") + F.col("comp") == 1).alias("antiphase"), F.avg(F.when(F.col("dv") == 1, F.col("a2"))).alias("motor_loaded")))


@query
def a9_toggles(spark, d):
    return rounded(stats.toggles_per_hour(view(spark, d), "dv", FAILURES[0].start, FAILURES[0].start + 7 * DAY_US).drop("series_id"))


@query
def a10_label_stats(spark, d):
    v = labelled(spark, d)
    out = v.groupBy("label").agg(F.avg("dv").alias("duty"), F.count(F.lit(1)).alias("n"))
    medians = quantiles(stats.unpivoted(v.select("label", "a1", "a2"), ["label"], SENSORS), ["label", "signal"], "value", (0.5,))
    medians = medians.groupBy("label").agg(*[F.max(F.when(F.col("signal") == c, F.get("q", 0))).alias(f"{c}_median") for c in SENSORS])  # two rows
    return rounded(out.join(medians, "label").select("label", "a1_median", "a2_median", "duty", "n"))


@query
def a11_duty_by_hour(spark, d):
    hours = view(spark, d).groupBy(F.hour("ts").alias("hour")).agg(F.avg("dv").alias("duty"), F.count(F.lit(1)).alias("n"))
    return rounded(hours)


@query
def a11_duty_by_weekday(spark, d):
    days = view(spark, d).groupBy(F.weekday("ts").alias("dow")).agg(F.avg("dv").alias("duty"))
    return rounded(days.withColumn("spread", F.max("duty").over(Window.partitionBy(F.lit(1))) - F.min("duty").over(Window.partitionBy(F.lit(1)))))  # seven rows


@query
def a16_window_labels(spark, d):
    v = view(spark, d)
    lags = timeline.with_lag(v)
    rows = timeline.segmented(lags, GRID_FACTOR * grid_gap(spark, d).first()["lag"])
    segs = timeline.segments(rows)
    inside = timeline.windowed(rows, segs).withColumn("_label", labels.label(F.col("us")))
    per = inside.groupBy("series_id", "seg", "win").agg(labels.majority("_label", F.count(F.lit(1))).alias("label"), F.count(F.lit(1)).alias("n"))
    out = timeline.grid(segs).join(per, ["series_id", "seg", "win"], "left")
    return out.select("seg", "win", "ws", F.coalesce("label", F.lit("empty")).alias("label"), F.coalesce("n", F.lit(0)).alias("n"))


@query
def a17_run_summary(spark, d):
    return stats.run_summary(view(spark, d), SIGNALS)


@query
def a18_episode_stats(spark, d):
    inside = joins.inside_any(F.col("us"), [(f.start, f.end) for f in FAILURES])
    return view(spark, d).groupBy(inside.alias("inside")).agg(F.count(F.lit(1)).alias("n"), F.bround(F.avg("dv"), 3).alias("duty"), F.bround(F.avg("a2"), 3).alias("motor_mean"), F.bround(features.share(F.col("a2") < 20), 3).alias("share_low"))


@query
def a19_gap_context(spark, d):
    g = found_gaps(spark, d)
    near = F.lit(False)
    for f in FAILURES:
        near = near | ((F.col("gap_end") >= f.start - 3 * DAY_US) & (F.col("gap_start") <= f.end + 3 * DAY_US))
    g = g.withColumn("near", near)
    g = stored(g)
    halves = quantiles(g, ["near"], "gap_minutes", (0.5,)).agg(*[F.bround(F.max(F.when(F.col("near") == side, F.get("q", 0))), 1).alias(name) for side, name in ((True, "median_near_min"), (False, "median_far_min"))])  # two rows
    base = g.agg(F.count_if("near").alias("n_near"), F.count_if(~F.col("near")).alias("n_far"), F.bround(F.max(F.when(F.col("near"), F.col("gap_minutes"))), 1).alias("max_near_min"))
    top = g.orderBy(F.desc("gap_minutes"), "gap_start").limit(20).agg(F.bround(features.share(F.col("near")), 2).alias("share_of_top20_near"))
    return base.crossJoin(halves).crossJoin(top)  # one row each


@query
def a20_effect_sizes(spark, d):
    return stats.effect_sizes(labelled(spark, d), F.col("label"), ["a1", "a2", "dv", "comp"], "healthy", "prefail", SIGNALS)


@query
def a21_effect_by_failure(spark, d):
    return stats.prefail_effects(labelled(spark, d), "us", "label", ["a1", "a2", "dv", "comp"], SIGNALS, hours=168)


@query
def a22_feature_effects(spark, d):
    f = feature_table(spark, d)
    return stats.prefail_effects(f, "ws", "label", ["duty", "oil_median", "oil_std", "antiphase_share"], [], healthy_wins=False)


@query
def a24_base_rates(spark, d):
    g = joins.nearest_event(found_gaps(spark, d), failure_table(spark), "gap_start")
    span = view(spark, d).agg(((F.max("us") - F.min("us")) / DAY_US).alias("span_days"))
    n = 3 * len(FAILURES) - sum(f.maintenance is None for f in FAILURES)
    middle = quantiles(g, [], "days_away", (0.5,)).select(F.get("q", 0).alias("median_days"))
    out = g.agg(features.share(F.col("days_away") <= 3).alias("share_within_3d")).crossJoin(middle).crossJoin(span)  # one row each
    return rounded(out.select("share_within_3d", "median_days", F.least(F.lit(1.0), F.lit(6.0 * n) / F.col("span_days")).alias("chance")))


@query
def a25_pearson(spark, d):
    return rounded(stats.correlations(view(spark, d), ["a1", "a2", "dv", "comp"]))


@query
def a26_spearman(spark, d):
    return rounded(stats.spearman(view(spark, d), ["a1", "a2"]))


@query
def a27_histogram(spark, d):
    return stats.histogram(view(spark, d), "a1", 60)


@query
def a28_box_stats(spark, d):
    return rounded(stats.box_stats(view(spark, d), "a1"))


@query
def a29_distinct_counts(spark, d):
    v = view(spark, d)
    return stats.unpivoted(v.agg(*[F.count_distinct(c).alias(c) for c in ("a1", "a2", "dv", "comp")]), [], ["a1", "a2", "dv", "comp"], "column", "n_distinct")


@query
def a30_pivot(spark, d):
    e = evaluation.evaluate(score_table(spark, d), ["zmax"])
    wide = e.groupBy("model").pivot("target", ["F1", "F2", "F3", "F4", "degraded"]).agg(F.avg("roc_auc"))
    return rounded(spark.createDataFrame([("zmax",)], "model string").join(wide, "model", "left"))  # without windows a row of nulls


@query
def a31_label_counts(spark, d):
    return labelled(spark, d).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query
def a32_no_cycle_windows(spark, d):
    f = feature_table(spark, d)
    few = F.col("cycles_per_hour") < 3
    return f.agg(F.count_if((F.col("duty") < 0.05) & few).alias("idle"), F.count_if((F.col("duty") > 0.8) & few).alias("locked"), F.count_if(~few).alias("cyclable"), F.count_if(F.col("n_samples") < 5).alias("thin"))


@query
def a34_health_by_label(spark, d):
    f = feature_table(spark, d)
    return rounded(f.groupBy("label").agg(F.avg("antiphase_share").alias("antiphase"), F.avg(F.col("motor_frozen").cast("int")).alias("motor_frozen"), F.count(F.lit(1)).alias("n")))


@query
def a35_missing_rates(spark, d):
    p = scoring.prepared(feature_table(spark, d))
    names = [f"{c}_missing" for c in ("tp3_decay_slope", "oil_trend", "cycle_dur_cv", "duty")]
    return rounded(stats.unpivoted(p.agg(*[F.avg(c).alias(c) for c in names]), [], names, "column", "rate"))


@query
def a36_hourly_probe(spark, d):
    hours = view(spark, d).groupBy((F.floor(F.col("us") / HOUR_US) * HOUR_US).alias("hour_us")).agg(F.var_samp("a2").alias("motor_var"), features.share(F.col("dv") + F.col("comp") == 1).alias("antiphase"))
    return rounded(hours)


@query
def a39_score_summary(spark, d):
    s = score_table(spark, d)
    return rounded(s.agg(*[F.avg(F.when(F.col(c), F.col("zmax"))).alias(f"mean_{c}") for c in ("is_train", "is_val", "is_eval_fail", "is_eval_degr")]).crossJoin(quantiles(s, [], "zmax", (0.5,)).select(F.get("q", 0).alias("median_all"))))  # one row each


@query
def a40_antiphase_sums(spark, d):
    return view(spark, d).groupBy((F.col("dv") + F.col("comp")).alias("total")).agg(F.count(F.lit(1)).alias("n"))


@query
def a41_label_month_rollup(spark, d):
    return labelled(spark, d).rollup("label", F.month("ts").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("a1"), 6).alias("a1_mean"))


# --- quality


@query
def q7_checks(spark, d):
    v = view(spark, d).withColumn("unloaded", 1 - F.col("dv"))  # tells the same as comp, but for errors
    order = v.select("series_id", "us", "event_id")
    others = [quality.binary_check(SIGNALS), quality.twin_check("comp", "unloaded", 0.01, 0.5), quality.antiphase_check(0.02), quality.range_check({"a1": (0.0, 90.0), "a2": (0.0, 100.0)}, SENSORS)]
    checks = [quality.increasing(order), quality.modal(timeline.with_lag(order), 10_000_000), quality.in_one_pass(v, others)]
    return rounded(quality.run_checks(checks, on_fail="ignore"))


# --- order


@query
def w1_lag(spark, d):
    return timeline.with_lag(view(spark, d)).select("event_id", "us", "prev_us", "dus")


@query
def w2_gap_inventory(spark, d):
    return rounded(found_gaps(spark, d).select("gap_start", "gap_end", "gap_minutes"))


@query
def w3_segments(spark, d):
    lags = timeline.with_lag(view(spark, d))
    return timeline.segments(timeline.segmented(lags, GRID_FACTOR * grid_gap(spark, d).first()["lag"])).drop("series_id")


@query
def w4_window_grid(spark, d):
    return tiles_table(spark, d).drop("series_id")


@query
def w5_runs(spark, d):
    return stats.series_runs(view(spark, d), ["dv"]).groupBy("state", "n").agg(F.count(F.lit(1)).alias("n_runs"))


@query
def e1_state_episodes(spark, d):
    lo, hi = labels.us("2024-01-01 00:00"), labels.us("2024-01-31 00:00")
    return episodes.state_episodes(view(spark, d), episodes.mostly_off("dv", 0.6), lo, hi).drop("series_id")


@query
def e4_run_episodes(spark, d):
    return episodes.run_episodes(view(spark, d), "dv", 0, HOUR_US // 4).drop("series_id")


# --- joins


@query
def j1_asof(spark, d):
    v = view(spark, d)
    tiles = tiles_table(spark, d).withColumn("at", F.col("ws") + 90_000_000)
    return joins.asof(tiles, v.withColumn("right_us", F.col("us")), "at", "us", ["series_id"], ["a1", "right_us"], "event_id").select("seg", "win", "at", "a1", "right_us")


@query
def j2_gaps_near_failures(spark, d):
    return joins.interval_overlap(found_gaps(spark, d), failure_table(spark))


@query
def j3_gaps_nearest_event(spark, d):
    top = found_gaps(spark, d).orderBy(F.desc("gap_minutes"), "gap_start").limit(15)
    return rounded(joins.nearest_event(top, failure_table(spark), "gap_start").select("gap_start", "gap_end", "gap_minutes", "nearest_event", "days_away"))


@query
def j4_episode_nearest(spark, d):
    e = episodes.run_episodes(view(spark, d), "dv", 0, HOUR_US // 2)
    return joins.nearest_event(e, failure_table(spark), "episode_start").select("episode_start", "nearest_event", "days_away")


@query
def j5_failure_rows(spark, d):
    return joins.nearest_row(alarms.indexed(feature_table(spark, d).select("series_id", "ws", "seg", "win")), failure_table(spark), "ws", "idx")


@query
def j6_inside_outside(spark, d):
    """Readings inside and outside of all failures, in one pass."""
    v = joins.inside(view(spark, d), failure_table(spark), "us", "start", "end")
    return v.groupBy(F.when(F.col("inside"), "left_semi").otherwise("left_anti").alias("side")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("a1"), 6).alias("a1_mean"))


def many_events(spark: SparkSession, d: str) -> DataFrame:
    """Thirty intervals for each event, as a list of known events that is too long to be sent to all tasks."""
    k = view(spark, d).select("event_id", "us", F.explode(F.sequence(F.lit(0), F.lit(29))).alias("k"))
    key = F.col("event_id") * 30 + F.col("k")
    start = F.col("us") + F.col("k") * 3_000_000
    end = start + F.when(key % 5000 == 0, 6 * HOUR_US).otherwise((key * 7919) % 20_000_000)
    return k.select(key.cast("string").alias("failure_id"), start.alias("start"), end.alias("end"), F.when(F.col("k") % 3 == 0, end + HOUR_US).alias("maintenance"))


@query
def j2_gaps_near_many(spark, d):
    """Gaps that overlap any of a long list of intervals."""
    return joins.interval_overlap(found_gaps(spark, d), many_events(spark, d), pad_us=0)


@query
def j3_nearest_of_many(spark, d):
    """For each reading the nearest start, end or maintenance of a long list."""
    v = view(spark, d).select("event_id", (F.col("us") + 130_000_000).alias("at"))
    return joins.nearest_event(v, many_events(spark, d), "at").select("event_id", "nearest_event", "days_away")


@query
def j5_rows_of_many(spark, d):
    """For each event of a long list the reading closest to its start."""
    return joins.nearest_row(view(spark, d), many_events(spark, d), "us", "event_id")


@query
def j6_members_of_many(spark, d):
    """Whether a time soon after each reading lies in any interval of a long list."""
    v = view(spark, d).select("event_id", (F.col("us") + 130_000_000).alias("at"))
    return joins.inside(v, many_events(spark, d), "at", "start", "end").select("event_id", "inside")


@query
def j8_lookback_cycles(spark, d):
    v = view(spark, d)
    tiles = tiles_table(spark, d)
    return rounded(features.multiscale_cycles(v, tiles).select("seg", "win", "cycle_dur_cv_6h", "cycle_dur_trend_6h"), 4)


# --- streams: what has left them when the watermark, an hour behind the last reading, stops


def event_stream(spark: SparkSession, d: str) -> DataFrame:
    schema = table(spark, d, "events").schema
    return streams.timed(sensor_view(streams.replay(spark, f"{d}/events.parque[t]", schema)), late="1 hour")  # a pattern may name a file


@query
def st1_tumbling(spark, d):
    return rounded(streams.drained(streams.window_features(event_stream(spark, d))))


@query
def st2_sliding(spark, d):
    return rounded(streams.drained(streams.window_features(event_stream(spark, d), "1 hour", "20 minutes")).select("ws", "we", "n", "duty", "oil_trend"))


@query
def st3_gap_sessions(spark, d):
    """Segments between gaps of ten median lags."""
    gap = int(GRID_FACTOR * grid_gap(spark, d).first()["lag"])
    return streams.drained(streams.gap_sessions(event_stream(spark, d), f"{gap} microseconds"))


@query
def st4_coverage(spark, d):
    """Hours that hold nine tenths of the readings that the median lag makes one expect."""
    expected = max(1, round(HOUR_US / grid_gap(spark, d).first()["lag"]))
    return rounded(streams.drained(streams.covered(streams.window_features(event_stream(spark, d)), expected, 0.9)).select("ws", "n", "coverage"))


@query
def st5_segment_windows(spark, d):
    """Features of the windows anchored at segments."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    ship(spark)
    streams.stateful(spark)
    try:
        closed = streams.drained(streams.segment_windows(event_stream(spark, d), GRID_FACTOR * grid_gap(spark, d).first()["lag"]))
    finally:
        spark.conf.set(key, before)
    return rounded(streams.window_table(closed).select("seg", "win", "ws", "we", "n_samples", "label", "duty", "oil_median", "oil_std", "tp3_decay_slope", "rising_edges", "longest_load_stretch"), 4)


# --- labels and features


@query
def l1_labels(spark, d):
    return labelled(spark, d).select("event_id", "label")


@query
def l2_relabelled(spark, d):
    return labelled(spark, d).groupBy(labels.relabel_prefail(F.col("label"), F.col("us")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


def _columns(name: str, doc: str, *columns: str) -> None:
    def run(spark, d):
        return rounded(feature_table(spark, d).select("seg", "win", *columns), 4)

    run.__name__, run.__doc__ = name, doc
    query(run)


_columns("fe1_duty", "Duty and motor modes.", "duty", "frac_off", "frac_offloaded", "frac_loaded")
_columns("fe2_pressure", "Pressure decay and loaded samples.", "tp3_decay_slope", "cycles_per_hour", "rising_edges")
_columns("fe3_thermal", "Oil temperature.", "oil_median", "oil_trend")
_columns("fe4_residual", "Oil temperature beyond what the duty tells.", "oil_residual")
_columns("fe5_variability", "Spread and cycles.", "oil_std", "tp3_std", "duty_std", "cycle_dur_cv", "cycle_dur_trend", "longest_load_stretch")
_columns("fe7_instrument", "Trust in the instruments.", "antiphase_share", "motor_frozen", "tp3_frozen")
_columns("fe10_regime", "Cycling regime.", "cycling_regime")
_columns("fe9_features", "The whole feature table.", "ws", "we", "n_samples", "label", "cycling_regime", *features.SCORED)


@query
def fe11_prepared(spark, d):
    p = scoring.prepared(feature_table(spark, d))
    return rounded(p.select("seg", "win", *features.FILLED, "tp3_decay_slope_missing", "oil_trend_missing", "cycle_dur_cv_missing"), 4)


# --- scores


@query
def m2_split(spark, d):
    return scoring.time_split(feature_table(spark, d)).select("seg", "win", "is_train", "is_val", "is_eval_fail", "is_eval_degr")


@query
def m3_scaler(spark, d):
    return rounded(scoring.scaler(scoring.time_split(scoring.prepared(feature_table(spark, d)))).select("_mu_duty", "_sd_duty", "_mu_oil_std", "_sd_oil_std").toDF("mu_duty", "sd_duty", "mu_oil_std", "sd_oil_std"))


@query
def m5_zmax(spark, d):
    """Flagship: windows with their score, alert, driver and trust."""
    return rounded(score_table(spark, d).select("seg", "win", "ws", "we", "label", "zmax", "alert", "quality_bad"), 5)


@query
def m13_driver_frequency(spark, d):
    return score_table(spark, d).filter("is_eval_fail").groupBy("driver").agg(F.count(F.lit(1)).alias("n"))


@query
def m14_ablation(spark, d):
    s = score_table(spark, d)
    without = [c for c in features.SCORED if not c.startswith("cycle")]
    s = s.withColumn("zmax_plain", scoring.zmax(without))
    return rounded(evaluation.roc_auc(evaluation.by_score(evaluation.long_table(s, ["zmax", "zmax_plain"]))))


@query
def m6_mahalanobis(spark, d):
    out, _ = scoring.mahalanobis(scoring.time_split(scoring.prepared(feature_table(spark, d))))
    return rounded(out.select("seg", "win", "mahalanobis"), 4)


@query
def m8_forecast_residual(spark, d):
    return rounded(scoring.forecast_residual(scoring.prepared(feature_table(spark, d)), "oil_median").select("seg", "win", "forecast_residual"), 4)


@query
def o4_top_drivers(spark, d):
    s = score_table(spark, d).withColumn("t", F.explode(scoring.top_drivers(k=3)))
    return s.groupBy(F.col("t.column").alias("column")).agg(F.count(F.lit(1)).alias("n"))


@query
def o5_driver(spark, d):
    return score_table(spark, d).select("seg", "win", "driver")


@query
def o3_recent_alerts(spark, d):
    s = score_table(spark, d)
    return rounded(alarms.recent_alerts(s, F.col("thr"), 600).select("idx", "ws", "zmax"), 5)


# --- evaluation


@query
def ev2_evaluation(spark, d):
    return rounded(evaluation.evaluate(score_table(spark, d), ["zmax"]))


@query
def ev3_roc(spark, d):
    return rounded(evaluation.roc_auc(evaluation.by_score(evaluation.long_table(score_table(spark, d), ["zmax"]))))


@query
def ev4_ap(spark, d):
    return rounded(evaluation.average_precision(evaluation.by_score(evaluation.long_table(score_table(spark, d), ["zmax"]))))


@query
def ev8_sweep(spark, d):
    return rounded(evaluation.threshold_sweep(score_table(spark, d)))


@query
def ev10_false_alarms(spark, d):
    s = score_table(spark, d).filter("is_val AND alert")
    return s.groupBy(F.month(F.timestamp_micros("ws")).alias("month")).agg(F.count(F.lit(1)).alias("n"))


@query
def ev11_descriptive(spark, d):
    s = score_table(spark, d)
    s = s.filter(F.col("label").isin("healthy", "prefail", "infail"))
    middle = quantiles(s, ["label"], "zmax", (0.5,)).select("label", F.get("q", 0).alias("median_z"))
    return rounded(s.groupBy("label").agg(F.count(F.lit(1)).alias("n")).join(middle, "label"), 5)


# --- status and alarms


@kept
def status_table(spark: SparkSession, d: str) -> DataFrame:
    s = score_table(spark, d)
    return alarms.status(s.withColumn("t_watch", F.col("thr") * 0.6), F.col("t_watch"), F.col("thr") * 0.8)


@query
def d1_status(spark, d):
    return status_table(spark, d).select("seg", "win", "status")


@query
def d2_alarms(spark, d):
    return alarms.alarms(status_table(spark, d)).select("idx", "ws", "level")


@query
def d2_alarms_replayed(spark, d):
    """Alarms that a replay has raised when it stands at window 400."""
    return alarms.alarms(status_table(spark, d), 400).select("idx", "ws", "level")


@query
def d3_alarm_groups(spark, d):
    return alarms.grouped_by_failure(alarms.alarms(status_table(spark, d))).groupBy("failure", "level").agg(F.count(F.lit(1)).alias("n"))


@query
def d4_suspected_faults(spark, d):
    return alarms.alarms(status_table(spark, d)).groupBy(alarms.suspected_fault(F.col("driver")).alias("fault")).agg(F.count(F.lit(1)).alias("n"))


@query
def d5_alarm_counts(spark, d):
    return alarms.alarm_counts(alarms.alarms(status_table(spark, d))).select("idx", "n_events", "n_alerts")


@query
def d7_failure_timeline(spark, d):
    s = score_table(spark, d)
    f = FAILURES[3]
    return rounded(s.filter((F.col("ws") >= f.start - 3 * DAY_US) & (F.col("ws") <= f.end + 6 * HOUR_US)).select("ws", "zmax", "alert"), 5)


# --- further tables of the figures, the dashboard and the models


@query
def a11_healthy_hours(spark, d):
    """Duty of healthy readings by hour, and its spread."""
    hours = labelled(spark, d).filter("label = 'healthy'").groupBy(F.hour("ts").alias("hour")).agg(F.avg("dv").alias("duty"), F.count(F.lit(1)).alias("n"))
    spread = hours.agg((F.max("duty") - F.min("duty")).alias("spread"))
    return rounded(hours.crossJoin(F.broadcast(spread)))  # one row


@query
def a23_effect_matrix(spark, d):
    """Shift of each family's feature before each failure, in healthy interquartile ranges (1 where that is 0)."""
    chosen = ["duty", "tp3_decay_slope", "oil_residual", "cycle_dur_cv", "antiphase_share"]
    f = stats.unpivoted(feature_table(spark, d).select("ws", "label", *chosen), ["ws", "label"], chosen, "feature")
    base = quantiles(f.filter("label = 'healthy'"), ["feature"], "value", (0.25, 0.5, 0.75)).withColumnRenamed("q", "b")
    spans = F.explode(F.array(*[F.struct(F.lit(x.failure_id).alias("failure"), F.lit(x.start - 48 * HOUR_US).alias("lo"), F.lit(x.start).alias("hi")) for x in FAILURES]))
    before = f.withColumn("s", spans).filter("ws >= s.lo AND ws < s.hi").select(F.col("s.failure").alias("failure"), "feature", "value")
    iqr = F.get("b", 2) - F.get("b", 0)
    out = quantiles(before, ["failure", "feature"], "value", (0.5,)).join(base, "feature")
    return rounded(out.select("failure", "feature", ((F.get("q", 0) - F.get("b", 1)) / F.when(iqr == 0, 1.0).otherwise(iqr)).alias("shift")), 5)


@query
def a27_density(spark, d):
    """Histogram as a density, and the logarithm of its counts."""
    v = view(spark, d)
    size = v.agg(F.count("a1").alias("all"), ((F.max("a1") - F.min("a1")) / 50).alias("width"))
    h = stats.histogram(v, "a1", 50).crossJoin(F.broadcast(size))  # one row
    return rounded(h.select("bin", "n", (F.col("n") / (F.col("all") * F.col("width"))).alias("density"), F.log10("n").alias("log10_n")), 8)


@query
def a38_span_details(spark, d):
    """Motor reading under load and recording gaps of each failure's span."""
    spans = F.explode(F.array(*[F.struct(F.lit(x.failure_id).alias("failure"), F.lit(x.start - DAY_US).alias("lo"), F.lit(x.end + DAY_US).alias("hi")) for x in FAILURES]))
    v = stats.between(view(spark, d), min(f.start for f in FAILURES) - DAY_US, max(f.end for f in FAILURES) + DAY_US)
    seen = v.withColumn("s", spans).filter("us >= s.lo AND us < s.hi").groupBy(F.col("s.failure").alias("failure")).agg(F.avg(F.when(F.col("dv") == 1, F.col("a2"))).alias("motor_loaded"), F.min("us").alias("lo"), F.max("us").alias("hi"))
    inside = found_gaps(spark, d).join(F.broadcast(seen), (F.col("gap_start") >= F.col("lo")) & (F.col("gap_end") <= F.col("hi"))).groupBy("failure").agg(F.count(F.lit(1)).alias("n"))  # a row for each failure
    return rounded(seen.join(inside, "failure", "left").select("failure", "motor_loaded", F.coalesce("n", F.lit(0)).alias("gaps_inside")))


def scored_plain(spark: SparkSession, d: str) -> DataFrame:
    return score_table(spark, d).withColumn("zmax_plain", scoring.zmax([c for c in features.SCORED if not c.startswith("cycle")]))


@query
def a39_describe_scores(spark, d):
    return rounded(stats.describe(scored_plain(spark, d), ["zmax", "zmax_plain"]), 5)


@query
def a40_twin_difference(spark, d):
    """How far the idle channel and the one that should be its opposite are apart, by whether they disagree, and the
    difference of the readings beside them."""
    v = view(spark, d).withColumn("difference", F.abs(F.col("comp") - (1 - F.col("dv"))))
    return rounded(v.groupBy("difference").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("a1") - F.col("a2"))).alias("apart_mean"), F.max(F.abs(F.col("a1") - F.col("a2"))).alias("apart_most")))


@query
def d6_gauge(spark, d):
    s = status_table(spark, d)
    return rounded(alarms.gauge(s, 400, F.col("t_watch"), F.col("thr") * 0.8).drop("series_id"), 5)


@query
def d6_timeline(spark, d):
    return rounded(alarms.timeline_view(status_table(spark, d), F.col("thr") * 0.8, 600).drop("series_id"), 5)


@query
def d6_driver_bars(spark, d):
    """The largest deviations of the window at which the third failure starts, with their bands."""
    now = score_table(spark, d).filter(F.col("ws") >= FAILURES[2].start).agg(F.min("ws").alias("ws"))
    s = score_table(spark, d).join(F.broadcast(now), "ws").withColumn("t", F.explode(scoring.top_drivers()))  # one row
    return rounded(s.select(F.col("t.column").alias("column"), F.abs("t.z").alias("z"), alarms.band(F.col("t.z")).alias("band")), 5)


@query
def d7_first_crossings(spark, d):
    return rounded(alarms.first_crossing(score_table(spark, d)), 5)


@query
def ev10_false_alarm_list(spark, d):
    return rounded(score_table(spark, d).filter("is_val AND alert").select("ws", "zmax", "driver"), 5)


@query
def ev10_high_healthy(spark, d):
    """Validation windows that score nearly as high as an alarm, by month."""
    s = score_table(spark, d).filter(F.col("is_val") & (F.col("zmax") > F.col("thr") * 0.75))
    return s.groupBy(F.month(F.timestamp_micros("ws")).alias("month")).agg(F.count(F.lit(1)).alias("n"), F.min("ws").alias("first_ws"))


@query
def j10_window_of_key(spark, d):
    """Features of the windows that hold an alarm, by the exact key of their start."""
    keys = alarms.alarms(status_table(spark, d)).select("series_id", "ws")
    return rounded(feature_table(spark, d).join(keys, ["series_id", "ws"]).select("ws", "duty", "oil_median", "label"), 4)


@query
def w12_tail(spark, d):
    return rounded(alarms.tail_view(score_table(spark, d), 500).select("idx", "ws", "zmax"), 5)


@query
def m1_matrix(spark, d):
    x = models.matrix(feature_table(spark, d))
    return rounded(x.select("seg", "win", "motor_frozen", "tp3_frozen", "regime_cycling", "regime_idle", "regime_locked", "rising_edges", "duty"), 4)


@query
def fe12_calendar(spark, d):
    return rounded(features.calendar(feature_table(spark, d)).select("seg", "win", "hour_sin", "hour_cos", "dow_sin", "dow_cos", "duty_residual"), 5)


@query
def fe6_spectral(spark, d):
    lags = timeline.with_lag(view(spark, d))
    rows = timeline.segmented(lags, GRID_FACTOR * grid_gap(spark, d).first()["lag"])
    return rounded(features.spectral(timeline.windowed(rows, timeline.segments(rows)), least=10).drop("series_id"), 6)


@query
def o8_without_second(spark, d):
    """Drivers by how often they lead, without the second, of which the first three."""
    n = score_table(spark, d).groupBy("driver").agg(F.count(F.lit(1)).alias("n"))
    k = F.row_number().over(Window.orderBy(F.desc("n"), "driver"))  # a row for each column
    return n.withColumn("k", k).filter("k <> 2").orderBy("k").limit(3)


@query
def e2_stuck_instrument(spark, d):
    lo, hi = labels.us("2024-01-01 00:00"), labels.us("2024-01-31 00:00")
    return episodes.state_episodes(view(spark, d), episodes.stuck_instrument(var_eps=800.0, anti_eps=0.8), lo, hi).drop("series_id")


@query
def m16_condition(spark, d):
    _, number = scoring.mahalanobis(scoring.time_split(scoring.prepared(feature_table(spark, d))))
    return rounded(spark.createDataFrame([(number,)], "condition double"), 2)


@query
def m7_isolation_forest(spark, d):
    ship(spark)
    return rounded(models.isolation_forest(score_table(spark, d)).select("seg", "win", "iforest"), 5)


@query
def m9_anchored_residual(spark, d):
    return rounded(models.anchored_residual(score_table(spark, d)).select("seg", "win", "anchored_residual"), 4)


@query
def m10_leave_one_out(spark, d):
    return rounded(models.leave_one_out(score_table(spark, d), {k: models.LEARNERS[k] for k in ("logreg", "tree")}), 4)


@query
def m11_classifiers(spark, d):
    """The other learners; each failure is held out once."""
    ship(spark)
    return rounded(models.leave_one_out(score_table(spark, d), {k: models.LEARNERS[k] for k in ("rf", "gbm", "ada", "svm", "xgb")}), 4)


@query
def m12_importance(spark, d):
    ship(spark)
    return rounded(models.permutation_importance(score_table(spark, d)), 4)


@query
def m12_importance_before(spark, d):
    ship(spark)
    return rounded(models.permutation_importance(score_table(spark, d), infail=False), 4)


@query
def m14_lookback(spark, d):
    """ROC-AUC with cycle columns of one hour and of six."""
    f = feature_table(spark, d)
    six = features.multiscale_cycles(view(spark, d), tiles_table(spark, d)).select("series_id", "seg", "win", F.col("cycle_dur_cv_6h"), F.col("cycle_dur_trend_6h"))
    swapped = f.drop("cycle_dur_cv", "cycle_dur_trend").join(six, ["series_id", "seg", "win"]).withColumnsRenamed({"cycle_dur_cv_6h": "cycle_dur_cv", "cycle_dur_trend_6h": "cycle_dur_trend"})
    long = evaluation.long_table(score_table(spark, d).withColumn("zmax_1h", F.col("zmax")), ["zmax_1h"]).unionByName(evaluation.long_table(scoring.scored(swapped).withColumn("zmax_6h", F.col("zmax")), ["zmax_6h"]))
    return rounded(evaluation.roc_auc(evaluation.by_score(long)))


@query
def ev12_scorers(spark, d):
    """Three scores of all windows, judged alike."""
    names = ["zmax", "mahalanobis", "forecast_residual"]
    return rounded(evaluation.evaluate(scorers.with_scores(score_table(spark, d), names), names))


@query
def ev12_tree_scorers(spark, d):
    """The scores that random and boosted trees give."""
    ship(spark)
    names = ["iforest", "anchored_residual"]
    return rounded(evaluation.evaluate(scorers.with_scores(score_table(spark, d), names), names))


# --- time frames, sketches, SQL text, table functions


@query
def w14_range_frames(spark, d):
    """Number, sum and extremes of the readings in the six hours up to each."""
    v = view(spark, d).select("series_id", "event_id", "us", "a1", "a2")
    made = {"n": ("count", F.lit(1)), "a2_sum": ("sum", "a2"), "a1_low": ("min", "a1"), "a1_high": ("max", "a1")}
    return timeline.range_totals(v, 6 * HOUR_US, made).select("event_id", *made)


@query
def k1_sketched_spans(spark, d):
    """Spans of days from stored daily sketches, beside the exact numbers: quantiles' ranks and distinct users within the
    stated bounds (three standard deviations for the counts)."""
    rows = view(spark, d).join(table(spark, d, "events").select("event_id", "user_id"), "event_id")
    days = stored(sketches.daily(rows, "a1", "user_id"))
    probs, out = (0.1, 0.5, 0.9), None
    for name, lo, hi in (("week", 19723, 19729), ("month", 19723, 19753), ("day", 19730, 19730)):
        guess = sketches.answers(sketches.spans(days, F.lit(lo), F.lit(hi), ["series_id"]), probs)
        real = rows.filter((F.col("us") >= lo * DAY_US) & (F.col("us") < (hi + 1) * DAY_US))
        d2 = real.join(F.broadcast(guess.select("series_id", "q")), "series_id")  # a row for each series
        ranks = d2.groupBy("series_id").agg(F.count_distinct("user_id").alias("users"), *[F.avg((F.col("a1") <= F.get("q", i)).cast("int")).alias(f"rank{i}") for i in range(3)])
        near = F.lit(True)
        for i, p in enumerate(probs):
            near = near & (F.abs(F.col(f"rank{i}") - p) <= sketches.rank_error() + 1 / F.col("n"))
        one = guess.join(ranks, "series_id").select(
            F.lit(name).alias("span"), "series_id", "n", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "users", near.alias("ranks_near"),
            (F.abs(F.col("n_items") - F.col("users")) <= 3 * 1.04 / 64 * F.col("users") + 1).alias("hll_near"), (F.abs(F.col("n_keys") - F.col("users")) <= 3 / 64 * F.col("users") + 1).alias("theta_near"),
        )
        out = one if out is None else out.unionByName(one)
    return out


def alarm_tables(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {"alarms": alarms.alarms(status_table(spark, d)), "scores": score_table(spark, d)}


@query
def t1_alarms_with_subqueries(spark, d):
    return views.sql(spark, views.ABOVE_ALARM, alarm_tables(spark, d), back=6 * HOUR_US)


@query
def t2_alarm_chains(spark, d):
    """Alarms within six hours of the one before, by a recursive query."""
    return views.sql(spark, views.CHAINS, alarm_tables(spark, d), back=6 * HOUR_US)


@query
def t3_windows_of_leaders(spark, d):
    return views.sql(spark, views.LEADERS, alarm_tables(spark, d))


@query
def u1_runs_of_users(spark, d):
    """Runs of the load signal of each user, by a table function."""
    views.register_functions(spark)
    ship(spark)
    sensor_view(table(spark, d, "events"), "user_id").select(F.col("series_id").alias("series"), "us", F.col("dv").alias("state")).createOrReplaceTempView("tidemark_states")
    return spark.sql("SELECT * FROM tidemark_runs(TABLE(tidemark_states) PARTITION BY series ORDER BY us)")


@query
def s1_series_gaps(spark, d):
    """Each user as a series of its own: rows, segments at gaps of a day, and the longest lag."""
    lags = timeline.with_lag(sensor_view(table(spark, d, "events"), series="user_id"))
    rows = timeline.segmented(lags, DAY_US)
    return rows.groupBy("series_id").agg(F.count(F.lit(1)).alias("n"), (F.max("seg") + 1).alias("n_segments"), F.max("dus").alias("longest_us"))


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share."""
    return f"{checkpoint_folder(spark)}/{uuid.uuid4().hex}-{name}"


@query
def s3_typed_csv(spark, d):
    """The readings, written as CSV with an index and digital channels as 0.0 and 1.0, and read with their types."""
    schema = SensorSchema(analog=("a1", "a2"), digital=("dv", "comp"), timestamp="ts", timestamp_format="yyyy-MM-dd HH:mm:ss.SSSSSS")
    path = scratch(spark, "readings.csv")
    written = view(spark, d).select(F.col("event_id").alias("index"), F.date_format("ts", schema.timestamp_format).alias("ts"), "a1", "a2", F.col("dv").cast("double"), F.col("comp").cast("double"))
    written.write.option("header", True).csv(path)
    return files.sensor_rows(files.read_raw(spark, path, schema), schema).select("us", "a1", "a2", F.col("dv").cast("int").alias("dv"), F.col("comp").cast("int").alias("comp"))


@query
def s5_parquet_by_date(spark, d):
    """Readings of one week from a table partitioned by day; other days' files aren't read."""
    path = scratch(spark, "readings.parquet")
    files.write_parquet(view(spark, d).withColumn("date", F.to_date("ts")), path, ["date"])
    week = files.read_parquet(spark, path).filter(F.col("date").between(F.lit("2024-01-08").cast("date"), F.lit("2024-01-14").cast("date")))
    return rounded(week.groupBy(F.col("date").cast("string").alias("date")).agg(F.count(F.lit(1)).alias("n"), F.avg("a1").alias("a1_mean"), F.sum("dv").alias("loaded")))


@query
def s10_report(spark, d):
    """The evaluation, written as a CSV with a header and read without given types."""
    path = scratch(spark, "evaluation")
    files.write_report(evaluation.evaluate(score_table(spark, d), ["zmax"]), path)
    return rounded(files.read_naive(spark, path).select("model", "target", "precision", "recall", "roc_auc", F.col("n_pos").cast("long").alias("n_pos")))


@query
def r8_strings(spark, d):
    c = table(spark, d, "customer")
    return c.groupBy(F.upper(F.substring("c_mktsegment", 1, 4)).alias("segment"), F.col("c_name").endswith("7").alias("ends_with_7")).agg(F.count(F.lit(1)).alias("n"), F.max(F.concat_ws("/", F.lower("c_mktsegment"), F.col("c_name"))).alias("last"))


# --- relational operators


@query
def r1_hash_join_rollup(spark, d):
    o, c, n = table(spark, d, "orders"), table(spark, d, "customer"), table(spark, d, "nation")
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return j.rollup("n_name", "c_mktsegment").agg(F.count(F.lit(1)).alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.count_distinct("o_custkey").alias("n_customers"))


@query
def r2_semi_anti(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    n = lambda how: c.join(o, c.c_custkey == o.o_custkey, how).groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n")).withColumn("kind", F.lit(how))
    return n("left_semi").unionByName(n("left_anti"))


@query
def r3_outer_joins(spark, d):
    s, c = table(spark, d, "supplier"), table(spark, d, "customer")
    a, b = s.groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n_suppliers")), c.filter("c_acctbal > 9000").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n_customers"))
    return a.join(b, a.s_nationkey == b.c_nationkey, "full").select(F.coalesce("s_nationkey", "c_nationkey").alias("nationkey"), "n_suppliers", "n_customers")


@query
def r4_ranks(spark, d):
    """The 20 dearest orders of each priority: ranks and the next key need 21 rows of each, the tile of ten their number."""
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    w = Window.partitionBy("o_orderpriority").orderBy(F.desc("o_totalprice"), "o_orderkey")
    top = o.withColumn("rn", F.row_number().over(w)).filter("rn <= 21")  # each map task keeps as many
    n = o.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    ranked = top.join(n, "o_orderpriority").withColumns({"rk": F.rank().over(w), "dr": F.dense_rank().over(w), "next_key": F.lead("o_orderkey").over(w)})
    small, longer = F.floor(F.col("n") / 10), F.col("n") % 10  # the first tiles have one row more
    ahead = F.col("rn") - 1 - longer * (small + 1)
    tile = F.when(ahead < 0, F.floor((F.col("rn") - 1) / (small + 1))).otherwise(longer + F.floor(ahead / small)) + 1
    return ranked.filter("rn <= 20").select("o_orderkey", "o_orderpriority", "rn", "rk", "dr", tile.cast("int").alias("tile"), "next_key")


@query
def r5_set_operations(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    a, b = c.select(F.col("c_custkey").alias("k")), o.filter("o_totalprice > 300000").select(F.col("o_custkey").alias("k"))
    out = None
    for name, df in (("intersect", a.intersect(b)), ("except", a.exceptAll(b.distinct())), ("union", a.union(b).distinct())):
        one = df.agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("s")).withColumn("op", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query
def r6_cube(spark, d):
    l = table(spark, d, "lineitem")
    return l.cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"), F.round(F.avg("l_discount"), 4).alias("disc"))


@query
def r7_top_parts(spark, d):
    l, p = table(spark, d, "lineitem"), table(spark, d, "part")
    s = l.join(p, l.l_partkey == p.p_partkey).groupBy("p_partkey", "p_brand").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
    return s.orderBy(F.desc("revenue"), "p_partkey").limit(50)
