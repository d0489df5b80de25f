"""Operators on small tables with known answers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark import registry
from tidemark.operators import episodes, joins, labels, quality, timeline
from tidemark.functions import quantiles, stats
from tidemark.plans import alarms, evaluation, features, models, scorers, scoring
from tidemark.schema import HOUR_US, VIEW

S = 1_000_000
SCHEMA = "series_id string, event_id long, us long, a1 double, a2 double, dv int, comp int"


def rows(spark, times, dv=None, a1=None, a2=None):
    n = len(times)
    dv = dv or [0] * n
    return spark.createDataFrame([("S1", i, int(t), float((a1 or [1.0] * n)[i]), float((a2 or [5.0] * n)[i]), dv[i], 1 - dv[i]) for i, t in enumerate(times)], SCHEMA)


def test_gap_of_exactly_the_threshold_does_not_split(spark):
    d = timeline.with_lag(rows(spark, [0, 60 * S, 120 * S + 1]))
    assert timeline.gaps(d, 60 * S).count() == 1
    assert [r.seg for r in timeline.segmented(d, 60 * S).orderBy("us").collect()] == [0, 0, 1]


def test_lag_and_counts_cross_buckets(spark):
    times = [i * 7 * S for i in range(50)]
    d = timeline.lagged(rows(spark, times), {"us": "p"}, VIEW, bucket_us=20 * S)
    assert [r.p for r in d.orderBy("us").collect()] == [None, *times[:-1]]
    c = timeline.running_count(rows(spark, times), F.col("event_id") % 3 == 0, "k", VIEW, bucket_us=20 * S)
    assert [r.k for r in c.orderBy("us").collect()] == [i // 3 + 1 for i in range(50)]


def test_grid_drops_the_rest_and_short_segments(spark):
    d = timeline.segmented(timeline.with_lag(rows(spark, [0, 30 * S, 65 * S, 500 * S, 510 * S])), 100 * S)
    g = timeline.grid(timeline.segments(d), 20 * S).orderBy("seg", "win").collect()
    assert [(r.seg, r.win, r.ws) for r in g] == [(0, 0, 0), (0, 1, 20 * S), (0, 2, 40 * S)]
    assert timeline.windowed(d, timeline.segments(d), 20 * S).count() == 2


def test_asof_takes_the_last_row_at_or_before(spark):
    right = spark.createDataFrame([("S1", 10, 1, "a"), ("S1", 20, 2, None), ("S1", 20, 3, "c"), ("S1", 90, 4, "d")], "k string, t long, seq long, v string")
    left = spark.createDataFrame([("S1", 5), ("S1", 10), ("S1", 20), ("S1", 89), ("S2", 50)], "k string, at long")
    got = {(r.k, r.at): r.v for r in joins.asof(left, right, "at", "t", ["k"], ["v"], "seq", bucket_us=15).collect()}
    assert got == {("S1", 5): None, ("S1", 10): "a", ("S1", 20): "c", ("S1", 89): "c", ("S2", 50): None}


def test_label_priority(spark):
    at = {"2024-01-05 12:00": "healthy", "2024-01-06 00:00": "prefail", "2024-01-08 00:00": "degraded", "2024-01-09 12:00": "invalid", "2024-01-15 06:00": "infail", "2024-01-27 10:00": "postrepair", "2024-01-12 00:00": "degraded"}
    d = spark.createDataFrame([(k, labels.us(k)) for k in at], "t string, us long").withColumn("l", labels.label(F.col("us")))
    got = {r.t: r.l for r in d.collect()}
    assert got == at | {"2024-01-12 00:00": "degraded"}


def test_nearest_event_and_ties(spark):
    f = labels.failure_table(spark, [labels.Failure("A", "x", 0, 20 * S, None), labels.Failure("B", "x", 40 * S, 50 * S, 60 * S)])
    d = spark.createDataFrame([(10 * S,), (58 * S,)], "t long")
    assert [r.nearest_event for r in joins.nearest_event(d, f, "t").orderBy("t").collect()] == ["A-failure_start", "B-maintenance"]


def test_run_episodes_and_state_episodes_agree(spark):
    hours = [1] * 12 + [0] * 12 + [1] * 12
    d = rows(spark, [i * HOUR_US for i in range(36)], dv=hours)
    e = episodes.run_episodes(d, "dv", 0).collect()
    assert [(r.episode_start, r.episode_end) for r in e] == [(12 * HOUR_US, 23 * HOUR_US)]
    s = episodes.state_episodes(d, episodes.mostly_off("dv"), 0, 36 * HOUR_US, 6 * HOUR_US, HOUR_US).collect()
    assert [(r.episode_start, r.episode_end) for r in s] == [(12 * HOUR_US, 24 * HOUR_US)]


def test_checks_can_stop_the_job(spark):
    d = rows(spark, [0, 10 * S, 10 * S])
    out = quality.run_checks([quality.increasing(d), quality.ranges(d, {"a1": (0, 5), "ghost": (0, 1)}, ["a1"])], on_fail="ignore").collect()
    assert [r.passed for r in out] == [False, False]
    with pytest.raises(quality.QualityError):
        quality.run_checks([quality.increasing(d)])
    with pytest.warns(UserWarning):
        quality.run_checks([quality.increasing(d)], on_fail="warn")


def test_checks_on_the_way_to_a_sink_equal_those_of_a_scan(spark, tmp_path):
    d = rows(spark, range(0, 50 * S, S), dv=[0, 1] * 25, a1=[float(i % 7) for i in range(50)], a2=[float(i % 5) for i in range(50)])
    d.write.parquet(str(tmp_path / "given"))
    d = spark.read.parquet(str(tmp_path / "given"))
    checks = [quality.binary_check(["dv", "comp"]), quality.twin_check("a1", "a2", 0.1, 9), quality.antiphase_check(0.02), quality.range_check({"a1": (0, 5), "a2": (0, 9)}, ["a1", "a2"])]
    once = quality.in_one_pass(d, checks)
    assert once._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    each = [quality.binary(d, ["dv", "comp"]), quality.twins(d, "a1", "a2", 0.1, 9), quality.antiphase(d, 0.02), quality.ranges(d, {"a1": (0, 5), "a2": (0, 9)}, ["a1", "a2"])]
    want = sorted(tuple(r) for x in each for r in x.collect())
    assert sorted(map(tuple, once.collect())) == want and {w[1] for w in want} == {True, False}
    out, measured = quality.watched(d, checks)
    out.write.parquet(str(tmp_path / "sink"))
    assert sorted(map(tuple, measured().collect())) == want and spark.read.parquet(str(tmp_path / "sink")).count() == 50


def test_quadratic_fit_equals_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.random(60)
    y = 3 + 2 * x - 5 * x**2 + rng.normal(0, 0.1, 60)
    fit = features.quadratic_fit(spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)], "x double, y double"), "x", "y", F.lit(True)).first()
    assert np.allclose([fit.b2, fit.b1, fit.b0], np.polyfit(x - fit.mx, y, 2))


def test_roc_and_average_precision_with_ties(spark):
    rng = np.random.default_rng(5)
    score, y = rng.integers(0, 6, 80) / 2, rng.integers(0, 2, 80)
    long = spark.createDataFrame([("m", "t", float(s), int(v)) for s, v in zip(score, y, strict=True)], "model string, target string, score double, y int")
    p, n = score[y == 1], score[y == 0]
    auc = np.mean([(a > b) + (a == b) / 2 for a in p for b in n])
    ap, last = 0.0, 0.0
    for t in sorted(set(score), reverse=True):
        tp, fp = (p >= t).sum(), (n >= t).sum()
        ap += (tp / len(p) - last) * tp / (tp + fp)
        last = tp / len(p)
    counts = evaluation.by_score(long)
    assert abs(evaluation.roc_auc(counts).first().roc_auc - auc) < 1e-9
    assert abs(evaluation.average_precision(counts).first().pr_auc - ap) < 1e-9


def test_scaler_sees_only_training_windows(spark):
    base = [(float(i), i, 0, "healthy") for i in range(10)]
    make = lambda data: scoring.time_split(spark.createDataFrame(data, "x double, ws long, seg int, label string").withColumn("win", F.col("ws")))
    a = scoring.scaler(make(base), ["x"]).first()
    changed = [(v + 1000 * (i >= 6), i, s, lab) for v, i, s, lab in base]
    assert tuple(a) == tuple(scoring.scaler(make(changed), ["x"]).first())
    assert make(base).filter("is_train").count() == 6


def test_alarms_fire_when_severity_rises(spark):
    z = [0.0, 5.0, 5.0, 5.0, 5.0, 1.0, 5.0]
    d = spark.createDataFrame([("S1", i, 0, i, v, "duty", False) for i, v in enumerate(z)], "series_id string, ws long, seg int, win int, zmax double, driver string, quality_bad boolean")
    s = alarms.status(d, F.lit(2.0), F.lit(4.0))
    assert [r.status for r in s.orderBy("ws").collect()] == ["healthy", "alert", "alert", "critical", "critical", "healthy", "alert"]
    assert [(r.idx, r.level) for r in alarms.alarms(s).orderBy("idx").collect()] == [(1, "alert"), (3, "critical"), (6, "alert")]
    assert [(r.idx, r.level) for r in alarms.alarms(s, 3).orderBy("idx").collect()] == [(1, "alert"), (3, "critical")]  # a replay
    assert s.select(alarms.suspected_fault(F.lit("nothing"))).first()[0] == "abnormal behavior"


def test_mahalanobis_and_forecast_have_the_expected_order(spark):
    rng = np.random.default_rng(1)
    data = [("S1", i, 0, i, "healthy", *map(float, rng.normal(size=3))) for i in range(60)] + [("S1", 60, 0, 60, "prefail", 9.0, 9.0, -9.0)]
    d = spark.createDataFrame(data, "series_id string, ws long, seg int, win int, label string, x double, y double, z double")
    out, condition = scoring.mahalanobis(scoring.time_split(d), ("x", "y", "z"))
    assert condition < 1e3 and out.orderBy(F.desc("mahalanobis")).first().ws == 60
    bare = d.withColumns({"none": F.lit(None).cast("double"), "same": F.lit(1.0)})
    with_null, _ = scoring.mahalanobis(scoring.time_split(bare), ("x", "y", "z", "none"))
    assert with_null.filter("mahalanobis IS NULL").count() == 0 and with_null.orderBy(F.desc("mahalanobis")).first().ws == 60
    flat, _ = scoring.mahalanobis(scoring.time_split(bare), ("same",))
    assert {r.mahalanobis for r in flat.collect()} == {0.0}
    nothing, number = scoring.mahalanobis(scoring.time_split(d.filter("label = 'prefail'")), ("x", "y"))
    assert [r.mahalanobis for r in nothing.collect()] == [None] and np.isnan(number)
    f = scoring.forecast_residual(d, "x", lags=3)
    assert f.filter("ws < 3").agg(F.max("forecast_residual")).first()[0] == 0 and f.orderBy(F.desc("forecast_residual")).first().ws == 60


def test_quantiles_and_ranks_equal_numpy(spark):
    rng = np.random.default_rng(2)
    data = [(g, None if v == 3 else float(v)) for g in ("a", "b", None) for v in rng.integers(0, 40, 200)]
    d = spark.createDataFrame(data, "g string, v double").repartition(5)
    probs = (0.0, 0.1, 0.25, 0.5, 0.97, 1.0)
    for r in quantiles.quantiles(d, ["g"], "v", probs).collect():
        assert np.allclose(r.q, np.quantile([v for g, v in data if g == r.g and v is not None], probs))
    whole = [v for _, v in data if v is not None]
    assert np.allclose(quantiles.quantiles(d, [], "v", probs).first().q, np.quantile(whole, probs))
    assert quantiles.quantiles(d.limit(0), ["g"], "v", probs).count() == 0 and timeline.median_lag(timeline.with_lag(rows(spark, [5]))) is None
    ranks = {r.v: r.v_rank for r in stats.average_ranks(d.select("v"), ["v"]).distinct().collect()}
    ordered = sorted(whole)
    assert ranks == {v: (ordered.index(v) + 1 + len(ordered) - ordered[::-1].index(v)) / 2 for v in set(whole)} | {None: None}
    n = quantiles.numbered(spark.range(100).withColumn("k", -F.col("id")).repartition(7), ["k"], "n").collect()
    assert sorted((r.n, r.id) for r in n) == [(i, 99 - i) for i in range(100)]


def test_previous_rows_cross_buckets(spark):
    d = timeline.lagged_many(rows(spark, [i * 7 * S for i in range(50)]), ["event_id"], 3, "past", VIEW, bucket_us=20 * S)
    for r in d.collect():
        assert [x.event_id for x in r.past] == [k for k in range(r.event_id - 1, r.event_id - 4, -1) if k >= 0]


def test_time_filter_reaches_the_scan(spark, tmp_path, capsys):
    spark.sql("SELECT timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, id) AS ts, unix_micros(timestamp'2024-01-01 00:00:00' + make_dt_interval(0, id)) AS us FROM range(100)").write.parquet(str(tmp_path / "t"))
    d = spark.read.parquet(str(tmp_path / "t"))
    lo = d.agg(F.min("us")).first()[0] + 10 * HOUR_US
    out = stats.between(d, lo, lo + HOUR_US // 2).filter((F.col("us") >= lo) & (F.col("us") < lo + HOUR_US // 2))
    assert out.count() == 1
    out.explain("formatted")
    assert "GreaterThanOrEqual(ts" in capsys.readouterr().out


def windows(spark, n=80, seed=4):
    """Scored windows of one series: healthy, but for some before and in two failures."""
    rng = np.random.default_rng(seed)
    fails = [labels.Failure("A", "x", 30 * HOUR_US, 36 * HOUR_US, None), labels.Failure("B", "x", 60 * HOUR_US, 66 * HOUR_US, None)]
    data = []
    for i in range(n):
        bad = any(f.start - 4 * HOUR_US <= i * HOUR_US <= f.end for f in fails)
        x, y = rng.normal(size=2)
        data.append(("S1", 0, i, i * HOUR_US, (i + 1) * HOUR_US, 60, "prefail" if bad else "healthy", float(x + 4 * bad), float(y), float(2 * x), "idle", bool(bad)))
    d = spark.createDataFrame(data, "series_id string, seg int, win int, ws long, we long, n_samples int, label string, x double, y double, z double, cycling_regime string, frozen boolean")
    return d, fails


def test_matrix_is_numeric_and_guards_raise(spark):
    d, _ = windows(spark, 5)
    m = models.matrix(d)
    assert m.columns[-3:] == ["regime_cycling", "regime_idle", "regime_locked"] and dict(m.dtypes)["frozen"] == "int"
    assert m.first().regime_idle == 1 and models.numeric_columns(m, ("regime", "frozen")) == ["x", "y", "z"]
    with pytest.raises(ValueError, match="not numeric"):
        models.matrix(d.withColumn("odd", F.lit("a")))
    with pytest.raises(ValueError, match="without any value"):
        features.guard(d.withColumn("none", F.lit(None).cast("double")), ["x", "none"])
    with pytest.raises(ValueError, match="twice"):
        features.guard(d.select("x", "x"), [])


def test_forest_and_residual_find_the_outliers(spark):
    d, _ = windows(spark)
    split = scoring.time_split(d)
    out = models.isolation_forest(split, ("x", "y")).collect()
    bad, good = ([r.iforest for r in out if (r.label == "prefail") == b] for b in (True, False))
    assert all(0 < r.iforest < 1 for r in out) and np.mean([b > g for b in bad for g in good]) > 0.9
    again = models.isolation_forest(split.repartition(7), ("x", "y")).collect()  # however the rows are dealt
    assert {(r.win, r.iforest) for r in again} == {(r.win, r.iforest) for r in out}
    grown = models._trees(split, ("x", "y"), 5, 32, 1).toPandas()
    assert sorted(grown["tree"].unique()) == list(range(5)) and set(grown["size"]) == {32}
    assert models.isolation_forest(split.limit(0), ("x", "y")).count() == 0
    r = models.anchored_residual(d, ("x",), ("x", "z")).collect()  # z tells x, but not in the failures
    bad, good = ([v.anchored_residual for v in r if (v.label == "prefail") == b] for b in (True, False))
    assert np.std(good) > 0 and np.mean([b > g for b in bad for g in good]) > 0.9


def test_scorers_are_judged_side_by_side(spark):
    d, fails = windows(spark)
    split = scoring.time_split(d)

    @registry.register("scorer", "sum_of_two")
    def two(table, columns):
        return table.withColumn("sum_of_two", F.col("x") + F.col("y"))

    registry.register("scorer", "odd")(lambda table, columns: table.withColumn("other", F.lit(1.0)))
    try:
        names = ["zmax", "mahalanobis", "iforest", "sum_of_two"]
        out = scorers.with_scores(split, names, ("x", "y"))
        assert out.columns == [*split.columns, *names] and out.count() == split.count()
        alone = {r.win: r.mahalanobis for r in scoring.mahalanobis(split, ("x", "y"))[0].collect()}
        assert {r.win: r.mahalanobis for r in out.collect()} == alone
        table = {(r.model, r.target): r for r in evaluation.evaluate(out, names, failures=fails, hours=4).collect()}
        assert set(table) == {(m, t) for m in names for t in ("A", "B")} and all(r.roc_auc > 0.7 for r in table.values())
        assert scorers.with_scores(out, names, ("x", "y")) is out  # what is there stays
        with pytest.raises(ValueError, match="odd must add"):
            scorers.with_scores(split, ["odd"], ("x",))
        with pytest.raises(KeyError, match="no scorer named what"):
            scorers.with_scores(split, ["what"])
    finally:
        registry.unregister("scorer", "sum_of_two")
        registry.unregister("scorer", "odd")


def test_held_out_failures_are_told_by_the_others(spark):
    d, fails = windows(spark)
    out = models.leave_one_out(d, columns=("x", "y"), failures=fails, hours=4).collect()
    assert {(r.model, r.target) for r in out} == {(m, t) for m in models.LEARNERS for t in ("A", "B")}
    assert all(r.roc_auc > 0.8 and r.n_pos == 11 for r in out)
    assert models.leave_one_out(d, columns=("x", "y"), failures=fails[:1], hours=4).count() == 0
    imp = {r["column"]: r.importance for r in models.permutation_importance(d, ("x", "y"), fails, 4).collect()}
    assert imp["x"] > 0.2 > imp["y"]


def test_two_assets_are_kept_apart(spark):
    a = rows(spark, [i * HOUR_US for i in range(48)], dv=[0 if 6 <= i < 18 else 1 for i in range(48)])
    b = rows(spark, [i * HOUR_US for i in range(48)], dv=[0 if 30 <= i < 36 else 1 for i in range(48)]).withColumn("series_id", F.lit("S2"))
    both = a.unionByName(b)
    e = episodes.state_episodes(both, episodes.mostly_off("dv"), 0, 48 * HOUR_US, 6 * HOUR_US, HOUR_US).collect()
    assert sorted(map(tuple, e)) == [("S1", 6 * HOUR_US, 18 * HOUR_US), ("S2", 30 * HOUR_US, 36 * HOUR_US)]
    got = {r.series_id: r.toggles_per_hour for r in stats.toggles_per_hour(both, "dv", 0, 48 * HOUR_US).collect()}
    assert got == {"S1": 3 / 47, "S2": 3 / 47}


def test_spectrum_equals_least_squares(spark):
    rng = np.random.default_rng(9)
    t = np.sort(rng.integers(0, 3600, 120))
    y = (np.sin(2 * np.pi * t / 300) > 0).astype(int)
    data = [("S1", 0, 0, int(a) * S, int(b)) for a, b in zip(t, y, strict=True)] + [("S1", 0, 1, i * S, 1) for i in range(50)]
    got = {r.win: r for r in features.spectral(spark.createDataFrame(data, "series_id string, seg int, win int, us long, dv int")).collect()}
    assert got[1].dominant_freq is None
    freq, power = np.linspace(1 / 3600, 1 / 60, 200), []
    for f in freq:
        base = np.stack([np.ones(len(t)), np.cos(2 * np.pi * f * t), np.sin(2 * np.pi * f * t)], axis=1)
        rest = y - base @ np.linalg.lstsq(base, y, rcond=None)[0]
        power.append(1 - (rest @ rest) / ((y - y.mean()) @ (y - y.mean())))
    p = np.array(power) / sum(power)
    assert abs(got[0].dominant_freq - freq[int(np.argmax(power))]) < 1e-12 and abs(got[0].spectral_entropy + (p * np.log(p + 1e-12)).sum()) < 1e-6


def test_stuck_instrument_and_first_crossing(spark):
    hours = 24
    d = rows(spark, [i * HOUR_US // 4 for i in range(4 * hours)], dv=[0] * (4 * hours), a2=[5.0 if 24 <= i < 60 else float(i) for i in range(4 * hours)])
    stuck = d.withColumn("comp", F.when(F.col("event_id").between(24, 59), 0).otherwise(1))
    e = episodes.state_episodes(stuck, episodes.stuck_instrument(), 0, hours * HOUR_US, 6 * HOUR_US, HOUR_US).collect()
    assert [(r.episode_start, r.episode_end) for r in e] == [(6 * HOUR_US, 15 * HOUR_US)]
    z, fails = spark.createDataFrame([("S1", i * HOUR_US, float(i % 7), i == 20) for i in range(40)], "series_id string, ws long, zmax double, alert boolean"), [labels.Failure("A", "x", 30 * HOUR_US, 31 * HOUR_US, None)]
    r = alarms.first_crossing(z, fails).first()
    assert (r.n, r.first_alert, r.lead_h) == (38, 20 * HOUR_US, 10.0)
