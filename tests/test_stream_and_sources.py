"""Streams equal batches; files are read as they were written; the batch pipeline runs from end to end."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from tidemark import pipeline
from tidemark.operators import labels, quality
from tidemark.plans import alarms, features, scoring
from tidemark.schema import SensorSchema
from tidemark.sources import files
from tidemark.streaming import streams

S = 1_000_000
SCHEMA = "series_id string, event_id long, us long, a1 double, a2 double, dv int, comp int"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stream"))
    rng = random.Random(4)
    data = [("S1", i, 1_704_067_200 * S + i * 60 * S, rng.random(), rng.random(), rng.randrange(2), rng.randrange(2)) for i in range(600) if not 200 <= i < 260]
    for k in range(4):
        spark.createDataFrame(data[k * 135 : (k + 1) * 135], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return path


def run(spark, df, tmp_path, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return spark.table(name)


def test_tumbling_windows_equal_the_batch(spark, folder, tmp_path):
    got = run(spark, streams.window_features(streams.timed(streams.replay(spark, folder, SCHEMA, 10), late="1 day")), tmp_path, "tumbling", "complete")
    want = streams.window_features(spark.read.schema(SCHEMA).parquet(folder).withColumn("time", F.timestamp_micros("us")))
    key = lambda df: sorted((r.ws, r.n, round(r.duty, 9), round(r.oil_median, 9)) for r in df.collect())
    assert key(got) == key(want) and len(key(want)) == 10


def test_sessions_split_at_gaps(spark, folder, tmp_path):
    got = run(spark, streams.gap_sessions(streams.timed(streams.replay(spark, folder, SCHEMA, 10)), "10 minutes"), tmp_path, "sessions", "complete")
    assert sorted(r.n for r in got.collect()) == [200, 340]


def test_sliding_windows_equal_the_batch(spark, folder, tmp_path):
    got = run(spark, streams.window_features(streams.timed(streams.replay(spark, folder, SCHEMA, 10), late="1 day"), "1 hour", "5 minutes"), tmp_path, "sliding", "complete")
    want = streams.window_features(spark.read.schema(SCHEMA).parquet(folder).withColumn("time", F.timestamp_micros("us")), "1 hour", "5 minutes")
    key = lambda df: sorted((r.ws, r.n, round(r.duty, 9)) for r in df.collect())
    assert key(got) == key(want) and len({k[0] for k in key(want)}) > 100


def test_coverage_and_stored_scaler_on_a_stream(spark, folder, tmp_path):
    batch = streams.window_features(spark.read.schema(SCHEMA).parquet(folder).withColumn("time", F.timestamp_micros("us")))
    scaler = scoring.scaler(batch.withColumn("is_train", F.lit(True)), ["duty", "oil_std"])
    scaler.write.parquet(str(tmp_path / "scaler"))
    windows = streams.covered(streams.window_features(streams.timed(streams.replay(spark, folder, SCHEMA), late="1 minute")), 60, 0.9)
    live = streams.scored(windows, spark.read.parquet(str(tmp_path / "scaler")), ["duty", "oil_std"], F.lit(1.0))
    got = {r.ws: (r.zmax, r.alert) for r in run(spark, live.select("ws", "zmax", "alert"), tmp_path, "live").collect()}
    mean, sd = (batch.agg(*[f(c) for c in ("duty", "oil_std")]).first() for f in (F.avg, F.stddev_samp))
    full = [r for r in batch.collect() if r.n >= 54]
    want = {r.ws: max(abs(r.duty - mean[0]) / sd[0], abs(r.oil_std - mean[1]) / sd[1]) for r in full}
    # The last window stays open until the watermark passes its end.
    assert len(full) - 1 <= len(got) < batch.count() and all(abs(got[k][0] - want[k]) < 1e-9 and got[k][1] == (want[k] > 1.0) for k in got)


def test_late_and_repeated_rows_are_dropped(spark, tmp_path):
    path, at = str(tmp_path / "late"), 1_704_067_200 * S
    minutes = [[0, 1, 2], [2, 3, 30], [31], [4, 31], [60]]  # 4 comes when the watermark has passed it, and a batch has seen that
    for k, part in enumerate(minutes):
        spark.createDataFrame([("S1", m, at + m * 60 * S, 0.5, 0.5, 0, 1) for m in part], SCHEMA).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)  # files are read in the order of their times
    rows = streams.without_repeats(streams.timed(streams.replay(spark, path, SCHEMA), late="10 minutes"), ["series_id", "event_id"])
    assert sorted(r.event_id for r in run(spark, rows.select("event_id"), tmp_path, "once").collect()) == [0, 1, 2, 3, 30, 31, 60]
    wins = streams.window_features(streams.timed(streams.replay(spark, path, SCHEMA), late="10 minutes"), "10 minutes")
    got = {(r.ws - at) // (600 * S): r.n for r in run(spark, wins, tmp_path, "windows").collect()}
    assert got[0] == 5 and got[3] == 3  # 0, 1, 2, 2, 3; 30, 31, 31


def test_escalations_keep_state_between_batches(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    path, z = str(tmp_path / "z"), [0.0, 5.0, 5.0, 5.0, 5.0, 1.0, 5.0]
    for k in range(len(z)):
        spark.createDataFrame([("S1", k, z[k])], "series_id string, ws long, zmax double").coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        found = run(spark, streams.escalations(streams.replay(spark, path, "series_id string, ws long, zmax double"), 2.0, 4.0), tmp_path, "levels").collect()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    assert sorted((r.ws, r.level) for r in found) == [(1, "alert"), (3, "critical"), (6, "alert")]


@pytest.fixture
def rocks(spark):
    pytest.importorskip("google.protobuf")
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    streams.stateful(spark)
    yield
    spark.conf.set(key, old)


def test_stream_alarms_equal_the_batch(spark, tmp_path, rocks):
    """Untrusted windows, persistence over the edges of batches, two assets."""
    rng, path, schema = random.Random(3), str(tmp_path / "z"), "series_id string, seg long, win int, ws long, zmax double, quality_bad boolean, driver string"
    data = [(s, 0, k, k * 3600 * S, rng.choice((0.0, 2.5, 5.0, 6.0)), rng.random() < 0.2, "duty") for s in ("A", "B") for k in range(80)]
    cuts = [0, 3, 4, 20, 21, 50, 80]
    for a, b in zip(cuts, cuts[1:], strict=False):
        spark.createDataFrame([r for r in data if a <= r[2] < b], schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    got = run(spark, streams.escalations(streams.replay(spark, path, schema), 2.0, 4.0), tmp_path, "all_levels").collect()
    batch = alarms.alarms(alarms.status(spark.createDataFrame(data, schema), F.lit(2.0), F.lit(4.0))).collect()
    assert sorted((r.series_id, r.ws, r.level, r.zmax) for r in got) == sorted((r.series_id, r.ws, r.level, r.zmax) for r in batch) and len({r.level for r in batch}) == 3


def sensor_rows(assets=("A", "B"), n=900):
    """Minutes with jitter, gaps of 3 (no window's break) and 30 minutes, a window without rows, equal times."""
    rng, out = random.Random(9), []
    for a in assets:
        t = 1_704_067_200 * S + rng.randrange(60) * S
        for i in range(n):
            t += rng.choice((50, 60, 60, 70)) * S + (1800 * S if i % 300 == 299 else 1100 * S if i % 170 == 169 else 0) * (1 + (i == 599)) - (60 * S if i % 91 == 90 else 0)
            load = int(i // 9 % 2)
            out.append((a, i, t, 60 + 5 * load + rng.random(), rng.random() * 90 * (0.3 + 0.7 * load), load, 1 - load if i % 40 else load))
    return out


def in_order(rows):
    return sorted(rows, key=lambda r: (r[2], r[0], r[1]))


def drained(spark, path, batches):
    for part in batches:
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)


def test_segment_windows_equal_the_batch_after_a_restart(spark, tmp_path, rocks):
    """Features of windows that are anchored at segments: rows out of order within the delay, rows that come too late,
    a stop and a start from the checkpoint, an asset that sends nothing at the end."""
    gap, width, rng = 20 * 60 * S, 900 * S, random.Random(2)
    rows = in_order(sensor_rows())
    end = max(r[2] for r in rows)
    parts = [rows[k : k + 240] for k in range(0, len(rows), 240)]
    for k in range(len(parts) - 1):  # the last 8 rows of each batch come with the next one, shuffled
        parts[k + 1], parts[k] = parts[k][-8:] + parts[k + 1], parts[k][:-8]
    for part in parts:
        rng.shuffle(part)
    late = [("A", 10_000 + i, rows[0][2] + i * S, 1.0, 1.0, 0, 1) for i in range(7)]
    path, out = str(tmp_path / "rows"), str(tmp_path / "windows")
    finish = lambda d: features.with_regime(d)

    def go():
        stream = streams.timed(streams.replay(spark, path, SCHEMA), late="15 minutes")
        closed = streams.segment_windows(streams.observed(stream, "minutes", loaded=F.sum("dv")), gap, width, silence_us=86_400 * S)
        q = streams.write_windows(closed, out, finish, failures=(), degraded=(), invalid=()).queryName("segments").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        assert q.awaitTermination(300)

    listener = streams.LateRows()
    spark.streams.addListener(listener)
    try:
        drained(spark, path, parts[:4])
        go()
        drained(spark, path, [*parts[4:], late])
        drained(spark, path, [[("Z", 0, end + 3 * 86_400 * S, 0.0, 0.0, 0, 1)], [("Z", 1, end + 3 * 86_400 * S + 1, 0.0, 0.0, 0, 1)]])
        go()
        for _ in range(60):
            if listener.read.get("segments", 0) >= len(rows) + 9:
                break
            time.sleep(0.5)
    finally:
        spark.streams.removeListener(listener)
    assert listener.dropped["segments"] == 7
    assert listener.read["segments"] == len(rows) + 9 == listener.seen["minutes"]["rows"] and listener.seen["minutes"]["loaded"] == sum(r[5] for r in rows)

    given = spark.createDataFrame(rows, SCHEMA)
    tiles, inside = features.window_table(given, gap, width)
    want = finish(features.base_features(tiles, inside, failures=(), degraded=(), invalid=()))
    got = spark.read.parquet(out).drop("batch").select(want.columns)
    plain = lambda d: sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in d.collect()), key=str)
    assert plain(got) == plain(want) and got.count() > 60
    assert want.filter("n_samples = 0").count() > 0 and want.select("seg").distinct().count() > 2


def test_silent_assets_are_forgotten(spark, tmp_path, rocks):
    """After its silence an asset's segments are numbered anew; a timer lets its last windows go without any row of it."""
    path, at = str(tmp_path / "quiet"), 1_704_067_200 * S
    minutes = [("A", m, at + m * 60 * S, 0.5, 0.5, 0, 1) for m in range(31)]
    later = [("A", 100 + m, at + 90_000 * S + m * 60 * S, 0.5, 0.5, 0, 1) for m in range(21)]
    drained(spark, path, [minutes, [("Z", 0, at + 80_000 * S, 0.5, 0.5, 0, 1)], [("Z", 1, at + 80_100 * S, 0.5, 0.5, 0, 1)], later, [("Z", 2, at + 200_000 * S, 0.5, 0.5, 0, 1)], [("Z", 3, at + 200_001 * S, 0.5, 0.5, 0, 1)]])
    seen = {}
    for silence in (7200 * S, 10**6 * S):
        closed = streams.segment_windows(streams.timed(streams.replay(spark, path, SCHEMA), late="1 minute"), 600 * S, 600 * S, silence)
        seen[silence] = run(spark, closed, tmp_path, f"quiet{silence}").filter("series_id = 'A'").groupBy("seg", "win").count().collect()
    assert sorted(tuple(r) for r in seen[7200 * S]) == [(0, 0, 20), (0, 1, 20), (0, 2, 10)]
    assert sorted(tuple(r) for r in seen[10**6 * S]) == [(0, 0, 10), (0, 1, 10), (0, 2, 10), (1, 0, 10), (1, 1, 10)]


def test_failures_are_read_as_dates(spark, tmp_path):
    fails = [labels.Failure("F1", "leak", 1_704_067_200 * S, 1_704_070_800 * S, None), labels.Failure("F2", "leak", 1_704_167_200 * S, 1_704_170_800 * S, 1_704_180_000 * S)]
    files.write_failures(spark, fails, str(tmp_path / "f.csv"))
    assert "2024-01-01 00:00:00" in "".join(p.read_text() for p in (tmp_path / "f.csv").glob("*.csv"))
    assert [tuple(r) for r in files.read_failures(spark, str(tmp_path / "f.csv")).orderBy("start").collect()] == [(f.failure_id, f.fault_type, f.start, f.end, f.maintenance) for f in fails]


@pytest.fixture(scope="module")
def raw_csv(tmp_path_factory):
    schema, rng = SensorSchema(), random.Random(8)
    path = tmp_path_factory.mktemp("raw") / "raw.csv"
    lines = [",".join(["", *schema.columns])]
    for i in range(3000):
        at = f"2024-01-{1 + i // 1440:02d} {i // 60 % 24:02d}:{i % 60:02d}:00"
        load = int(i // 7 % 2)
        tp3 = 8 + rng.random() - 0.1 * (i % 7) * (1 - load)
        analog = [rng.random(), tp3, rng.random(), rng.random(), tp3, 60 + 10 * load + rng.random(), 5.5 * load + rng.random()]
        lines.append(",".join(map(str, [i * 10, at, *analog, 1.0 - load, float(load), 1.0, 0.0, 0.0, 1.0, 1.0, 0.0])))
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_typed_scan_and_sinks(spark, raw_csv, tmp_path):
    d = files.read_raw(spark, raw_csv)
    assert d.columns == SensorSchema().columns and dict(d.dtypes)["COMP"] == "tinyint" and d.count() == 3000
    files.write_parquet(d, str(tmp_path / "x.parquet"))
    assert files.read_parquet(spark, str(tmp_path / "x.parquet")).count() == 3000
    with pytest.raises(ValueError):
        files.write_parquet(d, str(tmp_path / "x.csv"))
    assert files.read_if_there(spark, str(tmp_path / "none.parquet"), "x") is None
    assert files.read_naive(spark, raw_csv).count() == 3000


def test_pipeline_from_end_to_end(spark, raw_csv, tmp_path):
    names = {"processed": "r.parquet", "failure_windows": "f", "features": "feat.parquet", "scores": "s.parquet", "evaluation": "e"}
    raw = {
        "scorers": ["zmax", "mahalanobis", "forecast_residual"], "paths": {"raw_csv": raw_csv, **{k: str(tmp_path / v) for k, v in names.items()}}, "preprocessing": {"expected_interval_seconds": 60, "gap_threshold_seconds": 300},
        "failure_windows": [{"failure_id": "F1", "fault_type": "leak", "start": "2024-01-04 12:00", "end": "2024-01-04 14:00"}],
    }
    config = tmp_path / "configs" / "config.json"
    config.parent.mkdir()
    config.write_text(json.dumps(raw))
    assert pipeline.main(["--config", str(config)]) == 0
    scores = spark.read.parquet(str(tmp_path / "s.parquet"))
    assert scores.count() == 49 and scores.filter("zmax IS NULL OR mahalanobis IS NULL OR forecast_residual IS NULL").count() == 0
    assert {r.model for r in spark.read.csv(str(tmp_path / "e"), header=True).collect()} == set(raw["scorers"])
    raw["checks"] = {"analog_ranges": [{"sensor": "TP2", "min": 0, "max": 0.5}]}
    config.write_text(json.dumps(raw))
    assert pipeline.main(["--config", str(config), "--stage", "preprocess"]) == 1
    assert issubclass(quality.QualityError, RuntimeError)


def test_segments_of_a_batch_are_gone_through_once():
    """As many segments as times, of one batch: each is looked at by itself, not all rows for each."""
    import numpy as np
    import pyarrow as pa

    class Kept:
        def __init__(self):
            self.value = None

        def exists(self):
            return self.value is not None

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

    width, n = 3_600_000_000, 60_000
    t = np.arange(n, dtype=np.int64) * 26_000_000
    long = np.r_[t[-1] + 26_000_000 + np.arange(0, 3 * width + 1, 10_000_000, dtype=np.int64)]
    for times, gap, want in ((t, 0, []), (np.r_[t, long], 20_000_000, [(n, 0), (n, 1), (n, 2)])):
        p = streams.SegmentWindows(pa.schema([("us", pa.int64())]), "us", "us", gap, width, 10**15)
        p.context = Kept()
        began = time.thread_time()
        given, rest = p._close(pa.table({"us": times}), times)
        assert time.thread_time() - began < 1  # 4 s and more where all rows are looked at for each segment
        assert [(s, w) for s, w, _, _ in given] == want and sum(len(x[3]) for x in given) == 360 * len(want) and len(rest) == 1
        assert p.context.value[:2] == (n if want else n - 2, int(rest.column("us")[0].as_py()) - (3 * width if want else 0))
