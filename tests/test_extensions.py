"""Time-range frames, sketches, SQL text, registered extensions, table functions."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark import registry
from tidemark.functions import sketches
from tidemark.operators import timeline
from tidemark.plans import features, views
from tidemark.schema import DAY_US, HOUR_US

S = 1_000_000
SCHEMA = "series_id string, event_id long, us long, a1 double, a2 double, dv int, comp int"


def readings(n=200, assets=("A", "B"), seed=1, step=90):
    rng = random.Random(seed)
    return [(a, i, (i * step + rng.randrange(step)) * S, rng.choice((None, rng.random())) if i % 9 == 0 else rng.random(), float(rng.randrange(100)), rng.randrange(2), 1) for a in assets for i in range(n)]


@pytest.mark.parametrize("bucket", [None, 1, 3000 * S])
def test_range_frames_equal_brute_force(spark, bucket):
    rows = readings() + [("A", 500, 100 * 90 * S, 0.5, 7.0, 0, 1), ("A", 501, 100 * 90 * S, 0.25, 8.0, 0, 1)]  # equal times
    span = 1000 * S
    d = timeline.range_frame(spark.createDataFrame(rows, SCHEMA).repartition(3), span, {"n": F.count("a1"), "total": F.sum("a2"), "low": F.min("a1")}, bucket_us=bucket)
    got = {(r.series_id, r.event_id): (r.n, r.total, r.low) for r in d.collect()}
    assert len(got) == len(rows) and d.columns[-3:] == ["n", "total", "low"]
    for a, i, t, *_ in rows:
        near = [r for r in rows if r[0] == a and t - span < r[2] <= t]
        known = [r[3] for r in near if r[3] is not None]
        assert got[a, i] == (len(known), sum(r[4] for r in near), min(known, default=None))


def test_sketches_of_spans_are_within_their_bounds(spark):
    rng = random.Random(3)
    rows = [(a, i, int(rng.random() * 6 * DAY_US), rng.gauss(0, 1), float(rng.randrange(3000)), 0, 1) for a in ("A", "B") for i in range(20_000)] + [("C", 1, 5, None, None, 0, 1)]
    days = sketches.daily(spark.createDataFrame(rows, SCHEMA).withColumn("item", F.col("a2").cast("string")), "a1", "item")
    assert days.count() == 13
    probs = (0.01, 0.25, 0.5, 0.99)
    for lo, hi in ((0, 5), (2, 3), (4, 4)):
        found = {r.series_id: r for r in sketches.answers(sketches.spans(days, F.lit(lo), F.lit(hi), ["series_id"]), probs).collect()}
        for a in ("A", "B"):
            own = [r for r in rows if r[0] == a and lo <= r[2] // DAY_US <= hi]
            values, items = [r[3] for r in own], len({r[4] for r in own})
            assert found[a].n == len(own) and (found[a].low, found[a].high) == (min(values), max(values))
            for p, q in zip(probs, found[a].q, strict=True):
                assert abs(sum(v <= q for v in values) / len(values) - p) <= sketches.rank_error()
            assert abs(found[a].n_items - items) < 0.06 * items and abs(found[a].n_keys - items) < 0.06 * items
    nothing = sketches.answers(sketches.spans(days, F.lit(0), F.lit(0), ["series_id"]), probs).filter("series_id = 'C'").first()
    assert (nothing.n, nothing.q, nothing.n_items) == (0, None, 0)
    assert sketches.answers(sketches.spans(days, F.lit(50), F.lit(60), ["series_id"]), probs).count() == 0


def test_registered_family_appears_in_build(spark):
    @registry.register("family", "swing")
    def swing(roles):
        return [(F.max(roles.oil) - F.min(roles.oil)).alias("oil_swing")]

    try:
        rows = readings(400, step=60)
        built = features.build(spark.createDataFrame(rows, SCHEMA), HOUR_US, failures=(), degraded=(), invalid=())
        assert "oil_swing" in built.columns and built.filter("oil_swing > 0.5").count() > 5
        with pytest.raises(ValueError, match="already"):
            registry.register("family", "swing")(swing)
    finally:
        registry.unregister("family", "swing")
    assert "oil_swing" not in features.build(spark.createDataFrame(rows, SCHEMA), HOUR_US, failures=(), degraded=(), invalid=()).columns


def test_extensions_are_checked_when_registered(spark):
    for kind, bad in (("family", lambda: []), ("family", lambda a, b: []), ("scorer", lambda split: split), ("predicate", lambda *, roles: None)):
        with pytest.raises(TypeError):
            registry.register(kind, "bad")(bad)
    with pytest.raises(ValueError, match="no such kind"):
        registry.register("colour", "x")
    with pytest.raises(KeyError, match="no scorer named x"):
        registry.get("scorer", "x")
    registry.register("scorer", "mean")(lambda split, columns, extra=1: split.withColumn("mean", sum(F.col(c) for c in columns) / len(columns)))
    try:
        d = spark.createDataFrame([(1.0, 3.0)], "a double, b double")
        assert registry.get("scorer", "mean")(d, ["a", "b"]).first()["mean"] == 2.0 and list(registry.registered("scorer")) == ["mean"]
    finally:
        registry.unregister("scorer", "mean")


def test_chains_by_recursion(spark):
    times = [0, 5, 9, 30, 31, 100]
    alarms = spark.createDataFrame([(t,) for t in times], "ws long")
    got = sorted(tuple(r) for r in views.sql(spark, views.CHAINS, {"alarms": alarms}, back=5).collect())
    assert got == [(0, 9, 3), (30, 31, 2), (100, 100, 1)]
    long = spark.createDataFrame([(t,) for t in range(130)], "ws long")  # over Spark's own limit of 100 steps
    before = spark.conf.get("spark.sql.cteRecursionLevelLimit", "100")
    assert [tuple(r) for r in views.sql(spark, views.CHAINS, {"alarms": long}, back=1).collect()] == [(0, 129, 130)]
    assert spark.conf.get("spark.sql.cteRecursionLevelLimit", "100") == before


def test_table_function_of_runs(spark):
    views.register_functions(spark)
    rows = [(a, t, s) for a, states in (("A", "0011101"), ("B", "1")) for t, s in enumerate(map(int, states))]
    spark.createDataFrame(rows, "series string, us long, state int").repartition(3).createOrReplaceTempView("states")
    got = spark.sql("SELECT * FROM tidemark_runs(TABLE(states) PARTITION BY series ORDER BY us)").collect()
    assert sorted(map(tuple, got)) == [("A", 0, 0, 1, 2), ("A", 0, 5, 5, 1), ("A", 1, 2, 4, 3), ("A", 1, 6, 6, 1), ("B", 1, 0, 0, 1)]
