"""Totals of time-range frames against brute force and the frames of range_frame."""

import random

from pyspark.sql import functions as F

from tidemark.operators import timeline
from tidemark.schema import HOUR_US


def test_totals_equal_brute_force(spark):
    rng = random.Random(3)
    rows = [(rng.choice("ab"), i, rng.randrange(-60, 400), rng.choice((None, rng.randrange(-9, 9) / 2))) for i in range(400)]
    rows += [("a", 400, None, 2.0), ("a", 401, None, 3.0), ("c", 402, 7, None)]
    d = spark.createDataFrame(rows, "series_id string, event_id long, us long, x double").repartition(3)
    got = timeline.range_totals(d, 50, {"n": ("count", F.lit(1)), "xs": ("count", "x"), "sum": ("sum", "x"), "low": ("min", "x"), "high": ("max", "x")})
    assert got.columns == ["series_id", "event_id", "us", "x", "n", "xs", "sum", "low", "high"]
    got = {r.event_id: tuple(r)[4:] for r in got.collect()}
    assert len(got) == len(rows)
    for s, i, t, _ in rows:
        frame = [x for k, _, u, x in rows if k == s and (u is None if t is None else u is not None and t - 50 < u <= t)]
        known = [x for x in frame if x is not None]
        assert got[i] == (len(frame), len(known), *((sum(known), min(known), max(known)) if known else (None, None, None)))


def test_totals_equal_frames_and_go_through_none(spark):
    d = spark.range(3000).selectExpr("'S1' AS series_id", "id AS event_id", f"(id div 2) * 17 * {HOUR_US // 1000} AS us", "CAST(id * 7919 % 101 AS DOUBLE) AS x")
    made = {"n": ("count", F.lit(1)), "x_sum": ("sum", "x"), "x_high": ("max", "x")}
    got = timeline.range_totals(d, HOUR_US, made)
    want = timeline.range_frame(d, HOUR_US, {"n": F.count(F.lit(1)), "x_sum": F.sum("x"), "x_high": F.max("x")})
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert "RangeFrame" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_the_query_goes_through_no_frame(spark):
    from tidemark.queries import QUERIES
    from tests.conftest import DATA

    plan = QUERIES["w14_range_frames"](spark, f"{DATA}/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "RangeFrame" not in plan
