"""Batch pipeline: preprocess, features, score, evaluate. Each stage reads what the one before it wrote.

python -m tidemark.pipeline --config configs/config.json --stage all
"""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import Config
from tidemark.operators import quality
from tidemark.operators.timeline import with_lag
from tidemark.plans import evaluation, features, scorers, scoring
from tidemark.schema import Roles, SensorSchema
from tidemark.session import session
from tidemark.sources import files

log = logging.getLogger(__name__)


def roles(config: Config) -> Roles:
    return Roles(load="DV_eletric", idle="COMP", motor="Motor_current", pressure="TP3", oil="Oil_temperature", off_max=config.off_max, offloaded_max=config.offloaded_max, sample_seconds=config.expected_interval_seconds)


def preprocess(spark: SparkSession, config: Config, on_fail: str = "raise") -> DataFrame:
    schema, r = SensorSchema(), roles(config)
    rows = files.sensor_rows(files.read_raw(spark, config.paths["raw_csv"], schema), schema)
    unordered = [quality.binary_check(list(schema.digital)), quality.twin_check("TP3", "Reservoirs", config.twin_eps, config.twin_max), quality.antiphase_check(config.antiphase_eps, r), quality.range_check(config.ranges, list(schema.analog))]
    rows, measured = quality.watched(rows.withColumn("date", F.to_date(schema.timestamp)), unordered)
    files.write_parquet(rows, config.paths["processed"], ["date"])
    rows = files.read_parquet(spark, config.paths["processed"]).select(r.series, r.us, r.seq)
    checks = [quality.increasing(rows, r), quality.modal(with_lag(rows, r), config.expected_interval_seconds * 1_000_000), measured()]
    out = quality.run_checks(checks, on_fail)
    files.write_failures(spark, config.failures, config.paths["failure_windows"])
    return out


def build_features(spark: SparkSession, config: Config) -> DataFrame:
    rows = files.read_parquet(spark, config.paths["processed"])
    out = features.build(rows, config.gap_threshold_seconds * 1e6, r=roles(config), strict=True, failures=config.failures, degraded=config.degraded, invalid=config.invalid)
    files.write_parquet(out, config.paths["features"])
    return out


def score(spark: SparkSession, config: Config) -> DataFrame:
    out = scorers.with_scores(scoring.scored(files.read_parquet(spark, config.paths["features"]), config.threshold_q), config.scorers)
    files.write_parquet(out, config.paths["scores"])
    return out


def evaluate(spark: SparkSession, config: Config) -> DataFrame:
    out = evaluation.evaluate(files.read_parquet(spark, config.paths["scores"]), config.scorers, config.threshold_q, config.failures)
    files.write_report(out, config.paths["evaluation"])
    return out


STAGES = {"preprocess": preprocess, "features": build_features, "score": score, "evaluate": evaluate}


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--config", required=True)
    parser.add_argument("--stage", choices=[*STAGES, "all"], default="all")
    parser.add_argument("--threshold-q", type=float)
    parser.add_argument("-v", "--verbose", action="store_true")
    args = parser.parse_args(argv)
    logging.basicConfig(level=logging.DEBUG if args.verbose else logging.INFO)
    config = Config.load(args.config)
    if args.threshold_q is not None:
        config.threshold_q = args.threshold_q
    spark = session()
    for name in STAGES if args.stage == "all" else [args.stage]:
        try:
            STAGES[name](spark, config)
        except Exception:
            log.exception("stage %s failed", name)
            return 1
        log.info("stage %s done", name)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
