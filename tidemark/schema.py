"""Sensor schemas, the roles that features need, and the sensor view over an event table."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HOUR_US = 3_600_000_000
DAY_US = 24 * HOUR_US


@dataclass(frozen=True)
class SensorSchema:
    """Names of a sensor table's columns; the canonical order is time, analog, digital."""

    analog: tuple[str, ...] = ("TP2", "TP3", "H1", "DV_pressure", "Reservoirs", "Oil_temperature", "Motor_current")
    digital: tuple[str, ...] = ("COMP", "DV_eletric", "Towers", "MPG", "LPS", "Pressure_switch", "Oil_level", "Caudal_impulses")
    timestamp: str = "timestamp"
    timestamp_format: str = "yyyy-MM-dd HH:mm:ss"
    units: dict[str, str] = field(default_factory=lambda: {"TP2": "bar", "TP3": "bar", "H1": "bar", "DV_pressure": "bar", "Reservoirs": "bar", "Oil_temperature": "°C", "Motor_current": "A"})

    @property
    def columns(self) -> list[str]:
        return [self.timestamp, *self.analog, *self.digital]

    def raw_type(self) -> T.StructType:
        """Types of the CSV: digital channels are written as 0.0 and 1.0."""
        return T.StructType([T.StructField("index", T.LongType()), T.StructField(self.timestamp, T.TimestampNTZType()), *[T.StructField(c, T.DoubleType()) for c in self.analog + self.digital]])

    def label(self, column: str) -> str:
        """Axis label with the unit."""
        return f"{column} [{self.units[column]}]" if column in self.units else column


@dataclass(frozen=True)
class Roles:
    """Which columns play the parts that features are defined on, and their cut points."""

    series: str = "series_id"
    us: str = "us"
    seq: str = "event_id"
    load: str = "dv"
    idle: str = "comp"
    motor: str = "a2"
    pressure: str = "a2"
    oil: str = "a1"
    off_max: float = 20.0
    offloaded_max: float = 60.0
    sample_seconds: float = 10.0


VIEW = Roles()


def micros(ts) -> object:
    """Microseconds of a timestamp without zone, read as UTC."""
    return F.unix_micros(ts.cast("timestamp"))


def sensor_view(events: DataFrame, series: str | None = None) -> DataFrame:
    """Sensor readings as a view of an event table(event_id, ts, event_type, value, props); the session is in UTC.

    series names the column that tells assets apart; None makes one asset of the table.
    """
    loaded = F.col("event_type").isin("click", "purchase")
    return events.select(
        (F.lit("S1") if series is None else F.col(series).cast("string")).alias("series_id"),
        "event_id", "ts", micros(F.col("ts")).alias("us"), F.col("value").alias("a1"),
        F.get_json_object("props", "$.k").cast("double").alias("a2"),
        F.when(loaded, 1).otherwise(0).alias("dv"),
        F.when(loaded | (F.col("event_type") == "error"), 0).otherwise(1).alias("comp"),
        "event_type",
    )
