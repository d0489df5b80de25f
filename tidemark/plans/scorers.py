"""Anomaly scores by name, side by side on one table."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark import registry
from tidemark.plans import models, scoring
from tidemark.plans.features import SCORED
from tidemark.storage import stored


def _zmax(split: DataFrame, columns) -> DataFrame:
    d = scoring.standardised(split, columns)
    return d.withColumn("zmax", scoring.zmax(columns)).drop(*[f"z_{c}" for c in columns])


#: Each takes a table split in time and the scored columns, and adds a column of its name.
SCORERS: dict[str, Callable[[DataFrame, tuple[str, ...]], DataFrame]] = {
    "zmax": _zmax,
    "mahalanobis": lambda split, columns: scoring.mahalanobis(split, columns)[0],
    "forecast_residual": lambda split, columns: scoring.forecast_residual(split, "oil_median"),
    "iforest": models.isolation_forest,
    "anchored_residual": lambda split, columns: models.anchored_residual(split, columns=columns),
}


def with_scores(split: DataFrame, names: Iterable[str], columns=SCORED) -> DataFrame:
    """Adds a column of each named scorer, built in or registered; a column that is there already stays.

    The table, a row for each window, is stored after each scorer: the next one reads it several times. Raises if a
    scorer doesn't give its column or changes the number of columns otherwise.
    """
    known = SCORERS | registry.registered("scorer")
    names = list(names)
    if odd := [n for n in names if n not in known and n not in split.columns]:
        raise KeyError(f"no scorer named {', '.join(odd)}; there are {', '.join(sorted(known))}")
    for name in names:
        if name in split.columns:
            continue
        made = known[name](split, tuple(columns))
        if sorted(made.columns) != sorted([*split.columns, name]):
            raise ValueError(f"scorer {name} must add the column {name} and no other")
        split = stored(made.withColumn(name, F.col(name).cast("double")))
    return split
