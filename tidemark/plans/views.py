"""Engine tables as SQL: temporary views, queries in SQL text, and a table function over runs."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Windows of each alarm's segment that scored higher than it: a correlated subquery for each row.
ABOVE_ALARM = """
SELECT a.idx, a.ws, a.level,
       (SELECT count(*) FROM {scores} s WHERE s.seg = w.seg AND s.zmax > w.zmax) AS n_above,
       EXISTS (SELECT 1 FROM {alarms} b WHERE b.ws < a.ws AND b.ws >= a.ws - {back}) AS follows
FROM {alarms} a JOIN {scores} w ON w.ws = a.ws
"""

#: Alarms each of which is within a time of the one before it, as chains: recursion over numbered alarms.
CHAINS = """
WITH RECURSIVE numbered AS (
  SELECT ws, lag(ws) OVER (ORDER BY ws) AS before, row_number() OVER (ORDER BY ws) AS k FROM {alarms}
), chain (k, ws, first, length) AS (
  SELECT k, ws, ws, 1 FROM numbered WHERE before IS NULL OR ws - before > {back}
  UNION ALL
  SELECT n.k, n.ws, c.first, c.length + 1 FROM chain c JOIN numbered n ON n.k = c.k + 1 AND n.ws - c.ws <= {back}
)
SELECT first AS chain_start, max(ws) AS chain_end, max(length) AS n_alarms FROM chain GROUP BY first
"""

#: Windows led by any of the drivers that lead most often, with how far they are above their driver's mean.
LEADERS = """
WITH counts AS (SELECT driver, count(*) AS n, avg(zmax) AS mean FROM {scores} WHERE alert GROUP BY driver)
SELECT s.ws, s.driver, round(s.zmax - (SELECT max(c.mean) FROM counts c WHERE c.driver = s.driver), 5) AS above
FROM {scores} s WHERE s.alert AND s.driver IN (SELECT driver FROM counts ORDER BY n DESC, driver LIMIT 3)
"""


def register(spark: SparkSession, tables: dict[str, DataFrame], prefix: str = "tidemark_") -> dict[str, str]:
    """Makes each table a temporary view of the session; the views' names by the tables'."""
    for name, df in tables.items():
        df.createOrReplaceTempView(prefix + name)
    return {name: prefix + name for name in tables}


def sql(spark: SparkSession, text: str, tables: dict[str, DataFrame], depth: int = 1000, **values: int) -> DataFrame:
    """The result of a query whose text names tables and whole numbers in braces. depth bounds recursion, which reads the
    table once a step: a chain longer than that raises."""
    key = "spark.sql.cteRecursionLevelLimit"
    before = spark.conf.get(key, "100")
    spark.conf.set(key, str(depth))
    try:
        out = spark.sql(text.format(**register(spark, tables), **{k: int(v) for k, v in values.items()}))
        if "RECURSIVE" in text:
            from tidemark.storage import stored

            return stored(out)  # while the limit holds
        return out
    finally:
        spark.conf.set(key, before)


class Runs:
    """Runs of equal states in the rows (series, us, state) of one partition, in order of time: one row for each run."""

    def __init__(self) -> None:
        self.run = None

    def eval(self, row) -> Iterator[tuple]:
        if self.run and self.run[1] == row["state"]:
            self.run[3], self.run[4] = row["us"], self.run[4] + 1
            return
        if self.run:
            yield tuple(self.run)
        self.run = [row["series"], row["state"], row["us"], row["us"], 1]

    def terminate(self) -> Iterator[tuple]:
        if self.run:
            yield tuple(self.run)


def register_functions(spark: SparkSession) -> None:
    """Makes tidemark_runs(TABLE(t) PARTITION BY series ORDER BY us) a table function of the session."""
    spark.udtf.register("tidemark_runs", F.udtf(Runs, returnType="series string, state int, first_us long, last_us long, n long", useArrow=True))
