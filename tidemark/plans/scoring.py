"""Leak-free standardisation, anomaly scores, drivers, and flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.quantiles import quantiles
from tidemark.operators.labels import FAILURES
from tidemark.operators.timeline import lagged_many, running_count
from tidemark.plans.features import SCORED, prepared
from tidemark.schema import DAY_US, HOUR_US, Roles
from tidemark.storage import stored


#: Windows by time; a series has one at a time. Buckets of them hold a month.
BY_TIME = Roles(us="ws", seq="win")
MONTH_US = 30 * DAY_US


def time_split(features: DataFrame, train_fraction: float = 0.6) -> DataFrame:
    """Adds is_train and is_val (healthy windows, the earliest first), is_eval_fail, is_eval_degr."""
    d = features.withColumn("healthy", F.col("label") == "healthy").withColumn("_tie", F.struct("seg", "win"))
    d = running_count(d, F.col("healthy"), "_rank", Roles(series="healthy", us="ws", seq="_tie"), MONTH_US)
    d = d.crossJoin(F.broadcast(features.agg(F.count_if(F.col("label") == "healthy").alias("_n"))))  # one row
    train = F.col("healthy") & (F.col("_rank") - 1 < F.floor(F.col("_n") * train_fraction))
    return d.withColumns({"is_train": train, "is_val": F.col("healthy") & ~train, "is_eval_fail": F.col("label").isin("prefail", "infail"), "is_eval_degr": F.col("label") == "degraded"}).drop("_rank", "_n", "_tie", "healthy")


def scaler(split: DataFrame, columns=SCORED) -> DataFrame:
    """One row of means and deviations (0 counts as 1) of the training windows."""
    spread = lambda c: F.when(F.stddev_samp(c) == 0, 1.0).otherwise(F.coalesce(F.stddev_samp(c), F.lit(1.0)))
    return split.filter("is_train").agg(*[F.avg(c).alias(f"_mu_{c}") for c in columns], *[spread(c).alias(f"_sd_{c}") for c in columns])


def standardised(split: DataFrame, columns=SCORED) -> DataFrame:
    """Adds z_{column}."""
    d = split.crossJoin(F.broadcast(scaler(split, columns)))  # one row
    return d.withColumns({f"z_{c}": (F.col(c) - F.col(f"_mu_{c}")) / F.col(f"_sd_{c}") for c in columns}).drop(*[f"_{k}_{c}" for k in ("mu", "sd") for c in columns])


def zmax(columns=SCORED) -> Column:
    """Largest |z|; nulls are passed over."""
    return F.greatest(*[F.abs(f"z_{c}") for c in columns])


def driver(columns=SCORED) -> Column:
    """The first column whose |z| is the largest."""
    best = zmax(columns)
    return F.coalesce(*[F.when(F.abs(f"z_{c}") == best, F.lit(c)) for c in columns])


def top_drivers(columns=SCORED, k: int = 6) -> Column:
    """The k columns of largest |z|, nulls last, as structs (z, column)."""
    ranked = F.array_sort(F.array(*[F.struct(F.col(f"z_{c}").isNull().alias("none"), (-F.abs(f"z_{c}")).alias("m"), F.lit(i).alias("i"), F.lit(c).alias("column"), F.col(f"z_{c}").alias("z")) for i, c in enumerate(columns)]))
    return F.slice(ranked, 1, k)


def threshold(scored: DataFrame, q: float = 0.99, score: str = "zmax") -> DataFrame:
    """One row: the quantile of the validation windows' scores."""
    return quantiles(scored.filter("is_val"), [], score, (q,)).select(F.get("q", 0).alias("thr"))


def scored(features: DataFrame, q: float = 0.99, columns=SCORED) -> DataFrame:
    """Features with splits, z columns, zmax, driver, thr, alert and quality_bad."""
    split = stored(time_split(prepared(features)))
    d = stored(standardised(split, columns).withColumn("zmax", zmax(columns)).withColumn("driver", driver(columns)))
    d = d.crossJoin(F.broadcast(threshold(d, q)))  # one row
    return d.withColumns({"alert": F.col("zmax") > F.col("thr"), "quality_bad": F.col("motor_frozen") | F.col("tp3_frozen")})


def targets(failures=FAILURES, hours: int = 48) -> list[tuple[str, int, int, int]]:
    """(name, first start, last start, failure start) of the windows that each failure's evaluation counts as positive."""
    return [(f.failure_id, f.start - hours * HOUR_US, f.end, f.start) for f in failures]


def forecast_residual(features: DataFrame, signal: str, lags: int = 6, alpha: float = 1.0) -> DataFrame:
    """Adds forecast_residual: the error of a ridge regression of the signal on its last windows of the segment.

    Fitted on healthy windows with whole lags from one table of sums; windows without whole lags score 0,
    the others null where there is nothing to fit.
    """
    import numpy as np

    d = lagged_many(features, [signal, "seg"], lags, "_lags", BY_TIME, MONTH_US)
    d = d.withColumns({f"_lag{k}": F.get("_lags", k - 1)[signal] for k in range(1, lags + 1)}).withColumn("_seg", F.get("_lags", lags - 1)["seg"]).drop("_lags")
    names = [f"_lag{k}" for k in range(1, lags + 1)]
    usable = (F.col("_seg") == F.col("seg")) & F.col(signal).isNotNull()
    for c in names:
        usable = usable & F.col(c).isNotNull()
    fit = d.filter(usable & (F.col("label") == "healthy"))
    every = [*names, signal]
    pairs = [(a, b) for i, a in enumerate(every) for b in every[i:]]
    row = fit.agg(F.count(F.lit(1)), *[F.avg(c) for c in every], *[F.covar_pop(a, b) for a, b in pairs]).first()  # one row
    n, means = row[0], row[1 : 1 + len(every)]
    if not n:
        return d.withColumn("forecast_residual", F.when(usable, F.lit(None).cast("double")).otherwise(0.0)).drop("_seg", *names)
    cov = np.zeros((len(every), len(every)))
    for (a, b), v in zip(pairs, row[1 + len(every) :], strict=True):
        i, j = every.index(a), every.index(b)
        cov[i, j] = cov[j, i] = v * n
    beta = np.linalg.solve(cov[:-1, :-1] + alpha * np.eye(lags), cov[:-1, -1])
    guess = sum((F.lit(float(b)) * (F.col(c) - F.lit(m)) for b, c, m in zip(beta, names, means[:-1], strict=True)), F.lit(means[-1]))
    return d.withColumn("forecast_residual", F.when(usable, F.abs(F.col(signal) - guess)).otherwise(0.0)).drop("_seg", *names)


def mahalanobis(split: DataFrame, columns=SCORED) -> tuple[DataFrame, float]:
    """Adds mahalanobis, the distance from the training mean under a Ledoit-Wolf covariance; and its condition number.

    Moments come from two aggregates of fixed width; the matrix is inverted on the driver. A null counts as the mean; a
    column without any training value tells nothing. Without training windows the distance is null.
    """
    import numpy as np

    train = split.filter("is_train")
    p = len(columns)
    row = train.agg(F.count(F.lit(1)), *[F.avg(c) for c in columns]).first()  # one row
    n, mu = row[0], row[1:]
    if not n:
        return split.withColumn("mahalanobis", F.lit(None).cast("double")), float("nan")
    x = [F.coalesce(F.col(c) - F.lit(m), F.lit(0.0)) if m is not None else F.lit(0.0) for c, m in zip(columns, mu, strict=True)]
    square = sum((v * v for v in x[1:]), x[0] * x[0])
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    sums = train.agg(F.sum(square * square), *[F.sum(x[i] * x[j]) for i, j in pairs]).first()  # one row
    s = np.zeros((p, p))
    for (i, j), v in zip(pairs, sums[1:], strict=True):
        s[i, j] = s[j, i] = v / n
    m = np.trace(s) / p
    delta = ((s - m * np.eye(p)) ** 2).sum() / p
    beta = min((sums[0] / n - (s**2).sum()) / (n * p), delta)
    shrunk = (beta / delta if delta else 0.0) * m * np.eye(p) + (1 - (beta / delta if delta else 0.0)) * s
    inverse = np.linalg.pinv(shrunk, hermitian=True)  # constant columns alone leave it singular
    total = sum((F.lit(float(inverse[i, j]) * (1 if i == j else 2)) * x[i] * x[j] for i, j in pairs[1:]), F.lit(float(inverse[0, 0])) * x[0] * x[0])
    return split.withColumn("mahalanobis", F.sqrt(F.greatest(total, F.lit(0.0)))), float(np.linalg.cond(shrunk))
