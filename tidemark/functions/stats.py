"""Statistics of columns and groups: profiles, histograms, correlations, effect sizes, runs."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.quantiles import counted, quantiles
from tidemark.operators.labels import FAILURES
from tidemark.operators.timeline import lagged, series_runs
from tidemark.schema import HOUR_US, VIEW, Roles


def unpivoted(df: DataFrame, keep: list[str], columns: list[str], name: str = "signal", value: str = "value") -> DataFrame:
    """A row for each of the columns."""
    return df.unpivot(keep, columns, name, value)


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, std, min, quartiles and max of each column; percentiles are exact and interpolate. A table without rows
    has none of them and counts 0."""
    long = unpivoted(df.select(*[F.col(c).cast("double") for c in columns]), [], columns)
    sums = long.groupBy("signal").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    q = quantiles(long, ["signal"], "value", (0.25, 0.5, 0.75))
    every = df.sparkSession.createDataFrame([(c,) for c in columns], "signal string")
    return every.join(sums, "signal", "left").join(q, "signal", "left").select("signal", F.coalesce("n", F.lit(0)).alias("n"), "mean", "std", "min", *[F.get("q", i).alias(c) for i, c in enumerate(("p25", "p50", "p75"))], "max")


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    sums = df.agg(*[F.sum(F.col(c).isNull().cast("int")).alias(c) for c in columns])
    return unpivoted(sums, [], columns, "column", "n_null")


def digital_summary(df: DataFrame, signals: list[str]) -> DataFrame:
    long = unpivoted(df.select(*signals), [], signals)
    return long.groupBy("signal").agg(F.count_if(F.col("value") == 0).alias("n_zeros"), F.count_if(F.col("value") == 1).alias("n_ones"), F.count_if(~F.col("value").isin(0, 1)).alias("n_other"), F.bround(F.avg((F.col("value") == 1).cast("int")), 4).alias("frac_active"))


def interval_distribution(lags: DataFrame) -> DataFrame:
    return lags.filter("dus IS NOT NULL").groupBy("dus").agg(F.count(F.lit(1)).alias("n"))


def modal_interval(lags: DataFrame) -> DataFrame:
    """The most frequent time between rows (the smallest of ties), its share of all rows' intervals."""
    counts = interval_distribution(lags)
    best = counts.agg(F.min_by("dus", F.struct(-F.col("n"), "dus")).alias("dus"), F.max("n").alias("top"), F.sum("n").alias("all"))
    return best.select(F.col("dus").alias("modal_us"), (F.col("top") / F.col("all")).alias("modal_share"))


def histogram(df: DataFrame, column: str, bins: int = 60) -> DataFrame:
    """Equal-width bins over the column's range; the last is closed."""
    r = df.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    d = df.filter(F.col(column).isNotNull()).crossJoin(F.broadcast(r))  # one row
    width = (F.col("_hi") - F.col("_lo")) / bins
    b = F.when(F.col("_hi") > F.col("_lo"), F.least(F.floor((F.col(column) - F.col("_lo")) / width), F.lit(bins - 1))).otherwise(0)
    return d.groupBy(b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def box_stats(df: DataFrame, column: str) -> DataFrame:
    """Quartiles, whiskers at 1.5 interquartile ranges, and the number of values beyond."""
    q = quantiles(df.select(F.col(column).cast("double").alias("v")), [], "v", (0.25, 0.5, 0.75)).select(*[F.get("q", i).alias(c) for i, c in enumerate(("q1", "median", "q3"))])
    lo, hi = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1")), F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    d = df.crossJoin(F.broadcast(q))  # one row
    inside = (F.col(column) >= lo) & (F.col(column) <= hi)
    return d.groupBy("q1", "median", "q3").agg(F.min(F.when(inside, F.col(column))).alias("whisker_lo"), F.max(F.when(inside, F.col(column))).alias("whisker_hi"), F.count_if(~inside).alias("n_outliers"))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Pearson correlation of each pair, in one aggregate."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    row = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    return unpivoted(row, [], [f"{a}|{b}" for a, b in pairs], "pair", "r").select(F.split("pair", r"\|")[0].alias("a"), F.split("pair", r"\|")[1].alias("b"), "r")


def average_ranks(df: DataFrame, columns: list[str]) -> DataFrame:
    """Adds {column}_rank, averaged over ties, from the running counts of distinct values."""
    for c in columns:
        ranks = counted(df.select(F.col(c).alias("_v")), [], "_v").select("_v", (F.col("_upto") - (F.col("_n") - 1) / 2).alias(f"{c}_rank"))
        df = df.join(ranks, df[c] == ranks["_v"], "left").drop("_v")
    return df


def spearman(df: DataFrame, columns: list[str]) -> DataFrame:
    ranked = average_ranks(df.select(*columns), columns)
    return correlations(ranked.select(*[F.col(f"{c}_rank").alias(c) for c in columns]), columns)


def between(df: DataFrame, lo: int, hi: int, r: Roles = VIEW, time: str = "ts") -> DataFrame:
    """Rows whose timestamp lies in the seconds that [lo, hi] touches, so that the scan reads those alone; all where the
    table has no timestamp."""
    if time not in df.columns:
        return df
    at = lambda us: F.lit(datetime.fromtimestamp(us, timezone.utc).replace(tzinfo=None)).cast("timestamp_ntz")
    return df.filter((F.col(time) >= at(lo // 1_000_000)) & (F.col(time) < at(hi // 1_000_000 + 1)))


def toggles_per_hour(df: DataFrame, signal: str, lo: int, hi: int, r: Roles = VIEW) -> DataFrame:
    """Changes of a signal on [lo, hi) per hour, for each series; the first row counts as one."""
    d = lagged(between(df, lo, hi, r).filter((F.col(r.us) >= lo) & (F.col(r.us) < hi)), {signal: "_prev"}, r)
    return d.groupBy(r.series).agg((F.sum((~F.col(signal).eqNullSafe(F.col("_prev"))).cast("int")) / ((F.max(r.us) - F.min(r.us)) / HOUR_US)).alias("toggles_per_hour"))


def run_summary(df: DataFrame, signals: list[str], state: int = 0, r: Roles = VIEW) -> DataFrame:
    """Lengths of the runs of a state, in minutes of samples."""
    runs = series_runs(df, signals, r).filter(F.col("state") == state).withColumn("mins", F.col("n") * r.sample_seconds / 60)
    sums = runs.groupBy("signal").agg(F.count(F.lit(1)).alias("n_runs"), F.max("mins").alias("_max"), F.sum("mins").alias("_sum"), F.count_if(F.col("mins") > 60).alias("n_runs_over_1h"))
    d = sums.join(quantiles(runs, ["signal"], "mins", (0.5, 0.9)), "signal")
    return d.select("signal", "n_runs", F.bround(F.get("q", 0), 2).alias("median_min"), F.bround(F.get("q", 1), 2).alias("p90_min"), F.bround("_max", 1).alias("max_min"), F.bround("_sum", 1).alias("total_min"), "n_runs_over_1h")


def effect_sizes(df: DataFrame, group: Column, features: list[str], reference: str, other: str, digital: list[str], extra: list[str] | None = None) -> DataFrame:
    """Effect of other against reference: difference and ratio of rates for binary features, else of medians over the
    reference's interquartile range; null where that is 0."""
    extra = extra or []
    long = unpivoted(df.select(*extra, group.alias("_g"), *[F.col(f).cast("double") for f in features]), [*extra, "_g"], features, "feature", "x")
    of = lambda g: F.when(F.col("_g") == g, F.col("x"))
    s = long.groupBy(*extra, "feature").agg(F.avg(of(reference)).alias("mr"), F.avg(of(other)).alias("mg"))
    for g, names in ((reference, ("q1", "q2", "q3")), (other, (None, "qg", None))):
        q = quantiles(long.filter(F.col("_g") == g), [*extra, "feature"], "x", (0.25, 0.5, 0.75))
        s = s.join(q.select(*extra, "feature", *[F.get("q", i).alias(n) for i, n in enumerate(names) if n]), [*extra, "feature"], "left")
    binary = F.col("feature").isin(*digital) if digital else F.lit(False)
    iqr = F.col("q3") - F.col("q1")
    effect = F.when(binary, F.bround(F.col("mg") - F.col("mr"), 3)).when(iqr != 0, F.bround((F.col("qg") - F.col("q2")) / iqr, 2))
    ratio = F.when(binary & (F.col("mr") != 0), F.bround(F.col("mg") / F.col("mr"), 2))
    return s.select(*extra, "feature", effect.alias("effect"), ratio.alias("ratio"))


def prefail_effects(df: DataFrame, at: str, label: str, features: list[str], digital: list[str], hours: int = 48, healthy_wins: bool = True, failures=FAILURES) -> DataFrame:
    """effect_sizes of each failure's last hours against all healthy rows."""
    spans = F.array(*[F.struct(F.lit(f.failure_id).alias("failure"), F.lit(f.start - hours * HOUR_US).alias("lo"), F.lit(f.start).alias("hi")) for f in failures])
    d = df.withColumn("_f", F.explode(spans))
    healthy, inside = F.col(label) == "healthy", (F.col(at) >= F.col("_f.lo")) & (F.col(at) < F.col("_f.hi"))
    group = F.when(healthy, "healthy").when(inside, "prefail") if healthy_wins else F.when(inside, "prefail").when(healthy, "healthy")
    return effect_sizes(d.withColumn("failure", F.col("_f.failure")), group, features, "healthy", "prefail", digital, ["failure"])
