"""Model matrix, isolation forest, healthy-anchored residuals, leave-one-failure-out classifiers, permutation importance."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import Estimator, PipelineModel, Transformer
from pyspark.ml.classification import DecisionTreeClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.quantiles import numbered
from tidemark.operators.labels import FAILURES
from tidemark.plans.boosting import Boosted, ada_boost, boost, matrix_of, values
from tidemark.plans.evaluation import average_precision, by_score, roc_auc
from tidemark.plans.features import SCORED
from tidemark.plans.scoring import targets
from tidemark.storage import checkpoint_folder, stored

#: Columns that say which window it is, and don't enter the model matrix.
BOOKKEEPING = ("series_id", "seg", "win", "ws", "we", "label", "n_samples")
REGIMES = ("cycling", "idle", "locked")


def matrix(features: DataFrame, bookkeeping: tuple[str, ...] = BOOKKEEPING, regimes: tuple[str, ...] = REGIMES) -> DataFrame:
    """Bookkeeping columns and the numeric rest: booleans as 0 and 1, cycling_regime as a column for each regime. Raises
    if a column is left that isn't numeric."""
    meta = [c for c in bookkeeping if c in features.columns]
    rest = [f for f in features.schema if f.name not in meta and f.name != "cycling_regime"]
    odd = [f.name for f in rest if not isinstance(f.dataType, (T.NumericType, T.BooleanType))]
    if odd:
        raise ValueError(f"columns that are not numeric: {odd}")
    columns = [F.col(f.name).cast("int").alias(f.name) if isinstance(f.dataType, T.BooleanType) else F.col(f.name) for f in rest]
    hot = [(F.col("cycling_regime") == r).cast("int").alias(f"regime_{r}") for r in regimes] if "cycling_regime" in features.columns else []
    return features.select(*meta, *columns, *hot)


def numeric_columns(matrix_: DataFrame, tags: tuple[str, ...] = ()) -> list[str]:
    """Columns of a matrix that are features, without those whose name has one of the tags."""
    return [c for c in matrix_.columns if c not in BOOKKEEPING and not any(t in c for t in tags)]


def assembled(df: DataFrame, columns) -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol="_x", handleInvalid="keep").transform(df)


# --- isolation forest


def _grow(x: np.ndarray, rng: np.random.Generator, depth: int) -> list[tuple[int, float, int, int, float]]:
    """An isolation tree as rows (column, cut, left, right, path length); leaves have column -1."""
    nodes: list = []

    def build(rows: np.ndarray, level: int) -> int:
        at = len(nodes)
        nodes.append(None)
        low, high = (x[rows].min(axis=0), x[rows].max(axis=0)) if len(rows) else (np.zeros(1), np.zeros(1))
        open_ = np.nonzero(high > low)[0]
        if level >= depth or len(rows) <= 1 or not len(open_):
            nodes[at] = (-1, 0.0, -1, -1, level + _mean_path(len(rows)))
            return at
        c = int(rng.choice(open_))
        cut = float(rng.uniform(low[c], high[c]))
        inside = x[rows, c] <= cut
        left, right = build(rows[inside], level + 1), build(rows[~inside], level + 1)
        nodes[at] = (c, cut, left, right, 0.0)
        return at

    build(np.arange(len(x)), 0)
    return nodes


def _mean_path(n: int) -> float:
    """Mean length of a search that fails in a binary tree of n rows."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (np.log(n - 1) + np.euler_gamma) - 2 * (n - 1) / n


def _trees(split: DataFrame, columns, trees: int, sample: int, seed: int) -> DataFrame:
    """Isolation trees as rows (tree, size, node, column, cut, left, right, path), each grown by one task.

    Of the training rows, trees * sample at most are taken, those of least hash; of these, each tree has the sample rows
    of least hash with the tree's number. Nulls count as 0.
    """
    at = ("series_id", "seg", "win")
    x = F.array(*[F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in columns])
    rows = split.filter("is_train").select(F.xxhash64(F.lit(seed), *at).alias("h"), *at, x.alias("x"))
    rows = rows.orderBy("h", *at).limit(trees * sample)  # a number of rows that doesn't grow
    each = rows.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    order = Window.partitionBy("tree").orderBy(F.xxhash64(F.lit(seed), "tree", "h"), "h", *at)
    drawn = each.withColumn("k", F.row_number().over(order)).filter(F.col("k") <= sample).select("tree", "k", "x")

    def grow(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        tree, table = key[0].as_py(), table.sort_by("k")
        v = np.array(table.column("x").to_pylist(), float)
        nodes = _grow(v, np.random.default_rng([seed, tree]), max(1, int(np.ceil(np.log2(max(2, len(v)))))))
        parts = [pa.array(c) for c in zip(*nodes, strict=True)]
        return pa.table([pa.array([tree] * len(nodes), pa.int32()), pa.array([len(v)] * len(nodes), pa.int32()), pa.array(range(len(nodes)), pa.int32()), parts[0].cast(pa.int32()), parts[1].cast(pa.float64()), parts[2].cast(pa.int32()), parts[3].cast(pa.int32()), parts[4].cast(pa.float64())], ["tree", "size", "node", "column", "cut", "left", "right", "path"])

    return drawn.groupBy("tree").applyInArrow(grow, "tree int, size int, node int, column int, cut double, left int, right int, path double")


def isolation_forest(split: DataFrame, columns=SCORED, trees: int = 100, sample: int = 256, seed: int = 1) -> DataFrame:
    """Adds iforest, from 0 to 1: rows that few random cuts isolate score high (Liu et al., 2008).

    Each tree is grown by one task from sample training rows, drawn by hashes: the same rows give the same forest,
    however they are partitioned. The forest, of 2 * trees * sample nodes at most, is sent to the tasks that score.
    Without training rows the score is null.
    """
    grown = _trees(split, columns, trees, sample, seed).toPandas().sort_values(["tree", "node"])  # a model of fixed size
    if grown.empty:
        return split.withColumn("iforest", F.lit(None).cast("double"))
    size = int(grown["size"].iloc[0])
    forest = [t[["column", "cut", "left", "right", "path"]].to_numpy(float) for _, t in grown.groupby("tree")]
    norm = _mean_path(size) or 1.0

    names = list(split.columns)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.nan_to_num(np.stack([c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in batch.columns[len(names) :]], axis=1))
            total = np.zeros(len(v))
            for tree in forest:
                at = np.zeros(len(v), int)
                while (inner := tree[at, 0] >= 0).any():
                    c = np.maximum(tree[at, 0].astype(int), 0)
                    step = np.where(v[np.arange(len(v)), c] <= tree[at, 1], tree[at, 2], tree[at, 3]).astype(int)
                    at = np.where(inner, step, at)
                total += tree[at, 4]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(2.0 ** (-total / len(forest) / norm))], [*names, "iforest"])

    given = split.select("*", *[F.col(c).cast("double").alias(f"_f{i}") for i, c in enumerate(columns)])
    return given.mapInArrow(score, T.StructType([*split.schema.fields, T.StructField("iforest", T.DoubleType())]))


# --- residuals against the healthy expectation


def anchored_residual(features: DataFrame, signals=("oil_median", "tp3_decay_slope"), columns=SCORED, multi: bool = True, seed: int = 1) -> DataFrame:
    """Adds anchored_residual (or, without multi, one for each signal): how far a signal is from what boosted trees, fitted
    on healthy windows, tell from the other columns; in healthy deviations, the largest of the signals. Null without
    healthy windows of the signal."""
    healthy = F.col("label") == "healthy"
    for s in signals:
        if features.filter(healthy & F.col(s).isNotNull()).isEmpty():
            features = features.withColumn(f"{s}_residual", F.lit(None).cast("double"))
            continue
        d = assembled(features, [c for c in columns if c != s])
        model = GBTRegressor(featuresCol="_x", labelCol=s, predictionCol="_guess", maxIter=20, maxDepth=3, stepSize=0.1, seed=seed).fit(d.filter(healthy & F.col(s).isNotNull()))
        d = stored(model.transform(d).withColumn("_r", F.abs(F.col(s) - F.col("_guess"))).drop("_x", "_guess"))
        spread = d.filter(healthy).agg(F.stddev_pop("_r").alias("_sd"))
        scaled = F.col("_r") / F.when(F.coalesce(F.col("_sd"), F.lit(0.0)) == 0, 1.0).otherwise(F.col("_sd"))
        features = d.crossJoin(F.broadcast(spread)).withColumn(f"{s}_residual", scaled).drop("_r", "_sd")  # one row
    names = [f"{s}_residual" for s in signals]
    if not multi:
        return features
    return features.withColumn("anchored_residual", F.greatest(*names) if len(names) > 1 else F.col(names[0])).drop(*names)


# --- classifiers

class FourierFeatures(Transformer):
    """Adds output: random features of the vector in input whose products are those of a Gaussian kernel,
    exp(-gamma * |x - y|^2), up to an error that falls as one over the root of their number (Rahimi and Recht, 2007)."""

    def __init__(self, width: int, gamma: float, size: int = 256, input: str = "_x", output: str = "_phi", seed: int = 1) -> None:
        super().__init__()
        rng = np.random.default_rng(seed)
        self.weights, self.turns = rng.normal(0, np.sqrt(2 * gamma), (size, width)), rng.uniform(0, 2 * np.pi, size)
        self.input, self.output = input, output

    def _transform(self, dataset: DataFrame) -> DataFrame:
        waves = F.from_json(F.lit(json.dumps([{"w": w, "b": b} for w, b in zip(self.weights.tolist(), self.turns.tolist(), strict=True)])), "array<struct<w: array<double>, b: double>>")
        dot = lambda wave: F.aggregate(F.zip_with(wave["w"], F.col("_given"), lambda w, x: w * x), F.lit(0.0), lambda s, v: s + v)
        phi = F.transform(waves, lambda wave: F.cos(dot(wave) + wave["b"]) * float(np.sqrt(2 / len(self.turns))))
        return dataset.withColumn("_given", vector_to_array(self.input)).withColumn(self.output, array_to_vector(phi)).drop("_given")


class KernelSVC(Estimator):
    """Support vector classifier with a Gaussian kernel: a linear one over FourierFeatures. Without gamma it is one over
    the number of columns times the variance of all their values."""

    def __init__(self, gamma: float | None = None, size: int = 256, max_iter: int = 50, seed: int = 1) -> None:
        super().__init__()
        self.gamma, self.size, self.max_iter, self.seed = gamma, size, max_iter, seed

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        x = vector_to_array("_x")
        found = dataset.select(F.size(x).alias("d"), F.explode(x).alias("v")).agg(F.max("d").alias("d"), F.var_pop("v").alias("v")).first()
        gamma = self.gamma or 1 / (found["d"] * (found["v"] or 1.0))
        waves = FourierFeatures(found["d"], gamma, self.size, seed=self.seed)
        linear = LinearSVC(featuresCol="_phi", labelCol="_y", weightCol="_weight", maxIter=self.max_iter, standardization=False)
        return PipelineModel([waves, detached(linear.fit(waves.transform(dataset)))])


def detached(model):
    """A fitted model as it is when written and read again: without the summary of its training, which holds the session
    and, once something has been observed in that, can't be sent to tasks."""
    if not getattr(model, "hasSummary", False):
        return model
    path = f"{checkpoint_folder(SparkSession.active())}/model-{uuid.uuid4().hex}"
    model.write().save(path)
    return type(model).load(path)


@dataclass(frozen=True)
class Together:
    """A learner that grows the models of all held-out failures at once, from a table with model numbers."""

    fit: Callable[..., Boosted]
    options: dict


#: MLlib's learners, each with balanced weights, and boosted ones.
LEARNERS: dict[str, Callable[[], Estimator] | Together] = {
    "logreg": lambda: LogisticRegression(featuresCol="_x", labelCol="_y", weightCol="_weight", maxIter=100),
    "tree": lambda: DecisionTreeClassifier(featuresCol="_x", labelCol="_y", weightCol="_weight", maxDepth=10, seed=1),
    "rf": lambda: RandomForestClassifier(featuresCol="_x", labelCol="_y", weightCol="_weight", numTrees=100, maxDepth=10, seed=1),
    "gbm": Together(boost, {"trees": 100, "depth": 3, "eta": 0.1, "penalty": 0.0, "least_hessian": 0.0}),
    "ada": Together(ada_boost, {"rounds": 50}),
    "svm": KernelSVC,
    "xgb": Together(boost, {"trees": 100, "depth": 6, "eta": 0.3, "positive_weight": 20.0}),
}


def positives(at: str, failures=FAILURES, hours: int = 48, infail: bool = True) -> Column:
    """The failure whose last hours (and, with infail, whose span) hold a window; later failures win."""
    out = F.lit(None).cast("string")
    for name, lo, hi, start in targets(failures, hours):
        inside = (F.col(at) >= lo) & ((F.col(at) <= hi) if infail else (F.col(at) < start))
        out = F.when(inside, F.lit(name)).otherwise(out)
    return out


def weighted(df: DataFrame) -> DataFrame:
    """Adds _weight: both classes of _y weigh the same in all."""
    sums = df.groupBy("_y").agg(F.count(F.lit(1)).alias("_n")).crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("_all"))))  # one row
    return df.join(F.broadcast(sums.select("_y", (F.col("_all") / (2 * F.col("_n"))).alias("_weight"))), "_y")  # two rows


def _margin(scored: DataFrame) -> Column:
    """Score of class 1: its probability, or the raw margin where a learner gives none."""
    return F.get(vector_to_array(F.col("probability" if "probability" in scored.columns else "rawPrediction")), 1)


def leave_one_out(features: DataFrame, learners: dict[str, Callable[[], Estimator] | Together] | None = None, columns=SCORED, failures=FAILURES, hours: int = 48) -> DataFrame:
    """Rows (model, target, roc_auc, pr_auc, n_pos, n_neg): each failure judged by learners that saw healthy windows and
    the other failures. A failure is left out if there are no windows of it or none of the others."""
    d = assembled(features.withColumn("fail_of", positives("ws", failures, hours)), columns)
    d = stored(d.withColumn("_y", F.col("fail_of").isNotNull().cast("int")).filter((F.col("label") == "healthy") | (F.col("_y") == 1)).select("fail_of", "_y", "_x", *columns))
    there = {r["fail_of"]: r["n"] for r in d.filter("_y = 1").groupBy("fail_of").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each failure
    held = [f.failure_id for f in failures if there.get(f.failure_id) and len(there) > 1]
    rows = None
    for name, learner in (learners or LEARNERS).items() if held else ():
        if isinstance(learner, Together):
            one = [_scores_together(name, learner, d, held, columns)]
        else:
            one = [_scores(name, learner(), d, h) for h in held]
        for part in one:
            rows = part if rows is None else rows.unionByName(part)
    if rows is None:
        return features.sparkSession.createDataFrame([], "model string, target string, roc_auc double, n_pos long, n_neg long, pr_auc double")
    counts = by_score(rows)
    return roc_auc(counts).join(average_precision(counts), ["model", "target"])


def _scores(name: str, learner: Estimator, d: DataFrame, held: str) -> DataFrame:
    healthy = F.col("fail_of").isNull()
    out = detached(learner.fit(weighted(d.filter(healthy | (F.col("fail_of") != held))))).transform(d.filter(healthy | (F.col("fail_of") == held)))
    return out.select(F.lit(name).alias("model"), F.lit(held).alias("target"), _margin(out).alias("score"), F.col("_y").alias("y"))


def _scores_together(name: str, learner: Together, d: DataFrame, held: list[str], columns) -> DataFrame:
    each = [(F.col("fail_of").isNull() | (F.col("fail_of") != h), F.col("fail_of").isNull() | (F.col("fail_of") == h)) for h in held]
    of = lambda side: F.explode(F.array_compact(F.array(*[F.when(pair[side], k) for k, pair in enumerate(each)])))
    model = learner.fit(d.withColumn("_model", of(0)), columns, model="_model", models=len(held), **learner.options)
    names = F.array(*[F.lit(h) for h in held])
    test = d.withColumn("_model", of(1))
    return test.select(F.lit(name).alias("model"), F.get(names, F.col("_model")).alias("target"), model.score(F.col("_model")).alias("score"), F.col("_y").alias("y"))


def permutation_importance(features: DataFrame, columns=SCORED, failures=FAILURES, hours: int = 48, infail: bool = True, repeats: int = 10, trees: int = 200, positive_weight: float | None = None, seed: int = 1) -> DataFrame:
    """Rows (column, importance): by how much the average precision of second-order boosted trees falls, on average, where
    a column's values are dealt anew; without infail windows from a failure's start on don't count as positive.

    Values are permuted by numberings of the rows, one by place and one by a hash for each repeat, that are joined. All
    columns are scored side by side. positive_weight is 20 with infail and 40 without.
    """
    columns = list(columns)
    y = positives("ws", failures, hours, infail).isNotNull().cast("int")
    d = features.withColumn("_y", y).filter((F.col("label") == "healthy") | (F.col("_y") == 1)).select("series_id", "seg", "win", "_y", *[F.col(c).cast("double").alias(c) for c in columns])
    d = stored(numbered(d, ["series_id", "seg", "win"], "_row"))
    n = d.count()
    model = boost(d, columns, trees=trees, positive_weight=positive_weight or (20.0 if infail else 40.0))
    given = d.select("_row", "_y", values(columns).alias("_v"))
    again = given.withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    dealt = numbered(again.select("_r", F.xxhash64(F.lit(seed), "_r", "_row").alias("_h"), "_row", F.col("_v").alias("_new")), ["_r", "_h", "_row"], "_to")
    dealt = dealt.select("_r", (F.col("_to") - F.col("_r").cast("long") * n).alias("_row"), "_new")

    def score(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for old, new in parts:
            x, z = matrix_of(old), matrix_of(new)
            none, out = np.zeros(len(x), int), []
            for c in range(len(columns)):
                moved = x.copy()
                moved[:, c] = z[:, c]
                out.append(model.sums(none, moved))
            flat = np.stack(out, axis=1).ravel() if len(x) else np.zeros(0)
            yield pa.ListArray.from_arrays(np.arange(0, len(x) * len(columns) + 1, len(columns), dtype=np.int32), pa.array(flat))

    scored = again.select("_r", "_row", "_y", "_v").join(dealt, ["_r", "_row"]).select("_r", "_y", F.posexplode(F.arrow_udf(score, "array<double>")("_v", "_new")).alias("_c", "score"))
    moved = scored.select(F.col("_c").cast("string").alias("model"), F.col("_r").cast("string").alias("target"), "score", F.col("_y").alias("y"))
    base = d.select(F.lit("all").alias("model"), F.lit("base").alias("target"), model.score().alias("score"), F.col("_y").alias("y"))
    found = average_precision(by_score(stored(moved.unionByName(base))))
    before = found.filter("model = 'all'").select(F.col("pr_auc").alias("base"))
    name = F.get(F.array(*[F.lit(c) for c in columns]), F.col("model").cast("int"))
    falls = found.filter("model <> 'all'").crossJoin(F.broadcast(before)).groupBy(name.alias("column"))  # one row
    return falls.agg(F.avg(F.col("base") - F.col("pr_auc")).alias("importance"))
