"""Boosting over histograms of bins: second-order trees, and AdaBoost over stumps. Several models are grown at once.

Columns are cut into bins once, by exact ranks. A level of a tree is one job: tasks add up their rows' statistics for each
(model, node, column, bin), Spark sums them, and the driver chooses the splits from what is left, a table of models *
nodes * columns * bins numbers at the most, whatever the rows are. Nodes with few rows are not split that way: their rows
are grouped, and one task grows what lies below a node, by the same rules. Rows with nulls have a bin of their own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.quantiles import counted
from tidemark.storage import stored

#: Rows of a task, at the least: a job for each level of a round should not be many small tasks.
TASK_ROWS = 20_000
#: Rows of a node up to which one task grows what lies below it.
NODE_ROWS = 20_000
#: Rounds after which rows are stored with what the models give for them so far.
STORED_ROUNDS = 20
_STATS = "model int, node int, place int, bin int, g double, h double, n long"
_NODES = "model int, node int, place int, cut int, null_left boolean, value double"
_LEAST_GAIN = 1e-6


def values(columns) -> Column:
    """The columns as one array of doubles."""
    return F.array(*[F.col(c).cast("double") for c in columns])


def bin_cuts(df: DataFrame, columns, bins: int = 256) -> list[np.ndarray]:
    """For each column the upper ends of its bins, the last one's left out: of all distinct values those at which the
    share of rows up to them passes a multiple of 1 / bins, so all of them where there are no more rows than bins."""
    long = df.select(*[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(columns)]).unpivot([], [f"v{i}" for i in range(len(columns))], "name", "value").filter("NOT isnan(value)")
    counts = stored(counted(long, ["name"], "value"))
    total = counts.groupBy("name").agg(F.max("_upto").alias("_all"))
    d = counts.join(F.broadcast(total), "name")  # a row for each column
    step = lambda n: F.floor(n * bins / F.col("_all"))
    kept = d.filter((step(F.col("_upto")) > step(F.col("_upto") - F.col("_n"))) & (F.col("_upto") < F.col("_all"))).select("name", "value").collect()
    found: dict[str, list[float]] = {}
    for r in kept:
        found.setdefault(r["name"], []).append(r["value"])
    return [np.array(sorted(found.get(f"v{i}", []))) for i in range(len(columns))]


def matrix_of(column: pa.Array) -> np.ndarray:
    """Arrays of one length as rows; nulls are NaN."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(float).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Bin of each value, from 0; -1 for NaN."""
    out = np.empty(x.shape, np.int16)
    for i, c in enumerate(cuts):
        out[:, i] = np.where(np.isnan(x[:, i]), -1, np.searchsorted(c, x[:, i], side="left"))
    return out


@dataclass
class Round:
    """A tree for each model, as arrays (models, nodes) in heap order. Leaves have column -1."""

    column: np.ndarray
    cut: np.ndarray
    null_left: np.ndarray
    value: np.ndarray

    @classmethod
    def empty(cls, models: int, depth: int) -> Round:
        shape = (models, 2 ** (depth + 1) - 1)
        return cls(np.full(shape, -1), np.zeros(shape, int), np.ones(shape, bool), np.zeros(shape))

    def nodes(self, model: np.ndarray, bins: np.ndarray) -> np.ndarray:
        node, rows = np.zeros(len(bins), int), np.arange(len(bins))
        for _ in range(int(np.log2(self.column.shape[1] + 1)) - 1):
            c = self.column[model, node]
            b = bins[rows, np.maximum(c, 0)]
            right = np.where(b < 0, ~self.null_left[model, node], b > self.cut[model, node])
            node = np.where(c < 0, node, 2 * node + 1 + right)
        return node

    def add(self, model: np.ndarray, bins: np.ndarray) -> np.ndarray:
        return self.value[model, self.nodes(model, bins)]


@dataclass
class Boosted:
    """Models grown together: what each gives for a row is the sum over rounds of its trees' values."""

    columns: list[str]
    cuts: list[np.ndarray]
    rounds: list[Round] = field(default_factory=list)

    def sums(self, model: np.ndarray, x: np.ndarray) -> np.ndarray:
        bins, out = binned(x, self.cuts), np.zeros(len(x))
        for r in self.rounds:
            out += r.add(model, bins)
        return out

    def score(self, model: Column | None = None) -> Column:
        """Sum of a row's leaves under the model of that number."""
        def run(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
            for m, x in parts:
                yield pa.array(self.sums(m.to_numpy(zero_copy_only=False).astype(int), matrix_of(x)))

        return F.arrow_udf(run, "double")(F.coalesce(model if model is not None else F.lit(0), F.lit(0)).cast("int"), values(self.columns))


def _rows(df: DataFrame, columns, cuts: list[np.ndarray], label: str, model: str | None) -> DataFrame:
    def run(columns_: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for x in columns_:
            b = binned(matrix_of(x), cuts)
            yield pa.ListArray.from_arrays(np.arange(0, b.size + 1, max(1, b.shape[1]), dtype=np.int32) if b.size else np.zeros(len(x) + 1, np.int32), pa.array(b.ravel()))

    bins = F.arrow_udf(run, "array<smallint>")(values(columns))
    rows = stored(df.select((F.col(model) if model else F.lit(0)).cast("int").alias("model"), F.col(label).cast("int").alias("y"), bins.alias("bins"), F.lit(0.0).alias("sum")))
    return rows.coalesce(-(-rows.count() // TASK_ROWS) or 1)


def _taken(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    m, y, s = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("model", "y", "sum"))
    return m.astype(int), y.astype(int), matrix_of(batch.column("bins")).astype(np.int16), s.astype(float)


def _statistics(rounds: list[Round], tree: Round, level: int, stats: Callable, most: int):
    """Of the rows in the nodes of a level, number and sums of g and h by (model, node, column, bin)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, width = 2**level - 1, most + 2  # nodes of the level; a bin for nulls, and one to spare
        held = np.zeros((0, 3))
        for batch in batches:
            model, y, bins, out = _taken(batch)
            if not len(y):
                continue
            for r in rounds:
                out += r.add(model, bins)
            g, h = stats(model, y, out)
            node = tree.nodes(model, bins)
            here = node >= first
            key = (model[here] * 2**level + node[here] - first) * width
            size = tree.column.shape[0] * 2**level * width
            if not len(held):
                held = np.zeros((bins.shape[1] * size, 3))
            for c in range(bins.shape[1]):
                at = key + bins[here, c] + 1
                for k, v in enumerate((None, g[here], h[here])):
                    held[c * size : (c + 1) * size, k] += np.bincount(at, v, size)
        used = np.flatnonzero(held[:, 0])
        size = tree.column.shape[0] * 2**level * width
        place, rest = np.divmod(used, size)
        model, rest = np.divmod(rest, 2**level * width)
        node, code = np.divmod(rest, width)
        yield pa.RecordBatch.from_arrays([pa.array(v.astype(np.int32)) for v in (model, node + first, place, code - 1)] + [pa.array(held[used, k]) for k in (1, 2)] + [pa.array(held[used, 0].astype(np.int64))], ["model", "node", "place", "bin", "g", "h", "n"])

    return run


def _with_sums(rows: DataFrame, rounds: list[Round]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            model, _, bins, out = _taken(batch)
            for r in rounds:
                out = out + r.add(model, bins)
            yield pa.RecordBatch.from_arrays([batch.column("model"), batch.column("y"), batch.column("bins"), pa.array(out, pa.float64())], ["model", "y", "bins", "sum"])

    return stored(rows.mapInArrow(run, rows.schema))


def _histograms(rows: DataFrame, rounds: list[Round], tree: Round, level: int, stats: Callable, cuts: list[np.ndarray]) -> dict[tuple[int, int], np.ndarray]:
    """For each (model, node) of a level an array (columns, bins + 1, 3) of g, h and n; the last bin is that of nulls."""
    most = max((len(c) for c in cuts), default=0) + 1
    sums = rows.mapInArrow(_statistics(rounds, tree, level, stats, most), _STATS).groupBy("model", "node", "place", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n"))
    out: dict[tuple[int, int], np.ndarray] = {}
    for r in sums.collect():
        out.setdefault((r["model"], r["node"]), np.zeros((len(cuts), most + 1, 3)))[r["place"], r["bin"]] += (r["g"], r["h"], r["n"])
    return out


def _best_split(hist: np.ndarray, cuts: list[np.ndarray], gain: Callable[[np.ndarray, np.ndarray], np.ndarray]):
    """(gain, column, cut, null_left) of the best split; of equal ones that of the first column and cut, nulls to the
    left. gain takes the sums (g, h) of both sides."""
    total, nulls = hist[0].sum(axis=0), hist[:, -1]
    below = np.cumsum(hist[:, :-1], axis=1)[:, :-1]  # (columns, cuts, 3)
    real = np.arange(below.shape[1])[None] < np.array([len(c) for c in cuts])[:, None]
    each = [np.where(real, gain(left, total - left), -np.inf) for left in (below + nulls[:, None], below)]
    if not below.shape[1]:
        return -np.inf, -1, 0, True
    best = np.maximum(each[0], each[1])
    column, cut = np.unravel_index(np.argmax(best), best.shape)
    return float(best[column, cut]), int(column), int(cut), bool(each[0][column, cut] >= each[1][column, cut])


def _grow(bins: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray], levels: int, gain: Callable, least: float) -> list[tuple]:
    """The tree of one node's rows as (place in heap order, column, cut, null_left, g, h)."""
    most, out, open_ = max((len(c) for c in cuts), default=0) + 1, [], [(0, np.arange(len(g)), levels)]
    while open_:
        at, rows, left_levels = open_.pop()
        hist = np.zeros((len(cuts), most + 1, 3))
        if left_levels:
            for c in range(len(cuts)):
                b = np.where(bins[rows, c] < 0, most, bins[rows, c])
                hist[c] = np.stack([np.bincount(b, v, most + 1) for v in (g[rows], h[rows], np.ones(len(rows)))], axis=1)
        won, column, cut, null_left = _best_split(hist, cuts, gain) if left_levels else (-np.inf, -1, 0, True)
        if won <= least:
            column, cut, null_left = -1, 0, True
        else:
            b = bins[rows, column]
            right = np.where(b < 0, not null_left, b > cut)
            open_ += [(2 * at + 1, rows[~right], left_levels - 1), (2 * at + 2, rows[right], left_levels - 1)]
        out.append((at, column, cut, null_left, float(g[rows].sum()), float(h[rows].sum())))
    return out


def _below(root: int, at: int) -> int:
    """Place in the tree of what is at a place below root in a tree of its own, both in heap order."""
    depth = (at + 1).bit_length() - 1
    return (root + 1) * 2**depth - 1 + (at + 1 - 2**depth)


def _grown(rows: DataFrame, rounds: list[Round], tree: Round, small: set[tuple[int, int]], depth: int, stats: Callable, cuts: list[np.ndarray], gain: Callable, least: float, leaf: Callable) -> list:
    """Rows of _NODES below the nodes in small, each grown by a task from the node's rows."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            model, y, bins, out = _taken(batch)
            if not len(y):
                continue
            for r in rounds:
                out += r.add(model, bins)
            g, h = stats(model, y, out)
            node = tree.nodes(model, bins)
            here = np.array([k in small for k in zip(model.tolist(), node.tolist(), strict=True)])
            yield pa.RecordBatch.from_arrays([pa.array(model[here].astype(np.int32)), pa.array(node[here].astype(np.int32)), batch.column("bins").filter(pa.array(here)), pa.array(g[here]), pa.array(h[here])], ["model", "node", "bins", "g", "h"])

    def grow(table: pa.Table) -> pa.Table:
        model, node = table.column("model")[0].as_py(), table.column("node")[0].as_py()
        level = (node + 1).bit_length() - 1
        found = _grow(matrix_of(table.column("bins").combine_chunks()).astype(np.int16), table.column("g").to_numpy(), table.column("h").to_numpy(), cuts, depth - level, gain, least)
        kinds = [pa.int32()] * 4 + [pa.bool_(), pa.float64()]
        cells = zip(*[(model, _below(node, at), c, cut, left, float(leaf(g, h))) for at, c, cut, left, g, h in found], strict=True)
        return pa.table([pa.array(x, k) for x, k in zip(cells, kinds, strict=True)], ["model", "node", "place", "cut", "null_left", "value"])

    given = rows.mapInArrow(take, "model int, node int, bins array<smallint>, g double, h double")
    return given.groupBy("model", "node").applyInArrow(grow, _NODES).collect()  # 2 ** (depth + 1) for each model at most


def boost(df: DataFrame, columns, label: str = "_y", model: str | None = None, models: int = 1, trees: int = 100, depth: int = 6, eta: float = 0.3, penalty: float = 1.0, gamma: float = 0.0, least_hessian: float = 1.0, positive_weight: float = 1.0, bins: int = 256) -> Boosted:
    """Second-order boosting of the logistic loss (Chen and Guestrin, 2016): trees of regularised gain, level by level,
    with a learned side for nulls. model names a column of model numbers below models; each learns from its own rows."""
    columns = list(columns)
    cuts = bin_cuts(df, columns, bins)
    rows, out, since = _rows(df, columns, cuts, label, model), Boosted(columns, cuts), []
    sizes = {r["model"]: r["count"] for r in rows.groupBy("model").count().collect()}  # a row for each model

    def stats(_, y: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p, w = 1 / (1 + np.exp(-s)), np.where(y == 1, positive_weight, 1.0)
        return (p - y) * w, np.maximum(p * (1 - p), 1e-16) * w

    worth = lambda a: a[..., 0] ** 2 / np.maximum(a[..., 1] + penalty, 1e-16)
    leaf = lambda g, h: -eta * g / max(h + penalty, 1e-16)
    least = max(gamma, _LEAST_GAIN)

    def gain(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        fits = (left[..., 1] >= least_hessian) & (right[..., 1] >= least_hessian) & (left[..., 2] > 0) & (right[..., 2] > 0)
        return np.where(fits, worth(left) + worth(right) - worth(left + right), -np.inf)

    for _ in range(trees):
        tree, small = Round.empty(models, depth), {(m, 0) for m, n in sizes.items() if n <= NODE_ROWS}
        large = {(m, 0) for m in sizes} - small
        for level in range(depth + 1):
            found = _histograms(rows, since, tree, level, stats, cuts) if large else {}
            large = {k for k in large if k in found}
            for m, node in sorted(large):
                hist = found[m, node]
                g, h, _ = hist[0].sum(axis=0)
                tree.value[m, node] = leaf(g, h)
                won, column, cut, left = _best_split(hist, cuts, gain) if level < depth else (-np.inf, -1, 0, True)
                large.discard((m, node))
                if won > least:
                    tree.column[m, node], tree.cut[m, node], tree.null_left[m, node] = column, cut, left
                    low = hist[column, : cut + 1, 2].sum() + (hist[column, -1, 2] if left else 0)
                    for child, n in ((2 * node + 1, low), (2 * node + 2, hist[column, :, 2].sum() - low)):
                        (small if n <= NODE_ROWS else large).add((m, child))
        for r in _grown(rows, since, tree, small, depth, stats, cuts, gain, least, leaf) if small else []:
            m, node = r["model"], r["node"]
            tree.column[m, node], tree.cut[m, node], tree.null_left[m, node], tree.value[m, node] = r["place"], r["cut"], r["null_left"], r["value"]
        out.rounds.append(tree)
        since.append(tree)
        if len(since) == STORED_ROUNDS:
            rows, since = _with_sums(rows, since), []
    return out


def ada_boost(df: DataFrame, columns, label: str = "_y", model: str | None = None, models: int = 1, rounds: int = 50, bins: int = 256) -> Boosted:
    """AdaBoost (SAMME, two classes) over stumps of the least weighted Gini impurity. A model's sum for a row is that of
    its rounds' weights, each with the sign of the round's vote; the share of a row's weight follows from the sums:
    exp(-y * sum / 2) with y of -1 and 1. A model whose stump is no better than chance, or is never wrong, has its last."""
    columns = list(columns)
    cuts = bin_cuts(df, columns, bins)
    rows, out, since = _rows(df, columns, cuts, label, model), Boosted(columns, cuts), []

    def stats(_, y: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w = np.exp(-(2 * y - 1) * s / 2)
        return w * y, w

    def purity(a: np.ndarray) -> np.ndarray:
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(a[..., 1] > 0, a[..., 0] ** 2 / a[..., 1] + (a[..., 1] - a[..., 0]) ** 2 / a[..., 1], 0.0)

    gain = lambda left, right: np.where((left[..., 1] > 0) & (right[..., 1] > 0), purity(left) + purity(right), -np.inf)
    over = np.zeros(models, bool)
    for _ in range(rounds):
        stump = Round.empty(models, 1)
        for (m, _), hist in _histograms(rows, since, stump, 0, stats, cuts).items():
            won, column, cut, left = _best_split(hist, cuts, gain)
            if over[m] or not np.isfinite(won):
                over[m] = True
                continue
            low = hist[column, : cut + 1].sum(axis=0) + (hist[column, -1] if left else 0)
            total = hist[column].sum(axis=0)
            sides = [low, total - low]
            wrong = sum(min(s[0], s[1] - s[0]) for s in sides) / total[1]
            over[m] = wrong <= 1e-12 or wrong >= 0.5
            if wrong >= 0.5 and out.rounds:
                continue
            alpha = np.log((1 - max(wrong, 1e-12)) / max(wrong, 1e-12))
            stump.column[m, 0], stump.cut[m, 0], stump.null_left[m, 0] = column, cut, left
            stump.value[m, 1:] = [alpha if 2 * s[0] > s[1] else -alpha for s in sides]
        out.rounds.append(stump)
        since.append(stump)
        if len(since) == STORED_ROUNDS:
            rows, since = _with_sums(rows, since), []
        if over.all():
            break
    return out
