"""Boosted trees, AdaBoost and the kernel classifier against brute force and hand computation."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tidemark.plans import boosting, models


def table(spark, x, y, extra=None):
    rows = [(int(b), *[None if np.isnan(v) else float(v) for v in a], *(() if extra is None else (int(extra[i]),))) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    kinds = ["_y int", *[f"c{i} double" for i in range(x.shape[1])], *(() if extra is None else ("m int",))]
    return spark.createDataFrame(rows, ", ".join(kinds)).repartition(3)


def columns(x):
    return [f"c{i}" for i in range(x.shape[1])]


def data(seed, n=150, k=4):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, k)), 1)
    y = (((x[:, 0] > 0) ^ (x[:, 1] > 0.4)) | (x[:, 2] > 1.4)).astype(int)
    x[rng.random(x.shape) < 0.1] = np.nan
    return x, y


def brute_tree(x, g, h, rows, depth, eta, penalty):
    """Value of each row under a tree grown by trying every cut with nulls on either side."""
    if depth:
        best = (1e-6, None)
        worth = lambda r: g[r].sum() ** 2 / (h[r].sum() + penalty)
        for c in range(x.shape[1]):
            v = x[rows, c]
            for cut in np.unique(v[~np.isnan(v)]):
                for null_left in (True, False):
                    left = np.where(np.isnan(v), null_left, v <= cut)
                    a, b = rows[left], rows[~left]
                    if len(a) and len(b) and h[a].sum() >= 1 and h[b].sum() >= 1 and (gain := worth(a) + worth(b) - worth(rows)) > best[0] + 1e-9:
                        best = (gain, (a, b))
        if best[1]:
            return {k: v for part in best[1] for k, v in brute_tree(x, g, h, part, depth - 1, eta, penalty).items()}
    value = -eta * g[rows].sum() / (h[rows].sum() + penalty)
    return dict.fromkeys(rows.tolist(), value)


@pytest.mark.parametrize("node_rows", [20_000, 40, 0])
def test_first_trees_equal_brute_force(spark, monkeypatch, node_rows):
    """Grown by histograms of all rows, by tasks that have a node's rows, and by both."""
    monkeypatch.setattr(boosting, "NODE_ROWS", node_rows)
    monkeypatch.setattr(boosting, "STORED_ROUNDS", 1)
    x, y = data(1)
    d = table(spark, x, y)
    model = boosting.boost(d, columns(x), trees=2, depth=3, positive_weight=3.0)
    s = np.zeros(len(y))
    for _ in range(2):
        p, w = 1 / (1 + np.exp(-s)), np.where(y == 1, 3.0, 1.0)
        tree = brute_tree(x, (p - y) * w, p * (1 - p) * w, np.arange(len(y)), 3, 0.3, 1.0)
        s = s + np.array([tree[i] for i in range(len(y))])
    assert np.allclose(model.sums(np.zeros(len(y), int), x), s)
    got = sorted((r.s, r["_y"]) for r in d.select("_y", model.score().alias("s")).collect())
    assert np.allclose([g[0] for g in got], sorted(s)) and len({round(v, 9) for v in s}) > 6


@pytest.mark.parametrize("node_rows", [20_000, 0])
def test_models_grown_together_equal_single_ones(spark, monkeypatch, node_rows):
    monkeypatch.setattr(boosting, "NODE_ROWS", node_rows)
    x, y = data(2)
    u = (np.nan_to_num(x[:, 3]) > 0.2).astype(int)
    both = table(spark, np.r_[x, x], np.r_[y, u], np.r_[np.zeros(len(y)), np.ones(len(u))])
    for fit, how in ((boosting.boost, {"trees": 3, "depth": 2}), (boosting.ada_boost, {"rounds": 3})):
        together = fit(both, columns(x), model="m", models=2, **how)
        for k, b in enumerate((y, u)):
            alone = fit(table(spark, x, b), columns(x), **how)
            assert np.allclose(together.sums(np.full(len(b), k), x), alone.sums(np.zeros(len(b), int), x))
        assert ((together.sums(np.ones(len(u), int), x) > 0) == (u == 1)).mean() > 0.9


def test_three_rounds_of_adaboost_equal_a_hand_computation(spark):
    x = np.arange(10, dtype=float)[:, None]
    y = np.array([1, 1, 1, 0, 0, 0, 1, 1, 1, 0])
    model = boosting.ada_boost(table(spark, x, y), ["c0"], rounds=3)
    w, sums = np.full(10, 0.1), np.zeros(10)
    for k in range(3):
        tries = []
        for cut in range(9):
            sides = [x[:, 0] <= cut, x[:, 0] > cut]
            votes = [w[s & (y == 1)].sum() * 2 > w[s].sum() for s in sides]
            impurity = sum(w[s].sum() - (w[s & (y == 1)].sum() ** 2 + w[s & (y == 0)].sum() ** 2) / w[s].sum() for s in sides)
            tries.append((round(impurity, 12), cut, np.where(sides[0], votes[0], votes[1])))
        _, cut, vote = min(tries, key=lambda t: t[:2])
        wrong = vote != (y == 1)
        alpha = np.log((1 - w[wrong].sum()) / w[wrong].sum())
        w = w * np.exp(alpha * wrong)
        w /= w.sum()
        sums += alpha * np.where(vote, 1, -1)
        stump = model.rounds[k]
        assert int(stump.cut[0, 0]) == cut and np.allclose(np.abs(stump.value[0, 1:]), alpha)
    assert np.allclose(model.sums(np.zeros(10, int), x), sums)
    own = np.exp(-(2 * y - 1) * sums / 2)
    assert np.allclose(own / own.sum(), w)  # the weights follow from the sums


def test_adaboost_ends_where_a_stump_is_never_wrong(spark):
    x = np.arange(8, dtype=float)[:, None]
    model = boosting.ada_boost(table(spark, x, (x[:, 0] > 3).astype(int)), ["c0"], rounds=9)
    assert len(model.rounds) == 1 and ((model.sums(np.zeros(8, int), x) > 0) == (x[:, 0] > 3)).all()


def test_cuts_are_exact_ranks(spark):
    x = np.r_[np.full(600, 5.0), np.arange(400)][:, None]
    cuts = boosting.bin_cuts(table(spark, x, np.zeros(1000)), ["c0"], bins=10)[0]
    v = np.sort(x[:, 0])
    want = sorted({float(u) for u in np.unique(v) if np.floor((v <= u).sum() / 100) > np.floor((v < u).sum() / 100) and u < v[-1]})
    assert cuts.tolist() == want
    assert [c.tolist() for c in boosting.bin_cuts(table(spark, np.full((3, 1), np.nan), np.zeros(3)), ["c0"])] == [[]]


def test_constant_and_empty_tables(spark):
    x = np.full((6, 2), 1.0)
    model = boosting.boost(table(spark, x, np.array([0, 1, 0, 1, 1, 1])), columns(x), trees=2)
    assert (model.rounds[0].column == -1).all() and np.ptp(model.sums(np.zeros(6, int), x)) < 1e-12
    none = boosting.boost(table(spark, x, np.zeros(6)).filter("_y > 3"), columns(x), trees=1)
    assert none.sums(np.zeros(6, int), x).tolist() == [0.0] * 6


def rings(spark, n=400):
    rng = np.random.default_rng(5)
    turn, y = rng.uniform(0, 2 * np.pi, n), np.arange(n) % 2
    r = np.where(y == 1, 2.0, 0.7) + rng.normal(0, 0.1, n)
    return spark.createDataFrame([(int(b), float(a), float(c)) for a, c, b in zip(r * np.cos(turn), r * np.sin(turn), y, strict=True)], "_y int, c0 double, c1 double")


def test_kernel_features_and_rings(spark):
    d = models.assembled(rings(spark), ["c0", "c1"]).withColumn("_weight", F.lit(1.0))
    waves = models.FourierFeatures(2, gamma=0.5, size=2048)
    rows = waves.transform(d.limit(40)).select("c0", "c1", vector_to_array("_phi").alias("p")).collect()
    x, phi = np.array([[r.c0, r.c1] for r in rows]), np.array([r.p for r in rows])
    exact = np.exp(-0.5 * ((x[:, None] - x[None]) ** 2).sum(-1))
    assert np.abs(phi @ phi.T - exact).mean() < 0.02 and np.abs(phi @ phi.T - exact).max() < 0.1
    seen = Observation()
    d.observe(seen, F.count(F.lit(1)).alias("n")).count()
    assert seen.get["n"] == 400  # from now on the session can't be sent to tasks, nor can models that hold it
    right = {}
    for name, learner in (("linear", models.LinearSVC(featuresCol="_x", labelCol="_y", maxIter=50)), ("kernel", models.KernelSVC())):
        right[name] = models.detached(learner.fit(d)).transform(d).agg(F.avg((F.col("prediction") == F.col("_y")).cast("int"))).first()[0]
    assert right["kernel"] > 0.97 > 0.75 > right["linear"]
