"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut


#: Edges of which one task finds the components.
FOREST_EDGES = 500_000
#: Rows that it gives out at once.
_ROWS = 10_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, root) of every node of a task's edges; root is the smallest node that the task's edges join it to."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[p]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if (p := find(a)) != (q := find(b)):
                parent[max(p, q)] = min(p, q)
    nodes = list(parent)
    for at in range(0, len(nodes), _ROWS):
        part = nodes[at : at + _ROWS]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([find(x) for x in part], pa.int64())], ["node", "root"])


def components(edges: DataFrame, most_rounds: int = 60, store: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """Rows (node, root) of every node of edges(a, b); root is the component's smallest node. store keeps each round's edges.

    Tasks of FOREST_EDGES edges each first find the components of their own edges. With no more edges than that these are
    the result. Of several tasks the results are edges again, which large-star and small-star rounds join (Kiveris et al.,
    2014): in practice they need a number of rounds that grows with the logarithm of the size at most; each is stored, and
    the loop ends when a round changes nothing. A round is some ten shuffles, so few edges are not worth them.
    """
    edges = store(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    tasks = max(1, -(-edges.count() // FOREST_EDGES))
    forest = edges.coalesce(tasks).mapInArrow(_forest, "node long, root long")
    if tasks == 1:
        return store(forest)
    # A dense group is left with as many edges as it has nodes, for each task.
    edges = store(forest.filter("node <> root").toDF("a", "b").distinct())

    def mark(e: DataFrame) -> tuple:
        r = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return tuple(r)

    seen = mark(edges)
    for _ in range(most_rounds):
        if not seen[0]:
            break
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(down.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()
        edges = store(small)
        now = mark(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
