"""K-d tree sharding by weighted medians; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import bucket_count, cut, offsets, shielded

#: Coordinates are cut to this many bits and followed by as many bits of a hash, which splits ties.
_BITS = 24
#: Bins of a histogram in the search of a median, and the share of a node's weight at which the search ends.
_BINS_BITS = 16
_CLOSE = 1e-5


#: Nodes of a level that are sent to all tasks; with more each has few points, and they are joined by a shuffle. So many
#: nodes go into expressions, more into tables.
SENT_NODES = 1_000_000
SMALL = 64


def _ranks(values: DataFrame) -> DataFrame:
    """Rows (v, rank) of the distinct values v, in order, from 0; nulls left out. Values are dealt to ranges; each range's
    ranks begin after the numbers of those before."""
    parts = cut(values.filter("v IS NOT NULL").distinct().repartitionByRange("v").select("v", F.spark_partition_id().alias("part")))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))  # a row for each range
    return parts.join(starts, "part").select("v", (F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy("v")) - 1).cast("double").alias("rank"))


def _with_codes(raw: DataFrame, columns: list[str]) -> DataFrame:
    """Strings replaced by their ranks among the column's values; -1 for null."""
    for c in columns:
        ranks = _ranks(raw.select(F.col(c).alias("v"))).withColumnRenamed("v", c)
        raw = raw.join(ranks, c, "left").drop(c).withColumn(c, F.coalesce("rank", F.lit(-1.0))).drop("rank")
    return raw


def text_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 1."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


@shielded
def kd_shards(
    docs: DataFrame,
    shards: int | None = 16,
    target_bytes: int | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    metadata: tuple[str, ...] = ("lang", "source"),
    keep: list[str] | None = None,
) -> DataFrame:
    """Columns of keep (all by default) and __size, __shard, __slot for each row.

    Points of the tree are the distinct texts, weighted by the sizes of their copies, so equal texts share a shard.
    Their coordinates are the text's length, the copies' smallest id (its rank, if ids aren't numbers) and the rank of
    the smallest value of each metadata column. A node splits along its widest coordinate (range over the whole table's
    range) where the weight divides as the shards to fill do. Nodes are a table; all medians of a level are found at once
    in histograms of fixed size, one for each node. With target_bytes the number of shards is the total size over it.
    __slot counts from 0 within a shard, without gaps.

    Nulls: a null text is a text of its own of size 1; null metadata and ids come first. Metadata columns that the
    table lacks are left out. One text with more weight than a shard's share makes that shard larger. Repeated rows get
    a slot each. An empty table gives no rows.
    """
    keep = docs.columns if keep is None else keep
    text = F.col(text_col)
    rows = docs.select(
        *[F.col(f"`{c}`") for c in keep],
        F.coalesce(F.xxhash64(text), F.lit(0)).alias("__h"), text.isNull().alias("__n"), text_size(text).alias("__size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).alias("__crc"),
        F.col(id_col).alias("__id"), *[F.col(m).alias(f"__m{i}") for i, m in enumerate(m for m in metadata if m in docs.columns)],
    )
    metas = [c for c in rows.columns if c.startswith("__m") and c[3:].isdigit()]
    group = ["__h", "__crc", "__n", "__size"]
    raw = rows.groupBy(*group).agg(F.sum("__size").alias("__w"), F.count(F.lit(1)).alias("__count"), F.min("__id").alias("__id"), *[F.min(m).alias(m) for m in metas])
    number = isinstance(docs.schema[id_col].dataType, T.NumericType)
    raw = _with_codes(raw.withColumn("__id", F.col("__id").cast("double" if number else "string")), metas if number else ["__id", *metas])
    coords = [F.col("__size").cast("double"), F.col("__id"), *[F.col(m) for m in metas]]
    points = cut(raw.select(*group, "__w", "__count", *[F.when(c.isNull() | F.isnan(c), -1.0).otherwise(c).alias(f"c{i}") for i, c in enumerate(coords)]))
    dims = len(coords)
    bounds = points.agg(F.sum("__w").alias("total"), F.sum("__count").alias("rows"), *[f(f"c{i}").alias(f"{n}{i}") for i in range(dims) for n, f in (("lo", F.min), ("hi", F.max))]).first()
    if bounds["total"] is None:
        return rows.select(*[F.col(f"`{c}`") for c in keep], "__size", F.lit(None).cast("int").alias("__shard"), F.lit(None).cast("long").alias("__slot"))
    if target_bytes:
        shards = max(1, -(-bounds["total"] // target_bytes))
    tie = F.shiftrightunsigned(F.xxhash64(*group), 64 - _BITS)
    top = (1 << _BITS) - 1
    for i in range(dims):
        span = (bounds[f"hi{i}"] - bounds[f"lo{i}"]) or 1.0
        points = points.withColumn(f"q{i}", F.shiftleft(F.floor((F.col(f"c{i}") - F.lit(bounds[f"lo{i}"])) / F.lit(span) * F.lit(top)).cast("long"), _BITS) + tie)
    points = cut(points.select(*group, "__w", *[f"q{i}" for i in range(dims)], F.lit(1).cast("long").alias("node")))

    spark, q = docs.sparkSession, [f"q{i}" for i in range(dims)]
    nodes = spark.createDataFrame([(1, shards, 0)], "node long, shards long, first long")
    for level in range((shards - 1).bit_length()):
        nodes = _split_few(points, nodes, q) if 1 << level <= SMALL else cut(_split_nodes(points, nodes, q, level))
        side = F.when(F.col("split").isNull(), F.col("node")).otherwise(2 * F.col("node") + (F.get(F.array(*q), F.col("dim")) >= F.col("split")).cast("long"))
        points = cut(points.join(_sent(nodes.select("node", "dim", "split"), level), "node").select(*group, "__w", *q, side.alias("node")))
        half = F.floor(F.col("shards") / 2).cast("long")
        children = nodes.filter("split IS NOT NULL").select(F.explode(F.array(F.struct((2 * F.col("node")).alias("node"), half.alias("shards"), "first"), F.struct((2 * F.col("node") + 1).alias("node"), (F.col("shards") - half).alias("shards"), (F.col("first") + half).alias("first")))).alias("c")).select("c.*")
        nodes = nodes.filter("split IS NULL").select("node", "shards", "first").unionByName(children)
    places = points.join(_sent(nodes, (shards - 1).bit_length()), "node").select(*group, F.col("first").cast("int").alias("__shard"))

    # Slots: rows of a shard are dealt to buckets by their text's hash and, for hot texts, by their id's.
    buckets = bucket_count(bounds["rows"] // shards + 1)
    placed = rows.join(places, group).withColumn("__bucket", F.pmod(F.xxhash64("__h", "__id"), F.lit(buckets)).cast("int"))
    counts = placed.groupBy("__shard", "__bucket").agg(F.count(F.lit(1)).alias("n"))
    starts = offsets(counts, ["__shard"], "__bucket", "n", "__before").select("__shard", "__bucket", "__before")
    order = Window.partitionBy("__shard", "__bucket").orderBy("__id", "__h")
    return (
        placed.join(starts.hint("shuffle_merge"), ["__shard", "__bucket"])
        .withColumn("__slot", F.col("__before") + F.row_number().over(order) - 1)
        .select(*[F.col(f"`{c}`") for c in keep], "__size", "__shard", F.col("__slot").cast("long"))
    )


def _sent(nodes: DataFrame, level: int) -> DataFrame:
    return F.broadcast(nodes) if 1 << level <= SENT_NODES else nodes  # a level has so many nodes at most


def _ranges(points: DataFrame, q: list[str]) -> DataFrame:
    """Rows (node, w, dim): a node's weight and its widest coordinate, the first of ties."""
    wide = [F.shiftright(F.max(c), _BITS) - F.shiftright(F.min(c), _BITS) for c in q]
    sums = points.groupBy("node").agg(F.sum("__w").alias("w"), F.array(*wide).alias("r"))
    return sums.select("node", "w", (F.array_position("r", F.array_max("r")) - 1).cast("int").alias("dim"))


def _first_over(here: DataFrame, bits: int, before: Column, want: Column) -> DataFrame:
    """Of each node's rows (node, __w, q) the first bin of q with which the weight, from before on, passes want."""
    bins = here.groupBy("node", F.shiftright("q", bits).alias("bin")).agg(F.sum("__w").alias("in"))
    upto = bins.withColumn("upto", before + F.sum("in").over(Window.partitionBy("node").orderBy("bin")))  # 65536 rows at most
    return upto.groupBy("node").agg(F.min(F.when(F.col("upto") > want, F.struct("bin", "in", "upto"))).alias("b"))


def _split_few(points: DataFrame, nodes: DataFrame, q: list[str]) -> DataFrame:
    """As _split_nodes, for few nodes: what is known of them goes into expressions, and the driver gets a row for each."""
    known = {r["node"]: r for r in nodes.collect()}
    state = {r["node"]: {"w": r["w"], "dim": r["dim"], "prefix": 0, "before": 0, "split": None} for r in _ranges(points, q).collect() if known[r["node"]]["shards"] > 1}
    for k, n in state.items():
        n["want"] = n["w"] * (known[k]["shards"] // 2) / known[k]["shards"]
    for bits in range(2 * _BITS, 0, -_BINS_BITS):
        todo, left = {k: n for k, n in state.items() if n["split"] is None}, bits - _BINS_BITS
        if not todo:
            break
        of = lambda what, todo=todo: F.element_at(F.create_map(*[F.lit(x) for k, n in todo.items() for x in (k, n[what])]), F.col("node").cast("int"))
        here = points.filter(F.col("node").isin(list(todo))).select("node", "__w", F.get(F.array(*q), of("dim")).alias("q"))
        here = here.filter(F.shiftright("q", bits) == of("prefix"))
        found = {r["node"]: r["b"] for r in _first_over(here, left, of("before"), of("want")).collect()}
        for k, n in todo.items():
            if (b := found.get(k)) is None:
                n["split"] = (n["prefix"] + 1) << bits
                continue
            before = b["upto"] - b["in"]
            if left == 0 or b["in"] <= _CLOSE * n["w"]:
                n["split"] = (b["bin"] + (abs(b["upto"] - n["want"]) < abs(before - n["want"]))) << left  # the last bin goes where it fits better
            n["prefix"], n["before"] = b["bin"], before
    rows = [(k, r["shards"], r["first"], state[k]["dim"] if k in state else None, state[k]["split"] if k in state else None) for k, r in known.items() if k in state or r["shards"] <= 1]
    return points.sparkSession.createDataFrame(rows, "node long, shards long, first long, dim int, split long").coalesce(1)


def _split_nodes(points: DataFrame, nodes: DataFrame, q: list[str], level: int) -> DataFrame:
    """Nodes (node, shards, first) that have points, with dim and split: a node's points from split on along dim are
    those of its upper half. Null for nodes of one shard."""
    open_ = nodes.filter("shards > 1")
    want = F.col("w") * F.floor(F.col("shards") / 2) / F.col("shards")
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    state = _ranges(points, q).join(open_, "node").select("node", "shards", "first", "w", "dim", want.alias("want"), zero.alias("prefix"), zero.alias("before"), none.alias("split"))
    for bits in range(2 * _BITS, 0, -_BINS_BITS):
        state, left = cut(state), bits - _BINS_BITS
        todo = state.filter("split IS NULL")
        if not todo.limit(1).count():
            break
        sent = _sent(todo.select("node", "dim", "prefix", "before", "want"), level)
        here = points.join(sent, "node").withColumn("q", F.get(F.array(*q), F.col("dim"))).filter(F.shiftright("q", bits) == F.col("prefix"))
        bins = here.groupBy("node", "before", "want", F.shiftright("q", left).alias("bin")).agg(F.sum("__w").alias("in"))
        upto = bins.withColumn("upto", F.col("before") + F.sum("in").over(Window.partitionBy("node").orderBy("bin")))  # 65536 rows at most
        found = upto.groupBy("node").agg(F.min(F.when(F.col("upto") > F.col("want"), F.struct("bin", "in", "upto"))).alias("b"))
        before = F.coalesce(F.col("b.upto") - F.col("b.in"), F.col("before")).cast("long")
        up = (F.abs(F.col("b.upto") - F.col("want")) < F.abs(before - F.col("want"))).cast("long")
        close = (F.col("b.in") <= F.lit(_CLOSE) * F.col("w")) | F.lit(left == 0)
        split = F.when(F.col("b").isNull(), F.shiftleft(F.col("prefix") + 1, bits)).when(close, F.shiftleft(F.col("b.bin") + up, left))
        moved = todo.join(found, "node", "left").select("node", "shards", "first", "w", "dim", "want", F.coalesce("b.bin", "prefix").alias("prefix"), before.alias("before"), split.alias("split"))
        state = state.filter("split IS NOT NULL").unionByName(moved)
    return state.select("node", "shards", "first", "dim", "split").unionByName(nodes.filter("shards <= 1").select("node", "shards", "first", F.lit(None).cast("int").alias("dim"), none.alias("split")))
