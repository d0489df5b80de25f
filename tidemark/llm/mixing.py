"""Mixing sources to target weights by weighted fair queueing; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import bucket_count, cut, hash_bucket, offsets, shielded, shuffle_key, word_count

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = MOST_REPEATS) -> DataFrame:
    """Targets of sources(src, src_null, source_size) whose sum is the sum of all sizes.

    Sources in order of code point, null last, weigh as in weights, again and again. A source fills at the virtual time
    repeats * source_size / weight; the time at which all that flowed equals the budget follows from running sums in
    that order, so excess of full sources goes to the others by weight. Adds weight, target, v_end (that time).
    """
    order = Window.orderBy("src_null", "src")
    by_cap = Window.orderBy("fill", "src_null", "src").rowsBetween(Window.unboundedPreceding, -1)
    ranked = sources.withColumn("src_rank", F.row_number().over(order) - 1)
    pick = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("src_rank") % len(weights) + 1).cast("int"))
    timed = (
        ranked.withColumn("weight", pick.cast("long"))
        .withColumn("fill", F.lit(repeats) * F.col("source_size") / F.col("weight"))
        .withColumn("full_before", F.coalesce(F.sum(F.lit(repeats) * F.col("source_size")).over(by_cap), F.lit(0)))
        .withColumn("weight_before", F.coalesce(F.sum("weight").over(by_cap), F.lit(0)))
        .crossJoin(F.broadcast(ranked.agg(F.sum("source_size").alias("budget"))))  # one row
        .crossJoin(F.broadcast(ranked.agg(F.sum(pick.cast("long")).alias("weights"))))  # one row
        .withColumn("v", (F.col("budget") - F.col("full_before")) / (F.col("weights") - F.col("weight_before")))
    )
    # The first source, in order of fill, that isn't full at its v tells when the budget is spent.
    end = timed.agg(F.coalesce(F.max(F.when(F.col("v") <= F.col("fill"), F.col("v"))), F.max("fill")).alias("v_end"))
    return timed.crossJoin(F.broadcast(end)).select(  # one row
        "src", "src_null", "src_rank", "weight", "source_size", "budget", "v_end",
        F.least(F.lit(repeats) * F.col("source_size").cast("double"), F.col("weight") * F.col("v_end")).alias("target"),
    )


@shielded
def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    repeats: int = MOST_REPEATS,
    keep: list[str] | None = None,
) -> DataFrame:
    """Columns of keep (all by default) and __size, __source_size, __target, __taken, __copies for each row.

    Each source's documents queue in a random order that depends on the ids only, up to repeats times over. The
    running words of the queue divided by the source's weight are a document's virtual finish time. All finish times
    in order, cut off where the words reach the budget (the words of all documents), are the mix: a document is taken
    as often as its finish times lie before the cut.

    Nulls: a null text has size 0, a null source is a source of its own, a null id shuffles as one value. Repeated rows
    queue one by one. Documents without words have nothing to take and 1 copy. An empty table gives no rows.

    No group lands in one task: a source's queue is dealt to buckets by its shuffle key, with running sums over bucket
    totals, and the cut is found in a histogram of finish times and then within one bin of it.
    """
    spark = docs.sparkSession
    keep = docs.columns if keep is None else keep
    wide = docs.select(
        *[F.col(f"`{c}`") for c in keep],
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("__src"),
        F.col(source_col).isNull().alias("__src_null"),
        word_count(F.col(text_col)).alias("__size"),
        shuffle_key(F.col(id_col)).alias("__key"),
    )
    narrow = cut(wide.select("__src", "__src_null", "__size", "__key"))
    buckets = bucket_count(narrow.count())
    wide, narrow = (d.withColumn("__bucket", hash_bucket(F.col("__key"), buckets)) for d in (wide, narrow))

    totals = narrow.groupBy("__src", "__src_null", "__bucket").agg(F.sum("__size").alias("bucket_size"))
    sources = totals.groupBy(F.col("__src").alias("src"), F.col("__src_null").alias("src_null")).agg(F.sum("bucket_size").alias("source_size"))
    targets = source_targets(sources, weights, repeats)
    starts = offsets(totals, ["__src", "__src_null"], "__bucket", "bucket_size", "__before")
    starts = cut(
        starts.join(targets, (F.col("__src") == F.col("src")) & (F.col("__src_null") == F.col("src_null")))
        .select("__src", "__src_null", "__bucket", "__before", F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), F.col("weight").alias("__weight"), F.col("src_rank").alias("__rank"), F.col("budget").alias("__budget"), F.col("v_end").alias("__v_end"))
    )

    in_queue = Window.partitionBy("__src", "__src_null", "__bucket").orderBy("__key", "__size").rowsBetween(Window.unboundedPreceding, 0)

    def queued(rows: DataFrame) -> DataFrame:
        return rows.join(starts.hint("shuffle_merge"), ["__src", "__src_null", "__bucket"]).withColumn("__cum", F.col("__before") + F.sum("__size").over(in_queue))

    def finish(epoch: int):
        return (F.lit(epoch) * F.col("__source_size") + F.col("__cum")) / F.col("__weight")

    head = starts.select("__budget", "__v_end").first()
    budget, v_end = (head["__budget"], head["__v_end"]) if head else (0, 0.0)
    last = None
    if budget:
        bins = F.floor(F.col("finish") / F.lit(v_end) * F.lit(4 * buckets)).cast("long")
        items = queued(narrow.filter("__size > 0")).select(
            "__size", "__rank", "__cum", F.explode(F.array(*[F.struct(finish(e).alias("finish"), F.lit(e).alias("epoch")) for e in range(repeats)])).alias("i")
        ).select("__size", "__rank", "__cum", "i.finish", "i.epoch").withColumn("bin", bins)
        items = cut(items.filter(F.col("finish") >= F.lit(v_end * 0.5)))
        early = narrow_taken_before(queued(narrow.filter("__size > 0")), finish, repeats, v_end * 0.5)
        per_bin = items.groupBy("bin").agg(F.sum("__size").alias("words"))
        # Bins are few (a fixed number for each bucket of documents): the first one that passes the budget.
        running = per_bin.withColumn("upto", F.sum("words").over(Window.orderBy("bin")) + F.lit(early))
        over = running.filter(F.col("upto") > F.lit(budget)).orderBy("bin").select("bin", (F.col("upto") - F.col("words")).alias("before")).first()
        if over is not None:
            order = Window.orderBy("finish", "__rank", "__cum", "epoch")
            inside = items.filter(F.col("bin") == F.lit(over["bin"])).withColumn("upto", F.sum("__size").over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.lit(over["before"]))
            first_out = inside.filter(F.col("upto") > F.lit(budget)).orderBy("finish", "__rank", "__cum", "epoch").select("finish", "__rank", "__cum").first()
            last = (first_out["finish"], first_out["__rank"], first_out["__cum"])

    def taken(epoch: int):
        if last is None:
            return F.lit(1 if budget else 0)
        f = finish(epoch)
        before = (f < F.lit(last[0])) | ((f == F.lit(last[0])) & ((F.col("__rank") < last[1]) | ((F.col("__rank") == last[1]) & (F.col("__cum") < last[2]))))
        return F.when(before, 1).otherwise(0)

    copies = sum((taken(e) for e in range(1, repeats)), taken(0))
    out = queued(wide).withColumn("__copies", F.when(F.col("__size") == 0, F.lit(1)).otherwise(copies).cast("int"))
    return out.select(*[F.col(f"`{c}`") for c in keep], "__size", "__source_size", F.col("__target"), (F.col("__size") * F.col("__copies")).cast("long").alias("__taken"), "__copies")


def narrow_taken_before(queue: DataFrame, finish, repeats: int, limit: float) -> int:
    """Words of all queue entries that finish before limit."""
    words = sum((F.when(finish(e) < F.lit(limit), F.col("__size")).otherwise(0) for e in range(1, repeats)), F.when(finish(0) < F.lit(limit), F.col("__size")).otherwise(0))
    return queue.agg(F.coalesce(F.sum(words), F.lit(0)).alias("n")).first()["n"]
