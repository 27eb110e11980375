"""Mixing sources to target weights by weighted fair queueing.

Every source puts its documents in a shuffled order, once and then again, as each document may be used twice. A
document's virtual finish time is what its source has sent up to and with it, divided by the source's target; at
time 1 a source has sent its target. All documents then stand in the order of their finish times, and the mix is the
longest beginning of that order that keeps within the total budget.

Running sums are taken in two levels, so no source and no tie is sorted in one task: within a source, the shuffle's
hash is cut into slices of bounded size whose sums are added up first; in the global order, virtual time is cut
into ranges, which hold about equally many words each, as time runs evenly for every source until time 1. Time after it, which the budget
still reaches where large documents were left out, is folded into as many ranges again.

Null texts and texts without words have size 0 and are never taken. A null source is a source of its own, the last. Repeated rows are documents of
their own. The shuffled order goes by doc_id and text, so rows that share an id or have none are spread; only rows equal in both
stand together. A source without words has target 0. An empty table gives no rows. Sizes come from one regular expression in the JVM,
so texts may be long. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.llm.shared import materialise

#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (3, 1, 2)
#: The mix's words as a share of all words, and how often a document may be used.
SHARE, MOST = 1.5, 2
#: Documents in a slice of a source's shuffled order, about.
SLICE = 1_000
#: Ranges of virtual time until 1, at most; twice as many are added up in one task.
RANGES = 50_000
#: Sources whose table of a row each is broadcast; with more, Spark chooses the join.
BROADCAST_SOURCES = 10_000

# What separates words: blank, tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def words(text: str | Column = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("bigint"), F.lit(0).cast("bigint"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, rows, source_size, target per source, from rows of source and size.

    The excess of sources at their limit goes to the others by weight until none is above: the level L with
    sum(min(limit, L * weight)) = budget. Sources reach their limit in the order of limit / weight, so L is found by
    running sums over the sources, one row each.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("full", F.col("source_size").cast("double") * most)
    order = Window.orderBy(F.col("full") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    budget = F.least(F.sum("source_size").over(every) * share, F.sum("full").over(every))
    left = budget - F.coalesce(F.sum("full").over(before), F.lit(0.0))
    rest = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = left / rest
    # Taking out a source that reaches its limit raises the level, taking out one that doesn't lowers it: L is the largest.
    per = per.withColumn("level", F.max(level).over(every))
    return per.select("source", "rows", "source_size", F.coalesce(F.least("full", F.col("level") * F.col("weight")), "full").alias("target"))


def shuffled(doc_id: str = "doc_id", text: str = "text") -> Column:
    """A place in [0, 2^52) by the digest of id and text, the same in every run and engine."""
    key = F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit(" "), F.coalesce(F.col(text), F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("bigint")


def mix(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, slice_rows: int = SLICE) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: the words of each document that the mix takes, repeats counted."""
    held = materialise(documents.select("doc_id", "source", words().alias("size"), shuffled().alias("place"), F.monotonically_increasing_id().alias("row")), "mix-sizes")
    targets = materialise(source_targets(held, weights, share, most).withColumn("key", _key()), "mix-targets")
    known = targets.agg(F.count("*").alias("sources"), F.sum("rows").alias("rows"), F.sum("source_size").alias("words")).first()
    ranges = min(RANGES, -(-(known.rows or 1) // slice_rows))
    per_source = targets.select("key", "rows", "source_size", "target")
    if known.sources <= BROADCAST_SOURCES:
        per_source = F.broadcast(per_source)

    # Within each source: what stands before a slice, then within the slice.
    held = held.withColumn("key", _key()).join(per_source, "key")
    held = held.withColumn("slice", F.floor(F.col("place") / F.lit(float(1 << 52)) * F.ceil(F.col("rows") / slice_rows)))
    sums = held.groupBy("key", "slice").agg(F.sum("size").alias("own"))
    earlier = Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    before = materialise(sums.select("key", "slice", F.coalesce(F.sum("own").over(earlier), F.lit(0)).alias("before")), "mix-slices")
    inner = Window.partitionBy("key", "slice").orderBy("place", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, 0)
    sent = held.withColumn("within", F.sum("size").over(inner)).join(before, ["key", "slice"])
    sent = materialise(sent.withColumn("sent", F.col("before") + F.col("within")).drop("before", "within", "slice", "rows", "key"), "mix-sent")

    # All uses of all documents by finish time. At time 1 the sources have sent at most the budget.
    finish = F.array(*[(F.col("sent") + F.col("source_size") * k) / F.col("target") for k in range(most)])
    uses = sent.filter("size > 0").select("row", "place", "size", F.explode(finish).alias("finish"))
    time = F.col("finish")
    uses = uses.withColumn("range", F.floor(F.when(time <= 1, time).otherwise(2 - 1 / time) * ranges))
    up_to = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    running = uses.groupBy("range").agg(F.sum("size").alias("own")).select("range", "own", F.sum("own").over(up_to).alias("to"))
    # Earlier ranges than the one that the budget cuts are taken whole, later ones not at all.
    budget = (known.words or 0) * float(min(share, most))
    cut = running.filter(F.col("to") > budget).agg(F.min(F.struct("range", (F.col("to") - F.col("own")).alias("start"))).alias("cut")).first().cut
    taken = uses.select("row", "size")
    if cut is not None:
        order = Window.partitionBy("range").orderBy("finish", "place", "row").rowsBetween(Window.unboundedPreceding, 0)
        last = uses.filter(F.col("range") == cut.range).withColumn("to", F.lit(cut.start) + F.sum("size").over(order))
        taken = uses.filter(F.col("range") < cut.range).select("row", "size").union(last.filter(F.col("to") <= budget).select("row", "size"))
    per_row = taken.groupBy("row").agg(F.sum("size").alias("taken"))
    return sent.join(per_row, "row", "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))


def _key() -> Column:
    """The source as a join key that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
