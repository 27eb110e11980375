"""Tracks: keys of counters and events on one tree, fixed location trees, ids that are the same on every run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def union_keys(counters: DataFrame, events: DataFrame, key: str = "key") -> DataFrame:
    """key, is_counter: every key of either side once; one that both have is a counter."""
    both = counters.select(key, F.lit(True).alias("is_counter")).union(events.select(key, F.lit(False)))
    return both.groupBy(key).agg(F.bool_or("is_counter").alias("is_counter"))


def ranked_kinds(events: DataFrame, by: list[str], kind: str, skip: list[str] = ()) -> DataFrame:
    """by, kind, rank: the kinds that a task has, by name, without those skipped. The distinct combines before the shuffle."""
    kinds = events.select(*by, kind).distinct()
    if skip:
        kinds = kinds.filter(~F.col(kind).isin(*skip))
    return kinds.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(kind)) - 1)


def location_tree(rows: DataFrame, levels: list[str]) -> DataFrame:
    """depth, path, parent, rank: every location and what is above it; siblings are ranked by number.

    All depths come from one pass over the rows, by grouping the beginnings of each location.
    """
    text = lambda n: F.concat_ws("/", *[F.concat(F.lit(f"{name}="), F.col(name).cast("string")) for name in levels[:n]])
    nodes = F.array(*[F.struct(F.lit(n).alias("depth"), text(n).alias("path"), (text(n - 1) if n > 1 else F.lit(None).cast("string")).alias("parent"), F.col(levels[n - 1]).cast("bigint").alias("number")) for n in range(1, len(levels) + 1)])
    found = rows.select(*levels).distinct().select(F.inline(nodes)).distinct()
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("depth", "parent").orderBy("number")) - 1).select("depth", "path", "parent", "rank")


def mixed_rank(digits: list[Column], base: int = 32) -> Column:
    """One number that sorts like the digits, each below the base."""
    total = F.lit(0).cast("bigint")
    for d in digits:
        total = total * base + d
    return total


def track_id(path: Column) -> Column:
    """A positive 63-bit id of a track by its full path."""
    return F.xxhash64(path).bitwiseAND(F.lit((1 << 63) - 1))


def flow_id(base: int, place: Column, local: Column, stride: int = 1 << 24) -> Column:
    """An id within the range of its place; null where the local number doesn't fit the range."""
    return F.when((local >= 0) & (local < stride), F.lit(base) + place * stride + local)


def address_flow(text: Column) -> Column:
    """63 bits of a hexadecimal address of up to 16 digits, as its low digits; null where it is none."""
    bare = F.regexp_replace(F.lower(text), "^0x", "")
    padded = F.lpad(bare, 16, "0")
    high = F.conv(F.substring(padded, 1, 8), 16, 10).cast("bigint").bitwiseAND(0x7FFFFFFF)
    return F.when(bare.rlike("^[0-9a-f]{1,16}$"), F.shiftleft(high, 32).bitwiseOR(F.conv(F.substring(padded, 9, 8), 16, 10).cast("bigint")))
