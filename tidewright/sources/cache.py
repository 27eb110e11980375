"""Texts of parsed files kept between runs.

The key holds a file's path, size and time and the parser's version, so what changed is parsed anew. A run looks its files up by their
listing alone: only those that the store lacks are opened. What it parses is written as a folder of its own and named last, so a run that fails
leaves nothing that others would read. A file that can't be parsed is told and tried again by the next run.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators import corpus, staging
from tidewright.sources import files, folders

STORED = files.PARSED + ", key string"
#: Keys that a lookup may broadcast, 40 bytes each.
BROADCAST_KEYS = 500_000


def stored(spark: SparkSession, path: str) -> DataFrame:
    """What all runs have parsed, and the run; a damaged file of the store counts as nothing."""
    runs = [n for n in staging.names(spark, path) if n.startswith("run=")]
    if not runs:
        return spark.createDataFrame([], STORED + ", run string")
    return spark.read.schema(STORED + ", run string").option("basePath", path).option("ignoreCorruptFiles", "true").parquet(*[f"{path}/{n}" for n in runs]).filter("error is null")


def extract(listed: DataFrame, path: str, most: int = files.MOST_BYTES, version: str = files.VERSION) -> DataFrame:
    """Every listed file parsed, from the store where it has it. Two runs that parse a file at the same time both store it; one of the two is read."""
    spark = listed.sparkSession
    wanted = staging.staged(files.keyed(listed, version), "listed")
    held = stored(spark, path)
    # A lookup reads keys alone. One run answers for a key.
    known = staging.staged(held.join(wanted.select("key"), "key", "left_semi").groupBy("key").agg(F.min("run").alias("run")), "known")
    small = F.broadcast(known) if known.count() <= BROADCAST_KEYS else known
    left = folders.dealt(wanted.join(small, "key", "left_anti"))
    name = uuid.uuid4().hex
    files.extract(folders.opened(left, most)).write.parquet(f"{path}/_{name}")
    store, where = staging.at(spark, f"{path}/_{name}")
    if not store.rename(where, staging.at(spark, f"{path}/run={name}")[1]):
        raise OSError(f"{path}: the run couldn't be named")
    fresh = spark.read.schema(STORED).parquet(f"{path}/run={name}")
    return held.join(small, ["key", "run"], "left_semi").drop("run").unionByName(fresh).drop("key")


def stats(spark: SparkSession, path: str) -> DataFrame:
    """entries, bytes: distinct keys, and the bytes of all their texts."""
    once = stored(spark, path).groupBy("key").agg(F.min(F.octet_length("text")).alias("size"))
    return corpus.cache_stats(once, "size")


def clear(spark: SparkSession, path: str) -> int:
    """Remove all runs; gives their number. Folders that aren't of a store stay."""
    runs = [n for n in staging.names(spark, path) if n.startswith(("run=", "_"))]
    for n in runs:
        store, where = staging.at(spark, f"{path}/{n}")
        store.delete(where, True)
    return sum(n.startswith("run=") for n in runs)
