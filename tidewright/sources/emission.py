"""Sorted emission: tables written as files that follow one another in the order of their keys, with an index, and read by range.

Rows are dealt out by ranges of the keys over the whole cluster and sorted within each, so a key with very many rows is spread over many
files; files of a bounded number of rows are cut from that. The index has a row per file: first and last key, rows, bytes, and the bytes of
all files before it, so the files in order are the parts of one stream. A reader takes the files from the index whose range meets what it
wants and opens no other.

A folder holds generations; the index is written last, and a reader takes the last complete one. So a job that fails leaves what was there before.

seal() and damaged() hold the digests of the parts: what is missing, has changed, or doesn't belong there.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.operators import staging

#: Rows of a file, at most.
FILE_ROWS = 1_000_000


def write_sorted(df: DataFrame, path: str, keys: Sequence[str], rows: int = FILE_ROWS, parts: int | None = None) -> DataFrame:
    """Write df in the order of its keys (nulls first) and give the index. parts: ranges to write at once, as many as the session's shuffle partitions if not told."""
    spark, name = df.sparkSession, uuid.uuid4().hex
    order = [F.col(k).asc_nulls_first() for k in keys]
    dealt = df.repartitionByRange(parts, *order) if parts else df.repartitionByRange(*order)
    dealt.sortWithinPartitions(*order).write.option("maxRecordsPerFile", rows).parquet(f"{path}/data/{name}")
    number = max([int(n) for n in staging.names(spark, f"{path}/index") if n.isdigit()], default=0) + 1
    # An empty table has no file and so no row in the index.
    index_of(spark, f"{path}/data/{name}", keys).withColumn("folder", F.lit(name)).coalesce(1).write.parquet(f"{path}/index/{number}")
    return index(spark, path)


def index_of(spark: SparkSession, folder: str, keys: Sequence[str]) -> DataFrame:
    """file, first, last (structs of the keys), rows, bytes, offset of the files of a folder, from one read of the key columns."""
    key = F.struct(*keys)
    found = spark.read.parquet(folder).select(key.alias("key"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_size").alias("size"))
    files = found.groupBy("file").agg(F.min("key").alias("first"), F.max("key").alias("last"), F.count("*").alias("rows"), F.max("size").alias("bytes"))
    before = Window.orderBy("first", "last", "file").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    return files.withColumn("offset", F.coalesce(F.sum("bytes").over(before), F.lit(0)))


def _last(spark: SparkSession, path: str) -> int:
    done = [int(n) for n in staging.names(spark, f"{path}/index") if n.isdigit() and staging.exists(spark, f"{path}/index/{n}/_SUCCESS")]
    if not done:
        raise FileNotFoundError(f"no complete index in {path}")
    return max(done)


def index(spark: SparkSession, path: str) -> DataFrame:
    """The index of the last complete generation."""
    return spark.read.parquet(f"{path}/index/{_last(spark, path)}")


def _bound(values: Sequence | None, names: Sequence[str], side: str, below: bool) -> Column:
    """Whether the key struct `side` is not below (or not above) the values, which may be fewer than the keys."""
    if values is None:
        return F.lit(True)
    have = F.struct(*[F.col(f"{side}.{n}") if side else F.col(n) for n in names[: len(values)]])
    want = F.struct(*[F.lit(v).alias(n) for v, n in zip(values, names, strict=False)])
    return have >= want if below else have <= want


def files_of(spark: SparkSession, path: str, low: Sequence | None = None, high: Sequence | None = None) -> DataFrame:
    """The files whose keys meet [low, high]; a bound may name the first keys alone."""
    every = index(spark, path)
    names = every.schema["first"].dataType.names
    return every.filter(_bound(low, names, "last", True) & _bound(high, names, "first", False))


def read_range(spark: SparkSession, path: str, low: Sequence | None = None, high: Sequence | None = None) -> DataFrame:
    """The rows with keys in [low, high], both ends included, from the files that can hold them. Rows with a null among the bounded keys are below every bound."""
    wanted = files_of(spark, path, low, high).select("folder", "file").orderBy("offset").collect()
    schema_from = index(spark, path).first()
    if schema_from is None:
        raise FileNotFoundError(f"{path} holds no rows")
    if not wanted:
        return spark.read.parquet(f"{path}/data/{schema_from.folder}/{schema_from.file}").limit(0)
    names = index(spark, path).schema["first"].dataType.names
    rows = spark.read.parquet(*[f"{path}/data/{w.folder}/{unquote(w.file)}" for w in wanted])
    # Plain comparisons of the first key as well, which the scan can push down.
    for values, near in ((low, lambda c, v: c >= v), (high, lambda c, v: c <= v)):
        if values is not None and values[0] is not None:
            keep = near(F.col(names[0]), F.lit(values[0]))
            rows = rows.filter(keep if values is low else keep | F.col(names[0]).isNull())
    return rows.filter(_bound(low, names, "", True) & _bound(high, names, "", False))


# --- parts and their digests -----------------------------------------------------------------------------------------


def seal(spark: SparkSession, folder: str) -> DataFrame:
    """path (below the folder), bytes, sha256 of every file that a table or archive consists of. A file has to fit into a task."""
    return _files(spark, folder).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def _files(spark: SparkSession, folder: str) -> DataFrame:
    root = staging.at(spark, folder)
    base = root[0].makeQualified(root[1]).toUri().getPath().rstrip("/") + "/"
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "[!_.]*").load(folder)
    return read.withColumn("path", F.substring_index(F.col("path"), base, -1))


def damaged(spark: SparkSession, folder: str, sealed: DataFrame) -> DataFrame:
    """path, problem of the parts that aren't as they were sealed: missing, size, content, unknown. Contents are read only where the size is right."""
    now = _files(spark, folder)
    sizes = sealed.select("path", F.col("bytes").alias("_bytes"), F.col("sha256").alias("_sha"))
    held = now.select("path", "length").join(sizes, "path", "full").select("path", "length", "_bytes", "_sha")
    problem = F.when(F.col("length").isNull(), "missing").when(F.col("_bytes").isNull(), "unknown").when(F.col("length") != F.col("_bytes"), "size")
    plain = held.withColumn("problem", problem)
    content = now.select("path", F.sha2("content", 256).alias("sha256")).join(plain.filter("problem is null"), "path").filter(F.col("sha256") != F.col("_sha"))
    return plain.filter("problem is not null").select("path", "problem").union(content.select("path", F.lit("content").alias("problem")))
