"""Manifests of files: hashes, parts of bounded size, and what differs from a tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def safe_path(path: Column) -> Column:
    """A relative path below the root: no backslash, no colon, no step that leaves it, not the root itself."""
    steps = F.split(path, "/")
    names = F.filter(steps, lambda s: ~s.isin("", "."))
    # The depth after each step never falls below zero if no prefix has more '..' than names.
    depth = F.aggregate(names, F.struct(F.lit(0).alias("at"), F.lit(0).alias("low")), lambda d, s: F.struct((d.at + F.when(s == "..", -1).otherwise(1)).alias("at"), F.least(d.low, d.at + F.when(s == "..", -1).otherwise(1)).alias("low")))
    return F.coalesce((path != "") & ~path.startswith("/") & ~path.rlike(r"[\\:]") & (depth.low >= 0) & (depth.at > 0), F.lit(False))


def manifest(files: DataFrame, path: str, content: Column) -> DataFrame:
    """path, bytes, sha256 of every file."""
    return files.select(F.col(path).alias("path"), F.octet_length(content).cast("bigint").alias("bytes"), F.sha2(content, 256).alias("sha256"))


def verify(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """path, status: ok, missing, extra, size, hash or duplicate, for every path of either side."""
    side = lambda df, tag: df.groupBy("path").agg(F.count("*").alias(f"{tag}_n"), F.min("bytes").alias(f"{tag}_bytes"), F.min("sha256").alias(f"{tag}_sha"))
    both = side(expected, "e").join(side(actual, "a"), "path", "full")
    status = (
        F.when(F.col("a_n").isNull(), "missing").when(F.col("e_n").isNull(), "extra").when((F.col("e_n") > 1) | (F.col("a_n") > 1), "duplicate")
        .when(~F.col("e_bytes").eqNullSafe(F.col("a_bytes")), "size").when(~F.col("e_sha").eqNullSafe(F.col("a_sha")), "hash").otherwise("ok")
    )
    return both.select("path", status.alias("status"))


def parts(files: DataFrame, limit: int, slice_of: Column) -> DataFrame:
    """path, first_part, last_part: where each file lies in a byte stream cut into parts of at most `limit` bytes.

    Files stand in the order of (slice, path). slice_of must follow that order, so that offsets are summed in two levels.
    """
    cut = files.select("path", "bytes", slice_of.alias("slice"))
    sums = cut.groupBy("slice").agg(F.sum("bytes").alias("own"))
    before = sums.select("slice", F.coalesce(F.sum("own").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inner = Window.partitionBy("slice").orderBy("path").rowsBetween(Window.unboundedPreceding, 0)
    end = F.col("before") + F.sum("bytes").over(inner)
    placed = cut.join(before, "slice").select("path", "bytes", end.alias("end"))
    start = F.col("end") - F.col("bytes")
    return placed.select("path", F.floor(start / limit).cast("bigint").alias("first_part"), F.floor(F.greatest(F.col("end") - 1, start) / limit).cast("bigint").alias("last_part"))


def as_manifest(files: DataFrame, form: str) -> DataFrame:
    """One row: the manifest as JSON, files by path."""
    listed = F.array_sort(F.collect_list(F.struct("path", "bytes", "sha256")))
    return files.agg(F.to_json(F.struct(F.lit(form).alias("format"), listed.alias("files"))).alias("manifest"))


def from_manifest(manifests: DataFrame, column: str = "manifest") -> DataFrame:
    """format, path, bytes, sha256: the files a JSON manifest lists."""
    schema = "format string, files array<struct<path:string,bytes:bigint,sha256:string>>"
    return manifests.select(F.from_json(column, schema).alias("m")).select("m.format", F.inline("m.files"))
