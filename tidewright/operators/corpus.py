"""Operators over document tables: inventory, search, samples, incremental extraction, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.functions import text as tx


def search(docs: DataFrame, key: list[str], text: str, pattern: str, **options) -> DataFrame:
    """key, line_no, text: hits per document. The cap per document is taken inside the row, without a shuffle."""
    return docs.select(*key, F.inline(tx.hits(text, pattern, **options)))


def search_summary(docs: DataFrame, text: str, pattern: str, **options) -> DataFrame:
    """One row: documents scanned and matched, and hits after the cap per document."""
    n = F.size(tx.hits(text, pattern, **options))
    counted = docs.select(F.coalesce(F.when(n > 0, n), F.lit(0)).alias("n"))
    return counted.agg(F.count("*").alias("scanned"), F.count_if(F.col("n") > 0).alias("matched"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("total_hits"))


def errors(docs: DataFrame, key: str = "path", error: str = "error") -> DataFrame:
    """key, error of the documents that couldn't be read, by key."""
    return docs.filter(F.col(error).isNotNull()).select(key, error).orderBy(key)


def first_documents(docs: DataFrame, path: str, most: int) -> DataFrame:
    """The first documents by path. The reference order is that of a directory; a path order is the same on every run."""
    return docs.orderBy(path).limit(most)


def inventory(docs: DataFrame, path: Column, parsers: DataFrame, none: str = "(no extension)") -> DataFrame:
    """ext, n, description: counts by extension, the most frequent first, ties by extension. parsers has a row per extension known."""
    ext = tx.extension(path)
    counts = docs.groupBy(F.when(ext == "", F.lit(none)).otherwise(ext).alias("ext")).agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(parsers), "ext", "left").select("ext", "n", "description", F.col("description").isNotNull().alias("supported")).orderBy(F.desc("n"), "ext")


def parser_table(parsers: DataFrame) -> DataFrame:
    """description, exts: the extensions of each kind of document."""
    return parsers.groupBy("description").agg(F.array_sort(F.collect_list("ext")).alias("exts"))


def sample_per_group(docs: DataFrame, group: str, key: str, most: int, seed: str) -> DataFrame:
    """At most `most` rows of each group, the same for the same seed. Spark keeps only the first rows of each group before the shuffle."""
    order = F.md5(F.concat(F.col(key).cast("string"), F.lit(":" + seed)))
    return docs.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(order, key))).filter(F.col("rank") <= most)


def group_report(docs: DataFrame, group: str, ok: Column, chars: Column) -> DataFrame:
    """group, n, ok, avg_chars: whole characters per readable document."""
    good = F.count_if(ok)
    total = F.coalesce(F.sum(F.when(ok, chars)), F.lit(0))
    return docs.groupBy(group).agg(F.count("*").alias("n"), good.alias("ok"), F.when(good > 0, F.floor(total / good)).otherwise(0).cast("bigint").alias("avg_chars"))


def content_key(path: Column, size: Column, modified: Column, version: Column) -> Column:
    """What an extracted text is cached under. The parser's version is part of it, so an upgrade serves no old text."""
    return F.sha1(F.concat_ws("|", path, size.cast("string"), modified.cast("string"), version).cast("binary"))


def not_cached(files: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """The files whose key the cache lacks."""
    return files.join(cache.select(key), key, "left_anti")


def with_cache(files: DataFrame, cache: DataFrame, extract, key: str = "key") -> DataFrame:
    """What the cache holds for these files, and the others extracted: each file is read once over all runs."""
    held = cache.join(files.select(key), key, "left_semi")
    return held.unionByName(extract(not_cached(files, cache, key)))


def cache_stats(cache: DataFrame, size: str) -> DataFrame:
    return cache.agg(F.count("*").alias("entries"), F.coalesce(F.sum(size), F.lit(0)).cast("bigint").alias("bytes"))
