"""Log files whose names tell where their lines come from, and tables that hold for a version.

Names are read when the plan is made: a name that doesn't fit is an error, files of other places are never opened, and what the name tells becomes typed columns.
"""

from __future__ import annotations

import re
from collections.abc import Collection, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewright.operators import guards, staging


def read_located(
    spark: SparkSession, folder: str, pattern: str, types: dict[str, str] | None = None, keep: dict[str, Collection] | None = None, ignore: dict[str, Collection] | None = None,
) -> DataFrame:
    """line, line_no, file and a column for each named group of the pattern, from the files of a folder whose names tell a place that is wanted.

    types: Spark types of groups, string if not named. keep: the values wanted of a group, all if not named. ignore: values that aren't. line_no counts the lines of a file from 1.
    """
    names = [n for n in staging.names(spark, folder) if not n.startswith((".", "_"))]
    form, rows = re.compile(pattern), []
    for name in names:
        found = form.fullmatch(name)
        if not found:
            raise ValueError(f"the name of {folder}/{name} doesn't fit {pattern}")
        told = found.groupdict()
        wanted = all(told[g] in set(map(str, values)) for g, values in (keep or {}).items())
        if wanted and not any(told[g] in set(map(str, values)) for g, values in (ignore or {}).items()):
            rows.append((name, *told.values()))
    groups = list(form.groupindex)
    of = spark.createDataFrame(rows, "file string" + "".join(f", {g} string" for g in groups))
    of = of.select("file", *[F.col(g).cast((types or {}).get(g, "string")).alias(g) for g in groups])
    if not rows:
        return of.select(F.lit("").alias("line"), F.lit(0).cast("bigint").alias("line_no"), "file", *groups).limit(0)
    # A file is a row first, so that its lines can be numbered; the lines of one file are one task's work either way, as text isn't split by an order.
    whole = spark.read.text([f"{folder}/{r[0]}" for r in rows], wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.regexp_replace("value", r"\r?\n$", "").alias("value"))
    lines = whole.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("at", "line")).select("line", (F.col("at") + 1).cast("bigint").alias("line_no"), "file")
    return lines.join(F.broadcast(of), "file").select("line", "line_no", "file", *groups)


def drop_later(lines: DataFrame, by: Sequence[str], order: str, ends: Column) -> DataFrame:
    """The lines of a group up to the first one for which `ends` holds; that one and all later ones go. The first places combine before the shuffle."""
    first = lines.filter(F.coalesce(ends, F.lit(False))).groupBy(*by).agg(F.min(order).alias("_end"))
    first = first.select(*[F.col(c).alias(f"_{c}") for c in by], "_end")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    return lines.join(first, [*same, F.col(order) >= F.col("_end")], "left_anti")


def read_weights(spark: SparkSession, path: str) -> DataFrame:
    """version, kind, counter, inc from JSON lines; a row that lacks one or has another type ends the job and is told."""
    raw = spark.read.text(path)
    row = F.from_json("value", "version bigint, kind string, counter string, inc bigint")
    held = raw.filter(F.trim("value") != "").select(row.alias("r"), "value")
    whole = F.col("r").isNotNull() & F.col("r.version").isNotNull() & F.col("r.kind").isNotNull() & F.col("r.counter").isNotNull() & F.col("r.inc").isNotNull()
    return guards.fatal(held, whole, F.concat(F.lit("not a weight: "), F.col("value"))).select("r.*")


def as_of(weights: DataFrame, key: Sequence[str], version: str = "version") -> DataFrame:
    """weights with the versions that each row holds for: from its own up to, not including, until (null: for ever). A later row of a key takes its place."""
    return weights.withColumn("until", F.lead(version).over(Window.partitionBy(*key).orderBy(version)))


def weighed(rows: DataFrame, weights: DataFrame, key: Sequence[str], version: str = "version", most: int = 100_000) -> DataFrame:
    """rows with the weight that held at their version, null where none did. The weights are a small dimension; more than `most` aren't broadcast."""
    held = as_of(weights, key, version)
    held = held.select(*[F.col(c).alias(f"_{c}") for c in (*key, version)], "until", *[c for c in weights.columns if c not in (*key, version)])
    small = held.limit(most + 1).count() <= most
    same = [F.col(c) == F.col(f"_{c}") for c in key]
    when = (F.col(version) >= F.col(f"_{version}")) & (F.col("until").isNull() | (F.col(version) < F.col("until")))
    return rows.join(F.broadcast(held) if small else held, [*same, when], "left").drop(*[f"_{c}" for c in (*key, version)], "until")
