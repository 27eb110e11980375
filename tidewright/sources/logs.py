"""Line-oriented logs and counter files, by rules that the caller gives."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str, location: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """line, file and, with a pattern of one group, the location in the file's name; a file that doesn't fit has none."""
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.input_file_name().alias("file"))
    if location:
        found = F.regexp_extract("file", location, 1)
        lines = lines.withColumn("location", F.when(found != "", found))
        if keep is not None:
            lines = lines.filter(F.col("location").isin(*keep))
    return lines


def classify(lines: DataFrame, rules: list[tuple[str, str]], literals: list[str] = (), line: str = "line") -> DataFrame:
    """rule, groups: the first rule whose pattern fits, and what its groups hold. Lines without any of the literals are dropped first, as that is cheap."""
    if literals:
        lines = lines.filter(reduce(lambda a, b: a | b, [F.contains(line, F.lit(x)) for x in literals]))
    which, groups = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    for name, pattern in reversed(rules):
        fits = F.col(line).rlike(pattern)
        count = _groups(pattern)
        held = F.array(*[F.regexp_extract(line, pattern, k + 1) for k in range(count)]) if count else F.array().cast("array<string>")
        which, groups = F.when(fits, F.lit(name)).otherwise(which), F.when(fits, held).otherwise(groups)
    return lines.withColumn("rule", which).withColumn("groups", groups)


def _groups(pattern: str) -> int:
    import re

    return re.compile(pattern).groups


def event_list(lines: DataFrame, line: str = "line") -> DataFrame:
    """ts, id, name, valid from "ts id name" lines; comments and empty lines go, and the id may be GLOBAL, which is null."""
    bare = F.trim(F.regexp_replace(line, "#.*$", ""))
    parts = F.split(bare, r"\s+")
    valid = (F.size(parts) == 3) & F.get(parts, F.lit(0)).rlike(r"^\d+$") & F.get(parts, F.lit(1)).rlike(r"^(GLOBAL|\d+)$")
    ts, name = F.when(valid, F.get(parts, F.lit(0)).cast("bigint")), F.when(valid, F.get(parts, F.lit(2)))
    return lines.filter(bare != "").select(ts.alias("ts"), F.when(valid & (F.get(parts, F.lit(1)) != "GLOBAL"), F.get(parts, F.lit(1)).cast("bigint")).alias("id"), name.alias("name"), valid.alias("valid"))


def counter_csv(spark: SparkSession, path: str, ignore: list[str] = ("row_id",)) -> DataFrame:
    """Wide counters with every column a number; what is none counts as 0. Nothing is inferred, so the file is read once."""
    raw = spark.read.csv(path, header=True)
    names = [c for c in raw.columns if c.strip() and not c.startswith("_c") and c not in ignore]
    return raw.select(*[F.coalesce(F.expr(f"try_cast(`{c}` as double)"), F.lit(0.0)).alias(c) for c in names])


def extract_counters(lines: DataFrame, patterns: list[str], name: Column, ts: Column, value: Column) -> DataFrame:
    """ts, value of the lines whose name any of the patterns is found in."""
    return lines.filter(reduce(lambda a, b: a | b, [name.rlike(p) for p in patterns])).select(ts.alias("ts"), value.alias("value"))
