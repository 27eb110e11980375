"""Conditions that a table has to fulfil, checked in the pass that reads it anyway.

A fatal condition stops the job at the first row that breaks it. A counted one is told after the pass, by Spark's observed metrics, with some of
the rows' names. Neither reads the table a second time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


class Broken(ValueError):
    """A condition that didn't hold."""


def fatal(df: DataFrame, holds: Column, message: Column | str) -> DataFrame:
    """df; a row for which the condition is false or null ends the job with the message."""
    said = F.lit(message) if isinstance(message, str) else message
    return df.filter(F.when(F.coalesce(holds, F.lit(False)), F.lit(True)).otherwise(F.raise_error(said).cast("boolean")))


def unique(df: DataFrame, name: str, keep: Sequence[str] = ()) -> DataFrame:
    """name and the columns to keep, a row each; a name that occurs twice ends the job and is told. The count rides on the grouping that makes the names distinct."""
    held = df.groupBy(name).agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in keep])
    said = F.concat(F.lit(f"{name} isn't unique: "), F.coalesce(F.col(name).cast("string"), F.lit("null")), F.lit(" occurs "), F.col("_n"), F.lit(" times"))
    return fatal(held, F.col("_n") == 1, said).select(name, *keep)


class Counted:
    """Conditions of which is counted how many rows break them, while df is used for something else.

    The counts are there after the first action on `df`; told() waits for it.
    """

    def __init__(self, df: DataFrame, conditions: dict[str, Column], name: str | None = None):
        self.conditions = list(conditions)
        self.seen = Observation()
        said = F.lit(None).cast("string") if name is None else F.col(name).cast("string")
        counts = []
        for k, holds in enumerate(conditions.values()):
            broken = ~F.coalesce(holds, F.lit(False))
            counts += [F.count_if(broken).alias(f"n{k}"), F.min(F.when(broken, said)).alias(f"low{k}"), F.max(F.when(broken, said)).alias(f"high{k}")]
        self.df = df.observe(self.seen, *counts)

    def told(self) -> dict[str, tuple[int, str | None, str | None]]:
        """Of each condition how many rows break it, and the least and the greatest of their names."""
        got = self.seen.get
        return {c: (got[f"n{k}"], got[f"low{k}"], got[f"high{k}"]) for k, c in enumerate(self.conditions)}

    def enforce(self) -> None:
        """An error with all conditions that don't hold."""
        wrong = [f"{c}: {n} rows, from {low} to {high}" for c, (n, low, high) in self.told().items() if n]
        if wrong:
            raise Broken("; ".join(wrong))
