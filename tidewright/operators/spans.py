"""Operators that turn ordered events into intervals and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _islands(events: DataFrame, by: list[str], order: list[str], opens: Column) -> DataFrame:
    """island: a number per group that rises with every row that opens a new one."""
    w = Window.partitionBy(*by).orderBy(*order)
    return events.withColumn("_opens", F.coalesce(opens.cast("int"), F.lit(1))).withColumn("island", F.sum("_opens").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_opens")


def merge_adjacent(events: DataFrame, by: list[str], order: list[str], *, extra: str | None = None, last: str | None = None) -> DataFrame:
    """start, end of runs in which each event starts where the one before ends. The first `extra` stays, and the last `last` that isn't null.

    With the type and its extra among `by`, events of other kinds may lie between.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    cut = _islands(events, by, order, F.lag("end").over(w) != F.col("start"))
    place = F.struct(*order)
    what = [F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n")]
    if extra:
        what.append(F.min_by(extra, place).alias(extra))
    if last:
        what.append(F.max_by(last, F.when(F.col(last).isNotNull(), place)).alias(last))
    return cut.groupBy(*by, "island").agg(*what).drop("island")


def merge_runs(events: DataFrame, by: list[str], kind: str, ts: str, order: list[str]) -> DataFrame:
    """kind, start, end, n: runs of one kind, whatever the gaps; a run ends one tick after its last event."""
    w = Window.partitionBy(*by).orderBy(*order)
    cut = _islands(events, by, order, F.lag(kind).over(w) != F.col(kind))
    return cut.groupBy(*by, "island", kind).agg(F.min(ts).alias("start"), (F.max(ts) + 1).alias("end"), F.count("*").alias("n")).drop("island")


def pair_open_close(events: DataFrame, by: list[str], kind: str, ts: str, open_kind: str, close_kind: str) -> DataFrame:
    """start, end, valid: valid only if there is exactly one opening, at most one closing, and it isn't earlier."""
    opened, closed = F.count_if(F.col(kind) == open_kind), F.count_if(F.col(kind) == close_kind)
    start, end = F.min(F.when(F.col(kind) == open_kind, F.col(ts))), F.max(F.when(F.col(kind) == close_kind, F.col(ts)))
    grouped = events.filter(F.col(kind).isin(open_kind, close_kind)).groupBy(*by).agg(start.alias("start"), end.alias("end"), opened.alias("opened"), closed.alias("closed"))
    return grouped.withColumn("valid", F.coalesce((F.col("opened") == 1) & (F.col("closed") <= 1) & (F.col("end").isNull() | (F.col("end") >= F.col("start"))), F.lit(False)))


def first_per_key(events: DataFrame, key: list[str], primary: Column, order: list[str]) -> DataFrame:
    """All primary rows, and of the others those whose key no row before them has."""
    n = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return events.withColumn("_n", n).withColumn("_keep", primary | (F.col("_n") == 1)).filter("_keep").drop("_n", "_keep")


def stretch_waits(waits: DataFrame, steps: DataFrame, by: list[str], op: str, missing: int = 1000) -> DataFrame:
    """waits with their end at the first start of the step numbered exactly one higher, or `missing` ticks on if there is none.

    Only where that lies after the start; a gap in the numbers counts as missing, so this is a join and no lead().
    """
    following = steps.groupBy(*by, (F.col(op) - 1).alias(op)).agg(F.min("start").alias("_next"))
    end = F.coalesce(F.col("_next"), F.col("start") + missing)
    return waits.join(following, [*by, op], "left").withColumn("end", F.when(end > F.col("start"), end).otherwise(F.col("end"))).drop("_next")


def infer_end(tasks: DataFrame, events: DataFrame, key: str) -> DataFrame:
    """Tasks without an end take the latest end of their events."""
    latest = events.groupBy(key).agg(F.max("end").alias("_latest"))
    return tasks.join(latest, key, "left").withColumn("end", F.coalesce("end", "_latest")).drop("_latest")


def running_count(events: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """ordinal: from 0, how many events of the group came before."""
    return events.withColumn("ordinal", F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)


def count_steps(events: DataFrame, by: list[str], ts: str, order: list[str], first: int | Column) -> DataFrame:
    """by, ts, value: the running count as a step series that stands at 0 from the first instant."""
    steps = running_count(events, by, order).select(*by, F.col(ts).alias("ts"), (F.col("ordinal") + 1).cast("bigint").alias("value"))
    start = first if isinstance(first, Column) else F.lit(first)
    return events.select(*by).distinct().select(*by, start.alias("ts"), F.lit(0).cast("bigint").alias("value")).union(steps)


def state_intervals(states: DataFrame, by: list[str], ts: str, order: list[str], until: Column) -> DataFrame:
    """start, end of each state: until the next one, the last until its owner ends."""
    following = F.lead(ts).over(Window.partitionBy(*by).orderBy(*order))
    return states.withColumn("start", F.col(ts)).withColumn("end", F.coalesce(following, until))


def relative(points: DataFrame, by: list[str], value: str, name: str = "offset") -> DataFrame:
    """value less the group's least. The minima combine before the shuffle and join back."""
    least = points.groupBy(*by).agg(F.min(value).alias("_least"))
    return points.join(least, by).withColumn(name, F.col(value) - F.col("_least")).drop("_least")


def slices(spans: DataFrame) -> DataFrame:
    """kind, ts per packet: an interval without length is an instant, any other begins and ends."""
    instant = F.col("end").isNull() | (F.col("end") == F.col("start"))
    begin, end = F.struct(F.lit("begin").alias("kind"), F.col("start").alias("ts")), F.struct(F.lit("end").alias("kind"), F.col("end").alias("ts"))
    packets = F.when(instant, F.array(F.struct(F.lit("instant").alias("kind"), F.col("start").alias("ts")))).otherwise(F.array(begin, end))
    rest = [c for c in spans.columns if c not in ("start", "end")]
    return spans.select(*rest, F.inline(packets))


def drop_incomplete(ops: DataFrame, task: str, complete: Column, keep: Column) -> tuple[DataFrame, DataFrame]:
    """Ops that are complete or to be kept anyway, and the tasks that are left with none."""
    marked = ops.withColumn("_ok", F.coalesce(complete, F.lit(False)) | F.coalesce(keep, F.lit(False)))
    empty = marked.groupBy(task).agg(F.bool_or("_ok").alias("_any")).filter("not _any").select(task)
    return marked.filter("_ok").drop("_ok"), empty


def stretch_to_done(events: DataFrame, by: list[str], kind: str, ts: str, wait: str, done: str) -> DataFrame:
    """by, start, end: a wait lasts until its own done; without one it has no length."""
    start, end = F.min(F.when(F.col(kind) == wait, F.col(ts))), F.min(F.when(F.col(kind) == done, F.col(ts)))
    grouped = events.filter(F.col(kind).isin(wait, done)).groupBy(*by).agg(start.alias("start"), end.alias("_done"))
    return grouped.filter("start is not null").select(*by, "start", F.greatest("start", F.coalesce("_done", "start")).alias("end"))
