"""Streaming forms of the series and state operators. Each key's state is a few numbers, kept by Spark's state store."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewright.operators.state import MODULUS, PRIORITY, Semaphore


def changes(points: DataFrame, by: str = "series", order: str = "event_id") -> DataFrame:
    """Points that differ from the one emitted before, over all batches; within a batch in the order of (ts, order).

    What comes later than points already seen is taken as it comes: order across batches is the source's.
    """
    schema = f"{by} {dict(points.dtypes)[by]}, ts bigint, {order} {dict(points.dtypes)[order]}, value double"

    def step(key: tuple, groups: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known, last = (True, state.get[0]) if state.exists else (False, None)
        rows = pd.concat(list(groups)).sort_values(["ts", order], kind="stable")
        before = rows["value"].shift(1)
        new = rows["value"].ne(before)
        if len(rows):
            new.iloc[0] = not known or last is None or rows["value"].iloc[0] != last
            state.update((float(rows["value"].iloc[-1]),))
        yield rows.loc[new, [by, "ts", order, "value"]]

    return points.select(by, "ts", order, "value").groupBy(by).applyInPandasWithState(step, schema, "last double", "append", GroupStateTimeout.NoTimeout)


def semaphore_states(ops: DataFrame, by: str, modulus: int = MODULUS) -> DataFrame:
    """by, ts, count, limit, done, error after every operation; once a key has failed it tells nothing more."""
    schema = f"{by} {dict(ops.dtypes)[by]}, ts bigint, count int, limit int, done int, error string"

    def step(key: tuple, groups: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        machine = Semaphore(modulus)
        if state.exists:
            machine.count, machine.limit, machine.done, failed = state.get
            if failed:
                return
        rows = pd.concat(list(groups))
        rows = rows.assign(prio=rows["kind"].map(PRIORITY)).dropna(subset=["prio"]).sort_values(["ts", "prio", "seq"], kind="stable")
        clean = lambda v: None if pd.isna(v) else int(v)
        out = []
        for r in rows.itertuples():
            machine.apply(r.kind, clean(r.data), clean(r.more))
            out.append((key[0], int(r.ts), machine.count, machine.limit, machine.done, machine.error))
            if machine.error:
                break
        state.update((machine.count, machine.limit, machine.done, int(machine.error is not None)))
        yield pd.DataFrame(out, columns=[by, "ts", "count", "limit", "done", "error"])

    return ops.groupBy(by).applyInPandasWithState(step, schema, "count int, limit int, done int, failed int", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, ts: str, kind: str, width: str, late: str) -> DataFrame:
    """kind, start, n per time window; a window is told once the watermark has passed it, so what comes later than `late` is left out."""
    counted = events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), kind).agg(F.count("*").alias("n"))
    return counted.select(kind, F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, ts: str, key: str, gap: str, late: str) -> DataFrame:
    """key, start, end, n: runs of events with no pause as long as the gap."""
    counted = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return counted.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
