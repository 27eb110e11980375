"""Counting semaphores: a state machine per key, in the order of time and priority.

A key isn't one task. All operations are sorted by ranges over the cluster and cut into slices. What a slice makes of any state that it may begin in
is a table of a few hundred numbers, its transition function; functions are composed in a tree, which gives the state that each slice begins in, and then every
slice runs by itself. The limit isn't part of the tables: what it is at a slice's begin is the last one set before.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewright.operators import staging

#: At the same instant settings come first and waits last.
PRIORITY = {"set": 0, "limit": 0, "signal": 1, "wait": 100}
#: The count wraps at this number.
MODULUS = 64
#: Operations of a slice, and functions composed at once.
SLICE, FAN = 4096, 64

SCHEMA = "ts bigint, count int, limit int, done int, error string"


class Semaphore:
    """count rises with signals; at the limit it is done and the count falls by the limit; a wait takes done back."""

    def __init__(self, modulus: int = MODULUS, checked: bool = False):
        """checked: before its first setting a semaphore isn't valid, and a signal or a wait is an error."""
        self.modulus, self.count, self.limit, self.done, self.error, self.valid = modulus, 0, 0, 0, None, not checked

    def apply(self, kind: str, data: int | None, more: int | None) -> None:
        if not self.valid and kind in ("signal", "wait"):
            self.error = f"a {kind} before set"
            return
        self.valid = self.valid or kind == "set"
        if kind == "signal":
            self.count = (self.count + 1) % self.modulus
        elif kind == "set":
            self.count, self.limit = (data or 0) % self.modulus, more or 0
            self.done = 0
        elif kind == "limit":
            self.limit = data or 0
        elif kind == "wait":
            if not self.done:
                self.error = "a wait before done"
                return
            self.done = 0
        if not self.done and self.count and self.limit and self.count >= self.limit:
            self.done, self.count = 1, self.count - self.limit


def samples(rows: Iterator[tuple[int, str, int | None, int | None]], modulus: int = MODULUS, state: Semaphore | None = None) -> list[tuple]:
    """(ts, count, limit, done, error) per instant, the last of each. After an error nothing more is told."""
    state, out = state or Semaphore(modulus), []
    for ts, kind, data, more in rows:
        state.apply(kind, data, more)
        row = (ts, state.count, state.limit, state.done, state.error)
        if out and out[-1][0] == ts:
            out[-1] = row
        else:
            out.append(row)
        if state.error:
            break
    return out


class Transition:
    """What a run of operations makes of every state at once. A state's number is (valid * 2 + done) * modulus + count; the last number stands for an error."""

    def __init__(self, limit: int, modulus: int = MODULUS):
        every = np.arange(4 * modulus)
        self.modulus, self.limit = modulus, limit
        self.count, self.done, self.valid, self.failed = every % modulus, every // modulus % 2, every // (2 * modulus), np.zeros(4 * modulus, bool)

    def apply(self, kind: str, data: int | None, more: int | None) -> None:
        live = ~self.failed
        if kind in ("signal", "wait"):
            self.failed |= live & ((self.valid == 0) | ((self.done == 0) & (kind == "wait")))
            live = ~self.failed
        if kind == "signal":
            self.count[live] = (self.count[live] + 1) % self.modulus
        elif kind == "set":
            self.count[live], self.done[live], self.valid[live], self.limit = (data or 0) % self.modulus, 0, 1, more or 0
        elif kind == "limit":
            self.limit = data or 0
        else:
            self.done[live] = 0
        reached = live & (self.done == 0) & (self.count > 0) & (self.count >= self.limit) & (self.limit > 0)
        self.done[reached] = 1
        self.count[reached] -= self.limit

    def table(self) -> list[int]:
        number = (self.valid * 2 + self.done) * self.modulus + self.count
        return [*np.where(self.failed, 4 * self.modulus, number).tolist(), 4 * self.modulus]


def _number(modulus: int, checked: bool) -> int:
    """The state that a key begins in."""
    return 0 if checked else 2 * modulus


def _at(number: int, limit: int, modulus: int) -> Semaphore:
    state = Semaphore(modulus, checked=number < 2 * modulus)
    state.count, state.done, state.limit = number % modulus, number // modulus % 2, limit
    return state


OPS = "part int, k int, whole boolean, first bigint, last bigint, set_to bigint, ts array<bigint>, kind array<string>, data array<bigint>, more array<bigint>"


def slices_of(ops: DataFrame, by: Sequence[str], rows: int = SLICE) -> DataFrame:
    """by and OPS: each key's operations in order, in slices of bounded length. A slice is whole if its key has no other."""
    rank = F.create_map(*[F.lit(x) for pair in PRIORITY.items() for x in pair])
    ordered = ops.withColumn("prio", rank[F.col("kind")]).filter("prio is not null").select(*by, *[F.col(c).cast("bigint") for c in ("ts", "prio", "seq")], "kind", *[F.col(c).cast("bigint") for c in ("data", "more")])
    order = [F.col(c).asc_nulls_first() for c in (*by, "ts", "prio", "seq", "kind", "data", "more")]
    ordered = ordered.repartitionByRange(*order).sortWithinPartitions(*order)
    keys, width = ordered.select(*by).schema, len(by)
    names = [*by, *(c.split()[0] for c in OPS.split(", "))]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in keys) + ", " + OPS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, key, held, cut, runs, done, types = TaskContext.get().partitionId(), 0, None, [], False, 0, [], None

        def close(more: bool, end: bool) -> None:
            # The first and the last key of a partition may go on in others.
            nonlocal k, held, cut
            columns = list(zip(*held, strict=True))
            limits = [m or 0 if kind == "set" else d or 0 for _, kind, d, m in held if kind in ("set", "limit")]
            whole = not more and not cut and not end and runs > 1
            done.append((*key, part, k, whole, held[0][0], held[-1][0], limits[-1] if limits else None, *map(list, columns)))
            k, held, cut = k + 1, [], more

        def table() -> pa.RecordBatch:
            kinds = [*types, pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], names=names)

        for batch in batches:
            types = [f.type for f in batch.schema][:width]
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if runs == 0 or row[:width] != key:
                    if held:
                        close(False, False)
                    key, cut, runs = row[:width], False, runs + 1
                elif len(held) >= rows:
                    close(True, False)
                held.append((row[width], *row[width + 3 :]))
            if done:
                yield table()
                done.clear()
        if held:
            close(False, True)
            yield table()

    return ordered.mapInArrow(run, schema)


def starts(functions: DataFrame, by: Sequence[str], first: int, fan: int = FAN) -> DataFrame:
    """by, rank, start: the state before each function, from by, rank (from 0 on), f (an array). Groups of `fan` functions become one, level by level."""
    group = functions.withColumn("_group", F.floor(F.col("rank") / fan)).groupBy(*by, "_group").agg(F.sort_array(F.collect_list(F.struct("rank", "f"))).alias("_fs"))
    through = lambda f, state: F.element_at(f, state + 1)
    if functions.filter(F.col("rank") >= fan).limit(1).count():
        one = F.aggregate(F.slice("_fs", 2, F.size("_fs")), F.col("_fs")[0]["f"], lambda f, then: F.transform(f, lambda x: through(then["f"], x)))
        above = starts(staging.staged(group.select(*by, F.col("_group").alias("rank"), one.alias("f")), "functions"), by, first, fan)
        above = above.select(*[F.col(c).alias(f"_{c}") for c in by], F.col("rank").alias("_of"), F.col("start"))
        group = group.join(above, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by] + [F.col("_group") == F.col("_of")])
    else:
        group = group.withColumn("start", F.lit(first))
    every = F.aggregate("_fs", F.array("start"), lambda done, then: F.concat(done, F.array(through(then["f"], F.element_at(done, -1)))))
    return group.select(*by, (F.col("_group") * fan).alias("_base"), F.posexplode(F.slice(every, 1, F.size("_fs"))).alias("_at", "start")).select(*by, (F.col("_base") + F.col("_at")).alias("rank"), "start")


def semaphore_states(ops: DataFrame, by: Sequence[str], modulus: int = MODULUS, checked: bool = False, rows: int = SLICE, fan: int = FAN) -> DataFrame:
    """by, ts, count, limit, done, error from ops (by, ts, seq, kind, data, more). An error ends only its own key's states."""
    slices = staging.staged(slices_of(ops, by, rows), "slices")
    order = Window.partitionBy(*by).orderBy("part", "k")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    cut = slices.filter("not whole").select("*", F.coalesce(F.last("set_to", ignorenulls=True).over(before), F.lit(0)).alias("limit"), F.lead("first").over(order).alias("next"), (F.row_number().over(order) - 1).cast("bigint").alias("rank"))
    cut = staging.staged(cut, "slices-cut")

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for limit, kinds, data, more in zip(*[batch.column(c).to_pylist() for c in ("limit", "kind", "data", "more")], strict=True):
                all_states = Transition(limit, modulus)
                for op in zip(kinds, data, more, strict=True):
                    all_states.apply(*op)
                out.append(all_states.table())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in by], batch.column("rank"), pa.array(out, pa.list_(pa.int32()))], names=[*by, "rank", "f"])

    keys = ", ".join(f"{c} {t}" for c, t in slices.select(*by).dtypes)
    functions = staging.staged(cut.select(*by, "rank", "limit", "kind", "data", "more").mapInArrow(tables, f"{keys}, rank bigint, f array<int>"), "functions")
    begin = starts(functions, by, _number(modulus, checked), fan).select(*[F.col(c).alias(f"_{c}") for c in by], F.col("rank").alias("_rank"), "start")
    cut = cut.join(begin, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by] + [F.col("rank") == F.col("_rank")])
    whole = slices.filter("whole").withColumns({"limit": F.lit(0).cast("bigint"), "next": F.lit(None).cast("bigint"), "start": F.lit(_number(modulus, checked))})
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
    own = [*by, "limit", "next", "start", "ts", "kind", "data", "more"]

    def play(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, out = [], []
            for k, (limit, following, start, *lists) in enumerate(zip(*[batch.column(c).to_pylist() for c in own[len(by) :]], strict=True)):
                if start == 4 * modulus:
                    continue
                got = samples(zip(*lists, strict=True), modulus, _at(start, limit, modulus))
                # An instant that goes on in the next slice is told there.
                if got[-1][0] == following and not got[-1][4]:
                    got.pop()
                of += [k] * len(got)
                out += got
            columns = list(zip(*out, strict=True)) or [[]] * len(names)
            place = pa.array(of, pa.int32())
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(place) for c in by], *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], names=[*by, *names])

    return whole.select(*own).union(cut.select(*own)).mapInArrow(play, f"{keys}, {SCHEMA}")


def wait_mask(ops: DataFrame, mask: str, ids: range, name: str = "sem") -> DataFrame:
    """Operations with a mask as one row per semaphore whose bit is set, the lowest bit for the first of ids; without a mask the row's own semaphore stays."""
    chosen = F.filter(F.array(*[F.lit(i) for i in ids]), lambda i: F.call_function("shiftright", F.col(mask), i - ids.start).bitwiseAND(F.lit(1)) == 1)
    return ops.withColumn(name, F.explode(F.when(F.col(mask).isNull(), F.array(F.col(name).cast("int"))).otherwise(chosen)))


def routed(ops: DataFrame, by: Sequence[str], to: dict[str, str], known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Operations at the key that they act on, and those that name none. A signal with a destination acts there: to gives for columns of `by` the column that holds it.

    known: the keys that exist, as a table of the columns of `to`; without it every named one does.
    """
    away: Column = F.lit(False)
    for target in to.values():
        away = away | F.col(target).isNotNull()
    away = (F.col("kind") == "signal") & away
    moved = ops.withColumns({c: F.when(away, F.coalesce(F.col(target), F.col(c))).otherwise(F.col(c)) for c, target in to.items()})
    if known is None:
        return moved, moved.limit(0)
    there = known.select(*to).distinct().withColumn("_known", F.lit(True))
    marked = moved.withColumn("_away", away).join(there, list(to), "left")
    lost = F.col("_away") & F.col("_known").isNull()
    return marked.filter(~lost).select(moved.columns), marked.filter(lost).select(moved.columns)
