"""Results per file that merge: a file is reduced to a small state, and states are merged in any grouping.

A state is a table with a row per key and a column per rule. A rule tells how rows become a value, how values of several states become
one, and what is shown of it. Merging is associative and commutative, as every rule orders by values and never by arrival; so a tree of merges, or
one run over all files, gives the same. Both steps are aggregations that combine before their shuffle.

Lists grow with their key, so a key has to hold a slice of time as well (sliced, cut): a row then holds what falls into one slice.

Store keeps a state in a folder as runs: each fold writes one, and as soon as a level has `fan` runs these are merged into one of the next
level. A file is rewritten once a level, and a reader merges at most `fan` runs a level. What counts is the last manifest that was
written to its end, so a fold that fails leaves nothing.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators import staging


@dataclass(frozen=True)
class Rule:
    """A column of a state: an aggregate over rows, an aggregate over values of this column, and what is shown of a value."""

    name: str
    of_rows: Column
    of_states: Column
    shown: Column


def lowest(name: str, value: Column) -> Rule:
    return Rule(name, F.min(value), F.min(name), F.col(name))


def highest(name: str, value: Column) -> Rule:
    return Rule(name, F.max(value), F.max(name), F.col(name))


def total(name: str, value: Column) -> Rule:
    return Rule(name, F.sum(value), F.sum(name), F.col(name))


def later(name: str, value: Column, source: Column) -> Rule:
    """The value of the latest source, also if it is null; of equal sources the greatest."""
    return Rule(name, F.max(F.struct(source.alias("source"), value.alias("value"))), F.max(name), F.col(f"{name}.value"))


def listed(name: str, *columns: Column) -> Rule:
    """All rows as a list of structs in the order of their fields."""
    return Rule(name, F.array_sort(F.collect_list(F.struct(*columns))), F.array_sort(F.flatten(F.collect_list(name))), F.col(name))


def covered(name: str, start: Column, end: Column) -> Rule:
    """What the intervals [start, end) cover, as disjoint intervals in order that don't touch."""
    pairs = F.collect_list(F.when(start < end, F.struct(start.alias("start"), end.alias("end"))))
    return Rule(name, _united(pairs), _united(F.flatten(F.collect_list(name))), F.col(name))


def _united(intervals: Column) -> Column:
    """Sorted intervals, each joined to the one before if it touches it."""

    def add(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        return F.when(x["start"] <= last["end"], F.concat(F.slice(done, 1, F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(x)))

    ordered = F.array_sort(intervals)
    return F.when(F.size(ordered) > 0, F.aggregate(F.slice(ordered, 2, F.greatest(F.size(ordered) - 1, F.lit(0))), F.slice(ordered, 1, 1), add)).otherwise(ordered)


def sliced(rows: DataFrame, ts: str, width: int, name: str = "slice") -> DataFrame:
    """rows with the slice of time that a point lies in."""
    return rows.withColumn(name, F.floor(F.col(ts) / width).cast("bigint"))


def cut(rows: DataFrame, start: str, end: str, width: int, name: str = "slice") -> DataFrame:
    """Intervals parted where a slice ends, a row for each slice; one without length stays in its slice."""
    first, last = F.floor(F.col(start) / width), F.floor(F.greatest(F.col(end) - 1, F.col(start)) / width)
    out = rows.withColumn(name, F.explode(F.sequence(first.cast("bigint"), last.cast("bigint"))))
    return out.withColumns({start: F.greatest(F.col(start), F.col(name) * width), end: F.least(F.col(end), (F.col(name) + 1) * width)})


def state_of(rows: DataFrame, by: Sequence[str], rules: Sequence[Rule]) -> DataFrame:
    """The state of one file."""
    return rows.groupBy(*by).agg(*[r.of_rows.alias(r.name) for r in rules])


def merged(states: Sequence[DataFrame], by: Sequence[str], rules: Sequence[Rule]) -> DataFrame:
    """One state of several."""
    every = reduce(DataFrame.unionByName, states)
    return every.groupBy(*by).agg(*[r.of_states.alias(r.name) for r in rules])


def result(state: DataFrame, by: Sequence[str], rules: Sequence[Rule]) -> DataFrame:
    return state.select(*by, *[r.shown.alias(r.name) for r in rules])


class Store:
    """A state in a folder, into which files are folded one by one."""

    def __init__(self, spark: SparkSession, path: str, by: Sequence[str], rules: Sequence[Rule], fan: int = 8):
        self.spark, self.path, self.by, self.rules, self.fan = spark, path.rstrip("/"), list(by), list(rules), fan

    def _manifest(self) -> tuple[int, list[dict]]:
        """The number of the last manifest that is complete, and its runs."""
        done = [n for n in staging.names(self.spark, f"{self.path}/manifest") if n.isdigit() and staging.exists(self.spark, f"{self.path}/manifest/{n}/_SUCCESS")]
        if not done:
            return 0, []
        last = max(map(int, done))
        return last, json.loads("".join(r.value for r in self.spark.read.text(f"{self.path}/manifest/{last}").collect()))

    def _commit(self, number: int, runs: list[dict]) -> None:
        # A folder that is there already belongs to another writer, and this fails.
        self.spark.createDataFrame([(json.dumps(runs),)], "value string").coalesce(1).write.text(f"{self.path}/manifest/{number}")

    def _run(self, level: int, state: DataFrame, sources: DataFrame) -> dict:
        name = uuid.uuid4().hex
        state.write.parquet(f"{self.path}/runs/{name}/state")
        sources.coalesce(1).write.parquet(f"{self.path}/runs/{name}/sources")
        return {"name": name, "level": level}

    def _read(self, run: dict, part: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/runs/{run['name']}/{part}")

    def sources(self) -> DataFrame:
        """source: what has been folded."""
        runs = self._manifest()[1]
        empty = self.spark.createDataFrame([], "source string")
        return reduce(DataFrame.union, [self._read(r, "sources") for r in runs], empty)

    def fold(self, rows: DataFrame, source: str) -> None:
        """The rows of one more file. A source that is there already is an error, as its rows would count twice."""
        if self.sources().filter(F.col("source") == source).limit(1).count():
            raise ValueError(f"{source} has been folded already")
        number, runs = self._manifest()
        runs.append(self._run(0, state_of(rows, self.by, self.rules), self.spark.createDataFrame([(source,)], "source string")))
        level = 0
        while len(full := [r for r in runs if r["level"] == level]) >= self.fan:
            state = merged([self._read(r, "state") for r in full], self.by, self.rules)
            sources = reduce(DataFrame.union, [self._read(r, "sources") for r in full])
            runs = [r for r in runs if r["level"] != level] + [self._run(level + 1, state, sources)]
            level += 1
        self._commit(number + 1, runs)

    def state(self) -> DataFrame:
        runs = self._manifest()[1]
        if not runs:
            raise ValueError("nothing has been folded")
        return merged([self._read(r, "state") for r in runs], self.by, self.rules)

    def result(self) -> DataFrame:
        return result(self.state(), self.by, self.rules)

    def clean(self) -> int:
        """Delete runs that the last manifest doesn't name; how many. Not while another reads an older state."""
        held = {r["name"] for r in self._manifest()[1]}
        left = [n for n in staging.names(self.spark, f"{self.path}/runs") if n not in held]
        for name in left:
            files, where = staging.at(self.spark, f"{self.path}/runs/{name}")
            files.delete(where, True)
        return len(left)
