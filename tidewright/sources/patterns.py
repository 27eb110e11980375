"""Many patterns over many lines in one scan.

Each pattern that a match can't do without some literal is filed under it (required). One automaton over all literals reads a line once and tells which
patterns are worth trying; only these are tried. So a line costs its length and its candidates, however many patterns there are.
Patterns without a literal are tried on every line; loose() tells them, so that their number can be kept small.

Patterns belong to kinds, and each kind is a cascade of its own: of a kind among `first` a line gets the first pattern that matches, in the order of
rank and name, of any other kind all that match. What one kind finds doesn't hide a line from the others.
The scan is narrow: no line moves, and the table of patterns is broadcast, with a bound on its size. A larger table isn't broadcast (scan_table): the places of a line that
have the form of a literal are joined with the literals, and a line meets its candidates alone.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache
from re import _constants as codes
from re import _parser as parser

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.operators import staging

#: Characters of all patterns together that go to every task.
MOST = 16 << 20
#: Literals shorter than this don't sort out enough lines to be worth an entry.
SHORTEST = 2
#: Forms of literals that go to every task, and the letters at either end that tell a form, as many as that number allows.
SHAPES, ENDS = 20_000, (8, 4, 2, 1, 0)

FOUND = "array<struct<kind:string,name:string,groups:array<string>>>"


@dataclass(frozen=True)
class Pattern:
    """A regular expression that has to match from the start of a line, or with whole=False be found anywhere in it."""

    kind: str
    name: str
    expression: str
    rank: int = 0
    whole: bool = True
    _compiled: re.Pattern = field(init=False, repr=False, compare=False)

    def __post_init__(self) -> None:
        try:
            object.__setattr__(self, "_compiled", re.compile(self.expression))
        except re.error as error:
            raise ValueError(f"pattern {self.name} of {self.kind}: {error}") from None

    def groups_in(self, line: str) -> list[str | None] | None:
        found = self._compiled.match(line) if self.whole else self._compiled.search(line)
        return None if found is None else list(found.groups())


def required(expression: str) -> str | None:
    """The longest literal that every match of the expression holds; None if none is certain."""
    tree = parser.parse(expression)
    if tree.state.flags & re.IGNORECASE:
        return None
    best, run = "", []

    def close() -> None:
        nonlocal best, run
        best, run = max(best, "".join(run), key=len), []

    def walk(parts: Sequence) -> None:
        for op, what in parts:
            if op is codes.LITERAL:
                run.append(chr(what))
            elif op is codes.AT:
                continue
            elif op is codes.SUBPATTERN and not what[1] and not what[2]:
                walk(what[3])
            elif op in (codes.MAX_REPEAT, codes.MIN_REPEAT, codes.POSSESSIVE_REPEAT) and what[0] > 0:
                # Its first round joins what stands before; what follows joins no longer.
                walk(what[2])
                close()
            else:
                close()

    walk(tree)
    close()
    return best if len(best) >= SHORTEST else None


def loose(patterns: Sequence[Pattern]) -> list[Pattern]:
    """The patterns that have to be tried on every line."""
    return [p for p in patterns if required(p.expression) is None]


def matcher(patterns: Sequence[Pattern], first: Sequence[str] = ()) -> Callable[[str], list[tuple[str, str, list[str | None]]]]:
    """A function from a line to (kind, name, groups) of what matches, by kind, rank and name."""
    order = sorted(patterns, key=lambda p: (p.kind, p.rank, p.name, p.expression))
    filed: dict[str, list[int]] = {}
    always = []
    for k, p in enumerate(order):
        literal = required(p.expression)
        if literal is None:
            always.append(k)
        else:
            filed.setdefault(literal, []).append(k)
    index = ahocorasick.Automaton()
    for literal, which in filed.items():
        index.add_word(literal, which)
    if filed:
        index.make_automaton()
    once = set(first)

    def find(line: str) -> list[tuple[str, str, list[str | None]]]:
        worth = set(always)
        if filed:
            for _, which in index.iter(line):
                worth.update(which)
        out, done = [], set()
        for k in sorted(worth):
            p = order[k]
            if p.kind in done:
                continue
            groups = p.groups_in(line)
            if groups is not None:
                out.append((p.kind, p.name, groups))
                if p.kind in once:
                    done.add(p.kind)
        return out

    return find


def _size(rows: DataFrame) -> int:
    return rows.agg(F.sum(F.length("expression"))).first()[0] or 0


def table_of(rows: DataFrame) -> list[Pattern]:
    """The patterns of a table with kind, name, expression and perhaps rank and whole. Its size is checked before it comes to the driver."""
    if (size := _size(rows)) > MOST:
        raise ValueError(f"{size} characters of patterns are more than {MOST}")
    more = [c for c in ("rank", "whole") if c in rows.columns]
    return [Pattern(**r.asDict()) for r in rows.select("kind", "name", "expression", *more).collect()]


def scan(lines: DataFrame, patterns: Sequence[Pattern], first: Sequence[str] = (), line: str = "line", found: str = "found") -> DataFrame:
    """lines with what was found in each, an array of kind, name and groups. Null lines hold nothing."""
    if (size := sum(len(p.expression) for p in patterns)) > MOST:
        raise ValueError(f"{size} characters of patterns are more than {MOST}")
    held = lines.sparkSession.sparkContext.broadcast((list(patterns), tuple(first)))
    place = lines.columns.index(line)
    schema = lines.select("*", F.lit(None).cast(FOUND).alias(found)).schema
    kind = pa.list_(pa.struct([("kind", pa.string()), ("name", pa.string()), ("groups", pa.list_(pa.string()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = matcher(*held.value)
        for batch in batches:
            got = [[] if x is None else [dict(zip(("kind", "name", "groups"), f, strict=True)) for f in find(x)] for x in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, kind)], names=[*batch.schema.names, found])

    return lines.mapInArrow(run, schema)


def scan_table(lines: DataFrame, table: DataFrame, first: Sequence[str] = (), line: str = "line", found: str = "found", most: int = MOST) -> DataFrame:
    """As scan(), with the patterns of a table (as in table_of) of any size; more than `most` characters of them stay in Spark."""
    if _size(table) <= min(most, MOST):
        return scan(lines, table_of(table), first, line, found)
    filed = staging.staged(_filed(table), "patterns-filed")
    number = "_line"
    while number in lines.columns:
        number += "_"
    numbered = staging.staged(lines.withColumn(number, F.monotonically_increasing_id()), "patterns-lines")
    told = F.struct("kind", "name", "expression", "rank", "whole").alias("p")
    # Python's share is large for the bytes, so it is dealt by count, not by size.
    parts = 4 * lines.sparkSession.sparkContext.defaultParallelism
    texts = numbered.select(F.col(number).alias("at"), F.col(line).alias("text")).repartition(parts)
    places = staging.staged(_places(texts, _shapes(filed)), "patterns-places")
    met = _met(places, filed.withColumnRenamed("literal", "piece")).select("at", told)
    always = filed.filter("literal is null")
    if _size(always) <= min(most, MOST):
        loose_ones = table_of(always)
    else:
        loose_ones, met = [], met.union(numbered.select(F.col(number).alias("at")).crossJoin(always.select(told)))
    # A line and its candidates meet by runs of lines, since neighbours often need the same patterns, and these are compiled once a task.
    row = F.struct(*[F.col(c) for c in lines.columns])
    rows = numbered.select(F.col(number).alias("at"), row.alias("row")).withColumn("p", F.lit(None).cast(met.schema["p"].dataType))
    both = rows.unionByName(met, allowMissingColumns=True).withColumn("run", F.shiftright("at", 13)).repartition(parts, "run")
    tried = both.groupBy("run", "at").agg(F.first("row", ignorenulls=True).alias("row"), F.collect_list("p").alias("_tried"))
    return _tried(tried.select("row.*", "_tried"), loose_ones, first, line, found)


def _met(places: DataFrame, filed: DataFrame) -> DataFrame:
    """places with the patterns that are filed under them. What stands at more than a thousandth of all places is met by broadcast, so no key is one task's work."""
    often = staging.staged(places.groupBy("piece").count().filter(F.col("count") > places.count() // 1000).select("piece"), "patterns-often")
    hot = filed.join(F.broadcast(often), "piece", "left_semi")
    rare = places.join(F.broadcast(often), "piece", "left_anti").join(filed, "piece")
    return rare.unionByName(places.join(F.broadcast(hot) if _size(hot) <= MOST else hot, "piece"))


def _filed(table: DataFrame) -> DataFrame:
    """kind, name, expression, rank, whole and the literal of every pattern; one that can't be compiled ends the job."""
    rank = F.col("rank").cast("int") if "rank" in table.columns else F.lit(0)
    whole = F.col("whole") if "whole" in table.columns else F.lit(True)
    rows = table.select("kind", "name", "expression", rank.alias("rank"), whole.alias("whole"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [required(Pattern(**r).expression) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.string())], names=[*batch.schema.names, "literal"])

    parts = 4 * table.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(parts).mapInArrow(run, rows.select("*", F.lit(None).cast("string").alias("literal")).schema)


def _shapes(filed: DataFrame) -> list[tuple[str, int, str]]:
    """Beginning, length and end of the literals, each form once. Without letters at the ends only the lengths are told."""
    for n in ENDS:
        of = filed.filter("literal is not null").select(F.left("literal", F.lit(n)), F.length("literal"), F.right("literal", F.lit(n))).distinct()
        got = of.limit(SHAPES + 1).collect() if n else of.collect()
        if len(got) <= SHAPES or not n:
            return [tuple(r) for r in got]
    return []


def _places(texts: DataFrame, shapes: Sequence[tuple[str, int, str]]) -> DataFrame:
    """at, piece: of each text the distinct pieces that have the form of a literal."""
    held = texts.sparkSession.sparkContext.broadcast(list(shapes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads: dict[int, dict[str, list[tuple[int, str]]]] = {}
        for head, n, tail in held.value:
            heads.setdefault(len(head), {}).setdefault(head, []).append((n, tail))
        for batch in batches:
            rows, pieces = [], []
            for number, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if text is None:
                    continue
                seen = set()
                for width, forms in heads.items():
                    for k in range(len(text) - width + 1):
                        for n, tail in forms.get(text[k : k + width], ()):
                            if text.endswith(tail, k, k + n) and k + n <= len(text):
                                seen.add(text[k : k + n])
                rows += [number] * len(seen)
                pieces += seen
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(pieces, pa.string())], names=["at", "piece"])

    return texts.mapInArrow(run, "at bigint, piece string")


@lru_cache(1 << 16)
def _compiled(*fields: str | int | bool) -> Pattern:
    return Pattern(*fields)


def _cascade(candidates: Sequence[dict], loose_ones: Sequence[Pattern], first: Sequence[str], line: str) -> list[dict]:
    """What matcher() finds in a line whose candidates are known."""
    order = [_compiled(c["kind"], c["name"], c["expression"], c["rank"], c["whole"]) for c in candidates] + list(loose_ones)
    out, done = [], set()
    for p in sorted(order, key=lambda p: (p.kind, p.rank, p.name, p.expression)):
        groups = None if p.kind in done else p.groups_in(line)
        if groups is not None:
            out.append({"kind": p.kind, "name": p.name, "groups": groups})
            done |= {p.kind} & set(first)
    return out


def _tried(lines: DataFrame, loose_ones: Sequence[Pattern], first: Sequence[str], line: str, found: str) -> DataFrame:
    """lines with what their candidates in the last column find, which takes that column's place."""
    held = lines.sparkSession.sparkContext.broadcast((list(loose_ones), tuple(first)))
    place = lines.columns.index(line)
    schema = lines.select(*lines.columns[:-1], F.lit(None).cast(FOUND).alias(found)).schema
    kind = pa.list_(pa.struct([("kind", pa.string()), ("name", pa.string()), ("groups", pa.list_(pa.string()))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        more, once = held.value
        for batch in batches:
            both = zip(batch.column(place).to_pylist(), batch.columns[-1].to_pylist(), strict=True)
            got = [[] if x is None else _cascade(c or (), more, once, x) for x, c in both]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(got, kind)], names=[*batch.schema.names[:-1], found])

    return lines.mapInArrow(run, schema)


def of_kind(scanned: DataFrame, kind: str, found: str = "found") -> DataFrame:
    """A row for each find of a kind: the line's columns, name and groups."""
    mine = F.filter(found, lambda f: f["kind"] == kind)
    rest = [c for c in scanned.columns if c != found]
    return scanned.select(*rest, F.explode(mine).alias("_f")).select(*rest, F.col("_f.name").alias("name"), F.col("_f.groups").alias("groups"))


def group(k: int) -> Column:
    """The k-th group of a find, from 1 on, or null."""
    return F.get("groups", F.lit(k - 1))
