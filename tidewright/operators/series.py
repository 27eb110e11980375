"""Operators over (series, ts, value) points and wide counter rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def prefix_time(rows: DataFrame, clock: Column, order: list[str], by: list[str]) -> DataFrame:
    """start: the sum of the clock over all earlier rows of the group; a clock that is no number counts as 0."""
    before = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("start", F.coalesce(F.sum(F.coalesce(clock, F.lit(0))).over(before), F.lit(0)))


def global_prefix(rows: DataFrame, value: Column, order: list[str], slice_of: Column, name: str = "before") -> DataFrame:
    """The sum over all earlier rows of the whole table, in two levels.

    slice_of must follow the order and hold a bounded number of rows per slice: a window without a partition would take the table through one task.
    """
    cut = rows.withColumn("_slice", slice_of).withColumn("_v", F.coalesce(value, F.lit(0)))
    sums = cut.groupBy("_slice").agg(F.sum("_v").alias("_own"))
    ahead = sums.select("_slice", F.coalesce(F.sum("_own").over(Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    inner = Window.partitionBy("_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    done = cut.withColumn("_in", F.coalesce(F.sum("_v").over(inner), F.lit(0))).join(ahead, "_slice")
    return done.withColumn(name, F.col("_ahead") + F.col("_in")).drop("_slice", "_v", "_ahead", "_in")


def in_window(points: DataFrame, start: int | None, end: int | None, order: list[str], by: str = "series") -> DataFrame:
    """Points of a time window, its end included. What lies before the start leaves its last point as the baseline."""
    kept = points if end is None else points.filter(F.col("ts") <= end)
    if start is None:
        return kept
    early = kept.filter(F.col("ts") < start).groupBy(by).agg(F.max(F.struct("ts", *[c for c in order if c != "ts"], "value")).alias("p"))
    return kept.filter(F.col("ts") >= start).select(by, "ts", "value").union(early.select(by, "p.ts", "p.value"))


def changes(points: DataFrame, order: list[str], by: str = "series", mode: str = "all") -> DataFrame:
    """Points that differ from the one before.

    mode "all": every repeat goes. "zeros": only repeated zeros go. "none": all stay. A NaN differs from every value, itself included.
    """
    if mode == "none":
        return points
    last = F.lag("value").over(Window.partitionBy(by).orderBy(*order))
    first = F.row_number().over(Window.partitionBy(by).orderBy(*order)) == 1
    marked = points.withColumn("_new", first | F.isnan("value") | ~F.col("value").eqNullSafe(last))
    if mode == "zeros":
        marked = marked.withColumn("_new", F.col("_new") | F.coalesce(F.col("value") != 0, F.lit(False)))
    return marked.filter("_new").drop("_new")


def varying(points: DataFrame, by: str = "series") -> DataFrame:
    """Without series of a single point. The counts combine before the shuffle, so a long series meets in no one task."""
    several = points.groupBy(by).agg(F.count("*").alias("_n")).filter("_n > 1").select(by)
    return points.join(several, by, "left_semi")


def choose(columns: list[str], include: list[str], exclude: list[str], *, none_if_empty: bool = False) -> list[str]:
    """Column names that any include pattern fits from their start (all, where there are none) and no exclude pattern does."""
    fits = lambda name, patterns: any(re.match(p, name) for p in patterns)
    wanted = columns if not include and not none_if_empty else [c for c in columns if fits(c, include)]
    return [c for c in wanted if not fits(c, exclude)]


def row_stat(columns: list[str], pattern: str, kind: str) -> Column | None:
    """sum, mean, min or max over the columns of a row whose names fit; None where none fits."""
    cols = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns if re.match(pattern, c)]
    if not cols:
        return None
    total = cols[0]
    for c in cols[1:]:
        total = total + c
    least, most = (cols[0], cols[0]) if len(cols) == 1 else (F.least(*cols), F.greatest(*cols))
    return {"sum": total, "mean": total / len(cols), "min": least, "max": most}[kind]


_TOKEN = re.compile(r"\s*(?:(?P<number>\d+\.?\d*(?:[eE][+-]?\d+)?)|(?P<name>[A-Za-z_][A-Za-z0-9_.]*)|(?P<op>\*\*|//|[-+*/%(),]))")
_CALLS = {
    "abs": lambda a: F.abs(a), "sqrt": lambda a: F.sqrt(a), "log": lambda a: F.log(a), "exp": lambda a: F.exp(a), "floor": lambda a: F.floor(a), "ceil": lambda a: F.ceil(a), "round": lambda a: F.bround(a, 0),
    "min": lambda *a: F.least(*a), "max": lambda *a: F.greatest(*a), "sum": lambda *a: sum(a[1:], a[0]), "avg": lambda *a: sum(a[1:], a[0]) / len(a), "pow": lambda a, b: F.pow(a, b),
}


def expression(text: str, columns: list[str]) -> Column:
    """Arithmetic over columns, parsed against a list of functions; nothing is evaluated as code.

    A name is the longest run of letters, digits, dots and underscores, so "a.b" is never read as "a".
    """
    tokens, at = [], 0
    while at < len(text.rstrip()):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"not understood at {at}: {text}")
        tokens.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    tokens.append(("end", ""))
    place = 0

    def take(value: str | None = None) -> tuple[str, str]:
        nonlocal place
        kind, got = tokens[place]
        if value is not None and got != value:
            raise ValueError(f"{value} expected, found {got or 'the end'}: {text}")
        place += 1
        return kind, got

    def several(below, ops: dict) -> Column:
        left = below()
        while tokens[place][0] == "op" and tokens[place][1] in ops:
            left = ops[take()[1]](left, below())
        return left

    def add() -> Column:
        return several(multiply, {"+": lambda a, b: a + b, "-": lambda a, b: a - b})

    def multiply() -> Column:
        ops = {"*": lambda a, b: a * b, "/": lambda a, b: F.try_divide(a, b), "//": lambda a, b: F.floor(F.try_divide(a, b)), "%": lambda a, b: F.when(b != 0, F.pmod(a, b))}
        return several(signed, ops)

    def signed() -> Column:
        if tokens[place][1] in ("-", "+"):
            return -signed() if take()[1] == "-" else signed()
        base = atom()
        if tokens[place][1] == "**":
            take()
            return F.pow(base, signed())
        return base

    def atom() -> Column:
        kind, got = take()
        if kind == "number":
            return F.lit(float(got))
        if got == "(":
            inner = add()
            take(")")
            return inner
        if kind == "name" and tokens[place][1] == "(":
            name = got.removeprefix("math.")
            if name not in _CALLS:
                raise ValueError(f"no such function: {got}")
            take("(")
            args = [add()]
            while tokens[place][1] == ",":
                take()
                args.append(add())
            take(")")
            return _CALLS[name](*args)
        if kind == "name" and got in columns:
            return F.coalesce(F.col(f"`{got}`").cast("double"), F.lit(0.0))
        raise ValueError(f"no such counter: {got or 'the end'}")

    out = add()
    take("")
    return out


def counters(wide: DataFrame, defined: list[dict], select: list[str] = (), deselect: list[str] = (), view: str = "default", keep: list[str] = ()) -> DataFrame:
    """Wide rows with the defined counters, in their order; a later one may use an earlier one.

    Patterns choose among the raw columns; defined ones stay. view: default has the raw ones first, defined_first the others, and defined_only has raw ones
    only where a pattern asks for them. Columns to keep come before both.

    A definition has a target and one of alias, regex with op, or expr. One that refers to a counter defined later is an error, and so
    is an alias without its source; all errors are told at once. A regex that fits nothing drops the counter.
    """
    errors, known = [], list(wide.columns)
    raw = list(wide.columns)
    for d in defined:
        try:
            if "alias" in d:
                if d["alias"] not in known:
                    raise ValueError(f"no such counter: {d['alias']}")
                col = F.col(f"`{d['alias']}`")
            elif "regex" in d:
                col = row_stat(known, d["regex"], d["op"])
            else:
                col = expression(d["expr"], known)
        except (ValueError, KeyError) as error:
            errors.append(f"{d.get('target')}: {error}")
            continue
        if col is not None:
            wide = wide.withColumn(d["target"], col)
            known.append(d["target"])
    if errors:
        raise ValueError("; ".join(errors))
    made = list(dict.fromkeys(d["target"] for d in defined if d["target"] in known))
    rest = choose([c for c in raw if c not in made and c not in keep], list(select), list(deselect), none_if_empty=view == "defined_only")
    names = [*keep, *(rest + made if view == "default" else made + rest)]
    return wide.select(*[F.col(f"`{c}`") for c in names])


def to_points(wide: DataFrame, ts: str, columns: list[str], keys: list[str] = ()) -> DataFrame:
    """Wide rows as (series, ts, value); what is no number counts as 0."""
    pairs = F.array(*[F.struct(F.lit(c).alias("series"), F.coalesce(F.expr(f"try_cast(`{c}` as double)"), F.lit(0.0)).alias("value")) for c in columns])
    return wide.select(*keys, F.col(ts).alias("ts"), F.inline(pairs))


def path_tree(keys: DataFrame, key: str = "key") -> DataFrame:
    """path, parent, name, depth, rank: every beginning of a dotted path is a node; siblings are ranked by name."""
    parts = F.split(key, r"\.")
    nodes = keys.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, F.lit(1), n), ".").alias("path"), n.alias("depth")))).alias("n")).select("n.*").distinct()
    nodes = nodes.withColumn("name", F.substring_index("path", ".", -1)).withColumn("parent", F.when(F.col("depth") > 1, F.expr("substring(path, 1, length(path) - length(name) - 1)")))
    return nodes.withColumn("rank", F.row_number().over(Window.partitionBy("parent").orderBy("name")) - 1)
