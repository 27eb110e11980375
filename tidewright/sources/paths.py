"""Lines under a path of any depth, parted in one scan into several typed outputs.

Such a line says "a.b.c: name=value" or "a.b.c: name text", with an instant; how exactly is told by patterns with named groups. Every line gets its
kind and, in one variant column, what belongs to that kind; outputs are then typed views of the same scan, and a sink that is
written by kind reads its input once.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Of a line that no form fits.
REJECT = "reject"


@dataclass(frozen=True)
class Form:
    """A kind of line: a pattern that has to fit the whole line, with named groups. The groups path, name and ts are columns of their own, the others go into the payload.

    types: the Spark types of payload groups, string if not named. A value that its type can't hold makes the line a reject.
    unless: a group and a text; a line whose group holds the text isn't of this kind.
    """

    kind: str
    pattern: str
    types: tuple[tuple[str, str], ...] = ()
    unless: tuple[str, str] | None = None

    def __post_init__(self) -> None:
        names = set(re.compile(self.pattern).groupindex)
        if missing := {"path", "name", "ts"} - names:
            raise ValueError(f"form {self.kind} has no group {', '.join(sorted(missing))}")
        if unknown := {t for t, _ in self.types} - names:
            raise ValueError(f"form {self.kind} has types for {', '.join(sorted(unknown))}")

    def group(self, line: str | Column, name: str) -> Column:
        """A group's text; null where it took no part."""
        java = f"^(?:{self.pattern.replace('(?P<', '(?<')})$"
        found = F.regexp_extract(line, java, re.compile(self.pattern).groupindex[name])
        return F.when(found != "", found)

    def payload(self) -> list[str]:
        return [n for n in re.compile(self.pattern).groupindex if n not in ("path", "name", "ts")]


def parted(lines: DataFrame, forms: Sequence[Form], line: str = "line", separator: str = ".") -> DataFrame:
    """The lines with kind, path, steps (its parts), node (the last), depth, name, ts, payload (a variant). The first form that fits counts."""
    kind, columns = F.lit(REJECT), {c: F.lit(None).cast("string") for c in ("path", "name")} | {"ts": F.lit(None).cast("bigint"), "payload": F.lit(None).cast("variant")}
    for form in reversed(forms):
        types = dict(form.types)
        ts = form.group(line, "ts").try_cast("bigint")
        values = {n: form.group(line, n).try_cast(types.get(n, "string")) for n in form.payload()}
        fits = F.col(line).rlike(f"^(?:{form.pattern.replace('(?P<', '(?<')})$") & ts.isNotNull()
        for n in types:
            fits &= form.group(line, n).isNull() | values[n].isNotNull()
        if form.unless:
            fits &= ~F.coalesce(F.contains(form.group(line, form.unless[0]), F.lit(form.unless[1])), F.lit(False))
        fits = F.coalesce(fits, F.lit(False))
        held = F.to_variant_object(F.struct(*[v.alias(n) for n, v in values.items()])) if values else F.lit(None).cast("variant")
        mine = {"path": form.group(line, "path"), "name": form.group(line, "name"), "ts": ts, "payload": held}
        kind = F.when(fits, F.lit(form.kind)).otherwise(kind)
        columns = {c: F.when(fits, mine[c]).otherwise(v) for c, v in columns.items()}
    out = lines.withColumns({"kind": kind, **columns})
    steps = F.split("path", re.escape(separator))
    return out.withColumns({"steps": steps, "node": F.element_at(steps, -1), "depth": F.size(steps)})


def view(table: DataFrame, form: Form) -> DataFrame:
    """The lines of one form: path, node, name, ts and the payload's fields by their types."""
    types = dict(form.types)
    fields = [F.try_variant_get("payload", f"$.{n}", types.get(n, "string")).alias(n) for n in form.payload()]
    return table.filter(F.col("kind") == form.kind).select("path", "node", "name", "ts", *fields)


def rejects(table: DataFrame, line: str = "line") -> DataFrame:
    return table.filter(F.col("kind") == REJECT).select(line)
