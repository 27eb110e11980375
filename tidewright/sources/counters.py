"""Definitions of counters from a file: which columns stay, which are made of others, and in which order they come.

A plain file has a pattern a line, with ! before those to leave out and # before remarks. A .json or .yaml file holds `config` with a view and
`stats`, a list of entries with select, deselect, alias and target, stat and regex (and op), or stat and expr. All that is wrong with a file is told at once.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from tidewright.operators import series

# Names of the format.
VIEWS = ("default", "defined_only", "defined_first")
OPS = ("sum", "mean", "min", "max")


@dataclass
class Config:
    select: list[str] = field(default_factory=list)
    deselect: list[str] = field(default_factory=list)
    defined: list[dict] = field(default_factory=list)
    view: str = "default"

    def apply(self, wide: DataFrame, keep: list[str] | tuple = ()) -> DataFrame:
        """wide with the defined counters and the raw ones that are wanted; the columns to keep come first."""
        return series.counters(wide, self.defined, self.select, self.deselect, self.view, keep)


def _plain(text: str) -> tuple[Config, list[str]]:
    lines = [line.strip() for line in text.splitlines()]
    lines = [line for line in lines if line and not line.startswith("#")]
    return Config([x for x in lines if not x.startswith("!")], [x[1:].strip() for x in lines if x.startswith("!")]), []


def _entry(entry: object) -> tuple[str, dict] | str:
    """What an entry is and what it gives, or what is wrong with it."""
    if not isinstance(entry, dict):
        return "not a mapping"
    empty = [k for k in ("select", "deselect", "alias", "target", "stat", "regex", "expr") if k in entry and not isinstance(entry[k], str)]
    if empty:
        return f"{', '.join(empty)} without a value"
    if entry.keys() & {"select", "deselect"}:
        return "patterns", entry
    if "alias" in entry:
        return ("defined", {"target": entry["target"], "alias": entry["alias"]}) if "target" in entry else "an alias without a target"
    if "stat" in entry and "regex" in entry:
        op = entry.get("op", "sum")
        return ("defined", {"target": entry["stat"], "regex": entry["regex"], "op": op}) if op in OPS else f"op {op} isn't one of {', '.join(OPS)}"
    if "stat" in entry and "expr" in entry:
        return "defined", {"target": entry["stat"], "expr": entry["expr"]}
    return "neither a pattern, nor an alias, nor a stat with regex or expr"


def _structured(data: object) -> tuple[Config, list[str]]:
    out, errors = Config(), []
    data = {} if data is None else data
    if not isinstance(data, dict):
        return out, ["not a mapping"]
    out.view = (data.get("config") or {}).get("view", "default")
    if out.view not in VIEWS:
        errors.append(f"config.view: {out.view} isn't one of {', '.join(VIEWS)}")
    stats = data.get("stats") or []
    if not isinstance(stats, list):
        return out, [*errors, "stats: not a list"]
    for k, entry in enumerate(stats):
        got = _entry(entry)
        if isinstance(got, str):
            errors.append(f"stats[{k}]: {got}")
        elif got[0] == "defined":
            out.defined.append(got[1])
        else:
            out.select += [got[1]["select"]] if "select" in got[1] else []
            out.deselect += [got[1]["deselect"]] if "deselect" in got[1] else []
    errors += [f"{name}: defined {n} times" for name, n in Counter(d["target"] for d in out.defined).items() if n > 1]
    return out, errors


def parse_config(text: str, kind: str = "plain") -> Config:
    """A configuration from text of a kind: plain, json or yaml."""
    if kind == "plain":
        out, errors = _plain(text)
    else:
        try:
            if kind == "json":
                data = json.loads(text) if text.strip() else None
            else:
                import yaml  # only where such a file is read

                data = yaml.safe_load(text)
        except ValueError as error:
            raise ValueError(f"not {kind}: {error}") from None
        out, errors = _structured(data)
    for pattern in (*out.select, *out.deselect, *(d["regex"] for d in out.defined if "regex" in d)):
        try:
            re.compile(pattern)
        except re.error as error:
            errors.append(f"{pattern}: {error}")
    if errors:
        raise ValueError("; ".join(errors))
    return out


def read_config(spark: SparkSession, path: str) -> Config:
    """The configuration in a file of any store, by its suffix."""
    text = spark.read.text(path, wholetext=True).first()
    suffix = path.rsplit(".", 1)[-1].lower()
    return parse_config(text[0] if text else "", {"json": "json", "yaml": "yaml", "yml": "yaml"}.get(suffix, "plain"))
