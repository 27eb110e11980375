"""Conversation repair: the cheapest edits that make the roles of a conversation alternate.

Three weighted machines are composed: an acceptor of the conversation's turns, an edit transducer (keep K, rerole R, delete D, insert I)
and an acceptor of the role grammar, nothing or (s?(ua)+) over the roles' first letters. The composition is lazy: a state is a place in the conversation, a
state of the grammar and the number of turns inserted at this place (two suffice, more lead back to a state at a higher cost), and only states
that are reached are made. Their order is topological, and one pass finds the shortest path under lexicographic weights (cost, string of edits).
At one place equal costs never go with strings of which one begins the other, as an insertion costs something; so the order
of two strings stays when both are continued, and minima may be taken early.

A long conversation is cut into chunks, and no task ever holds one whole. All turns are sorted by ranges over the cluster; a chunk has a
weight for each pair of grammar states, and the chunks of a conversation are multiplied in a tree. Then each gets its slice of
the edits, and the digest streams over the chunks in order. Turns that repeat one of an earlier chunk are found by digests, each sent once a chunk.

Turns go by number, nulls first, then by role and digest of the text. A null role or text is one space. A null conv_id is a conversation. A role whose first letter the grammar doesn't know, also an empty one, has
to be changed or deleted; a kept role stays as it is. Equal turns are duplicates after the first. An empty table gives no rows; a conversation whose turns are all gone gets zeros and the digest of nothing. What holds a
conversation's edits in one string grows with it, one character a turn. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from tidewright.llm.shared import _arrow_type, forget, materialise

#: Costs of the edits, and of a truncated turn that stays.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Turns and characters of a chunk, and chunks that one task multiplies.
CHUNK_TURNS, CHUNK_CHARS, FAN = 1024, 4 << 20, 64

#: The grammar: what follows a state by a role's letter. State 0 is the start, 1 after s, 2 after u, 3 after a; 0 and 3 may end.
GRAMMAR = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ENDS = (0, 3)
#: Turns inserted at one place, at most.
LAYERS = 2
#: Labels: in a string of edits the roles that R and I give are told by a second letter, which sorts next to the first.
NAMES = {"u": "user", "a": "assistant"}
RENAMES, INSERTS = {"u": "S", "a": "R"}, {"u": "J", "a": "I"}
_ROLE = {label: NAMES[letter] for labels in (RENAMES, INSERTS) for letter, label in labels.items()}
_SPACE = " \t\n\x0b\x0c\r"

Weight = tuple[int, str]
Weights = dict[int, Weight]

CHUNK = "part int, k int, whole boolean, n int, turns array<bigint>, roles array<string>, texts array<string>, keys array<binary>"
SUMMARY = (
    "n bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, first string, last string, "
    "low bigint, high bigint, steps bigint, paths array<struct<enter:int,leave:int,cost:bigint,edits:string>>, chunks array<struct<part:int,k:int,n:int>>"
)
EDITED = "array<struct<role:string,text:string>>"


# --- one conversation, or a piece of it ------------------------------------------------------------------------------


def fault(text: str, again: bool) -> str:
    """The first fault of a turn: blank, duplicate, truncated or none."""
    end = text.rstrip(_SPACE)[-1:]
    return "blank" if not end else "duplicate" if again else "truncated" if end not in ".!?" else ""


def _arcs(role: str, wrong: str, state: int) -> Iterator[tuple[int, str, int]]:
    """What the edit transducer and the grammar make of one turn: cost, label, next state of the grammar."""
    yield DELETE, "D", state
    if wrong in ("blank", "duplicate"):
        return
    more = TRUNCATED if wrong else 0
    for letter, then in GRAMMAR[state].items():
        if role[:1] == letter:
            yield KEEP + more, "K", then
        if letter in NAMES:
            yield REROLE + more, RENAMES[letter], then


def _lowest(into: Weights, state: int, weight: Weight) -> None:
    if state not in into or weight < into[state]:
        into[state] = weight


def _inserted(reached: Weights) -> Iterator[Weights]:
    """The layers of one place: nothing inserted, one turn, two turns."""
    yield reached
    for _ in range(LAYERS):
        layer: Weights = {}
        for state, (cost, edits) in reached.items():
            for letter, then in GRAMMAR[state].items():
                if letter in NAMES:
                    _lowest(layer, then, (cost + INSERT, edits + INSERTS[letter]))
        reached = layer
        yield reached


def shortest(roles: list[str], faults: list[str], enter: int = 0) -> Weights:
    """The least weight of every state of the grammar that the turns lead to from `enter`, before insertions after the last."""
    reached: Weights = {enter: (0, "")}
    for role, wrong in zip(roles, faults, strict=True):
        after: Weights = {}
        for layer in _inserted(reached):
            for state, (cost, edits) in layer.items():
                for more, label, then in _arcs(role, wrong, state):
                    _lowest(after, then, (cost + more, edits + label))
        reached = after
    return reached


def ended(reached: Weights) -> Weight:
    """The least weight among those that may end, with insertions after the last turn."""
    return min(layer[state] for layer in _inserted(reached) for state in ENDS if state in layer)


def product(a: dict[int, Weights], b: dict[int, Weights]) -> dict[int, Weights]:
    """The weights of two pieces in a row."""
    out: dict[int, Weights] = {}
    for enter, reached in a.items():
        out[enter] = {}
        for state, (cost, edits) in reached.items():
            for leave, (more, then) in b.get(state, {}).items():
                _lowest(out[enter], leave, (cost + more, edits + then))
    return out


def audit_of(edits: str) -> str:
    return edits.translate(str.maketrans("JS", "IR"))


def applied(edits: str, roles: list[str], texts: list[str]) -> list[tuple[str, str]]:
    """The repaired turns."""
    out, at = [], 0
    for label in edits:
        if label in INSERTS.values():
            out.append((_ROLE[label], ""))
            continue
        if label != "D":
            out.append((_ROLE.get(label, roles[at]), texts[at]))
        at += 1
    return out


def slices(edits: str, sizes: list[int]) -> list[str]:
    """The edits of pieces of so many turns; insertions go with the turn before them, those in front with the first piece."""
    out, at = [], 0
    for k, size in enumerate(sizes):
        start = at
        while at < len(edits) and (size or k == len(sizes) - 1 or edits[at] in INSERTS.values()):
            size -= edits[at] not in INSERTS.values()
            at += 1
        out.append(edits[start:at])
    return out


# --- chunks ----------------------------------------------------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone: turns with errors by a checksum of conv_id and turn. A dropped turn stays as one that is gone."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn")).cast("binary")) % 20
    text = F.when(fate == 1, "").when(fate == 2, F.translate(text_of("text"), ".!?", "")).otherwise(text_of("text"))
    out = conversations.select("conv_id", "turn", F.when(fate == 4, "user").otherwise(text_of("role")).alias("role"), text.alias("text"), (fate == 0).alias("gone"), F.when(fate == 3, 2).otherwise(1).alias("times"))
    return out.select("conv_id", "turn", "role", "text", "gone", F.explode(F.array_repeat(F.lit(0), F.col("times")))).drop("col")


def chunks_of(turns: DataFrame, rows: int = CHUNK_TURNS, chars: int = CHUNK_CHARS) -> DataFrame:
    """conv_id and CHUNK: the turns in order, by ranges over the cluster. A chunk is whole if its conversation has no other."""
    gone = F.coalesce(F.col("gone"), F.lit(False)) if "gone" in turns.columns else F.lit(False)
    blank = lambda c: F.coalesce(F.col(c), F.lit(" "))
    turns = turns.select("conv_id", F.col("turn").cast("bigint").alias("turn"), blank("role").alias("role"), blank("text").alias("text"), gone.alias("gone"))
    turns = turns.withColumns({"mark": F.md5(F.col("text").cast("binary")), "at": F.monotonically_increasing_id()})
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "mark", "at")]
    turns = turns.repartitionByRange(*order).sortWithinPartitions(*order).drop("mark", "at")
    kind = pa.int64() if dict(turns.dtypes)["conv_id"] in ("bigint", "int") else pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k, conv, held, size, cut, runs = TaskContext.get().partitionId(), 0, None, [], 0, False, 0
        done: list[tuple] = []

        def close(last: bool, more: bool) -> None:
            # The first and the last conversation of a partition may go on in others.
            nonlocal k, held, size, cut
            whole = not more and not cut and not last and runs > 1
            there = [t for t in held if not t[3]]
            keys = [xxh3_128_digest(f"{conv}:{len(r)}:{r}{t}".encode("utf-8", "surrogatepass")) for _, r, t, _ in there]
            done.append((conv, part, k, whole, len(there), *([t[c] for t in there] for c in range(3)), keys))
            k, held, size, cut = k + 1, [], 0, more

        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for conv_id, *turn in zip(*columns, strict=True):
                if runs == 0 or conv_id != conv:
                    if held:
                        close(False, False)
                    conv, cut, runs = conv_id, False, runs + 1
                elif len(held) >= rows or size >= chars:
                    close(False, True)
                held.append(tuple(turn))
                size += len(turn[2])
            if done:
                yield _table(done, kind)
                done = []
        if held:
            close(True, False)
            yield _table(done, kind)

    return turns.mapInArrow(run, f"conv_id {dict(turns.dtypes)['conv_id']}, {CHUNK}")


def _table(done: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    kinds = [kind, pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.binary())]
    names = ["conv_id", *(c.split()[0] for c in CHUNK.split(", "))]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), kinds, strict=True)], names=names)


def with_earlier(chunks: DataFrame) -> DataFrame:
    """The chunks with the keys that earlier chunks of the same conversation hold. Each chunk sends a key once."""
    sent = chunks.filter("not whole").select("part", "k", F.explode(F.array_distinct("keys")).alias("key"))
    place = F.struct("part", "k")
    late = sent.withColumn("first", F.min(place).over(Window.partitionBy("key"))).filter(F.col("first") < place)
    earlier = late.groupBy("part", "k").agg(F.collect_list("key").alias("earlier"))
    opened = chunks.filter("not whole").join(earlier, ["part", "k"], "left").select(*chunks.columns, "earlier")
    return chunks.filter("whole").withColumn("earlier", F.lit(None).cast("array<binary>")).union(opened)


def _faults(chunk: dict) -> list[str]:
    seen, out = set(chunk["earlier"] or []), []
    for text, key in zip(chunk["texts"], chunk["keys"], strict=True):
        out.append(fault(text, key in seen))
        seen.add(key)
    return out


def weighed(chunk: dict) -> dict:
    """SUMMARY of a chunk. One that is a whole conversation is entered by the start alone."""
    faults, initials = _faults(chunk), [r[:1] for r in chunk["roles"]]
    told = [t for t in chunk["turns"] if t is not None]
    paths = [(enter, leave, *w) for enter in ([0] if chunk["whole"] else range(len(GRAMMAR))) for leave, w in shortest(chunk["roles"], faults, enter).items()]
    return {
        "n": len(faults), "blank": faults.count("blank"), "duplicate": faults.count("duplicate"), "truncated": faults.count("truncated"),
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)),
        "first": initials[0] if initials else None, "last": initials[-1] if initials else None,
        "low": told[0] if told else None, "high": told[-1] if told else None, "steps": len(set(told)),
        "paths": [dict(zip(("enter", "leave", "cost", "edits"), p, strict=True)) for p in paths],
        "chunks": [{"part": chunk["part"], "k": chunk["k"], "n": len(faults)}],
    }


def joined(a: dict, b: dict) -> dict:
    """The summary of two pieces in a row."""
    meet = a["last"] is not None and b["first"] is not None
    out = {c: a[c] + b[c] for c in ("n", "blank", "duplicate", "truncated", "illegal", "steps", "chunks")}
    out["illegal"] += int(meet and a["last"] + b["first"] not in ("su", "ua", "au"))
    out["steps"] -= int(a["high"] is not None and a["high"] == b["low"])
    for c, x, y in (("first", a, b), ("low", a, b), ("last", b, a), ("high", b, a)):
        out[c] = x[c] if x[c] is not None else y[c]
    both = product(_matrix(a), _matrix(b))
    out["paths"] = [{"enter": p, "leave": q, "cost": c, "edits": e} for p, reached in both.items() for q, (c, e) in reached.items()]
    return out


def _matrix(summary: dict) -> dict[int, Weights]:
    out: dict[int, Weights] = {}
    for p in summary["paths"]:
        out.setdefault(p["enter"], {})[p["leave"]] = (p["cost"], p["edits"])
    return out


def _best(summary: dict) -> Weight:
    return ended(_matrix(summary)[0])


def _rows(df: DataFrame, columns: list[str], more: str, each: Callable[[dict], dict]) -> DataFrame:
    """df's columns and those of `more`, which the function gives for a row of all columns."""
    schema = ", ".join(f"{c} {t}" for c, t in df.select(*columns).dtypes) + f", {more}"
    arrow = _arrow(df, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = batch.slice(at, 64).to_pylist()
                yield pa.RecordBatch.from_pylist([{c: r[c] for c in columns} | each(r) for r in rows], schema=arrow)

    return df.mapInArrow(run, schema)


def _arrow(df: DataFrame, schema: str) -> pa.Schema:
    return pa.schema([(f.name, _arrow_type(f.dataType)) for f in df.sparkSession.createDataFrame([], schema).schema])


def multiplied(opened: DataFrame, fan: int = FAN) -> DataFrame:
    """conv_id and SUMMARY of each conversation from those of its chunks, in a tree."""
    names = ["conv_id", *(c.split()[0] for c in SUMMARY.split(", "))]
    kind = dict(opened.dtypes)["conv_id"]
    arrow = _arrow(opened, f"conv_id {kind}, rank bigint, {SUMMARY}")

    def fold(key: tuple, table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["rank"])
        out = rows[0]
        for r in rows[1:]:
            out = joined(out, r)
        return pa.Table.from_pylist([out | {"conv_id": rows[0]["conv_id"], "rank": key[1].as_py()}], schema=arrow)

    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy("part", "k")) - 1
    held = opened.select("conv_id", rank.cast("bigint").alias("rank"), *names[1:])
    while True:
        after = materialise(held.withColumn("group", F.floor(F.col("rank") / fan)).groupBy("conv_id", "group").applyInArrow(fold, f"conv_id {kind}, rank bigint, {SUMMARY}"), "repair-tree")
        if hasattr(held, "written_to"):
            forget(held)
        held = after
        if not held.filter("rank > 0").limit(1).count():
            return held.drop("rank")


# --- whole tables ----------------------------------------------------------------------------------------------------


def repaired(turns: DataFrame, rows: int = CHUNK_TURNS, chars: int = CHUNK_CHARS, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """Two written tables. The first has a row per conversation: conv_id, blank, duplicate, truncated, illegal, gaps, cost, audit. The second has the repaired turns
    in order of (conv_id, part, k): conv_id, part, k, whole, edited (an array of role and text)."""
    chunks = materialise(chunks_of(turns, rows, chars), "repair-chunks")

    def weigh(chunk: dict) -> dict:
        out = weighed(chunk)
        edited = None
        if chunk["whole"]:
            edited = [{"role": r, "text": t} for r, t in applied(_best(out)[1], chunk["roles"], chunk["texts"])]
        return out | {"edited": edited}

    weights = _rows(with_earlier(chunks).drop("n"), ["conv_id", "part", "k", "whole"], f"{SUMMARY}, edited {EDITED}", weigh)
    weights = materialise(weights, "repair-weights")
    names = [c.split()[0] for c in SUMMARY.split(", ")]
    opened = weights.filter("not whole").drop("whole", "edited")
    of_all = weights.filter("whole").select("conv_id", "whole", *names).union(multiplied(opened, fan).select("conv_id", F.lit(False), *names))

    def close(row: dict) -> dict:
        cost, edits = _best(row)
        return {"gaps": 0 if row["low"] is None else row["high"] - row["low"] + 1 - row["steps"], "cost": cost, "audit": audit_of(edits), "edits": edits}

    summary = materialise(_rows(of_all, ["conv_id", "whole", "blank", "duplicate", "truncated", "illegal", "chunks"], "gaps bigint, cost bigint, audit string, edits string", close), "repair-summary")

    # Each chunk of a cut conversation gets its slice of the edits.
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own = slices(row["edits"], [c["n"] for c in row["chunks"]])
                yield pa.RecordBatch.from_pydict({"part": pa.array([c["part"] for c in row["chunks"]], pa.int32()), "k": pa.array([c["k"] for c in row["chunks"]], pa.int32()), "edits": pa.array(own, pa.string())})

    dealt = summary.filter("not whole").select("chunks", "edits").mapInArrow(deal, "part int, k int, edits string")
    left = chunks.filter("not whole").join(dealt, ["part", "k"])
    edit = lambda r: {"edited": [{"role": a, "text": b} for a, b in applied(r["edits"], r["roles"], r["texts"])]}
    late = _rows(left.select("conv_id", "part", "k", "whole", "roles", "texts", "edits"), ["conv_id", "part", "k", "whole"], f"edited {EDITED}", edit)
    done = materialise(weights.filter("whole").select("conv_id", "part", "k", "whole", "edited").union(late), "repair-turns")
    forget(chunks, weights)
    return summary.drop("whole", "chunks", "edits"), done


def repaired_turns(turns: DataFrame) -> DataFrame:
    """conv_id, part, k, place, role, text: the repaired turns, which stand in the order of part, k and place."""
    return repaired(turns)[1].select("conv_id", "part", "k", F.posexplode("edited").alias("place", "of")).select("conv_id", "part", "k", "place", "of.role", "of.text")


def digests(edited: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 of the lines role:text. A cut conversation streams through one task, chunk by chunk, as the digest demands."""
    lines = F.array_join(F.transform("edited", lambda t: F.concat(t.role, F.lit(":"), t.text)), "\n")
    whole = edited.filter("whole").select("conv_id", F.sha2(lines.cast("binary"), 256).alias("repaired_sha256"))
    kind = dict(edited.dtypes)["conv_id"]
    schema = f"conv_id {kind}, repaired_sha256 string"
    arrow = _arrow(edited, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, some = None, None, False
        for batch in batches:
            for row in batch.to_pylist():
                if state is None or row["conv_id"] != conv:
                    if state is not None:
                        yield pa.RecordBatch.from_pylist([{"conv_id": conv, "repaired_sha256": state.hexdigest()}], schema=arrow)
                    conv, state, some = row["conv_id"], hashlib.sha256(), False
                if row["n"]:
                    state.update((b"\n" if some else b"") + row["lines"].encode("utf-8", "surrogatepass"))
                    some = True
        if state is not None:
            yield pa.RecordBatch.from_pylist([{"conv_id": conv, "repaired_sha256": state.hexdigest()}], schema=arrow)

    cut = edited.filter("not whole").select("conv_id", "part", "k", F.size("edited").alias("n"), lines.alias("lines"))
    return whole.union(cut.repartition("conv_id").sortWithinPartitions("conv_id", "part", "k").mapInArrow(run, schema))


def repair_audit(turns: DataFrame, rows: int = CHUNK_TURNS, chars: int = CHUNK_CHARS, fan: int = FAN) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 per conversation."""
    summary, edited = repaired(turns, rows, chars, fan)
    sha = digests(edited).withColumnRenamed("conv_id", "of")
    out = summary.join(sha, F.col("conv_id").eqNullSafe(F.col("of")))
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
