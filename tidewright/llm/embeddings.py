"""Embedding near-dedup by sorted projection passes.

Equal vectors of a label form one class with a weight. In every pass a class gets a key, the concatenated bits of
random projections in a fresh order, and all classes are sorted by label and key over the whole cluster. Near
vectors share long beginnings of their keys, so they stand close; each is compared with the vectors of a bounded
window before it, in double precision, also where the sorted order is cut into tasks. The pairs that hold in any pass are
united into components, and links are counted exactly among all vectors of a component, in pairs of blocks, so a group of near
vectors may be of any size. A link between two components that no pass joins is missed; the number of passes grows with the largest label,
so that a pair at the least cosine still meets with the chance RECALL, and recall is measured in the tests.

Vectors move as they came, in 4 bytes a component where the column holds floats, and are brought to length 1 in double precision where they are compared.

Vectors that are null, empty or zero, or hold null or non-finite components, and rows with a null label link with nothing. Vectors
of different lengths are not compared. Every row is a vector of its own, also where a vec_id repeats; a null vec_id is linked and never names a
component that holds an id. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.shared import _slices, components, forget, materialise

COSINE = 0.93
#: Sorted passes at least, bits of a key in each, and neighbours before a vector that it is compared with.
PASSES, BITS, NEIGHBOURS = 12, 48, 384
#: The chance that a pair at the least cosine stands within a window in some pass.
RECALL = 0.95
#: Rows that a task compares with their windows at once.
ROWS = 512
#: Vectors of a component that are counted as one block; a task holds two.
BLOCK = 4096

_KEYED = "pass int, group string, key bigint, cls bigint, vector binary"


def passes_for(largest: int, cosine: float, neighbours: int) -> int:
    """Passes for labels of up to so many distinct vectors.

    One bit of two vectors agrees with the chance 1 - angle / pi; keys that agree in log2(largest / neighbours) bits stand within a window.
    """
    bits = max(0.0, math.log2(max(1, largest) / neighbours))
    meet = (1 - math.acos(min(1.0, cosine)) / math.pi) ** bits
    return max(PASSES, math.ceil(math.log(1 - RECALL) / math.log(max(1e-12, 1 - meet))))


def _units(vectors: list[bytes], kind: str) -> np.ndarray:
    """Rows of length 1 in double precision."""
    x = np.frombuffer(b"".join(vectors), kind).reshape(len(vectors), -1).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


@functools.lru_cache(maxsize=256)
def _planes(dim: int, number: int) -> np.ndarray:
    """Random projections of a pass, the same in every task."""
    seed = int.from_bytes(hashlib.blake2b(f"{dim}:{number}".encode(), digest_size=8).digest(), "little")
    return np.random.default_rng(seed).standard_normal((dim, BITS))


def _keyed(passes: int, kind: str):
    arrow = pa.schema([("pass", pa.int32()), ("group", pa.string()), ("key", pa.int64()), ("cls", pa.int64()), ("vector", pa.binary())])
    weights = (1 << np.arange(BITS - 1, -1, -1)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _slices(batch):
                vectors, groups, ids = (piece.column(k).to_pylist() for k in (2, 1, 0))
                by_size: dict[int, list[int]] = {}
                for k, v in enumerate(vectors):
                    by_size.setdefault(len(v), []).append(k)
                for size, rows in by_size.items():
                    x = _units([vectors[k] for k in rows], kind)
                    for n in range(passes):
                        key = (x @ _planes(x.shape[1], n) > 0) @ weights
                        yield pa.RecordBatch.from_arrays([pa.array([n] * len(rows), pa.int32()), pa.array([groups[k] for k in rows]), pa.array(key), pa.array([ids[k] for k in rows]), pa.array([vectors[k] for k in rows], pa.binary())], schema=arrow)

    return run


_FOUND = "a bigint, b bigint, part int, head boolean, pass int, group string, cls bigint, vector binary"
_FOUND_ARROW = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("part", pa.int32()), ("head", pa.bool_()), ("pass", pa.int32()), ("group", pa.string()), ("cls", pa.int64()), ("vector", pa.binary())])


def _links(ids: np.ndarray, x: np.ndarray, old: int, cosine: float, neighbours: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of the rows from `old` on to rows before them, as many as connect what is near within the windows.

    A link is left out if the row's first near one is near to the same partner, as these two are connected already.
    """
    near = x @ x.T >= cosine
    place = np.arange(len(ids))
    near &= (place < place[:, None]) & (place[:, None] - place <= neighbours)
    new = near[old:]
    row, col = np.nonzero(new & ~near[:, new.argmax(1)].T)
    return ids[row + old], ids[col]


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    pair = {"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))}
    return pa.RecordBatch.from_arrays([pair.get(f.name, pa.nulls(len(a), f.type)) for f in _FOUND_ARROW], schema=_FOUND_ARROW)


def _windowed(cosine: float, neighbours: int, kind: str):
    """Links within a sorted partition; the last `neighbours` vectors are carried from piece to piece.

    The begin of a partition's first run (head) and the end of its last go out as well, for the windows over the cuts.
    """

    def edge(head: bool, run_of: tuple, ids: np.ndarray, raw: list[bytes]) -> pa.RecordBatch:
        n, part = len(ids), TaskContext.get().partitionId()
        row = {
            "part": pa.array([part] * n, pa.int32()), "head": pa.array([head] * n), "pass": pa.array([run_of[0]] * n, pa.int32()), "group": pa.array([run_of[1]] * n, pa.string()),
            "cls": pa.array(ids), "vector": pa.array(raw, pa.binary()),
        }
        return pa.RecordBatch.from_arrays([row.get(f.name, pa.nulls(n, f.type)) for f in _FOUND_ARROW], schema=_FOUND_ARROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run_of, ids, x, raw = None, np.zeros(0, np.int64), None, []
        first, headed = None, 0
        for batch in batches:
            for piece in _slices(batch, ROWS):
                numbers, groups, cls, vectors = piece.column(0).to_pylist(), piece.column(1).to_pylist(), piece.column(2).to_numpy(), piece.column(3).to_pylist()
                marks = list(zip(numbers, groups, map(len, vectors), strict=True))
                begin = 0
                while begin < len(marks):
                    end = begin
                    while end < len(marks) and marks[end] == marks[begin]:
                        end += 1
                    new = _units(vectors[begin:end], kind)
                    if marks[begin] != run_of:
                        run_of, ids, x, raw = marks[begin], np.zeros(0, np.int64), np.zeros((0, new.shape[1])), []
                    first = first or run_of
                    if run_of == first and headed < neighbours:
                        yield edge(True, run_of, cls[begin:end][: neighbours - headed], vectors[begin:end][: neighbours - headed])
                        headed += end - begin
                    ids, x = np.concatenate([ids, cls[begin:end]]), np.concatenate([x, new])
                    a, b = _links(ids, x, len(ids) - (end - begin), cosine, neighbours)
                    if len(a):
                        yield _pairs(a, b)
                    ids, x, raw = ids[-neighbours:], x[-neighbours:], (raw + vectors[begin:end])[-neighbours:]
                    begin = end
        if run_of:
            yield edge(False, run_of, ids, raw)

    return run


def _over_cuts(found: DataFrame, cosine: float, neighbours: int, kind: str) -> DataFrame:
    """Links of every partition's first rows to the rows of its run that stand in the partitions before it.

    The driver sees one row per partition and side. A partition shorter than the window that holds a single run leads on to the one before.
    """
    spark = found.sparkSession
    edges = found.filter("part is not null")
    told = edges.groupBy("part", "head").agg(F.count("*").alias("n"), F.first(F.struct("pass", "group", F.octet_length("vector"))).alias("run"))
    heads, tails = {}, {}
    for r in told.collect():
        (heads if r["head"] else tails)[r["part"]] = (r["n"], tuple(r["run"]))
    order = sorted(heads)
    needs = []
    for k, part in enumerate(order):
        run, left = heads[part][1], neighbours
        while k and left > 0 and tails[order[k - 1]][1] == run:
            k -= 1
            needs.append((order[k], part))
            left -= tails[order[k]][0]
            if heads[order[k]][1] != run:
                break
    needs = spark.createDataFrame(needs, "source int, target int")
    before = edges.filter("not head").join(F.broadcast(needs), F.col("part") == F.col("source")).select("target", "head", "cls", "vector")
    after = edges.filter("head").join(F.broadcast(needs.select("target").distinct()), F.col("part") == F.col("target")).select("target", "head", "cls", "vector")

    def compare(table: pa.Table) -> pa.Table:
        # All pairs before the cut are compared elsewhere, so links may be left out here as within a partition.
        head = table.column("head").to_numpy(zero_copy_only=False)
        at = np.argsort(head, kind="stable")
        x = _units(table.column("vector").to_pylist(), kind)[at]
        a, b = _links(table.column("cls").to_numpy()[at], x, int((~head).sum()), cosine, len(at))
        return pa.table({"a": np.minimum(a, b), "b": np.maximum(a, b)})

    return before.union(after).groupBy("target").applyInArrow(compare, "a bigint, b bigint")


def _counted(cosine: float, kind: str):
    """Near partners of every vector, with their weights, within a block (i = j) or between two blocks of a component; sorted by these."""

    def near(x: np.ndarray, y: np.ndarray, of_x: np.ndarray, of_y: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
        left, right = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
        for at in range(0, len(x), ROWS):
            hit = x[at : at + ROWS] @ y.T >= cosine
            if same:
                hit[np.arange(len(hit)), np.arange(at, at + len(hit))] = False
            left[at : at + ROWS] = hit @ of_y
            right += of_x[at : at + ROWS] @ hit
        return left, right

    def count(mine: np.ndarray, i: int, j: int, cls: np.ndarray, weight: np.ndarray, vectors: list) -> list[tuple[np.ndarray, np.ndarray]]:
        x = _units(vectors, kind)
        if i == j:
            return [(cls, near(x, x, weight, weight, True)[0])]
        a = mine == i
        left, right = near(x[a], x[~a], weight[a], weight[~a], False)
        return [(cls[a], left), (cls[~a], right)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, of = [], None

        def closed() -> list[tuple[np.ndarray, np.ndarray]]:
            if not kept:
                return []
            mine, cls, weight = (np.concatenate([k[c] for k in kept]) for c in range(3))
            return count(mine, of[1], of[2], cls, weight, [v for k in kept for v in k[3]])

        for batch in batches:
            for piece in _slices(batch):
                component, i, j, mine, cls, weight = (piece.column(c).to_numpy() for c in range(6))
                vectors = piece.column(6).to_pylist()
                cuts = np.flatnonzero((component[1:] != component[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
                out = []
                for begin, end in zip([0, *cuts], [*cuts, len(cls)], strict=True):
                    if (mark := (component[begin], i[begin], j[begin])) != of:
                        out += closed()
                        kept, of = [], mark
                    kept.append((mine[begin:end], cls[begin:end], weight[begin:end], vectors[begin:end]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[c] for o in out])) for c in range(2)], names=["cls", "others"])
        for cls, others in closed():
            yield pa.RecordBatch.from_arrays([pa.array(cls), pa.array(others)], names=["cls", "others"])

    return run


def _link_counts(units: DataFrame, classes: DataFrame, joined: DataFrame, cosine: float, block: int, kind: str) -> DataFrame:
    """cls, others: the rows that are near to each class, by comparing all vectors of its component."""
    sizes = joined.groupBy("component").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    of = joined.join(sizes, "component").join(classes.select(F.col("cls").alias("node"), "weight"), "node")
    of = of.select(F.col("node").alias("cls"), "component", "weight", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("mine"))
    members = of.join(units.select("cls", "vector"), "cls").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = members.select("component", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "cls", "weight", "vector")
    members = members.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")
    return members.mapInArrow(_counted(cosine, kind), "cls bigint, others bigint").groupBy("cls").agg(F.sum("others").alias("others"))


def near_vectors(vectors: DataFrame, cosine: float = COSINE, passes: int | None = None, neighbours: int = NEIGHBOURS, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row. passes: by the size of the largest label where not given."""
    spark = vectors.sparkSession
    kind = "<f4" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"
    rows = vectors.select("vec_id", "embedding", "label", F.monotonically_increasing_id().alias("row"))
    sound = F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")) & ~F.isnan(x.cast("double")))
    rows = materialise(rows.withColumn("sound", F.coalesce(sound & finite & F.exists("embedding", lambda x: x != 0), F.lit(False))), "vectors")
    valid = rows.filter("sound").select("vec_id", "row", F.col("label").cast("string").alias("group"), F.col("embedding").cast("array<double>").alias("v"))
    # -0.0 and 0.0 are one value.
    valid = valid.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0))).withColumn("digest", F.sha2(F.to_json("v").cast("binary"), 256))
    classes = valid.groupBy("group", "digest").agg(F.min("row").alias("cls"), F.min("vec_id").alias("first_id"), F.count("*").alias("weight"), F.first("v").alias("v"))
    classes = materialise(classes, "vector-classes")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [np.array(v.as_py()).astype(kind).tobytes() for v in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["cls", "group", "vector"])

    units = classes.select("cls", "group", "v").mapInArrow(packed, "cls bigint, group string, vector binary")
    if passes is None:
        largest = classes.groupBy("group").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
        passes = passes_for(largest or 0, cosine, neighbours)
    keyed = units.mapInArrow(_keyed(passes, kind), _KEYED)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["pass", "group", F.octet_length("vector"), "key", "cls"]
    ranged = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("pass", "group", "cls", "vector")
    found = materialise(ranged.mapInArrow(_windowed(cosine, neighbours, kind), _FOUND), "vector-links")
    joined = components(found.filter("a is not null").select("a", "b").union(_over_cuts(found, cosine, neighbours, kind)))
    links = _link_counts(units, classes, joined, cosine, block, kind)
    named = classes.join(joined, classes.cls == joined.node, "left").select("cls", "group", "digest", "first_id", "weight", F.coalesce("component", "cls").alias("component"))
    named = materialise(named.join(links, "cls", "left"), "vector-named")
    first = materialise(named.groupBy("component").agg(F.min("first_id").alias("component_id")), "vector-first")
    forget(found)
    named = named.join(first, "component").select("group", "digest", "component_id", (F.coalesce("others", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    linked = valid.select("vec_id", "group", "digest").join(materialise(named, "vector-labels"), ["group", "digest"]).select("vec_id", "n_links", "component_id")
    out = linked.union(rows.filter("not sound").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()))
