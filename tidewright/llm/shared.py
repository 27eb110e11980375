"""What several operators of this subpackage need: a shared folder, null-safe text batches, connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it in spark.checkpoint.dir.

    Only where none is set and all runs on one machine (tests) a temporary folder is made and set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tidewright-"))
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
    return held.get().rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage is cut and every executor can read it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidewright/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def forget(*tables: DataFrame) -> None:
    """Delete tables of materialise() that nothing will read again."""
    for table in tables:
        _delete(table.sparkSession, table.written_to)


def clean(spark: SparkSession) -> None:
    """Delete all that this application wrote to the shared folder; results that read from it have to be written before."""
    _delete(spark, f"{shared_dir(spark)}/tidewright/{spark.sparkContext.applicationId}")


#: Ids that a join may broadcast: 8 bytes each, so a few tens of MB at most in a task's memory.
BROADCAST_IDS = 1_000_000


def ids_for_join(ids: DataFrame) -> DataFrame:
    """A written table of one id column, to be broadcast where its counted size allows; otherwise Spark shuffles both sides."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def map_rows(df: DataFrame, columns: list[str], schema: str, start: Callable[[], Callable[[dict], dict]]) -> DataFrame:
    """Pieces of Arrow batches of the named columns through a function of column lists.

    start() runs once per task and gives the function, so that caches and tables live as long as the task.
    The function takes {column: list} and returns {column: list or array} in the order of schema.
    """
    out = df.sparkSession.createDataFrame([], schema).schema
    arrow = pa.schema([(f.name, _arrow_type(f.dataType)) for f in out])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = start()
        for batch in batches:
            for part in _slices(batch):
                got = each({c: part.column(k).to_pylist() for k, c in enumerate(columns)})
                yield pa.RecordBatch.from_arrays([pa.array(got[f.name], type=f.type, from_pandas=False) for f in arrow], schema=arrow)

    return df.select(*columns).mapInArrow(run, out)


def append(df: DataFrame, name: str, columns: list[str], schema: str, start: Callable[[], Callable[[dict], dict]], room: int = 0) -> DataFrame:
    """df with one more column, a struct of what the function gives for the named columns (as in map_rows). Narrow: no row moves.

    room: pieces are put together until they hold so many bytes, for functions that do better on more rows at once.
    """
    fields = df.sparkSession.createDataFrame([], schema).schema
    out = T.StructType([*df.schema.fields, T.StructField(name, fields)])
    kind = _arrow_type(fields)
    at = [df.columns.index(c) for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = start()
        for part in gathered((p for batch in batches for p in _slices(batch)), room):
            got = each({c: part.column(k).to_pylist() for c, k in zip(columns, at, strict=True)})
            more = pa.StructArray.from_arrays([pa.array(got[f.name], type=f.type, from_pandas=False) for f in kind], fields=list(kind))
            yield pa.RecordBatch.from_arrays([*part.columns, more], names=[*part.schema.names, name])

    return df.mapInArrow(run, out)


def unused(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    while name.lower() in {c.lower() for c in df.columns}:
        name += "_"
    return name


def _slices(batch: pa.RecordBatch, rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Pieces small enough that the Python objects of one piece stay far below a worker's memory."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def gathered(pieces: Iterator[pa.RecordBatch], room: int) -> Iterator[pa.RecordBatch]:
    """Pieces put together until they hold `room` bytes."""
    held, size = [], 0
    for piece in pieces:
        held.append(piece)
        size += piece.nbytes
        if size >= room:
            yield held[0] if len(held) == 1 else pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield held[0] if len(held) == 1 else pa.concat_batches(held)


def _arrow_type(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow_type(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([(f.name, _arrow_type(f.dataType)) for f in kind])
    return {
        "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "float": pa.float32(),
        "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(),
    }[kind.simpleString()]


def components(edges: DataFrame, a: str = "a", b: str = "b", known: DataFrame | None = None) -> DataFrame:
    """(node, component): the smallest id reachable over undirected edges; only nodes with an edge appear.

    known: the components of earlier edges, of the same form, to which these are added; only edges between different ones take part
    in the rounds, so a few late edges cost as much as they are.

    Each round takes the smallest label of the neighbours, gives it to the node that the old label names as well, and then
    takes the label of the label; so whole trees hook onto lower ones and long chains shrink in any order of their ids.
    Labels only fall, and the rounds end when none does.
    The minima combine before the shuffle, and the labels are a written table, so Spark can split a node with
    very many edges in either join. Nothing but one count of changes comes to the driver.
    """
    edges = edges.select(F.col(a).alias("src"), F.col(b).alias("dst"))
    if known is not None:
        for end in ("src", "dst"):
            of = known.select(F.col("node").alias(end), F.col("component").alias("held"))
            edges = edges.join(of, end, "left").withColumn(end, F.coalesce("held", end)).drop("held")
    both = edges.select("src", "dst").union(edges.select(F.col("dst"), F.col("src")))
    both = materialise(both.filter("src <> dst").distinct(), "edges")
    if known is not None:
        if both.limit(1).count() == 0:
            forget(both)
            return known
        late = _settled(both)
        of = late.select(F.col("node").alias("component"), F.col("component").alias("root"))
        raised = known.join(of, "component", "left").select("node", F.coalesce("root", "component").alias("component"))
        return materialise(raised.union(late.join(known, "node", "left_anti").select("node", "component")), "labels")
    return _settled(both)


def _settled(both: DataFrame) -> DataFrame:
    """The components of a written table of edges in both directions, which is deleted."""
    labels = materialise(both.groupBy(F.col("src").alias("node")).agg(F.least(F.first("src"), F.min("dst")).alias("component")), "labels")
    held = labels
    while True:
        near = both.join(labels, both.src == labels.node).select(F.col("dst").alias("node"), "component")
        near = near.withColumn("old", F.lit(None).cast("bigint")).union(labels.withColumn("old", F.col("component")))
        low = near.groupBy("node").agg(F.min("component").alias("component"), F.max("old").alias("old"))
        hooked = F.struct(F.col("old").alias("node"), "component", F.lit(None).cast("bigint").alias("old"))
        low = low.select(F.inline(F.array(F.struct("node", "component", "old"), hooked)))
        raised = materialise(low.groupBy("node").agg(F.min("component").alias("component"), F.max("old").alias("old")), "low")
        of = raised.select(F.col("node").alias("component"), F.col("component").alias("root"))
        step = materialise(raised.join(of, "component").select("node", F.col("root").alias("component"), "old"), "labels")
        forget(raised, held)
        labels, held = step.select("node", "component"), step
        if step.filter("component <> old").limit(1).count() == 0:
            forget(both)
            return labels
