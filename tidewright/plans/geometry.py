"""Queries over indexed geometry made from the tables' numbers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewright.operators import spatial
from tidewright.session import load

WIDTH = HEIGHT = 128


def _indices(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "orders").select(F.col("o_orderkey").alias("pos"), (F.col("o_custkey") % 50).alias("vid"))


def _triangles(spark: SparkSession, d: str) -> DataFrame:
    """One small triangle per part, within the unit square; multiples of 1/1024 are exact."""
    at = lambda m, k: ((F.col("p_partkey") * m + k) % 1024 / F.lit(1024.0)).alias("v")
    x, y = at(37, 5), at(91, 11)
    side = lambda m: (F.col("p_partkey") * m % 61 - 30) / F.lit(1024.0)
    return load(spark, d, "part").select(F.col("p_partkey").alias("tri"), x.alias("x0"), y.alias("y0"), (x + side(7)).alias("x1"), (y + side(13)).alias("y1"), (x + side(17)).alias("x2"), (y + side(29)).alias("y2"))


def block_dedup(spark: SparkSession, d: str) -> DataFrame:
    return spatial.block_dedup(_indices(spark, d))


def dispatch_size(spark: SparkSession, d: str) -> DataFrame:
    return spatial.dispatch_size(spatial.block_dedup(_indices(spark, d)))


def gather(spark: SparkSession, d: str) -> DataFrame:
    vertices = load(spark, d, "supplier").select(F.col("s_suppkey").alias("vid"), (F.col("s_suppkey") / 4).alias("x"), (F.col("s_suppkey") / 8).alias("y"))
    indices = load(spark, d, "orders").select(F.col("o_orderkey").alias("pos"), (F.col("o_custkey") % 100 + 1).alias("vid"))
    return spatial.triangles(indices, vertices)


def triangle_bounds(spark: SparkSession, d: str) -> DataFrame:
    return spatial.bounds(_triangles(spark, d), WIDTH, HEIGHT).select("tri", "xmin", "xmax", "ymin", "ymax")


def tile_bins(spark: SparkSession, d: str) -> DataFrame:
    return spatial.tiles(spatial.bounds(_triangles(spark, d), WIDTH, HEIGHT), WIDTH).select("tri", "tx", "ty", "tile")


def tile_owners(spark: SparkSession, d: str) -> DataFrame:
    return spatial.owners(spatial.tiles(spatial.bounds(_triangles(spark, d), WIDTH, HEIGHT), WIDTH), 5, "tri")


def queue_capacity(spark: SparkSession, d: str) -> DataFrame:
    return spatial.bounded_queues(load(spark, d, "orders").withColumn("queue", F.col("o_custkey") % 7), "queue", "o_orderkey", 2000)


def queue_slots(spark: SparkSession, d: str) -> DataFrame:
    return spatial.queued(load(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 7).alias("queue")), "queue", "o_orderkey", 100)


def coverage(spark: SparkSession, d: str) -> DataFrame:
    return spatial.coverage(_triangles(spark, d), WIDTH, HEIGHT)


def tile_edges(spark: SparkSession, d: str) -> DataFrame:
    """Triangles sixteen times as wide under the edge test: tiles of the bounds that a triangle doesn't reach are gone, full ones are marked."""
    wide = _triangles(spark, d).select("tri", "x0", "y0", *[(F.col(f"{a}0") + (F.col(f"{a}{k}") - F.col(f"{a}0")) * 16).alias(f"{a}{k}") for k in (1, 2) for a in "xy"])
    return spatial.edge_tiles(spatial.bounds(wide, WIDTH, HEIGHT), WIDTH, HEIGHT, 8).select("tri", "tx", "ty", "full")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (block_dedup, dispatch_size, gather, triangle_bounds, tile_bins, tile_owners, queue_capacity, queue_slots, coverage, tile_edges)}

_DEDUP = """
i as (select o_orderkey as pos, o_custkey % 50 as vid, o_orderkey // 30 as block from orders),
f as (select block, vid, dense_rank() over (partition by block order by min(pos)) - 1 as local from i group by block, vid),
b as (select block, coalesce(sum(count(*)) over (order by block rows between unbounded preceding and 1 preceding), 0)::bigint as base from f group by block)"""
_TRI = """
t as (select p_partkey as tri, (p_partkey * 37 + 5) % 1024 / 1024.0::double as x0, (p_partkey * 91 + 11) % 1024 / 1024.0::double as y0 from part),
u as (select *, x0 + (tri * 7 % 61 - 30) / 1024.0::double as x1, y0 + (tri * 13 % 61 - 30) / 1024.0::double as y1, x0 + (tri * 17 % 61 - 30) / 1024.0::double as x2, y0 + (tri * 29 % 61 - 30) / 1024.0::double as y2 from t),
c as (select tri, x0, y0, x1, y1, x2, y2, greatest(ceil((least(x0, x1, x2) - 1e-9) * 127), 0)::int as xmin, least(floor((greatest(x0, x1, x2) + 1e-9) * 127), 127)::int as xmax,
  greatest(ceil((1 - greatest(y0, y1, y2) - 1e-9) * 127), 0)::int as ymin, least(floor((1 - least(y0, y1, y2) + 1e-9) * 127), 127)::int as ymax from u),
b as (select * from c where xmin <= xmax and ymin <= ymax),
l as (select tri, tx::int as tx, ty::int as ty, (ty * 4 + tx)::int as tile from (select tri, unnest(range(xmin // 32, xmax // 32 + 1)) as tx, ymin, ymax from b) x, lateral (select unnest(range(x.ymin // 32, x.ymax // 32 + 1)) as ty))"""

_WIDE = _TRI.replace("% 61 - 30) / 1024.0::double", "% 61 - 30) / 1024.0::double * 16")
_CORNERS = ", ".join(f"(x{j} - x{i}) * ({y} - y{i}) - (y{j} - y{i}) * ({x} - x{i}) as e{i}{n}" for i, j in ((0, 1), (1, 2), (2, 0)) for n, (x, y) in enumerate([("xl", "yl"), ("xl", "yh"), ("xh", "yl"), ("xh", "yh")]))
_MOST, _LEAST = ([f"{f}({', '.join(f'e{i}{n}' for n in range(4))})" for i in range(3)] for f in ("greatest", "least"))

SQL: dict[str, str] = {
    "tile_edges": f"""
with {_WIDE}, m as (select tri, tx::int as tx, ty::int as ty, x0, y0, x1, y1, x2, y2, tx * 8 / 127.0::double as xl, least(tx * 8 + 7, 127) / 127.0::double as xh, 1 - ty * 8 / 127.0::double as yl, 1 - least(ty * 8 + 7, 127) / 127.0::double as yh
  from (select b.*, unnest(range(xmin // 8, xmax // 8 + 1)) as tx from b) x, lateral (select unnest(range(x.ymin // 8, x.ymax // 8 + 1)) as ty)),
e as (select tri, tx, ty, {_CORNERS} from m)
select tri, tx, ty, ({" and ".join(f"{c} > 1e-9" for c in _LEAST)}) or ({" and ".join(f"{c} < -1e-9" for c in _MOST)}) as "full"
from e where ({" and ".join(f"{c} >= -1e-9" for c in _MOST)}) or ({" and ".join(f"{c} <= 1e-9" for c in _LEAST)})""",
    "block_dedup": f"with {_DEDUP} select pos, i.vid, i.block, local::int as local, base + local as uid from i join f using (block, vid) join b using (block)",
    "dispatch_size": f'with {_DEDUP} select max(base + local) + 1 as "unique", ceil((max(base + local) + 1) / 32.0)::bigint as groups from f join b using (block)',
    "gather": """
with p as (select o_orderkey // 3 as tri, o_orderkey % 3 as c, o_custkey % 100 + 1 as vid from orders), v as (select s_suppkey as vid, s_suppkey / 4.0::double as x, s_suppkey / 8.0::double as y from supplier)
select tri, max(x) filter (c = 0) as x0, max(y) filter (c = 0) as y0, max(x) filter (c = 1) as x1, max(y) filter (c = 1) as y1, max(x) filter (c = 2) as x2, max(y) filter (c = 2) as y2 from p join v using (vid) group by tri having count(*) = 3""",
    "triangle_bounds": f"with {_TRI} select tri, xmin, xmax, ymin, ymax from b",
    "tile_bins": f"with {_TRI} select tri, tx, ty, tile from l",
    "tile_owners": f"with {_TRI} select distinct tri, (tile % 5)::int as owner from l",
    "queue_capacity": "select o_custkey % 7 as queue, count(*) as n, least(count(*), 2000) as kept, count(*) > 2000 as overflow from orders group by 1",
    "queue_slots": "select o_orderkey, queue, slot::int as slot from (select o_orderkey, o_custkey % 7 as queue, row_number() over (partition by o_custkey % 7 order by o_orderkey) - 1 as slot from orders) where slot < 100",
    "coverage": f"""
with {_TRI}, g as (select px::int as px, py::int as py, px / 127.0::double as x, 1 - py / 127.0::double as y from range(128) a(px), range(128) b(py)),
e as (select px, py, (x1 - x0) * (y - y0) - (y1 - y0) * (x - x0) as e0, (x2 - x1) * (y - y1) - (y2 - y1) * (x - x1) as e1, (x0 - x2) * (y - y2) - (y0 - y2) * (x - x2) as e2 from g, b where px between xmin and xmax and py between ymin and ymax)
select distinct px, py from e where (e0 >= 0 and e1 >= 0 and e2 >= 0) or (e0 <= 0 and e1 <= 0 and e2 <= 0)""",
}
