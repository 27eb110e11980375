"""Indexed geometry: block-local deduplication, gathering, tiles, queues and coverage."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Indices in a block of ten triangles, and pixels along a tile's side.
BLOCK, TILE = 30, 32


def block_dedup(indices: DataFrame, block: int = BLOCK) -> DataFrame:
    """pos, vid, block, local, uid: equal ids of a block share the rank of their first place; blocks follow one another.

    The base of a block is the number of distinct ids in all earlier blocks; it is summed in two levels.
    """
    cut = indices.withColumn("block", F.floor(F.col("pos") / block).cast("bigint"))
    first = F.min("pos").over(Window.partitionBy("block", "vid"))
    cut = cut.withColumn("_first", first).withColumn("local", F.dense_rank().over(Window.partitionBy("block").orderBy("_first")) - 1)
    sizes = cut.groupBy("block").agg((F.max("local") + 1).alias("n")).withColumn("super", F.floor(F.col("block") / 4096))
    sums = sizes.groupBy("super").agg(F.sum("n").alias("_own"))
    ahead = sums.select("super", F.coalesce(F.sum("_own").over(Window.orderBy("super").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    inner = Window.partitionBy("super").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.join(ahead, "super").withColumn("base", F.col("_ahead") + F.coalesce(F.sum("n").over(inner), F.lit(0))).select("block", "base")
    return cut.join(base, "block").select("pos", "vid", "block", "local", (F.col("base") + F.col("local")).alias("uid"))


def dispatch_size(deduped: DataFrame, width: int = 32) -> DataFrame:
    """unique, groups: distinct ids over all blocks and the groups of `width` that hold them."""
    return deduped.agg((F.max("uid") + 1).alias("unique")).select("unique", F.ceil(F.col("unique") / width).alias("groups"))


def triangles(indices: DataFrame, vertices: DataFrame) -> DataFrame:
    """tri, x0, y0, x1, y1, x2, y2: three corners gathered by one join and one grouping."""
    corner = F.pmod(F.col("pos"), F.lit(3))
    placed = indices.select(F.floor(F.col("pos") / 3).cast("bigint").alias("tri"), corner.alias("c"), "vid").join(vertices.select("vid", "x", "y"), "vid")
    pick = lambda axis, k: F.max(F.when(F.col("c") == k, F.col(axis))).alias(f"{axis}{k}")
    out = placed.groupBy("tri").agg(*[pick(a, k) for k in range(3) for a in "xy"], F.count("*").alias("_n"))
    return out.filter("_n = 3").drop("_n")


def bounds(tris: DataFrame, width: int, height: int) -> DataFrame:
    """Pixel bounds of triangles within the picture; empty ones go. Samples stand at x / (width - 1) and 1 - y / (height - 1)."""
    xs, ys = [F.col(f"x{k}") for k in range(3)], [F.col(f"y{k}") for k in range(3)]
    low = lambda c, n: F.greatest(F.ceil(c * (n - 1)), F.lit(0)).cast("int")
    high = lambda c, n: F.least(F.floor(c * (n - 1)), F.lit(n - 1)).cast("int")
    out = tris.withColumns({
        "xmin": low(F.least(*xs) - 1e-9, width), "xmax": high(F.greatest(*xs) + 1e-9, width),
        "ymin": low(1 - F.greatest(*ys) - 1e-9, height), "ymax": high(1 - F.least(*ys) + 1e-9, height),
    })
    return out.filter("xmin <= xmax and ymin <= ymax")


def tiles(boxes: DataFrame, width: int, tile: int = TILE) -> DataFrame:
    """A row per triangle and tile that its bounds touch: tx, ty, tile."""
    across = -(-width // tile)
    cells = boxes.withColumn("tx", F.explode(F.sequence((F.col("xmin") / tile).cast("int"), (F.col("xmax") / tile).cast("int"))))
    cells = cells.withColumn("ty", F.explode(F.sequence((F.col("ymin") / tile).cast("int"), (F.col("ymax") / tile).cast("int"))))
    return cells.withColumn("tile", F.col("ty") * across + F.col("tx"))


def owners(cells: DataFrame, queues: int, item: str) -> DataFrame:
    """item, owner: each item once for each queue that owns one of its tiles."""
    return cells.select(item, F.pmod(F.col("tile"), F.lit(queues)).cast("int").alias("owner")).distinct()


def bounded_queues(items: DataFrame, queue: str, order: str, capacity: int) -> DataFrame:
    """queue, n, kept, overflow: how many fit. The counts combine before the shuffle."""
    return items.groupBy(queue).agg(F.count("*").alias("n")).select(queue, "n", F.least("n", F.lit(capacity)).alias("kept"), (F.col("n") > capacity).alias("overflow"))


def queued(items: DataFrame, queue: str, order: str, capacity: int) -> DataFrame:
    """The items in their queues, slot by slot; Spark drops what is over the capacity before the shuffle."""
    slot = F.row_number().over(Window.partitionBy(queue).orderBy(order)) - 1
    return items.withColumn("slot", slot).filter(F.col("slot") < capacity)


def _edge(ax: Column, ay: Column, bx: Column, by: Column, px: Column, py: Column) -> Column:
    return (bx - ax) * (py - ay) - (by - ay) * (px - ax)


def _edges(x: Column, y: Column) -> list[Column]:
    """The three edge functions of a triangle's columns at a point; their signs agree inside, whichever way round it is."""
    c = {k: F.col(k).cast("double") for k in ("x0", "y0", "x1", "y1", "x2", "y2")}
    return [_edge(c[f"x{i}"], c[f"y{i}"], c[f"x{j}"], c[f"y{j}"], x, y) for i, j in ((0, 1), (1, 2), (2, 0))]


def _all(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests)


#: Sides of the tiles that a triangle descends through, each a multiple of the next.
SIDES = (256, 32, 8)
#: Below this an edge function counts as zero when a whole tile is judged; its pixels are then judged one by one.
NEAR = 1e-9


def edge_tiles(boxes: DataFrame, width: int, height: int, side: int) -> DataFrame:
    """boxes (bounds) by the tiles of one side that the triangle may touch: tx, ty, full (every pixel of the tile within the picture lies inside).

    An edge function is linear, so over a tile it lies between its values at the corners. A tile goes where one edge has all of it
    outside. The test is conservative: what stays may still hold no pixel.
    """
    out = boxes
    for t, low, high in (("tx", "xmin", "xmax"), ("ty", "ymin", "ymax")):
        out = out.withColumn(t, F.explode(F.sequence((F.col(low) / side).cast("int"), (F.col(high) / side).cast("int"))))
    return _judged(out, width, height, side)


def _judged(cells: DataFrame, width: int, height: int, side: int) -> DataFrame:
    left, top = F.col("tx") * side, F.col("ty") * side
    right, below = F.least(left + side - 1, F.lit(width - 1)), F.least(top + side - 1, F.lit(height - 1))
    xs, ys = [c / F.lit(float(width - 1)) for c in (left, right)], [F.lit(1.0) - c / F.lit(float(height - 1)) for c in (top, below)]
    corners = [_edges(x, y) for x in xs for y in ys]
    most, least = [F.greatest(*[c[k] for c in corners]) for k in range(3)], [F.least(*[c[k] for c in corners]) for k in range(3)]
    may = _all([m >= -NEAR for m in most]) | _all([m <= NEAR for m in least])
    full = _all([m > NEAR for m in least]) | _all([m < -NEAR for m in most])
    return cells.filter(may).withColumn("full", full)


def descended(tris: DataFrame, width: int, height: int, sides: Sequence[int] = SIDES) -> DataFrame:
    """side, tx, ty, full and the triangle's columns: from coarse tiles to fine ones. A full tile isn't parted; of the others the last side remains."""
    level = edge_tiles(bounds(tris, width, height), width, height, sides[0]).withColumn("side", F.lit(sides[0]))
    for above, side in zip(sides, sides[1:], strict=False):
        n = above // side
        # Parts of a tile that the triangle's bounds don't reach aren't made.
        part = lambda t, low, high: F.explode(F.sequence(F.greatest(F.col(t) * n, (F.col(low) / side).cast("int")), F.least(F.col(t) * n + n - 1, (F.col(high) / side).cast("int"))))  # noqa: B023, E731
        finer = level.filter("not full").filter(F.col("side") == above)
        finer = _judged(finer.withColumn("tx", part("tx", "xmin", "xmax")).withColumn("ty", part("ty", "ymin", "ymax")), width, height, side).withColumn("side", F.lit(side))
        level = level.filter(F.col("full") | (F.col("side") != above)).union(finer.select(level.columns))
    return level


def coverage(tris: DataFrame, width: int, height: int, sides: Sequence[int] = SIDES) -> DataFrame:
    """px, py: pixels whose sample lies within a triangle, on its edges included, either way round.

    Full tiles are told apart before their pixels are made, so a large triangle costs its border and a tile under many triangles counts once; in
    the tiles on the border each pixel is judged.
    """
    cells = descended(tris, width, height, sides)
    span = lambda t, end: F.explode(F.sequence(F.col(t) * F.col("side"), F.least(F.col(t) * F.col("side") + F.col("side") - 1, F.lit(end - 1))))
    whole = cells.filter("full").select("side", "tx", "ty").distinct().withColumn("px", span("tx", width)).withColumn("py", span("ty", height)).select("px", "py")
    within = lambda t, low, high: F.explode(F.sequence(F.greatest(F.col(t) * F.col("side"), F.col(low)), F.least(F.col(t) * F.col("side") + F.col("side") - 1, F.col(high))))
    border = cells.filter("not full").filter("greatest(tx * side, xmin) <= least(tx * side + side - 1, xmax) and greatest(ty * side, ymin) <= least(ty * side + side - 1, ymax)")
    border = border.withColumn("px", within("tx", "xmin", "xmax")).withColumn("py", within("ty", "ymin", "ymax"))
    e = _edges(F.col("px") / F.lit(float(width - 1)), F.lit(1.0) - F.col("py") / F.lit(float(height - 1)))
    inside = _all([x >= 0 for x in e]) | _all([x <= 0 for x in e])
    return border.filter(inside).select("px", "py").union(whole).distinct()
