"""The descent through tiles against judging every pixel of the picture."""

import random

import pytest
from pyspark.sql import functions as F

from tidewright.operators import spatial

TRI = "tri int, x0 double, y0 double, x1 double, y1 double, x2 double, y2 double"


def plain(tris, width, height):
    out = set()
    for _, *c in tris:
        for px in range(width):
            for py in range(height):
                x, y = px / (width - 1), 1.0 - py / (height - 1)
                e = [(c[2 * j] - c[2 * i]) * (y - c[2 * i + 1]) - (c[2 * j + 1] - c[2 * i + 1]) * (x - c[2 * i]) for i, j in ((0, 1), (1, 2), (2, 0))]
                inside = (min(c[0::2]) - 1e-9 <= x <= max(c[0::2]) + 1e-9) and (min(c[1::2]) - 1e-9 <= y <= max(c[1::2]) + 1e-9)
                if inside and (min(e) >= 0 or max(e) <= 0):
                    out.add((px, py))
    return out


ODD = [(100, 0.0, 0.0, 1.0, 0.0, 0.0, 1.0), (101, 0.5, 0.5, 0.5, 0.5, 0.5, 0.5), (102, 0.0, 0.25, 1.0, 0.25, 0.5, 0.25), (103, -5.0, -5.0, 6.0, -5.0, 0.5, 9.0), (104, 2.0, 2.0, 3.0, 2.0, 2.0, 3.0), (105, 0.2, 0.1, 0.21, 0.9, 0.205, 0.1)]


@pytest.mark.parametrize("width, height, sides", [(40, 30, (256, 32, 8)), (33, 64, (32, 8)), (50, 50, (8,)), (65, 17, (16, 4, 2))])
def test_coverage(spark, width, height, sides):
    rng = random.Random(width)
    tris = [(k, *[rng.uniform(-0.2, 1.2) for _ in range(6)]) for k in range(6)] + [(k, *[rng.randint(0, 8) / 8 for _ in range(6)]) for k in range(6, 12)]
    for some in [tris, *[[t] for t in ODD]]:
        got = {tuple(r) for r in spatial.coverage(spark.createDataFrame(some, TRI), width, height, sides).collect()}
        assert got == plain(some, width, height)
        if sides != (8,):
            break
    assert spatial.coverage(spark.createDataFrame([], TRI), width, height, sides).count() == 0


def test_odd_triangles_together(spark):
    got = {tuple(r) for r in spatial.coverage(spark.createDataFrame(ODD[:3] + ODD[4:], TRI), 48, 48, (16, 4)).collect()}
    assert got == plain(ODD[:3] + ODD[4:], 48, 48)


def test_fewer_candidates_than_bounds(spark):
    """A large slanted triangle makes tiles along its border and whole tiles inside, not the pixels of its bounds."""
    df = spark.createDataFrame([(1, 0.0, 0.0, 1.0, 0.9, 0.05, 1.0)], TRI)
    cells = spatial.descended(df, 1024, 1024)
    border = cells.filter("not full").select(F.sum(F.col("side") * F.col("side"))).first()[0]
    box = spatial.bounds(df, 1024, 1024).select((F.col("xmax") - F.col("xmin") + 1) * (F.col("ymax") - F.col("ymin") + 1)).first()[0]
    assert border < box / 20 and cells.count() < 2000
    assert spatial.coverage(df, 1024, 1024).count() > box / 3
