"""Window forms against a plain walk over the rows, on random input."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidewright.operators import links, series, spans, state


def test_changes_with_nan(spark):
    nan = float("nan")
    rows = [("s", k, v) for k, v in enumerate([0.0, 0.0, nan, nan, 1.0, 1.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "series string, ts bigint, value double")
    assert sorted(r.ts for r in series.changes(df, ["ts"]).collect()) == [0, 2, 3, 4, 6]
    assert sorted(r.ts for r in series.changes(df, ["ts"], mode="zeros").collect()) == [0, 2, 3, 4, 5, 6]
    assert series.changes(df, ["ts"], mode="none").count() == 8


def test_window_keeps_the_baseline(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("a", 3, 6.0), ("a", 10, 7.0), ("b", 12, 1.0), ("b", 20, 2.0)], "series string, ts bigint, value double")
    assert sorted(map(tuple, series.in_window(df, 5, 12, ["ts"]).collect())) == [("a", 3, 6.0), ("a", 10, 7.0), ("b", 12, 1.0)]


def test_expressions():
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    df = spark.createDataFrame([(2.0, 3.0, None)], "`a.b` double, a double, c double")
    value = lambda t: df.select(series.expression(t, df.columns).alias("x")).first().x
    assert value("a.b * a + max(a, 10) - -1") == 17.0
    assert value("2 ** 3 ** 1 + avg(1, 3) + c") == 10.0
    assert value("a / c") is None
    for bad in ("a +", "__import__('os')", "nope(1)", "missing", "1 2"):
        with pytest.raises(ValueError):
            series.expression(bad, df.columns)


def test_counters_tell_all_errors(spark):
    df = spark.createDataFrame([(1.0,)], ["a"])
    with pytest.raises(ValueError, match="x: .*; y: "):
        series.counters(df, [{"target": "x", "alias": "none"}, {"target": "y", "expr": "later"}, {"target": "later", "expr": "a"}])


def test_columns_by_prefix():
    assert series.choose(["ab", "b", "abc"], ["a"], [".*c"]) == ["ab"]
    assert series.choose(["ab"], [], []) == ["ab"]
    assert series.choose(["ab"], [], [], none_if_empty=True) == []


def test_merge_adjacent_at_random(spark):
    rng, rows = random.Random(1), []
    for k in range(8):
        at = 0
        for n in range(30):
            at += rng.choice([0, 0, 3])
            rows.append((k, n, at, at := at + rng.randint(1, 4), rng.choice([None, "x", "y"])))
    df = spark.createDataFrame(rows, "k int, n int, start bigint, end bigint, note string")
    want = []
    for k, n, a, b, note in rows:
        if want and want[-1][0] == k and want[-1][2] == a:
            want[-1][2], want[-1][3], want[-1][4] = b, want[-1][3] + 1, note or want[-1][4]
        else:
            want.append([k, a, b, 1, note])
    got = spans.merge_adjacent(df, ["k"], ["n"], last="note").select("k", "start", "end", "n", "note").collect()
    assert sorted(map(list, got), key=repr) == sorted(want, key=repr)


def test_fifo_at_random(spark):
    rng = random.Random(2)
    rows = [(k, n, rng.choice([0, 0, 1, 2]) if n % 5 else 0, rng.randint(0, 3) if n % 5 == 0 else None) for k in range(6) for n in range(40)]
    want = set()
    for k, n, _, allowed in rows:
        if allowed is not None:
            need = allowed + 1
            for k2, m, inc, _ in reversed([r for r in rows if r[0] == k and r[1] < n]):
                need -= inc
                if inc and need <= 0:
                    want.add((k, n, m))
                    break
    df = spark.createDataFrame(rows, "k bigint, n bigint, inc bigint, allowed bigint")
    assert {tuple(r) for r in links.fifo(df, ["k"], "n", "inc", "allowed").collect()} == want


def test_within_at_random(spark):
    rng = random.Random(3)
    points = [(n, rng.randint(-50, 2000)) for n in range(200)]
    spanned = [(n, s := rng.randint(-50, 2000), s + rng.choice([0, 1, 7, 100, 5000, -3])) for n in range(60)]
    p, s = spark.createDataFrame(points, "p bigint, ts bigint"), spark.createDataFrame(spanned, "s bigint, start bigint, end bigint")
    got = {(r.p, r.s) for r in links.within(p, s, [], 16).collect()}
    assert got == {(a, b) for a, t in points for b, x, y in spanned if x <= t <= y}
    assert "NestedLoop" not in links.within(p, s, [], 16)._jdf.queryExecution().executedPlan().toString().split("BroadcastNestedLoopJoin BuildRight, Cross")[-1]


def test_semaphore(spark):
    rows = [("k", 0, 0, "set", 0, 2), ("k", 1, 1, "signal", None, None), ("k", 2, 2, "wait", None, None), ("k", 2, 3, "signal", None, None), ("k", 5, 4, "wait", None, None), ("k", 6, 5, "signal", None, None)]
    df = spark.createDataFrame(rows, "slot string, ts bigint, seq bigint, kind string, data bigint, more bigint")
    got = [tuple(r)[1:] for r in state.semaphore_states(df, ["slot"]).orderBy("ts").collect()]
    assert got[:3] == [(0, 0, 2, 0, None), (1, 1, 2, 0, None), (2, 0, 2, 0, None)]
    assert got[3][0] == 5 and got[3][4] and len(got) == 4


def test_count_wraps():
    got = state.samples([(k, "signal", None, None) for k in range(65)])
    assert got[63][1] == 0 and got[64][1] == 1 and not math.isnan(got[0][1])


def test_packets(spark):
    df = spark.createDataFrame([(1, 5, 5), (2, 5, 9), (3, 4, None)], "id bigint, start bigint, end bigint")
    assert sorted(map(tuple, spans.slices(df).collect())) == [(1, "instant", 5), (2, "begin", 5), (2, "end", 9), (3, "instant", 4)]
    assert spans.first_per_key(df, ["start"], F.lit(False), ["id"]).count() == 2
