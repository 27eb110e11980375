"""States of files merge in any grouping, in memory and in a store."""

import random

import pytest
from pyspark.sql import functions as F

from tidewright.operators import partials

BY = ["key", "slice"]


def rules():
    return [
        partials.lowest("low", F.col("start")), partials.highest("high", F.col("end")), partials.total("n", F.lit(1)), partials.later("label", F.col("label"), F.col("source")),
        partials.listed("all", F.col("start"), F.col("end"), F.col("label")), partials.covered("covers", F.col("start"), F.col("end")),
    ]


def made(spark, seed, n=300):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        start = rng.randint(-50, 400)
        rows.append((rng.choice(["a", "a", "b", None]), start, start + rng.choice([0, 1, 5, 40]), rng.choice(["x", "y", None]), k % 7))
    return rows, spark.createDataFrame(rows, "key string, start bigint, end bigint, label string, source int")


def plain(rows):
    out = {}
    for key, start, end, label, source in rows:
        k = start // 100
        while True:
            a, b = max(start, k * 100), min(end, (k + 1) * 100)
            out.setdefault((key, k), []).append((a, b, label, source))
            k += 1
            if k * 100 >= end:
                break
    done = {}
    none_first = lambda v: (v is not None, v or "")
    for at, got in out.items():
        covers = []
        for a, b in sorted((a, b) for a, b, _, _ in got if a < b):
            if covers and a <= covers[-1][1]:
                covers[-1] = (covers[-1][0], max(b, covers[-1][1]))
            else:
                covers.append((a, b))
        last = max(got, key=lambda g: (g[3], none_first(g[2])))
        done[at] = (min(g[0] for g in got), max(g[1] for g in got), len(got), last[2], sorted(((a, b, x) for a, b, x, _ in got), key=str), covers)
    return done


def shown(df):
    return {(r.key, r.slice): (r.low, r.high, r.n, r.label, sorted(map(tuple, r["all"]), key=str), [tuple(c) for c in r.covers]) for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_any_grouping(spark, seed):
    rows, df = made(spark, seed)
    df = partials.cut(df, "start", "end", 100)
    want = plain(rows)
    assert shown(partials.result(partials.state_of(df, BY, rules()), BY, rules())) == want
    states = [partials.state_of(df.filter(F.col("source") == k), BY, rules()) for k in range(7)]
    random.Random(seed).shuffle(states)
    left = partials.merged(states[:2], BY, rules())
    tree = partials.merged([partials.merged([left, states[2]], BY, rules()), partials.merged(states[3:], BY, rules())], BY, rules())
    assert shown(partials.result(tree, BY, rules())) == want
    lists = [[tuple(x) for x in r["all"]] for r in partials.result(tree, BY, rules()).collect()]
    assert all([x[0] for x in one] == sorted(x[0] for x in one) for one in lists)


def test_store(spark, tmp_path):
    rows, df = made(spark, 3, 120)
    df = partials.cut(df, "start", "end", 100)
    store = partials.Store(spark, str(tmp_path / "state"), BY, rules(), fan=3)
    with pytest.raises(ValueError):
        store.state()
    for k in (4, 0, 6, 2, 1, 5, 3):
        store.fold(df.filter(F.col("source") == k), f"file{k}")
    assert shown(store.result()) == plain(rows)
    assert len(store._manifest()[1]) == 3 and sorted(r.source for r in store.sources().collect()) == [f"file{k}" for k in range(7)]
    with pytest.raises(ValueError, match="file6"):
        store.fold(df, "file6")
    # A fold that ends before its manifest changes nothing, and what it left is deleted.
    broken = df.withColumn("end", F.raise_error(F.lit("broken")).cast("bigint"))
    with pytest.raises(Exception, match="broken"):
        store.fold(broken, "file9")
    assert shown(store.result()) == plain(rows)
    assert store.clean() >= 4 and shown(store.result()) == plain(rows)


def test_empty(spark):
    _, df = made(spark, 1)
    none = partials.cut(df.limit(0), "start", "end", 100)
    assert partials.merged([partials.state_of(none, BY, rules())] * 2, BY, rules()).count() == 0
