"""The split state machine against one sequential run."""

import random

import pytest
from pyspark.sql import functions as F

from tidewright.operators import state

SCHEMA = "slot string, sem int, ts bigint, seq bigint, kind string, data bigint, more bigint"


def operations(seed, n, slots=("a", "hot", "hot", "hot", None)):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        kind = rng.choices(["signal", "wait", "limit", "set", "other"], [20, 3 if seed % 2 else 0, 2, 1, 1])[0]
        rows.append((rng.choice(slots), rng.choice([1, 2]), rng.randint(0, n // 3), k, kind, rng.choice([None, 0, 1, 2, 5, 63, 64, 70, 200]), rng.choice([None, 0, 1, 3, 64])))
    return rows


def plain(rows, checked=False):
    out = []
    for key in {r[:2] for r in rows}:
        mine = sorted((r for r in rows if r[:2] == key and r[4] in state.PRIORITY), key=lambda r: (r[2], state.PRIORITY[r[4]], r[3]))
        out += [(*key, *s) for s in state.samples(((r[2], r[4], r[5], r[6]) for r in mine), state=state.Semaphore(checked=checked))]
    return sorted(map(repr, out))


@pytest.mark.parametrize("seed, n, rows, fan, checked", [(0, 800, 1 << 20, 64, False), (0, 800, 7, 3, False), (2, 600, 1, 4, True), (1, 400, 5, 2, False), (3, 300, 2, 64, True)])
def test_slices_equal_one_run(spark, seed, n, rows, fan, checked):
    ops = operations(seed, n)
    df = spark.createDataFrame(ops, SCHEMA).repartition(5)
    got = state.semaphore_states(df, ["slot", "sem"], checked=checked, rows=rows, fan=fan)
    assert sorted(repr(tuple(r)) for r in got.collect()) == plain(ops, checked)


def test_64_slices_and_no_task_per_key(spark):
    ops = operations(4, 2900, slots=("hot",))
    df = spark.createDataFrame([(*r[:1], 1, *r[2:]) for r in ops], SCHEMA)
    assert state.slices_of(df, ["slot", "sem"], 40).count() >= 64
    one, many = (state.semaphore_states(df, ["slot", "sem"], rows=k) for k in (1 << 20, 40))
    assert sorted(map(tuple, one.collect()), key=str) == sorted(map(tuple, many.collect()), key=str)
    assert "FlatMapGroups" not in many._jdf.queryExecution().optimizedPlan().toString()


def test_transition_is_the_machine():
    ops = [(r[4], r[5], r[6]) for r in operations(5, 60) if r[4] in state.PRIORITY]
    every = state.Transition(3)
    for op in ops:
        every.apply(*op)
    for number, after in enumerate(every.table()[:-1]):
        one = state._at(number, 3, 64)
        for op in ops:
            if not one.error:
                one.apply(*op)
        assert after == (256 if one.error else (one.valid * 2 + one.done) * 64 + one.count)


def test_empty(spark):
    assert state.semaphore_states(spark.createDataFrame([], SCHEMA), ["slot", "sem"]).count() == 0


def test_masks_and_destinations(spark):
    rows = [("a", None, 5, 1, "wait", 0b101, None), ("a", 2, 5, 2, "wait", None, None), ("a", 1, 1, 3, "signal", None, "b"), ("a", 1, 2, 4, "signal", None, "gone"), ("b", 1, 0, 5, "limit", None, "a"), ("a", 3, 7, 6, "signal", None, None)]
    df = spark.createDataFrame(rows, "slot string, sem int, ts bigint, seq bigint, kind string, mask int, target string")
    masked = state.wait_mask(df, "mask", range(1, 5))
    assert sorted((r.seq, r.sem) for r in masked.collect()) == [(1, 1), (1, 3), (2, 2), (3, 1), (4, 1), (5, 1), (6, 3)]
    known = spark.createDataFrame([("a",), ("b",)], "slot string")
    kept, lost = state.routed(masked, ["slot", "sem"], {"slot": "target"}, known)
    assert sorted((r.seq, r.slot) for r in kept.collect()) == [(1, "a"), (1, "a"), (2, "a"), (3, "b"), (5, "b"), (6, "a")]
    assert [(r.seq, r.slot) for r in lost.collect()] == [(4, "gone")]
    assert state.routed(masked, ["slot"], {"slot": "target"})[0].filter(F.col("slot") == "gone").count() == 1
