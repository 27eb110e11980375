"""Connection rules, and lines parted by form."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tidewright.operators import rules
from tidewright.sources import paths

EVENTS = "task int, name string, ts bigint, ordinal bigint, event_id bigint"
TASKS = "task int, start bigint, end bigint, slot bigint, group bigint, cluster string"


def made(rng):
    tasks = [(k, s := rng.randint(0, 50), s + rng.choice([0, 10, 400]), rng.choice([0, 1, 2, None]), rng.choice([0, 1, None]), rng.choice(["x", "y", None])) for k in range(60)]
    events, n = [], itertools.count()
    for k in range(60):
        for name in "abc":
            events += [(k, name, rng.randint(0, 80), i, next(n)) for i in range(rng.randint(0, 5))]
    return events, tasks


def plain(events, tasks, table):
    out, of = [], {t[0]: t for t in tasks}
    for k, r in enumerate(table):
        for task, name, ts, i, source in events:
            _, _, _, slot, group, cluster = of[task]
            cond = True if r.cond is None else eval(str(r.cond), {}, {"i": i})
            if name != r.src or not cond or (r.src_slot is not None and slot != r.src_slot) or (r.src_group is not None and group != r.src_group) or (r.src_cluster is not None and cluster != r.src_cluster):
                continue
            want = group if r.dst_group is None else r.dst_group
            for t in tasks:
                if t[1] <= ts <= t[2] and want is not None and t[4] == want and (r.dst_slot is None or t[3] == r.dst_slot) and (r.dst_cluster is None or t[5] == r.dst_cluster):
                    n = eval(str(r.count), {}, {"i": i, "abs": abs})
                    out += [(k, source, g[4]) for g in events if g[0] == t[0] and g[1] == r.dst and g[3] == n]
    return sorted(out)


def test_connect(spark):
    events, tasks = made(random.Random(3))
    table = [
        rules.Rule("a", "b"), rules.Rule("a", "c", "i // 2", "i > 0 and not i == 2", src_slot=1), rules.Rule("b", "a", "abs(i - 3)", src_cluster="x", dst_cluster="y", dst_group=1),
        rules.Rule("c", "c", 0, 1, dst_slot=2, src_group=0), rules.Rule("c", "a", 0, 0), rules.Rule("b", "b", "i - 1"),
    ]
    got = rules.connect(spark.createDataFrame(events, EVENTS), spark.createDataFrame(tasks, TASKS), table, 16)
    want = plain(events, tasks, table)
    assert sorted(tuple(r)[:3] for r in got.collect()) == want and {w[0] for w in want} == {0, 1, 2, 3, 5}
    assert got.select("flow").distinct().count() == got.count()


@pytest.mark.parametrize("bad, told", [({"cond": "j > 1"}, "may not hold"), ({"cond": "i >"}, "isn't an expression"), ({"count": "i > 1"}, "has to be a number"), ({"cond": "java_method('a', 'b')"}, "may not hold"), ({"count": "(i"}, "isn't an expression")])
def test_a_bad_expression_is_told_with_its_rule(spark, bad, told):
    with pytest.raises(ValueError, match=f"rule go -> stop.*{told}"):
        rules.compiled(spark, [rules.Rule("a", "b"), rules.Rule("go", "stop", **bad)])


def test_parted_lines(spark, tmp_path):
    counter = paths.Form("counter", r"(?P<path>[\w.]+): (?P<name>\w+)=(?P<value>\d+) TS=(?P<ts>\d+)", (("value", "int"),))
    event = paths.Form("event", r"(?P<path>[\w.]+): (?P<name>\w+)(?: (?P<extra>.*))? TS=(?P<ts>\d+)", unless=("extra", "="))
    lines = ["a.b.c: n=5 TS=7", "a: n=99999999999 TS=7", "x.y: go TS=1", "x.y: go far away TS=2", "x.y: go k=v TS=3", "nothing", "", None, "a.b: n=1 TS=99999999999999999999", "a.b: n=2 TS=8 "]
    df = paths.parted(spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "id int, line string"), [counter, event])
    assert [(r.kind, r.path, r.node, r.depth, r.name, r.ts) for r in df.orderBy("id").collect()[:4]] == [("counter", "a.b.c", "c", 3, "n", 7), ("reject", None, None, None, None, None), ("event", "x.y", "y", 2, "go", 1), ("event", "x.y", "y", 2, "go", 2)]
    assert [tuple(r) for r in paths.view(df, counter).collect()] == [("a.b.c", "c", "n", 7, 5)] and paths.view(df, counter).schema["value"].dataType.simpleString() == "int"
    assert sorted((r.extra or "") for r in paths.view(df, event).collect()) == ["", "far away"]
    assert paths.rejects(df).count() == 7
    # All outputs of one write come from one scan.
    df.select("id", "line").write.parquet(str(tmp_path / "in"))
    scan = paths.parted(spark.read.parquet(str(tmp_path / "in")), [counter, event])
    assert scan._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1
    scan.select("kind", "path", "ts", F.col("payload").cast("string").alias("payload")).write.partitionBy("kind").parquet(str(tmp_path / "out"))
    assert {r.kind: r["count"] for r in spark.read.parquet(str(tmp_path / "out")).groupBy("kind").count().collect()} == {"counter": 1, "event": 2, "reject": 7}
    with pytest.raises(ValueError, match="form odd has no group ts"):
        paths.Form("odd", r"(?P<path>a)(?P<name>b)")
