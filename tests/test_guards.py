"""Guards that ride on a pass, files by their names, and weights of a version."""

import pytest
from pyspark.sql import functions as F

from tidewright.operators import guards
from tidewright.sources import located


def test_duplicate_names_are_told(spark, tmp_path):
    rows = [("a", 1), ("b", 2), ("c", 3)]
    spark.createDataFrame(rows, "name string, n int").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    held = guards.unique(df, "name", ["n"])
    assert sorted(map(tuple, held.collect())) == rows
    assert held._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1
    with pytest.raises(Exception, match="name isn't unique: b occurs 2 times"):
        guards.unique(df.union(df.filter("name = 'b'")), "name").collect()
    with pytest.raises(Exception, match="n is small for c"):
        guards.fatal(df, F.col("n") < 3, F.concat(F.lit("n is small for "), "name")).collect()


def test_counts_ride_on_the_pass(spark):
    df = spark.createDataFrame([("a", 1), ("b", None), ("c", 30), (None, -1)], "name string, n int")
    counted = guards.Counted(df, {"n is there": F.col("n").isNotNull(), "n is below ten": F.col("n") < 10, "always": F.lit(True)}, "name")
    assert counted.df.select("name", "n").collect() == df.collect()
    assert counted.told() == {"n is there": (1, "b", "b"), "n is below ten": (2, "b", "c"), "always": (0, None, None)}
    with pytest.raises(guards.Broken, match="n is there: 1 rows, from b to b; n is below ten: 2 rows"):
        counted.enforce()


def logs(tmp_path):
    for n, text in {"log_e0_s1.txt": "x\ny\n", "log_e0_s2.txt": "z", "log_e11_s1.txt": "p\r\nq\r\n\r\nr"}.items():
        (tmp_path / n).write_bytes(text.encode())
    return str(tmp_path), r"log_e(?P<engine>\d+)_s(?P<side>\d)\.txt"


def test_files_by_name(spark, tmp_path):
    folder, pattern = logs(tmp_path)
    every = located.read_located(spark, folder, pattern, {"engine": "int"})
    assert sorted((r.engine, r.side, r.line_no, r.line) for r in every.collect()) == [(0, "1", 1, "x"), (0, "1", 2, "y"), (0, "2", 1, "z"), (11, "1", 1, "p"), (11, "1", 2, "q"), (11, "1", 3, ""), (11, "1", 4, "r")]
    some = located.read_located(spark, folder, pattern, keep={"side": [1]}, ignore={"engine": [11]})
    assert {r.line for r in some.collect()} == {"x", "y"} and [f.rsplit("/", 1)[-1] for f in some.inputFiles()] == ["log_e0_s1.txt"]
    assert located.read_located(spark, folder, pattern, keep={"side": [9]}).count() == 0
    (tmp_path / "other.txt").write_text("")
    with pytest.raises(ValueError, match="other.txt doesn't fit"):
        located.read_located(spark, folder, pattern)


def test_later_lines_go(spark):
    rows = [("f", "a", 1, "go"), ("f", "a", 2, "ignore"), ("f", "a", 3, "late"), ("f", "b", 2, "go"), ("g", "a", 9, "go"), ("f", None, 1, "ignore"), ("f", None, 2, "late"), ("f", "a", 4, "ignore")]
    df = spark.createDataFrame(rows, "file string, task string, line_no bigint, line string")
    got = located.drop_later(df, ["file", "task"], "line_no", F.col("line") == "ignore")
    assert sorted(map(tuple, got.collect())) == [("f", "a", 1, "go"), ("f", "b", 2, "go"), ("g", "a", 9, "go")]


def test_weights_of_a_version(spark, tmp_path):
    (tmp_path / "w.json").write_text('{"version": 1, "kind": "k", "counter": "c", "inc": 2}\n\n{"version": 5, "kind": "k", "counter": "c", "inc": 7}\n')
    weights = located.read_weights(spark, str(tmp_path / "w.json"))
    rows = spark.createDataFrame([(v, "k", "c") for v in (0, 1, 4, 5, 9)] + [(9, "other", "c")], "version bigint, kind string, counter string")
    for most in (10, 0):
        got = located.weighed(rows, weights, ["kind", "counter"], most=most)
        assert sorted((r.kind, r.version, r.inc) for r in got.collect()) == [("k", 0, None), ("k", 1, 2), ("k", 4, 2), ("k", 5, 7), ("k", 9, 7), ("other", 9, None)]
    (tmp_path / "w.json").write_text('{"version": 1, "kind": "k", "counter": "c", "inc": "much"}\n')
    with pytest.raises(Exception, match="not a weight.*much"):
        located.read_weights(spark, str(tmp_path / "w.json")).collect()
