"""Definitions of counters from files, the order of columns, and empty columns."""

import json

import pytest

from tidewright.operators import links
from tidewright.sources import counters

YAML = """
config:
  view: {view}
stats:
  - select: a
  - deselect: ab
  - alias: b
    target: two
  - stat: most
    regex: "[ab]"
    op: max
  - stat: twice
    expr: two * 2
"""


@pytest.mark.parametrize("view, names", [("default", ["a", "ac", "two", "most", "twice"]), ("defined_first", ["two", "most", "twice", "a", "ac"]), ("defined_only", ["two", "most", "twice", "a", "ac"])])
def test_views(spark, view, names):
    wide = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0)], "a double, ab double, ac double, b double")
    config = counters.parse_config(YAML.replace("{view}", view), "yaml")
    got = config.apply(wide)
    assert got.columns == names and got.first().asDict() == {"a": 1, "ac": 3, "two": 4, "most": 4, "twice": 8}
    config.select = []
    assert config.apply(wide, ["b"]).columns == {"default": ["b", "a", "ac", "two", "most", "twice"], "defined_first": ["b", "two", "most", "twice", "a", "ac"], "defined_only": ["b", "two", "most", "twice"]}[view]


def test_files(spark, tmp_path):
    (tmp_path / "c.txt").write_text("# remark\n\na\n! ab\n")
    assert counters.read_config(spark, str(tmp_path / "c.txt")) == counters.Config(["a"], ["ab"])
    (tmp_path / "c.json").write_text(json.dumps({"stats": [{"stat": "s", "regex": "a"}]}))
    assert counters.read_config(spark, str(tmp_path / "c.json")).defined == [{"target": "s", "regex": "a", "op": "sum"}]
    (tmp_path / "empty.yaml").write_text("")
    assert counters.read_config(spark, str(tmp_path / "empty.yaml")) == counters.Config()


def test_all_errors_are_told():
    stats = [{"select": None}, {"alias": "a"}, {"stat": "s", "regex": "(", "op": "sum"}, {"stat": "s", "expr": "1"}, {"stat": "t", "regex": "a", "op": "first"}, {"what": 1}, 3]
    with pytest.raises(ValueError) as told:
        counters.parse_config(json.dumps({"config": {"view": "all"}, "stats": stats}), "json")
    for part in ("config.view: all", "stats[0]: select", "stats[1]: an alias without", "stats[4]: op first", "stats[5]: neither", "stats[6]: not a mapping", "s: defined 2 times", "(: "):
        assert part in str(told.value)
    for text in ("{", "[1]", '{"stats": 1}'):
        with pytest.raises(ValueError):
            counters.parse_config(text, "json")


def test_empty_columns(spark):
    df = spark.createDataFrame([(1, None, None, "x"), (2, None, 3.5, None)], "task int, none string, some double, name string")
    assert links.without_empty(df).columns == ["task", "some", "name"]
    assert links.without_empty(df, ["none"]).columns == df.columns and links.without_empty(df.limit(0), ["task"]).columns == ["task"]
