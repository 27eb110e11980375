"""The multi-pattern scan against trying every pattern on every line."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewright.sources import patterns as pt

MANY = [pt.Pattern("event", f"e{k:04}", rf"(\d+) ns .*?code{k:04}x (\w+)", rank=k % 3) for k in range(1000)]


def plain(lines, table, first):
    out = []
    for line in lines:
        found, done = [], set()
        for p in sorted(table, key=lambda p: (p.kind, p.rank, p.name, p.expression)):
            m = (re.match if p.whole else re.search)(p.expression, line) if line is not None and p.kind not in done else None
            if m:
                found.append((p.kind, p.name, list(m.groups())))
                done |= {p.kind} & set(first)
        out.append(found)
    return out


@pytest.mark.parametrize(
    "expression, literal",
    [
        (r"abc", "abc"), (r"^abc$", "abc"), (r"a(bc)+d", "abc"), (r"(ab)?cde", "cde"), (r"ab|cd", None), (r"x(?:yz|w)longer", "longer"), (r"\d+ ns", " ns"), (r".*", None), (r"(?i)abc", None),
        (r"a{2}bcd", "bcd"), (r"(?P<n>ab)cd", "abcd"), (r"(?=abc)de", "de"), (r"(?!abc)de", "de"), (r"(?<!abc)de", "de"), (r"a\.b", "a.b"), (r"[a]bc", "abc"), (r"ab*?c", None), (r"(?i:abc)de", "de"), (r"ab(?:cd){0,2}", "ab"),
    ],
)
def test_required(expression, literal):
    assert pt.required(expression) == literal


PIECES = st.sampled_from(["a", "b", "ab", "(ab)", "(?:b|a)", "a+", "b*", "(ab)+", "[ab]", ".", "a?", "(?:ab){2}", "c{1,2}", "^", "$", r"\w", "(?=a)", "(?i:a)"])


@settings(max_examples=300, deadline=None)
@given(st.lists(PIECES, max_size=6), st.text("abcAB", max_size=12))
def test_every_match_holds_the_literal(parts, line):
    expression = "".join(parts)
    literal = pt.required(expression)
    if literal and re.search(expression, line):
        assert literal in line


def test_scan(spark):
    rng = random.Random(4)
    lines = [f"{k} ns at code{rng.randint(0, 1300):04}x {rng.choice(['go', 'stop'])} count={k}" for k in range(400)] + [None, "", "12 ns code0007x code0001x two", "count=5", "é count=x"]
    table = MANY + [
        pt.Pattern("counter", "count", r".*?count=(\d+)"), pt.Pattern("counter", "other", r".*?count=(\w+)", rank=1), pt.Pattern("mark", "stop", r"\bstop\b", whole=False), pt.Pattern("mark", "any", r".", whole=False), pt.Pattern("mark", "opt", r"(x)?(y)?e\b", whole=False),
    ]
    assert [p.name for p in pt.loose(table)] == ["any", "opt"]
    df = spark.createDataFrame([(k, x, "f") for k, x in enumerate(lines)], "id int, line string, found_at string").repartition(3)
    scanned = pt.scan(df, table, ("event", "counter"))
    got = {r.id: [(f.kind, f.name, f.groups) for f in r.found] for r in scanned.collect()}
    assert [got[k] for k in range(len(lines))] == plain(lines, table, ("event", "counter"))
    # Events and counters come from one read of the lines.
    both = pt.of_kind(scanned, "event").select("id", pt.group(2).alias("what"))
    assert both.count() == sum(any(f[0] == "event" for f in g) for g in got.values()) > 100
    plan = scanned._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan


def test_only_candidates_are_tried(monkeypatch):
    tried = []
    real = pt.Pattern.groups_in
    monkeypatch.setattr(pt.Pattern, "groups_in", lambda self, line: tried.append(self.name) or real(self, line))
    find = pt.matcher(MANY)
    for k in range(100):
        find(f"1 ns code{k:04}x go")
    assert len(tried) == 100


def test_errors(spark):
    with pytest.raises(ValueError, match="pattern bad of event"):
        pt.Pattern("event", "bad", "(")
    rows = spark.createDataFrame([("event", "a", "x+y"), ("event", "b", "yx")], "kind string, name string, expression string")
    assert {p.name for p in pt.table_of(rows)} == {"a", "b"}
    with pytest.raises(ValueError, match="more than"):
        pt.table_of(rows.withColumn("expression", F.repeat("expression", F.lit(pt.MOST))))


@pytest.mark.parametrize(("most", "shapes"), [(1, pt.SHAPES), (1, 3), (500, pt.SHAPES), (pt.MOST, pt.SHAPES)])
def test_tables_of_any_size(spark, monkeypatch, most, shapes):
    """Joined with the literals, by forms of any width, with loose patterns broadcast or crossed, as by one automaton."""
    monkeypatch.setattr(pt, "SHAPES", shapes)
    table = [*MANY[:100], pt.Pattern("any", "digits", r"\d+", whole=False), pt.Pattern("any", "end", "x y$", whole=False), pt.Pattern("event", "all", ".*z.*", 3), pt.Pattern("wide", "é", "über (.)", whole=False)]
    lines = [f"{k} ns a code{k % 130:04}x w{k} code{(k + 1) % 130:04}x v" for k in range(150)] + ["", None, "x y", "ab", "ns über ß", "z", "z", "12 ns code0001x"]
    rows = spark.createDataFrame([(p.kind, p.name, p.expression, p.rank, p.whole) for p in table], "kind string, name string, expression string, rank int, whole boolean")
    got = pt.scan_table(spark.createDataFrame(list(enumerate(lines)), "id int, line string"), rows, ("event",), most=most)
    assert got.columns == ["id", "line", "found"]
    assert [[(f.kind, f.name, f.groups) for f in r.found] for r in got.orderBy("id").collect()] == plain(lines, table, ("event",))


def test_pattern_finds_with_more_patterns_than_are_broadcast(spark, monkeypatch):
    from tidewright.plans import merging

    rows = lambda: sorted(merging.pattern_finds(spark, "/root/testdata/sf0.001").collect())
    want = rows()
    monkeypatch.setattr(pt, "MOST", 1000)
    assert rows() == want
