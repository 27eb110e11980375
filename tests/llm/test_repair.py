"""Conversation repair against an exhaustive search, whole and in chunks."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import duckdb
import pytest

from tidewright.llm import queries, repair

FOLDER = "/root/testdata/sf0.001"
TURNS = "conv_id bigint, turn bigint, role string, text string, n int, part string, chunks boolean"
SPACE = " \t\n\x0b\x0c\r"
GOOD = re.compile(r"(s?(ua)+)?")


def plain_faults(rows):
    seen, out = set(), []
    for role, text in rows:
        end = text.rstrip(SPACE)[-1:]
        out.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else "")
        seen.add((role, text))
    return out


def every_repair(rows):
    """The least (cost, audit, turns) of all edits, one by one."""
    inserts = [(), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")]
    choices = []
    for (role, text), wrong in zip(rows, plain_faults(rows), strict=True):
        more = 3 if wrong == "truncated" else 0
        mine = [(4, "D", [])]
        if wrong not in ("blank", "duplicate"):
            mine += [(more, "K", [(role, text)])] + [(3 + more, "R", [(r, text)]) for r in ("user", "assistant")]
        choices.append(mine)
    gaps = [[(3 * len(x), "I" * len(x), [(r, "") for r in x]) for x in inserts]] * (len(rows) + 1)
    best = None
    for picked in itertools.product(*[x for pair in itertools.zip_longest(gaps, choices) for x in pair if x is not None]):
        turns = [t for p in picked for t in p[2]]
        if all(t[0] for t in turns) and GOOD.fullmatch("".join(t[0][0] for t in turns)):
            found = (sum(p[0] for p in picked), "".join(p[1] for p in picked))
            if best is None or found < best[:2]:
                best = (*found, turns)
    return best


def searched(rows):
    """The same by uniform-cost search, for longer conversations."""
    faults, heap, done = plain_faults(rows), [(0, "", 0, 0, ())], set()
    step = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
    while heap:
        cost, audit, at, state, turns = heapq.heappop(heap)
        if at == len(rows) and state in (0, 3):
            return cost, audit, list(turns)
        if (at, state) in done:
            continue
        done.add((at, state))
        for name in ("user", "assistant"):
            if name[0] in step[state]:
                heapq.heappush(heap, (cost + 3, audit + "I", at, step[state][name[0]], (*turns, (name, ""))))
        if at < len(rows):
            (role, text), wrong = rows[at], faults[at]
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, state, turns))
            if wrong in ("", "truncated"):
                more = 3 if wrong else 0
                if role[:1] in step[state]:
                    heapq.heappush(heap, (cost + more, audit + "K", at + 1, step[state][role[0]], (*turns, (role, text))))
                for name in ("user", "assistant"):
                    if name[0] in step[state]:
                        heapq.heappush(heap, (cost + more + 3, audit + "R", at + 1, step[state][name[0]], (*turns, (name, text))))
    return None


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fate == 4:
            role = "user"
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        out += [] if fate == 0 else [(conv, turn, role, text)] * (2 if fate == 3 else 1)
    return out


def plain_audit(rows, damage=True, find=searched):
    out, convs = [], {r[0] for r in rows}
    rows = plain_damage(rows) if damage else rows
    for conv in convs:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest()))
        turns, pairs = [r[1] for r in mine if r[1] is not None], [r[2:] for r in mine]
        faults, letters = plain_faults(pairs), [r[0][:1] for r in pairs]
        cost, audit, repaired = find(pairs)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(letters))
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
        out.append((conv, gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, sha))
    return sorted(map(repr, out))


def random_rows(rng, convs, most):
    rows = []
    for conv in range(convs):
        for turn in range(rng.randint(1, most)):
            text = rng.choice(["Yes.", "No!", "Cut off", " ", "", "What? \n", "a\x85", "é.", None] + [f"t{k}." for k in range(9)])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 1, None]), rng.choice(["user", "assistant"] * 4 + ["system", "tool", "", None, "User", "unit"]), text))
    return rows + [(None, None, None, None), (None, 1, "user", "Hi."), (-4, 5, "assistant", "x" * 100_000 + ".")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "p", True) for r in rows], TURNS).repartition(5)


def rows_from(df):
    return sorted(repr(tuple(r)) for r in df.collect())


def test_search_equals_all_edits():
    rng = random.Random(0)
    for _ in range(120):
        rows = [(rng.choice(["user", "assistant", "system", "tool", ""]), rng.choice(["A.", "A.", "B", " ", "C!"])) for _ in range(rng.randint(0, 3))]
        want = every_repair(rows)
        assert searched(rows) == want
        faults = plain_faults(rows)
        cost, edits = repair.ended(repair.shortest([r for r, _ in rows], faults))
        assert (cost, repair.audit_of(edits), repair.applied(edits, *map(list, zip(*rows, strict=True))) if rows else []) == want


@pytest.mark.parametrize("seed, sizes", [(1, {}), (2, {"rows": 1, "fan": 2}), (3, {"rows": 3, "chars": 20, "fan": 3})])
def test_against_search(spark, seed, sizes):
    rows = random_rows(random.Random(seed), 60, 14 if sizes else 7)
    assert rows_from(repair.repair_audit(repair.damaged(frame(spark, rows)), **sizes)) == plain_audit(rows)


def test_one_long_conversation(spark):
    """Most rows belong to one conversation; it is cut into many chunks and gives what one pass gives."""
    rng = random.Random(7)
    rows = [(1, k, rng.choice(["user", "assistant", "system"]), rng.choice(["A.", "B", "", f"t{k}."])) for k in range(4000)] + [(2, 0, "user", "Hi."), (0, 3, "assistant", "So.")]
    docs = frame(spark, rows)
    chunks = repair.chunks_of(docs, 100)
    assert chunks.agg({"n": "max"}).first()[0] <= 100
    plain = [(r, t) for _, _, r, t in rows[:4000]]
    cost, edits = repair.ended(repair.shortest([r for r, _ in plain], plain_faults(plain)))
    turns = repair.applied(edits, *map(list, zip(*plain, strict=True)))
    got = {r.conv_id: r for r in repair.repair_audit(docs, 100, 1 << 20, 4).collect()}
    assert (got[1].cost, got[1].audit) == (cost, repair.audit_of(edits))
    assert got[1].repaired_sha256 == hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()
    made = [(r.role, r.text) for r in repair.repaired_turns(docs).orderBy("part", "k", "place").collect() if r.conv_id == 1]
    assert made == turns and GOOD.fullmatch("".join(r[0] for r, _ in made))


def test_odd_tables(spark):
    none = frame(spark, [(1, 1, "user", "x")]).limit(0)
    assert repair.repair_audit(repair.damaged(none)).collect() == []
    gone = [k for k in range(200) if zlib.crc32(f"{k}:0".encode()) % 20 == 0]
    rows = [(k, 0, "user", "Hi.") for k in gone]
    empty = hashlib.sha256(b"").hexdigest()
    assert {tuple(r)[1:] for r in repair.repair_audit(repair.damaged(frame(spark, rows))).collect()} == {(0, 0, 0, 0, 0, 0, "", empty)}
    nulls = [(None, None, None, None)] * 50
    assert rows_from(repair.repair_audit(frame(spark, nulls), rows=4)) == plain_audit([(None, None, " ", " ")] * 50, damage=False)


def test_query_against_sql(spark, tmp_path):
    rows = random_rows(random.Random(11), 80, 7)
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(str(tmp_path / "odd/conversations.parquet"))
    for folder, files in ((f"{tmp_path}/odd", "/*.parquet"), (FOLDER, "")):
        con = duckdb.connect()
        con.sql(f"create view conversations as select * from '{folder}/conversations.parquet{files}'")
        want = con.sql(queries.SQL["op13_conversation_repair"])
        got = queries.op13_conversation_repair(spark, folder)
        assert got.columns == want.columns
        assert rows_from(got) == sorted(map(repr, want.fetchall()))
