"""Fill in the middle against a plain version, on odd and long texts."""

import hashlib
import random
import re

import duckdb

from tidewright.llm import fim, queries

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, n string, form int, marked string, row bigint, output string"


def plain_fim(doc_id, text, seed=7, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (len(units) + 1) for x in h[:2])
    parts = ["".join(x) for x in (units[:a], units[a:b], units[b:])]
    if not text or any(x in text for x in fim.MARKERS) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, None, text
    prefix, middle, suffix = parts
    if h[3] % 100 < spm:
        return len(units), "spm", *parts, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(units), "psm", *parts, f"<P>{prefix}<S>{suffix}<M>{middle}"


ODD = [
    None, "", "\n", "\n\n\n", "one", "one\n", "a\nb", "a\r\nb\rc\n", "<P>", "a<S>\nb", "x\n<M>", "<\nP>\nS>", "<<\n<\n", "\x01\n\x02\n\x02d\x01e\n\x02\x02", "\x02e\n\x01\x01", "\x02d",
    "é ü\n\U0001f600\n \n\x85 \x0b\n$0\\1\n", " \n \n", "a" * 100_000, "\n" * 30_000, "line of some words\n" * 300_000,
]


def rows_of():
    rng = random.Random(5)
    made = ["".join(rng.choices("ab<PSM>\n\n\x01\x02ed", k=rng.randint(0, 40))) for _ in range(300)]
    return [(k, t) for k, t in enumerate(ODD + made)] + [(3, "twice\nso\n")] * 2 + [(None, "no\nid\n"), (-5, "less\nthan\nnothing")]


def test_against_plain(spark):
    rows = rows_of()
    docs = spark.createDataFrame([(k, t, "x", 1, "m", 2, "o") for k, t in rows], DOCS).repartition(4)
    for rate, spm in ((100, 50), (40, 0), (0, 50)):
        made = fim.fill_in_middle(docs, rate=rate, spm=spm).withColumn("back", fim.restored(fim.F.col("output"), fim.F.col("form"))).collect()
        got = sorted(repr((r.doc_id, r.n, r.form, r.prefix, r.middle, r.suffix, r.output, r.back)) for r in made)
        assert got == sorted(repr((k, *plain_fim(k, t, rate=rate, spm=spm), t or "")) for k, t in rows)
        assert {r.row for r in made} == {2} and made[0].marked == "m"
    assert fim.fill_in_middle(docs.limit(0)).count() == 0


def test_digests_against_sql(spark, tmp_path):
    spark.createDataFrame([(k, t) for k, t in rows_of()], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op11_fill_in_middle(spark, str(tmp_path))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(queries.SQL["op11_fill_in_middle"])
    assert got.columns == want.columns
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, want.fetchall()))
    assert all(r.restored_sha256 == hashlib.sha256((t or "").encode()).hexdigest() for r in got.collect() for k, t in rows_of() if k == r.doc_id and k not in (3,))


def test_jvm_only(spark):
    plan = queries.op11_fill_in_middle(spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
