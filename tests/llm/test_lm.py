"""Language-model scores against a plain model, over blocks of every size."""

import math
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from tidewright.llm import lm, queries

FOLDER = "/root/testdata/sf0.001"
ODD = [None, "", " \n\t ", "one", "One two ONE two", "\x1c a\x1fb \x85c\xa0d e\x0bf\x0cg", "a\x00b É é İ", "word " * 500, " " * 300 + "late", "x" * 400 + " " + "y" * 400 + " z", "a b " * 200 + "b a"]


def plain_scores(rows, order, prior, fold=lm.HELD_OUT):
    texts = []
    for doc_id, text in rows:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        held = doc_id is not None and zlib.crc32(str(doc_id).encode()) % fold[0] == fold[1]
        texts.append((doc_id, held, ["<s>"] + re.findall(r"[^\x20\x09-\x0D]+", lower) + ["</s>"]))
    grams, after = Counter(), Counter()
    for _, held, t in texts:
        for k in range(1, len(t)):
            for n in range(min(order, k + 1) if not held else 0):
                grams[tuple(t[k - n : k + 1])] += 1
                after[tuple(t[k - n : k])] += 1
    n_all, v = after[()], sum(len(g) == 1 for g in grams)

    def p(h, w):
        if not h:
            return (grams[(w,)] + 1) / (n_all + v + 1)
        return (grams[(*h, w)] + prior * p(h[1:], w)) / (after[h] + prior)

    out = []
    for doc_id, held, t in texts:
        tokens = range(1, len(t))
        score = sum(math.log10(p(tuple(t[max(0, k - order + 1) : k]), t[k])) for k in tokens)
        base = sum(math.log10(p((), t[k])) for k in tokens)
        out.append((doc_id, held, len(t) - 1, sum(grams[(t[k],)] > 0 for k in tokens), n_all, base, score))
    return out


def rows_of(seed, n=60):
    rng = random.Random(seed)
    words = ["The", "the", "a", "b", "cat", "é", "sat."] + [f"w{k}" for k in range(20)]
    rows = [(k, rng.choice([" ", "\n", "  "]).join(rng.choices(words, k=rng.randint(0, 30)))) for k in range(n)]
    return rows + list(enumerate(ODD, n)) + [(2, "again a b"), (2, "again a b"), (None, "no id a b"), (-3, "less")]


def check(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:5], round(r[5], 5))
    got, want = sorted((tuple(r) for r in got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for a, b in zip(got, want, strict=True):
        assert a[5:] == pytest.approx(b[5:], abs=1e-8)


@pytest.mark.parametrize("order, block, bucket", [(1, 50, 7), (2, 1, 1 << 20), (2, 64, 50), (2, 1 << 20, 100), (3, 90, 40), (4, 30, 64)])
def test_against_plain(spark, order, block, bucket):
    rows = rows_of(order)
    docs = spark.createDataFrame([(k, t, 1, "x", True) for k, t in rows], "doc_id bigint, text string, row int, held string, block boolean").repartition(3)
    check(lm.lm_scores(docs, order=order, prior=3.0, block=block, bucket=bucket).collect(), plain_scores(rows, order, 3.0))


def test_without_rows_to_learn_from(spark):
    docs = spark.createDataFrame([(k, "a b") for k in range(200) if zlib.crc32(str(k).encode()) % 7 == 2], "doc_id bigint, text string")
    assert {tuple(r)[1:] for r in lm.lm_scores(docs).collect()} == {(True, 3, 0, 0, 0.0, 0.0)}
    assert lm.lm_scores(docs.limit(0)).collect() == []


def test_long_text_in_pieces(spark):
    """A text of 5 MB over many pieces scores as in one."""
    rng = random.Random(1)
    rows = [(0, " ".join(rng.choices(["ab", "cd", "ef", "gh"], k=1_700_000))), (1, "ab cd ef"), (2, "gh " * 9)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    whole, cut = ({r.doc_id: r for r in lm.lm_scores(docs, block=b).collect()} for b in (1 << 24, 1 << 18))
    for k in whole:
        assert whole[k][:5] == cut[k][:5] and cut[k][5:] == pytest.approx(whole[k][5:], rel=1e-9)


def test_query_against_sql(spark, tmp_path):
    spark.createDataFrame(rows_of(9), "doc_id bigint, text string").write.parquet(str(tmp_path / "odd/documents.parquet"))
    for folder, files in ((f"{tmp_path}/odd", "/*.parquet"), (FOLDER, "")):
        con = duckdb.connect()
        con.sql(f"create view documents as select * from '{folder}/documents.parquet{files}'")
        want = con.sql(queries.SQL["op12_lm_scores"])
        got = queries.op12_lm_scores(spark, folder)
        assert got.columns == want.columns
        check(got.collect(), want.fetchall())


def test_better_than_base(spark):
    held = queries.op12_lm_scores(spark, "/root/testdata/sf0.01").filter("held_out").selectExpr("sum(score) s", "sum(base_score) b", "sum(n_tokens) n").first()
    assert held.s / held.n > held.b / held.n + 0.2
