"""Each training-data operator against a plain version on small tables, and on odd input."""

import hashlib
import json
import math
import os
import random
import re
import time
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewright.llm import chat, decontaminate, embeddings, licenses, mixing, neardup, quality, queries, shared, tokens, toxicity, warc

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def docs_of(spark, texts, extra=""):
    """Documents with columns whose names may clash with those used inside."""
    rows = [(k, t, "en", None if k % 3 == 0 else f"s{k % 2}", len(t or ""), "x", 1, 2) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS + ", item string, score bigint, rep bigint")


ODD = [None, "", " \n\t ", "one", "One, TWO three!", "é ü word", "word " * 3000, "word " * 3000, "x" * 5000, "<|endoftext|> a", "a\x00b\x0bc"]


# 1


def plain_hits(texts, items, window=13):
    grams = {}
    for item, text in items:
        w = decontaminate.words(text)
        for at in range(max(1, len(w) - window + 1) if w else 0):
            grams.setdefault(tuple(w[at : at + window]), set()).update([] if item is None else [str(item)])
    out = []
    for text in texts:
        w, hit, found = decontaminate.words(text), set(), set()
        for n in {len(g) for g in grams}:
            for at in range(len(w) - n + 1):
                if (g := tuple(w[at : at + n])) in grams:
                    hit.update(range(at, at + n))
                    found |= grams[g]
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("seed", [0, 1])
def test_decontamination(spark, seed):
    rng = random.Random(seed)
    words = [chr(97 + k) for k in range(6)]
    make = lambda n: " ".join(rng.choices(words, k=n))
    items = [(10 - k if k else None, make(rng.choice([0, 1, 5, 12, 13, 14, 20]) if seed else rng.choice([13, 20]))) for k in range(10)] + [(3, None), (9, make(15))]
    texts = [make(rng.randint(0, 60)) + rng.choice(["", " " + (rng.choice(items)[1] or "")]) + " zzz " + make(8) for _ in range(60)] + ODD
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit(1))
    want = [(k, *x) for k, x in enumerate(plain_hits(texts, items))]
    got = decontaminate.contamination(docs_of(spark, texts), bench)
    assert sorted(map(tuple, got.collect())) == want
    # In several passes over a benchmark that is too large for one.
    spans = decontaminate.benchmark_spans(docs_of(spark, texts), bench, phrases=9)
    hits = {r.doc_id: sum(s.end - s.start for s in r.spans) for r in spans.collect()}
    assert hits == {k: x[1] for k, *x in want}
    for size in (9, 1 << 20):
        kept = decontaminate.unseen_documents(docs_of(spark, texts), bench, phrases=size)
        assert kept.columns == docs_of(spark, texts).columns
        assert sorted(r.doc_id for r in kept.collect()) == [k for k, *x in want if not x[4]]


def test_one_index_per_shard(monkeypatch):
    """Many rows share an index; a text longer than an index is searched in pieces, also across their cuts."""
    rng, made = random.Random(3), []
    texts = [" ".join(rng.choices("abcde", k=30)) for _ in range(5000)] + [None, " ".join(rng.choices("abcde", k=3000))]
    items = [(str(k), texts[k * 7]) for k in range(20)] + [(None, texts[-1][1000:1030])]
    monkeypatch.setattr(decontaminate.FMIndex, "__init__", (lambda init: lambda self, *a: (made.append(len(a[0])), init(self, *a))[1])(decontaminate.FMIndex.__init__))
    phrases, got = decontaminate.Phrases(items), []
    for words in (2_000_000, 97):
        monkeypatch.setattr(decontaminate, "INDEX_WORDS", words)
        got.append(decontaminate.scan(texts, phrases))
        assert len(made) == 1 or max(made[1:]) < 500
    assert got[0] == got[1]
    want = plain_hits(texts, items)
    assert [sum(s["end"] - s["start"] for s in x) for x in got[0]["spans"]] == [x[1] for x in want] and [len(x) for x in got[0]["items"]] == [x[2] for x in want]
    rows = pa.record_batch({"text": texts})
    assert [b.num_rows for b in shared.gathered(iter([rows.slice(k, 1024) for k in range(0, 5002, 1024)]), 100_000)] == [2048, 2048, 906]


def test_decontamination_of_nothing(spark):
    docs, bench = docs_of(spark, ["a b"]), spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.contamination(docs, bench).first().n_hit == 0
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0


def test_wavelet_tree_and_index():
    rng = np.random.default_rng(0)
    seq = rng.integers(0, 23, 500)
    tree = decontaminate.WaveletTree(seq, 23)
    at = np.arange(500)
    assert (tree.access(at) == seq).all()
    for c in (0, 7, 22, 5):
        assert (tree.rank(np.full(501, c), np.arange(501)) == np.concatenate([[0], np.cumsum(seq == c)])).all()
    text = np.concatenate([rng.integers(1, 4, 300), [0], rng.integers(1, 4, 77), [0]])
    index = decontaminate.FMIndex(text, 4)
    low, high = index.find(np.array([[0, 1, 2, 3], [3, 3, 1, 1]]), np.array([3, 4]))
    found = [sorted(index.locate(np.arange(a, b))) for a, b in zip(low, high, strict=True)]
    assert found == [[k for k in range(len(text)) if list(text[k : k + len(p)]) == p] for p in ([1, 2, 3], [3, 3, 1, 1])]


# 2 and 5


def quality_labels():
    con = duckdb.connect()
    d = "/root/testdata/sf0.1"
    return con.sql(f"select doc_id, text, quality, toxic from '{d}/documents.parquet' join '{d}/labels.parquet' using (doc_id) order by doc_id").fetchall()


def test_quality_on_held_out_labels():
    rows = quality_labels()
    held = [zlib.crc32(str(r[0]).encode()) % 4 == 2 for r in rows]
    stats = quality.statistics_of([r[1] for r in rows])
    y, held = np.array([r[2] for r in rows]), np.array(held)
    model = quality.fit_rules(stats[~held], y[~held].astype(float))
    right = (model.score(stats[held]) >= quality.THRESHOLD) == y[held]
    assert right.mean() > 0.98 and right[y[held] == 1].mean() > 0.99


def held_out_figures(spark, query, label, fold):
    """Share of label 1 that is found, and of what is found that is label 1, by a query over the whole table, on labels that it may not learn from."""
    folder = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in queries.QUERIES[query](spark, folder).collect()}
    told = duckdb.sql(f"select doc_id, {label} from '{folder}/labels.parquet' where {label} is not null").fetchall()
    assert len(got) == duckdb.sql(f"select count(*) from '{folder}/documents.parquet'").fetchall()[0][0]
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % fold[0] == fold[1]) for k, r in got.items())
    pairs = [(y, got[k].predicted) for k, y in told if k in got and got[k].held_out]
    both = sum(y and p for y, p in pairs)
    return both / sum(y for y, _ in pairs), both / max(1, sum(p for _, p in pairs)), pairs


def test_toxicity_query_on_held_out_labels(spark):
    recall, precision, pairs = held_out_figures(spark, "op5_toxicity", "toxic", (5, 0))
    # About a tenth of the toxic labels here stand at texts that hold none of what marks the others.
    assert sum(y for y, _ in pairs) > 50 and recall > 0.75 and precision > 0.85


def test_quality_query_on_held_out_labels(spark):
    recall, precision, pairs = held_out_figures(spark, "op2_quality", "quality", (4, 2))
    poor = [p for y, p in pairs if not y]
    assert recall > 0.98 and precision > 0.98 and len(poor) > 50 and np.mean(poor) < 0.1


def test_samples_are_bounded(spark):
    """An id that documents repeat very often, and long texts, stay within rows and bytes."""
    rows = [(1, "a" * k) for k in range(300)] + [(1, "same")] * 50 + [(k, "b" * 1000) for k in range(2, 60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id bigint, toxic int")
    got = quality.labelled_sample(docs, labels, "toxic", (1000, 999), 40, 30_000).collect()
    for k in (0, 1):
        mine = [r.text for r in got if r.label == k]
        assert 10 < len(mine) <= 20 and sum(map(len, mine)) <= 15_000
    assert sorted(map(str, got)) == sorted(map(str, quality.labelled_sample(docs.repartition(7), labels, "toxic", (1000, 999), 40, 30_000).collect()))


def test_long_texts_are_read_in_pieces(monkeypatch):
    """A window of bad words is found wherever it stands, also across the cut of two pieces, and a word without end is read."""
    rng, net = random.Random(2), toxicity.Network(4)
    words = [f"w{rng.randrange(500)}" for _ in range(3000)]
    whole = toxicity.worst_windows(net, [" ".join(words), "x" * 20000, None])
    monkeypatch.setattr(toxicity, "PIECE", 2000)
    pieces = list(toxicity.pieces_of(" ".join(words), 2000))
    assert len(pieces) > 5 and max(map(len, pieces)) <= 2000
    at, joined = 0, " ".join(words)
    for one, two in zip(pieces, pieces[1:], strict=False):
        assert two.split()[: toxicity.WINDOW] == one.split()[-toxicity.WINDOW :]
        assert joined[at:].startswith(one)
        at += len(one) - len(" ".join(one.split()[-toxicity.WINDOW :]))
    cut = toxicity.worst_windows(net, [" ".join(words), "x" * 20000, None])
    assert cut[2] == whole[2] == -np.inf and np.isfinite(cut[:2]).all() and abs(cut[0] - whole[0]) < 1


def test_quality_is_the_same_on_small_and_large_tables(spark):
    """Both have 85 percent good rows without evidence either way; only the large one is cut, to as many of each label."""
    score = {}
    for n in (300, 3000):
        labels = spark.createDataFrame([(k, int(k % 20 >= 3)) for k in range(n)], "doc_id bigint, quality int")
        rows = quality.quality_scores(docs_of(spark, ["some words of text"] * n), labels, rows=600).collect()
        score[n] = rows[0].score
        assert all(r.predicted for r in rows)
    assert abs(score[300] - score[3000]) < 0.03


def test_rules_in_spark_score_as_in_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.random((400, len(quality.STATS)))
    model = quality.fit_rules(x, ((x[:, 3] > 0.5) & (x[:, 5] < 0.7)).astype(float), trees=10)
    assert len(model.rules)
    df = spark.createDataFrame([(k, *map(float, row)) for k, row in enumerate(x)], quality.STAT_SCHEMA)
    got = [r.score for r in df.orderBy("doc_id").select(model.column().alias("score")).collect()]
    assert np.allclose(got, model.score(x))


def test_network_gradient():
    net = toxicity.Network(2)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    rng = np.random.default_rng(1)
    gates = [net.padded(rng.standard_normal((6, 3 * toxicity.UNITS))) for _ in "01"]
    ids, y, w = rng.integers(0, 7, (5, 8)), np.array([0, 1, 1, 0, 1]), np.ones(5) / 5
    ids[:, 0] = 1

    def loss():
        z = net.run(ids, gates)
        return (np.logaddexp(0, z) - y * z) @ w

    g, by_word = net.gradient(ids, gates, y, w)
    for name, at in (("u0", (1, 2)), ("u1", (3, 20)), ("att", (2, 1)), ("att_v", (3,)), ("out", (4,))):
        old = net.p[name][at]
        net.p[name][at] = old + 1e-3
        up = loss()
        net.p[name][at] = old - 1e-3
        down = loss()
        net.p[name][at] = old
        assert abs((up - down) / 2e-3 - g[name][at]) < 2e-3 * max(1, abs(g[name][at]))
    gates[0][2, 5] += 1e-3
    up = loss()
    gates[0][2, 5] -= 2e-3
    assert abs((up - loss()) / 2e-3 - by_word[0][2, 5]) < 2e-3


def test_words_as_a_plain_split():
    texts = ["A b a", None, "", "Ça va, ça!", "x" * 100 + " b", "b"]
    table = toxicity.Words.of(texts)
    plain = [[w for w in (t or "").lower().encode().translate(toxicity._FOLD).split()] for t in texts]
    assert table.owner.tolist() == [k for k, ws in enumerate(plain) for _ in ws]
    seen = {}
    for row, w in zip(table.ids.tolist(), [w for ws in plain for w in ws], strict=True):
        assert seen.setdefault(w, row) == row
    assert len(set(seen.values())) == len(seen) == len(table.word)


@pytest.mark.parametrize("score", [quality.quality_scores, toxicity.toxicity_scores])
def test_scores_of_odd_texts(spark, score):
    docs = docs_of(spark, ODD)
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    both = spark.createDataFrame([(k, k % 2, (k + 1) % 2) for k in range(11)] + [(None, 1, 1), (3, None, None), (4, 1, 1)], "doc_id bigint, quality int, toxic int").withColumn("text", F.lit("clash"))
    for labels in (none, both):
        rows = score(docs, labels).collect()
        assert sorted(r.doc_id for r in rows) == list(range(len(ODD))) and all(0 <= r.score <= 1 for r in rows)
    assert score(docs.limit(0), both).count() == 0


# 3


def test_preferences(spark):
    turns = [
        (0, 0, "user", "q", 1), (0, 1, "assistant", "short", 1), (1, 0, "user", "q", 1), (1, 1, "assistant", "longer answer", 1), (1, 2, "user", "thanks", 1),
        (2, 0, "system", None, 1), (2, 1, "user", "q", 1), (3, 0, "assistant", "alone", 1), (None, 0, "user", "q", 1), (4, 0, "user", "q", 1), (4, 1, "assistant", "short", 1), (5, 0, None, "", 1),
    ]
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string, request int")
    got = {(r.chosen_id, r.rejected_id): r for r in chat.preferences(df, neighbours=True).collect()}
    assert {(r.chosen_id, r.rejected_id) for r in chat.preferences(df).collect()} == {(0, 2), (1, 2), (4, 2)}
    assert set(got) == {(1, 0), (0, 2), (1, 2), (4, 2), (3, 2), (4, 5)}
    one = got[1, 0]
    assert one.prompt == "<|im_start|>user\nq<|im_end|>\n" and one.n_common == 1
    assert [(p.text, p.train) for p in one.chosen_pieces] == [("<|im_start|>assistant\n", False), ("longer answer<|im_end|>\n", True), ("<|im_start|>user\n", False), ("thanks<|im_end|>\n", False)]
    same = chat.preferences(df, spark.createDataFrame([(0, 4), (0, 9)], "chosen_id bigint, rejected_id bigint")).collect()
    assert len(same) == 1 and same[0].identical and same[0].chosen == "" and same[0].n_common == 2
    assert chat.preferences(df.limit(0)).count() == 0


# 4


def plain_components(ids, linked):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near_copies(rng, n):
    """Texts with near copies at all similarities, a passage that many share, and exact copies."""
    vocabulary = [f"w{k}" for k in range(400)]
    passage = " ".join(rng.choices(vocabulary, k=60))
    texts = []
    while len(texts) < n:
        base = rng.choices(vocabulary, k=rng.choice([3, 10, 80, 200]))
        for _ in range(rng.choice([1, 1, 2, 6])):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy) + rng.choice(["", "", " " + passage]))
    return texts[:n] + ODD


@pytest.mark.parametrize(("size", "block"), [(4, 512), (5, 3)])
def test_near_duplicates(spark, size, block):
    texts = near_copies(random.Random(size), 150)
    sets = [set(neardup.shingles(t, size).tolist()) for t in texts]
    linked = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = plain_components(range(len(texts)), linked)
    got = {r.doc_id: r for r in neardup.near_duplicates(docs_of(spark, texts), size=size, block=block).collect()}
    assert {k: r.component_id for k, r in got.items()} == want
    assert all(r.n_shingles == len(sets[k]) and r.kept == (k == want[k]) for k, r in got.items())


def test_near_duplicates_of_null_and_repeated_ids(spark):
    """Null-id copies bridge two documents; two of them alone keep one; repeated ids are documents of their own."""
    words = [f"w{k}" for k in range(400)]
    chain = [" ".join(words[k * 8 : k * 8 + 100]) for k in range(4)]
    texts = [(5, chain[0]), (None, chain[1]), (9, chain[2]), (None, chain[3]), (None, "alone " + " ".join(words[300:350])), (None, " ".join(words[300:350])), (7, "x y z"), (7, "p q r"), (8, "p q r"), (None, None)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(3)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(df, size=4).collect()), key=str)
    assert got == sorted([(5, 97, 5, True), (None, 97, 5, False), (9, 97, 5, False), (None, 97, 5, False), (None, 48, None, True), (None, 47, None, False), (7, 1, 7, True), (7, 1, 7, True), (8, 1, 7, False), (None, 0, None, True)], key=str) or got == sorted(
        [(5, 97, 5, True), (None, 97, 5, False), (9, 97, 5, False), (None, 97, 5, False), (None, 48, None, False), (None, 47, None, True), (7, 1, 7, True), (7, 1, 7, True), (8, 1, 7, False), (None, 0, None, True)], key=str
    )


def test_long_lists_are_not_expanded(spark, monkeypatch):
    """4,000 texts share three fifths of their words and lie in 2,000 components; their long lists go on as a long signature's, where none is left."""
    rng = random.Random(11)
    common, texts, told = " ".join(f"c{k}" for k in range(120)), [], {}
    for k in range(2000):
        own = [f"u{rng.randrange(10**9)}" for _ in range(75)]
        texts += [common + " " + " ".join(own), common + " " + " ".join([*own[:-2], "other"])]
    monkeypatch.setattr(neardup, "_compared", (lambda old: lambda part, lists, *a, **k: (told.setdefault(len(told), sum(r.n for r in lists.collect())), old(part, lists, *a, **k))[1])(neardup._compared))
    got = neardup.near_duplicates(docs_of(spark, texts), size=4, block=64).collect()
    assert all(r.component_id == r.doc_id // 2 * 2 for r in got)
    assert told[1] < len(texts)


def test_long_lists_of_nearly_similar_texts(spark, monkeypatch):
    """Copies around the similarity, all in the same long lists, which are compared in several blocks up to the full sets."""
    monkeypatch.setattr(neardup, "WIDE", 32)
    monkeypatch.setattr(neardup, "ENTRIES", 5000)
    rng, texts = random.Random(3), []
    for _ in range(260):
        words = [f"b{k}" for k in range(300)]
        for _ in range(rng.choice([2, 6, 8, 10])):
            words[rng.randrange(300)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    sets = [set(neardup.shingles(t, 4).tolist()) for t in texts]
    linked = [(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = plain_components(range(len(texts)), linked)
    assert 50 < len(set(want.values())) < 200
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(docs_of(spark, texts), size=4, block=16).collect()} == want


def test_near_duplicates_of_nothing(spark):
    assert neardup.near_duplicates(docs_of(spark, ["a b"]).limit(0)).count() == 0
    twice = docs_of(spark, ["a b c d e f", "g h i j k l"]).withColumn("doc_id", F.lit(7).cast("bigint"))
    assert [(r.component_id, r.kept) for r in neardup.near_duplicates(twice).collect()] == [(7, True)] * 2


def test_signature_estimates_similarity():
    rng, m = np.random.default_rng(0), neardup._constants(64, 3)
    hits = []
    for _ in range(200):  # 32 bits of each coordinate are kept; all 64 are compared here
        x = rng.integers(0, 2**63, 180, dtype=np.uint64)
        hits.append((neardup.signature(np.unique(x[:170]), m) == neardup.signature(np.unique(np.concatenate([x[:153], x[170:]])), m)).sum())
    assert abs(np.mean(hits) / 64 - 153 / 180) < 0.02 and min(hits) >= neardup.MATCHES


def test_components_of_chains(spark):
    rng = random.Random(4)
    edges = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 140)] + [(rng.randint(200, 400), rng.randint(200, 400)) for _ in range(150)]
    got = {r.node: r.component for r in shared.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = plain_components(sorted({x for e in edges for x in e}), edges)
    assert got == {k: v for k, v in want.items() if any(k in e and e[0] != e[1] for e in edges)}


def test_components_of_shuffled_chains(spark):
    ids = list(range(1000))
    random.Random(8).shuffle(ids)
    edges = list(zip(ids, ids[1:])) + [(2000 + a, 2000 + b) for a, b in zip(ids[:200], ids[1:200])]
    got = {r.node: r.component for r in shared.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == dict.fromkeys(range(1000), 0) | dict.fromkeys((2000 + k for k in ids[:200]), 2000 + min(ids[:200]))


# 6


def test_components_with_later_edges(spark):
    """Edges added to known components give what all edges give at once, whether they join some, add nodes or do nothing."""
    first, later = [(1, 2), (5, 6), (6, 7), (9, 12)], [(7, 2), (12, 20), (30, 31), (40, 40), (5, 7)]
    known = shared.components(spark.createDataFrame(first, "a bigint, b bigint"))
    for more in (later, [(2, 1), (5, 7)], []):
        got = shared.components(spark.createDataFrame(more, "a bigint, b bigint"), known=known).collect()
        edges = first + [e for e in more if e[0] != e[1]]
        assert len(got) == len({r.node for r in got})
        assert {r.node: r.component for r in got} == plain_components(sorted({x for e in edges for x in e}), edges)


def test_mix_is_near_its_targets(spark):
    texts = [("w " * (k * 7 % 40)).strip() for k in range(900)] + [None, ""]
    docs = docs_of(spark, texts).withColumn("source", F.when(F.col("doc_id") % 2 == 0, "hot").when(F.col("doc_id") % 5 == 0, None).otherwise(F.concat(F.lit("s"), (F.col("doc_id") % 7).cast("string"))))
    runs = [sorted(map(tuple, mixing.mix(docs, slice_rows=n).collect())) for n in (50, 1000)]
    assert runs[0] == runs[1]
    by = {}
    for _, source, size, whole, target, taken in runs[0]:
        assert taken in (0, size, 2 * size)
        by.setdefault(source, [whole, target, 0, 0])
        by[source][2] += taken
        by[source][3] += size
    assert all(w == s and t <= 2 * w + 1e-6 and abs(got - t) <= 80 for w, t, got, s in by.values())
    assert math.isclose(sum(t for _, t, _, _ in by.values()), 1.5 * sum(w for w, *_ in by.values()))
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mix(docs_of(spark, [None])).first().taken == 0


@pytest.mark.parametrize("seed", range(3))
def test_mix_of_few_large_documents(spark, seed):
    """Uses that finish long after time 1 are taken while the budget lasts."""
    from tests.test_queries import plain

    rng = random.Random(seed)
    rows = [(k if k % 9 else 4, "w " * rng.choice([0, 1, 10, 50, 100]), rng.choice(["a", "b", "c", "d", "e", "f", "g", "h", None])) for k in range(25)]
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id bigint, text string, source string, place bigint")
    con = duckdb.connect()
    documents = con.from_arrow(pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows], "source": [r[2] for r in rows]}))
    assert documents.columns == ["doc_id", "text", "source"]
    con.register("documents", documents.to_arrow_table())
    per_row = queries.SQL["op6_mixing"].replace("select doc_id, source, coalesce(len", "select row_number() over () as row, doc_id, source, coalesce(len").replace("select doc_id, place, size, (sent", "select row, doc_id, place, size, (sent")
    per_row = per_row.replace("select doc_id, sum(size) as taken", "select row, sum(size) as taken").replace("group by doc_id)", "group by row)").replace("using (doc_id)", "using (row)")
    got = mixing.mix(df).select("doc_id", "size", "source_size", "target", "taken").collect()
    assert sorted(repr(plain(list(r))) for r in got) == sorted(repr(plain(list(r))) for r in con.sql(per_row).fetchall())


# 7


def test_near_vectors(spark):
    rng = np.random.default_rng(5)
    x = []
    for _ in range(60):
        base = rng.standard_normal(32)
        x += [base + rng.standard_normal(32) * s for s in (0, 0, 0.1, 0.2, 0.3)]
    rows = [(k, [float(v) for v in np.float32(x[k])], k // 5 % 3 if k % 50 else None) for k in range(len(x))]
    odd = [(1000, None, 1), (1001, [], 1), (1002, [0.0] * 32, 1), (1003, [None] + [1.0] * 31, 1), (1004, [float("nan")] + [1.0] * 31, 1), (1005, [float("inf")] * 32, 1), (1006, [1.0], 1)]
    df = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<float>, label int").withColumn("group", F.lit(1))
    v = np.array([r[1] for r in rows], np.float64)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    near = [(a, b) for a in range(len(v)) for b in range(a) if rows[a][2] is not None and rows[a][2] == rows[b][2] and v[a] @ v[b] >= 0.93]
    got = {r.vec_id: r for r in embeddings.near_vectors(df).collect()}
    links = {k: 0 for k in got}
    for a, b in near:
        links[a] += 1
        links[b] += 1
    assert set(got) == {r[0] for r in rows + odd} and all(got[k].n_links <= n for k, n in links.items())
    assert sum(r.n_links for r in got.values()) >= 0.97 * 2 * len(near)
    assert sum(got[k].component_id == c for k, c in plain_components(range(len(v)), near).items()) >= 0.97 * len(v)
    assert embeddings.near_vectors(df.limit(0)).count() == 0


@pytest.mark.parametrize(("parts", "passes", "neighbours", "block"), [("200", 12, 384, 4096), ("200", 1, 40, 700), ("3", 2, 40, 700)])
def test_near_vectors_beyond_the_window(spark, parts, passes, neighbours, block):
    """Two labels of 2,000 near vectors each, several times the window, in few pieces and in more than the window holds."""
    rng = np.random.default_rng(7)
    base = rng.standard_normal(64)
    v = base + rng.standard_normal((4000, 64)) * 0.2
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(k, [float(c) for c in x], k % 2) for k, x in enumerate(v)], "vec_id bigint, embedding array<double>, label int")
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {r.vec_id: r for r in embeddings.near_vectors(df, passes=passes, neighbours=neighbours, block=block).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    for label in (0, 1):
        want = (v[label::2] @ v[label::2].T >= 0.93).sum(1) - 1
        assert want.min() > 384
        assert [got[k].n_links for k in range(label, 4000, 2)] == want.tolist() and {got[k].component_id for k in range(label, 4000, 2)} == {label}


def test_near_vectors_of_a_large_group(spark):
    """10,000 near vectors, with links to some of the others only; the same result in 4 and in 64 parts."""
    rng = np.random.default_rng(9)
    v = rng.standard_normal(48) + rng.standard_normal((10000, 48)) * 0.3
    v = np.float32(v)
    df = spark.createDataFrame([(k, x.tolist(), 1) for k, x in enumerate(v)], "vec_id bigint, embedding array<float>, label int")
    was, got = spark.conf.get("spark.sql.shuffle.partitions"), []
    for parts in ("4", "64"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got.append({r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_vectors(df).collect()})
    spark.conf.set("spark.sql.shuffle.partitions", was)
    u = v.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    want = np.concatenate([(u[k : k + 1000] @ u.T >= 0.93).sum(1) - 1 for k in range(0, 10000, 1000)])
    assert 1000 < want.mean() < 9000
    assert got[0] == got[1]
    assert sum(n for n, _ in got[0].values()) >= 0.999 * want.sum()


def test_passes_grow_with_labels():
    assert embeddings.passes_for(0, 0.93, 384) == embeddings.passes_for(100_000, 0.93, 384) == 12 < embeddings.passes_for(10**9, 0.93, 384) < 100


# 8


def license_names(spark, texts, *table):
    return [r.licenses for r in licenses.license_scan(docs_of(spark, texts), *table).orderBy("doc_id").collect()]


def plain_licenses(text, known, rules, gap=licenses.GAP):
    """Every known sentence as a pattern at every place where one may begin; then the rules."""
    found, at = [], 0
    ends = licenses.sentence_ends(text)
    starts = {m.end() for m in re.finditer(r"^[^0-9A-Za-z]*|\n[^0-9A-Za-z]*|[.!?;:]['\")\]]*\s[^0-9A-Za-z]*", text)} | {m.end() for m in re.finditer(r"(?m)^[^0-9A-Za-z\n]*(?:[A-Za-z]|\d\d?)[^0-9A-Za-z]{2,}", text)}
    for start in sorted(starts):
        if start < at or start > 0 and text[start - 1].isalnum() and text[start - 1].isascii():
            continue
        best = None
        for name, pattern, size in known:
            if (m := pattern.match(text, start)) and (best is None or size > best[2]):
                best = (name, m.end("all"), size)
        if best:
            stop = best[1]
            while stop < len(text) and text[stop] in ".!?;:":
                stop += 1
            found.append((best[0], start, stop, sum(e <= start for e in ends), sum(e < best[1] for e in ends)))
            at = best[1]
    out, k = [], 0
    while k < len(found):
        for name, ids in sorted(rules, key=lambda r: -len(r[1])):
            row = found[k : k + len(ids)]
            if [x[0] for x in row] == ids and all(b[3] - a[4] <= gap + 1 for a, b in zip(row, row[1:])):
                out.append((name, row[0][1], row[-1][2]))
                k += len(ids)
                break
        else:
            k += 1
    return out


def test_licenses_as_a_plain_matcher(spark):
    rng = random.Random(12)
    more, rules = licenses.families()
    known, rules = licenses.SENTENCES | more, licenses.RULES + rules
    gap, compiled = r"[^0-9A-Za-z]+", []
    for name, text in known.items():
        parts = [gap.join(re.findall("[0-9A-Za-z]+", p)) for p in text.split("<>")]
        body = f"(?:{gap}[0-9A-Za-z]+){{1,{licenses.HOLE_WORDS}}}?{gap}".join(p for p in parts if p)
        compiled.append((name, re.compile(rf"(?i)(?P<all>{body})(?=[^0-9A-Za-z]*$|[^0-9A-Za-z]*\n|[^0-9A-Za-z]*[.!?;:]['\")\]]*\s)"), len(re.findall("[0-9A-Za-z]+", text))))
    same = {}
    for name, text in known.items():
        same[name] = next(n for n, t in known.items() if re.findall("[0-9a-z]+|<>", t.lower()) == re.findall("[0-9a-z]+|<>", text.lower()))
    rules = [(name, [same[i] for i in ids]) for name, ids in rules]
    compiled = [c for c in compiled if same[c[0]] == c[0]]
    names, texts = list(known), []
    for _ in range(150):
        parts = []
        for _ in range(rng.randint(1, 4)):
            ids = rng.choice(rules)[1] if rng.random() < 0.7 else [rng.choice(names)]
            for i in ids:
                line = known[i].replace("<>", " ".join(rng.choices(["Some", "Name", "Inc.", "and", "others"], k=rng.randint(1, 4))))
                line = line if rng.random() < 0.7 else rng.choice([line.upper(), line.lower(), line.replace(" ", "\n", 3), line[:-1], line.replace(" the ", " ", 1)])
                parts.append(rng.choice(["", "", "1. ", "# ", " * ", "(a) ", "So "]) + line + rng.choice([" ", "\n", "\n\n", " Unknown here. ", "\nA. B c. D e. F g.\n"]))
        texts.append("".join(parts))
    got = {r.doc_id: [tuple(x) for x in r.spans] for r in licenses.license_scan(docs_of(spark, texts)).collect()}
    assert sum(map(len, got.values())) > 150
    for k, text in enumerate(texts):
        assert got[k] == plain_licenses(text, compiled, rules), text


def test_licenses_of_long_texts_in_linear_time():
    scan = licenses.Recogniser().scan
    began = time.perf_counter()
    assert scan("\n".join(f"a line without any mark {k}" for k in range(20000)))[2] == []
    assert time.perf_counter() - began < 3


def test_licenses(spark):
    s = licenses.SENTENCES
    full = "Copyright (c) 2020 A\n\n" + s["mit-grant"].replace(" of this", "\nof this") + "\n\n" + s["mit-keep"].upper() + "\n\n" + s["mit-asis"] + " " + s["mit-liable"].replace("<>", "THE AUTHORS")
    gpl = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. "
    gpl += s["gpl-hope"].replace("<>", "program") + " See the GNU General Public License for more details."
    bsd = s["bsd-grant"] + "\n1. " + s["bsd-source"] + "\n2. " + s["bsd-binary"]
    texts = [full, "Prose here.\nReleased under the MIT License.\nMore prose.", bsd, gpl, s["mit-keep"], "Licensed under CC BY-NC 4.0.", s["apache-under"] + "\n" + s["apache-use"], *ODD]
    got = {r.doc_id: r for r in licenses.license_scan(docs_of(spark, texts)).collect()}
    assert [got[k].licenses for k in range(7)] == [["MIT"], ["MIT"], ["BSD-2-Clause"], ["GPL-3.0-or-later"], [], ["CC-BY-NC-4.0"], ["Apache-2.0"]]
    assert len(got[0].spans) == 1 and texts[1][got[1].spans[0].start : got[1].spans[0].end] == "Released under the MIT License."
    assert all(not got[k].licenses for k in range(7, len(texts)))
    google = s["bsd-grant"] + "\n * " + s["bsd-source"] + "\n(b) " + s["bsd-binary"] + "\n3. " + s["bsd-endorse"].replace("<>", "Google Inc.")
    assert licenses.Recogniser().scan(google)[2] == [("BSD-3-Clause", 0, len(google))]
    assert [x[0] for x in licenses.Recogniser().scan("Notes\nLicensed under the MIT License\nand so on, for a while")[2]] == ["MIT"]
    assert license_names(spark, ["// SPDX-License-Identifier: LGPL-3.0-or-later"]) == [["LGPL-3.0-or-later"]]
    assert license_names(spark, ["It is a b c."], {"a": "It is <> c."}, [("Own", ["a"])]) == [["Own"]] and licenses.license_scan(docs_of(spark, ["a"]).limit(0)).count() == 0
    far = licenses.Recogniser(gap=1).scan(s["mit-grant"] + " A. B. C. " + s["mit-keep"])
    assert [x[0] for x in far[2]] == ["MIT"] and far[2][0][2] <= len(s["mit-grant"])


# 9


def test_warc_round_trip(spark, tmp_path):
    pages = [(1, "http://a/%0A", "x" * 2000), (2, None, "x" * 2000), (3, "u\r\nv", "x" * 2000), (4, "u", None), (5, "u", "small"), (6, "u", "small"), (None, "u", "x" * 2000), (7, "u", "é" * 600)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumn("digest", F.lit("clash"))
    archives = warc.write_archives(df, roll=500)
    got = {r.page_id: r for r in warc.read_archives(archives).collect()}
    assert [(k, got[k].record_type, got[k].refers_to) for k in (1, 2, 3, 4, 5, 6, 7)] == [(1, "revisit", 3), (2, "revisit", 3), (3, "response", None), (4, "response", None), (5, "response", None), (6, "response", None), (7, "response", None)]
    assert len(got) == 8 and got[1].payload_bytes == 2000 and got[7].payload_bytes == 1200 and got[1].url == pages[0][1] and got[3].url == pages[2][1]
    assert all(got[k].payload_digest == hashlib.sha1((h or "").encode()).hexdigest() for k, _, h in pages)
    warc.save_archives(archives, str(tmp_path))
    files = sorted(map(str, tmp_path.glob("*.warc.gz")))
    assert len(files) > 1 and sorted(map(str, warc.read_files(spark, files).collect())) == sorted(map(str, got.values()))
    assert warc.resolved(warc.read_archives(archives)).count() == 8
    with pytest.raises(warc.WarcError):
        warc.resolved(warc.read_archives(archives).withColumn("payload_digest", F.when(F.col("page_id") == 1, "0" * 40).otherwise(F.col("payload_digest"))))
    assert warc.read_archives(warc.write_archives(df.limit(0))).count() == 0


def test_warc_faults():
    good = warc.record(1, "u", b"hello", hashlib.sha1(b"hello").hexdigest())
    assert warc.parse(next(warc.members(good)))["content"] == b"hello"
    assert len(list(warc.members(good * 3, step=7))) == 3
    for bad in (good[:-4], good + b"junk", b"\x00" * 30):
        with pytest.raises(warc.WarcError):
            list(warc.members(bad))
    plain = next(warc.members(good))
    for bad in (plain.replace(b"hello", b"hallo"), plain.replace(b"Length: 5\r\n\r\n", b"Length: 4\r\n\r\n"), plain[4:], plain.replace(b"urn:page:1", b"urn:page:x")):
        with pytest.raises(warc.WarcError):
            warc.parse(bad)


# 10


def test_tokens_as_the_library(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    rng = random.Random(6)
    pool = [chr(c) for c in [*range(0, 0x180), 0x2028, 0x3000, 0x4E00, 0x1F600, 0x300, 0xFEFF]] + ["'s", "'LL", "  ", "\n\n", "<|endoftext|>", " the", "ing"]
    texts = ["".join(rng.choices(pool, k=rng.randint(0, 40))) for _ in range(400)] + ODD
    got = {r.doc_id: r for r in tokens.token_counts(docs_of(spark, texts), path).collect()}
    for k, t in enumerate(texts):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[k].n_tokens, got[k].n_bytes, got[k].over_limit) == (n, len((t or "").encode()), n > 512)
    assert tokens.token_counts(docs_of(spark, ["a"]).limit(0), path).count() == 0
    known = tokens.vocabulary(path)
    assert known.ranks
    for word in ["ab" * 300, "aaaa" * 100, *("".join(rng.choices("thenigéß", k=rng.randint(1, 300))) for _ in range(200))]:
        n = len(library.encode(word, add_special_tokens=False).ids)
        assert known.merged(word.encode()) == known._merged_long([known.byte[b] for b in word.encode()]) == known.merger()(word) == n
    told = json.load(open(path, encoding="utf-8"))
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"model": told["model"] | {"byte_fallback": True}}, {"added_tokens": [told["added_tokens"][0] | {"lstrip": True}]}):
        with pytest.raises(ValueError, match="can't be counted"):
            tokens._check(told | change)
    assert all(len(library.encode(t, add_special_tokens=False).ids) == 1 for t in rng.sample(sorted(known.shortcut), 2000))


# Queries with SQL


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query(spark, name):
    from tests.test_queries import plain

    con = duckdb.connect()
    for table in ("documents", "benchmark", "pages", "conversations", "embeddings"):
        con.sql(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    df, rel = queries.QUERIES[name](spark, FOLDER), con.sql(queries.SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    at = [rel.columns.index(c) for c in cols]
    assert sorted(repr([plain(r[c]) for c in cols]) for r in df.collect()) == sorted(repr([plain(r[k]) for k in at]) for r in rel.fetchall())


def test_sample_within_bytes_prefers_no_length(spark):
    """A quarter of the rows are long; with room for a part of all, about a quarter of the sample is long, and both labels give equally many rows."""
    rows = [(k, ("l" * 4000 if k % 8 < 2 else "s") + str(k)) for k in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, k % 2) for k, _ in rows], "doc_id bigint, toxic int")
    got = quality.labelled_sample(docs, labels, "toxic", (5, 0), 3000, 1_000_000).collect()
    assert 600 < len(got) < 1300 and 0.2 < sum(len(r.text) > 1000 for r in got) / len(got) < 0.3
    assert abs(sum(r.label for r in got) * 2 - len(got)) <= 1
    huge = spark.createDataFrame([(1, "a" * (3 << 20)), (2, "b")], "doc_id bigint, text string")
    both = spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, toxic int")
    assert sorted(len(r.text) for r in quality.labelled_sample(huge, both, "toxic", (5, 0), 10, 16 << 20).collect()) == [1, 1 << 20]


def test_license_tags_are_expressions():
    scan = licenses.Recogniser().scan
    names = lambda text: [x[0] for x in scan(text)[2]]
    assert names("// SPDX-License-Identifier: MIT OR Apache-2.0\nint x;") == ["MIT", "Apache-2.0"]
    assert names("# SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0\n") == ["GPL-2.0-only WITH Classpath-exception-2.0"]
    assert names("/* SPDX-License-Identifier: (LGPL-2.1+ AND mit) OR (GPL-2.0 WITH Linux-syscall-note AND LicenseRef-x) */ x") == ["LGPL-2.1-or-later", "MIT", "GPL-2.0-only WITH Linux-syscall-note"]
    # One name as before; an exception that doesn't belong to the licence is left out, and so is what isn't known.
    assert names("SPDX-License-Identifier: EUPL-1.2\nSPDX-License-Identifier: CDDL-1.0") == ["EUPL-1.2", "CDDL-1.0"]
    assert names("SPDX-License-Identifier: GPL-2.0+") == ["GPL-2.0-or-later"] and names("SPDX-License-Identifier: MIT is what we chose") == []
    assert names("SPDX-License-Identifier: MIT WITH LLVM-exception") == ["MIT"] and names("SPDX-License-Identifier: Nothing-1.0 OR Other") == [] and names("SPDX-License-Identifier") == []
    text = "x SPDX-License-Identifier: y\n SPDX-License-Identifier: MS-PL OR ISC and so on"
    assert [text[a:b] for _, a, b in scan(text)[2]] == ["MS-PL", "ISC"]


def test_license_families():
    names = lambda text: [x[0] for x in licenses.Recogniser().scan(text)[2]]
    lesser = """This library is free software; you can redistribute it and/or
 * modify it under the terms of the GNU Lesser General Public
 * License as published by the Free Software Foundation; either
 * version 2.1 of the License, or (at your option) any later version."""
    assert names(lesser) == ["LGPL-2.1-or-later"]
    assert names(lesser.replace("2.1", "3")) == ["LGPL-3.0-or-later"] and names(lesser.replace("2.1", "2").replace("Lesser", "Library")) == ["LGPL-2.0-or-later"]
    assert names("Licensed under the Common Development and Distribution License, Version 1.0.") == ["CDDL-1.0"]
    assert names("This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License.") == ["CC-BY-SA-3.0"]


def test_warc_record_ids_differ(spark):
    """However often a page's number occurs, and where it has none."""
    rows = [(k, f"u{k}", "a" * 2000) for k in (1, 1, 2, 2, None, None)] + [(3, "a%\nb", "short")] * 2
    archives = warc.write_archives(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3), roll=300)
    heads = [m.partition(b"\r\n\r\n")[0].decode() for r in archives.collect() for m in warc.members(bytes(r.content))]
    fields = [dict(line.split(": ", 1) for line in h.split("\r\n")[1:]) for h in heads]
    assert len({f["WARC-Record-ID"] for f in fields}) == len(rows) == len(fields)
    again = [f for f in fields if f["WARC-Type"] == "revisit"]
    assert len(again) == 2 and all(f["Page-ID"] == "1" and f["Refers-To-Page-ID"] == "2" and f["WARC-Refers-To-Target-URI"] == "u2" for f in again)
    assert warc.resolved(warc.read_archives(archives)).count() == 8


def test_toxicity_network_is_not_fitted_by_the_driver(spark, monkeypatch):
    def marked(texts, y, share):
        net = toxicity.Network()
        net.shift = float(os.getpid())
        return net

    monkeypatch.setattr(toxicity, "fit", marked)
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    assert toxicity.train(docs, labels).shift != os.getpid()
