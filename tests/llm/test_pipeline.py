"""The pipeline's stages against a plain version; each is judged on its own input."""

import corpus_pipeline
from tests.llm.test_operators import plain_components
from tidewright.llm import mixing, neardup, quality, toxicity
from tidewright.session import load

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    docs, labels = load(spark, FOLDER, "documents"), load(spark, FOLDER, "labels")
    kept = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        kept[name] = corpus_pipeline.materialise(stage(spark, docs, FOLDER), name)
        if name != "mixing":
            assert kept[name].dtypes == docs.dtypes
        docs = kept[name]
    ids = {name: sorted(r.doc_id for r in df.select("doc_id").collect()) for name, df in kept.items()}
    bad = {r.doc_id for r in toxicity.toxicity_scores(kept["documents"], labels).filter("predicted = 1").collect()}
    assert ids["toxicity"] == [k for k in ids["documents"] if k not in bad]
    poor = {r.doc_id for r in quality.quality_scores(kept["toxicity"], labels).filter("predicted = 0").collect()}
    assert ids["quality"] == [k for k in ids["toxicity"] if k not in poor]
    sets = {r.doc_id: set(neardup.shingles(r.text, 5).tolist()) for r in kept["quality"].collect()}
    linked = [(a, b) for a in sets for b in sets if b < a and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert ids["near_duplicates"] == sorted(k for k, c in plain_components(sets, linked).items() if k == c)
    assert set(ids["decontamination"]) <= set(ids["near_duplicates"])
    want = {r.doc_id: r.taken for r in mixing.mix(kept["decontamination"]).filter("taken > 0").collect()}
    assert {r.doc_id: r.taken for r in kept["mixing"].collect()} == want
    assert {r.doc_id for r in corpus_pipeline.run(spark, FOLDER).collect()} == set(want)


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Nulls in every column, repeated rows and ids, clashing names; then tables without rows."""
    from pyspark.sql import functions as F

    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, _seen_at string, _found int, row bigint, spans int"
    rows = [(1, "a b c d e f g", "en", "s", 13, "x", 1, 1, 1)] * 2 + [(1, "other words here", None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None), (None, "no id here", "en", "s", 1, None, 1, 1, 1), (2, "", "en", "t", 0, "", 0, 0, 0)]
    for name, n in (("odd", 100), ("none", 0)):
        folder = f"{tmp_path}/{name}"
        spark.createDataFrame(rows, schema).limit(n).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (None, None, None)], "doc_id bigint, quality int, toxic int").limit(n).write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([(None, "nothing that occurs"), (1, None)], "item_id bigint, text string").withColumn("_found", F.lit(1)).limit(n).write.parquet(f"{folder}/benchmark.parquet")
        got = corpus_pipeline.run(spark, folder).collect()
        assert bool(got) == bool(n) and all(0 < r.taken <= 2 * r.size for r in got)
