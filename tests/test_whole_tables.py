"""Queries answer for whole texts and tables."""

from pyspark.sql import functions as F

from tidewright.functions import text as tx
from tidewright.plans import documents, events, geometry

FOLDER = "/root/testdata/sf0.001"


def test_outline_and_page_of_long_text(spark, tmp_path):
    text = "a" * 3000 + "\nLate. Heading"
    docs = spark.createDataFrame([(1, text, "en", "s", len(text))], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert any("Late. Heading" in str(r) for r in documents.doc_outline(spark, str(tmp_path)).collect())
    assert text in documents.doc_render(spark, str(tmp_path)).first().page
    cut = docs.select(tx.rendered(F.lit("t"), {}, F.array().cast("array<string>"), F.col("text"), 1000).alias("page")).first().page
    assert "Late. Heading" not in cut and "a" * 1000 in cut and cut.endswith("\n[... 2014 more characters]")


def test_geometry_of_every_part(spark, tmp_path):
    spark.range(1, 1001).withColumnRenamed("id", "p_partkey").write.parquet(str(tmp_path / "part.parquet"))
    d = str(tmp_path)
    assert geometry._triangles(spark, d).count() == 1000
    for query in (geometry.triangle_bounds, geometry.tile_bins, geometry.tile_owners):
        assert query(spark, d).agg(F.max("tri")).first()[0] > 900


def test_constant_drop_keeps_every_series_that_varies(spark):
    changed = events.series.changes(events._points(spark, FOLDER), events.ORDER).groupBy("series").count().filter("count > 1")
    assert {r.series for r in events.series_constant_drop(spark, FOLDER).collect()} == {r.series for r in changed.collect()}


def test_bit_fields_of_large_ids(spark, tmp_path):
    ids = [0, 7, 106_039, 106_040, 600_000, 3_000_000_000]
    rows = spark.createDataFrame([(i, 1, "view", 1.0) for i in ids], "event_id bigint, user_id bigint, event_type string, value double")
    rows.withColumn("ts", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).write.parquet(str(tmp_path / "events.parquet"))
    got = {r.event_id: (r.text, r.back) for r in events.bit_fields(spark, str(tmp_path)).collect()}
    assert got == {i: ("0x" + f"{i * 2654435761:012x}"[:12], i * 2654435761) for i in ids}
