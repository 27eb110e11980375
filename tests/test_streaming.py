"""Streams give what the batch operators give."""

import pytest

from tidewright.operators import series, state
from tidewright.streaming import points


def run(df, name):
    query = df.writeStream.format("memory").queryName(name).outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    return df.sparkSession.sql(f"select * from {name}")


@pytest.fixture
def batches(spark, tmp_path):
    def make(rows, schema, at):
        for k in range(0, len(rows), at):
            spark.createDataFrame(rows[k : k + at], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    return make


def test_changes(spark, batches):
    schema = "series string, ts bigint, event_id bigint, value double"
    rows = [("ab"[k % 2], k, k, float(k // 5 % 2)) for k in range(40)]
    got = run(points.changes(batches(rows, schema, 7)), "s1")
    want = series.changes(spark.createDataFrame(rows, schema), ["ts", "event_id"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_semaphores(spark, batches):
    schema = "slot string, ts bigint, seq bigint, kind string, data bigint, more bigint"
    rows = [("k", 0, 0, "limit", 2, None)] + [("k", n, n, "wait" if n % 3 == 0 else "signal", None, None) for n in range(1, 12)]
    got = run(points.semaphore_states(batches(rows, schema, 4), "slot"), "s2")
    want = state.semaphore_states(spark.createDataFrame(rows, schema), ["slot"])
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
