"""Sorted files with an index: order, bounds, and that a range opens only its files."""

import glob
import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

from tidewright.sources import emission

KEYS = ["track", "ts", "id"]


def made(spark, n=2000):
    """Most rows belong to one track."""
    rng = random.Random(1)
    rows = [(rng.choice(["a", "hot", "hot", "hot", "z", None]), rng.choice([None, *range(50)]), k, "x" * (k % 9)) for k in range(n)]
    return rows, spark.createDataFrame(rows, "track string, ts bigint, id bigint, more string").repartition(5)


def key(row):
    return tuple((v is not None, v if v is not None else 0) for v in row[:3])


def test_files_follow_one_another(spark, tmp_path):
    path = str(tmp_path / "out")
    rows, df = made(spark)
    index = emission.write_sorted(df, path, KEYS, rows=100, parts=6).orderBy("offset").collect()
    assert sum(f.rows for f in index) == len(rows) and max(f.rows for f in index) <= 100 and len(index) >= 20
    assert all(key(a.last) < key(b.first) for a, b in zip(index, index[1:], strict=False))
    # The offsets are those of the files one after the other.
    sizes = {os.path.basename(f): os.path.getsize(f) for f in glob.glob(f"{path}/data/*/*.parquet")}
    at = 0
    for f in index:
        assert f.offset == at and f.bytes == sizes[f.file]
        at += f.bytes
    assert at == sum(sizes.values())
    # Each file is sorted, so the files in order are the whole table in order.
    there = [tuple(r) for f in index for r in spark.read.parquet(f"{path}/data/{f.folder}/{f.file}").collect()]
    assert there == sorted(rows, key=key)


@pytest.mark.parametrize("low, high", [(("hot", 10), ("hot", 12)), (("hot",), ("hot",)), (("b",), None), (None, ("hot", 3, 900)), (("zz",), None), (None, None), (("a", 0, 0), ("a", 49, 10**6))])
def test_range(spark, tmp_path, low, high):
    path = str(tmp_path / "out")
    rows, df = made(spark)
    emission.write_sorted(df, path, KEYS, rows=50, parts=4)
    wrap = lambda v: None if v is None else key((*v, None, None)[:3])[: len(v)]
    want = [r for r in rows if (low is None or key(r)[: len(low)] >= wrap(low)) and (high is None or key(r)[: len(high)] <= wrap(high))]
    got = emission.read_range(spark, path, low, high)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    # Only files that hold some of it are opened, besides those that the range meets between two rows.
    opened = {f.rsplit("/", 1)[-1] for f in got.inputFiles()} if want else set()
    wanted = {r.f for r in got.select(F.col("_metadata.file_name").alias("f")).distinct().collect()} if want else set()
    assert wanted <= opened and len(opened) <= len(wanted) + 1
    if low and high and want:
        assert len(opened) < emission.index(spark, path).count() / 1.5


def test_generations(spark, tmp_path):
    path = str(tmp_path / "out")
    with pytest.raises(FileNotFoundError):
        emission.index(spark, path)
    rows, df = made(spark, 300)
    emission.write_sorted(df, path, KEYS, rows=100, parts=2)
    broken = df.withColumn("id", F.when(F.col("id") == 7, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).cast("bigint"))
    with pytest.raises(Exception, match="broken"):
        emission.write_sorted(broken, path, KEYS)
    assert emission.read_range(spark, path).count() == 300
    emission.write_sorted(df.filter("id < 10"), path, KEYS)
    assert emission.read_range(spark, path).count() == 10
    emission.write_sorted(df.limit(0), path, KEYS)
    with pytest.raises(FileNotFoundError):
        emission.read_range(spark, path)


def test_seal(spark, tmp_path):
    path = str(tmp_path / "out")
    emission.write_sorted(made(spark, 300)[1], path, KEYS, rows=60, parts=2)
    sealed = emission.seal(spark, f"{path}/data")
    sealed.write.parquet(str(tmp_path / "sealed"))
    sealed = spark.read.parquet(str(tmp_path / "sealed"))
    assert sealed.count() >= 5 and emission.damaged(spark, f"{path}/data", sealed).count() == 0
    files = sorted(glob.glob(f"{path}/data/*/*.parquet"))
    for f in files:  # the local file system's own checksums would tell first
        os.remove(os.path.join(os.path.dirname(f), f".{os.path.basename(f)}.crc"))
    content = open(files[0], "rb").read()
    open(files[0], "wb").write(bytes([content[0] ^ 1]) + content[1:])
    open(files[1], "ab").write(b"x")
    os.remove(files[2])
    shutil.copy(files[3], files[3].replace(".parquet", "-2.parquet"))
    got = {(os.path.basename(r.path), r.problem) for r in emission.damaged(spark, f"{path}/data", sealed).collect()}
    name = [os.path.basename(f) for f in files]
    assert got == {(name[0], "content"), (name[1], "size"), (name[2], "missing"), (name[3].replace(".parquet", "-2.parquet"), "unknown")}
