"""Every query with SQL gives the rows that DuckDB gives, on the smallest tables and on larger ones."""

import os

import duckdb
import numpy as np
import pytest

from tidewright.plans import registry

FOLDERS = ["/root/testdata/sf0.001", "/root/testdata/sf0.01"]


def plain(v):
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, (list, tuple, np.ndarray)):
        return [plain(x) for x in v]
    if isinstance(v, dict):
        return {k: plain(x) for k, x in v.items()}
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    return v


@pytest.fixture(scope="module")
def duck():
    out = {}
    for folder in FOLDERS:
        out[folder] = duckdb.connect()
        for f in os.listdir(folder):
            out[folder].sql(f"create view {f.split('.')[0]} as select * from '{folder}/{f}'")
    return out


@pytest.mark.parametrize("folder", FOLDERS)
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name, folder):
    df = registry.QUERIES[name](spark, folder)
    rows = df.collect()
    if name not in registry.SQL:
        return
    rel = duck[folder].sql(registry.SQL[name])
    cols = sorted(df.columns)
    assert cols == sorted(rel.columns)
    at = [rel.columns.index(c) for c in cols]
    assert sorted(repr([plain(r[c]) for c in cols]) for r in rows) == sorted(repr([plain(r[k]) for k in at]) for r in rel.fetchall())
