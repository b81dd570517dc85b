"""Every query with SQL gives the rows that DuckDB gives, and none is empty."""

import math
import os

import duckdb
import pytest

from lodestrata.registry import REGISTRY

SF = "/root/testdata/sf0.001"
#: May be empty at this size.
MAY_BE_EMPTY = {"missing_file_nodes", "chunk_page", "finding_page", "stale_jobs", "run_history"}


def _plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "NULL"
    if isinstance(v, float):
        return f"{v:.11g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(_plain, v)) + "]"
    return str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query(spark, con, name):
    df = REGISTRY[name].run(spark, SF)
    cols = sorted(df.columns)
    rows = sorted(tuple(map(_plain, r)) for r in df.select(*cols).collect())
    assert rows or name in MAY_BE_EMPTY
    if REGISTRY[name].sql:
        found = con.execute(REGISTRY[name].sql)
        names = [x[0] for x in found.description]
        assert sorted(names) == cols
        at = [names.index(c) for c in cols]
        assert rows == sorted(tuple(_plain(r[i]) for i in at) for r in found.fetchall())
