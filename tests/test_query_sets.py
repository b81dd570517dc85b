"""Searches cover their whole set of queries, and so does their SQL."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from test_queries import SF, _plain

from lodestrata.functions import text as T
from lodestrata.operators import retrieval
from lodestrata.registry import REGISTRY


def _same(spark, name):
    con = duckdb.connect()
    for table in ("benchmark", "documents", "embeddings"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    found = con.execute(REGISTRY[name].sql)
    names = [x[0] for x in found.description]
    rows = REGISTRY[name].run(spark, SF).select(*names).collect()
    assert sorted(tuple(map(_plain, r)) for r in rows) == sorted(tuple(map(_plain, r)) for r in found.fetchall())
    return rows


@pytest.mark.parametrize("name", ["bm25_topk", "lexical_topk", "score_stats", "evidence_budget", "ir_metrics"])
def test_every_benchmark_item_is_a_query(spark, name):
    rows = _same(spark, name)
    if name != "ir_metrics":
        assert {r["query_id"] for r in rows} == {r["item_id"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}


@pytest.mark.parametrize("name", ["vector_topk", "vector_topk_scoped"])
def test_every_twentieth_vector_is_a_query(spark, name):
    rows = _same(spark, name)
    assert {r["query_id"] for r in rows} == set(range(0, 500, 20))


def test_blocks_give_what_one_block_gives(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 8)).round(1)
    x[40:140], x[7] = x[5], 0
    data = [(k, None if k == 9 else v.tolist()[: 7 if k == 11 else 8], k % 3) for k, v in enumerate(x)]
    v = spark.createDataFrame(data, "id int, vector array<double>, run int")
    q = v.filter("id < 60").selectExpr("id as query_id", "vector as query", "run")
    for scope, k in ((None, 4), ("run", 120)):
        pairs = v.join(q.withColumnRenamed("run", "r"), F.col("run") == F.col("r") if scope else F.lit(True))
        pairs = pairs.withColumn("score", T.cosine(F.col("vector"), F.col("query")))
        pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id"))).filter(F.col("rank") <= k)
        want = sorted(map(tuple, pairs.select("query_id", "rank", "id", "score").collect()))
        for sizes in ((4096, 512), (37, 11)):
            monkeypatch.setattr(retrieval, "VECTOR_BLOCK", sizes[0])
            monkeypatch.setattr(retrieval, "QUERY_BLOCK", sizes[1])
            got = retrieval.cosine_top_k(v, q, k, scope).select("query_id", "rank", "id", "score")
            assert sorted(map(tuple, got.collect())) == want
