import hashlib
import math
import zlib
from collections import Counter

from lodestrata.llm import queries, sharding
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def test_whole_table(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op5_shard_tree(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        raw = docs[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert r["grown_shard"] in (r["shard"], 8)
    for s in range(8):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    moved = sum(r["grown_shard"] == 8 for r in rows)
    assert 0.07 < moved / len(rows) < 0.16


def _draw(key, path, weight):
    bits = int(hashlib.md5(f"{key}/{path}".encode()).hexdigest()[:12], 16)
    return -math.log((bits + 0.5) / 2**48) / weight


def _descend(doc_id, regions):
    """regions: {region: {rack: [shards]}}, all of weight 1."""
    key, path, at = hashlib.md5(str(doc_id).encode()).hexdigest(), "", regions
    count = lambda x: sum(map(count, x.values())) if isinstance(x, dict) else len(x)
    for name in ("region", "rack"):
        best = min(at, key=lambda k: _draw(key, f"{path}{name}{k}", count(at[k])))
        path, at = f"{path}{name}{best}.", at[best]
    return min(at, key=lambda k: _draw(key, f"{path}shard{k}", 1))


def test_shards_equal_a_plain_descent(spark):
    tree = {0: {0: [0, 1], 1: [2, 3]}, 1: {2: [4, 5], 3: [6, 7]}}
    rows = queries.op5_shard_tree(spark, SF).collect()
    for r in rows:
        assert (r["shard"], r["grown_shard"]) == (_descend(r["doc_id"], tree), _descend(r["doc_id"], tree | {2: {4: [8]}}))


def test_weights_decide_shares_and_confine_movement(spark):
    tree = [sharding.Shard(0, 0, 0, 1), sharding.Shard(0, 0, 1, 3), sharding.Shard(0, 1, 2, 2), sharding.Shard(1, 2, 3, 2), sharding.Shard(1, 3, 4, 0)]
    swapped = [sharding.Shard(0, 0, 0, 3), sharding.Shard(0, 0, 1, 1), *tree[2:]]
    rows = spark.range(8000).select(sharding.assign(F.col("id"), tree).alias("a"), sharding.assign(F.col("id"), swapped).alias("b")).collect()
    share = Counter(r["a"] for r in rows)
    assert 4 not in share and all(abs(share[s.shard] / 8000 - s.weight / 8) < 0.03 for s in tree)
    assert all({r["a"], r["b"]} <= {0, 1} for r in rows if r["a"] != r["b"])


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "é"), (3, "é"), (None, "x" * 100000)], "doc_id long, text string").selectExpr("*", "'s' as shard", "0 as slot")
    rows = sharding.shard_documents(docs).collect()
    assert sorted((r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in rows) == sorted((i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in [(1, None), (2, ""), (3, "é"), (3, "é"), (None, "x" * 100000)])
    assert len({(r["shard"], r["slot"]) for r in rows}) == 5
    assert sharding.shard_documents(docs.limit(0)).count() == 0
