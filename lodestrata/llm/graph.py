"""Connected components of link tables, by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.common import remove, scratch


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node hands its larger neighbours to the smallest of its neighbours and itself. Edges are (u, v), u > v."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node hands its smaller neighbours and itself to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    ends = edges.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return ends.filter("u > v").distinct()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(a, b) links -> (node, component), the smallest node of its component; only nodes that have links.

    Rounds are written to the shared folder, so lineage stays short. The number of rounds grows with the logarithm of the
    longest chain; stars of near copies settle in one or two.
    """
    spark = edges.sparkSession
    now = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    mark, old = None, None
    for _ in range(most_rounds):
        path = scratch(spark, "components")
        _small_star(_large_star(now)).write.parquet(path)
        now = spark.read.schema("u long, v long").parquet(path)
        if old:
            remove(spark, old)
        old = path
        new = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if new == mark:
            break
        mark = new
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = now.select(F.col("v").alias("u")).distinct().select("u", F.col("u").alias("v"))
    return now.unionByName(roots).select(F.col("u").alias("node"), F.col("v").alias("component"))
