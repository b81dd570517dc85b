"""Sharding by a hierarchical weighted hash tree.

A key descends region, rack and shard. At each level every child draws ``-ln(u) / weight`` with ``u`` hashed from
the key and the child's own path, and the smallest draw wins; a child wins in proportion to its weight, which is the sum
of the weights below it. A draw depends on nothing but key, path and weight, so a change of weights inside a
subtree leaves every draw elsewhere as it was: rows move only into a child whose weight rose, or out of one whose
weight fell. A new shard opens a region of its own (``grow``), because rows that enter an existing region are dealt to
all its racks; with a new region they can only go into the new shard.

Everything is a Spark expression over one narrow pass; only the numbering of slots shuffles, and that without the text.

Defined results: a null key hashes as the text "null"; repeated rows go to the same shard and get slots of their own;
an empty table gives no rows; a null text counts as no bytes; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hex digits of the key's hash that deal the rows of a shard out for numbering: 4,096 groups a shard.
SLOT_DIGITS = 3


@dataclass(frozen=True)
class Shard:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def plan_tree(shards: int, per_rack: int = 2, per_region: int = 4) -> list[Shard]:
    """``shards`` shards of weight 1: racks of ``per_rack``, regions of ``per_region``."""
    return [Shard(i // per_region, i // per_rack, i) for i in range(shards)]


def grow(tree: list[Shard], weight: float = 1.0) -> list[Shard]:
    """One more shard, in a region and a rack of its own."""
    return [*tree, Shard(max(s.region for s in tree) + 1, max(s.rack for s in tree) + 1, len(tree), weight)]


def key_hash(key: Column) -> Column:
    return F.md5(F.encode(F.coalesce(key.cast("string"), F.lit("null")), "UTF-8"))


def _draw(key: Column, path: str, weight: float) -> Column:
    """-ln(u) / weight, u in (0, 1) from 48 bits of the md5 of the key's hash and the child's path."""
    bits = F.conv(F.substring(F.md5(F.encode(F.concat(key, F.lit(f"/{path}")), "UTF-8")), 1, 12), 16, 10).cast("double")
    return -F.log((bits + F.lit(0.5)) / F.lit(float(2**48))) / F.lit(float(weight))


def _descend(key: Column, tree: list[Shard], level: tuple[str, ...], path: str = "") -> Column:
    name, *rest = level
    children: dict[int, list[Shard]] = {}
    for s in tree:
        if s.weight > 0:
            children.setdefault(getattr(s, name), []).append(s)
    below = {c: _descend(key, own, tuple(rest), f"{path}{name}{c}.") if rest else F.lit(c) for c, own in children.items()}
    if len(children) == 1:
        return next(iter(below.values()))
    draws = {c: _draw(key, f"{path}{name}{c}", sum(s.weight for s in own)) for c, own in children.items()}
    least = F.array_min(F.array(*[F.struct(d.alias("draw"), F.lit(c).alias("child")) for c, d in draws.items()]))["child"]
    cases = [(least == F.lit(c), below[c]) for c in children]
    if not rest:
        return least
    out = F.when(*cases[0])
    for case in cases[1:]:
        out = out.when(*case)
    return out


def assign(key: Column, tree: list[Shard]) -> Column:
    """The shard (int) of a key."""
    return _descend(key_hash(key), tree, ("region", "rack", "shard")).cast("int")


def number_slots(rows: DataFrame, shard: str, order: list[str], hashed: str) -> DataFrame:
    """Adds ``slot``: gapless from 0 within each shard.

    A shard holds a fixed share of all rows, so it is not numbered in one task: rows are counted by (shard, first
    digits of the hash), the counts are summed up over at most 4,096 groups a shard, and rows are numbered in a group.
    """
    rows = rows.withColumn("_group", F.substring(hashed, 1, SLOT_DIGITS))
    before = Window.partitionBy(shard).orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(shard, "_group").agg(F.count("*").alias("_n"))
    starts = starts.select(shard, "_group", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    numbered = rows.withColumn("_k", F.row_number().over(Window.partitionBy(shard, "_group").orderBy(*order)))
    return numbered.join(starts, [shard, "_group"]).withColumn("slot", F.col("_start") + F.col("_k") - 1).drop("_group", "_start", "_k")


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """(doc_id, text) -> doc_id, size, text_crc32, law, shard, slot, grown_shard. The law is ``key``."""
    tree = plan_tree(shards)
    text = F.encode("text", "UTF-8")
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        assign(F.col("doc_id"), tree).alias("shard"),
        assign(F.col("doc_id"), grow(tree)).alias("grown_shard"),
        key_hash(F.col("doc_id")).alias("_hash"),
    )
    out = number_slots(rows, "shard", ["_hash", "doc_id", "size", "text_crc32"], "_hash")
    return out.select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
