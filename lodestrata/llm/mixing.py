"""Mixing sources to target weights by weighted fair queueing, in Spark expressions only.

Each source is a queue of its documents in a fixed shuffled order, run through up to ``max_epochs`` times. A document
finishes at the virtual time (words of its source up to and with it) / (its source's target). The mix serves all queues in
order of finish time and stops at the total budget: at any time each source has had about the same share of its target.

Cumulative words of a source are summed in two steps, by groups of the shuffle hash and then inside a group, so a
source that holds a third of all rows is spread over 4,096 groups. Copies are then sorted globally, by range-partitioning their
finish times into as many ranges as the table needs. The ranges' totals say in which range the budget ends; that range is
walked in order, and the last copy that is served says for every other one, by comparison, whether it is taken.

Defined results: a null text has size 0; null is a source of its own, last in order; documents without words, and
sources without any, are taken 0 times; equal finish times are served in order of source, shuffle hash, size and copy; repeated
rows are documents of their own; an empty table gives no rows; extra columns are ignored but for those to carry.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.llm.common import WORD, materialize

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: Copies in one range of finish times, about; beyond some 10^9 copies ranges and their number grow alike.
RANGE_ROWS = 50_000
SHUFFLE_DIGITS = 3


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size) -> those, weight and target.

    A target is min(most x size, level x weight) with one level for all, which is where resharing the excess ends.
    Sources sorted by most x size / weight are capped in that order, so running sums give the level in closed form.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    k = (F.row_number().over(by_name) - 1) % len(weights)
    ranked = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), k + 1).cast("double"))
    ranked = ranked.withColumn("_cap", (F.col("source_size") * most).cast("double")).withColumn("_ratio", F.col("_cap") / F.col("weight"))
    order = Window.orderBy("_ratio", F.col("source").asc_nulls_last())
    upto, beyond = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    # with the sources before this one capped, the rest would stand at this level
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(upto), F.lit(0.0))) / F.sum("weight").over(beyond)
    ranked = ranked.withColumn("_level", F.when(level <= F.col("_ratio"), level))
    ranked = ranked.withColumn("_level", F.max("_level").over(everything))  # beyond the first that holds, too many are capped and it sinks
    return ranked.select("source", "source_size", "weight", F.least("_cap", F.col("_level") * F.col("weight")).alias("target"))


def _source_key():
    """A key that is never null: a source, or that there is none."""
    return F.when(F.col("source").isNull(), "0").otherwise(F.concat(F.lit("1"), "source"))


def word_sizes(docs: DataFrame, *carry) -> DataFrame:
    """(doc_id, source, text) -> doc_id, source, size in words, and the columns to carry."""
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), *carry)


def queue(docs: DataFrame, size: str = "size", weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, size) -> those, ``source_size``, ``target``, ``shuffled`` (the shuffle hash), ``upto`` (words of the source up
    to and with this document) and ``first_time`` (virtual finish time of the first copy; null if it has no words)."""
    rows = docs.select(
        "doc_id", "source", F.col(size).cast("long").alias("size"), *carry,
        F.md5(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "UTF-8")).alias("shuffled"),
    ).withColumn("_group", F.substring("shuffled", 1, SHUFFLE_DIGITS)).withColumn("_source", _source_key())
    groups = rows.groupBy("_source", "_group").agg(F.first("source").alias("source"), F.sum("size").alias("_n"))
    sizes = groups.groupBy("_source").agg(F.first("source").alias("source"), F.sum("_n").alias("source_size"))
    targets = source_targets(sizes, weights, max_epochs).select(_source_key().alias("_source"), "source_size", "target")
    before = Window.partitionBy("_source").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    starts = groups.select("_source", "_group", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    # what a group needs to know of its source, a row for each group
    known = starts.join(targets, "_source")
    inside = Window.partitionBy("_source", "_group").orderBy("shuffled", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_within", F.sum("size").over(inside)).join(known, ["_source", "_group"]).withColumn("upto", F.col("_start") + F.col("_within"))
    first = F.when((F.col("size") > 0) & (F.col("target") > 0), F.col("upto") / F.col("target"))
    return rows.select("doc_id", "source", "size", *carry, "source_size", "target", "shuffled", "upto", first.alias("first_time"))


def _served_at(epoch):
    """What copies are served in order of."""
    time = (F.col("upto") + epoch * F.col("source_size")) / F.col("target")
    nulls_last = F.when(F.col("source").isNull(), "1").otherwise(F.concat(F.lit("0"), "source"))
    return F.struct(time.alias("time"), nulls_last.alias("source"), F.col("shuffled").alias("shuffled"), F.col("size").alias("size"), epoch.cast("int").alias("epoch"))


def mix(docs: DataFrame, size: str = "size", weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, size) -> what ``queue`` gives, without ``upto``, and ``epochs`` (copies the mix takes), a row for each document.

    ``docs`` is read twice: give a narrow table that is already written. To write the mix, repeat a document ``epochs`` times; copy
    e finishes at first_time + e x source_size / target.
    """
    spark = docs.sparkSession
    queued = materialize(spark, queue(docs, size, weights, max_epochs, carry), "mix-queue")
    epochs = F.sequence(F.lit(0), F.lit(max_epochs - 1))
    served = queued.filter("first_time is not null")
    copies = served.select("upto", "source_size", "target", "source", "shuffled", "size", F.explode(epochs).alias("epoch")).select(_served_at(F.col("epoch")).alias("at"))
    n = max_epochs * served.count()
    ranges = max(1, -(-n // max(RANGE_ROWS, math.isqrt(3 * n))))
    ordered = copies.repartitionByRange(ranges, "at").select("at", F.col("at.size").alias("size"), F.spark_partition_id().alias("range"))
    ordered = materialize(spark, ordered, "mix-order")
    budget = queued.agg(F.sum("size")).first()[0] or 0
    upto = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    totals = ordered.groupBy("range").agg(F.sum("size").alias("n")).withColumn("upto", F.sum("n").over(upto))  # a row for each range
    cut = totals.filter(F.col("upto") > budget).orderBy("range").select("range", (F.lit(budget) - F.col("upto") + F.col("n")).alias("left")).first()
    if cut is None:  # everything fits
        taken = F.lit(max_epochs)
    else:
        walked = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
        inside = ordered.filter(F.col("range") == cut["range"]).withColumn("served", F.sum("size").over(walked)).filter(F.col("served") <= cut["left"])
        # the last copy that is served: in the range where the budget ends, or else in one before it
        last = inside.agg(F.max("at")).first()[0] or ordered.filter(F.col("range") < cut["range"]).agg(F.max("at")).first()[0]
        if last is None:
            taken = F.lit(0)
        else:
            kind = ordered.schema["at"].dataType
            end = F.struct(*[F.lit(last[f.name]).cast(f.dataType).alias(f.name) for f in kind])
            taken = F.size(F.filter(epochs, lambda e: _served_at(e) <= end))
    return queued.withColumn("epochs", F.when(F.col("first_time").isNotNull(), taken).otherwise(0).cast("int")).select(
        "doc_id", "source", "size", *carry, "source_size", "target", "epochs", "first_time", "shuffled"
    )
