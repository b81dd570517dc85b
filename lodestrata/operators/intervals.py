"""Joins of positions and intervals that share a key."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Lines of a bin.
BIN_LINES = 128


def stab(points: DataFrame, spans: DataFrame, key: str, line: str = "line", bin_lines: int | None = None) -> DataFrame:
    """Every span of the same key that covers a point: start_line <= line <= end_line.

    An equi join with the range as residual; with ``bin_lines`` the lines are cut into bins that join the key, for keys with very many spans.
    """
    points = points.filter(F.col(line).isNotNull() & (F.col(line) > 0))
    on = [key]
    if bin_lines:
        points = points.withColumn("_bin", F.floor(F.col(line) / bin_lines))
        spans = spans.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("start_line") / bin_lines), F.floor(F.col("end_line") / bin_lines))))
        on.append("_bin")
    return points.join(spans, on).filter((F.col("start_line") <= F.col(line)) & (F.col(line) <= F.col("end_line"))).drop("_bin")


def resolve(points: DataFrame, spans: DataFrame, key: str, point_id: str, tie: list[str], line: str = "line", bin_lines: int = BIN_LINES) -> DataFrame:
    """The covering span that begins last, then ends first, then comes first in ``tie``: one row for each point that is covered."""
    order = Window.partitionBy(point_id).orderBy(F.col("start_line").desc(), "end_line", *tie)
    return stab(points, spans, key, line, bin_lines).withColumn("_k", F.row_number().over(order)).filter("_k = 1").drop("_k")


def overlaps(windows: DataFrame, spans: DataFrame, key: str, start: str = "start", end: str = "end", bin_lines: int = BIN_LINES) -> DataFrame:
    """Windows joined with the spans of the same key that they meet: start_line <= end and end_line >= start; a null bound is open.

    Both sides are cut into bins of lines, which join the key, so that a key with very many spans is spread over tasks. A pair meets in
    each bin that both cover and is kept in one: that of the larger of the two starts. An open window ends with the last line that any span of
    its key has, so it isn't cut into more bins than there are. Windows without a key, or that end before they start, meet nothing.
    """
    bounds = spans.groupBy(key).agg(F.min("start_line").alias("_least"), F.max("end_line").alias("_most"))
    w = windows.join(bounds, key).withColumns({"_from": F.greatest(F.coalesce(start, "_least"), "_least"), "_to": F.least(F.coalesce(end, "_most"), "_most")})
    w = w.filter((F.col("_from") <= F.col("_to")) & (F.coalesce(start, "_least") <= F.coalesce(end, "_most"))).drop("_least", "_most")
    cut = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / bin_lines), F.floor(F.col(b) / bin_lines)))
    s = spans.filter("start_line <= end_line").withColumn("_bin", cut("start_line", "end_line"))
    met = w.withColumn("_bin", cut("_from", "_to")).join(s, [key, "_bin"])
    met = met.filter((F.col("start_line") <= F.col("_to")) & (F.col("end_line") >= F.col("_from")) & (F.col("_bin") == F.floor(F.greatest("_from", "start_line") / bin_lines)))
    return met.drop("_bin", "_from", "_to")
