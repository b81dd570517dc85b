"""Ordered pages with totals, incident edges, upserts and integrity checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_ROWS = 500


def page(rows: DataFrame, order: list[Column | str], offset: int = 0, limit: int = 50) -> DataFrame:
    """Rows of a page; nulls last. Sorting and cutting are one top-k step, whatever the table's size."""
    if not 1 <= limit <= MOST_ROWS or offset < 0:
        raise ValueError(f"a page has 1 to {MOST_ROWS} rows and begins at 0 or later")
    return rows.orderBy(*[F.col(c).asc_nulls_last() if isinstance(c, str) else c for c in order]).offset(offset).limit(limit)


def equal(rows: DataFrame, **values) -> DataFrame:
    """Rows with these values; None leaves a column open."""
    for column, value in values.items():
        if value is not None:
            rows = rows.filter(F.col(column) == value)
    return rows


def incident_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an end among ``nodes`` (id), each as often as it is there: semi joins by one end, then by the other for the
    rest, as a join on either end would compare all with all."""
    source, target = nodes.select(F.col("id").alias("source")), nodes.select(F.col("id").alias("target"))
    out = edges.join(source, "source", "left_semi")
    return out.unionByName(edges.join(source, "source", "left_anti").join(target, "target", "left_semi"))


def node_page(nodes: DataFrame, edges: DataFrame, node_type: str | None = None, file_path: str | None = None, offset: int = 0, limit: int = 50) -> tuple[DataFrame, DataFrame]:
    """A page of (id, node_type, file_path, start_line, ...), of one type or file or of all, each node with the ``total`` of its filter, and the
    edges (source, target, ...) that have an end on the page. The nodes of files have no path, so a filter by path leaves them out."""
    own = equal(nodes, node_type=node_type, file_path=file_path)
    total = own.agg(F.count("*").alias("total"))
    shown = page(own, ["node_type", "file_path", "start_line", "id"], offset, limit).join(F.broadcast(total))  # one row
    return shown, incident_edges(edges, shown.select("id"))


def missing(rows: DataFrame, known: DataFrame, on: list[str]) -> DataFrame:
    """Distinct keys of ``rows`` that ``known`` lacks."""
    return rows.select(*on).distinct().join(known.select(*on), on, "left_anti")


def upsert(known: DataFrame, fresh: DataFrame, on: list[str]) -> DataFrame:
    """``known`` and those of ``fresh`` that are new to it, each key once."""
    return known.unionByName(fresh.dropDuplicates(on).join(known.select(*on), on, "left_anti"))
