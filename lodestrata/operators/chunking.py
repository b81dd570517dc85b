"""Source chunks: line windows, entity chunks, uncovered lines, content-derived ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.text import lines

WINDOW_LINES = 50
WHOLE_ENTITY_LINES = 100
CHUNKER_VERSION = "1"


def chunk_id(commit: Column, path: Column, start: Column, end: Column, text: Column, version: str = CHUNKER_VERSION) -> Column:
    """Equal content at an equal place has an equal id; a null commit counts as empty."""
    key = F.concat_ws("\n", F.coalesce(commit, F.lit("")), path, start.cast("string"), end.cast("string"), F.lit(version), text)
    return F.concat(F.lit("sc_"), F.substring(F.sha2(key, 256), 1, 32))


def islands(rows: DataFrame, keys: list[str], position: str, more: dict[str, Column] | None = None) -> DataFrame:
    """Runs of consecutive positions: keys, start_line, end_line and the aggregates in ``more``."""
    run = F.col(position) - F.row_number().over(Window.partitionBy(*keys).orderBy(position))
    out = rows.withColumn("_run", run).groupBy(*keys, "_run").agg(F.min(position).alias("start_line"), F.max(position).alias("end_line"), *[c.alias(n) for n, c in (more or {}).items()])
    return out.drop("_run")


def windows(files: DataFrame, size: int = WINDOW_LINES) -> DataFrame:
    """(file_path, text, ...) -> a chunk for every ``size`` lines. One pass over arrays: no shuffle."""
    cut = files.withColumn("_lines", lines(F.col("text"))).filter(F.size("_lines") > 0)
    starts = F.sequence(F.lit(1), F.size("_lines"), F.lit(size))
    texts = F.transform(starts, lambda s: F.struct(s.alias("start_line"), F.least(s + size - 1, F.size("_lines")).alias("end_line"), F.array_join(F.slice("_lines", s, F.lit(size)), "\n").alias("chunk_text")))
    parts = cut.select(*[c for c in files.columns if c != "text"], F.explode(texts).alias("_c")).select(*[c for c in files.columns if c != "text"], "_c.*")
    return parts.withColumn("chunk_id", chunk_id(F.lit(None).cast("string"), F.col("file_path"), F.col("start_line"), F.col("end_line"), F.col("chunk_text")))


def entity_chunks(files: DataFrame, entities: DataFrame, size: int = WINDOW_LINES, whole: int = WHOLE_ENTITY_LINES) -> DataFrame:
    """Chunks of entities, in windows beyond ``whole`` lines, then of the lines that no entity covers.

    (file_path, text), (file_path, start_line, end_line, name) -> file_path, start_line, end_line, name (null: uncovered), chunk_text, chunk_id.
    Entities may overlap: each is chunked. Their spans end with the file at both ends, and those that have no line in it give no chunk.
    They are gathered for each file, so the text is shuffled once; chunks are cut before they are exploded, so lines aren't copied for each.
    """
    spans = entities.groupBy("file_path").agg(F.collect_list(F.struct("start_line", "end_line", "name")).alias("_spans"))
    rows = files.select("file_path", lines(F.coalesce("text", F.lit(""))).alias("_lines")).join(spans, "file_path", "left")
    inside = F.transform("_spans", lambda s: F.struct(F.greatest(F.lit(1), s.start_line).alias("start_line"), F.least(F.size("_lines"), s.end_line).alias("end_line"), s["name"].alias("name")))
    none = F.array().cast("array<struct<start_line:int,end_line:int,name:string>>")
    rows = rows.withColumn("_spans", F.coalesce(F.filter(inside, lambda s: s.start_line <= s.end_line), none))
    cut = F.flatten(
        F.transform(
            "_spans",
            lambda s: F.when(s.end_line - s.start_line + 1 <= whole, F.array(F.struct(s.start_line.alias("s"), s.end_line.alias("e"), s["name"].alias("n")))).otherwise(
                F.transform(
                    F.sequence(s.start_line, s.end_line, F.lit(size)),
                    lambda b: F.struct(b.alias("s"), F.least(b + size - 1, s.end_line).alias("e"), s["name"].alias("n")),
                )
            ),
        )
    )
    # gaps: between the furthest end so far and the next start, in order of start
    ordered = F.array_sort(F.transform("_spans", lambda s: F.struct(s.start_line.alias("s"), s.end_line.alias("e"))))
    gaps = F.aggregate(
        F.concat(ordered, F.array(F.struct((F.size("_lines") + 1).alias("s"), (F.size("_lines") + 1).alias("e")))),
        F.struct(F.lit(1).alias("next"), F.array().cast("array<struct<s:int,e:int>>").alias("gaps")),
        lambda a, x: F.struct(
            F.greatest(a["next"], x["e"] + 1).alias("next"),
            F.when(x["s"] > a["next"], F.concat(a["gaps"], F.array(F.struct(a["next"].alias("s"), (x["s"] - 1).alias("e"))))).otherwise(a["gaps"]).alias("gaps"),
        ),
    )["gaps"]
    loose = F.flatten(
        F.transform(
            gaps,
            lambda g: F.transform(F.sequence(g["s"], g["e"], F.lit(size)), lambda b: F.struct(b.alias("s"), F.least(b + size - 1, g["e"]).alias("e"), F.lit(None).cast("string").alias("n"))),
        )
    )
    texts = F.transform(F.concat(cut, loose), lambda c: F.struct(c["s"].alias("start_line"), c["e"].alias("end_line"), c["n"].alias("name"), F.array_join(F.slice("_lines", c["s"], c["e"] - c["s"] + 1), "\n").alias("chunk_text")))
    out = rows.select("file_path", F.explode(texts).alias("c")).select("file_path", "c.*")
    return out.withColumn("chunk_id", chunk_id(F.lit(None).cast("string"), F.col("file_path"), F.col("start_line"), F.col("end_line"), F.col("chunk_text")))


def overlapping(chunks: DataFrame, file_path: str | None = None, start: int | None = None, end: int | None = None, entity: str | None = None) -> DataFrame:
    """Chunks that meet the given range of lines; each condition is optional."""
    for condition in (
        None if file_path is None else F.col("file_path") == file_path,
        None if start is None else F.col("end_line") >= start,
        None if end is None else F.col("start_line") <= end,
        None if entity is None else F.col("name") == entity,
    ):
        chunks = chunks if condition is None else chunks.filter(condition)
    return chunks
