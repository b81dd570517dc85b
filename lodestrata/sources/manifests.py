"""Dependency manifests: requirement lines, package.json and pyproject.toml."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A name, then what may stand for a version without an operator.
_NAME, _PLAIN = r"^([A-Za-z0-9_.-]+)", r"^[A-Za-z0-9_.-]+\s*([A-Za-z0-9_.-]*)"


def parse_requirements(lines: DataFrame) -> DataFrame:
    """(line, ...) -> those, package and version (empty unless pinned); comments, environment markers, options and blank lines go."""
    bare = F.trim(F.substring_index(F.substring_index(F.regexp_replace("line", r"^\s+|\s+$", ""), " #", 1), ";", 1))
    rows = lines.filter(~F.rlike(F.col("line"), F.lit(r"^\s*($|#|-)"))).withColumn("_bare", bare)
    rows = rows.withColumn("package", F.regexp_extract("_bare", _NAME, 1)).filter("package <> ''")
    pinned = F.regexp_extract(F.get(F.split("_bare", "=="), F.lit(1)), r"(\S+)", 1)
    version = F.when(F.contains(F.col("_bare"), F.lit("==")), pinned).when(F.rlike(F.col("_bare"), F.lit("[<>]|~=|!=")), "").otherwise(F.regexp_extract("_bare", _PLAIN, 1))
    return rows.withColumn("version", version).drop("_bare")


def parse_package_json(files: DataFrame) -> DataFrame:
    """(file_path, text) -> package, version, ecosystem, manifest_file of dependencies and development dependencies."""
    kind = "struct<dependencies:map<string,string>,devDependencies:map<string,string>>"
    parsed = files.select("file_path", F.from_json("text", kind).alias("j"))
    empty = F.create_map().cast("map<string,string>")
    both = F.array_union(F.map_entries(F.coalesce("j.dependencies", empty)), F.map_entries(F.coalesce("j.devDependencies", empty)))
    rows = parsed.select("file_path", F.explode(both).alias("e"))
    return rows.select(
        F.col("e.key").alias("package"), F.regexp_replace("e.value", r"^[\^~=>]+", "").alias("version"), F.lit("npm").alias("ecosystem"), F.col("file_path").alias("manifest_file")
    ).dropDuplicates()


def parse_pyproject(files: DataFrame) -> DataFrame:
    """(file_path, text) -> package, version, ecosystem, manifest_file, error. A file that can't be read, or a table of dependencies
    that isn't one, gives a row with its error and no package."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re
        import tomllib

        def within(doc: dict, *names: str) -> dict:
            for name in names:
                doc = doc.get(name) if isinstance(doc, dict) else None
            return doc if isinstance(doc, dict) else {}

        for pdf in batches:
            rows = []
            for path, text in zip(pdf["file_path"], pdf["text"], strict=True):
                broken = lambda what, path=path: rows.append((None, None, "PyPI", path, what))
                try:
                    doc = tomllib.loads(text or "text = {")  # a missing text is unreadable
                except (tomllib.TOMLDecodeError, TypeError) as e:
                    broken(f"unreadable: {e}")
                    continue
                specs = within(doc, "project").get("dependencies", [])
                if not isinstance(specs, list):
                    broken("project.dependencies is no list")
                    specs = []
                for spec in specs:
                    if m := isinstance(spec, str) and re.match(r"\s*([A-Za-z0-9._-]+)(?:\[[^\]]*\])?\s*(?:==\s*([^\s;,]+))?", spec):
                        rows.append((m[1], m[2], "PyPI", path, None))
                for name, spec in within(doc, "tool", "poetry", "dependencies").items():
                    version = spec.get("version") if isinstance(spec, dict) else spec
                    if name.lower() != "python":
                        rows.append((name, version.lstrip("^~=>") if isinstance(version, str) else None, "PyPI", path, None))
            yield pd.DataFrame(rows, columns=["package", "version", "ecosystem", "manifest_file", "error"])

    return files.select("file_path", "text").mapInPandas(run, "package string, version string, ecosystem string, manifest_file string, error string").dropDuplicates()
