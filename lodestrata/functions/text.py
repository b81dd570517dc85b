"""Column expressions on text: paths, lines, tokens, hashes and redaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Line breaks of Unicode text.
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x85\u2028\u2029]"

# Words that mark a path as a test's, and patterns of test file names.
TEST_MARKS = ("test/", "tests/", "testing/")
TEST_NAME = r"^(test_.*|.*_test\.py|conftest\.py)$"


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """With its dot, lower case; none for names that only begin with dots."""
    return F.lower(F.regexp_extract(base_name(path), r"^\.*[^.].*?(\.[^.]*)$", 1))


def is_test_file(path: Column) -> Column:
    rooted = F.concat(F.lit("/"), F.replace(path, F.lit("\\"), F.lit("/")))
    marked = F.lit(False)
    for mark in TEST_MARKS:
        marked = marked | F.contains(rooted, F.lit(mark))
    return marked | F.rlike(base_name(rooted), F.lit(TEST_NAME))


def normal_path(path: Column) -> Column:
    """Slashes forward, then every leading dot and slash off."""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^[./]+", "")


def resolve_relative(directory: Column, relative: Column) -> Column:
    """Join and fold ``.`` and ``..`` away; what climbs above the root keeps its ``..``."""
    parts = F.filter(F.split(F.concat_ws("/", directory, relative), "/"), lambda x: (x != "") & (x != "."))
    folded = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, x: F.when((x == "..") & (F.size(acc) > 0) & (F.element_at(F.concat(F.array(F.lit("..")), acc), -1) != ".."), F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(F.concat(acc, F.array(x))),
    )
    return F.array_join(folded, "/")


def is_safe_relative(path: Column) -> Column:
    """A relative path that never climbs above its root."""
    parts = F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/")
    lowest = F.aggregate(
        parts,
        F.struct(F.lit(0).alias("depth"), F.lit(0).alias("least")),
        lambda a, x: F.struct(
            (a["depth"] + F.when(x == "..", -1).when((x == "") | (x == "."), 0).otherwise(1)).alias("depth"),
            F.least(a["least"], a["depth"] + F.when(x == "..", -1).otherwise(0)).alias("least"),
        ),
    )["least"]
    return ~F.startswith(path, F.lit("/")) & (path != "") & ~F.rlike(path, F.lit(r"^[A-Za-z]:")) & (lowest >= 0)


def lines(text: Column) -> Column:
    """The lines of a text; a break at its very end begins no further line."""
    parts = F.split(text, LINE_BREAK)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def last_segment(name: Column, mark: str = ".") -> Column:
    return F.substring_index(name, mark, -1)


def identifiers(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z_][a-z0-9_]*"), F.lit(0))


def terms(text: Column) -> Column:
    """Unicode words of more than one character, lower case."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)), lambda x: F.char_length(x) > 1)


def overlap(query: Column, other: Column) -> Column:
    """The share of distinct words of ``query`` found in ``other``; 0 without words."""
    distinct = F.array_distinct(query)
    return F.when(F.size(distinct) > 0, F.size(F.array_intersect(distinct, other)) / F.size(distinct)).otherwise(F.lit(0.0))


def redact(text: Column) -> Column:
    """Credentials out of URLs."""
    return F.regexp_replace(text, r"(//)[^/@\s]+@", "$1***@")


def cosine(a: Column, b: Column) -> Column:
    """In doubles; 0 for vectors of different length or without length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norm == 0), F.lit(0.0)).otherwise(dot(a, b) / F.nullif(norm, F.lit(0.0)))


def hash_vector(text: Column, dims: int = 64) -> Column:
    """A unit vector from sha256(text, number): the first four bytes, signed, over 2^31 - 1."""
    raw = F.transform(
        F.sequence(F.lit(0), F.lit(dims - 1)),
        lambda i: F.conv(F.substring(F.sha2(F.concat(text, i.cast("string")), 256), 1, 8), 16, 10).cast("double"),
    )
    signed = F.transform(raw, lambda v: F.when(v >= 2.0**31, v - 2.0**32).otherwise(v) / (2.0**31 - 1))
    norm = F.sqrt(F.aggregate(signed, F.lit(0.0), lambda s, v: s + v * v))
    return F.transform(signed, lambda v: F.when(norm > 0, v / F.nullif(norm, F.lit(0.0))).otherwise(F.lit(1 / dims**0.5)))
