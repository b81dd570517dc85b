"""Identity and size of a working tree given as a table of files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.labels import in_ignored_folder


def tree_digest(files: DataFrame, tree: str) -> DataFrame:
    """(tree, path, text) -> tree, files, digest, over files outside ignored folders; a null text is an unreadable file.

    A file's hash covers its path and content. Hashes are added up in eight parts of 32 bits and the sums are hashed, so a tree of any
    size is folded on the map side without an order; a file that moves, changes or goes changes the digest.
    """
    mark = F.coalesce("text", F.lit("<unreadable>"))
    hashed = files.filter(~in_ignored_folder(F.col("path"))).select(tree, F.sha2(F.concat("path", F.lit("\n"), F.sha2(mark, 256)), 256).alias("h"))
    part = lambda k: F.conv(F.substring("h", 8 * k + 1, 8), 16, 10).cast("decimal(20,0)")
    summed = hashed.groupBy(tree).agg(F.count("*").alias("files"), *[F.sum(part(k)).alias(f"s{k}") for k in range(8)])
    return summed.select(tree, "files", F.sha2(F.concat_ws(",", *[F.col(f"s{k}").cast("string") for k in range(8)]), 256).alias("digest"))


def tree_size(files: DataFrame, tree: str) -> DataFrame:
    """(tree, path, text, is_link) -> tree, bytes of regular files outside ``.git``."""
    own = ~F.array_contains(F.split("path", "/"), ".git") & ~F.coalesce("is_link", F.lit(False))
    return files.groupBy(tree).agg(F.sum(F.when(own, F.coalesce(F.octet_length("text"), F.lit(0))).otherwise(0).cast("long")).alias("bytes"))
