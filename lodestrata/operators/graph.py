"""The code knowledge graph as two tables: nodes and edges, with ladders of ever weaker matches for what a name refers to.

A ladder is a set of candidate joins, each with the number of its matches; the first rung that has any decides. Nothing is
looked up row by row and nothing is collected: ladders are counts per key, left joins and one ``when``.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Confidences, and suffixes that an import path may lack.
CERTAIN, HIGH, LOW, FLAGGED = "structural_certain", "high_confidence", "low_confidence", "flagged"
PATH_SUFFIXES = (".py", ".js", ".ts", ".jsx", ".tsx", ".java", "/index.js", "/index.ts")
RELATIVE_SUFFIXES = ("", ".js", ".ts", ".jsx", ".tsx", "/index.js", "/index.ts")


def candidates(symbols: DataFrame, keys: list[str], prefix: str, order: str = "id") -> DataFrame:
    """For each key: how many symbols bear it, the first and the last of them."""
    return symbols.groupBy(*keys).agg(F.count("*").alias(f"{prefix}_n"), F.min_by("id", order).alias(f"{prefix}_id"), F.max_by("id", order).alias(f"{prefix}_2"))


def base_class_ladder(refs: DataFrame, classes: DataFrame) -> DataFrame:
    """(ref_id, file, base) against (id, file, name) -> target, confidence, provenance.

    One class of the name in the file is certain, several there are flagged; else one in the repository is weak, several are
    flagged; else the base is external.
    """
    short = F.substring_index("base", ".", -1)
    rows = refs.withColumn("name", short).join(candidates(classes, ["file", "name"], "near"), ["file", "name"], "left").join(candidates(classes, ["name"], "far"), "name", "left")
    case = lambda a, b, c, d, e: F.when(F.col("near_n") == 1, a).when(F.col("near_n") > 1, b).when(F.col("far_n") == 1, c).when(F.col("far_n") > 1, d).otherwise(e)
    ambiguous = F.concat(F.lit("ambiguous_class::"), "name")
    return rows.select(
        "ref_id", "file", "base",
        case(F.col("near_id").cast("string"), ambiguous, F.col("far_id").cast("string"), ambiguous, F.concat(F.lit("class_target::"), "base")).alias("target"),
        case(*map(F.lit, (CERTAIN, FLAGGED, LOW, FLAGGED, CERTAIN))).alias("confidence"),
    )


def call_ladder(calls: DataFrame, functions: DataFrame) -> DataFrame:
    """Bare calls (call_id, caller, file, name) against (id, file, name) -> target, confidence, provenance.

    In the caller's file without the caller: one match is strong, several are ambiguous. Else in the repository without the
    caller: one is weak, several are ambiguous. Else the call is unresolved. The caller itself is counted out by arithmetic, not by a join of all pairs:
    where it is one of two, the other is the first or the last.
    """
    near, far = candidates(functions, ["file", "name"], "near"), candidates(functions, ["name"], "far")
    own = functions.select(F.col("id").alias("caller"), F.col("name").alias("own_name"), F.col("file").alias("own_file"))
    rows = calls.join(near, ["file", "name"], "left").join(far, "name", "left").join(own, "caller", "left")
    self_far = F.coalesce((F.col("own_name") == F.col("name")).cast("int"), F.lit(0))
    self_near = F.coalesce(((F.col("own_name") == F.col("name")) & (F.col("own_file") == F.col("file"))).cast("int"), F.lit(0))
    rows = rows.withColumn("n1", F.coalesce("near_n", F.lit(0)) - self_near).withColumn("n2", F.coalesce("far_n", F.lit(0)) - self_far)
    pick = lambda prefix: F.when(F.col(f"{prefix}_id") == F.col("caller"), F.col(f"{prefix}_2")).otherwise(F.col(f"{prefix}_id")).cast("string")
    ambiguous, lost = F.concat(F.lit("ambiguous_call::"), "name"), F.concat(F.lit("unresolved_call::"), "name")
    case = lambda a, b, c, d, e: F.when(F.col("n1") > 1, a).when(F.col("n1") == 1, b).when(F.col("n2") == 1, c).when(F.col("n2") > 1, d).otherwise(e)
    return rows.select(
        "call_id", "caller", "name",
        case(ambiguous, pick("near"), pick("far"), ambiguous, lost).alias("target"),
        case(*map(F.lit, (FLAGGED, HIGH, LOW, FLAGGED, FLAGGED))).alias("confidence"),
        case(F.lit("duplicate_same_file_candidates"), F.lit("same_file"), F.lit("repository_unique"), F.concat(F.col("n2").cast("string"), F.lit("_candidate_definitions")), F.lit("no_matching_definition_found")).alias("provenance"),
    )


def import_candidates(directory: Column, name: Column) -> Column:
    """Paths that an import may mean, best first: as written, dots as slashes with each suffix, relative with each suffix."""
    from lodestrata.functions.text import normal_path, resolve_relative

    plain = normal_path(F.replace(name, F.lit("."), F.lit("/")))
    relative = resolve_relative(directory, name)
    is_relative = F.startswith(name, F.lit("./")) | F.startswith(name, F.lit("../"))
    found = F.array(name, *[F.concat(plain, F.lit(s)) for s in PATH_SUFFIXES])
    more = F.when(is_relative, F.array(*[F.concat(relative, F.lit(s)) for s in RELATIVE_SUFFIXES])).otherwise(F.array().cast("array<string>"))
    return F.concat(found, more)


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(import_id, file, imported) against (path) -> target, the best candidate that exists and isn't the file itself, or null."""
    directory = F.regexp_extract("file", r"^(.*)/[^/]*$", 1)
    tried = imports.select("import_id", "file", "imported", F.posexplode(import_candidates(directory, F.col("imported"))).alias("place", "path"))
    hit = tried.filter(F.col("path") != F.col("file")).join(files.select("path"), "path").groupBy("import_id").agg(F.min_by("path", "place").alias("target"))
    return imports.join(hit, "import_id", "left")


def checkpoint_dir(spark) -> None:
    """The session's checkpoint folder; a private one is made only in a local session that configures none, as in tests."""
    if spark.sparkContext.getCheckpointDir() is None:
        base = spark.conf.get("spark.checkpoint.dir", "")
        if not base and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(base or f"file://{tempfile.mkdtemp(prefix='lodestrata-')}")


def closure(parents: DataFrame, spark) -> DataFrame:
    """(child, parent) -> (child, ancestor, depth), the shortest way, however long; a pair that is there already ends a walk.

    Ways up to a length are joined with those of just that length, so the length doubles in each round. A shortest way has
    one point at each length, so it is found from there and a pair that comes later is no shorter. Rounds are checkpointed.
    """
    checkpoint_dir(spark)
    ways = parents.select("child", F.col("parent").alias("ancestor"), F.lit(1).alias("depth")).distinct().checkpoint()
    reach = 1
    while True:
        far = ways.filter(F.col("depth") == reach).select("child", F.col("ancestor").alias("_via"))
        on = ways.select(F.col("child").alias("_via"), "ancestor", F.col("depth").alias("_more"))
        found = far.join(on, "_via").filter("child <> ancestor").groupBy("child", "ancestor").agg((F.min("_more") + reach).alias("depth"))
        found = found.join(ways.select("child", "ancestor"), ["child", "ancestor"], "left_anti").checkpoint()
        if found.isEmpty():
            return ways
        ways, reach = ways.unionByName(found).checkpoint(), 2 * reach


def summary(edges: DataFrame) -> DataFrame:
    """Edges by relation and confidence in one row."""
    calls = F.col("relation") == "calls"
    good = calls & F.col("confidence").isin(HIGH, LOW, CERTAIN)
    return edges.agg(
        F.count("*").alias("edges"),
        F.countDistinct("source").alias("sources"),
        F.count_if(calls).alias("calls"),
        F.count_if(F.col("relation") == "inherits").alias("inherits"),
        F.count_if(calls & (F.col("confidence") == HIGH)).alias("calls_high"),
        F.count_if(calls & (F.col("confidence") == LOW)).alias("calls_low"),
        F.count_if(calls & (F.col("confidence") == FLAGGED)).alias("calls_flagged"),
        F.round(100.0 * F.count_if(good) / F.greatest(F.count_if(calls), F.lit(1)), 9).alias("resolved_percent"),
    )


def architecture(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Call edges between different files, each pair of files once, with the number of calls."""
    a, b = nodes.select(F.col("id").cast("string").alias("source"), F.col("file").alias("source_file")), nodes.select(F.col("id").cast("string").alias("target"), F.col("file").alias("target_file"))
    rows = edges.join(a, "source").join(b, "target").filter("source_file <> target_file")
    return rows.groupBy("source_file", "target_file").agg(F.count("*").alias("calls"))


def stratified(edges: DataFrame, quota: int, seed: str, keys: list[str]) -> DataFrame:
    """Up to ``quota`` edges of each relation, chosen by a seeded hash of the edge."""
    order = F.md5(F.encode(F.concat_ws("|", F.lit(seed), *[F.col(k).cast("string") for k in keys]), "UTF-8"))
    ranked = edges.withColumn("_k", F.row_number().over(Window.partitionBy("relation").orderBy(order, *keys)))
    return ranked.filter(F.col("_k") <= quota).drop("_k")


#: Fixed value: relations that a sample is drawn from, where there are any.
SAMPLED = ("calls", "imports", "inherits", "contains")


def sample(edges: DataFrame, size: int, seed: str, keys: list[str], relations: tuple[str, ...] = SAMPLED) -> DataFrame:
    """``size`` edges, as many of each relation that there is, and what a short relation leaves filled up from all that remain; in a seeded order.

    Relations other than ``relations`` count only where there is none of those. Every choice follows a hash of seed and keys, so it is the same on
    any partitioning; ranks are cut to those that can be chosen before they are shuffled. Edges are told apart by ``keys``.
    """
    known = edges.filter(F.col("relation").isin(*relations))
    counts = {r["relation"]: r["count"] for r in known.groupBy("relation").count().collect()}  # as many as ``relations`` at most
    if counts:
        edges, share = known, max(1, size // len(counts))
    else:
        share = max(1, size // max(1, edges.select("relation").distinct().count()))
    hashed = edges.withColumn("_h", F.md5(F.encode(F.concat_ws("|", F.lit(seed), *[F.col(k).cast("string") for k in keys]), "UTF-8")))
    ranked = hashed.withColumn("_k", F.row_number().over(Window.partitionBy("relation").orderBy("_h", *keys))).filter(F.col("_k") <= share + size)
    chosen, rest = ranked.filter(F.col("_k") <= share), ranked.filter(F.col("_k") > share)
    needed = size - (sum(min(n, share) for n in counts.values()) if counts else chosen.count())
    out = chosen.unionByName(rest.orderBy("_h", *keys).limit(needed)) if needed > 0 else chosen
    return out.withColumn("place", F.row_number().over(Window.orderBy("_h", *keys))).drop("_h", "_k")  # the sample alone


def stored_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_type), (relation, confidence) of a stored run -> one row: totals, calls by confidence as ``name=n`` in order of names, and
    the share of calls that are resolved. A missing confidence counts as flagged; unknown ones are counted under their names."""
    kind = lambda name: F.count_if(F.col("node_type") == name)
    relation = lambda name: F.sum(F.when(F.col("relation") == name, F.col("n")).otherwise(0)).alias(name)
    calls = F.col("relation") == "calls"
    n = nodes.agg(F.count("*").alias("nodes"), kind("finding").alias("findings"), kind("class").alias("classes"), kind("function").alias("functions"), kind("file").alias("files"))
    each = edges.groupBy("relation", F.coalesce("confidence", F.lit("flagged")).alias("confidence")).agg(F.count("*").alias("n"))
    good = F.sum(F.when(calls & F.col("confidence").isin("high_confidence", "low_confidence"), F.col("n")).otherwise(0))
    listed = F.sort_array(F.collect_list(F.when(calls, F.concat_ws("=", "confidence", F.col("n").cast("string")))))  # a row for each confidence
    e = each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("edges"), *[F.coalesce(relation(x), F.lit(0)).alias(x) for x in ("calls", "inherits", "depends_on", "has_finding")], F.coalesce(good, F.lit(0)).alias("good"), F.array_join(listed, ",").alias("by_confidence"))
    return n.join(F.broadcast(e)).withColumn("resolved_pct", F.round(100.0 * F.col("good") / F.greatest("calls", F.lit(1)), 1)).drop("good")  # one row with one row
