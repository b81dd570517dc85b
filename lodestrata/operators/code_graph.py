"""The graph of a repository from its parse records: containment, imports, modules, inheritance and resolved calls.

Tables: files (file, ord), functions (id, file, name, class_owner, ord), classes (id, file, name, bases, ord),
imports (file, imported, alias, ord), calls (call_id, caller, raw). ``ord`` is the order of parsing; where a name stands for
several things, the first or the last by it counts, as each rung says. Paths are normal already. Every rung of a ladder is a
count of matches and the first and last of them, joined by key; one ``when`` picks the first rung that decides.

What the rungs look up has a row for each name and place, not for each definition, and is found once. Where all of it is counted to be small it is broadcast, and
calls are shuffled once, by caller. Where not, it is shuffled by key: a call's answer depends on its file, the class that holds it, what it says
and, only where it bears its caller's name, on the caller; each such question is answered once, and calls are joined with the answers.
Methods are counted by file, class name and name: many classes of one name share them.

Defined results: names that nothing bears are targets of their own kind (``class_target::``, ``unresolved_call::``); null aliases
and owners mean none; empty tables give no edges; a repeated class or function counts as often as it comes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.operators.graph import CERTAIN, FLAGGED, HIGH, LOW, base_class_ladder, checkpoint_dir, import_candidates

def stripped(name: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(name, F.lit(" \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0"))


def last_part(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


#: What is looked up is broadcast up to so many rows: a row for each name and place.
BROADCAST_ROWS = 300_000


def _counted(rows: DataFrame, keys: list[str], prefix: str, value: str = "id") -> DataFrame:
    """How many rows bear a key, and the first and the last of them."""
    pair = F.struct("ord", value)
    return rows.groupBy(*keys).agg(F.count("*").alias(f"{prefix}_n"), F.min(pair)[value].alias(f"{prefix}_id"), F.max(pair)[value].alias(f"{prefix}_2"))


def modules(files: DataFrame) -> DataFrame:
    """(file, ord) -> module (dotted path, path or base name, without extension), module_file: the last file of that name."""
    stem = F.regexp_replace("file", r"(?<=[^/])\.[^./]*$", "")
    names = files.select("file", "ord", F.posexplode(F.array(F.replace(stem, F.lit("/"), F.lit(".")), stem, F.substring_index(stem, "/", -1))).alias("place", "module"))
    return names.groupBy("module").agg(F.max_by("file", F.struct("ord", "place")).alias("module_file"))


def dependencies(imports: DataFrame, files: DataFrame) -> DataFrame:
    """file, imported, target, confidence: the file that an import means; a path that exists is certain, a module's name is strong."""
    asked = imports.select("file", stripped(F.col("imported")).alias("imported")).filter("imported <> ''").distinct()
    directory = F.regexp_extract("file", r"^(.*)/[^/]*$", 1)
    tried = asked.select("file", "imported", F.posexplode(import_candidates(directory, F.col("imported"))).alias("place", "path"))
    hit = tried.filter("path <> file").join(files.select(F.col("file").alias("path")), "path").groupBy("file", "imported").agg(F.min_by("path", "place").alias("path"))
    known = modules(files)
    head = F.when(F.contains("imported", F.lit(".")), F.regexp_extract("imported", r"^(.*)\.[^.]*$", 1)).otherwise(F.col("imported"))
    rows = asked.join(hit, ["file", "imported"], "left").withColumn("head", head)
    rows = rows.join(known.toDF("imported", "whole_file"), "imported", "left").join(known.toDF("head", "head_file"), "head", "left")
    by_name = F.coalesce("whole_file", "head_file")
    rows = rows.withColumn("target", F.coalesce("path", F.when(by_name != F.col("file"), by_name)))
    return rows.filter("target is not null").select("file", "imported", "target", F.when(F.col("path").isNotNull(), CERTAIN).otherwise(HIGH).alias("confidence"))


def bound_imports(imports: DataFrame) -> DataFrame:
    """file, bound, imported, alias: the last import that binds a name; an alias leaves the imported name bound as well."""
    names = F.array_compact(F.array(F.coalesce("alias", last_part(F.col("imported"))), F.when(F.col("alias").isNotNull(), F.col("imported"))))
    rows = imports.select("file", "ord", "imported", "alias", F.posexplode(names).alias("place", "bound"))
    return rows.groupBy("file", "bound").agg(F.max_by(F.struct("imported", "alias"), F.struct("ord", "place")).alias("i")).select("file", "bound", "i.imported", "i.alias")


def inheritance(classes: DataFrame) -> DataFrame:
    """class_id, place (of the base), base, target, confidence."""
    refs = classes.select(F.col("id").alias("class_id"), "file", F.posexplode("bases").alias("place", "base")).filter("base <> ''")
    refs = refs.withColumn("ref_id", F.struct("class_id", "place"))
    found = base_class_ladder(refs.select("ref_id", "file", "base"), classes.select("id", "file", "name"))
    return found.select("ref_id.class_id", "ref_id.place", "base", "target", "confidence")


def ancestors(parents: DataFrame) -> DataFrame:
    """(class_id, place, target) -> class_id, ancestor, way: all ancestors, with the first way to each, shorter ones first, then by the
    places of bases. A round adds one step to ways found in the one before; pairs that are known end there, and so do cycles."""
    checkpoint_dir(parents.sparkSession)
    parents = parents.filter(~F.startswith("target", F.lit("ambiguous_class::")) & ~F.startswith("target", F.lit("class_target::")))  # names lead nowhere
    step = parents.groupBy("class_id", F.col("target").alias("ancestor")).agg(F.min("place").alias("place"))
    known = step.select("class_id", "ancestor", F.array("place").alias("way")).checkpoint()
    fresh = known
    while True:
        more = fresh.select("class_id", F.col("ancestor").alias("via"), "way").join(step.toDF("via", "ancestor", "place"), "via")
        more = more.groupBy("class_id", "ancestor").agg(F.min(F.array_append("way", F.col("place"))).alias("way"))
        fresh = more.join(known.select("class_id", "ancestor"), ["class_id", "ancestor"], "left_anti").checkpoint()
        if fresh.isEmpty():
            return known
        known = known.unionByName(fresh).checkpoint()


def _first_classes(classes: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    """As ``_counted``, with the file of the first class and how often it comes."""
    ids = classes.groupBy("file", "name", "id").agg(F.count("*").alias("copies"), F.min("ord").alias("low"))
    rows = ids.groupBy(*keys).agg(F.sum("copies").alias(f"{prefix}_n"), F.min(F.struct("low", "id", F.col("file").alias("of_file"), "copies")).alias("c"))
    return rows.select(*keys, f"{prefix}_n", F.col("c.id").alias(f"{prefix}_id"), F.col("c.of_file").alias(f"{prefix}_file"), F.col("c.copies").alias(f"{prefix}_copies"))


def _imported(imports: DataFrame, files: DataFrame, depends: DataFrame, of_file: DataFrame, class_near: DataFrame) -> DataFrame:
    """file, bound: what an imported name stands for. means: the file, for ``new X`` and ``x.m``; ic_id: the class of the name there; from_import: the function
    that a bare call means; imported_too: whether the last name of an import, or its alias, is this one."""
    known = modules(files)
    rows = bound_imports(imports)
    module = F.when(F.contains("imported", F.lit(".")), F.regexp_extract("imported", r"^(.*)\.[^.]*$", 1)).otherwise(F.col("imported"))
    rows = rows.withColumn("module", module).withColumn("symbol", last_part(F.col("imported")))
    target = depends.select("file", "imported", "target")
    rows = rows.join(target.toDF("file", "imported", "d_whole"), ["file", "imported"], "left").join(target.toDF("file", "module", "d_module"), ["file", "module"], "left")
    rows = rows.join(known.toDF("imported", "m_whole"), "imported", "left").join(known.toDF("module", "m_module"), "module", "left")
    rows = rows.withColumn("means", F.coalesce("d_whole", "m_whole")).withColumn("bare", F.coalesce("d_whole", "d_module", "m_module", "m_whole"))
    rows = rows.withColumn("sought", F.when(F.col("alias").eqNullSafe(F.col("bound")), F.col("symbol")).otherwise(F.col("bound")))
    of = of_file.select("file", "name", "near_n", "near_id")
    rows = rows.join(of.toDF("bare", "sought", "im_n", "im_id"), ["bare", "sought"], "left").join(of.toDF("bare", "symbol", "is_n", "is_id"), ["bare", "symbol"], "left")
    rows = rows.join(class_near.select(F.col("file").alias("means"), F.col("name").alias("bound"), F.col("cn_id").alias("ic_id")), ["means", "bound"], "left")
    too = imports.select("file", F.coalesce("alias", last_part(F.col("imported"))).alias("bound"), F.lit(True).alias("imported_too")).distinct()
    found = F.when(F.col("im_n") == 1, F.col("im_id")).when(F.col("im_n").isNull() & (F.col("is_n") == 1), F.col("is_id"))
    return rows.join(too, ["file", "bound"], "left").select("file", "bound", "means", "ic_id", found.alias("from_import"), "imported_too")


def _methods(classes: DataFrame, methods: DataFrame, class_near: DataFrame) -> DataFrame:
    """file, class_owner, name -> om_n, om_id: methods of the first class of a name in a file; um_n, um_id: those of its first ancestor that has any.
    An ancestor is the only class of its name where it was found."""
    home = class_near.select("file", F.col("name").alias("class_owner"), F.col("cn_id").alias("class_id"), "cn_copies")
    own = methods.join(home, ["file", "class_owner"]).select("file", "class_owner", "name", (F.col("m_n") * F.col("cn_copies")).alias("om_n"), F.col("m_id").alias("om_id"))
    up = ancestors(inheritance(classes)).join(classes.select(F.col("id").alias("ancestor"), "file", F.col("name").alias("class_owner")), "ancestor").join(methods, ["file", "class_owner"])
    up = up.groupBy("class_id", "name").agg(F.min_by(F.struct("m_n", "m_id"), F.struct(F.size("way"), "way")).alias("u"))
    up = up.join(home, "class_id").select("file", "class_owner", "name", F.col("u.m_n").alias("um_n"), F.col("u.m_id").alias("um_id"))
    return own.join(up, ["file", "class_owner", "name"], "full")


def resolve_calls(calls: DataFrame, functions: DataFrame, classes: DataFrame, imports: DataFrame, files: DataFrame) -> DataFrame:
    """-> call_id, caller, raw, target, confidence, rung (what decided).

    ``new X``: the class that an import of X means, the only one in the file, the only one of the name. ``self.m``, ``this.m`` and
    ``super.m``: the one method of the caller's class, else of its first ancestor that has any. ``x.m``: the function of the module
    that x is bound to, else the method of the only class x. ``f``: the function that an import of f means, that of the first module the
    file depends on, the only other one in the file unless its name is also imported. All but ``new`` end with the only other function of the name.
    """
    checkpoint_dir(calls.sparkSession)
    depends = dependencies(imports, files).checkpoint()
    methods = _counted(functions.filter("class_owner is not null"), ["file", "class_owner", "name"], "m").drop("m_2").checkpoint()
    of_file = _counted(functions, ["file", "name"], "near").checkpoint()
    class_near = _first_classes(classes, ["file", "name"], "cn").checkpoint()
    class_far = _first_classes(classes, ["name"], "cf").checkpoint()
    only = class_far.filter("cf_n = 1").select(F.col("cf_file").alias("file"), F.col("name").alias("class_owner"))
    found = {
        "imported": _imported(imports, files, depends, of_file, class_near),
        "here": of_file.join(class_near.select("file", "name", "cn_n", "cn_id"), ["file", "name"], "full"),
        "far": _counted(functions, ["name"], "far").join(class_far.select("name", "cf_n", "cf_id"), "name", "full"),
        "methods": _methods(classes, methods, class_near),
        "of_class": methods.filter("m_n = 1").join(only, ["file", "class_owner"]).select(F.col("class_owner").alias("receiver"), "name", F.col("m_id").alias("rm_id")),
    }
    found = {k: v.checkpoint() for k, v in found.items()}
    # modules in use and the functions that each of them alone bears
    order = imports.select("file", stripped(F.col("imported")).alias("imported"), "ord").groupBy("file", "imported").agg(F.min("ord").alias("ord"))
    uses = depends.join(order, ["file", "imported"]).select("file", "ord", F.col("target").alias("t"))
    single = of_file.filter("near_n = 1").select(F.col("file").alias("t"), "name", F.col("near_id").alias("offer"))
    offers = uses.groupBy("t").agg(F.count("*").alias("uses")).join(single.groupBy("t").agg(F.count("*").alias("names")), "t").agg(F.coalesce(F.sum(F.col("uses") * F.col("names")), F.lit(0)).alias("n"))
    counts = offers
    for table in (depends, of_file, *found.values()):
        counts = counts.unionByName(table.agg(F.count("*").alias("n")))
    small = max(r["n"] for r in counts.collect()) <= BROADCAST_ROWS  # a number for each of these tables
    near_by = F.broadcast if small else lambda df: df
    homes = functions.select(F.col("id").alias("caller"), "file", "class_owner", F.col("name").alias("own_name"))
    raw = F.col("said")
    kind = F.when(F.startswith(raw, F.lit("new ")), "new").when(F.substring_index(raw, ".", 1).isin("self", "this", "super") & F.contains(raw, F.lit(".")), "receiver").when(F.contains(raw, F.lit(".")), "qualified").otherwise("bare")
    made = calls.join(homes, "caller").withColumn("said", stripped(F.col("raw"))).withColumn("kind", kind)
    subject = F.when(F.col("kind") == "new", last_part(stripped(F.substr(raw, F.lit(5))))).when(F.col("kind") == "bare", raw).otherwise(last_part(raw))
    receiver = F.when(F.col("kind") == "qualified", F.substring_index(F.substring_index(raw, ".", -2), ".", 1))
    made = made.withColumn("name", subject).withColumn("receiver", receiver)
    asked = ("file", "class_owner", "raw", "self_id")  # the caller counts itself out of its own name
    made = made.withColumn("self_id", F.when(F.col("own_name") == F.col("name"), F.col("caller")))
    rows = made if small else made.select(*asked, "kind", "name", "receiver").distinct()
    rows = rows.withColumn("bound", F.coalesce("receiver", "name"))

    rows = rows.join(near_by(found["imported"]), ["file", "bound"], "left").join(near_by(found["here"]), ["file", "name"], "left").join(near_by(found["far"]), "name", "left")
    rows = rows.join(near_by(found["methods"]), ["file", "class_owner", "name"], "left").join(near_by(found["of_class"]), ["receiver", "name"], "left")
    rows = rows.join(near_by(of_file.select(F.col("file").alias("means"), "name", F.col("near_n").alias("im_n"), F.col("near_id").alias("im_id"))), ["means", "name"], "left")
    # the first module, in order of imports, that has one function of the name
    if not small:
        uses = uses.join(rows.filter("kind = 'bare'").select("file", "name").distinct(), "file")
    offered = uses.join(single, ["t"] if small else ["t", "name"]).groupBy("file", "name").agg(F.min_by("offer", "ord").alias("offer"))
    rows = rows.join(near_by(offered), ["file", "name"], "left")

    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    same = F.col("self_id").isNotNull().cast("int")
    rows = rows.withColumn("n1", zero("near_n") - same).withColumn("n2", zero("far_n") - same)
    other = lambda p: F.when(F.col(f"{p}_id") == F.col("self_id"), F.col(f"{p}_2")).otherwise(F.col(f"{p}_id"))
    flag = lambda what, name: F.concat(F.lit(f"{what}::"), name)
    lost, many = flag("unresolved_call", F.col("raw")), flag("ambiguous_call", F.col("name"))
    several = F.concat(F.col("n2").cast("string"), F.lit("_candidate_definitions"))
    is_kind = lambda k: F.col("kind") == k
    rungs: list[tuple[Column, Column, str, Column | str]] = [
        (is_kind("new") & F.col("ic_id").isNotNull(), F.col("ic_id"), HIGH, "constructor_import"),
        (is_kind("new") & (zero("cn_n") == 1), F.col("cn_id"), HIGH, "constructor_same_file"),
        (is_kind("new") & (zero("cf_n") == 1), F.col("cf_id"), LOW, "constructor_repository"),
        (is_kind("new") & (zero("cf_n") > 1), many, FLAGGED, "duplicate_constructor_candidates"),
        (is_kind("new"), lost, FLAGGED, "constructor_target_not_found"),
        (is_kind("receiver") & (zero("om_n") == 1), F.col("om_id"), HIGH, "class_receiver"),
        (is_kind("receiver") & (zero("om_n") > 1), many, FLAGGED, "duplicate_method_in_class"),
        (is_kind("receiver") & (zero("um_n") == 1), F.col("um_id"), HIGH, "inheritance_receiver"),
        (is_kind("receiver") & (F.col("n2") == 1), other("far"), LOW, "receiver_repository"),
        (is_kind("receiver") & (F.col("n2") > 1), many, FLAGGED, several),
        (is_kind("qualified") & (zero("im_n") == 1), F.col("im_id"), HIGH, "module_qualified"),
        (is_kind("qualified") & F.col("rm_id").isNotNull(), F.col("rm_id"), HIGH, "class_qualified"),
        (is_kind("qualified") & (F.col("n2") == 1), other("far"), LOW, "attribute_repository"),
        (is_kind("receiver") | is_kind("qualified"), lost, FLAGGED, "attribute_call_unknown_receiver_type"),
        (F.col("from_import").isNotNull(), F.col("from_import"), HIGH, "imported_call"),
        (F.col("offer").isNotNull(), F.col("offer"), HIGH, "imported_call"),
        (F.col("n1") > 1, many, FLAGGED, "duplicate_same_file_candidates"),
        ((F.col("n1") == 1) & F.col("imported_too").isNull(), other("near"), HIGH, "same_file"),
        (F.col("n1") == 1, many, FLAGGED, "name_collides_with_local_import"),
        (F.col("n2") == 1, other("far"), LOW, "repository_unique"),
        (F.col("n2") > 1, many, FLAGGED, several),
        (F.lit(True), lost, FLAGGED, "no_matching_definition_found"),
    ]
    at = None  # the number of the first rung that holds is found once; the parts of its answer go by it
    for k, (holds, *_) in enumerate(rungs):
        at = F.when(holds, k) if at is None else at.when(holds, k)
    rows = rows.withColumn("_at", at)

    def by_rung(values: list) -> Column:
        """The value of the rung; rungs of one value share a branch."""
        columns = [F.lit(v) if isinstance(v, str) else v for v in values]
        of = {}
        for k, c in enumerate(columns):
            of.setdefault(str(c), (c, []))[1].append(k)
        out = None
        for c, ks in of.values():
            out = F.when(F.col("_at").isin(*ks), c) if out is None else out.when(F.col("_at").isin(*ks), c)
        return out

    parts = [by_rung([r[k] for r in rungs]).alias(name) for k, name in ((1, "target"), (2, "confidence"), (3, "rung"))]
    more = ["line"] if "line" in calls.columns else []
    if small:
        return rows.select("call_id", "caller", "raw", *parts, *more)
    answers = rows.select(*[F.col(c).alias(f"_{c}") for c in asked], F.struct(*parts).alias("_a"))
    told = made.join(answers, [made[c].eqNullSafe(F.col(f"_{c}")) for c in asked])
    return told.select("call_id", "caller", "raw", "_a.target", "_a.confidence", "_a.rung", *more)


def edges(calls: DataFrame, functions: DataFrame, classes: DataFrame, imports: DataFrame, files: DataFrame) -> DataFrame:
    """All edges of the graph: contains, imports, inherits, depends_on and calls, each with what it was found by (``provenance``) and, where
    the record says so, the line it stands on and the alias it binds. Parallel edges stay apart."""
    no_line, no_alias = F.lit(None).cast("int"), F.lit(None).cast("string")

    def edge(df: DataFrame, source: str, target: Column, relation: str, confidence: Column, provenance: Column, alias: Column = no_alias) -> DataFrame:
        line = F.col("line").cast("int") if "line" in df.columns else no_line
        return df.select(F.col(source).alias("source"), target.alias("target"), F.lit(relation).alias("relation"), confidence.alias("confidence"), provenance.alias("provenance"), line.alias("line"), alias.alias("alias"))

    sure, parsed = F.lit(CERTAIN), F.lit("parse_record")
    owners = _counted(classes, ["file", "name"], "c").select("file", F.col("name").alias("class_owner"), F.col("c_id").alias("parent"))
    held = functions.join(owners, ["file", "class_owner"], "left").withColumn("parent", F.coalesce("parent", "file"))
    found = F.when(F.col("confidence") == CERTAIN, "import_path").otherwise("module_name")
    parts = [
        edge(classes, "file", F.col("id"), "contains", sure, parsed),
        edge(held, "parent", F.col("id"), "contains", sure, parsed),
        edge(imports, "file", F.concat(F.lit("import::"), "imported"), "imports", sure, parsed, F.col("alias")),
        edge(inheritance(classes), "class_id", F.col("target"), "inherits", F.col("confidence"), F.concat(F.lit("base:"), F.col("base"))),
        edge(dependencies(imports, files), "file", F.col("target"), "depends_on", F.col("confidence"), found),
        edge(resolve_calls(calls, functions, classes, imports, files), "caller", F.col("target"), "calls", F.col("confidence"), F.col("rung")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
