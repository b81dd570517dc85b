"""Golden cases of call resolution, and random repositories against a plain resolver."""

import posixpath
import random

import pytest

from lodestrata.operators import code_graph

SCHEMAS = {
    "files": "file string, ord int",
    "functions": "id string, file string, name string, class_owner string, ord int",
    "classes": "id string, file string, name string, bases array<string>, ord int",
    "imports": "file string, imported string, alias string, ord int",
    "calls": "call_id int, caller string, raw string",
}


def _frames(spark, repo):
    return {k: spark.createDataFrame(repo[k], s) for k, s in SCHEMAS.items()}


def _repo(functions, classes=(), imports=(), calls=(), files=None):
    """functions: (file, name, owner); classes: (file, name, bases); imports: (file, imported, alias); calls: (caller, raw)."""
    files = files or list(dict.fromkeys([x[0] for x in (*functions, *classes, *imports)]))
    ident = lambda f, n, o, k: f"{f}::{o + '.' if o else ''}{n}#{k}"
    return {
        "files": [(f, k) for k, f in enumerate(files)],
        "functions": [(ident(f, n, o, k), f, n, o, k) for k, (f, n, o) in enumerate(functions)],
        "classes": [(f"{f}::{n}@{k}", f, n, list(b), k) for k, (f, n, b) in enumerate(classes)],
        "imports": [(f, i, a, k) for k, (f, i, a) in enumerate(imports)],
        "calls": [(k, ident(*functions[c], c), raw) for k, (c, raw) in enumerate(calls)],
    }


#: The rules of resolution, for each kind of call: the name of a set of candidates, and what follows if it has one, several or no members.
#: "take" answers with the one, "many" calls it ambiguous, "lost" unresolved, "next" asks the next rule.
RULES = {
    "new": [("imported class", "take", "first", "next"), ("class here", "take", "next", "next"), ("class anywhere", "take", "many", "lost")],
    "receiver": [("own method", "take", "many", "next"), ("inherited method", "take", "next", "next"), ("others anywhere", "take", "many", "lost")],
    "qualified": [("of the module", "take", "next", "next"), ("of the class", "take", "next", "next"), ("others anywhere", "take", "lost", "lost")],
    "bare": [("imported", "take", "next", "next"), ("imported by symbol", "take", "next", "next"), ("of a module in use", "take", "next", "next"), ("others here", "unless bound", "many", "next"), ("others anywhere", "take", "many", "lost")],
}


class Plain:
    """Candidates of a call as comprehensions over the records."""

    def __init__(self, repo):
        self.files, self.functions, self.classes, self.imports = ([tuple(r) for r in repo[k]] for k in ("files", "functions", "classes", "imports"))
        stems = [(f, f[: -len(posixpath.splitext(f)[1]) or None]) for f, _ in sorted(self.files, key=lambda r: r[1])]
        self.module = {name: f for f, stem in stems for name in (stem.replace("/", "."), stem, posixpath.basename(stem))}
        self.uses = {(f, i): to for f, i in {r[:2] for r in self.imports} if (to := self.file_of(f, i))}
        self.bound = {(f, n): (i, a) for f, i, a, _ in sorted(self.imports, key=lambda r: r[3]) for n in ((a, i) if a else (i.split(".")[-1],))}

    def file_of(self, file, name):
        """What an import means: a path that exists, else a module of the name or of what stands before its last dot."""
        slashed, near = name.replace(".", "/"), posixpath.normpath(posixpath.join(posixpath.dirname(file), name))
        endings = {"dotted": [".py", ".js", ".ts", ".jsx", ".tsx", ".java", "/index.js", "/index.ts"], "relative": ["", ".js", ".ts", ".jsx", ".tsx", "/index.js", "/index.ts"]}
        paths = [name, *((slashed + e).lstrip("./") for e in endings["dotted"])]
        paths += [(near + e).lstrip("./") for e in endings["relative"] if name.startswith(("./", "../"))]
        exists = {f for f, _ in self.files} - {file}
        by_name = self.module.get(name, self.module.get(name.rpartition(".")[0] or name))
        return next(filter(exists.__contains__, paths), by_name if by_name != file else None)

    def named(self, name, file=None, owner=None):
        return [f[0] for f in self.functions if f[2] == name and file in (None, f[1]) and (owner is None or (f[1], f[3]) == owner)]

    def classes_named(self, name, file=None):
        return [c for c in self.classes if c[2] == name and file in (None, c[1])]

    def methods(self, cls, name):
        return self.named(name, owner=(cls[1], cls[2]))

    def parents(self, cls):
        for base in cls[3]:
            short = base.split(".")[-1]
            found = self.classes_named(short, cls[1]) or self.classes_named(short)
            if len(found) == 1:
                yield found[0]

    def levels(self, cls):
        """Ancestors, a generation at a time, in the order in which bases name them; each once."""
        met, now = [], [cls]
        while now := list(dict.fromkeys(p[0] for c in now for p in self.parents(c) if p[0] not in met)):
            met += now
            now = [next(c for c in self.classes if c[0] == k) for k in now]
            yield from now

    def candidates(self, caller, raw):
        """name, kind and, for each set of RULES, its members."""
        _, file, _, owner, _ = next(f for f in self.functions if f[0] == caller)
        kind = "new" if raw.startswith("new ") else "receiver" if raw.split(".")[0] in ("self", "this", "super") and "." in raw else "qualified" if "." in raw else "bare"
        name = raw.removeprefix("new ").strip().split(".")[-1]
        holder = raw.split(".")[-2] if kind == "qualified" else name
        imported, alias = self.bound.get((file, holder), (None, None))
        known = imported is not None
        symbol, head = (imported.split(".")[-1], imported.rpartition(".")[0] or imported) if known else (None, None)
        whole = self.uses.get((file, imported)) or self.module.get(imported) if known else None
        of = lambda f, n: self.named(n, f) if f else []
        home = self.classes_named(owner, file)[:1] if owner else []
        others = lambda found: [f for f in found if f != caller]
        sets = {"others anywhere": others(self.named(name)), "others here": others(self.named(name, file))}
        sets["imported class"] = [c[0] for c in self.classes_named(name, whole)] if whole else []
        sets["class here"], sets["class anywhere"] = ([c[0] for c in self.classes_named(name, f)] for f in (file, None))
        sets["own method"] = [m for c in home for m in self.methods(c, name)]
        sets["inherited method"] = next((m for c in home for a in self.levels(c) if (m := self.methods(a, name))), [])
        sets["of the module"] = of(whole, name)
        sets["of the class"] = self.methods(c[0], name) if len(c := self.classes_named(holder)) == 1 else []
        means = self.uses.get((file, imported)) or self.uses.get((file, head)) or self.module.get(head) or self.module.get(imported) if known else None
        sets["imported"] = of(means, symbol if alias and alias == raw else name)
        sets["imported by symbol"] = of(means, symbol) if not sets["imported"] else []
        offers = [of(self.uses[f, i], name) for f, i, _, _ in sorted(self.imports, key=lambda r: r[3]) if f == file and (f, i) in self.uses]
        sets["of a module in use"] = next((o for o in offers if len(o) == 1), [])
        bound_here = any(f == file and (a or i.split(".")[-1]) == name for f, i, a, _ in self.imports)
        return kind, name, sets, bound_here

    def answer(self, caller, raw):
        kind, name, sets, bound_here = self.candidates(caller, raw)
        ambiguous, lost = f"ambiguous_call::{name}", f"unresolved_call::{raw}"
        for rule, one, several, none in RULES[kind]:
            found = sets[rule]
            then = one if len(found) == 1 else several if found else none
            if then != "next":
                return {"take": found[:1], "first": found[:1], "many": [ambiguous], "lost": [lost], "unless bound": [ambiguous] if bound_here else found[:1]}[then][0]


def _plain(repo):
    records = Plain(repo)
    return {k: records.answer(caller, raw) for k, caller, raw in repo["calls"]}


def _resolved(spark, repo):
    f = _frames(spark, repo)
    return {r["call_id"]: r for r in code_graph.resolve_calls(f["calls"], f["functions"], f["classes"], f["imports"], f["files"]).collect()}


def test_golden_cases(spark):
    repo = _repo(
        [("a.py", "run", "Child"), ("a.py", "local_work", "Child"), ("b.py", "super_work", "Base"), ("a.py", "compute", None), ("b.py", "compute", None), ("src/client.ts", "render", None), ("src/index.ts", "main", None), ("a.py", "go", None)],
        [("a.py", "Child", ["Base"]), ("b.py", "Base", []), ("c.py", "Service", [])],
        [("a.py", "c.Service", None), ("src/index.ts", "./client", None)],
        [(0, "self.local_work"), (0, "super.super_work"), (7, "new Service"), (6, "render"), (6, "compute"), (7, "nonexistent_func"), (7, "Child.run"), (7, "compute")],
    )
    got = _resolved(spark, repo)
    assert [(got[k]["target"].split("#")[0].split("@")[0], got[k]["confidence"], got[k]["rung"]) for k in range(8)] == [
        ("a.py::Child.local_work", "high_confidence", "class_receiver"),
        ("b.py::Base.super_work", "high_confidence", "inheritance_receiver"),
        ("c.py::Service", "high_confidence", "constructor_import"),
        ("src/client.ts::render", "high_confidence", "imported_call"),
        ("ambiguous_call::compute", "flagged", "2_candidate_definitions"),
        ("unresolved_call::nonexistent_func", "flagged", "no_matching_definition_found"),
        ("a.py::Child.run", "high_confidence", "class_qualified"),
        ("a.py::compute", "high_confidence", "same_file"),
    ]


@pytest.mark.parametrize("seed", range(3))
def test_random_repositories(spark, seed):
    rng = random.Random(seed)
    files = ["a.py", "pkg/b.py", "pkg/c.py", "src/d.ts", "src/e.js", "pkg/a.py"]
    names, types = ["f", "g", "h", "run"], ["A", "B", "C", "Dup"]
    classes = [(rng.choice(files), rng.choice(types), rng.sample(["A", "B", "m.C", "Dup", "Other"], rng.randrange(3))) for _ in range(7)]
    functions = [(f, rng.choice(names), None) for f in files for _ in range(2)] + [(c[0], rng.choice(names), c[1]) for c in classes for _ in range(rng.randrange(3))]
    targets = ["a", "pkg.b", "pkg.b.f", "pkg.c.A", "b", "./e", "../pkg/c", "pkg.a.g", "os.path", "d", "h"]
    imports = [(rng.choice(files), rng.choice(targets), rng.choice([None, None, "f", "A", "x"])) for _ in range(14)]
    raws = ["f", "g", "h", "run", "zzz", "self.f", "self.run", "this.g", "super.h", "b.f", "x.g", "A.f", "Dup.run", "q.h", "new A", "new C", "new Dup", "new None"]
    repo = _repo(functions, classes, imports, [(c, r) for c in range(len(functions)) for r in raws], files)
    got, want = _resolved(spark, repo), _plain(repo)
    assert {k: r["target"] for k, r in got.items()} == want
    assert len({r["rung"] for r in got.values()}) > 8


def test_edges_and_empty_tables(spark):
    repo = _repo([("a.py", "f", "A"), ("b.py", "g", None)], [("a.py", "A", ["X"])], [("b.py", "a", None)], [(1, "f")])
    f = _frames(spark, repo)
    rows = code_graph.edges(f["calls"], f["functions"], f["classes"], f["imports"], f["files"]).collect()
    got = {tuple(r)[:4] for r in rows}
    assert {r["relation"]: r["provenance"] for r in rows} == {"contains": "parse_record", "imports": "parse_record", "inherits": "base:X", "depends_on": "import_path", "calls": "imported_call"}
    sure = "structural_certain"
    assert got == {
        ("a.py", "a.py::A@0", "contains", sure), ("a.py::A@0", "a.py::A.f#0", "contains", sure), ("b.py", "b.py::g#1", "contains", sure), ("b.py", "import::a", "imports", sure),
        ("a.py::A@0", "class_target::X", "inherits", sure), ("b.py", "a.py", "depends_on", sure), ("b.py::g#1", "a.py::A.f#0", "calls", "high_confidence"),
    }
    none = {k: v.limit(0) for k, v in f.items()}
    assert code_graph.edges(none["calls"], none["functions"], none["classes"], none["imports"], none["files"]).count() == 0


def test_lines_aliases_and_white_space(spark):
    repo = _repo([("a.py", "f", "A"), ("a.py", "g", "A"), ("b.py", "h", None)], [("a.py", "A", [])], [("b.py", "a", "x"), ("b.py", "a", "y")], [(0, "\t self.g\n"), (2, " h\t"), (0, "new\tA"), (0, "\xa0new A ")])
    f = _frames(spark, repo)
    calls = f["calls"].selectExpr("*", "call_id + 10 as line")
    rows = code_graph.edges(calls, f["functions"], f["classes"], f["imports"], f["files"]).collect()
    assert sorted(r["alias"] for r in rows if r["relation"] == "imports") == ["x", "y"]
    assert {r["line"]: (r["target"], r["provenance"]) for r in rows if r["relation"] == "calls"} == {
        10: ("a.py::A.g#1", "class_receiver"), 11: ("unresolved_call:: h\t", "no_matching_definition_found"), 12: ("unresolved_call::new\tA", "no_matching_definition_found"), 13: ("a.py::A@0", "constructor_same_file"),
    }


def test_records_of_the_tables_against_the_plain_resolver(spark):
    from lodestrata.plans.records import records

    names = ("calls", "functions", "classes", "imports", "files")
    repo = {k: [tuple(r) for r in v.orderBy("ord").collect()] if k != "calls" else [tuple(r) for r in v.collect()] for k, v in zip(names, records(spark, "/root/testdata/sf0.001"), strict=True)}
    repo["calls"] = [((c, caller, raw), caller, raw) for c, caller, raw in repo["calls"]]  # lines may share a number
    got = {(r["call_id"], r["caller"], r["raw"]): r for r in code_graph.resolve_calls(*records(spark, "/root/testdata/sf0.001")).collect()}
    assert {k: r["target"] for k, r in got.items()} == _plain(repo)
    assert len({r["rung"] for r in got.values()}) > 8


def test_classes_of_one_name_share_their_methods(spark):
    repo = _repo([("a.py", f"f{k % 3}", "A") for k in range(60)], [("a.py", "A", ["A"]) for _ in range(50)], (), [(0, "self.f1"), (1, "self.g")])
    f = _frames(spark, repo)
    classes = code_graph._first_classes(f["classes"], ["file", "name"], "cn")
    methods = code_graph._methods(f["classes"], code_graph._counted(f["functions"], ["file", "class_owner", "name"], "m"), classes)
    assert methods.count() == 3  # not one for each class
    assert {k: r["target"] for k, r in _resolved(spark, repo).items()} == _plain(repo)


def test_tables_too_large_to_broadcast(spark, monkeypatch):
    monkeypatch.setattr(code_graph, "BROADCAST_ROWS", 1)
    names = ["f", "g", "self.f", "b.g", "A.f", "new A", "q.h", "super.g", "x.g"]
    functions = [("a.py", "f", "A"), ("a.py", "g", None), ("b.py", "g", None), ("b.py", "f", "B"), ("c.py", "h", None)]
    repo = _repo(functions, [("a.py", "A", ["B"]), ("b.py", "B", [])], [("a.py", "b", None), ("c.py", "b", "x"), ("c.py", "a.g", "f")], [(c, n) for c in range(5) for n in names])
    assert {k: r["target"] for k, r in _resolved(spark, repo).items()} == _plain(repo)
