from lodestrata.sources import python_source

TEXT = '''import os.path as p, sys
from . import x
from ..a.b import c as d
from m import *

class Child(mod.Base, Other, Generic[T], metaclass=M):
    def f(self):
        def inner():
            self.g(h())
        return inner()

async def top():
    await sys.exit(1)
'''


def test_records():
    r = python_source.parse("a/b.py", TEXT)
    assert [(f["id"], f["class_owner"]) for f in r["functions"]] == [("a/b.py::Child.f:7", "Child"), ("a/b.py::Child.inner:8", "Child"), ("a/b.py::top:12", None)]
    assert r["functions"][0]["calls"] == ["self.g", "h", "inner"] and r["functions"][1]["calls"] == ["self.g", "h"] and r["functions"][2]["calls"] == ["sys.exit"]
    assert r["classes"][0]["bases"] == ["mod.Base", "Other"] and r["classes"][0]["end_line"] == 10
    assert [(i["imported"], i["alias"]) for i in r["imports"]] == [("os.path", "p"), ("sys", None), ("..x", None), ("..a.b.c", "d"), ("m.*", None)]


def test_broken_files_keep_their_row():
    r = python_source.parse("x.py", "def broken(:")
    assert r["parse_error"].startswith("SyntaxError") and r["functions"] == []


def test_directories(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.py").write_text(TEXT)
    (tmp_path / "b.py").write_bytes("x = 'é'".encode("latin-1"))
    (tmp_path / "c.py").write_bytes(b"\0binary")
    (tmp_path / "d.py").write_bytes(b"")
    (tmp_path / "e.txt").write_text("no")
    rows = {r["file"].rsplit("/", 1)[1]: r for r in python_source.parse_files(python_source.read_directory(spark, str(tmp_path))).collect()}
    assert rows.keys() == {"a.py", "b.py"} and len(rows["a.py"]["functions"]) == 3 and rows["b.py"]["parse_error"] is None


MEASURED = '''
def straight():
    return 1

def ways(a, b):
    # a comment
    if a and b or a:
        return [x for x in a if x if b]
    elif b:
        for y in b:
            assert y
        else:
            pass

    while a:
        try:
            a()
        except ValueError:
            pass
        except OSError:
            pass
        else:
            b = 1 if a else 2

async def inner():
    def one():
        return lambda: 0
    match one():
        case 1:
            with one():
                pass
        case _:
            pass

class C:
    def method(self):
        if self: pass

def deep(x):
''' + "".join("    " * k + "if x:\n" for k in range(1, 42)) + "    " * 42 + "pass\n"


def test_metrics_of_functions_and_their_score(spark):
    from lodestrata.operators import health

    rows = {r[1]: r[2:] for r in python_source.metrics("m.py", MEASURED)}
    # ways: 1 + if 1 + and/or 2 + comprehension 3 + elif 1 + for and else 2 + assert 1 + while 1 + two handlers and else 3 + ternary 1
    assert rows["straight"] == (2, 1, "A", 2, 0) and rows["ways"][1:3] == (16, "C") and rows["ways"][4] == 2
    assert rows["inner"][1:3] == (3, "A") and rows["deep"][1:3] == (42, "F") and rows["deep"][4] == 41 and "method" not in rows
    assert [python_source.complexity_rank(n) for n in (5, 6, 10, 11, 20, 21, 30, 31, 40, 41)] == list("ABBCCDDEEF")
    files = spark.createDataFrame([("m.py", MEASURED), ("broken.py", "def f(:"), ("none.py", None)], "file_path string, text string")
    found = python_source.function_metrics(files)
    assert found.count() == 4
    results = found.selectExpr("1 as run_id", "'complexity' as component", "rank", "cc", "cast(null as double) as mi", "cast(null as string) as severity")
    blocks = spark.createDataFrame([(1, c, "success") for c in health.LEGACY_WEIGHTS], "run_id int, component string, status string")
    row = health.score_document(blocks, results).first()
    assert row["complexity"] == (100 + 70 + 100 + 10) / 4 and row["composite"] == 0.35 * 70 + 65 and row["status"] == "complete"


def test_routes_of_files(spark):
    rows = [("a/b.PY", 5), ("a/../../b.py", 5), ("x.rb", 5), ("big.py", 11 << 20), ("node_modules/x.py", 5), ("src/dist/y.ts", 5), ("dist", 5), ("web/z.Tsx", 5), ("README", 5)]
    got = {r["file_path"]: (r["parser"], r["parse_error"]) for r in python_source.routed(spark.createDataFrame(rows, "file_path string, size long"), {".py": "python", ".tsx": "ts"}).collect()}
    assert got == {
        "a/b.PY": ("python", None), "a/../../b.py": (None, "Unsafe path / path traversal detected for file a/../../b.py"), "x.rb": (None, "Unsupported file extension '.rb' for file x.rb"),
        "big.py": (None, "File size exceeds maximum limit of 10MB: big.py"), "dist": (None, "Unsupported file extension '' for file dist"), "web/z.Tsx": ("ts", None), "README": (None, "Unsupported file extension '' for file README"),
    }
