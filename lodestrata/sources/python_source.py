"""Parse records of Python files: functions, classes and imports as nested rows, one row a file.

A file that can't be parsed keeps its row, with the reason in ``parse_error`` and empty arrays. Unlike an error-tolerant
parser, the standard library's gives nothing at all for a file with a syntax error.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import text as T

# Larger files aren't parsed; what lies in these folders isn't read.
LARGEST_BYTES = 10 * 1024 * 1024
IGNORED_FOLDERS = (".git", "venv", ".venv", "__pycache__", "node_modules", "site-packages", "dist", "build")
RECORD = (
    "file string, parse_error string,"
    " functions array<struct<id:string,name:string,start_line:int,end_line:int,class_owner:string,calls:array<string>>>,"
    " classes array<struct<id:string,name:string,start_line:int,end_line:int,bases:array<string>>>,"
    " imports array<struct<imported:string,alias:string,line:int>>"
)


class _Collector(ast.NodeVisitor):
    def __init__(self, file: str):
        self.file, self.owner = file, None
        self.functions: list[dict] = []
        self.classes: list[dict] = []
        self.imports: list[dict] = []

    def visit_ClassDef(self, node: ast.ClassDef) -> None:
        bases = [ast.unparse(b) for b in node.bases if isinstance(b, (ast.Name, ast.Attribute))]
        self.classes.append({"id": f"{self.file}::{node.name}:{node.lineno}", "name": node.name, "start_line": node.lineno, "end_line": node.end_lineno, "bases": bases})
        outer, self.owner = self.owner, node.name
        self.generic_visit(node)
        self.owner = outer

    def visit_FunctionDef(self, node: ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        name = f"{self.owner}.{node.name}" if self.owner else node.name
        # calls of inner definitions count for the outer function as well
        calls = [ast.unparse(n.func) for n in sorted((n for n in ast.walk(node) if isinstance(n, ast.Call)), key=lambda n: (n.lineno, n.col_offset))]
        self.functions.append({"id": f"{self.file}::{name}:{node.lineno}", "name": node.name, "start_line": node.lineno, "end_line": node.end_lineno, "class_owner": self.owner, "calls": calls})
        self.generic_visit(node)

    visit_AsyncFunctionDef = visit_FunctionDef

    def visit_Import(self, node: ast.Import) -> None:
        self.imports += [{"imported": a.name, "alias": a.asname, "line": node.lineno} for a in node.names]

    def visit_ImportFrom(self, node: ast.ImportFrom) -> None:
        module = "." * node.level + (node.module or "")
        self.imports += [{"imported": f"{module}.{a.name}", "alias": a.asname, "line": node.lineno} for a in node.names]


def parse(file: str, text: str) -> dict:
    empty = {"functions": [], "classes": [], "imports": []}
    if len(text.encode()) > LARGEST_BYTES:
        return {"file": file, "parse_error": "file too large"} | empty
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError) as e:
        return {"file": file, "parse_error": f"{type(e).__name__}: {e}"} | empty
    found = _Collector(file)
    found.visit(tree)
    return {"file": file, "parse_error": None, "functions": found.functions, "classes": found.classes, "imports": found.imports}


def _branches(node: ast.AST) -> int:
    """What a node of the syntax tree adds to the number of ways through its function."""
    match node:
        case ast.If() | ast.IfExp() | ast.Assert():
            return 1
        case ast.For() | ast.AsyncFor() | ast.While():
            return 1 + bool(node.orelse)
        case ast.Try() | ast.TryStar():
            return len(node.handlers) + bool(node.orelse)
        case ast.BoolOp():
            return len(node.values) - 1
        case ast.comprehension():
            return 1 + len(node.ifs)
        case ast.Match():
            return sum(not (isinstance(c.pattern, ast.MatchAs) and c.pattern.pattern is None) for c in node.cases)
        case ast.FunctionDef() | ast.AsyncFunctionDef():  # an inner function has a way of its own
            return 1
    return 0


def _depth(node: ast.AST) -> int:
    """How deep blocks are nested below a node; an elif is as deep as its if."""
    if isinstance(node, ast.If) and len(node.orelse) == 1 and isinstance(node.orelse[0], ast.If):
        return max(1 + max(map(_depth, node.body)), _depth(node.orelse[0]))
    inner = max(map(_depth, ast.iter_child_nodes(node)), default=0)
    return inner + isinstance(node, (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.TryStar, ast.With, ast.AsyncWith, ast.Match))


def complexity_rank(cc: int) -> str:
    return next((rank for most, rank in ((5, "A"), (10, "B"), (20, "C"), (30, "D"), (40, "E")) if cc <= most), "F")


def metrics(file: str, text: str) -> list[tuple]:
    """(file, name, line, cyclomatic complexity, rank, lines of code, nesting) of the functions that stand at the top of a file; a file that
    can't be parsed has none. Lines of code are those that a statement of the function touches, without blank ones and comments."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return []
    out = []
    for node in tree.body:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            below = [n for child in ast.iter_child_nodes(node) for n in ast.walk(child)]
            cc = 1 + sum(map(_branches, below))
            code = [x for x in text.split("\n")[node.lineno - 1 : node.end_lineno] if x.strip() and not x.lstrip().startswith("#")]
            out.append((file, node.name, node.lineno, cc, complexity_rank(cc), len(code), max(map(_depth, node.body))))
    return out


def function_metrics(files: DataFrame) -> DataFrame:
    """(file_path, text) -> file, name, line, cc, rank, nloc, nesting, a row for each function. Files are measured where they are read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [m for p, t in zip(pdf["file_path"], pdf["text"], strict=True) for m in metrics(p, t or "")]
            yield pd.DataFrame(rows, columns=["file", "name", "line", "cc", "rank", "nloc", "nesting"])

    return files.select("file_path", "text").mapInPandas(run, "file string, name string, line int, cc int, rank string, nloc int, nesting int")


def routed(files: DataFrame, parsers: dict[str, str]) -> DataFrame:
    """(file_path: relative, size in bytes) -> those, ``parser`` (by the ending, in any case) and ``parse_error`` of files that none may read: a path that
    leaves the repository, an ending without a parser, a file that is too large. Files in ignored folders go."""
    extension = T.extension(F.col("file_path"))
    parser = None
    for ending, name in parsers.items():
        parser = F.when(extension == ending.lower(), name) if parser is None else parser.when(extension == ending.lower(), name)
    parser = F.lit(None).cast("string") if parser is None else parser
    path = F.col("file_path")
    error = (
        F.when(~T.is_safe_relative(path), F.concat(F.lit("Unsafe path / path traversal detected for file "), path))
        .when(parser.isNull(), F.concat(F.lit("Unsupported file extension '"), extension, F.lit("' for file "), path))
        .when(F.col("size") > LARGEST_BYTES, F.concat(F.lit("File size exceeds maximum limit of 10MB: "), path))
    )
    folders = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    kept = files.filter(~F.arrays_overlap(folders, F.array(*map(F.lit, IGNORED_FOLDERS))))
    return kept.withColumns({"parse_error": error, "parser": F.when(error.isNull(), parser)})


def parse_files(files: DataFrame) -> DataFrame:
    """(file_path, text) -> a parse record for each file. Files are parsed where they are read; nothing is shuffled."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([parse(p, t or "") for p, t in zip(pdf["file_path"], pdf["text"], strict=True)], columns=["file", "parse_error", "functions", "classes", "imports"])

    return files.select("file_path", "text").mapInPandas(run, RECORD)


def read_directory(spark, path: str, pattern: str = "*.py") -> DataFrame:
    """(file_path, text) of the files below ``path``; binary files (a NUL early on) and empty ones are left out, Latin-1 is the fallback."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    head = F.hex(F.substring("content", 1, 8000))
    binary = F.rlike(head, F.lit("^([0-9A-F]{2})*?00"))
    text = F.coalesce(F.try_validate_utf8(F.col("content").cast("string")), F.decode("content", "ISO-8859-1"))
    return raw.filter((F.col("length") > 0) & ~binary).select(F.col("path").alias("file_path"), text.alias("text"))
