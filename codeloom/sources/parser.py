"""Parsing of sources into nodes and edges (S3 to S5, M9, M10): Python by its own grammar, other languages by patterns.

A grammar walk is sequential in a file, so this is one Arrow function over files; everything after it is relational.
"""

from __future__ import annotations

import ast
import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "path string, row string, id string, kind string, name string, qualified string, line int, end_line int, complexity int, cognitive int, is_test boolean, recursive boolean, src string, dst string, rel string, detail string"
ARROW = pa.schema([(c.split()[0], {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}[c.split()[1]]) for c in SCHEMA.split(", ")])
BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.With, ast.AsyncWith, ast.IfExp, ast.comprehension)
DEFINITIONS = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
NESTING = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.IfExp)
#: Definitions in other languages: pattern and kind.
PATTERNS = {
    "java": ((r"\b(?:class|interface|enum)\s+(\w+)(?:\s+extends\s+(\w+))?", "Class"), (r"^\s*(?:public|private|protected|static|final|\s)*[\w<>\[\]]+\s+(\w+)\s*\([^;{]*\)\s*(?:throws[^{]*)?\{", "Method")),
    "javascript": ((r"\bclass\s+(\w+)(?:\s+extends\s+(\w+))?", "Class"), (r"\bfunction\s*\*?\s*(\w+)\s*\(", "Function"), (r"\b(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s*)?\([^)]*\)\s*=>", "Function")),
    "go": ((r"^type\s+(\w+)\s+(?:struct|interface)", "Class"), (r"^func\s+(?:\([^)]*\)\s*)?(\w+)\s*\(", "Function")),
    "rust": ((r"\b(?:struct|enum|trait)\s+(\w+)", "Class"), (r"\bfn\s+(\w+)", "Function")),
    "cpp": ((r"\b(?:class|struct)\s+(\w+)(?:\s*:\s*(?:public|private|protected)?\s*(\w+))?\s*\{", "Class"), (r"^[\w:<>*&\s]+?\b(\w+)\s*\([^;{}]*\)\s*(?:const)?\s*\{", "Function")),
    "csharp": ((r"\b(?:class|interface|struct|record)\s+(\w+)(?:\s*:\s*(\w+))?", "Class"), (r"^\s*(?:public|private|protected|internal|static|async|override|virtual|\s)+[\w<>\[\]?]+\s+(\w+)\s*\(", "Method")),
    "kotlin": ((r"\b(?:class|interface|object)\s+(\w+)(?:[^:{\n]*:\s*(\w+))?", "Class"), (r"\bfun\s+(?:<[^>]*>\s*)?(?:\w+\.)?(\w+)\s*\(", "Function")),
    "ruby": ((r"^\s*class\s+(\w+)(?:\s*<\s*(\w+))?", "Class"), (r"^\s*def\s+(?:self\.)?(\w+[?!]?)", "Function")),
}
PATTERNS |= {"typescript": PATTERNS["javascript"], "c": PATTERNS["cpp"], "scala": PATTERNS["kotlin"], "swift": PATTERNS["kotlin"], "php": PATTERNS["javascript"]}
EXTENSIONS = {"py": "python", "java": "java", "js": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go", "rs": "rust", "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "hpp": "cpp", "cs": "csharp", "kt": "kotlin", "scala": "scala", "rb": "ruby", "swift": "swift", "php": "php"}
ROUTES = {"get", "post", "put", "delete", "patch", "head", "options"}


def dotted(node: ast.AST) -> str:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join(([node.id] if isinstance(node, ast.Name) else []) + parts[::-1])


def cognitive(node: ast.AST) -> int:
    """One and the nesting for each branch; one for each run of boolean operators. Long chains of branches nest deeply, so this is a loop."""
    total, stack = 0, [(node, 0)]
    while stack:
        above, depth = stack.pop()
        for child in ast.iter_child_nodes(above):
            if isinstance(child, NESTING):
                total += 1 + depth
                stack.append((child, depth + 1))
            elif not isinstance(child, DEFINITIONS):
                total += isinstance(child, ast.BoolOp)
                stack.append((child, depth))
    return total


class Rows:
    def __init__(self, path: str):
        self.path, self.out = path, []

    def node(self, kind, name, qualified, line, end, **more):
        id_ = self.path if kind == "File" else f"{self.path}::{kind}::{qualified}::{line}"
        self.out.append({"row": "node", "id": id_, "kind": kind, "name": name, "qualified": qualified, "line": line, "end_line": end, **more})
        return id_

    def edge(self, src, dst, rel, line=None, detail=None):
        self.out.append({"row": "edge", "src": src, "dst": dst, "rel": rel, "line": line, "detail": detail})


def _own(node):
    """The nodes below a definition, without those of definitions inside it."""
    return _flat(list(ast.iter_child_nodes(node)))


def _flat(nodes):
    """The nodes and all below them in order, without what lies inside definitions."""
    stack = nodes[::-1]
    while stack:
        n = stack.pop()
        yield n
        if not isinstance(n, DEFINITIONS):
            stack.extend(list(ast.iter_child_nodes(n))[::-1])


def _function(rows: Rows, node, qualified: str, parent: str, kind: str):
    inner = list(_own(node))
    calls = [(dotted(n.func), n.lineno) for n in inner if isinstance(n, ast.Call)]
    complexity = 1 + sum(isinstance(n, BRANCHES) + (len(n.values) - 1 if isinstance(n, ast.BoolOp) else 0) for n in inner)
    recursive = any(name.rpartition(".")[2] == node.name and name.count(".") <= 1 for name, _ in calls)
    me = rows.node(kind, node.name, qualified, node.lineno, node.end_lineno, complexity=complexity, cognitive=cognitive(node), is_test=node.name.startswith("test_"), recursive=recursive)
    rows.edge(parent, me, "CONTAINS")
    arguments = [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs]
    for i, a in enumerate(arguments):
        rows.edge(rows.node("Parameter", a.arg, f"{qualified}.{a.arg}", node.lineno, node.lineno), me, "PARAMETER_OF", detail=str(i))
    if node.returns is not None:
        rows.edge(me, f"external_type::{ast.unparse(node.returns)}", "RETURNS")
    for name, line in calls:
        if name:
            rows.edge(me, f"external::{name}", "CALLS", line)
    if recursive:
        rows.edge(me, me, "RECURSES_TO")
    for n in inner:
        if isinstance(n, ast.Raise) and n.exc is not None:
            rows.edge(me, f"external::{dotted(n.exc.func if isinstance(n.exc, ast.Call) else n.exc)}", "RAISES", n.lineno)
        elif isinstance(n, ast.Attribute) and isinstance(n.value, ast.Name) and n.value.id == "self":
            rows.edge(me, f"state::{n.attr}", "WRITES" if isinstance(n.ctx, (ast.Store, ast.Del)) else "READS", n.lineno)
        if key := _environment(n):
            rows.edge(me, f"env::{key}", "USES", n.lineno)
    for d in node.decorator_list:
        if isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute) and d.func.attr in ROUTES and d.args and isinstance(d.args[0], ast.Constant):
            rows.edge(me, f"route::{d.args[0].value}", "HTTP_CALLS", detail=d.func.attr.upper())
    _body(rows, node.body, qualified, me, "Function")


def _environment(n: ast.AST) -> str | None:
    """The variable's name in os.environ[...], os.environ.get(...) and os.getenv(...)."""
    if isinstance(n, ast.Subscript) and dotted(n.value).endswith("environ") and isinstance(n.slice, ast.Constant):
        return str(n.slice.value)
    if isinstance(n, ast.Call) and dotted(n.func).endswith(("environ.get", "getenv")) and n.args and isinstance(n.args[0], ast.Constant):
        return str(n.args[0].value)
    return None


def _body(rows: Rows, body, prefix: str, parent: str, kind: str):
    """Definitions, imports and lambdas of a body, also those inside branches, loops, handlers and cases."""
    for node in _flat(body):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            _function(rows, node, f"{prefix}.{node.name}".lstrip("."), parent, kind)
        elif isinstance(node, ast.ClassDef):
            qualified = f"{prefix}.{node.name}".lstrip(".")
            me = rows.node("Class", node.name, qualified, node.lineno, node.end_lineno)
            rows.edge(parent, me, "CONTAINS")
            for b in node.bases:
                rows.edge(me, f"external::{dotted(b)}", "INHERITS")
            _body(rows, node.body, qualified, me, "Method")
        elif isinstance(node, ast.Import):
            for a in node.names:
                rows.edge(rows.path, f"external_file::{a.name}", "IMPORTS", node.lineno)
        elif isinstance(node, ast.ImportFrom):
            rows.edge(rows.path, f"external_file::{'.' * node.level}{node.module or ''}", "IMPORTS", node.lineno)
        elif isinstance(node, ast.Lambda):
            name = f"{prefix.rpartition('.')[2]}$lambda_{node.lineno}_{node.col_offset}"
            rows.edge(parent, rows.node("Lambda", name, f"{prefix}.{name}".lstrip("."), node.lineno, node.end_lineno), "CONTAINS_LAMBDA", node.lineno)


def parsed(path: str, text: str) -> list[dict]:
    rows = Rows(path)
    ends = [m.start() for m in re.finditer("\n", text)]
    file = rows.node("File", path.rpartition("/")[2], path, 1, len(ends) + 1)
    language = EXTENSIONS.get(path.rpartition(".")[2].lower())
    if language == "python":
        try:
            _body(rows, ast.parse(text).body, "", file, "Function")
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return rows.out[:1]  # the file alone
    else:
        for pattern, kind in PATTERNS.get(language, ()):
            for m in re.finditer(pattern, text, re.M):
                line = bisect_left(ends, m.start(1)) + 1
                me = rows.node(kind, m[1], m[1], line, line)
                rows.edge(file, me, "CONTAINS")
                if m.re.groups > 1 and m[2]:
                    rows.edge(me, f"external::{m[2]}", "INHERITS")
    return rows.out


def parse(files: DataFrame) -> DataFrame:
    """files(path, text) to rows of nodes and edges (SCHEMA)."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                path, text = batch.column(0)[k].as_py() or "", batch.column(1)[k].as_py() or ""
                yield pa.RecordBatch.from_pylist([{"path": path, **r} for r in parsed(path, text)], ARROW)

    from ..session import ship

    ship(files.sparkSession)
    return files.select("path", "text").mapInArrow(run, SCHEMA)


def nodes(rows: DataFrame) -> DataFrame:
    return rows.where("row = 'node'").select("id", F.lower("kind").alias("kind"), "name", "qualified", "path", "line", "end_line", "complexity", "cognitive", "is_test", "recursive").dropDuplicates(["id"])


def edges(rows: DataFrame) -> DataFrame:
    return rows.where("row = 'edge'").select("src", "dst", "rel", "line", "detail").distinct()


def lambdas(rows: DataFrame) -> DataFrame:
    """(parent): a row for each lambda, as `purity.lambda_density` takes them."""
    return rows.where("row = 'edge' AND rel = 'CONTAINS_LAMBDA'").select(F.col("src").alias("parent"))


def accesses(rows: DataFrame) -> DataFrame:
    """(src, is_mutation, is_taint): accesses to the object's own state, as `purity.state_mutations` takes them; taints aren't traced."""
    return rows.where("row = 'edge' AND rel IN ('READS', 'WRITES')").select("src", (F.col("rel") == "WRITES").alias("is_mutation"), F.lit(False).alias("is_taint"))
