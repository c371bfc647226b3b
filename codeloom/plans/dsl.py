"""The JSON query language (P1 to P9, T3): a dict becomes a DataFrame plan."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = {"nodes": ("kind", "filepath", "name", "relationships"), "files": ("filepath", "lang")}
COLUMNS = {"nodes": ("id", "name", "kind", "filepath", "start_line", "end_line"), "files": ("filepath", "lang", "mtime")}
MOST = 100


def predicate(column: str, wanted) -> Column | None:
    """eq (or a plain value), like and contains (both without regard to case), in."""
    c = F.col(column)
    if not isinstance(wanted, dict):
        return c == wanted
    out = None
    for op, value in wanted.items():
        p = c == value if op == "eq" else c.ilike(value) if op == "like" else c.ilike(f"%{value}%") if op == "contains" else c.isin(*value) if op == "in" else None
        if p is not None:
            out = p if out is None else out & p
    return out


def compile_query(query: dict | str, tables: dict[str, DataFrame], edges: DataFrame | None = None) -> DataFrame:
    """select nodes or files, where, join_graph {rel, target}, limit (20, at most 100), offset. Unknown fields don't count."""
    q = json.loads(query) if isinstance(query, str) else query
    select = q.get("select")
    if select not in FIELDS:
        raise ValueError(f"select must be one of {sorted(FIELDS)}")
    df = tables[select]
    for name, wanted in (q.get("where") or {}).items():
        if name in FIELDS[select] and name in df.columns and (p := predicate(name, wanted)) is not None:
            df = df.where(p)
    join = q.get("join_graph")
    if join and edges is not None:
        targets = tables["nodes"].where(name_matches(F.col("name"), join["target"])).select(F.col("id").alias("dst"))
        reached = edges.where(F.col("rel") == join["rel"]).join(targets, "dst", "left_semi").select(F.col("src").alias("id"))
        df = df.join(reached, "id", "left_semi")
    key = "id" if select == "nodes" else "filepath"
    kept = [c for c in COLUMNS[select] if c in df.columns]
    return df.select(*kept).orderBy(key).offset(max(0, int(q.get("offset", 0)))).limit(min(MOST, max(1, int(q.get("limit", 20)))))


def name_matches(name: Column, wanted: str) -> Column:
    """The name, a dotted suffix, or a part of it: the last covers the others."""
    return name.contains(wanted)


#: The extensions whose files are parsed.
EXTENSIONS = ("py", "pyi", "java", "scala", "kt", "kts", "js", "jsx", "ts", "tsx", "mjs", "cjs", "rb", "cs", "cpp", "cc", "cxx", "c", "h", "hpp", "hxx", "go", "rs", "swift")


def in_scope(path: Column, target: str, extensions=EXTENSIONS) -> Column:
    """A file by its extension, else everything below a directory."""
    if target.rpartition(".")[2] in extensions:
        return path == target
    return path.startswith(target.rstrip("/") + "/")
