"""A read-only subset of openCypher (G15, P16, P17) compiled to joins.

MATCH (a:Label {k: v})-[:REL]->(b)... [WHERE a.k op v AND ...] RETURN [DISTINCT] a.k AS x, count(*) AS n [ORDER BY x [DESC]] [LIMIT n].
A label is a kind. Chains of any length in either direction; each step is an equi-join, and filters reach the scans.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FORBIDDEN = re.compile(r"\b(CREATE|MERGE|SET|DELETE|REMOVE|DROP)\b", re.IGNORECASE)
QUERY = re.compile(r"^\s*MATCH\s+(?P<match>.+?)(?:\s+WHERE\s+(?P<where>.+?))?\s+RETURN\s+(?P<distinct>DISTINCT\s+)?(?P<ret>.+?)(?:\s+ORDER\s+BY\s+(?P<order>.+?))?(?:\s+LIMIT\s+(?P<limit>\d+))?\s*;?\s*$", re.IGNORECASE | re.DOTALL)
NODE = re.compile(r"\(\s*(\w+)?\s*(?::\s*(\w+))?\s*(?:\{(.*?)\})?\s*\)")
EDGE = re.compile(r"(<)?-\[\s*(\w+)?\s*(?::\s*(\w+))?\s*\]-(>)?")
TERM = re.compile(r"^\s*(\w+)\.(\w+)\s*(=|<>|<=|>=|<|>|CONTAINS|STARTS WITH|ENDS WITH)\s*(.+?)\s*$", re.IGNORECASE)


def _value(text: str, parameters: dict):
    text = text.strip()
    if text.startswith("$"):
        return parameters[text[1:]]
    if text[:1] in "'\"":
        return text[1:-1]
    return float(text) if "." in text else int(text)


def run_cypher(query: str, nodes: DataFrame, edges: DataFrame, parameters: dict | None = None) -> DataFrame:
    """nodes(id, kind, ...), edges(src, dst, rel, ...)."""
    if FORBIDDEN.search(re.sub(r"'[^']*'|\"[^\"]*\"", "", query)):
        raise ValueError("only reading queries are allowed")
    m = QUERY.match(query)
    if not m:
        raise ValueError("not in the supported subset")
    given = parameters or {}
    at, previous, df, named = 0, None, None, 0
    text = m["match"]
    while at < len(text):
        n = NODE.match(text, at)
        if not n:
            raise ValueError(f"a node is expected at: {text[at:at + 30]}")
        named += 1
        var = n[1] or f"_n{named}"
        side = nodes
        if n[2]:
            side = side.where(F.lower("kind") == n[2].lower())
        for pair in filter(None, (n[3] or "").split(",")):
            k, _, v = pair.partition(":")
            side = side.where(F.col(k.strip()) == _value(v, given))
        side = side.select(*(F.col(c).alias(f"{var}.{c}") for c in nodes.columns))
        if previous is None:
            df = side
        else:
            left, edge = previous
            rel = edges.where(F.col("rel") == edge[3]) if edge[3] else edges
            a, b = ("dst", "src") if edge[1] else ("src", "dst")
            step = rel.select(F.col(a).alias("_from"), F.col(b).alias("_to"), F.col("rel").alias(f"{edge[2] or f'_r{named}'}.rel"))
            df = df.join(step, F.col(f"`{left}.id`") == F.col("_from")).join(side, F.col("_to") == F.col(f"`{var}.id`")).drop("_from", "_to")
        at = n.end()
        if at >= len(text.rstrip()):
            break
        e = EDGE.match(text, at)
        if not e or bool(e[1]) == bool(e[4]):
            raise ValueError(f"a directed relation is expected at: {text[at:at + 30]}")
        previous, at = (var, e), e.end()
    for term in re.split(r"\s+AND\s+", m["where"] or "", flags=re.IGNORECASE):
        if term.strip():
            t = TERM.match(term)
            if not t:
                raise ValueError(f"not a supported condition: {term}")
            c, op, v = F.col(f"`{t[1]}.{t[2]}`"), t[3].upper(), _value(t[4], given)
            df = df.where({"=": lambda: c == v, "<>": lambda: c != v, "<": lambda: c < v, ">": lambda: c > v, "<=": lambda: c <= v, ">=": lambda: c >= v, "CONTAINS": lambda: c.contains(v), "STARTS WITH": lambda: c.startswith(v), "ENDS WITH": lambda: c.endswith(v)}[op]())
    keys, sums = [], []
    for item in m["ret"].split(","):
        expr, _, alias = re.sub(r"\s+AS\s+", "\0", item.strip(), flags=re.IGNORECASE).partition("\0")
        if c := re.match(r"count\(\s*(DISTINCT\s+)?(?:\*|(\w+)(?:\.(\w+))?)\s*\)$", expr, re.IGNORECASE):
            column = F.col(f"`{c[2]}.{c[3] or 'id'}`") if c[2] else F.lit(1)
            sums.append((F.countDistinct(column) if c[1] else F.count(column)).alias(alias or expr))
        else:
            var, _, field = expr.partition(".")
            keys.append(F.col(f"`{var}.{field or 'id'}`").alias(alias or expr.replace(".", "_")))
    out = df.groupBy(*keys).agg(*sums) if sums else df.select(*keys)
    out = out.distinct() if m["distinct"] else out
    if m["order"]:
        by = []
        for item in m["order"].split(","):
            name, _, way = item.strip().partition(" ")
            c = F.col(name.replace(".", "_") if name.replace(".", "_") in out.columns else name)
            by.append(c.desc() if way.strip().upper() == "DESC" else c.asc())
        out = out.orderBy(*by)
    return out.limit(int(m["limit"])) if m["limit"] else out
