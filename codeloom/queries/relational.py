
from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..adapters import with_
from ..operators import search as S
from ..plans.cypher import run_cypher
from ..plans.dsl import compile_query, in_scope
from ..plans.router import routed
from . import query


def tables(spark, d):
    nodes = A.symbols(spark, d).select("id", "name", "kind", "filepath", F.col("complexity").alias("start_line"), (F.col("complexity") + 10).alias("end_line"))
    files = A.bodies(spark, d).select("filepath", "lang", F.col("id").cast("double").alias("mtime"))
    return {"nodes": nodes, "files": files}


def edges(spark, d):
    return A.calls(spark, d).withColumn("rel", F.lit("CALLS"))


NODE = "SELECT id, name, kind, filepath, complexity AS start_line, complexity + 10 AS end_line FROM symbols"


@query(with_("symbols", NODE + " WHERE kind = 'function' AND filepath ILIKE 'brand#1%' AND name ILIKE '%RING%' ORDER BY id LIMIT 10 OFFSET 2"))
def dsl_nodes_filter(spark, d):
    return compile_query('{"select": "nodes", "where": {"kind": "function", "filepath": {"like": "brand#1%"}, "name": {"contains": "RING"}, "unknown": 1}, "limit": 10, "offset": 2}', tables(spark, d))


@query(with_("bodies", "SELECT filepath, lang, CAST(id AS DOUBLE) AS mtime FROM bodies WHERE lang IN ('fr', 'de') ORDER BY filepath LIMIT 100"))
def dsl_files_filter(spark, d):
    return compile_query({"select": "files", "where": {"lang": {"in": ["fr", "de"]}}, "limit": 5000}, tables(spark, d))


@query(with_("calls symbols", NODE + " WHERE kind = 'class' AND id IN (SELECT src FROM calls WHERE dst IN (SELECT id FROM symbols WHERE contains(name, 'ring'))) ORDER BY id LIMIT 50"))
def dsl_join_graph(spark, d):
    return compile_query({"select": "nodes", "where": {"kind": {"eq": "class"}}, "join_graph": {"rel": "CALLS", "target": "ring"}, "limit": 50}, tables(spark, d), edges(spark, d))


@query(with_("symbols", "SELECT id, filepath FROM symbols WHERE starts_with(filepath, 'Brand#2/')"))
def path_scope(spark, d):
    return A.symbols(spark, d).where(in_scope(F.col("filepath"), "Brand#2")).select("id", "filepath")


@query(with_("symbols", "SELECT id, name FROM symbols WHERE kind IN ('class', 'interface')"))
def all_classes(spark, d):
    return A.symbols(spark, d).where(F.col("kind").isin("class", "interface")).select("id", "name")


@query(with_("symbols", "SELECT id, name FROM symbols WHERE kind IN ('function', 'method')"))
def all_functions(spark, d):
    return A.symbols(spark, d).where(F.col("kind").isin("function", "method")).select("id", "name")


@query("SELECT lang, count(*) AS files FROM documents GROUP BY lang")
def files_by_language(spark, d):
    return A.bodies(spark, d).groupBy("lang").agg(F.count(F.lit(1)).alias("files"))


@query(with_("symbols", "SELECT id, name, pagerank FROM symbols WHERE starts_with(filepath, 'Brand#3/') ORDER BY pagerank DESC, id LIMIT 25"))
def pagerank_listing(spark, d):
    return A.symbols(spark, d).where(F.col("filepath").startswith("Brand#3/")).select("id", "name", "pagerank").orderBy(F.desc("pagerank"), "id").limit(25)


@query(with_("symbols", "SELECT id, substr(filepath, 9) AS relative FROM symbols WHERE starts_with(filepath, 'Brand#4/')"))
def browse_tree(spark, d):
    return A.symbols(spark, d).where(F.col("filepath").startswith("Brand#4/")).select("id", F.expr("substring(filepath, 9)").alias("relative"))


@query(with_("symbols", "SELECT count(DISTINCT filepath) AS files, count(*) AS symbols, count(*) FILTER (kind = 'class') AS classes FROM symbols WHERE starts_with(filepath, 'Brand#1')"))
def browse_summary(spark, d):
    return A.symbols(spark, d).where(F.col("filepath").startswith("Brand#1")).agg(F.countDistinct("filepath").alias("files"), F.count(F.lit(1)).alias("symbols"), F.count(F.when(F.col("kind") == "class", 1)).alias("classes"))


@query(with_("bodies", "SELECT id, array_to_string(list_slice(string_split(body, chr(10)), 2, 4), chr(10)) AS code FROM bodies"))
def browse_code(spark, d):
    """Lines 2 to 4 of each file."""
    return A.bodies(spark, d).select("id", F.array_join(F.slice(F.split("body", "\n", -1), 2, 3), "\n").alias("code"))


@query(with_("calls symbols", "SELECT a.name AS caller, count(DISTINCT b.id) AS callees FROM calls c JOIN symbols a ON a.id = c.src JOIN symbols b ON b.id = c.dst WHERE a.kind = 'class' AND b.kind = 'function' AND b.complexity > 10 GROUP BY a.name ORDER BY callees DESC, caller LIMIT 30"))
def cypher_one_hop(spark, d):
    return run_cypher("MATCH (a:Class)-[:CALLS]->(b:Function) WHERE b.complexity > 10 RETURN a.name AS caller, count(DISTINCT b) AS callees ORDER BY callees DESC, caller LIMIT 30", A.symbols(spark, d), edges(spark, d))


@query(with_("calls symbols", "SELECT DISTINCT a.id AS a, c.id AS c FROM calls x JOIN calls y ON y.src = x.dst JOIN symbols a ON a.id = x.src JOIN symbols b ON b.id = x.dst JOIN symbols c ON c.id = y.dst WHERE b.kind = 'method' AND a.complexity < 5"))
def cypher_two_hops(spark, d):
    return run_cypher("MATCH (a)-[:CALLS]->(b:Method)-[:CALLS]->(c) WHERE a.complexity < $most RETURN DISTINCT a.id AS a, c.id AS c", A.symbols(spark, d), edges(spark, d), {"most": 5})


ROUTE_SQL = """WITH q AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'who calls f' || doc_id WHEN 1 THEN 'what does g.h call?' WHEN 2 THEN 'dead code' WHEN 3 THEN 'what depends on a/b.py' WHEN 4 THEN 'list classes' ELSE ' plain words ' END AS q FROM documents)
SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'callers' WHEN 1 THEN 'callees' WHEN 2 THEN 'intent' WHEN 3 THEN 'impact' WHEN 4 THEN 'intent' ELSE 'hybrid' END AS mode, CASE doc_id % 6 WHEN 0 THEN 'f' || doc_id WHEN 1 THEN 'g.h' WHEN 3 THEN 'a/b.py' ELSE trim(q) END AS symbol, CASE doc_id % 6 WHEN 2 THEN 'dead_code' WHEN 4 THEN 'all_classes' END AS intent FROM q"""


@query(ROUTE_SQL)
def route_queries(spark, d):
    k = F.col("doc_id")
    texts = ["dead code", "what depends on a/b.py", "list classes", " plain words "]
    q = F.when(k % 6 == 0, F.concat(F.lit("who calls f"), k.cast("string"))).when(k % 6 == 1, "what does g.h call?")
    for i, t in enumerate(texts, 2):
        q = q.when(k % 6 == i, t)
    return A.table(spark, d, "documents").select("doc_id", *(c.alias(n) for n, c in routed(q).items()))


@query(with_("symbols", "SELECT regexp_replace(filepath, '/[^/]*$', '') AS dir, count(*) AS results FROM symbols GROUP BY 1"))
def directory_groups(spark, d):
    return S.by_directory(A.symbols(spark, d))


@query(with_("changes", ", f AS (SELECT DISTINCT file AS filepath FROM changes) SELECT array_to_string(list_slice(string_split(filepath, '/'), 1, 3), '/') AS package, count(*) AS results FROM f GROUP BY 1 ORDER BY results DESC, package LIMIT 5"))
def impact_packages(spark, d):
    return S.packages(A.changes(spark, d).select(F.col("file").alias("filepath")).distinct())


@query(with_("calls symbols", "SELECT s.id FROM symbols s WHERE id IN (SELECT src FROM calls) AND kind = 'method'"))
def semi_join_ids(spark, d):
    """J15."""
    return A.symbols(spark, d).where("kind = 'method'").join(A.calls(spark, d).select(F.col("src").alias("id")), "id", "left_semi").select("id")


@query(with_("calls", "SELECT src AS id FROM calls UNION SELECT dst FROM calls"))
def union_distinct_ids(spark, d):
    """U1, U4."""
    e = A.calls(spark, d)
    return e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()


@query(with_("calls", "SELECT src AS id FROM calls INTERSECT SELECT dst FROM calls"))
def intersect_ids(spark, d):
    """U2."""
    e = A.calls(spark, d)
    return e.select(F.col("src").alias("id")).intersect(e.select("dst"))


@query(with_("symbols", "SELECT count(*) AS symbols, count(DISTINCT filepath) AS files, count(*) FILTER (id NOT IN (SELECT l_partkey FROM lineitem)) AS unresolved FROM symbols"))
def integrity_counts(spark, d):
    """Totals, and symbols that nothing resolves, by an anti join."""
    s = A.symbols(spark, d)
    lost = s.join(A.table(spark, d, "lineitem").select(F.col("l_partkey").alias("id")), "id", "left_anti").agg(F.count(F.lit(1)).alias("unresolved"))
    return s.agg(F.count(F.lit(1)).alias("symbols"), F.countDistinct("filepath").alias("files")).join(F.broadcast(lost))  # one row each
