import pytest
from pyspark.sql import functions as F

from codeloom.plans.cypher import run_cypher
from codeloom.plans.dsl import compile_query, in_scope
from codeloom.plans.router import route, routed

ROUTES = {
    "Who calls load.rows?": ("callers", "load.rows", None),
    "callers of  sum_up": ("callers", "sum_up", None),
    "what does sum_up call": ("callees", "sum_up", None),
    "callees of Loader.open": ("callees", "Loader.open", None),
    "dependencies of lib/io.c": ("impact", "lib/io.c", None),
    "what depends on Loader?": ("impact", "Loader", None),
    "neighborhood Loader": ("community", "Loader", None),
    "related to sum_up": ("community", "sum_up", None),
    "unused code": ("intent", "unused code", "dead_code"),
    "ALL classes": ("intent", "ALL classes", "all_classes"),
    "list functions": ("intent", "list functions", "all_functions"),
    "entrypoint": ("intent", "entrypoint", "entry_points"),
    "match (x)\nreturn x": ("cypher", "match (x)\nreturn x", None),
    " read a table fast ": ("hybrid", "read a table fast", None),
    "who calls two words": ("hybrid", "who calls two words", None),
    "": ("hybrid", "", None),
}


def test_routes(spark):
    df = spark.createDataFrame([(q,) for q in ROUTES], "q string")
    got = df.select("q", *(c.alias(n) for n, c in routed(F.col("q")).items())).collect()
    assert {r["q"]: (r["mode"], r["symbol"], r["intent"]) for r in got} == ROUTES
    assert route(spark, "callers of x") == ("callers", "x", None) and route(spark, None) == ("hybrid", "", None)


@pytest.fixture(scope="module")
def graph(spark):
    nodes = spark.createDataFrame([(1, "Loader", "Class", "a/b.py", 5), (2, "sum_up", "Function", "a/b.py", 1), (3, "other", "Function", "c.py", 9)], "id long, name string, kind string, filepath string, size long")
    edges = spark.createDataFrame([(2, 1, "CALLS"), (3, 1, "CALLS"), (1, 3, "INHERITS")], "src long, dst long, rel string")
    return nodes, edges


def test_dsl(graph):
    nodes, edges = graph
    ids = lambda q: [r["id"] for r in compile_query(q, {"nodes": nodes}, edges).collect()]
    assert ids({"select": "nodes", "where": {"kind": {"eq": "Function"}, "filepath": {"like": "A/%"}}, "limit": 10}) == [2]
    assert ids('{"select": "nodes", "where": {"name": {"contains": "LOAD"}, "nothing": 1}}') == [1]
    assert ids({"select": "nodes", "where": {"kind": {"in": ["Class", "Module"]}}}) == [1]
    assert ids({"select": "nodes", "join_graph": {"rel": "CALLS", "target": "Loader"}}) == [2, 3]
    assert ids({"select": "nodes", "limit": 0, "offset": 1}) == [2]
    with pytest.raises(ValueError):
        compile_query({"select": "edges"}, {"nodes": nodes})


def test_scope(graph):
    names = lambda t: [r["id"] for r in graph[0].where(in_scope(F.col("filepath"), t)).orderBy("id").collect()]
    assert names("a/b.py") == [1, 2] and names("a") == [1, 2] and names("a/") == [1, 2] and names("b") == []


def test_cypher(graph):
    rows = lambda q, **p: [tuple(r) for r in run_cypher(q, *graph, p).collect()]
    assert rows("MATCH (a:Function)-[:CALLS]->(b:Class {name: 'Loader'}) RETURN a.name AS x ORDER BY x") == [("other",), ("sum_up",)]
    assert rows("MATCH (b)<-[r:CALLS]-(a) RETURN b.name AS b, count(*) AS n") == [("Loader", 2)]
    assert rows("MATCH (n) WHERE n.size >= $least AND n.name CONTAINS 't' RETURN n.id AS id", least=2) == [(3,)]
    assert rows("MATCH (a)-[:CALLS]->(b)-[:INHERITS]->(c) RETURN DISTINCT c.id AS c, a.id AS a ORDER BY a DESC LIMIT 1") == [(3, 3)]
    for bad in ("MATCH (n) DELETE n RETURN n", "RETURN 1", "MATCH (a)--(b) RETURN a"):
        with pytest.raises(ValueError):
            run_cypher(bad, *graph)
    assert rows("MATCH (n {name: 'DROP'}) RETURN n.id AS id") == []
