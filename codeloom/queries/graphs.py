
from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..adapters import with_
from ..operators import graph as G
from ..session import written
from . import query

SEEDS = "id % 20 = 0"


def stored_calls(spark, d):
    """The call graph, written once for operators that read it at every step."""
    return written(A.calls(spark, d), "calls")


def seeds(spark, d):
    return A.symbols(spark, d).where(SEEDS).select("id")


@query(with_("calls", "SELECT DISTINCT dst AS seed, src AS id FROM calls"))
def callers(spark, d):
    """Every symbol is a seed."""
    return G.neighbours(A.calls(spark, d), A.symbols(spark, d), forward=False)


@query(with_("calls", "SELECT DISTINCT src AS seed, dst AS id FROM calls"))
def callees(spark, d):
    """Every symbol is a seed."""
    return G.neighbours(A.calls(spark, d), A.symbols(spark, d))


@query(with_("trade", ", e AS (SELECT 'TRADES' AS rel, src, dst, weight FROM trade WHERE src = 3 UNION ALL SELECT 'IN_REGION', n_nationkey, n_regionkey, 1 FROM nation WHERE n_nationkey = 3) SELECT * FROM e"))
def explain_edges(spark, d):
    """All edges out of one node, with their relation."""
    member = A.table(spark, d, "nation").select(F.lit("IN_REGION").alias("rel"), F.col("n_nationkey").cast("long").alias("src"), F.col("n_regionkey").cast("long").alias("dst"), F.lit(1).cast("long").alias("weight"))
    return A.trade(spark, d).select(F.lit("TRADES").alias("rel"), "src", "dst", "weight").union(member).where("src = 3")


TRACE = "w(id, hop) AS (SELECT p_partkey, 0 FROM part WHERE p_partkey % 20 = 0 UNION SELECT e.{b}, hop + 1 FROM w JOIN calls e ON e.{a} = w.id WHERE hop < {k})"


@query(with_("calls", ", " + TRACE.format(a="src", b="dst", k=6) + " SELECT id, CAST(min(hop) AS BIGINT) AS hop FROM w GROUP BY id HAVING min(hop) > 0", True))
def trace_hops(spark, d):
    """From every symbol whose id is divisible by 20, so seeds grow with the table."""
    return G.trace(stored_calls(spark, d), A.symbols(spark, d).where("id % 20 = 0").select("id"), 6)


@query(with_("calls symbols", ", w(id, hop) AS (SELECT p_partkey, 0 FROM part WHERE p_partkey BETWEEN 1500 AND 1520 UNION SELECT e.src, hop + 1 FROM w JOIN calls e ON e.dst = w.id WHERE hop < 4), m AS (SELECT id, min(hop) AS hop FROM w GROUP BY id HAVING min(hop) > 0) SELECT regexp_extract(name, '^[^.]*') AS name, CAST(min(hop) AS BIGINT) AS distance FROM m JOIN symbols USING (id) GROUP BY 1", True))
def impact_transitive(spark, d):
    names = A.symbols(spark, d).select("id", F.substring_index("name", ".", 1).alias("name"))
    return G.impact(stored_calls(spark, d), A.symbols(spark, d).where("id BETWEEN 1500 AND 1520"), 4, names)


@query(with_("calls symbols", ", c AS (SELECT dst AS id, count(DISTINCT src) AS callers FROM calls GROUP BY 1) SELECT s.id, s.name, coalesce(callers, 0) AS callers FROM symbols s LEFT JOIN c USING (id) WHERE kind IN ('function', 'method')"))
def caller_counts(spark, d):
    return G.caller_counts(A.calls(spark, d), A.symbols(spark, d))


@query(with_("calls symbols", ", c AS (SELECT dst AS id, count(DISTINCT src) AS callers FROM calls GROUP BY 1) SELECT s.id, s.name, callers FROM symbols s JOIN c USING (id) WHERE kind IN ('function', 'method') AND callers >= 5"))
def entry_points(spark, d):
    return G.caller_counts(A.calls(spark, d), A.symbols(spark, d)).where("callers >= 5")


@query(with_("calls symbols", "SELECT id, name, kind FROM symbols WHERE kind IN ('function', 'method') AND NOT EXISTS (SELECT 1 FROM calls WHERE dst = id)"))
def dead_code(spark, d):
    return G.dead_code(A.calls(spark, d), A.symbols(spark, d))


DEGREES = ", ends AS (SELECT src AS id, 0 AS i, 1 AS o FROM {0} UNION ALL SELECT dst, 1, 0 FROM {0}), deg AS (SELECT id, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree FROM ends GROUP BY id) "


@query(with_("calls", DEGREES.format("calls") + "SELECT *, in_degree + out_degree AS coupling, round(CAST(out_degree AS DOUBLE) / (in_degree + out_degree), 4) AS instability FROM deg"))
def degree_instability(spark, d):
    return G.instability(A.calls(spark, d))


@query(with_("trade", ", e AS (SELECT DISTINCT src, dst FROM trade WHERE src <> dst), n AS (SELECT src AS id FROM e UNION SELECT dst FROM e), b AS (SELECT x.dst AS id, count(*) AS c FROM e x JOIN e y ON x.dst = y.src AND x.src <> y.dst GROUP BY 1), k AS (SELECT n.id, coalesce(c, 0) AS bridges FROM n LEFT JOIN b ON n.id = b.id) SELECT id, bridges, round(CASE WHEN max(bridges) OVER () = 0 THEN 0.0::DOUBLE ELSE CAST(bridges AS DOUBLE) / max(bridges) OVER () END, 4) AS betweenness FROM k"))
def betweenness_proxy(spark, d):
    return G.bridges(A.trade(spark, d).select("src", "dst"))


@query(with_("tree", ", w(id, depth) AS (SELECT dst, 1 FROM tree UNION ALL SELECT t.dst, depth + 1 FROM w JOIN tree t ON t.src = w.id WHERE depth < 3) SELECT id, count(*) AS paths FROM w GROUP BY id", True))
def containment_depth(spark, d):
    return G.walks(A.tree(spark, d), 3)


@query(with_("calls", ", w(id, depth) AS (SELECT dst, 1 FROM calls UNION ALL SELECT t.dst, depth + 1 FROM w JOIN calls t ON t.src = w.id WHERE depth < 4) SELECT id, count(*) AS paths FROM w GROUP BY id", True))
def inheritance_paths(spark, d):
    return G.walks(stored_calls(spark, d), 4)


@query(with_("trade", "SELECT DISTINCT src AS id FROM trade WHERE src = dst"))
def self_recursion(spark, d):
    return G.loops(A.trade(spark, d))


@query(with_("symbols", ", c AS (SELECT id, split_part(filepath, '/', 2) || '.' || name AS callee FROM symbols), m AS (SELECT id, name FROM symbols WHERE id % 7 = 0 UNION ALL SELECT id, CAST(id AS VARCHAR) FROM symbols WHERE id % 11 = 0) SELECT DISTINCT c.id, callee, m.id AS target FROM c JOIN m ON callee = m.name OR ends_with(callee, '.' || m.name)"))
def suffix_symbol_resolution(spark, d):
    s = A.symbols(spark, d)
    called = s.select("id", F.concat_ws(".", F.split("filepath", "/")[1], "name").alias("callee"))
    methods = s.where("id % 7 = 0").select("id", "name").union(s.where("id % 11 = 0").select("id", F.col("id").cast("string")))
    return G.resolve_suffix(called, methods)


@query(with_("calls symbols", ", n AS (SELECT id, kind, regexp_extract(name, '^[^.]*') AS base FROM symbols), t AS (SELECT base, kind, min(id) AS target FROM n WHERE kind IN ('class', 'method') GROUP BY 1, 2) SELECT c.src, c.dst, t.kind, t.target FROM calls c JOIN n ON n.id = c.dst JOIN t ON t.base = n.base WHERE n.kind = 'function'"))
def symbol_resolution(spark, d):
    """Calls of a symbol are pointed at the class or method of its name; the least id of each kind stands for it."""
    s = A.symbols(spark, d).select("id", "kind", F.substring_index("name", ".", 1).alias("base"))
    target = s.where(F.col("kind").isin("class", "method")).groupBy("base", "kind").agg(F.min("id").alias("target"))
    return A.calls(spark, d).join(s.where("kind = 'function'").select(F.col("id").alias("dst"), "base"), "dst").join(target, "base").select("src", "dst", "kind", "target")


def ranges(spark, d):
    """(file, id, start, end) of all of lineitem."""
    return A.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("file"), F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("start"), (F.col("l_partkey") + F.col("l_quantity").cast("long")).alias("end")).distinct()


RANGES = "spans AS (SELECT DISTINCT l_suppkey AS file, l_orderkey AS id, l_partkey AS s, l_partkey + CAST(l_quantity AS BIGINT) AS e FROM lineitem), points AS (SELECT DISTINCT l_suppkey AS file, l_partkey AS line FROM lineitem)"


@query(f"WITH {RANGES} SELECT p.file, line, min_by(id, struct_pack(s := s, id := id)) AS owner FROM points p JOIN spans x ON x.file = p.file AND line BETWEEN s AND e GROUP BY 1, 2")
def interval_call_resolution(spark, d):
    """Over all of lineitem."""
    spans = ranges(spark, d)
    return G.containing(spans.select("file", F.col("start").alias("line")).distinct(), spans)


@query(f"WITH {RANGES} SELECT p.file, line, min_by(id, struct_pack(w := e - s, id := id)) AS owner FROM points p JOIN spans x ON x.file = p.file AND line BETWEEN s AND e GROUP BY 1, 2")
def innermost_container(spark, d):
    """Over all of lineitem."""
    spans = ranges(spark, d)
    return G.innermost(spans.select("file", F.col("start").alias("line")).distinct(), spans)


@query(f"WITH {RANGES} , h AS (SELECT DISTINCT l_suppkey AS file, l_partkey AS hs, l_partkey + l_linenumber AS he FROM lineitem) SELECT id, count(*) AS hunks FROM spans x JOIN h ON h.file = x.file AND hs <= e AND he >= s GROUP BY id")
def hunk_overlap(spark, d):
    """Over all of lineitem."""
    hunks = A.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("file"), F.col("l_partkey").alias("start"), (F.col("l_partkey") + F.col("l_linenumber")).alias("end")).distinct()
    return G.overlapping(hunks, ranges(spark, d))


@query(with_("calls", ", one AS (SELECT dst AS id, src AS caller, 1 AS hop FROM calls WHERE dst % 10 = 0), two AS (SELECT o.id, c.src AS caller, 2 AS hop FROM one o JOIN calls c ON c.dst = o.caller), near AS (SELECT id, caller, CAST(min(hop) AS BIGINT) AS hop FROM (SELECT * FROM one UNION ALL SELECT * FROM two) GROUP BY 1, 2) SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY id ORDER BY hop, caller) <= 10"))
def change_impact(spark, d):
    return G.change_impact(A.calls(spark, d), A.symbols(spark, d).where("id % 10 = 0"))


def _pagerank_sql(rounds: int) -> str:
    out = [", e AS MATERIALIZED (SELECT DISTINCT src, dst FROM trade), o AS MATERIALIZED (SELECT src, count(*) AS c FROM e GROUP BY src), n AS MATERIALIZED (SELECT src AS id FROM e UNION SELECT dst FROM e), r0 AS MATERIALIZED (SELECT id, 1.0::DOUBLE / (SELECT count(*) FROM n) AS r FROM n)"]
    for i in range(rounds):
        out.append(f"r{i + 1} AS MATERIALIZED (SELECT n.id, 0.15::DOUBLE / (SELECT count(*) FROM n) + 0.85::DOUBLE * (coalesce(g, 0) + (SELECT coalesce(sum(r), 0) FROM r{i} WHERE id NOT IN (SELECT src FROM o)) / (SELECT count(*) FROM n)) AS r FROM n LEFT JOIN (SELECT dst, sum(r / c) AS g FROM e JOIN o USING (src) JOIN r{i} ON r{i}.id = src GROUP BY dst) ON dst = n.id)")
    return ", ".join(out) + f" SELECT id, round(r, 6) AS rank FROM r{rounds}"


@query(with_("trade", _pagerank_sql(20)))
def pagerank_fixed_iter(spark, d):
    return G.pagerank(A.trade(spark, d)).select("id", F.round("rank", 6).alias("rank"))


def _ppr_sql(rounds: int) -> str:
    out = [", seed AS (SELECT * FROM (VALUES (3, 0.75::DOUBLE), (7, 0.25::DOUBLE)) v(id, p)), f AS (SELECT DISTINCT src, dst FROM trade WHERE src IN (3, 7)), sub AS MATERIALIZED (SELECT DISTINCT src, dst FROM trade WHERE src IN (3, 7) OR src IN (SELECT dst FROM f)), o AS (SELECT src, count(*) AS c FROM sub GROUP BY src), s0 AS MATERIALIZED (SELECT id, p AS s FROM seed)"]
    for i in range(rounds):
        out.append(f"s{i + 1} AS MATERIALIZED (SELECT id, sum(s) AS s FROM (SELECT dst AS id, 0.85::DOUBLE * s / c AS s FROM sub JOIN o USING (src) JOIN s{i} ON s{i}.id = src UNION ALL SELECT id, 0.15::DOUBLE * p FROM seed) GROUP BY id)")
    return ", ".join(out) + f" SELECT CAST(id AS BIGINT) AS id, round(s / (SELECT max(s) FROM s{rounds}), 6) AS score FROM s{rounds}"


@query(with_("trade", _ppr_sql(10)))
def ppr_two_hop(spark, d):
    start = spark.createDataFrame([(3, 3.0), (7, 1.0)], "id long, weight double")
    return G.personalised(A.trade(spark, d), start).select("id", F.round("score", 6).alias("score"))


def _lpa_sql(rounds: int) -> str:
    out = [", b AS MATERIALIZED (SELECT src, dst FROM trade WHERE src <> dst UNION SELECT dst, src FROM trade WHERE src <> dst), l0 AS MATERIALIZED (SELECT DISTINCT src AS id, src AS c FROM b)"]
    for i in range(rounds):
        out.append(f"l{i + 1} AS MATERIALIZED (SELECT id, min_by(c, struct_pack(v := -v, c := c)) AS c FROM (SELECT src AS id, c, count(*) AS v FROM b JOIN l{i} ON l{i}.id = dst GROUP BY 1, 2) GROUP BY id)")
    return ", ".join(out) + f" SELECT id, c AS community FROM l{rounds}"


@query(with_("trade", _lpa_sql(4)))
def communities_lpa(spark, d):
    return G.label_propagation(A.trade(spark, d), 4)


@query("""WITH x AS (SELECT n_nationkey AS id, n_regionkey AS a, n_nationkey % 4 AS b FROM nation), c AS (SELECT a, b, count(*) AS c FROM x GROUP BY 1, 2), s AS (SELECT sum(c * (c - 1) / 2) AS ij, sum(c) AS n FROM c),
i AS (SELECT sum(k * (k - 1) / 2) AS i FROM (SELECT sum(c) AS k FROM c GROUP BY a)), j AS (SELECT sum(k * (k - 1) / 2) AS j FROM (SELECT sum(c) AS k FROM c GROUP BY b))
SELECT CAST(n AS BIGINT) AS nodes, round((ij - i * j / (n * (n - 1) / 2)) / ((i + j) / 2 - i * j / (n * (n - 1) / 2)), 6) AS ari FROM s, i, j""")
def ari(spark, d):
    n = A.table(spark, d, "nation")
    return G.adjusted_rand(n.select(F.col("n_nationkey").alias("id"), F.col("n_regionkey").alias("community")), n.select(F.col("n_nationkey").alias("id"), (F.col("n_nationkey") % 4).alias("community")))


@query()
def community_sweep(spark, d):
    """Partitions at several resolutions, their number of communities and the ARI with the next one; best: most stable."""
    gammas = [0.0, 0.5, 1.0, 2.0, 4.0]
    parts = [G.label_propagation(A.trade(spark, d), 3, g) for g in gammas]
    rows = None
    for i, p in enumerate(parts):
        one = p.agg(F.countDistinct("community").alias("communities")).join(G.adjusted_rand(p, parts[min(i + 1, len(parts) - 1)]))  # one row each
        one = one.select(F.lit(gammas[i]).alias("gamma"), "communities", "ari", (F.col("ari") > 0.99).alias("stable"))
        rows = one if rows is None else rows.unionByName(one)
    return rows


@query(with_("calls", ", w(id, l) AS (SELECT DISTINCT dst, 0 FROM calls UNION SELECT e.src, l + 1 FROM w JOIN calls e ON e.dst = w.id) SELECT id, CAST(max(l) AS BIGINT) AS level FROM w GROUP BY id", True))
def hcgs_levels(spark, d):
    return G.levels(stored_calls(spark, d))


@query()
def hcgs_summaries(spark, d):
    edges = stored_calls(spark, d)
    return G.summaries(A.symbols(spark, d), edges, G.levels(edges))


@query(with_("tree", ", w(id) AS (SELECT 'r1' UNION SELECT t.dst FROM w JOIN tree t ON t.src = w.id) SELECT id FROM w", True))
def containment_descent(spark, d):
    return G.descend(A.tree(spark, d), spark.createDataFrame([("r1",)], "id string"), 8)


@query()
def structural_embedding(spark, d):
    return G.structural_embedding(A.trade(spark, d), 16)


@query(with_("trade", DEGREES.format("trade") + ", r AS (SELECT id, in_degree, out_degree FROM deg) SELECT t.src AS file, t.dst AS dependency, 'out' AS direction, r.in_degree FROM trade t JOIN r ON r.id = t.dst WHERE t.src = 5 UNION ALL SELECT t.dst, t.src, 'in', r.in_degree FROM trade t JOIN r ON r.id = t.src WHERE t.dst = 5"))
def file_dependencies(spark, d):
    """What a file depends on and what depends on it, with each one's in degree."""
    e = A.trade(spark, d)
    deg = G.degrees(e)
    both = e.where("src = 5").select(F.col("src").alias("file"), F.col("dst").alias("dependency"), F.lit("out").alias("direction")).union(e.where("dst = 5").select("dst", "src", F.lit("in")))
    return both.join(deg.select(F.col("id").alias("dependency"), "in_degree"), "dependency").select("file", "dependency", "direction", "in_degree")


@query(with_("trade", "SELECT dst AS dependency, array_to_string(list_sort(list(DISTINCT src)), ',') AS dependants, count(DISTINCT src) AS n FROM trade GROUP BY dst"))
def dependency_fold(spark, d):
    """Dependency to its sorted dependants."""
    return A.trade(spark, d).groupBy(F.col("dst").alias("dependency")).agg(F.array_join(F.sort_array(F.collect_set("src")), ",").alias("dependants"), F.countDistinct("src").alias("n"))


@query(with_("calls symbols", "SELECT kind, count(*) AS sources, CAST(sum(n) AS BIGINT) AS calls FROM (SELECT src, count(*) AS n FROM calls GROUP BY src) JOIN symbols ON id = src GROUP BY kind ORDER BY calls DESC, kind LIMIT 20"))
def call_density(spark, d):
    """Kinds by the calls they make."""
    made = A.calls(spark, d).groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    return made.join(A.symbols(spark, d), "id").groupBy("kind").agg(F.count(F.lit(1)).alias("sources"), F.sum("n").alias("calls")).orderBy(F.desc("calls"), "kind").limit(20)
