"""Lookup, class metric and quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..adapters import with_
from ..operators import history as H
from ..operators import lookup as K
from ..plans.dsl import in_scope
from . import query
from .history import bus_factor
from .search import jaccard_pairs

NODES = "symbols", "id", "name", "kind", "filepath"


@query(with_("symbols", ", f AS (SELECT id, name, kind, filepath FROM symbols WHERE starts_with(filepath, 'Brand#2/') AND contains(lower(name), 'ring')) SELECT *, (SELECT count(*) FROM f) AS total_count FROM f ORDER BY id LIMIT 5 OFFSET 2"))
def file_search(spark, d):
    """A page of what a folder holds for a text."""
    return K.file_nodes(A.symbols(spark, d).select(*NODES[1:]), in_scope(F.col("filepath"), "Brand#2"), "RING", 5, 2)


@query(with_("symbols calls", ", f AS (SELECT id, name FROM symbols WHERE contains(name, 'widget') ORDER BY pagerank DESC, id LIMIT 5), c AS (SELECT DISTINCT dst, src FROM calls WHERE dst IN (SELECT id FROM f) QUALIFY row_number() OVER (PARTITION BY dst ORDER BY src) <= 5) SELECT id, name, src AS caller FROM f LEFT JOIN c ON dst = id"))
def usages(spark, d):
    return K.usages(A.symbols(spark, d), A.calls(spark, d), "Widget")


SNIPPET = ", e AS (SELECT id, name, kind, filepath FROM symbols WHERE name = '{0}' OR CAST(id AS VARCHAR) = '{0}' ORDER BY id LIMIT 10), s AS (SELECT id, name, kind, filepath FROM symbols WHERE ends_with(name, '{0}') AND NOT EXISTS (SELECT 1 FROM e) ORDER BY id LIMIT 10) SELECT * FROM e UNION ALL SELECT * FROM s"


@query(with_("symbols", SNIPPET.format("17")))
def snippet_exact(spark, d):
    return K.snippet(A.symbols(spark, d).select(*NODES[1:]), "17")


@query(with_("symbols", SNIPPET.format("t.77")))
def snippet_suffix(spark, d):
    return K.snippet(A.symbols(spark, d).select(*NODES[1:]), "t.77")


def _both_ways_sql() -> str:
    from . import SQL

    return f"WITH pairs AS ({SQL['jaccard_pairs']}) SELECT a, b, jaccard FROM pairs UNION ALL SELECT b, a, jaccard FROM pairs"


@query(_both_ways_sql())
def similarity_edges(spark, d):
    return K.both_ways(jaccard_pairs(spark, d))


@query("WITH l AS (SELECT p_type AS kind, list(DISTINCT p_brand ORDER BY p_brand) AS brands FROM part GROUP BY 1) SELECT kind, array_to_string(CASE WHEN len(brands) > 4 THEN list_append(brands[1:4], '... ' || (len(brands) - 4) || ' more') ELSE brands END, ',') AS brands FROM l")
def truncated_lists(spark, d):
    brands = A.table(spark, d, "part").groupBy(F.col("p_type").alias("kind")).agg(F.sort_array(F.collect_set("p_brand")).alias("b"))
    return brands.select("kind", F.array_join(K.truncated(F.col("b"), 4), ",").alias("brands"))


@query("WITH s AS (SELECT p_partkey AS id, p_type AS folder, p_name AS name FROM part) SELECT u.id AS src, min_by(s.id, struct_pack(far := s.folder <> u.folder, id := s.id)) AS dst, CASE WHEN bool_or(s.folder = u.folder) THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS confidence FROM s u JOIN s ON s.name = u.name AND s.id <> u.id GROUP BY 1")
def likely_calls(spark, d):
    """Every part calls its name in its folder."""
    s = A.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_type").alias("folder"), F.col("p_name").alias("name"))
    return K.likely_calls(s.withColumnRenamed("id", "src"), s)


@query(with_("calls", """, me AS (SELECT p_brand AS class, p_partkey AS method, p_size AS complexity, string_split(p_name, ' ') AS fields FROM part),
par AS (SELECT DISTINCT p_brand AS class, left(p_brand, 7) AS parent FROM part WHERE length(p_brand) > 7),
size AS (SELECT class, sum(complexity) AS wmc, count(*) AS m FROM me GROUP BY 1),
ends AS (SELECT a.class AS a, b.class AS b, dst FROM calls JOIN me a ON a.method = src JOIN me b ON b.method = dst WHERE a.class <> b.class),
far AS (SELECT a AS class, count(DISTINCT dst) AS far FROM ends GROUP BY 1),
cb AS (SELECT class, count(DISTINCT o) AS cbo FROM (SELECT a AS class, b AS o FROM ends UNION ALL SELECT b, a FROM ends) GROUP BY 1),
co AS (SELECT x.class, count(*) FILTER (len(list_intersect(x.fields, y.fields)) > 0) AS q, count(*) AS p FROM me x JOIN me y ON x.class = y.class AND x.method < y.method GROUP BY 1)
SELECT s.class, CAST(wmc AS BIGINT) AS wmc, CAST(EXISTS (SELECT 1 FROM par WHERE par.class = s.class) AS BIGINT) AS dit, (SELECT count(*) FROM par WHERE parent = s.class) AS noc, coalesce(cbo, 0) AS cbo, m + coalesce(far, 0) AS rfc, greatest(0, coalesce(p - q - q, 0)) AS lcom
FROM size s LEFT JOIN far USING (class) LEFT JOIN cb USING (class) LEFT JOIN co USING (class)"""))
def class_metrics(spark, d):
    """Brands as classes, parts as their methods, the words of a name as fields; Brand#12 is a child of Brand#1."""
    part = A.table(spark, d, "part")
    methods = part.select(F.col("p_brand").alias("class"), F.col("p_partkey").alias("method"), F.col("p_size").alias("complexity"))
    uses = part.select(F.col("p_partkey").alias("method"), F.explode(F.split("p_name", " ")).alias("field"))
    parents = part.where("length(p_brand) > 7").select(F.col("p_brand").alias("class"), F.substring("p_brand", 1, 7).alias("parent")).distinct()
    return K.class_metrics(methods, A.calls(spark, d), uses, parents)


def _quality_sql() -> str:
    from . import SQL

    return f"""WITH bus AS ({SQL['bus_factor']}), f AS (SELECT avg(p_size) AS c, avg(CASE WHEN p_size > 40 THEN 1.0::DOUBLE ELSE 0 END) AS part FROM part),
s AS (SELECT round(greatest(0, 100 - 10 * (c - 10)), 4) AS complexity, least(25.0::DOUBLE * (SELECT bus_factor FROM bus), 100) AS collaboration, round(greatest(0, 100 - 100 * part), 4) AS organisation FROM f) SELECT *, round((complexity + collaboration + organisation) / 3, 4) AS score FROM s"""


@query(_quality_sql())
def code_quality(spark, d):
    files = A.table(spark, d, "part").select(F.col("p_size").alias("complexity"), (F.col("p_size") > 40).alias("large"))
    return K.code_quality(files, bus_factor(spark, d))


SORTED = "SELECT author, commits, active_days, rank() OVER (ORDER BY commits DESC) AS by_commits, rank() OVER (ORDER BY active_days DESC) AS by_days FROM (SELECT author, count(*) AS commits, count(DISTINCT CAST(ts AS DATE)) AS active_days FROM commits GROUP BY 1)"


@query(with_("commits", SORTED))
def author_orders(spark, d):
    """T5: each author's place by contribution and by active days; equal values share a place."""
    spans = H.author_spans(A.commits(spark, d)).select("author", "commits", "active_days")
    return H.placed(H.placed(spans, "commits", "by_commits"), "active_days", "by_days")
