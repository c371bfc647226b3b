"""Sync, caches, logs, staged builds, request checks, functional analysis, summaries, the export by lines, and embeddings of large graphs."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import adapters as A
from ..adapters import with_
from ..functions import metrics as M
from ..functions import texts as T
from ..operators import history as H
from ..operators import purity as P
from ..operators import spectral
from ..operators import store as S
from ..operators import upkeep as U
from ..session import shared_dir
from . import query
from .source_metrics import CC, _halstead_sql


def _folder(spark, name):
    return f"{shared_dir(spark).rstrip('/')}/codeloom/{name}-{uuid.uuid4().hex}"


def _store(spark, d):
    return A.bodies(spark, d).select("id", "filepath", F.col("id").cast("double").alias("mtime"), F.md5("body").alias("content_hash"))


@query(with_("bodies", "SELECT filepath, id, CASE WHEN id % 7 = 0 OR id % 3 <> 0 THEN id::DOUBLE WHEN id % 2 = 0 THEN id + 5.0::DOUBLE ELSE id::DOUBLE END AS mtime, CASE WHEN id % 7 <> 0 AND id % 6 = 0 THEN 'other' ELSE md5(body) END AS content_hash FROM bodies WHERE id % 5 <> 0"))
def synced_store(spark, d):
    """Of a listing without a fifth of the files, some are new (7), some later with the same text (3) and some changed (6)."""
    s = _store(spark, d)
    late = (F.col("id") % 3 == 0) & (F.col("id") % 7 != 0)
    new = s.where("id % 5 != 0").withColumn("mtime", F.when(late, F.col("mtime") + 5).otherwise(F.col("mtime"))).withColumn("content_hash", F.when(late & (F.col("id") % 2 == 0), "other").otherwise(F.col("content_hash")))
    return U.synced(s.where("id % 7 != 0"), new)


def _terms(files):
    words = F.filter(F.split(F.lower("body"), "[^a-z0-9]+"), lambda w: w != "")
    return files.select("filepath", F.explode(words).alias("term")).groupBy("filepath", "term").agg(F.count(F.lit(1)).alias("tf"))


@query(with_("bodies", ", f AS (SELECT filepath, body || CASE WHEN id % 4 = 0 THEN ' brandnew' ELSE '' END AS body FROM bodies WHERE id % 5 <> 0), t AS (SELECT filepath, unnest(regexp_split_to_array(lower(body), '[^a-z0-9]+')) AS term FROM f) SELECT filepath, term, count(*) AS tf FROM t WHERE term <> '' GROUP BY ALL"))
def lazy_index(spark, d):
    """An index of terms after a quarter of the files changed and a fifth went; the SQL builds it from nothing."""
    body = A.bodies(spark, d).select("id", "filepath", "body").withColumn("content_hash", F.md5("body"))
    now = body.where("id % 5 != 0").withColumn("body", F.concat("body", F.when(F.col("id") % 4 == 0, " brandnew").otherwise(""))).withColumn("content_hash", F.md5("body"))
    return U.refreshed(_terms(body), body.select("filepath", "content_hash"), now, _terms)


@query(with_("bodies", ", b AS (SELECT md5(body) AS blob, min(len(string_split(body, chr(10)))) AS lines FROM bodies GROUP BY 1) SELECT * FROM b ORDER BY blob DESC LIMIT 10000"))
def blob_cache(spark, d):
    """Lines of each blob, half of them from the cache, trimmed to its bound."""
    blobs = A.bodies(spark, d).select("id", F.md5("body").alias("blob"), "body")
    lines = lambda rows: rows.select("blob", F.size(F.split("body", "\n", -1)).cast("long").alias("lines"))
    half = lines(blobs.where("id % 2 = 0").dropDuplicates(["blob"]))
    return U.trimmed(U.cached(half, blobs, lines, "blob"), "blob")


@query("SELECT event_type AS mode, count(*) AS searches, count(DISTINCT event_id) AS ids, CAST(sum(event_id) AS BIGINT) AS results FROM events GROUP BY 1")
def telemetry_log(spark, d):
    """Two appends, read back."""
    path = _folder(spark, "log")
    events = A.table(spark, d, "events").select(F.col("event_type").alias("mode"), F.col("event_id").alias("result_count"))
    for half in (0, 1):
        U.append_log(events.where(F.col("result_count") % 2 == half), path)
    log = U.read_log(spark, path, "event_id string, mode string, result_count long")
    return log.groupBy("mode").agg(F.count(F.lit(1)).alias("searches"), F.countDistinct("event_id").alias("ids"), F.sum("result_count").alias("results"))


@query(with_("symbols", "SELECT id, upper(name) AS name FROM symbols"))
def staged_build(spark, d):
    """A table is built, then replaced by another built from it."""
    path, s = _folder(spark, "staged"), A.symbols(spark, d).select("id", "name")
    U.build_and_swap(s, path)
    U.build_and_swap(spark.read.parquet(path).withColumn("name", F.upper("name")), path)
    return spark.read.parquet(path)


_ROWS = ", ".join(f"'{m}'" for m in T.MODES)


@query(f"""WITH r AS (SELECT p_partkey AS id, '  ' || repeat(p_name, CAST(p_partkey % 20 AS INT)) || CASE WHEN p_partkey % 11 = 0 THEN chr(10) || 'x' ELSE '' END || ' ' AS q, CASE WHEN p_partkey % 13 = 0 THEN 'nope' ELSE [{_ROWS}][CAST(p_partkey % 16 + 1 AS INT)] END AS mode, p_partkey % 300 - 50 AS l, p_partkey % 9 - 4 AS o, p_partkey % 17 - 2 AS w FROM part),
c AS (SELECT *, substring(regexp_replace(q, '^\\s+|\\s+$', '', 'g'), 1, 200) AS query FROM r) SELECT id, query, mode, greatest(1, least(l, 100)) AS "limit", greatest(0, o) AS "offset", greatest(1, least(w, 10)) AS depth, CASE WHEN mode = 'nope' THEN 'mode' WHEN contains(query, chr(10)) THEN 'query' END AS error FROM c""")
def checked_requests(spark, d):
    """P18."""
    k = F.col("p_partkey")
    mode = F.when(k % 13 == 0, "nope").otherwise(F.concat(F.lit(" "), F.upper(F.element_at(F.array(*map(F.lit, T.MODES)), (k % 16 + 1).cast("int")))))
    q = F.concat(F.lit("  "), F.expr("repeat(p_name, cast(p_partkey % 20 as int))"), F.when(k % 11 == 0, "\nx").otherwise(""), F.lit(" "))
    return T.checked(A.table(spark, d, "part").select(k.alias("id"), q.alias("query"), mode.alias("mode"), (k % 300 - 50).alias("limit"), (k % 9 - 4).alias("offset"), (k % 17 - 2).alias("depth")))


@query("""WITH s AS (SELECT event_id AS id, (event_id % 4000) * 2.25::DOUBLE AS s, event_type || ':/' || props AS f FROM events) SELECT id, CASE WHEN s < 60 THEN printf('%.1fs', s) WHEN s < 3600 THEN printf('%dm %.0fs', CAST(floor(s / 60) AS BIGINT), s % 60) ELSE printf('%dh %dm %.0fs', CAST(floor(s / 3600) AS BIGINT), CAST(floor((s % 3600) / 60) AS BIGINT), s % 60) END AS duration,
translate(f, '/\\:*?"<>|', '_________') AS file_name, CASE WHEN id % 3 = 0 THEN id ELSE 0 END AS stamp FROM s""")
def text_formats(spark, d):
    """F18."""
    e, id_ = A.table(spark, d, "events"), F.col("event_id")
    raw = F.when(id_ % 3 == 0, F.concat(F.lit(" +"), id_.cast("string"))).when(id_ % 3 == 1, F.concat(id_.cast("string"), F.lit(".5")))
    return e.select(id_.alias("id"), T.duration((id_ % 4000) * 2.25).alias("duration"), T.file_name(F.concat("event_type", F.lit(":/"), "props")).alias("file_name"), T.stamp(raw).alias("stamp"))


@query("SELECT n_name AS file, count(*) AS lambdas FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 ORDER BY lambdas DESC, file LIMIT 20")
def lambda_density(spark, d):
    """Nations hold customers, these orders, and these their lines as lambdas."""
    files = A.table(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.col("n_name").alias("name"))
    return P.lambda_density(A.tree(spark, d), A.table(spark, d, "lineitem").select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("parent")), files)


@query("SELECT s_name AS function, count(*) AS mutations FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_returnflag = 'R' OR l_linenumber = 1 GROUP BY 1 ORDER BY mutations DESC, function LIMIT 20")
def state_mutations(spark, d):
    accesses = A.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_returnflag") == "R").alias("is_mutation"), (F.col("l_linenumber") == 1).alias("is_taint"))
    return P.state_mutations(accesses, A.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")))


@query(with_("trade", "SELECT n_name AS function, CAST(n_regionkey AS VARCHAR) AS filepath FROM nation WHERE n_nationkey IN (SELECT src FROM trade WHERE src = dst) ORDER BY 1, 2 LIMIT 50"))
def recursive_symbols(spark, d):
    return P.recursive_symbols(A.trade(spark, d), A.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("string").alias("filepath")))


@query(with_("bodies", CC + " SELECT count(*) AS files, round(avg(cyclomatic), 4) AS mean, max(cyclomatic) AS most, count(*) FILTER (cyclomatic <= 5) AS simple_files, count(*) FILTER (cyclomatic BETWEEN 6 AND 10) AS moderate_files, count(*) FILTER (cyclomatic BETWEEN 11 AND 20) AS complex_files, count(*) FILTER (cyclomatic > 20) AS very_complex_files FROM cc"))
def complexity_summary(spark, d):
    c = M.cyclomatic(F.col("body"), "text")
    return P.complexity_summary(A.bodies(spark, d).select(c.alias("cyclomatic")).withColumn("complexity_class", M.complexity_class(F.col("cyclomatic"))))


@query(with_("bodies", _halstead_sql() + " SELECT count(*) AS files, round(avg(volume), 2) AS mean_volume, round(avg(difficulty), 2) AS mean_difficulty, round(avg(volume * difficulty), 2) AS mean_effort, round(sum(pow(volume * difficulty, 2.0::DOUBLE / 3) / 3000), 3) AS bugs FROM v"))
def halstead_summary(spark, d):
    return P.halstead_summary(M.halstead(A.bodies(spark, d), "text"))


@query(with_("symbols calls", """, s AS (SELECT id, kind, complexity, regexp_replace(filepath, '/[^/]*$', '') AS file FROM symbols), e AS (SELECT a.file AS f, b.file AS t FROM calls JOIN s a ON a.id = src JOIN s b ON b.id = dst WHERE a.file <> b.file),
o AS (SELECT f AS file, count(*) AS ce, 0 AS ca FROM e GROUP BY 1 UNION ALL SELECT t, 0, count(*) FROM e GROUP BY 1), l AS (SELECT file, sum(ce) AS ce, sum(ca) AS ca FROM o GROUP BY 1),
c AS (SELECT file, count(*) FILTER (kind = 'class') AS classes, count(*) FILTER (kind = 'class' AND complexity < 10) AS abstract, count(*) FILTER (kind = 'method') AS methods, count(*) FILTER (kind = 'function') AS attributes FROM s GROUP BY 1),
t AS (SELECT count(*) AS files, count(*) FILTER (classes > 0) AS files_with_classes, CAST(sum(classes) AS BIGINT) AS classes, CAST(sum(abstract) AS BIGINT) AS abstract, CAST(sum(methods) AS BIGINT) AS methods, CAST(sum(attributes) AS BIGINT) AS attributes, sum(coalesce(ce, 0))::DOUBLE AS ce, sum(coalesce(ca, 0))::DOUBLE AS ca FROM c LEFT JOIN l USING (file)),
u AS (SELECT *, CASE WHEN classes > 0 THEN abstract::DOUBLE / classes ELSE 0 END AS a, CASE WHEN ce + ca > 0 THEN ce / (ce + ca) ELSE 0 END AS i FROM t)
SELECT files, files_with_classes, classes, abstract, methods, attributes, round(CASE WHEN files_with_classes > 0 THEN (ce + ca) / files_with_classes ELSE 0 END, 4) AS mean_coupling, round(a, 4) AS abstractness, round(i, 4) AS instability, round(abs(a + i - 1), 4) AS distance FROM u"""))
def object_summary(spark, d):
    """Folders stand for files, functions for attributes, calls between folders for couplings."""
    s = A.symbols(spark, d).select("id", "kind", "complexity", F.regexp_replace("filepath", "/[^/]*$", "").alias("file"))
    a, b = s.select(F.col("id").alias("src"), F.col("file").alias("f")), s.select(F.col("id").alias("dst"), F.col("file").alias("t"))
    e = A.calls(spark, d).join(a, "src").join(b, "dst").where("f != t")
    ends = e.select(F.explode(F.array(F.struct(F.col("f").alias("file"), F.lit(1).alias("o")), F.struct(F.col("t").alias("file"), F.lit(0).alias("o")))).alias("x")).select("x.*")
    links = ends.groupBy("file").agg(F.sum("o").alias("ce"), F.sum(1 - F.col("o")).alias("ca"))
    some = lambda c: F.count(F.when(F.expr(c), 1))
    files = s.groupBy("file").agg(some("kind = 'class'").alias("classes"), some("kind = 'class' AND complexity < 10").alias("abstract"), some("kind = 'method'").alias("methods"), some("kind = 'function'").alias("attributes"))
    return P.object_summary(files.join(links, "file", "left").na.fill(0, ["ce", "ca"]).withColumn("coupling", F.col("ce") + F.col("ca")))


EXPORT = """, author_rows AS (SELECT author, count(DISTINCT commit_id) AS commits, CAST(sum(added) AS BIGINT) AS added, CAST(sum(deleted) AS BIGINT) AS deleted FROM changes GROUP BY 1), revised AS (SELECT file, count(*) AS revisions FROM changes GROUP BY 1 ORDER BY revisions DESC, file LIMIT 10),
cx AS (SELECT kind, count(*) AS symbols, max(complexity) AS most FROM symbols GROUP BY 1), hot AS (SELECT name, complexity FROM symbols ORDER BY complexity DESC, name LIMIT 20), by_subject AS (SELECT subject AS branch, count(DISTINCT commit_id) AS commits, CAST(sum(added) AS BIGINT) AS added, CAST(sum(deleted) AS BIGINT) AS deleted, count(DISTINCT author) AS authors FROM changes GROUP BY 1),
days AS (SELECT CAST(year(ts) AS BIGINT) AS year, count(*) AS commits FROM commits GROUP BY 1), whole AS (SELECT count(DISTINCT commit_id) AS commits, count(DISTINCT author) AS authors, CAST(sum(added) AS BIGINT) AS added FROM changes)
SELECT 'metadata' AS section, '{"repository":"benchmark"}' AS item UNION ALL SELECT 'repository', '{"commits":' || commits || ',"authors":' || authors || ',"added":' || added || '}' FROM whole
UNION ALL SELECT 'activity', '{"year":' || year || ',"commits":' || commits || '}' FROM days UNION ALL SELECT 'authors', '{"author":' || author || ',"commits":' || commits || ',"added":' || added || ',"deleted":' || deleted || '}' FROM author_rows
UNION ALL SELECT 'files', '{"file":"' || file || '","revisions":' || revisions || '}' FROM revised UNION ALL SELECT 'code_quality', '{"kind":"' || kind || '","symbols":' || symbols || ',"most":' || most || '}' FROM cx
UNION ALL SELECT 'hotspots', '{"name":"' || name || '","complexity":' || complexity || '}' FROM hot UNION ALL SELECT 'branches', '{"branch":"' || branch || '","commits":' || commits || ',"added":' || added || ',"deleted":' || deleted || ',"authors":' || authors || '}' FROM by_subject"""


@query(with_("changes symbols", EXPORT))
def report_lines(spark, d):
    """K8: the eight sections of the export."""
    c, s, n = A.changes(spark, d), A.symbols(spark, d), F.count(F.lit(1))
    return S.report_lines({
        "metadata": spark.createDataFrame([("benchmark",)], "repository string"),
        "repository": c.agg(F.countDistinct("commit_id").alias("commits"), F.countDistinct("author").alias("authors"), F.sum("added").alias("added")),
        "activity": A.commits(spark, d).groupBy(F.year("ts").alias("year")).agg(n.alias("commits")),
        "authors": c.groupBy("author").agg(F.countDistinct("commit_id").alias("commits"), F.sum("added").alias("added"), F.sum("deleted").alias("deleted")),
        "files": H.most_revised(c, 10),
        "code_quality": s.groupBy("kind").agg(n.alias("symbols"), F.max("complexity").alias("most")),
        "hotspots": s.select("name", "complexity").orderBy(F.desc("complexity"), "name").limit(20),
        "branches": H.branch_stats(c, F.col("subject")),
    })


@query()
def subspace_embedding(spark, d):
    """The call graph, in six rounds; tests compare the method with a dense decomposition."""
    return spectral.subspace_embedding(A.calls(spark, d), 16, rounds=6)
