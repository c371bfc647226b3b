
from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..adapters import with_
from ..operators import store as K
from ..sources import diff, gitlog, parser
from . import query


def _files(spark, d):
    return A.bodies(spark, d).select("filepath", F.md5("body").alias("content_hash"), F.col("id").cast("double").alias("mtime"), "lang", "id")


@query(with_("bodies", "SELECT filepath FROM bodies WHERE id % 5 = 0"))
def stale_files(spark, d):
    f = _files(spark, d)
    return K.stale(f, f.where("id % 5 != 0"))


@query(with_("bodies", "SELECT filepath, CASE WHEN id % 7 = 0 THEN 'new' WHEN id % 3 = 0 AND id % 2 = 0 THEN 'changed' ELSE 'same' END AS state FROM bodies"))
def changed_files(spark, d):
    f = _files(spark, d)
    now = f.withColumn("mtime", F.when(F.col("id") % 3 == 0, F.col("mtime") + 5).otherwise(F.col("mtime"))).withColumn("content_hash", F.when(F.col("id") % 2 == 0, F.lit("other")).otherwise(F.col("content_hash")))
    return K.changed(f.where("id % 7 != 0"), now)


@query(with_("symbols", "SELECT id, CASE WHEN id % 2 = 0 OR id >= 1000 THEN upper(name) ELSE name END AS name, CASE WHEN id < 1000 THEN pagerank ELSE 0.0::DOUBLE END AS pagerank FROM symbols WHERE id < 1000 OR id % 2 = 0"))
def cdc_upsert(spark, d):
    s = A.symbols(spark, d).select("id", "name", "pagerank")
    new = s.where("id % 2 = 0").select("id", F.upper("name").alias("name"), F.lit(0.0).alias("pagerank"))
    return K.upsert(s.where("id < 1000"), new, ["id"], keep=("pagerank",))


@query(with_("symbols", "SELECT id, name, CASE WHEN id % 4 = 0 THEN -1.0::DOUBLE ELSE pagerank END AS pagerank FROM symbols"))
def bulk_update(spark, d):
    s = A.symbols(spark, d).select("id", "name", "pagerank")
    return K.update(s, s.where("id % 4 = 0").select("id", F.lit(-1.0).alias("pagerank")), ["id"])


@query(with_("symbols", "SELECT id, filepath FROM symbols WHERE id % 10 <> 3"))
def delete_by_file(spark, d):
    s = A.symbols(spark, d).select("id", "filepath")
    return K.delete_files(s, s.where("id % 10 = 3").select("filepath"))


@query(with_("tree", ", w(id) AS (SELECT 'n3' UNION SELECT t.dst FROM w JOIN tree t ON t.src = w.id), a AS (SELECT src AS id FROM tree UNION SELECT dst FROM tree) SELECT id FROM a WHERE id NOT IN (SELECT id FROM w)", True))
def cascade_delete(spark, d):
    t = A.tree(spark, d)
    nodes = t.select(F.col("src").alias("id")).union(t.select("dst")).distinct()
    return K.cascade_delete(nodes, t, t, spark.createDataFrame([("n3",)], "id string"))[0]


@query(with_("calls symbols", "SELECT id, name FROM symbols WHERE id IN (SELECT dst FROM calls)"))
def orphan_purge(spark, d):
    return K.purge_orphans(A.symbols(spark, d).select("id", "name"), A.calls(spark, d))


@query(with_("symbols", "SELECT id, name FROM symbols"))
def bulk_load_nodes(spark, d):
    s = A.symbols(spark, d).select("id", "name")
    return K.load_nodes(s.where("id % 3 = 0"), s.union(s))


@query(with_("calls", "SELECT src, dst FROM calls"))
def bulk_load_edges(spark, d):
    e = A.calls(spark, d)
    return K.load_edges(e.union(e))


@query(with_("symbols", "SELECT id, CASE WHEN id < 1200 THEN 'a' ELSE 'b' END AS repo, name FROM symbols"))
def federated_union(spark, d):
    s = A.symbols(spark, d).select("id", "name")
    return K.federated({"b": s.where("id >= 800"), "a": s.where("id < 1200")}, ["id"])


@query()
def report_export(spark, d):
    from ..operators import history as H

    c = A.commits(spark, d)
    return K.report({"by_year": H.by_period(c, "yyyy"), "weekdays": H.histogram(c, "weekday"), "months": H.histogram(c, "month_of_year")})


@query(with_("symbols", "SELECT id, concat_ws('::', filepath, kind, name, CAST(complexity AS VARCHAR)) AS node_id, md5(concat_ws('::', filepath, kind, name, CAST(complexity AS VARCHAR))) AS uuid FROM symbols"))
def node_identity(spark, d):
    node = K.identity(F.col("filepath"), F.col("kind"), F.col("name"), F.col("complexity"))
    return A.symbols(spark, d).select("id", node.alias("node_id"), F.lower(F.hex(K.node_uuid(node))).alias("uuid"))


@query("SELECT CAST(max(n_nationkey) + 1 AS BIGINT) AS number, lpad(CAST(max(n_nationkey) + 1 AS VARCHAR), 4, '0') || '-use-spark-now.md' AS filename FROM nation")
def next_record(spark, d):
    return K.next_record(A.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("number")), "  Use Spark, now! ")


@query(with_("numstat", "SELECT commit_id, file, added, deleted FROM numstat"))
def gitlog_numstat(spark, d):
    """A log is written out as text lines in commit order, dealt to sources, and parsed back."""
    return gitlog.numstat(gitlog.as_log(A.numstat(spark, d), 1024)).select(F.col("commit").cast("long").alias("commit_id"), "file", "added", "deleted")


@query("SELECT l_suppkey AS file, l_orderkey AS start, l_orderkey + greatest(l_linenumber, 1) - 1 AS \"end\", count(*) AS hunks FROM lineitem GROUP BY ALL")
def diff_hunks(spark, d):
    """Hunk headers of a diff without context become ranges of each file."""
    return _hunks(A.table(spark, d, "lineitem"))


def _hunks(lines):
    text = lines.groupBy("l_suppkey").agg(F.sort_array(F.collect_list(F.concat(F.lit("@@ -1,0 +"), F.col("l_orderkey").cast("string"), F.when(F.col("l_linenumber") == 1, "").otherwise(F.concat(F.lit(","), F.col("l_linenumber").cast("string"))), F.lit(" @@ def f")))).alias("h"))
    keyed = text.select(F.col("l_suppkey").alias("source"), F.posexplode(F.concat(F.array(F.lit("diff --git a/x b/x"), F.concat(F.lit("+++ b/"), F.col("l_suppkey").cast("string"))), "h"))).select("source", "pos", F.col("col").alias("line"))
    return diff.hunks(keyed).groupBy(F.col("file").cast("long").alias("file"), "start", "end").agg(F.count(F.lit(1)).alias("hunks"))


@query()
def parse_sources(spark, d):
    """Nodes and edges of Python sources; documents stand for bodies of one function each."""
    code = F.concat(F.lit("import os\n\nclass C"), F.col("id").cast("string"), F.lit("(Base):\n    def run(self, x):\n        if x and self.ok:\n            return self.run(os.environ['K'])\n        raise ValueError(x)\n"))
    return parser.parse(A.bodies(spark, d).select(F.concat("filepath", F.lit(".py")).alias("path"), code.alias("text")))
