"""Domain relations over the benchmark tables: commits, file changes, activity, a call graph, symbols and vectors.

Every operator takes domain relations; these functions make them from the tables, and PRELUDE states the same in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed instants in place of "now", so results don't change from day to day.
AS_OF_COMMITS, AS_OF_EVENTS = "2002-01-01", "2024-01-31"
FIX_SUBJECTS = ("1-URGENT", "2-HIGH")
MESSAGES = {"1-URGENT": "Hotfix a crash", "2-HIGH": "Fix the total", "3-MEDIUM": "Add a new feature", "4-NOT SPECIFIED": "Refactor and cleanup"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def commits(spark: SparkSession, d: str) -> DataFrame:
    """commit_id, author, ts, subject, message, fix."""
    message = F.coalesce(*(F.when(F.col("o_orderpriority") == k, m) for k, m in MESSAGES.items()), F.lit("Update docs"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("commit_id"), F.col("o_custkey").alias("author"), F.col("o_orderdate").alias("ts"), F.col("o_orderpriority").alias("subject"), message.alias("message"), F.col("o_orderpriority").isin(*FIX_SUBJECTS).alias("fix"))


def numstat(spark: SparkSession, d: str) -> DataFrame:
    """commit_id, file, added, deleted."""
    part = table(spark, d, "part").select("p_partkey", F.concat_ws("/", "p_brand", "p_type", F.col("p_partkey").cast("string")).alias("file"))
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("commit_id"), F.col("l_partkey").alias("p_partkey")).agg(
        F.sum(F.col("l_quantity").cast("long")).alias("added"), F.sum(F.round(100 * F.col("l_discount")).cast("long")).alias("deleted")
    )
    return lines.join(part, "p_partkey").select("commit_id", "file", "added", "deleted")


def changes(spark: SparkSession, d: str) -> DataFrame:
    """commit_id, author, ts, subject, message, fix, file, added, deleted."""
    return numstat(spark, d).join(commits(spark, d), "commit_id")


def activity(spark: SparkSession, d: str) -> DataFrame:
    """author, ts, kind, file."""
    return table(spark, d, "events").select(F.col("user_id").alias("author"), "ts", F.col("event_type").alias("kind"), F.get_json_object("props", "$.k").cast("long").alias("file"), "value")


def calls(spark: SparkSession, d: str) -> DataFrame:
    """src, dst: parts bought together in two orders or more, the lesser first; an acyclic call graph."""
    bought = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p")).distinct()
    pairs = bought.alias("a").join(bought.alias("b"), F.expr("a.o = b.o AND a.p < b.p"))
    return pairs.groupBy(F.col("a.p").alias("src"), F.col("b.p").alias("dst")).agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("src", "dst")


def trade(spark: SparkSession, d: str) -> DataFrame:
    """src, dst, weight: customer nation to supplier nation, with cycles and loops; the busier pairs only."""
    o = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.expr("l_orderkey = o_orderkey"))
    c = table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("src"))
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("dst"))
    n = o.join(c, F.expr("o_custkey = c_custkey")).join(s, F.expr("l_suppkey = s_suppkey")).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight"))
    mean = n.agg((F.sum("weight") / F.count(F.lit(1))).alias("mean"))
    return n.join(F.broadcast(mean)).where(F.col("weight") > F.col("mean")).select("src", "dst", "weight")  # one row is broadcast


def symbols(spark: SparkSession, d: str) -> DataFrame:
    """id, name, kind, filepath, complexity, pagerank: parts as code nodes."""
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("id"), F.concat_ws(".", F.translate("p_name", " ", "_"), F.col("p_partkey").cast("string")).alias("name"),
        F.element_at(F.array(*map(F.lit, ("function", "method", "class"))), (F.col("p_partkey") % 3 + 1).cast("int")).alias("kind"),
        F.concat_ws("/", "p_brand", "p_type", F.concat(F.col("p_partkey").cast("string"), F.lit(".py"))).alias("filepath"), F.col("p_size").cast("long").alias("complexity"), F.col("p_retailprice").alias("pagerank"),
    )


def tree(spark: SparkSession, d: str) -> DataFrame:
    """src, dst: region, nation, customer, order as a containment tree of depth 3."""
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    return (
        table(spark, d, "nation").select(name("r", "n_regionkey").alias("src"), name("n", "n_nationkey").alias("dst"))
        .union(table(spark, d, "customer").select(name("n", "c_nationkey"), name("c", "c_custkey")))
        .union(table(spark, d, "orders").select(name("c", "o_custkey"), name("o", "o_orderkey")))
    )


def bodies(spark: SparkSession, d: str) -> DataFrame:
    """id, lang, filepath, name, body: documents as source files."""
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang", F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("filepath"), F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("name"), F.coalesce("text", F.lit("")).alias("body"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """id, group, embedding."""
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("group"), "embedding")


PRELUDE = {
    "commits": "commits AS (SELECT o_orderkey AS commit_id, o_custkey AS author, o_orderdate AS ts, o_orderpriority AS subject, CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN '{m}'" for k, m in MESSAGES.items()) + " ELSE 'Update docs' END AS message, o_orderpriority IN ('1-URGENT', '2-HIGH') AS fix FROM orders)",
    "numstat": "numstat AS (SELECT l_orderkey AS commit_id, p_brand || '/' || p_type || '/' || CAST(p_partkey AS VARCHAR) AS file, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS added, CAST(sum(CAST(round(100 * l_discount) AS BIGINT)) AS BIGINT) AS deleted FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey, p_partkey, p_brand, p_type)",
    "changes": "changes AS (SELECT c.*, n.file, n.added, n.deleted FROM numstat n JOIN commits c ON c.commit_id = n.commit_id)",
    "activity": "activity AS (SELECT user_id AS author, ts, event_type AS kind, CAST(json_extract_string(props, '$.k') AS BIGINT) AS file, value FROM events)",
    "calls": "bought AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem), calls AS (SELECT a.p AS src, b.p AS dst FROM bought a JOIN bought b ON a.o = b.o AND a.p < b.p GROUP BY a.p, b.p HAVING count(*) >= 2)",
    "trade": "flows AS (SELECT CAST(c_nationkey AS BIGINT) AS src, CAST(s_nationkey AS BIGINT) AS dst, count(*) AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2), trade AS (SELECT * FROM flows WHERE weight > (SELECT sum(weight) / count(*) FROM flows))",
    "symbols": "symbols AS (SELECT p_partkey AS id, replace(p_name, ' ', '_') || '.' || CAST(p_partkey AS VARCHAR) AS name, ['function', 'method', 'class'][CAST(p_partkey % 3 + 1 AS INT)] AS kind, p_brand || '/' || p_type || '/' || CAST(p_partkey AS VARCHAR) || '.py' AS filepath, CAST(p_size AS BIGINT) AS complexity, p_retailprice AS pagerank FROM part)",
    "tree": "tree AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey FROM orders)",
    "bodies": "bodies AS (SELECT doc_id AS id, lang, concat_ws('/', source, lang, CAST(doc_id AS VARCHAR)) AS filepath, 'doc_' || doc_id AS name, coalesce(text, '') AS body FROM documents)",
    "vectors": "vectors AS (SELECT vec_id AS id, CAST(label AS BIGINT) AS \"group\", embedding FROM embeddings)",
}
NEEDS = {"changes": ("commits", "numstat")}


def with_(names: str, sql: str, recursive: bool = False) -> str:
    """sql after the named relations; sql may begin with further ones, as ', x AS (...) SELECT ...'."""
    out: list[str] = []
    for n in names.split():
        for need in (*NEEDS.get(n, ()), n):
            if PRELUDE[need] not in out:
                out.append(PRELUDE[need])
    return f"WITH {'RECURSIVE ' * recursive}{', '.join(out)} {sql.strip()}"
