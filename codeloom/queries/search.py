
from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..adapters import with_
from ..functions import naming
from ..operators import search as S
from . import query

BM_QUERY, BM_FIELDS = "the fr doc_17 erth", {"name": 5.0, "kind": 4.0, "filepath": 2.0, "body": 1.0}


def _docs(spark, d):
    return A.bodies(spark, d).withColumnRenamed("lang", "kind")


def _bm25_sql() -> str:
    terms = sorted(set(BM_QUERY.split()))
    word = "list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: w <> '')"
    cols = {"name": "name", "kind": "lang", "filepath": "filepath", "body": "body"}
    tok = ", ".join(f"{word.format(c)} AS t_{f}" for f, c in cols.items())
    tf = ", ".join([*(f"CAST(len(t_{f}) AS DOUBLE) AS dl_{f}" for f in cols), *(f"CAST(len(list_filter(t_{f}, lambda w: w = '{t}')) AS DOUBLE) AS tf_{f}_{i}" for f in cols for i, t in enumerate(terms))])
    st = ", ".join(["CAST(count(*) AS DOUBLE) AS n", *(f"avg(dl_{f}) AS al_{f}" for f in cols), *(f"CAST(count(*) FILTER (tf_{f}_{i} > 0) AS DOUBLE) AS df_{f}_{i}" for f in cols for i in range(len(terms)))])
    score = " + ".join(f"{BM_FIELDS[f]}::DOUBLE * ln(1 + (n - df_{f}_{i} + 0.5::DOUBLE) / (df_{f}_{i} + 0.5::DOUBLE)) * tf_{f}_{i} * 2.2::DOUBLE / (tf_{f}_{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl_{f} / al_{f}))" for f in cols for i in range(len(terms)))
    any_ = " OR ".join(f"tf_{f}_{i} > 0" for f in cols for i in range(len(terms)))
    return f", tok AS (SELECT id, {tok} FROM bodies), cnt AS (SELECT id, {tf} FROM tok), st AS (SELECT {st} FROM cnt), bm AS (SELECT id, {score} AS bm25f FROM cnt, st WHERE {any_})"


@query(with_("bodies", _bm25_sql() + " SELECT id, round(bm25f, 6) AS bm25f FROM bm"))
def bm25f_search(spark, d):
    return S.bm25f(_docs(spark, d), BM_QUERY, BM_FIELDS).select("id", F.round("bm25f", 6).alias("bm25f"))


def _wanted(spark, d):
    """The query vector: that of the first row."""
    return A.vectors(spark, d).orderBy("id").limit(1).first()["embedding"]


VEC = "q AS (SELECT embedding AS e FROM vectors ORDER BY id LIMIT 1), cs AS (SELECT id, list_dot_product(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])) / (sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(e AS DOUBLE[]), CAST(e AS DOUBLE[])))) AS cosine FROM vectors, q)"


@query(with_("vectors", f", {VEC} SELECT id, round(cosine, 6) AS cosine FROM cs ORDER BY cs.cosine DESC, id LIMIT 20"))
def vector_topk(spark, d):
    return S.nearest(A.vectors(spark, d), _wanted(spark, d), 20).select("id", F.round("cosine", 6).alias("cosine"))


RRF = ", l AS (SELECT id, row_number() OVER (ORDER BY round(bm25f, 9) DESC, id) AS p FROM bm), v AS (SELECT id, row_number() OVER (ORDER BY round(cosine, 9) DESC, id) AS p FROM cs), r AS (SELECT id, sum(1.0::DOUBLE / (60 + p)) AS rrf FROM (SELECT * FROM l WHERE p <= 100 UNION ALL SELECT * FROM v WHERE p <= 100) GROUP BY id)"


def _lists(spark, d):
    text = S.bm25f(_docs(spark, d), BM_QUERY, BM_FIELDS).withColumn("bm25f", F.round("bm25f", 9))
    near = S.nearest(A.vectors(spark, d), _wanted(spark, d), 1000).withColumn("cosine", F.round("cosine", 9))
    return [S.places(text, "bm25f", 100), S.places(near, "cosine", 100)]


@query(with_("bodies vectors", _bm25_sql() + f", {VEC}" + RRF + " SELECT id, round(rrf, 9) AS rrf FROM r ORDER BY r.rrf DESC, id LIMIT 50"))
def rrf_hybrid(spark, d):
    return S.fused(_lists(spark, d), 50).select("id", F.round("rrf", 9).alias("rrf"))


@query(with_("bodies vectors", _bm25_sql() + f", {VEC}" + RRF + ", s AS (SELECT doc_id AS id, n_chars / 100000.0::DOUBLE AS pagerank, doc_id % 25 = 0 AS hit FROM documents), h AS (SELECT id FROM s WHERE hit ORDER BY id LIMIT 100) SELECT r.id, round(rrf * (1 + coalesce(pagerank, 0)) + CASE WHEN h.id IS NULL THEN 0 ELSE 100 END, 9) AS score FROM r LEFT JOIN s ON s.id = r.id LEFT JOIN h ON h.id = r.id"))
def hybrid_boosted(spark, d):
    symbols = A.table(spark, d, "documents").select(F.col("doc_id").alias("id"), (F.col("n_chars") / 100000.0).alias("pagerank"), F.when(F.col("doc_id") % 25 == 0, "retrieve").alias("canonical_verb"), F.lit("user").alias("canonical_entity"))
    scored = S.fused(_lists(spark, d), 200).withColumnRenamed("rrf", "score")
    return S.boosted(scored, symbols, "retrieve", "user").select("id", F.round("score", 9).alias("score"))


@query(with_("vectors", ", v AS (SELECT id, \"group\" AS g, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n FROM vectors) SELECT a.id AS a, b.id AS b, round(list_dot_product(a.e, b.e) / (a.n * b.n), 6) AS cosine FROM v a JOIN v b ON a.id < b.id AND a.g <> b.g WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.3"))
def cosine_pairs(spark, d):
    return S.similar_blocks(A.vectors(spark, d), 0.3, 200).select("a", "b", F.round("cosine", 6).alias("cosine"))


@query(with_("vectors", ", v AS (SELECT id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM vectors), m AS (SELECT id, max(abs(x)) AS m FROM v GROUP BY id) SELECT v.id, CAST(sum(i * CAST(round(127 * CAST(x AS DOUBLE) / m) AS BIGINT)) AS BIGINT) AS weighted, CAST(max(abs(CAST(round(127 * CAST(x AS DOUBLE) / m) AS BIGINT))) AS BIGINT) AS top FROM v JOIN m ON m.id = v.id GROUP BY v.id"))
def quantise_int8(spark, d):
    """G6's last step: each row scaled to int8; shown as a weighted sum and the greatest magnitude."""
    v = A.vectors(spark, d).withColumn("m", F.array_max(F.transform("embedding", lambda x: F.abs(x))))
    q = v.select("id", F.transform("embedding", lambda x: F.round(127 * x.cast("double") / F.col("m").cast("double")).cast("tinyint")).alias("q"))
    return q.select("id", F.aggregate(F.transform("q", lambda x, i: x.cast("long") * (i + 1)), F.lit(0).cast("long"), lambda s, x: s + x).alias("weighted"), F.array_max(F.transform("q", lambda x: F.abs(x.cast("long")))).alias("top"))


SETS = ", s AS (SELECT id, list_distinct(list_filter(regexp_split_to_array(lower(body), '[^\\p{L}\\p{N}_]+'), lambda w: length(w) >= 3)) AS t FROM bodies), p AS (SELECT a.id AS a, b.id AS b, CAST(len(list_intersect(a.t, b.t)) AS DOUBLE) AS c, len(a.t) + len(b.t) AS n FROM s a JOIN s b ON a.id < b.id AND len(a.t) >= 0.7 * len(b.t) AND len(b.t) >= 0.7 * len(a.t) AND len(a.t) > 0)"


@query(with_("bodies", SETS + " SELECT a, b, round(c / (n - c), 6) AS jaccard FROM p WHERE c / (n - c) >= 0.7"))
def jaccard_pairs(spark, d):
    return S.jaccard_pairs(A.bodies(spark, d)).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


@query()
def minhash_pairs(spark, d):
    """Rows 'member': each document a with its class b; rows 'pair': near classes a and b. A class is the least id with its words."""
    pairs, members = S.minhash_classes(A.bodies(spark, d))
    return pairs.select(F.lit("pair").alias("kind"), "a", "b", "jaccard").unionByName(members.select(F.lit("member").alias("kind"), F.col("id").alias("a"), F.col("class_id").alias("b"), F.lit(1.0).alias("jaccard")))


def _features(spark, d):
    h = A.changes(spark, d).groupBy(F.element_at(F.split("file", "/"), -1).cast("long").alias("id")).agg(F.count(F.lit(1)).alias("git_commit_count"), F.sum(F.col("added") + F.col("deleted")).alias("git_churn"), F.countDistinct("author").alias("git_authors"))
    s = A.symbols(spark, d).select("id", (F.col("id") % 17).cast("double").alias("fts_score"), (F.col("id") % 7 / 7.0).alias("vector_sim"), (F.col("pagerank") / 100000).alias("pagerank"), "complexity", (F.col("id") % 900).alias("git_days_since_change"))
    df = s.join(h, "id", "left")
    return df.select("*", *(F.lit(0.0).alias(k) for k in S.WEIGHTS if k not in df.columns))


LTR = """, h AS (SELECT CAST(regexp_extract(file, '[^/]*$') AS BIGINT) AS id, count(*) AS gc, sum(added + deleted) AS ch, count(DISTINCT author) AS au FROM changes GROUP BY 1),
x AS (SELECT s.id, CAST(s.id % 17 AS DOUBLE) AS f, (s.id % 7) / 7.0::DOUBLE AS v, pagerank / 100000 AS pr, complexity AS cx, s.id % 900 AS dy, coalesce(gc, 0) AS gc, coalesce(ch, 0) AS ch, coalesce(au, 0) AS au FROM symbols s LEFT JOIN h USING (id)),
ltr AS (SELECT id, 0.26::DOUBLE * least(1, CASE WHEN f <= 1 THEN f ELSE f / 10 END) + 0.22::DOUBLE * v + 0.08::DOUBLE * least(1, ln(1 + pr * 1000) / ln(1001::DOUBLE)) + 0.04::DOUBLE * least(1, ln(1 + gc::DOUBLE) / 6) + 0.04::DOUBLE * exp(-dy / 260.0::DOUBLE)
 + 0.02::DOUBLE * least(1, ln(1 + ch::DOUBLE) / 10) + 0.01::DOUBLE * least(1, ln(1 + au::DOUBLE) / 3) + 0.03::DOUBLE * least(1, ln(1 + cx::DOUBLE) / 4) AS score FROM x)"""


@query(with_("changes symbols", LTR + " SELECT id, round(score, 6) AS ltr_score FROM ltr"))
def ltr_scores(spark, d):
    return S.ltr(_features(spark, d)).select("id", F.round("ltr_score", 6).alias("ltr_score"))


@query()
def ltr_explained(spark, d):
    return S.ltr(_features(spark, d), explain=True)


@query()
def ltr_model(spark, d):
    """A model in place of the weights: here one whose prediction is the mean of the features."""
    return S.model_scores(_features(spark, d), lambda x: x.mean(axis=1))


@query(with_("changes symbols", LTR + ", c AS (SELECT id, row_number() OVER (ORDER BY round(score, 9) DESC, id) AS place FROM ltr), z AS (SELECT id, place, CASE WHEN place <= 30 THEN 1 / (1 + exp(-((id * 37) % 11 - 5)::DOUBLE)) END AS ce FROM c WHERE place <= 100) SELECT id, round(ce, 4) AS ce_score, row_number() OVER (ORDER BY CAST(place > 30 AS INT), ce DESC NULLS LAST, place) AS rank FROM z ORDER BY rank LIMIT 10"))
def rerank_topn(spark, d):
    found = S.places(S.ltr(_features(spark, d)).withColumn("ltr_score", F.round("ltr_score", 9)), "ltr_score", 100)
    return S.rerank(found, S.sigmoid(((F.col("id") * 37) % 11 - 5).cast("double")))


@query()
def embedding_cache_misses(spark, d):
    """Texts that the cache lacks are encoded in batches; the encoder here counts letters."""
    import numpy as np

    texts = A.bodies(spark, d).select(F.col("body").alias("text"))
    cache = texts.where(F.length("text") % 2 == 0).select(F.sha2("text", 256).alias("text_hash"))
    return S.embedded(texts, cache, lambda batch: np.array([[t.count(c) + 1 for c in "abcdefgh"] for t in batch]))


@query(with_("bodies", ", l AS (SELECT id, string_split(body, chr(10)) AS l FROM bodies), h AS (SELECT id, l, list_position(list_transform(l, lambda x: contains(lower(x), 'tion the')), true) AS pos FROM l) SELECT id, CAST(pos AS BIGINT) AS line, array_to_string(list_slice(l, greatest(1, pos - 1), least(len(l), pos + 1)), chr(10)) AS snippet FROM h WHERE pos > 0"))
def search_snippets(spark, d):
    return S.snippets(A.bodies(spark, d), "TION the")


@query(with_("symbols", ", s AS (SELECT id, name, pagerank, id % 13 AS community FROM symbols), b AS (SELECT community FROM s WHERE contains(name, 'widget') ORDER BY pagerank DESC, id LIMIT 1) SELECT id, name, community FROM s WHERE community IN (SELECT community FROM b)"))
def community_lookup(spark, d):
    return S.community_members(A.symbols(spark, d).withColumn("community", F.col("id") % 13), "widget")


@query()
def context_assembly(spark, d):
    c = A.changes(spark, d).select(F.element_at(F.split("file", "/"), -1).cast("long").alias("id"), "ts", "commit_id", F.concat(F.lit("fix #"), F.col("commit_id").cast("string"), F.lit(" PROJ-7")).alias("subject"))
    return S.context(A.symbols(spark, d), A.calls(spark, d), A.symbols(spark, d).select("id"), c)


@query("WITH m AS (SELECT o_orderkey AS id, 'Fix #' || (o_orderkey % 9) || ' see GH-' || o_custkey || ' and AB-' || (o_orderkey % 4) AS m FROM orders) SELECT id, array_to_string(regexp_extract_all(m, 'GH-[0-9]+|#[0-9]+|[A-Z]+-[0-9]+'), ',') AS issues FROM m")
def issue_ids(spark, d):
    o = A.table(spark, d, "orders")
    m = F.concat(F.lit("Fix #"), (F.col("o_orderkey") % 9).cast("string"), F.lit(" see GH-"), F.col("o_custkey").cast("string"), F.lit(" and AB-"), (F.col("o_orderkey") % 4).cast("string"))
    return o.select(F.col("o_orderkey").alias("id"), F.array_join(S.issue_ids(m), ",").alias("issues"))


NAMES = """n AS (SELECT p_partkey AS id, ['getUserById', 'm_userName', 'IUserService', 'HTTPServer_t', '__init__', 'MAX_SIZE', 'fetch-all-records', 'save_userInfo', 'k_value'][CAST(p_partkey % 9 + 1 AS INT)] AS raw, 'src/' || ['auth', 'billing', 'user', 'config', 'x'][CAST(p_partkey % 5 + 1 AS INT)] || '/f.py' AS path FROM part),
t AS (SELECT * FROM (VALUES ('getUserById', 'camelCase', '', '', false, 'get,user,by,id', 'get', 'user', 'by_id', 'retrieve', 'user', 'query'), ('m_userName', 'camelCase', 'm_', '', false, 'user,name', NULL, 'user', 'name', 'unknown', 'user', 'operation'),
('IUserService', 'PascalCase', 'I', '', false, 'user,service', NULL, 'user', 'service', 'unknown', 'user', 'operation'), ('HTTPServer_t', 'PascalCase', '', '_t', false, 'http,server', NULL, 'http', 'server', 'unknown', 'http', 'operation'),
('__init__', 'flatcase', '__', '__', true, 'init', 'init', NULL, NULL, 'unknown', 'init', 'operation'), ('MAX_SIZE', 'SCREAMING_SNAKE_CASE', '', '', false, 'max,size', NULL, 'max', 'size', 'unknown', 'max', 'operation'),
('fetch-all-records', 'kebab-case', '', '', false, 'fetch,all,records', 'fetch', 'all', 'records', 'retrieve', 'all', 'query'), ('save_userInfo', 'snake_case', '', '', false, 'save,user,info', 'save', 'user', 'info', 'persist', 'user', 'mutation'),
('k_value', 'flatcase', 'k_', '', false, 'value', NULL, 'value', NULL, 'unknown', 'value', 'operation')) v(raw, case_style, prefix, suffix, is_magic, tokens, verb, entity, qualifier, canonical_verb, canonical_entity, intent))"""


@query(f"WITH {NAMES} SELECT id, raw, case_style, prefix, suffix, is_magic, tokens, verb, entity, qualifier, canonical_verb, canonical_entity, ['auth', 'payment', 'user', 'infra', 'core'][CAST(id % 5 + 1 AS INT)] AS domain, intent FROM n JOIN t USING (raw)")
def identifier_analysis(spark, d):
    p, id_ = A.table(spark, d, "part"), F.col("p_partkey")
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (id_ % len(xs) + 1).cast("int"))
    names = p.select(id_.alias("id"), pick(["getUserById", "m_userName", "IUserService", "HTTPServer_t", "__init__", "MAX_SIZE", "fetch-all-records", "save_userInfo", "k_value"]).alias("raw"), F.concat(F.lit("src/"), pick(["auth", "billing", "user", "config", "x"]), F.lit("/f.py")).alias("path"))
    out = naming.analyse(names, path="path")
    return out.select("id", "raw", "case_style", "prefix", "suffix", "is_magic", F.array_join("tokens", ",").alias("tokens"), "verb", "entity", "qualifier", "canonical_verb", "canonical_entity", "domain", "intent")


@query("SELECT p_name AS raw, 'unknown' AS canonical_verb, array_to_string(list_filter(regexp_split_to_array(lower(p_name), '[_-]+'), lambda w: w <> ''), ',') AS tokens, count(*) AS n FROM part GROUP BY p_name")
def canonical_names(spark, d):
    n = A.table(spark, d, "part").groupBy(F.col("p_name").alias("raw")).agg(F.count(F.lit(1)).alias("n"))
    return naming.analyse(n).select("raw", "canonical_verb", F.array_join("tokens", ",").alias("tokens"), "n")
