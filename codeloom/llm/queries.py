"""The queries opN_<name> over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import decode_ids, encode_documents
from .common import table
from .decontaminate import overlaps
from .fingerprints import compare_with_next
from .html_text import extract_text
from .ngram_join import jaccard_classes
from .quality import fit_quality, score_quality
from .secret_scans import joined, scan_secrets
from .token_counts import count_tokens
from .toxicity import fit_toxicity, score_toxicity
from .url_filters import REFERENCES, judge_urls


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    tokens = encode_documents(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return decode_ids(tokens, path, public_tokenizers.PATTERN, digest=True)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(table(spark, sf_dir, "documents"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    n = [count(k).alias(f"n_{name}") for k, name in enumerate(("assign", "access", "hex"))]
    return found.select("doc_id", *n, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    return judge_urls(table(spark, sf_dir, "pages"), rules)


def _decoded(value: str) -> str:
    for written_as, char in REFERENCES:
        value = "replace({}, '{}', '{}')".format(value, written_as, char.replace("'", "''"))
    return value


OP10_SQL = r"""
WITH RECURSIVE tags AS (
  SELECT url, unnest(regexp_extract_all(html, '<(?:link|meta)\b[^>]*>', 0, 'is')) AS tag FROM pages
  WHERE contains(url, '://') AND regexp_matches(html, '<link\b[^>]*\bcanonical\b|<meta\b[^>]*\brefresh\b', 'is')),
stated AS (
  SELECT url AS u, CASE
    WHEN regexp_matches(tag, '^<link\b.*\brel\s*=\s*(?:"(?:[^"]*\s)?canonical(?:\s[^"]*)?"|''(?:[^'']*\s)?canonical(?:\s[^'']*)?''|canonical(?:[\s/>]))', 'is') THEN regexp_extract(tag, '\bhref\s*=\s*["'']?([^"''\s>]+)', 1, 'is')
    WHEN regexp_matches(tag, '^<meta\b.*\bhttp-equiv\s*=\s*["'']?refresh\b', 'is') THEN regexp_extract(tag, '\burl\s*=\s*["'']?([^"''\s>;]+(?:;[^"''\s>]+)*)', 1, 'is') END AS t FROM tags),
named AS (SELECT u, DECODED AS t FROM stated WHERE t IS NOT NULL),
parts AS (SELECT u, t, regexp_extract(u, '^(.*?://[^/?#]*)', 1, 's') AS origin, string_split(regexp_extract(u, '^.*?://[^/?#]*((?:/[^?#/]*)*)/', 1, 's'), '/') AS folder,
  regexp_extract(t, '^((?:\.{1,2}/)*)', 1) AS lead FROM named),
edges AS (SELECT u, CASE
    WHEN regexp_matches(t, '^[a-zA-Z][a-zA-Z0-9+.-]*:') THEN CASE WHEN contains(t, '://') THEN t END
    WHEN starts_with(t, '//') THEN regexp_extract(u, '^(.*?:)//', 1, 's') || t
    WHEN starts_with(t, '/') THEN origin || t
    WHEN starts_with(t, '?') THEN regexp_extract(u, '^([^?#]*)', 1, 's') || t
    WHEN starts_with(t, '#') OR t = '' THEN NULL
    ELSE origin || array_to_string(folder[1:greatest(1, len(folder) - (length(lead) - length(replace(lead, '../', ''))) // 3)], '/') || '/' || substr(t, length(lead) + 1) END AS v FROM parts),
near AS (SELECT u, v FROM edges WHERE u <> v UNION SELECT v, u FROM edges WHERE u <> v),
reach(node, root) AS (SELECT u, u FROM near UNION SELECT n.v, r.root FROM reach r JOIN near n ON n.u = r.node),
class AS (SELECT node, min(root) AS root FROM reach GROUP BY node),
names AS (SELECT url FROM pages UNION SELECT node FROM class),
split AS (SELECT url, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM names),
rules(rh, rp, action) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
best AS (SELECT url, host, path, (SELECT max(struct_pack(size := length(rh || rp), allow := action = 'allow', rule := rh || rp)) FROM rules
  WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)) AS b FROM split),
verdicts AS (SELECT root, bool_or(b.allow) AS allowed, count(b) AS n FROM class JOIN best ON best.url = class.node GROUP BY root)
SELECT p.page_id, b.host, b.path, b.b.rule AS rule,
  CASE WHEN coalesce(b.b.allow, v.allowed OR v.n = 0, true) THEN 'allow' ELSE 'block' END AS verdict
FROM pages p JOIN best b ON b.url IS NOT DISTINCT FROM p.url LEFT JOIN class c ON c.node = p.url LEFT JOIN verdicts v ON v.root = c.root
""".replace("DECODED", _decoded("t"))


OP5_SQL = r"""
WITH RECURSIVE words AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
sets AS MATERIALIZED (SELECT doc_id, CASE WHEN len(ws) >= 4 THEN list_distinct(list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3])) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS s FROM words),
rows AS MATERIALIZED (SELECT doc_id, len(s) AS n, hash(x) AS h FROM (SELECT doc_id, s, unnest(s) AS x FROM sets)),
links AS MATERIALIZED (SELECT a.doc_id AS u, b.doc_id AS v FROM rows a JOIN rows b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
near AS MATERIALIZED (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach(node, root) AS (SELECT u, u FROM near UNION SELECT n.v, r.root FROM reach r JOIN near n ON n.u = r.node),
least AS (SELECT node, min(root) AS root FROM reach GROUP BY node)
SELECT s.doc_id, len(s) AS n_shingles, coalesce(root, s.doc_id) AS component_id FROM sets s LEFT JOIN least ON node = s.doc_id
"""


def queries() -> dict:
    named = (op1_byte_bpe, op2_decontamination, op3_quality, op4_fingerprints, op5_ngram_join, op6_toxicity, op7_html_text, op8_token_counts, op9_secret_scans, op10_url_filters)
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {"op5_ngram_join": OP5_SQL, "op10_url_filters": OP10_SQL}
