
from __future__ import annotations

from pyspark.sql import functions as F

from .. import adapters as A
from ..adapters import with_
from ..functions import metrics as M
from ..operators import history as H
from . import query

WORD = "[a-zA-Z_][a-zA-Z0-9_]*"


def _count(op: str) -> str:
    return f"CAST((length(body) - length(replace(body, '{op}', ''))) / {len(op)} AS BIGINT)"


def _halstead_sql() -> str:
    ops = M.operators_of("text")
    counts = ", ".join(f"{_count(o)} AS o{i}" for i, o in enumerate(ops))
    n1 = " + ".join(f"CAST(o{i} > 0 AS BIGINT)" for i in range(len(ops)))
    total = " + ".join(f"o{i}" for i in range(len(ops)))
    present = ", ".join(f"CASE WHEN o{i} > 0 THEN '{o}' END" for i, o in enumerate(ops))
    return f""", c AS (SELECT id, lang, body, {counts}, list_filter(list_concat(list_concat(regexp_extract_all(body, '{WORD}'), regexp_extract_all(body, '[0-9]+\\.?[0-9]*')), list_concat(regexp_extract_all(body, '"([^"]*)"', 1), regexp_extract_all(body, '''([^'']*)''', 1))), lambda w: w <> '') AS f FROM bodies),
f AS (SELECT *, {n1} AS n1, {total} AS N1_, list_filter(f, lambda w: NOT list_contains([{present}], w)) AS w FROM c),
h AS (SELECT id, lang, n1, N1_, len(list_distinct(w)) AS n2, len(w) AS N2_ FROM f),
v AS (SELECT *, CASE WHEN n1 + n2 > 0 AND N1_ + N2_ > 0 THEN (N1_ + N2_) * log2(CAST(n1 + n2 AS DOUBLE)) ELSE 0 END AS volume, CASE WHEN n1 > 0 AND n2 > 0 THEN n1 / 2.0::DOUBLE * (CAST(N2_ AS DOUBLE) / n2) ELSE 0 END AS difficulty FROM h)"""


@query(with_("bodies", _halstead_sql() + " SELECT id, n1, N1_ AS total_operators, n2, N2_ AS total_operands, round(volume, 3) AS volume, round(difficulty, 4) AS difficulty FROM v"))
def halstead(spark, d):
    h = M.halstead(A.bodies(spark, d), "text")
    return h.select("id", "n1", "total_operators", "n2", "total_operands", F.round("volume", 3).alias("volume"), F.round("difficulty", 4).alias("difficulty"))


LOC = ", ln AS (SELECT id, lang, unnest(string_split(body, chr(10))) AS x FROM bodies), loc AS (SELECT id, count(*) AS loc_phy, count(*) FILTER (regexp_replace(x, '^\\s+|\\s+$', '', 'g') = '') AS loc_bl, count(*) FILTER (regexp_matches(regexp_replace(x, '^\\s+', ''), '^(#|//|/\\*)')) AS loc_com FROM ln GROUP BY id)"


@query(with_("bodies", LOC + " SELECT id, loc_phy, loc_bl, loc_com, loc_phy - loc_bl - loc_com AS loc_pro, round(100.0::DOUBLE * loc_com / loc_phy, 4) AS comment_ratio FROM loc"))
def loc_metrics(spark, d):
    x = A.bodies(spark, d).select("id", M.line_counts(F.col("body"), "text").alias("l"))
    return x.select("id", "l.loc_phy", "l.loc_bl", "l.loc_com", "l.loc_pro", F.round("l.comment_ratio", 4).alias("comment_ratio"))


DECIDE = " + ".join(f"len(regexp_extract_all(body, '\\b{w}\\b'))" for w in M.OTHER_DECISIONS.split())
CC = f", cc AS (SELECT id, 1 + {DECIDE} AS cyclomatic FROM bodies)"


@query(with_("bodies", CC + " SELECT id, cyclomatic, CASE WHEN cyclomatic <= 5 THEN 'simple' WHEN cyclomatic <= 10 THEN 'moderate' WHEN cyclomatic <= 20 THEN 'complex' ELSE 'very_complex' END AS complexity_class FROM cc"))
def mccabe(spark, d):
    return A.bodies(spark, d).select("id", M.cyclomatic(F.col("body"), "text").alias("cyclomatic")).withColumn("complexity_class", M.complexity_class(F.col("cyclomatic")))


MI = _halstead_sql() + LOC + CC + """, mi AS (SELECT v.id, v.lang, cyclomatic, 171 - 5.2::DOUBLE * ln(greatest(volume, 1.0::DOUBLE)) - 0.23::DOUBLE * cyclomatic - 16.2::DOUBLE * ln(greatest(CAST(loc_phy AS DOUBLE), 1)) + 50 * sin(sqrt(2.4::DOUBLE * (100.0::DOUBLE * loc_com / loc_phy))) AS raw FROM v JOIN loc USING (id) JOIN cc USING (id)),
m AS (SELECT *, greatest(0, least(171, raw)) AS mi, CASE WHEN raw >= 85 THEN 'good' WHEN raw >= 65 THEN 'moderate' WHEN raw >= 0 THEN 'difficult' ELSE 'critical' END AS band, 0.6::DOUBLE * greatest(0, 100 - greatest(0, least(171, raw)) / 171 * 100) + 0.4::DOUBLE * least(2.0::DOUBLE * cyclomatic, 100) AS score FROM mi)"""


@query(with_("bodies", MI + " SELECT id, round(raw, 4) AS mi_raw, round(mi, 4) AS mi, band, round(score, 4) AS complexity_score FROM m"))
def maintainability(spark, d):
    return M.file_metrics(A.bodies(spark, d), "text").select("id", F.round("mi_raw", 4).alias("mi_raw"), F.round("mi", 4).alias("mi"), "band", F.round("complexity_score", 4).alias("complexity_score"))


@query(with_("bodies", MI + " SELECT band, count(*) AS files, round(avg(mi), 4) AS mean_mi, round(max(mi), 4) AS best, CAST(sum(cyclomatic) AS BIGINT) AS complexity FROM m GROUP BY band"))
def mi_summary(spark, d):
    m = M.file_metrics(A.bodies(spark, d), "text")
    return m.groupBy("band").agg(F.count(F.lit(1)).alias("files"), F.round(F.avg("mi"), 4).alias("mean_mi"), F.round(F.max("mi"), 4).alias("best"), F.sum("cyclomatic").alias("complexity"))


BANDS = ("good", "moderate", "difficult", "critical")


@query(with_("bodies", MI + " SELECT lang, " + ", ".join(f"count(*) FILTER (band = '{b}') AS \"{b}\"" for b in BANDS) + ", round(avg(raw), 4) AS mean_raw FROM m GROUP BY lang"))
def mi_by_extension_pivot(spark, d):
    """Bands by language, as a pivot whose values are known, so one aggregation does it."""
    m = M.file_metrics(A.bodies(spark, d), "text")
    return m.groupBy("lang").agg(*(F.count(F.when(F.col("band") == b, 1)).alias(b) for b in BANDS), F.round(F.avg("mi_raw"), 4).alias("mean_raw"))


@query(with_("bodies changes", MI + """, hist AS (SELECT CAST(regexp_extract(file, '[^/]*$') AS BIGINT) AS id, count(*) AS revisions FROM changes GROUP BY 1), t AS (SELECT max(revisions) AS t FROM hist), r AS (SELECT m.id, revisions, 100.0::DOUBLE * revisions / t AS c, score FROM m JOIN hist USING (id), t)
SELECT id, revisions, round(c, 4) AS churn_score, round(score, 4) AS complexity_score, round(0.5::DOUBLE * c + 0.5::DOUBLE * score, 4) AS risk_score, CASE WHEN 0.5::DOUBLE * c + 0.5::DOUBLE * score >= 75 THEN 'critical' WHEN 0.5::DOUBLE * c + 0.5::DOUBLE * score >= 50 THEN 'high' WHEN 0.5::DOUBLE * c + 0.5::DOUBLE * score >= 25 THEN 'medium' ELSE 'low' END AS risk_level FROM r"""))
def hotspots(spark, d):
    history = A.changes(spark, d).groupBy(F.element_at(F.split("file", "/"), -1).cast("long").alias("id")).agg(F.count(F.lit(1)).alias("revisions"))
    return M.hotspots(M.file_metrics(A.bodies(spark, d), "text"), history, "id")


@query("WITH c AS (SELECT p_brand AS package, count(*) AS classes, count(*) FILTER (p_size < 10) AS abstract, count(*) FILTER (p_size % 2 = 0) AS ca, count(*) FILTER (p_size % 3 = 0) AS ce FROM part GROUP BY 1) SELECT *, round(CAST(abstract AS DOUBLE) / classes, 4) AS abstractness, round(CASE WHEN ca + ce = 0 THEN 0.0::DOUBLE ELSE CAST(ce AS DOUBLE) / (ca + ce) END, 4) AS instability, round(abs(CAST(abstract AS DOUBLE) / classes + CASE WHEN ca + ce = 0 THEN 0.0::DOUBLE ELSE CAST(ce AS DOUBLE) / (ca + ce) END - 1), 4) AS distance FROM c")
def oop_summary(spark, d):
    p = A.table(spark, d, "part")
    some = lambda c: F.count(F.when(c, 1))
    c = p.groupBy(F.col("p_brand").alias("package")).agg(F.count(F.lit(1)).alias("classes"), some(F.col("p_size") < 10).alias("abstract"), some(F.col("p_size") % 2 == 0).alias("ca"), some(F.col("p_size") % 3 == 0).alias("ce"))
    return M.object_metrics(c)


@query(with_("bodies", "SELECT '' AS ext, count(*) AS files, CAST(sum(len(string_split(body, chr(10)))) AS BIGINT) AS lines, CAST(sum(length(body)) AS BIGINT) AS size FROM bodies WHERE id % 3 = 0 UNION ALL SELECT CASE id % 3 WHEN 1 THEN 'py' ELSE 'ts' END, count(*), CAST(sum(len(string_split(body, chr(10)))) AS BIGINT), CAST(sum(length(body)) AS BIGINT) FROM bodies WHERE id % 3 > 0 GROUP BY id % 3"))
def extension_stats(spark, d):
    k = F.col("id") % 3
    files = A.bodies(spark, d).select(F.concat("filepath", F.when(k == 0, "").when(k == 1, ".py").otherwise(".d.ts")).alias("filepath"), F.size(F.split("body", "\n", -1)).cast("long").alias("lines"), F.length("body").cast("long").alias("size"))
    return H.extension_stats(files)


@query(with_("bodies", ", s AS (SELECT id, len(string_split(body, chr(10))) AS n FROM bodies) SELECT id, n AS lines FROM s WHERE n > 100"))
def large_files(spark, d):
    """M12."""
    return A.bodies(spark, d).select("id", F.size(F.split("body", "\n", -1)).cast("long").alias("lines")).where("lines > 100")


@query(with_("symbols", "SELECT id, regexp_extract(filepath, '[^/]*$') AS base, regexp_replace(filepath, '/[^/]*$', '') AS dir, regexp_extract(filepath, '([^/.]*)[^/]*$', 1) AS stem, 'py' AS ext, md5(filepath) AS hash, sha256(name) AS sha FROM symbols"))
def path_parts(spark, d):
    """F10, F11."""
    p = F.col("filepath")
    base = F.substring_index(p, "/", -1)
    return A.symbols(spark, d).select("id", base.alias("base"), F.regexp_replace(p, "/[^/]*$", "").alias("dir"), F.substring_index(base, ".", 1).alias("stem"), F.substring_index(base, ".", -1).alias("ext"), F.md5(p).alias("hash"), F.sha2("name", 256).alias("sha"))
