
from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import discard, task_count, written
from . import set_join as J

#: Field boosts of the full text engine. K1, B and the fusion constant are the published defaults.
BOOSTS = {"name": 5.0, "kind": 4.0, "summary": 3.0, "filepath": 2.0, "body": 1.0}
K1, B, FUSION = 1.2, 0.75, 60
#: Feature weights of the linear ranker; they sum to 1.
WEIGHTS = {
    "fts_score": 0.26, "vector_sim": 0.22, "ppr_score": 0.06, "prone_sim": 0.02, "pagerank": 0.08, "in_degree": 0.04, "out_degree": 0.02, "betweenness": 0.04, "git_commit_count": 0.04, "git_days_since_change": 0.04,
    "git_churn": 0.02, "git_ownership_entropy": 0.02, "git_bug_fix_ratio": 0.02, "git_authors": 0.01, "git_survival_days": 0.01, "instability": 0.02, "coupling": 0.02, "complexity": 0.03, "depth": 0.02, "inheritance_depth": 0.01,
}


def words(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda w: w != "")


def bm25f(docs: DataFrame, query: str, boosts: dict[str, float], id_col: str = "id") -> DataFrame:
    """(id, bm25f) of documents that have a query term: per field boost x idf x saturated tf. Only the query's terms are
    counted, in one aggregate over the documents; no postings are exploded."""
    terms = sorted(set(query.lower().split()))
    fields = [f for f in boosts if f in docs.columns]
    counted = docs.select(id_col, *(words(F.coalesce(F.col(f), F.lit(""))).alias(f) for f in fields))
    cols = [F.col(id_col)]
    for f in fields:
        cols.append(F.size(f).cast("double").alias(f"dl_{f}"))
        cols += [F.size(F.filter(F.col(f), _is(t))).cast("double").alias(f"tf_{f}_{i}") for i, t in enumerate(terms)]
    counted = counted.select(*cols)
    stats = counted.agg(F.count(F.lit(1)).cast("double").alias("N"), *(F.avg(f"dl_{f}").alias(f"al_{f}") for f in fields), *(F.sum((F.col(f"tf_{f}_{i}") > 0).cast("double")).alias(f"df_{f}_{i}") for f in fields for i in range(len(terms))))
    joined = counted.where(" OR ".join(f"tf_{f}_{i} > 0" for f in fields for i in range(len(terms)))).join(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for f in fields:
        length = F.when(F.col(f"al_{f}") > 0, F.col(f"dl_{f}") / F.col(f"al_{f}")).otherwise(0.0)
        for i in range(len(terms)):
            tf, df = F.col(f"tf_{f}_{i}"), F.col(f"df_{f}_{i}")
            score = score + boosts[f] * F.log(1 + (F.col("N") - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length))
    return joined.select(id_col, score.alias("bm25f"))


def _is(term: str) -> Callable[[Column], Column]:
    return lambda w: w == term


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is 0."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n == 0, 0.0).otherwise(dot(a, b) / n)


def nearest(vectors: DataFrame, wanted: list[float], k: int) -> DataFrame:
    """The k rows of vectors(id, embedding) nearest by cosine, exactly; a top-k per task, then of those."""
    query = F.array(*(F.lit(float(x)) for x in wanted))
    return vectors.select("id", cosine(F.col("embedding"), query).alias("cosine")).orderBy(F.desc("cosine"), "id").limit(k)


def places(scored: DataFrame, score: str, k: int) -> DataFrame:
    """The k best with their place; the window runs over k rows."""
    return scored.orderBy(F.desc(score), "id").limit(k).withColumn("place", F.row_number().over(Window.orderBy(F.desc(score), "id")))


def fused(lists: list[DataFrame], k: int) -> DataFrame:
    """Reciprocal rank fusion of lists (id, place)."""
    parts = [x.select("id", (1.0 / (FUSION + F.col("place"))).alias("part")) for x in lists]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("id").agg(F.sum("part").alias("rrf")).orderBy(F.desc("rrf"), "id").limit(k)


def boosted(scored: DataFrame, symbols: DataFrame, verb: str | None, entity: str | None, by: float = 100.0, most: int = 100) -> DataFrame:
    """Score (1 + pagerank), and by more for up to most symbols with the query's canonical verb and entity."""
    hit = symbols.where((F.col("canonical_verb") == verb) & (F.col("canonical_entity") == entity)).orderBy("id").limit(most).select("id", F.lit(by).alias("boost"))
    df = scored.join(symbols.select("id", "pagerank"), "id", "left").join(F.broadcast(hit), "id", "left")  # at most `most` rows
    return df.select("id", (F.col("score") * (1 + F.coalesce("pagerank", F.lit(0.0))) + F.coalesce("boost", F.lit(0.0))).alias("score"))


def similar_blocks(vectors: DataFrame, least: float, per_block: int = 2000) -> DataFrame:
    """(a, b, cosine) of all pairs of different groups with cosine of at least `least`, a < b. Vectors are dealt into blocks; each pair
    of blocks is one matrix product in numpy, and only pairs that qualify leave it."""
    size = vectors.count()
    blocks = max(1, -(-size // per_block))
    kind = vectors.schema["id"].dataType.simpleString()
    dealt = vectors.select("id", "group", "embedding", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("blk"))
    cells = dealt.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("o")).select("id", "group", "embedding", "blk", F.least("blk", "o").alias("i"), F.greatest("blk", "o").alias("j"))

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.array(pdf["embedding"].tolist(), float)
        x = x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)
        left, right = np.flatnonzero(pdf["blk"] == pdf["i"].iat[0]), np.flatnonzero(pdf["blk"] == pdf["j"].iat[0])
        c = x[left] @ x[right].T
        p, q = np.nonzero(c >= least)
        a, b = left[p], right[q]
        ids, group = pdf["id"].to_numpy(), pdf["group"].to_numpy()
        same = pdf["i"].iat[0] == pdf["j"].iat[0]
        ok = (group[a] != group[b]) & ((ids[a] < ids[b]) if same else (ids[a] != ids[b]))
        a, b, c = a[ok], b[ok], c[p, q][ok]
        return pd.DataFrame({"a": np.minimum(ids[a], ids[b]), "b": np.maximum(ids[a], ids[b]), "cosine": c})

    return cells.groupBy("i", "j").applyInPandas(product, f"a {kind}, b {kind}, cosine double")


def token_sets(docs: DataFrame, shortest: int = 3, most_chars: int | None = None) -> DataFrame:
    """(id, tokens): distinct words of at least `shortest` characters; with most_chars of the first characters only (the reference's
    sketches take 4096)."""
    text = F.col("body") if most_chars is None else F.substring("body", 1, most_chars)
    return docs.select("id", F.array_distinct(F.filter(words(text), lambda w: F.length(w) >= shortest)).alias("tokens"))


def minhash_pairs(docs: DataFrame, least: float = 0.7, permutations: int = 128, rows: int = 4, sets: DataFrame | None = None) -> DataFrame:
    """(a, b, jaccard), a < b, of classes that bands of their MinHash signatures join, verified exactly. Equal sets are one class first,
    so a group of copies doesn't make its pairs; classes carry their least id. minhash_classes has their members too."""
    return _near_classes(token_sets(docs) if sets is None else sets, least, permutations, rows)[0]


def minhash_classes(docs: DataFrame, least: float = 0.7, permutations: int = 128, rows: int = 4, most_chars: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The pairs of minhash_pairs, and (id, class_id) of every document: two documents are near where their classes are equal or a pair.
    A document without tokens is alone in its class."""
    return _near_classes(token_sets(docs, most_chars=most_chars), least, permutations, rows)


def _near_classes(sets: DataFrame, least: float, permutations: int, rows: int) -> tuple[DataFrame, DataFrame]:
    every = J.hashed(sets, every=True)
    members, chosen = J.classes(every)
    pairs = J.class_pairs(every, chosen, least, lambda x: J.minhash_links(x, least, permutations, rows))
    alone = written(every.where(F.coalesce("n", F.lit(0)) <= 0).select("id", F.col("id").alias("class_id")), "alone")
    discard(every)
    x, y = (chosen.select(F.col("id").alias(k), F.col("no").alias(no)) for k, no in (("x", "u"), ("y", "v")))
    found = pairs.join(J.compact(x), "u").join(J.compact(y), "v").where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "jaccard")
    return found, members.select("id", "class_id").unionByName(alone)


def jaccard_pairs(docs: DataFrame, least: float = 0.7, most_chars: int | None = None) -> DataFrame:
    """The same pairs exactly, and of all documents: classes of equal sets are compared (set_join), pairs of classes are pairs of their members."""
    sets = J.hashed(token_sets(docs, most_chars=most_chars))
    members, chosen = J.classes(sets)
    pairs = J.class_pairs(sets, chosen, least)
    discard(sets)
    return J.member_pairs(pairs, members)


def normalised() -> dict[str, Column]:
    """The 20 features, each in [0, 1], from columns of their names."""
    c = {k: F.coalesce(F.col(k).cast("double"), F.lit(0.0)) for k in WEIGHTS}
    unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    logs = lambda x, over: F.least(F.lit(1.0), F.log1p(F.greatest(F.lit(0.0), x)) / over)
    spread = lambda x, by: F.least(F.lit(1.0), F.log1p(x * by) / F.log1p(F.lit(by)))
    out = {k: unit(c[k]) for k in ("vector_sim", "ppr_score", "prone_sim", "instability", "git_bug_fix_ratio")}
    out["fts_score"] = unit(F.when(c["fts_score"] <= 1, c["fts_score"]).otherwise(c["fts_score"] / 10))
    out["git_days_since_change"] = F.exp(-c["git_days_since_change"] / 260)
    out["pagerank"], out["betweenness"] = spread(c["pagerank"], 1000.0), spread(c["betweenness"], 10000.0)
    for k, over in (("in_degree", 5.0), ("out_degree", 5.0), ("coupling", 5.0), ("complexity", 4.0), ("git_commit_count", 6.0), ("git_churn", 10.0), ("git_authors", 3.0)):
        out[k] = logs(c[k], over)
    for k, over in (("depth", 10.0), ("inheritance_depth", 5.0), ("git_survival_days", 730.0), ("git_ownership_entropy", 3.0)):
        out[k] = F.least(F.lit(1.0), F.greatest(F.lit(0.0), c[k]) / over)
    return out


def ltr(candidates: DataFrame, weights: dict[str, float] | None = None, explain: bool = False) -> DataFrame:
    """candidates(id, features) with ltr_score, and with explain the features as a struct."""
    x = normalised()
    score = sum(((weights or WEIGHTS).get(k, 0.0) * x[k] for k in WEIGHTS), F.lit(0.0))
    out = [F.col("id"), score.alias("ltr_score")]
    return candidates.select(*out, *([F.struct(*(x[k].alias(k) for k in WEIGHTS)).alias("features")] if explain else []))


def model_scores(candidates: DataFrame, predict: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """R7 with a model: predict gets the normalised features, in the order of WEIGHTS, a batch at a time."""
    x = normalised()

    @F.pandas_udf("double")
    def score(*columns: pd.Series) -> pd.Series:
        return pd.Series(np.asarray(predict(np.column_stack([c.to_numpy() for c in columns])), float))

    return candidates.select("id", score(*(x[k] for k in WEIGHTS)).alias("ltr_score"))


def rerank(candidates: DataFrame, score: Column, top_n: int = 30, top_k: int = 10) -> DataFrame:
    """Of candidates(id, place, ...), the first top_n by score, then the rest by place; the first top_k with their new place."""
    df = candidates.withColumn("_part", (F.col("place") > top_n).cast("int")).withColumn("ce_score", F.when(F.col("place") <= top_n, score))
    best = df.orderBy("_part", F.desc_nulls_last("ce_score"), "place").limit(top_k)
    w = Window.orderBy("_part", F.desc_nulls_last("ce_score"), "place")  # over top_k rows
    return best.select("id", F.round("ce_score", 4).alias("ce_score"), F.row_number().over(w).cast("long").alias("rank"))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def embedded(texts: DataFrame, cache: DataFrame, encode: Callable[[list[str]], np.ndarray], most_chars: int | None = None) -> DataFrame:
    """(text_hash, embedding) of new texts only, by SHA-256; encode gets a batch, and its rows are scaled to length 1. With
    most_chars, texts are cut to their first characters (2048 in the reference)."""
    cut = texts.select("text" if most_chars is None else F.substring("text", 1, most_chars).alias("text")).distinct().withColumn("text_hash", F.sha2("text", 256))
    new = cut.join(cache.select("text_hash"), "text_hash", "left_anti")

    @F.pandas_udf("array<float>")
    def run(x: pd.Series) -> pd.Series:
        v = np.asarray(encode(x.tolist()), float)
        return pd.Series(list((v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)).astype(np.float32)))

    return new.repartition(task_count(texts.sparkSession)).select("text_hash", run("text").alias("embedding"))


def snippets(docs: DataFrame, query: str, around: int = 1) -> DataFrame:
    """The first line that holds the query, without regard to case, and the lines around it."""
    lines = F.split("body", "\n", -1)
    at = F.array_position(F.transform(lines, lambda x: F.contains(F.lower(x), F.lit(query.lower()))), F.lit(True))
    start = F.greatest(F.lit(1).cast("long"), at - around)
    end = F.least(F.size(lines).cast("long"), at + around)
    return docs.withColumn("line", at).where("line > 0").select("id", "line", F.array_join(F.slice(lines, start.cast("int"), (end - start + 1).cast("int")), "\n").alias("snippet"))


def capped(body: Column, most: int = 300) -> Column:
    """The first lines, with a mark where more are cut."""
    lines = F.split(body, "\n", -1)
    return F.when(F.size(lines) <= most, body).otherwise(F.concat(F.array_join(F.slice(lines, 1, most), "\n"), F.lit("\n... (truncated)")))


def by_directory(results: DataFrame) -> DataFrame:
    """results(filepath) counted by directory."""
    d = F.when(F.instr("filepath", "/") > 0, F.regexp_replace("filepath", "/[^/]*$", "")).otherwise(".")
    return results.groupBy(d.alias("dir")).agg(F.count(F.lit(1)).alias("results"))


def packages(results: DataFrame, k: int = 5) -> DataFrame:
    """The k packages (first three parts of the path) with most results."""
    p = F.array_join(F.slice(F.split("filepath", "/"), 1, 3), "/")
    return results.groupBy(p.alias("package")).agg(F.count(F.lit(1)).alias("results")).orderBy(F.desc("results"), "package").limit(k)


def community_members(symbols: DataFrame, wanted: str) -> DataFrame:
    """All members of the community of the best match by pagerank."""
    best = symbols.where(F.col("name").contains(wanted)).orderBy(F.desc("pagerank"), "id").limit(1).select("community")
    return symbols.join(F.broadcast(best), "community", "left_semi").select("id", "name", "community")  # one row


def context(symbols: DataFrame, edges: DataFrame, seeds: DataFrame, commits: DataFrame, most: int = 5, last: int = 3) -> DataFrame:
    """For each seed(id): up to five callers and callees, the last three commits of it, and their issue ids.
    commits(id, ts, commit_id, subject)."""
    ids = seeds.select("id")
    first = lambda df, name: df.groupBy("id").agg(F.slice(F.sort_array(F.collect_set("x")), 1, most).alias(name))
    callers = first(edges.select(F.col("dst").alias("id"), F.col("src").alias("x")).join(ids, "id", "left_semi"), "callers")
    callees = first(edges.select(F.col("src").alias("id"), F.col("dst").alias("x")).join(ids, "id", "left_semi"), "callees")
    w = Window.partitionBy("id").orderBy(F.desc("ts"), F.desc("commit_id"))
    recent = commits.join(ids, "id", "left_semi").withColumn("r", F.row_number().over(w)).where(F.col("r") <= last)
    history = recent.groupBy("id").agg(F.sort_array(F.collect_list("commit_id")).alias("commits"), F.sort_array(F.array_distinct(F.flatten(F.collect_list(issue_ids(F.col("subject")))))).alias("issues"))
    return ids.join(callers, "id", "left").join(callees, "id", "left").join(history, "id", "left")


def issue_ids(message: Column) -> Column:
    """F16: #n, GH-n and PROJ-n."""
    return F.regexp_extract_all(message, F.lit(r"GH-\d+|#\d+|[A-Z]+-\d+"), F.lit(0))
