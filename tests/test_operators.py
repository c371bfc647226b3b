import math
import random

import pytest
from pyspark.sql import functions as F

from codeloom.operators import graph as G
from codeloom.operators import history as H
from codeloom.operators import search as S
from codeloom.operators import store as K


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def random_edges(spark, n, m, seed=1):
    r = random.Random(seed)
    return sorted({(r.randrange(n), r.randrange(n)) for _ in range(m)})


def test_pagerank_sums_to_one_and_equals_power_iteration(spark):
    pairs = random_edges(spark, 12, 30)
    got = {r["id"]: r["rank"] for r in G.pagerank(edges(spark, pairs), 10).collect()}
    nodes = sorted({x for p in pairs for x in p})
    rank = {v: 1 / len(nodes) for v in nodes}
    out = {v: [d for s, d in pairs if s == v] for v in nodes}
    for _ in range(10):
        lost = sum(rank[v] for v in nodes if not out[v])
        new = {v: 0.15 / len(nodes) + 0.85 * lost / len(nodes) for v in nodes}
        for v in nodes:
            for d in out[v]:
                new[d] += 0.85 * rank[v] / len(out[v])
        rank = new
    assert math.isclose(sum(got.values()), 1, abs_tol=1e-9) and all(math.isclose(got[v], rank[v], abs_tol=1e-9) for v in nodes)
    assert G.pagerank(edges(spark, [])).collect() == []


def test_personalised_ranks(spark):
    e = edges(spark, [(1, 2), (2, 3)])
    got = {r["id"]: r["score"] for r in G.personalised(e, spark.createDataFrame([(1, 1.0), (3, 0.2)], "id long, weight double")).collect()}
    assert set(got) == {1, 2, 3} and got[2] > 0 and got[1] >= got[2] and max(got.values()) == 1


def test_levels_with_a_cycle(spark):
    e = edges(spark, [(1, 2), (2, 3), (3, 1), (4, 1), (5, 5), (4, 6)])
    assert {r["id"]: r["level"] for r in G.levels(e).collect()} == {6: 0, 1: 1, 3: 2, 2: 3, 4: 2}


def test_ari(spark):
    p = lambda x: spark.createDataFrame(list(enumerate(x)), "id long, community long")
    a = p([0, 0, 1, 1, 2, 2])
    assert tuple(G.adjusted_rand(a, a).first()) == (6, 1.0)
    assert G.adjusted_rand(a, p([0, 1, 0, 1, 0, 1])).first()["ari"] < 0.1
    assert G.adjusted_rand(a.where("false"), a).first()["nodes"] == 0


def test_embedding_shape(spark):
    rows = G.structural_embedding(edges(spark, [(1, 2), (2, 3), (3, 1)]), 8).collect()
    assert len(rows) == 3 and all(len(r["vector"]) == 8 and max(map(abs, r["vector"])) == 127 for r in rows)
    with pytest.raises(ValueError):
        G.structural_embedding(edges(spark, [(1, 2)]), 8, most_nodes=1)


def test_trace_stops_at_seen_nodes(spark):
    e = edges(spark, [(1, 2), (2, 1), (2, 3), (3, 4), (4, 5), (5, 6), (1, 3)])
    seeds = spark.createDataFrame([(1,)], "id long")
    assert {r["id"]: r["hop"] for r in G.trace(e, seeds, 4).collect()} == {2: 1, 3: 1, 4: 2, 5: 3, 6: 4}
    assert {r["id"] for r in G.trace(e, seeds, 9, forward=False).collect()} == {2}


def test_summaries(spark):
    s = spark.createDataFrame([(1, "validate_token", "function", 3), (2, "decode_jwt", "function", 1), (3, "check_expiry", "function", 1)], "id long, name string, kind string, complexity long")
    e = edges(spark, [(1, 2), (1, 3)])
    text = {r["id"]: r["summary"] for r in G.summaries(s, e, G.levels(e), 3).collect()}[1]
    assert text == "Function validate_token. Complexity score: 3. Calls: decode_jwt (Function decode_jwt), check_expiry (Function check_expiry)."


def test_suffixes_and_spans_equal_brute_force(spark):
    r = random.Random(2)
    calls = [(i, ".".join(r.choice("abc") for _ in range(r.randrange(1, 4)))) for i in range(40)]
    methods = [(i, ".".join(r.choice("abc") for _ in range(r.randrange(1, 3)))) for i in range(12)]
    got = {tuple(x) for x in G.resolve_suffix(spark.createDataFrame(calls, "id long, callee string"), spark.createDataFrame(methods, "id long, name string")).collect()}
    assert got == {(i, c, j) for i, c in calls for j, m in methods if c == m or c.endswith("." + m)}
    spans = [(r.randrange(3), i, s := r.randrange(300), s + r.randrange(200)) for i in range(60)]
    points = [(f, x) for f in range(3) for x in range(0, 500, 7)]
    a, b = spark.createDataFrame(points, "file long, line long"), spark.createDataFrame(spans, "file long, id long, start long, end long")
    inner = {(x["file"], x["line"]): x["owner"] for x in G.innermost(a, b).collect()}
    first = {(x["file"], x["line"]): x["owner"] for x in G.containing(a, b).collect()}
    for p in points:
        inside = [s for s in spans if s[0] == p[0] and s[2] <= p[1] <= s[3]]
        assert inner.get(p) == min(((s[3] - s[2], s[1]) for s in inside), default=(0, None))[1]
        assert first.get(p) == min(((s[2], s[1]) for s in inside), default=(0, None))[1]


def test_co_change(spark):
    rows = [(c, f) for c in "123" for f in "ab"] + [("4", "c"), ("5", "c"), *(("6", f"f{i}") for i in range(60))]
    got = [tuple(r) for r in H.co_change(spark.createDataFrame(rows, "commit string, file string")).collect()]
    assert got == [("a", "b", 3, 1.0)]


def test_instability(spark):
    e = edges(spark, [(1, i) for i in range(2, 11)] + [(i, 1) for i in (20, 21, 22)])
    r = G.instability(e).where("id = 1").first()
    assert (r["coupling"], r["instability"]) == (12, 0.75)


def test_streaks_and_bus_factor(spark):
    days = ["2024-01-01", "2024-01-02", "2024-01-03", "2024-01-07"]
    df = spark.createDataFrame([(1, d) for d in days], "author long, d string").select("author", F.col("d").cast("timestamp").alias("ts"))
    assert tuple(H.streaks(df).first()) == (1, 4, 3, 2.0)
    counts = spark.createDataFrame([(1, 5), (2, 3), (3, 2)], "author long, commits long")
    assert tuple(H.bus_factor(counts).first()) == (3, 1)


def test_weights_and_features(spark):
    assert math.isclose(sum(S.WEIGHTS.values()), 1, abs_tol=0.01)
    base = {k: 0.0 for k in S.WEIGHTS}
    strong = base | {"fts_score": 30.0, "vector_sim": 2.0, "pagerank": 0.01, "git_commit_count": 1e9, "git_ownership_entropy": 9.0, "complexity": 500.0}
    rows = [(i, *v.values()) for i, v in enumerate([base | {"git_days_since_change": 1e6}, strong, *(base | {"git_days_since_change": float(d)} for d in (30, 365, 730))])]
    df = S.ltr(spark.createDataFrame(rows, ["id", *S.WEIGHTS]), explain=True)
    got = {r["id"]: r for r in df.collect()}
    assert all(0 <= x <= 1 for r in got.values() for x in r["features"])
    assert got[1]["ltr_score"] > got[0]["ltr_score"]
    assert got[2]["features"]["git_days_since_change"] > got[3]["features"]["git_days_since_change"] > got[4]["features"]["git_days_since_change"] > 0


def test_rerank(spark):
    c = spark.createDataFrame([(1, 1, 0.1), (2, 2, 0.9), (3, 3, 0.5), (4, 4, 9.0)], "id long, place int, s double")
    assert [r["id"] for r in S.rerank(c, F.col("s"), 3, 10).collect()] == [2, 3, 1, 4]
    assert [r["id"] for r in S.rerank(c, F.col("s"), 3, 2).collect()] == [2, 3]


def test_minhash_finds_what_exact_finds(spark):
    r = random.Random(4)
    base = [f"word{r.randrange(400)}" for _ in range(60)]
    docs = [(i, " ".join(base[: 60 - i] + [f"new{j}" for j in range(i)])) for i in range(0, 12)] + [(100 + i, " ".join(f"w{r.randrange(9000)}" for _ in range(40))) for i in range(20)]
    df = spark.createDataFrame([*docs, (200, None), (201, "")], "id long, body string").fillna({"body": ""})
    exact = {(x["a"], x["b"]) for x in S.jaccard_pairs(df).collect()}
    near = {(x["a"], x["b"]) for x in S.minhash_pairs(df).collect()}
    assert near <= exact and len(near) >= 0.95 * len(exact) > 0


def test_store(spark):
    old = spark.createDataFrame([(1, "a", 0.5), (2, "b", 0.6)], "id long, name string, pagerank double")
    new = spark.createDataFrame([(2, "B", 0.0), (3, "C", 0.1)], "id long, name string, pagerank double")
    assert sorted(map(tuple, K.upsert(old, new, ["id"], ("pagerank",)).collect())) == [(1, "a", 0.5), (2, "B", 0.6), (3, "C", 0.1)]
    t = spark.createDataFrame([("a", "h", 1.0), ("b", "h", 1.0), ("c", "h", 1.0)], "filepath string, content_hash string, mtime double")
    now = spark.createDataFrame([("a", "x", 1.005), ("b", "h", 9.0), ("c", "y", 9.0), ("d", "z", 0.0)], "filepath string, content_hash string, mtime double")
    assert dict(map(tuple, K.changed(t, now).collect())) == {"a": "same", "b": "same", "c": "changed", "d": "new"}
    assert [r["filepath"] for r in K.stale(t, now.where("filepath != 'a'")).collect()] == ["a"]


def test_snapshot(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "id long, name string")
    K.save_snapshot({"nodes": df}, str(tmp_path))
    assert K.load_snapshot(spark, str(tmp_path), ["nodes"])["nodes"].collect() == df.collect()
