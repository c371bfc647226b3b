"""Queries cover their whole tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom import adapters as A
from codeloom.operators import graph as G
from codeloom.operators import search as S
from codeloom.queries import catalogue

QUERIES, SQL = catalogue()


def test_queries_cover_the_whole_tables(spark, sf001):
    run = lambda name: QUERIES[name](spark, sf001)
    calls, lines = A.calls(spark, sf001).collect(), A.table(spark, sf001, "lineitem")
    assert {(r["src"], r["dst"]) for r in calls} == {(r["id"], r["seed"]) for r in run("callers").collect()} == {(r["seed"], r["id"]) for r in run("callees").collect()}
    assert run("context_assembly").count() == A.symbols(spark, sf001).count() > 50
    assert run("gitlog_numstat").count() == lines.select("l_orderkey", "l_partkey").distinct().count()
    assert run("diff_hunks").agg(F.sum("hunks")).first()[0] == lines.count()
    points = lines.select("l_suppkey", "l_partkey").distinct().count()
    assert run("interval_call_resolution").count() == run("innermost_container").count() == points
    assert run("hunk_overlap").count() == lines.select("l_orderkey").distinct().count()


def test_minhash_membership_gives_every_copy(spark):
    r = random.Random(5)
    texts = [" ".join(f"w{r.randrange(9000)}" for _ in range(40)) for _ in range(3)]
    near = texts[0].split()
    texts.append(" ".join([*near[:-1], "other"]))
    docs = [(4 * i + k, t) for k, t in enumerate(texts) for i in range(25)] + [(900, ""), (901, "a b")]
    df = spark.createDataFrame(docs, "id long, body string")
    pairs, members = S.minhash_classes(df)
    of = {x["id"]: x["class_id"] for x in members.collect()}
    assert members.count() == len(docs) and of == {i: i % 4 if i < 900 else i for i, _ in docs}
    linked = {(x["a"], x["b"]) for x in pairs.collect()}
    assert linked == {(0, 3)}
    found = {(a, b) for a in of for b in of if a < b < 900 and (of[a] == of[b] or tuple(sorted((of[a], of[b]))) in linked)}
    assert found == {(x["a"], x["b"]) for x in S.jaccard_pairs(df).collect()}


def test_minhash_query_has_a_row_per_document(spark, sf001):
    rows = QUERIES["minhash_pairs"](spark, sf001).where("kind = 'member'")
    assert rows.count() == A.bodies(spark, sf001).count()


def test_whole_texts_are_compared(spark):
    same = "word " * 2000
    df = spark.createDataFrame([(1, same + "alpha beta gamma"), (2, same + "delta epsilon zeta"), (3, same + "alpha beta gamma")], "id long, body string")
    assert [(x["a"], x["b"]) for x in S.jaccard_pairs(df).collect()] == [(1, 3)]
    assert len(S.jaccard_pairs(df, most_chars=4096).collect()) == 3
    assert {x["id"]: x["class_id"] for x in S.minhash_classes(df)[1].collect()} == {1: 1, 2: 2, 3: 1}
    texts = df.select(F.col("body").alias("text"))
    cache = texts.limit(0).select(F.sha2("text", 256).alias("text_hash"))
    assert S.embedded(texts, cache, lambda batch: np.ones((len(batch), 2))).count() == 2


def test_deep_graphs_have_all_levels_and_summaries(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(12)], "src long, dst long")
    symbols = spark.range(13).select("id", F.concat(F.lit("f"), "id").alias("name"), F.lit("function").alias("kind"), F.lit(1).alias("complexity"))
    levelled = G.levels(chain)
    assert {r["id"]: r["level"] for r in levelled.collect()} == {i: 12 - i for i in range(13)}
    text = {r["id"]: r["summary"] for r in G.summaries(symbols, chain, levelled).collect()}
    assert len(text) == 13 and "Calls: f1 (" in text[0]
    with pytest.raises(ValueError):
        G.levels(chain, most=5)
    with pytest.raises(ValueError):
        G.summaries(symbols, chain, levelled, 8)


def test_hcgs_summaries_has_every_symbol(spark, sf001):
    assert QUERIES["hcgs_summaries"](spark, sf001).count() == A.symbols(spark, sf001).count()


def test_entry_points_have_five_callers(spark, sf001):
    rows = QUERIES["entry_points"](spark, sf001).collect()
    assert rows and all(r["callers"] >= 5 for r in rows)
