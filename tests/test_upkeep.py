"""Sync, lazy rebuilds, caches, staged builds, logs, request checks, formats and the functional analysis on small tables."""

import pytest
from pyspark.sql import functions as F

from codeloom.functions import texts as T
from codeloom.operators import purity as P
from codeloom.operators import store as S
from codeloom.operators import upkeep as U

FILE = "filepath string, mtime double, content_hash string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_sync_keeps_replaces_adds_and_removes(spark):
    store = spark.createDataFrame([("same", 1.0, "a"), ("touched", 1.0, "b"), ("changed", 1.0, "c"), ("gone", 1.0, "d"), ("unknown", None, None)], FILE)
    listing = spark.createDataFrame([("same", 1.005, "z"), ("touched", 9.0, "b"), ("changed", 9.0, "y"), ("new", 2.0, "e"), ("unknown", 3.0, "u")], FILE)
    assert rows(U.synced(store, listing)) == [("changed", 9.0, "y"), ("new", 2.0, "e"), ("same", 1.0, "a"), ("touched", 1.0, "b"), ("unknown", 3.0, "u")]
    assert rows(U.synced(store, listing.limit(0))) == []
    assert rows(U.synced(store.limit(0), listing)) == rows(listing)


def test_only_dirty_files_are_built_again(spark):
    build = lambda f: f.select("filepath", F.concat(F.lit("built "), "content_hash").alias("row"))
    index = spark.createDataFrame([("a", "old a"), ("b", "old b"), ("c", "old c")], "filepath string, row string")
    built = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "filepath string, content_hash string")
    files = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "filepath string, content_hash string")
    assert rows(U.dirty(built, files)) == [("b", "2"), ("d", "1")]
    assert rows(U.refreshed(index, built, files, build)) == [("a", "old a"), ("b", "built 2"), ("d", "built 1")]


def test_cache_computes_missing_keys_once_and_is_trimmed(spark):
    cache = spark.createDataFrame([("a", -1)], "blob string, lines long")
    wanted = spark.createDataFrame([("a", "x"), ("b", "x\ny"), ("b", "x\ny"), ("c", "")], "blob string, body string")
    full = U.cached(cache, wanted, lambda m: m.select("blob", F.size(F.split("body", "\n", -1)).cast("long").alias("lines")), "blob")
    assert rows(full) == [("a", -1), ("b", 2), ("c", 1)]
    assert rows(U.trimmed(full, "blob", 2)) == [("b", 2), ("c", 1)]


def test_a_failed_build_leaves_the_table(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    U.build_and_swap(spark.range(3), path)
    with pytest.raises(Exception):
        U.build_and_swap(spark.range(5).select(F.when(F.col("id") == 4, F.raise_error(F.lit("no"))).otherwise(F.col("id")).alias("id")), path)
    assert rows(spark.read.parquet(path)) == [(0,), (1,), (2,)]
    U.build_and_swap(spark.range(2), path)
    assert rows(spark.read.schema("id long").parquet(path)) == [(0,), (1,)]
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["t"]


def test_log_appends(spark, tmp_path):
    for word in ("one", "two"):
        U.append_log(spark.createDataFrame([(word,)], "q string"), str(tmp_path / "log"))
    log = U.read_log(spark, str(tmp_path / "log"), "event_id string, q string").collect()
    assert sorted(r["q"] for r in log) == ["one", "two"] and len({r["event_id"] for r in log}) == 2


def test_requests_are_checked(spark):
    schema = "query string, mode string, limit long, offset long, depth long, user string"
    given = [(" find me ", " FTS ", 0, -1, 99, "u"), ("x" * 300, "trace", 500, 7, 0, "u"), ("a\nb", "dsl", 5, 0, 3, None), (None, None, 5, 0, 3, "u"), ("q", "other", 5, 0, 3, "u"), ("a\x00b", "auto", 1, 0, 1, "u")]
    got = list(map(tuple, T.checked(spark.createDataFrame(given, schema).coalesce(1)).collect()))
    assert got == [("find me", "fts", 1, 0, 10, "u", None), ("x" * 200, "trace", 100, 7, 1, "u", None), ("a\nb", "dsl", 5, 0, 3, None, "query"), (None, None, 5, 0, 3, "u", "mode"), ("q", "other", 5, 0, 3, "u", "mode"), ("a\x00b", "auto", 1, 0, 1, "u", "query")]


@pytest.mark.parametrize("seconds, text", [(0.0, "0.0s"), (0.25, "0.2s"), (59.9, "59.9s"), (60.0, "1m 0s"), (125.5, "2m 6s"), (3600.0, "1h 0m 0s"), (90061.4, "25h 1m 1s"), (None, None)])
def test_durations(spark, seconds, text):
    assert spark.createDataFrame([(seconds,)], "s double").select(T.duration(F.col("s"))).first()[0] == text


def test_stamps_and_file_names(spark):
    given = ["12", " -7 ", "1.5", "", "x", None, "99999999999999999999"]
    assert [r[0] for r in spark.createDataFrame([(g,) for g in given], "t string").coalesce(1).select(T.stamp(F.col("t"))).collect()] == [12, -7, 0, 0, 0, 0, 0]
    assert spark.createDataFrame([('a/b\\c:d*e?f"g<h>i|j k',)], "t string").select(T.file_name(F.col("t"))).first()[0] == "a_b_c_d_e_f_g_h_i_j k"


def test_lambdas_count_up_to_three_steps(spark):
    contains = spark.createDataFrame([("f", "c"), ("c", "m"), ("m", "n"), ("n", "o"), ("g", "k")], "src string, dst string")
    lambdas = spark.createDataFrame([("c",), ("m",), ("m",), ("n",), ("o",), ("k",)], "parent string")
    files = spark.createDataFrame([("f", "F"), ("g", "G")], "id string, name string")
    assert [tuple(r) for r in P.lambda_density(contains, lambdas, files).collect()] == [("F", 4), ("G", 1)]


def test_state_and_recursion(spark):
    symbols = spark.createDataFrame([(1, "a", "x.py"), (2, "b", "y.py")], "id long, name string, filepath string")
    accesses = spark.createDataFrame([(1, True, False), (1, False, True), (1, False, False), (2, None, True), (3, True, True)], "src long, is_mutation boolean, is_taint boolean")
    assert [tuple(r) for r in P.state_mutations(accesses, symbols).collect()] == [("a", 2), ("b", 1)]
    edges = spark.createDataFrame([(1, 2), (2, 2), (2, 2)], "src long, dst long")
    assert rows(P.recursive_symbols(edges, symbols)) == [("b", "y.py")]


def test_summaries_of_no_files(spark):
    empty = spark.createDataFrame([], "classes long, abstract long, methods long, attributes long, ca long, ce long, coupling long")
    out = P.object_summary(empty).first()
    assert (out["files"], out["abstractness"], out["instability"], out["distance"], out["mean_coupling"]) == (0, 0.0, 0.0, 1.0, 0.0)
    assert P.complexity_summary(spark.createDataFrame([], "cyclomatic long, complexity_class string")).first()["files"] == 0


def test_report_lines_keep_nulls(spark):
    one = spark.createDataFrame([(1, None)], "a long, b string")
    assert rows(S.report_lines({"x": one})) == [("x", '{"a":1,"b":null}')]
    assert rows(S.report_lines({"x": one}, yaml=True)) == [("x", '- {"a":1,"b":null}')]
