import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline as C
from codeloom.llm.byte_bpe import read_ranks
from codeloom.session import written

from .test_documents import brute_join, brute_overlaps
from .test_secrets_urls import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Each stage's input and output."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, f in C.STAGES:
        after = written(f(spark, docs, SF), "test")
        out.append((name, docs, after))
        docs = after
    return out


def texts(df):
    return {r["doc_id"]: r["text"] or "" for r in df.collect()}


def test_names_and_columns(stages):
    assert [s[0] for s in stages] == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "secret scans", "byte-level BPE"]
    assert all(after.columns == ["doc_id", "text", "lang", "source", "n_chars"] for _, _, after in stages[:-1])


def test_quality_keeps_good_documents(spark, stages):
    _, before, after = stages[0]
    kept = set(texts(after))
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r["doc_id"] in texts(before)}
    assert sum((k in kept) == bool(v) for k, v in labels.items()) >= 0.9 * len(labels)


def test_one_document_of_each_group_stays(stages):
    _, before, after = stages[1]
    rows = sorted(texts(before).items())
    assert set(texts(after)) == {k for k, _, c in brute_join(rows, 5, 80) if k == c}


def test_contaminated_documents_go(spark, stages):
    _, before, after = stages[2]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    near = [(d, t) for d, t in texts(before).items()]
    short = [(d, t) for d, t in near if len(t) < 4000]  # brute force is slow on long texts
    bad = {d for d, _ in brute_overlaps(short, items)}
    kept = set(texts(after))
    assert all((d in kept) == (d not in bad) for d, _ in short)
    assert all(d in kept for d, t in near if len(t) >= 4000 and not any(q in t for _, q in items))


def test_secrets_are_masked(spark, stages):
    rows = spark.createDataFrame([(1, 'a token = "' + "f0" * 20 + '" z', "en", "s", 60), (2, "plain", "en", "s", 5), (3, None, None, None, None), (4, "é " + "AKIA" + "B" * 16 + " and " + "ab12" * 8, "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r for r in C.secrets(spark, rows, SF).collect()}
    assert got[1]["text"] == 'a [assign]" z' and got[1]["n_chars"] == len(got[1]["text"])
    assert (got[2]["text"], got[3]["text"], got[3]["n_chars"]) == ("plain", None, None)
    assert got[4]["text"] == "é [access] and [hex]"
    _, before, after = stages[3]
    b, a = texts(before), texts(after)
    assert b.keys() == a.keys() and all(a[k] == t or brute(t) or len(a[k]) != len(t) for k, t in b.items())


def test_tokens_equal_the_library(stages):
    _, before, after = stages[4]
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb").read()), special_tokens={})
    for k, t in texts(before).items():
        ids = enc.encode_ordinary(t)
        row = after.where(f"doc_id = {k}").first() if zlib.crc32(str(k).encode()) % 20 == 0 else None
        if row:
            assert (row["n_tokens"], row["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
    assert after.count() == before.count()


def test_odd_and_empty_tables(spark, odd):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for table in (docs, docs.where("false")):
        for _, f in C.STAGES:
            assert f(spark, table, SF).count() <= table.count()
        assert C.quality(spark, docs, SF).columns == docs.columns


def test_rows_of_one_id_null_ids_and_repeated_rows(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    one, two = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    rows = [(1, one, "en", "s", 1), (1, one, "en", "s", 1), (1, one, "de", "s", 1), (1, item, "en", "s", 2), (None, two, "en", "s", 3), (None, item, "en", "s", 3), (5, two, "en", "s", 3), (6, "", "en", "s", 0), (6, "", "en", "s", 0), (7, None, None, None, None)]
    rows += [(10, two + " tail of words", "x", "s", 9)] * 300
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = sorted((tuple(r) for r in C.near_duplicates(spark, docs, SF).collect()), key=repr)
    item_row = (1, item, "en", "s", 2)
    assert got == sorted([(1, one, "de", "s", 1), item_row, (5, two, "en", "s", 3), (6, "", "en", "s", 0), (7, None, None, None, None)], key=repr)
    clean = [tuple(r) for r in C.decontamination(spark, docs, SF).collect()]
    assert sorted(clean, key=repr) == sorted((r for r in rows if r[1] != item), key=repr)
    wide = spark.createDataFrame([(1, "token = abcdef123", "en", "s", 17, "spans")], "doc_id long, text string, lang string, source string, n_chars long, spans string")
    assert [tuple(r) for r in C.secrets(spark, wide, SF).collect()] == [(1, "[assign]", "en", "s", 8, "spans")]
