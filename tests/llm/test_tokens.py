import hashlib
import sys
import unicodedata

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

from codeloom.llm import byte_bpe
from codeloom.llm.byte_bpe import decode_ids, encode_documents
from codeloom.llm.queries import op1_byte_bpe, op8_token_counts
from codeloom.llm.token_counts import count_tokens

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=byte_bpe.read_ranks(open(PATH, "rb").read()), special_tokens={})


def test_encode_equals_the_library_and_decodes_back(spark, odd):
    enc = library()
    got = encode_documents(odd, PATH, PATTERN, block_bytes=50_000)
    rows = sorted((repr(r["doc_id"]), list(r["ids"])) for r in got.collect())
    assert rows == sorted((repr(r["doc_id"]), enc.encode_ordinary(r["text"] or "")) for r in odd.collect())
    back = sorted((repr(r["doc_id"]), bytes(r["decoded"])) for r in decode_ids(got, PATH, PATTERN).collect())
    assert back == sorted((repr(r["doc_id"]), (r["text"] or "").encode()) for r in odd.collect())


def test_op1_on_the_small_table(spark, sf001):
    enc = library()
    want = {}
    for r in spark.read.parquet(f"{sf001}/documents.parquet").collect():
        ids = enc.encode_ordinary(r["text"] or "")
        want[r["doc_id"]] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest())
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in op1_byte_bpe(spark, sf001).collect()} == want


def test_splits_agree_with_the_library_on_every_known_code_point():
    ranks = {bytes([i]): i for i in range(256)}
    points = [c for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) != "Cn"]
    for before in "a1!\t":
        own = dict(ranks)
        for c in points:
            own.setdefault((before + chr(c)).encode(), len(own))
        enc = tiktoken.Encoding("probe", pat_str=PATTERN, mergeable_ranks=own, special_tokens={})
        texts = [before + chr(c) for c in points]
        assert [t for t in texts if (len(byte_bpe.pretokens(t, PATTERN)) == 1) != (len(enc.encode_ordinary(t)) == 1)] == []


def test_empty_tables(spark, odd):
    none = odd.where("false")
    assert encode_documents(none, PATH, PATTERN).collect() == []
    assert decode_ids(encode_documents(none, PATH, PATTERN), PATH, PATTERN, digest=True).collect() == []
    assert count_tokens(none, public_tokenizers.path("word_bpe_49k.json")).collect() == []


def test_decoding_skips_unknown_ids(spark):
    rows = spark.createDataFrame([(1, [0, None, 99_999_999, -5, 1]), (2, None), (3, [])], "doc_id long, ids array<int>")
    table = {v: k for k, v in byte_bpe.read_ranks(open(PATH, "rb").read()).items()}
    assert {r["doc_id"]: bytes(r["decoded"]) for r in decode_ids(rows, PATH, PATTERN).collect()} == {1: table[0] + table[1], 2: b"", 3: b""}


def test_counts_equal_the_library(spark, odd, sf001):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    count = lambda t: len(tok.encode(t or "", add_special_tokens=False).ids)
    got = count_tokens(odd, public_tokenizers.path("word_bpe_49k.json"))
    assert sorted((repr(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got.collect()) == sorted((repr(r["doc_id"]), len((r["text"] or "").encode()), count(r["text"]), count(r["text"]) > 2048) for r in odd.collect())
    want = {r["doc_id"]: count(r["text"]) for r in spark.read.parquet(f"{sf001}/documents.parquet").collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in op8_token_counts(spark, sf001).collect()} == want


def test_many_repeated_rows_spread_over_blocks(spark):
    """Copies of one row, flushed in several turns, go to several blocks, and all come back."""
    text = "the same row again and again " * 20
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string").crossJoin(spark.range(10_000)).select("doc_id", "text").repartition(4)
    rows = encode_documents(docs, PATH, PATTERN, block_bytes=100_000).groupBy("doc_id", "ids").count().collect()
    assert [(r["doc_id"], list(r["ids"]), r["count"]) for r in rows] == [(1, library().encode_ordinary(text), 10_000)]


def test_long_segments_are_cut_where_it_is_safe(spark):
    from codeloom.llm import token_counts

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    text = "\u6f22\u5b57\u3002\u4eee\u540d\uff0c\uff01\u4e00\u0301x1<|endoftext|>\u3001\u3099\u03a3\u3002\u4e8c" * 3000
    assert len(token_counts._parts(text)) > 1 and "".join(token_counts._parts(text)) == text
    rows = spark.createDataFrame([(1, text), (2, "x" * 50_000 + "\u3002" + "y" * 50_000)], "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in count_tokens(rows, public_tokenizers.path("word_bpe_49k.json")).collect()}
    assert got[1] == len(tok.encode(text, add_special_tokens=False)) and got[2] > 0
