"""Operator 1: byte-level BPE encoding and decoding through a global distinct-word shuffle.

Documents are dealt into blocks by a hash; a block's texts travel once, compressed. Each block explodes its texts into
pre-tokens, in order, and sends each distinct one, once, to a bucket by the word's hash; buckets encode every distinct word
of all blocks once; the ids go back to the blocks that asked, which join them to the pre-tokens by position. A word's
list of occurrences is never gathered: a word that stands in every text reaches its bucket once per block. Decoding joins
the token-byte table, which the vocabulary file bounds.

The number of blocks follows the bytes of text, so a block's memory does not grow with the table.

Cases: a null or empty text has no tokens; a very long text is a block's part like any other; equal rows each give a row;
an empty table gives an empty result; only the id and text columns are read. Ids that the vocabulary lacks, and
nulls, decode to nothing.
"""

from __future__ import annotations

import base64
import hashlib
import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship, task_count
from .common import lean, mixed, pieces

BLOCK_BYTES = 6_000_000
_LOADED: dict[str, tuple] = {}
_SPLIT: dict[str, object] = {}


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


def _encoder(key: str, data: bytes, pattern: str):
    """The library's encoding and the token-byte table as (all bytes, offsets by id)."""
    if key not in _LOADED:
        import tiktoken

        ranks = read_ranks(data)
        by_id = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            by_id[i] = token
        ends = np.concatenate([[0], np.cumsum([len(t) for t in by_id])])
        _LOADED.clear()
        _LOADED[key] = (tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), np.frombuffer(b"".join(by_id), np.uint8), ends)
    return _LOADED[key]


def _ranges(wanted, top: int) -> str:
    """A character class body of the code points below top that wanted() takes."""
    out: list[list[int]] = []
    for c in range(top):
        if not 0xD800 <= c < 0xE000 and wanted(chr(c)):
            if out and out[-1][1] == c - 1:
                out[-1][1] = c
            else:
                out.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


def _splitters(pattern: str):
    """The given pattern, the same one narrowed to code points below U+0240 in the standard library's terms, and
    a test for code points that this Python doesn't know, on which libraries of other Unicode versions can differ."""
    if pattern not in _SPLIT:
        import regex

        letter, number = (_ranges(lambda c, k=k: unicodedata.category(c)[0] == k, 0x240) for k in "LN")
        blank = r"\t-\r \x85\xa0"
        near = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{blank}{letter}{number}]").replace(r"\p{L}", f"[{letter}]").replace(r"\p{N}", f"[{number}]").replace(r"\S", f"[^{blank}]").replace(r"\s", f"[{blank}]")
        unknown = re.compile(f"[{_ranges(lambda c: unicodedata.category(c) == 'Cn', 0x110000)}]")
        _SPLIT.clear()
        _SPLIT[pattern] = (regex.compile(pattern), re.compile(near), unknown)
    return _SPLIT[pattern]


def pretokens(text: str, pattern: str) -> list[str]:
    """The pattern's matches, in order. A text with code points unknown to this Python stays whole, and the
    library splits it when it is encoded."""
    full, near, unknown = _splitters(pattern)
    if text.isascii() or np.frombuffer(text.encode("utf-8", "replace"), np.uint8).max() < 0xC9:
        return near.findall(text)
    return [text] if unknown.search(text) else full.findall(text)


def _packed(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))) as w:
        w.write_table(rows)
    return sink.getvalue().to_pybytes()


def _unpacked(payload) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(payload)).read_all()


def _pack(batches, most: int = 24_000_000):
    """(block, id, text) rows, with a hash of the row and the number of blocks, to (block, payload) rows, a few for each block and input partition.

    A row's block depends on its partition and on how much of that came before, so repeated rows spread: a block gets `most` bytes
    of one row at a time at most. The input's partitions must come again in the same order, as those of files do."""
    from pyspark import TaskContext

    held, size, turn = [], 0, [TaskContext.get().partitionId() << 20]

    def out():
        rows = pa.Table.from_batches(held)
        count = int(rows.column("blocks")[0].as_py())
        salt = mixed(np.array([turn[0]], np.uint64))
        turn[0] += 1
        dealt = (mixed(rows.column("block").to_numpy().view(np.uint64) ^ salt) % np.uint64(count)).astype(np.int32)
        rows = rows.select(["id", "text"]).append_column("block", pa.array(dealt)).sort_by("block")
        blocks = rows.column("block").to_numpy()
        cuts = np.flatnonzero(np.diff(blocks)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(blocks)]):
            yield pa.record_batch([pa.array([int(blocks[lo])], pa.int32()), pa.array([_packed(rows.slice(lo, hi - lo).select(["id", "text"]))], pa.binary())], ["block", "payload"])

    for batch in batches:
        for part in pieces(batch, "text", most):
            held.append(part)
            size += part.nbytes
            if size >= most:
                yield from out()
                held, size = [], 0
    if held:
        yield from out()


def _block_words(payloads: pa.ChunkedArray, pattern: str, buckets: int) -> list[list[str]]:
    """The block's distinct pre-tokens, dealt to buckets, each bucket sorted."""
    words: set[str] = set()
    for payload in payloads:
        for text in _unpacked(payload.as_buffer()).column("text"):
            words.update(pretokens(text.as_py() or "", pattern))
    out: list[list[str]] = [[] for _ in range(buckets)]
    for w in sorted(words):
        out[zlib.crc32(w.encode()) % buckets].append(w)
    return out


def _words(payload) -> list[str]:
    return [w.decode() for w in zstandard.ZstdDecompressor().decompress(payload.as_buffer()).split(b"\xff")]


def _small(ids: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(3).compress(ids.astype("<u4").tobytes())


def _large(data) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "<u4").astype(np.int32)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of docs: the id and ids array<int>, as the library's encode_ordinary gives them."""
    spark = docs.sparkSession
    ship(spark)
    with open(ranks_path, "rb") as f:
        data = f.read()
    key, sent = hashlib.sha256(data + pattern.encode()).hexdigest(), spark.sparkContext.broadcast(data)
    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    total = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = task_count(spark)
    blocks = max(1, -(-total // block_bytes), min(tasks, -(-total // 1_000_000)))
    buckets = int(blocks)
    dealt = slim.select(F.xxhash64("id", "text").alias("block"), F.lit(blocks).alias("blocks"), "id", "text")
    packed = dealt.mapInArrow(lean(_pack), "block int, payload binary").repartition(max(tasks, 1), "block")

    def ask(rows: pa.Table) -> pa.Table:
        block = rows.column("block")[0].as_py()
        found = [(b, zstandard.ZstdCompressor(3).compress(b"\xff".join(w.encode() for w in words))) for b, words in enumerate(_block_words(rows.column("payload"), pattern, buckets)) if words]
        return pa.table({"bucket": pa.array([b for b, _ in found], pa.int32()), "block": pa.array([block] * len(found), pa.int32()), "words": pa.array([w for _, w in found], pa.binary())})

    def encode(rows: pa.Table) -> pa.Table:
        one = _encoder(key, sent.value, pattern)[0]
        known: dict[str, list[int]] = {}
        counts, flat = [], []
        for payload in rows.column("words"):
            mine = []
            for w in _words(payload):
                ids = known.get(w)
                if ids is None:
                    ids = known[w] = _encode_word(one, w, pattern)
                mine.append(ids)
            counts.append(_small(np.fromiter(map(len, mine), np.uint32, len(mine))))
            flat.append(_small(np.fromiter((i for ids in mine for i in ids), np.uint32)))
        return pa.table({"block": rows.column("block").cast(pa.int32()), "words": rows.column("words"), "counts": pa.array(counts, pa.binary()), "flat": pa.array(flat, pa.binary())})

    asked = packed.groupBy("block").applyInArrow(ask, "bucket int, block int, words binary")
    answers = asked.groupBy("bucket").applyInArrow(encode, "block int, words binary, counts binary, flat binary")

    def join(texts: pa.Table, back: pa.Table):
        index: dict[str, int] = {}
        counts, flat = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        for words, c, f in zip(back.column("words"), back.column("counts"), back.column("flat")):
            for w in _words(words):
                index[w] = len(index)
            counts.append(_large(c.as_buffer()))
            flat.append(_large(f.as_buffer()))
        count, ids = np.concatenate(counts), np.concatenate(flat)
        begin = np.concatenate([[0], np.cumsum(count)])
        keys, out, ends = [], [], [0]
        for payload in texts.column("payload"):
            rows = _unpacked(payload.as_buffer())
            keys.append(rows.column("id"))
            for text in rows.column("text"):
                ps = pretokens(text.as_py() or "", pattern)
                at = np.fromiter(map(index.__getitem__, ps), np.int64, len(ps))
                out.append(ids[spans(begin[at], count[at])])
                ends.append(ends[-1] + len(out[-1]))
        values = np.concatenate(out) if out else np.zeros(0, np.int32)
        key_column = pa.chunked_array([c for k in keys for c in k.chunks]) if keys else pa.chunked_array([pa.array([], pa.int64())])
        return pa.table({"id": key_column.combine_chunks(), "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))})

    joined = packed.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(join, f"id {kind}, ids array<int>")
    return joined.withColumnRenamed("id", id_col)


def _encode_word(one, word: str, pattern: str) -> list[int]:
    if not word.isascii() and _splitters(pattern)[2].search(word):
        return one.encode_ordinary(word)
    return one._encode_single_piece(word)


def spans(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Indices begin[i] .. begin[i]+count[i]-1 for all i, in order."""
    total = int(count.sum())
    ends = np.cumsum(count)
    return np.arange(total) + np.repeat(begin - (ends - count), count)


def decoded(ids: np.ndarray, table: np.ndarray, ends: np.ndarray, step: int = 500_000) -> bytes:
    """The bytes of ids by the token-byte table."""
    out = []
    ids = ids[(ids >= 0) & (ids < len(ends) - 1)]
    for at in range(0, len(ids), step):
        part = ids[at : at + step]
        out.append(table[spans(ends[part], ends[part + 1] - ends[part])].tobytes())
    return b"".join(out)


def decode_ids(tokens: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids", digest: bool = False) -> DataFrame:
    """The id and decoded binary; with digest instead n_tokens, ids_sha256 and decoded_sha256."""
    spark = tokens.sparkSession
    ship(spark)
    with open(ranks_path, "rb") as f:
        data = f.read()
    key, sent = hashlib.sha256(data + pattern.encode()).hexdigest(), spark.sparkContext.broadcast(data)
    kind = tokens.schema[id_col].dataType.simpleString()

    def run(batches):
        _, table, ends = _encoder(key, sent.value, pattern)
        for batch in batches:
            lists = batch.column(1)
            values = lists.flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            sizes = np.array([len(x) if x.is_valid else 0 for x in lists], np.int64)
            to = np.cumsum(sizes)
            parts = [values[e - n : e] for e, n in zip(to, sizes)]
            if not digest:
                for k, p in enumerate(parts):
                    yield pa.record_batch([batch.column(0).slice(k, 1), pa.array([decoded(p, table, ends)], pa.binary())], ["id", "decoded"])
                continue
            yield pa.record_batch(
                [batch.column(0), pa.array(sizes), pa.array([hashlib.sha256(p.astype("<u4").tobytes()).hexdigest() for p in parts], pa.string()), pa.array([hashlib.sha256(decoded(p, table, ends)).hexdigest() for p in parts], pa.string())],
                ["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    slim = tokens.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    shape = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else f"id {kind}, decoded binary"
    return slim.mapInArrow(lean(run), shape).withColumnRenamed("id", id_col)
