"""Operator 8: token counts.

Every text is cut at spaces and line feeds. Such a cut is safe for a tokenizer whose pre-tokenizer drops white
space: no token, special string, composition or case rule reaches across it. A segment longer than SEGMENT is cut further, where
CJK punctuation meets an ideograph: there a run of the pre-tokenizer ends, and ideographs neither compose with what is before them nor
have case. The distinct segments of a batch that the worker doesn't know yet are encoded together, in batches of about equal
bytes; only lengths return.

Cases: a null or empty text has 0 bytes and 0 tokens; very long texts are cut like all others (a segment
without any safe cut is encoded whole); repeated rows give repeated rows; an empty table gives an empty result; only
the id and text columns are read, so other columns can't clash.
"""

from __future__ import annotations

import hashlib
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import pieces

_LOADED: dict[str, tuple] = {}
#: Known segments a worker keeps; beyond it starts anew. A segment of more characters isn't kept.
KNOWN, LONG = 400_000, 64
#: Characters from which a segment is cut further, and the cuts.
SEGMENT, SAFE = 30_000, re.compile("(?<=[\u3001\u3002\uff01\uff0c\uff1a\uff1b\uff1f])(?=[\u4e00-\u9fff])")


def _tokenizer(key: str, data: str):
    if key not in _LOADED:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tok = Tokenizer.from_str(data)
        tok.no_truncation()
        tok.no_padding()
        _LOADED.clear()
        _LOADED[key] = (tok, {"": 0})
    return _LOADED[key]


def _parts(segment: str) -> list[str]:
    """Of about SEGMENT characters each, cut where that is safe."""
    out, at = [], 0
    while len(segment) - at > SEGMENT and (m := SAFE.search(segment, at + SEGMENT)):
        out.append(segment[at : m.start()])
        at = m.start()
    return [*out, segment[at:]]


def lengths(tok, known: dict[str, int], texts: list[str | None], batch_bytes: int = 200_000) -> np.ndarray:
    """Token counts of texts; known is filled."""
    cut = [(t or "").replace("\n", " ").split(" ") for t in texts]
    cut = [[part for s in segments for part in _parts(s)] if max(map(len, segments)) > SEGMENT else segments for segments in cut]
    new: set[str] = set()
    for segments in cut:
        new.update(segments)
    new = sorted(s for s in new if s not in known)
    extra: dict[str, int] = {}
    at = 0
    while at < len(new):
        end, size = at, 0
        while end < len(new) and (size < batch_bytes or end == at):
            size += len(new[end]) if new[end].isascii() else len(new[end].encode())
            end += 1
        for s, e in zip(new[at:end], tok.encode_batch_fast(new[at:end], add_special_tokens=False)):
            (known if len(s) <= LONG else extra)[s] = len(e)
        at = end
    get = known.__getitem__ if not extra else lambda s: known[s] if s in known else extra[s]
    out = np.fromiter((sum(map(get, segments)) for segments in cut), np.int64, len(cut))
    if len(known) > KNOWN:
        known.clear()
        known[""] = 0
    return out


def count_tokens(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048) -> DataFrame:
    """One row per row of docs: the id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit)."""
    spark = docs.sparkSession
    ship(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        data = f.read()
    key, sent = hashlib.sha256(data.encode()).hexdigest(), spark.sparkContext.broadcast(data)

    def run(batches):
        tok, known = _tokenizer(key, sent.value)
        for batch in batches:
            for part in pieces(batch, "text"):
                yield pa.record_batch([part.column(0), part.column(1), pa.array(lengths(tok, known, part.column(2).to_pylist()))], ["id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(F.octet_length(text_col).cast("long"), F.lit(0).cast("long")).alias("n_bytes"), F.col(text_col).alias("text"))
    out = slim.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
