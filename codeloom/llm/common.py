"""Helpers that the operators share."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_part(doc_id) -> "F.Column":
    """crc32 of the id as text, modulo 3; rows with 1 are held out from every training."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def strings(array: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string array, without copying; nulls count as empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null("")
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(array.type) else np.int32
    _, off, data = array.buffers()
    offsets = np.frombuffer(off, kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(batch: pa.RecordBatch, column: str, most: int = 2_000_000):
    """Slices of a batch with about so many bytes of text each, one row at least."""
    column_ = batch.column(batch.schema.get_field_index(column))
    _, offsets = strings(column_)
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def lean(run):
    """A function for mapInArrow that gives the worker's freed memory back to the system when its partition ends; idle workers live on."""

    def outer(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return outer


def mixed(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS["up"]) < n:
        size = 1 << (n - 1).bit_length()
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _POWERS[name] = np.multiply.accumulate(out)
    return _POWERS["up"], _POWERS["down"]


#: What op 5 calls words: runs of bytes other than space and the controls 9 to 13; A-Z count as a-z.
BLANKS = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
#: Runs of ASCII letters and digits and of bytes beyond ASCII.
MARKS = ~(np.isin(np.arange(256), [*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]))
LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint8)


def hashed_words(raw: np.ndarray, offsets: np.ndarray, gaps: np.ndarray = BLANKS) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in order, and for each text where its words begin (one more entry than texts).

    A hash is a polynomial over the word's lower-cased bytes modulo 2**64, taken from one running sum by a
    subtraction and a multiplication with an inverse power, then mixed.
    """
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~gaps[raw]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    out = np.empty(len(starts), np.uint64)
    values = LOWER[raw]
    at, step = 0, 1 << 18
    while at < len(starts):
        lo = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, lo + step, side="right")))
        hi = ends[to - 1]
        up, down = _powers(int(hi - lo) + 1)
        total = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum((values[lo:hi].astype(np.uint64) + np.uint64(1)) * up[: hi - lo], out=total[1:])
        s, e = starts[at:to] - lo, ends[at:to] - lo
        out[at:to] = (total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        at = to
    return mixed(out), np.searchsorted(starts, offsets).astype(np.int64)


def mixed_int(x: int) -> int:
    return int(mixed(np.array([x & (2**64 - 1)], np.uint64))[0])


#: Rows of a lookup table by key that are broadcast at most; with more, the join is salted into so many parts.
LOOKUP_ROWS, SALTS = 20_000, 16


def looked_up(rows: DataFrame, lookup: DataFrame, key: str, spread: str, most: int = LOOKUP_ROWS) -> DataFrame:
    """rows left joined with lookup, one row a key, where a key may hold a third of all rows: a counted small lookup is broadcast,
    so rows stay where they are; a larger one is repeated for each salt, and a hot key's rows are dealt over the salts by `spread`."""
    if lookup.count() <= most:
        return rows.join(F.broadcast(lookup), key, "left")
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)))
    return salted.join(lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))), [key, "_salt"], "left").drop("_salt")
