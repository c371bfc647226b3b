"""Operator 2: benchmark decontamination by spaced seeds.

A text contains a benchmark item where, without gaps, WINDOW words in a row (the whole item if it is shorter) line up
with the item's so that LEAST of them are equal (the same part of a shorter item). A seed's mask compares some word positions
and ignores the others, so a substitution at an ignored position does not matter. The three masks together hit every
window with WINDOW - LEAST substitutions, wherever these are. Items of 6 to 9 words also have seeds of three words in a row, one more of
them than substitutions they allow.

Test hashes make a filter of fixed size, sent to the workers; training hashes that pass it are joined with the test hashes
by value, and overlaps around these hits are verified word by word. Runs of hits in a text make one region, so the
words of a region travel once. Equal benchmark items are one item, named by the least id.

Cases: words are runs of letters, digits and bytes beyond ASCII, lower-cased; null and empty texts and items, and items of
fewer than 6 words, match nothing; very long texts are scanned whole; equal rows give equal rows; an empty table on either
side gives an empty result; only the id and text columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship, written
from .common import MARKS, hashed_words, lean, mixed, pieces, strings

MASKS = ((0, 1, 2, 4, 5), (0, 1, 5, 6, 7), (0, 1, 6, 8, 9))
#: The mask of short items; its number is len(MASKS).
RUN = (0, 1, 2)
WINDOW, LEAST, SHORTEST, COVERED = 13, 10, 6, 10
FILTER_BITS = 1 << 25
#: With more test hashes than this the filter would pass too much; then all training hashes are joined.
MOST_FILTERED = 8_000_000
_SALTS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))


def words_of(column) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return hashed_words(*strings(pc.utf8_lower(column)), MARKS)


def seeds(words: np.ndarray, mask: int) -> np.ndarray:
    """The mask's hash at each position where it fits."""
    offsets = (*MASKS, RUN)[mask]
    n = max(0, len(words) - offsets[-1])
    h = np.full(n, mask + 1, np.uint64)
    for o, salt in zip(offsets, _SALTS):
        h += words[o : o + n] * salt
    return mixed(h)


def overlap(text: np.ndarray, item: np.ndarray, shift: int) -> tuple[int, int, int] | None:
    """(first word of text, words, equal words) of the best window of an alignment, text[i + shift] beside item[i]."""
    lo, hi = max(0, -shift), min(len(item), len(text) - shift)
    window = min(WINDOW, len(item))
    if hi - lo < window or window < SHORTEST:
        return None
    same = np.concatenate([[0], np.cumsum(text[lo + shift : hi + shift] == item[lo:hi])])
    sums = same[window:] - same[:-window]
    if sums.max() * WINDOW < LEAST * window:
        return None
    good = np.flatnonzero(sums * WINDOW >= LEAST * window)
    first, last = int(good[0]), int(good[-1]) + window
    return lo + shift + first, last - first, int(same[last] - same[first])


def item_seeds(words: np.ndarray):
    """(mask, places) of an item's seeds."""
    n = len(words)
    if n >= SHORTEST:
        for mask in range(len(MASKS)):
            yield mask, np.arange(max(0, n - MASKS[mask][-1]))
        if n < COVERED:
            yield len(MASKS), np.arange(0, n - 2, 3)


def _test_seeds(batches):
    for batch in batches:
        ids, hashes, places, masks = [], [], [], []
        words, at = words_of(batch.column(1))
        for k, (lo, hi) in enumerate(zip(at[:-1], at[1:])):
            for mask, where in item_seeds(words[lo:hi]):
                ids.append(np.full(len(where), k))
                hashes.append(seeds(words[lo:hi], mask)[where])
                places.append(where)
                masks.append(np.full(len(where), mask))
        if ids:
            yield pa.record_batch([batch.column(0).take(pa.array(np.concatenate(ids))), pa.array(np.concatenate(hashes).view(np.int64)), pa.array(np.concatenate(places).astype(np.int32)), pa.array(np.concatenate(masks).astype(np.int32))], ["item", "hash", "item_at", "mask"])


def _item_words(batches):
    for batch in batches:
        words, at = words_of(batch.column(1))
        yield pa.record_batch([batch.column(0), pa.array([words[lo:hi].view(np.int64) for lo, hi in zip(at[:-1], at[1:])], pa.list_(pa.int64()))], ["item", "item_words"])


def _regions(sent, masks):
    """(id, region, start, words, hashes, places): stretches of a text's words around seeds that pass the filter."""

    def run(batches):
        bits = sent.value
        for batch in batches:
            for part in pieces(batch, "text"):
                words, at = words_of(part.column(1))
                hit_at, hit_hash = [], []
                for mask in masks:
                    h = seeds(words, mask)
                    if bits is not None:
                        slot = (h % np.uint64(FILTER_BITS)).astype(np.int64)
                        found = np.flatnonzero(bits[slot >> 3] >> (slot & 7).astype(np.uint8) & 1)
                    else:
                        found = np.arange(len(h))
                    doc = np.searchsorted(at, found, side="right") - 1
                    found = found[found + (*MASKS, RUN)[mask][-1] < at[doc + 1]]
                    hit_at.append(found)
                    hit_hash.append(h[found])
                where, hashes = np.concatenate(hit_at), np.concatenate(hit_hash)
                order = np.argsort(where, kind="stable")
                where, hashes = where[order], hashes[order]
                doc = np.searchsorted(at, where, side="right") - 1
                new = np.flatnonzero(np.concatenate([[True], (np.diff(where) > WINDOW) | (np.diff(doc) > 0)])) if len(where) else np.zeros(0, np.int64)
                rows = []
                for lo, hi in zip(new, np.append(new[1:], len(where))):
                    d = doc[lo]
                    begin, end = max(at[d], where[lo] - 2 * WINDOW), min(at[d + 1], where[hi - 1] + 3 * WINDOW)
                    rows.append((d, begin - at[d], words[begin:end], hashes[lo:hi], where[lo:hi] - begin))
                take = pa.array([r[0] for r in rows], pa.int64())
                yield pa.record_batch(
                    [part.column(0).take(take), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2].view(np.int64) for r in rows], pa.list_(pa.int64())), pa.array([r[3].view(np.int64) for r in rows], pa.list_(pa.int64())), pa.array([r[4].astype(np.int32) for r in rows], pa.list_(pa.int32()))],
                    ["id", "start", "words", "hashes", "places"],
                )

    return run


def _verify(batches):
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(n)) for n in ("words", "item_words", "shifts", "start")]
        keep, found = [], []
        for k in range(batch.num_rows):
            text, item, shifts = (c[k].values.to_numpy(zero_copy_only=False) for c in columns[:3])
            best = max((o for s in shifts if (o := overlap(text, item, int(s)))), key=lambda o: (o[2], o[1], -o[0]), default=None)
            if best:
                keep.append(k)
                found.append((best[0] + columns[3][k].as_py(), *best[1:]))
        take = pa.array(keep, pa.int64())
        yield pa.record_batch([batch.column(0).take(take), batch.column(1).take(take), *(pa.array([f[i] for f in found], pa.int64()) for i in range(3))], ["id", "item", "first_word", "n_words", "n_equal"])


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each distinct row id of docs and item that it contains: the id, the item's id, first_word, n_words and n_equal of
    its best overlap."""
    spark = docs.sparkSession
    ship(spark)
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    items = written(benchmark.select(F.col(item_col).alias("item"), F.col(item_text).alias("text")).where("text is not null").groupBy("text").agg(F.min("item").alias("item")).select("item", "text"), "items")
    tests = written(items.mapInArrow(_test_seeds, f"item {item_kind}, hash long, item_at int, mask int"), "seeds")
    slots = tests.select(F.pmod(F.col("hash"), F.lit(FILTER_BITS)).alias("slot")).distinct()  # the modulus is a power of two: equal for signed and unsigned
    masks = sorted({*range(len(MASKS)), *(r["mask"] for r in tests.select("mask").distinct().collect())})  # at most 4 rows
    bits = None
    if tests.count() <= MOST_FILTERED:
        slot = slots.toPandas()["slot"].to_numpy(np.int64)
        bits = np.zeros(FILTER_BITS >> 3, np.uint8)
        np.bitwise_or.at(bits, slot >> 3, np.left_shift(1, slot & 7).astype(np.uint8))
    sent = spark.sparkContext.broadcast(bits)
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    shape = f"id {kind}, start long, words array<long>, hashes array<long>, places array<int>"
    regions = slim.mapInArrow(lean(_regions(sent, masks)), shape).withColumn("region", F.xxhash64("id", "start", "words"))
    regions = written(regions, "regions")
    hits = regions.select("region", F.explode(F.arrays_zip("hashes", "places")).alias("z")).select("region", F.col("z.hashes").alias("hash"), F.col("z.places").alias("place"))
    shifts = hits.join(tests, "hash").select("region", "item", (F.col("place") - F.col("item_at")).alias("shift")).distinct()
    tried = shifts.groupBy("region", "item").agg(F.collect_list("shift").alias("shifts"))  # a region's words bound these
    words = items.mapInArrow(_item_words, f"item {item_kind}, item_words array<long>")
    both = tried.join(regions.select("region", "id", "start", "words").dropDuplicates(["region", "id"]), "region").join(words, "item")
    found = both.select("id", "item", "words", "item_words", "shifts", "start").mapInArrow(lean(_verify), f"id {kind}, item {item_kind}, first_word long, n_words long, n_equal long")
    best = F.max(F.struct("n_equal", "n_words", (-F.col("first_word")).alias("before"))).alias("best")
    return found.groupBy("id", "item").agg(best).select(F.col("id").alias(id_col), F.col("item").alias(item_col), (-F.col("best.before")).alias("first_word"), "best.n_words", "best.n_equal")
