"""Operator 3: a quality classifier, a factorisation machine.

Features of a text are its hashed words (log counts, scaled to length 1), statistics of its structure, and its length as
metadata. A pair of features interacts through a product of low-rank factors; all pairs together are scored in linear
time by the identity sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2].

It is trained in numpy on the driver from a bounded sample of labelled rows (`most`); scoring runs in Arrow batches.

Cases: null and empty texts are scored by their statistics alone; very long texts are scored whole; equal texts have equal
scores; an empty table gives an empty result; only the id and text columns are read. Without labelled rows of
both classes every score is 0.5.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import MARKS, crc_part, hashed_words, lean, pieces, strings
from .labelled import sample

BUCKETS, RANK = 1 << 15, 8
_KIND = np.full(256, 9, np.uint8)  # other punctuation
for _k, _s in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n", b".,;:", b"!?", b"|", b"%*#&$@~^<>{}")):
    _KIND[list(_s)] = _k
_KIND[128:] = 10
KINDS, STATS = 11, 17


def features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets and values, where each text's begin, and the texts' statistics (rows)."""
    words, at = hashed_words(raw, offsets, MARKS)
    n = len(offsets) - 1
    count = np.diff(at)
    doc = np.repeat(np.arange(n), count)
    key, tf = np.unique(doc * BUCKETS + (words % np.uint64(BUCKETS)).astype(np.int64), return_counts=True)
    owner, bucket = key // BUCKETS, (key % BUCKETS).astype(np.int64)
    value = np.log1p(tf)
    norm = np.sqrt(np.bincount(owner, value * value, n))
    value = value / np.maximum(norm, 1e-9)[owner]
    begin = np.searchsorted(owner, np.arange(n + 1))
    stats = np.zeros((n, STATS))
    for i in range(n):
        lo, hi = offsets[i], offsets[i + 1]
        if hi > lo:
            stats[i, :KINDS] = np.bincount(_KIND[raw[lo:hi]], minlength=KINDS) / (hi - lo)
    size, some = np.diff(offsets), np.maximum(count, 1)
    stats[:, 11] = np.log1p(size)
    stats[:, 12] = np.log1p(size / some)
    stats[:, 13] = np.diff(begin) / some  # types per token
    stats[:, 14] = np.log1p(count)
    if len(tf):
        top = np.zeros(n)
        np.maximum.at(top, owner, tf)
        stats[:, 15] = top / some
    after = np.zeros(n)
    same = words[1:] == words[:-1]
    np.add.at(after, doc[1:][same & (doc[1:] == doc[:-1])], 1)
    stats[:, 16] = after / some  # words that repeat the one before
    return bucket, value, begin, stats


class Machine:
    """Weights of a trained machine. Features are the buckets, then the statistics, standardised."""

    def __init__(self, bias, weights, factors, mean, scale):
        self.bias, self.weights, self.factors, self.mean, self.scale = bias, weights, factors, mean, scale

    def inputs(self, bucket, value, begin, stats):
        """The texts' features as one list: indices, values and where each text's begin."""
        n, s = len(begin) - 1, stats.shape[1]
        z = np.clip((stats - self.mean) / self.scale, -4, 4) / np.sqrt(s)
        sizes = np.diff(begin)
        start = begin[:-1] + np.arange(n) * s
        index, x = np.empty(len(bucket) + n * s, np.int64), np.empty(len(bucket) + n * s)
        own = np.arange(len(bucket)) + np.repeat(np.arange(n) * s, sizes)
        index[own], x[own] = bucket, value
        rest = (start + sizes)[:, None] + np.arange(s)
        index[rest], x[rest] = BUCKETS + np.arange(s), z
        return index, x, start

    def margin(self, index, x, start):
        v = self.factors[index] * x[:, None]
        total = np.add.reduceat(v, start, axis=0)
        squares = np.add.reduceat((v * v).sum(1), start)
        return self.bias + np.add.reduceat(self.weights[index] * x, start) + 0.5 * ((total * total).sum(1) - squares), v, total

    def score(self, raw, offsets) -> np.ndarray:
        if len(offsets) < 2:
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.margin(*self.inputs(*features(raw, offsets)))[0], -30, 30)))


def train(rows: pd.DataFrame, epochs: int = 12, rate: float = 0.1, decay: float = 1e-4, seed: int = 7) -> Machine | None:
    """Adagrad on class-balanced logistic loss. rows: label, bucket, value, stats."""
    y = rows["label"].to_numpy(float)
    if not len(y) or y.min() == y.max():
        return None
    rng = np.random.default_rng(seed)
    stats = np.array(rows["stats"].tolist())
    m = Machine(0.0, np.zeros(BUCKETS + STATS), rng.normal(0, 0.05, (BUCKETS + STATS, RANK)), stats.mean(0), stats.std(0) + 1e-6)
    sum_w, sum_v, sum_b = np.full(len(m.weights), 1e-6), np.full(m.factors.shape, 1e-6), 1e-6
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for lo in range(0, len(y), 64):
            take = order[lo : lo + 64]
            sizes = [len(rows["bucket"].iat[i]) for i in take]
            index, x, start = m.inputs(np.concatenate([rows["bucket"].iat[i] for i in take]).astype(np.int64), np.concatenate([rows["value"].iat[i] for i in take]), np.concatenate([[0], np.cumsum(sizes)]), stats[take])
            margin, v, total = m.margin(index, x, start)
            g = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y[take]) * weight[take] / len(take)
            doc = np.repeat(np.arange(len(take)), np.diff(np.append(start, len(index))))
            gx = (g[doc] * x)[:, None]
            kinds, place = np.unique(index, return_inverse=True)
            dw, dv = np.zeros(len(kinds)), np.zeros((len(kinds), RANK))
            np.add.at(dw, place, gx[:, 0])
            np.add.at(dv, place, gx * (total[doc] - v))
            dw += decay * m.weights[kinds]
            dv += decay * m.factors[kinds]
            sum_w[kinds] += dw * dw
            sum_v[kinds] += dv * dv
            sum_b += g.sum() ** 2
            m.weights[kinds] -= rate * dw / np.sqrt(sum_w[kinds])
            m.factors[kinds] -= rate * dv / np.sqrt(sum_v[kinds])
            m.bias -= rate * g.sum() / np.sqrt(sum_b)
    return m


def _extract(batches):
    for batch in batches:
        for part in pieces(batch, "text"):
            bucket, value, begin, stats = features(*strings(part.column(2)))
            ends = pa.array(begin, pa.int32())
            yield pa.record_batch(
                [part.column(1), pa.ListArray.from_arrays(ends, pa.array(bucket, pa.int32())), pa.ListArray.from_arrays(ends, pa.array(value)), pa.array(list(stats), pa.list_(pa.float64()))],
                ["label", "bucket", "value", "stats"],
            )


def fit_quality(docs: DataFrame, labels: DataFrame, target: str = "quality", id_col: str = "doc_id", text_col: str = "text", most: int = 3000) -> Machine | None:
    ship(docs.sparkSession)
    rows = sample(docs, labels, target, id_col, text_col, most).select("id", F.col("label").cast("int").alias("label"), "text")
    found = rows.mapInArrow(lean(_extract), "label int, bucket array<int>, value array<double>, stats array<double>").toPandas()
    order = found["value"].map(lambda v: float(np.sum(v)) if len(v) else 0.0).argsort(kind="stable") if len(found) else []
    return train(found.iloc[order].reset_index(drop=True)) if len(found) else None


def score_quality(docs: DataFrame, machine: Machine | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: the id, held_out, score and predicted."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(machine)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                score = sent.value.score(*strings(part.column(1))) if sent.value else np.full(part.num_rows, 0.5)
                yield pa.record_batch([part.column(0), pa.array(score)], ["id", "score"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(lean(run), f"id {kind}, score double")
    return out.select(F.col("id").alias(id_col), F.coalesce(crc_part(F.col("id")) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
