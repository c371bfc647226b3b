"""Operator 6: toxicity, a convolutional text classifier in numpy.

A word's embedding is the sum of the hashed embeddings of the word and of its first 4 to 7 bytes. Filters of widths 1, 2
and 3 slide over the words; the largest responses of each filter (a short k-max pooling) feed a logistic output. Hashes
that training found uninformative share a zero embedding, so only windows with an informative word are computed; all
others respond alike. Scores are calibrated by language: a threshold is chosen for each on rows kept out of the training,
and mapped to 0.7. The language is inferred from the text's function words, since the language column is no input.

It is trained on the driver from a bounded sample of labelled rows (`most`); scoring runs in Arrow batches.

Cases: null and empty texts have the score of a text without informative words; very long texts are scored whole; equal texts
have equal scores; an empty table gives an empty result; only the id and text columns are read. Without labelled rows of
both classes every score is 0.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship, written
from .common import MARKS, crc_part, hashed_words, lean, mixed, pieces, strings
from .labelled import sample

PREFIXES = (4, 5, 6, 7)
FIELDS, DIM, FILTERS, WIDTHS, TOP = 1 + len(PREFIXES), 8, 6, (1, 2, 3), 3
SLOTS, MOST_ROWS, LEAST_TEXTS = 1 << 20, 6000, 5
LANGUAGES = ("en", "fr", "de", "es")
#: Frequent function words by language.
FUNCTION_WORDS = (
    "the of and to in is it that was for on are with as be this by",
    "le la les et des du un une est dans pour pas que qui sur au",
    "der die das und ist nicht ein eine mit den von zu im auf für sich",
    "el los las del y en es por con para una al lo como no",
)


def lowered(column) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return strings(pc.utf8_lower(column))


def word_fields(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each word and its prefixes (columns), and where each text's words begin."""
    words, at = hashed_words(raw, offsets, MARKS)
    out = np.empty((len(words), FIELDS), np.uint64)
    out[:, 0] = words
    if len(words):
        inside = ~MARKS[raw]
        edge = np.zeros(len(raw) + 1, bool)
        edge[offsets] = True
        first = inside.copy()
        first[1:] &= ~inside[:-1] | edge[1 : len(raw)]
        starts = np.flatnonzero(first)
        last = inside.copy()
        last[:-1] &= ~inside[1:] | edge[1 : len(raw)]
        size = np.flatnonzero(last) + 1 - starts
        padded = np.concatenate([raw, np.zeros(8, np.uint8)])
        eight = np.zeros(len(starts), np.uint64)
        for k in range(8):
            eight |= np.where(k < size, padded[starts + k], 0).astype(np.uint64) << np.uint64(8 * k)
        for f, k in enumerate(PREFIXES, 1):
            out[:, f] = mixed((eight & np.uint64((1 << 8 * k) - 1)) + np.uint64(f << 60))
    return out, at


_STOP = {}


def languages(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The language whose function words are most of each text's words; English where none is found."""
    if not _STOP:
        hashes, owner = [], []
        for k, line in enumerate(FUNCTION_WORDS):
            raw = np.frombuffer(line.encode(), np.uint8)
            found = hashed_words(raw, np.array([0, len(raw)]), MARKS)[0]
            hashes.append(found)
            owner.append(np.full(len(found), k))
        h, o = np.concatenate(hashes), np.concatenate(owner)
        slot = np.zeros(1 << 16, np.int16)
        slot[(h % np.uint64(1 << 16)).astype(np.int64)] = np.arange(1, len(h) + 1)
        _STOP["all"] = (slot, np.concatenate([np.zeros(1, np.uint64), h]), np.concatenate([[0], o]))
    slot, h, o = _STOP["all"]
    row = slot[(words % np.uint64(1 << 16)).astype(np.int64)]
    hit = np.flatnonzero((row > 0) & (h[row] == words))
    doc = np.searchsorted(at, hit, side="right") - 1
    counts = np.bincount(doc * 4 + o[row[hit]], minlength=4 * (len(at) - 1)).reshape(-1, 4)
    return counts.argmax(1)


class Network:
    def __init__(self, keys: np.ndarray, seed: int = 11):
        """keys: the hashes that have an embedding; row 0 is all others'."""
        rng = np.random.default_rng(seed)
        self.keys = np.concatenate([np.zeros(1, np.uint64), keys])
        self.slot = np.zeros(SLOTS, np.int32)
        self.slot[(keys % np.uint64(SLOTS)).astype(np.int64)] = np.arange(1, len(self.keys))
        at = self.slot[(keys % np.uint64(SLOTS)).astype(np.int64)]
        self.pushed = np.flatnonzero(at != np.arange(1, len(self.keys))) + 1  # rows whose slot a later key has
        self.pushed = self.pushed[np.argsort(self.keys[self.pushed])]
        self.p = {"E": rng.normal(0, 0.1, (len(self.keys), DIM)), "out": np.full(len(WIDTHS) * FILTERS * TOP, 0.3), "bias": np.array([-2.0])}
        for w in WIDTHS:
            self.p[f"W{w}"] = rng.normal(0, 0.3, (w, DIM, FILTERS))
            self.p[f"b{w}"] = np.zeros(FILTERS)
        self.p["E"][0] = 0
        self.cut = np.zeros(len(LANGUAGES))

    def rows(self, fields: np.ndarray) -> np.ndarray:
        row = self.slot[(fields % np.uint64(SLOTS)).astype(np.int64)]
        out = np.where(self.keys[row] == fields, row, 0)
        if len(self.pushed):
            other = (row > 0) & (out == 0)
            found = self.pushed[np.minimum(np.searchsorted(self.keys[self.pushed], fields[other]), len(self.pushed) - 1)]
            out[other] = np.where(self.keys[found] == fields[other], found, 0)
        return out

    def windows(self, row: np.ndarray, w: int) -> np.ndarray:
        """(windows, w, FIELDS) rows of all windows of one text with an informative word, then an empty one."""
        live = np.flatnonzero(row.any(1))
        at = np.unique((live[:, None] - np.arange(w)).ravel())
        padded = np.concatenate([np.zeros((w, FIELDS), row.dtype), row, np.zeros((w, FIELDS), row.dtype)])
        out = padded[(at[:, None] + w) + np.arange(w)]
        return np.concatenate([out, np.zeros((1, w, FIELDS), row.dtype)])

    def pooled(self, windows: dict[int, np.ndarray]):
        parts, kept = [], {}
        for w in WIDTHS:
            x = self.p["E"][windows[w]].sum(2)
            z = np.maximum(np.einsum("nwd,wdf->nf", x, self.p[f"W{w}"]) + self.p[f"b{w}"], 0)
            k = min(TOP, len(z))
            best = np.argsort(-z, axis=0, kind="stable")[:k]
            top = np.take_along_axis(z, best, 0)
            if k < TOP:  # short texts: the empty window's response again
                top = np.concatenate([top, np.repeat(z[-1:], TOP - k, 0)])
            parts.append(top.ravel())
            kept[w] = (x, z, best)
        return np.concatenate(parts), kept

    def margin(self, windows) -> float:
        return float(self.pooled(windows)[0] @ self.p["out"] + self.p["bias"][0])

    def margins(self, fields: np.ndarray, at: np.ndarray) -> np.ndarray:
        row = self.rows(fields)
        live = np.concatenate([[0], np.cumsum(row.any(1))])
        out = np.empty(len(at) - 1)
        empty = None
        for i in range(len(at) - 1):
            if live[at[i]] == live[at[i + 1]]:
                if empty is None:
                    empty = self.margin({w: np.zeros((1, w, FIELDS), np.int32) for w in WIDTHS})
                out[i] = empty
            else:
                out[i] = self.margin({w: self.windows(row[at[i] : at[i + 1]], w) for w in WIDTHS})
        return out

    def score(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        fields, at = word_fields(raw, offsets)
        shifted = self.margins(fields, at) - self.cut[languages(fields[:, 0], at)] + np.log(0.7 / 0.3)
        return 1 / (1 + np.exp(-np.clip(shifted, -30, 30)))


def train(net: Network, rows: pd.DataFrame, epochs: int = 10, rate: float = 0.02, seed: int = 5) -> Network | None:
    """rows: label, aside (sets the thresholds), lang, and w1, w2, w3: each text's windows, flattened."""
    y, aside, lang = rows["label"].to_numpy(int), rows["aside"].to_numpy(bool), rows["lang"].to_numpy(int)
    if not (~aside).any() or y[~aside].min() == y[~aside].max():
        return None
    data = [{w: np.asarray(x, np.int32).reshape(-1, w, FIELDS) for w, x in zip(WIDTHS, windows)} for windows in zip(*(rows[f"w{w}"] for w in WIDTHS))]
    rng = np.random.default_rng(seed)
    for w in WIDTHS:
        net.p[f"W{w}"][:, 0, :] = np.abs(net.p[f"W{w}"][:, 0, :]) + 0.3
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    weight = np.where(y == 1, 0.5 / max(1e-9, y.mean()), 0.5 / max(1e-9, 1 - y.mean()))
    mine, step = np.flatnonzero(~aside), 0
    for _ in range(epochs):
        order = rng.permutation(mine)
        for lo in range(0, len(order), 32):
            grad = {k: np.zeros_like(v) for k, v in net.p.items()}
            take = order[lo : lo + 32]
            for i in take:
                h, kept = net.pooled(data[i])
                g = (1 / (1 + np.exp(-np.clip(h @ net.p["out"] + net.p["bias"][0], -30, 30))) - y[i]) * weight[i] / len(take)
                grad["out"] += g * h
                grad["bias"] += g
                back = (g * net.p["out"]).reshape(len(WIDTHS), TOP, FILTERS)
                for a, w in enumerate(WIDTHS):
                    x, z, best = kept[w]
                    for t in range(len(best)):
                        d = back[a, t] * (z[best[t], np.arange(FILTERS)] > 0)
                        xs = x[best[t]]  # (filters, w, dim)
                        grad[f"b{w}"] += d
                        grad[f"W{w}"] += np.einsum("f,fwd->wdf", d, xs)
                        dx = np.einsum("f,wdf->fwd", d, net.p[f"W{w}"])
                        np.add.at(grad["E"], data[i][w][best[t]].reshape(FILTERS * w, FIELDS), np.repeat(dx.reshape(FILTERS * w, 1, DIM), FIELDS, 1))
            grad["E"][0] = 0
            step += 1
            for k, v in net.p.items():
                a, b = moment[k]
                a += 0.1 * (grad[k] - a)
                b += 0.001 * (grad[k] ** 2 - b)
                v -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    margin = np.array([net.margin(d) for d in data])
    net.cut[:] = _threshold(margin[aside], y[aside], 0.0)
    for k in range(len(LANGUAGES)):
        some = aside & (lang == k)
        if y[some].sum() >= 10 and (1 - y[some]).sum() >= 10:
            net.cut[k] = _threshold(margin[some], y[some], net.cut[k])
    return net


def _threshold(margin: np.ndarray, y: np.ndarray, default: float) -> float:
    """The middle of the gap below which lie as many errors as possible less: the threshold of fewest errors."""
    if not len(y) or y.min() == y.max():
        return default
    order = np.argsort(margin)
    m, t = margin[order], y[order]
    errors = np.concatenate([[(1 - t).sum()], (1 - t).sum() + np.cumsum(np.where(t == 1, 1, -1))])
    edges = np.concatenate([[m[0] - 1], (m[1:] + m[:-1]) / 2, [m[-1] + 1]])
    best = np.flatnonzero(errors == errors.min())
    return float(edges[best[len(best) // 2]])


def _hashes(batches):
    """Each text's distinct hashes, with its label."""
    for batch in batches:
        for part in pieces(batch, "text"):
            fields, at = word_fields(*lowered(part.column(1)))
            own = [np.unique(fields[lo:hi]) for lo, hi in zip(at[:-1], at[1:])]
            label = np.repeat(part.column(0).to_numpy(zero_copy_only=False), list(map(len, own)))
            yield pa.record_batch([pa.array(np.concatenate([*own, np.zeros(0, np.uint64)]).view(np.int64)), pa.array(label, pa.int64())], ["h", "label"])


def _windows(sent):
    def run(batches):
        net = sent.value
        for batch in batches:
            for part in pieces(batch, "text"):
                fields, at = word_fields(*lowered(part.column(3)))
                row, lang = net.rows(fields), languages(fields[:, 0], at)
                cut = [[net.windows(row[lo:hi], w).astype(np.int16).ravel() for lo, hi in zip(at[:-1], at[1:])] for w in WIDTHS]
                yield pa.record_batch([*part.columns[:3], pa.array(lang.astype(np.int32)), *(pa.array(c, pa.list_(pa.int16())) for c in cut)], ["place", "label", "aside", "lang", *(f"w{w}" for w in WIDTHS)])

    return run


def fit_toxicity(docs: DataFrame, labels: DataFrame, target: str = "toxic", id_col: str = "doc_id", text_col: str = "text", most: int = 2400) -> Network | None:
    """The driver gets the most informative hashes, MOST_ROWS at most, and the sample's windows that hold them."""
    spark = docs.sparkSession
    ship(spark)
    place = F.xxhash64("id")
    rows = written(sample(docs, labels, target, id_col, text_col, most).select(place.alias("place"), F.col("label").cast("int").alias("label"), (F.pmod(place, F.lit(5)) == 4).alias("aside"), "text"), "sample")
    use = rows.where("not aside")
    sizes = {r["label"]: r["count"] for r in use.groupBy("label").count().collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not n0 or not n1:
        return None
    seen = use.select(F.col("label"), "text").mapInArrow(_hashes, "h long, label long").groupBy("h").agg(F.sum("label").alias("pos"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_TEXTS)
    odds = F.log((F.col("pos") + 0.3) / n1) - F.log((F.col("n") - F.col("pos") + 0.3) / n0)
    top = seen.withColumn("odds", odds).where(F.abs("odds") > 1.2).orderBy(F.desc(F.abs("odds") * F.sqrt("n")), "h").limit(MOST_ROWS).select("h", "odds").collect()
    keys = np.array([r["h"] for r in top], np.int64).view(np.uint64)
    net = Network(keys)
    net.p["E"][1:, 0] = np.clip([r["odds"] for r in top], -3, 3) / 3  # where training starts
    shape = "place long, label int, aside boolean, lang int, " + ", ".join(f"w{w} array<smallint>" for w in WIDTHS)
    found = rows.mapInArrow(_windows(spark.sparkContext.broadcast(net)), shape).toPandas()
    return train(net, found.sort_values(["place", "label"], kind="stable").reset_index(drop=True))


def score_toxicity(docs: DataFrame, network: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: the id, held_out, score and predicted."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(network)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                score = sent.value.score(*lowered(part.column(1))) if sent.value else np.zeros(part.num_rows)
                yield pa.record_batch([part.column(0), pa.array(score)], ["id", "score"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(lean(run), f"id {kind}, score double")
    return out.select(F.col("id").alias(id_col), F.coalesce(crc_part(F.col("id")) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
