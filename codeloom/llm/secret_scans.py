"""Operator 9: secret scans with a randomness test battery.

Base kinds are found by their patterns. The method adds spans: runs of 20 or more token characters outside base spans get an
inferred encoding and three tests of the hypothesis that they are uniform in its alphabet (chi-squared over the alphabet,
runs about the median symbol, serial correlation at lag 1), combined by Fisher's method to one p-value. They are also tested against the
hypothesis of ordinary text, in which neighbouring characters mostly keep their class: one over the likelihood ratio is a
p-value by Markov's inequality. Both p-values depend on length, so discoveries are controlled within length bands, in two steps, each a
Benjamini-Hochberg threshold from counts over all documents by band and bin: first the runs that the battery finds not uniform, of
which at most the part LOST may be random, are set aside; then, among all runs of the band, the
others that aren't ordinary text are taken, of which at most the part `rate` may be.

Cases: a null or empty text has no spans; very long texts are scanned whole; equal rows each give a row; an empty table gives an
empty result; only the id and text columns are read. Overlaps: base kinds may overlap one another; added spans never
overlap base ones.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship, written
from .common import lean, pieces, strings

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS, HEX = re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")
KINDS = ("assign", "access", "hex", "random")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
RUN, SHORTEST = re.compile("[A-Za-z0-9+/_=-]{20,}"), 20
BANDS = (20, 28, 40, 64)
BIN, BINS = 0.25, 200
#: Ordinary text: a character keeps its neighbour's class with STAY. Of the runs that count as not uniform, the part that may be random.
STAY, LOST = 0.93, 1e-3
CLASS = {c: k for k, s in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "+/_=-")) for c in s}
CLASS_SIZE = (26, 26, 10, 5)
ALPHABETS = ("0123456789", "0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789abcdefghijklmnopqrstuvwxyz", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_")


def base_spans(text: str, runs: bool = True) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds, sorted. runs False: no run of 20 token characters is in the text."""
    low = text.lower()
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6] if any(k in low for k in KEYWORDS) else []
    if runs:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
        out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    return sorted(out)


def alphabet_of(run: str) -> str:
    body = set(run.rstrip("="))
    return next((a for a in ALPHABETS if body <= set(a)), "".join(sorted(body)))


def _normal_tail(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def battery(run: str) -> float:
    """Fisher's combined p-value of the three tests that the run is uniform in its inferred alphabet."""
    alphabet = alphabet_of(run)
    x = np.array([alphabet.index(c) for c in run.rstrip("=")], float)
    n, k = len(x), len(alphabet)
    if n < 8 or k < 2 or np.all(x == x[0]):
        return 0.0
    chi = float((np.bincount(x.astype(int), minlength=k) ** 2).sum() * k / n - n)
    d = k - 1
    z = ((max(chi, 1e-9) / d) ** (1 / 3) - (1 - 2 / (9 * d))) / math.sqrt(2 / (9 * d))  # Wilson and Hilferty
    p_chi = 0.5 * math.erfc(z / math.sqrt(2))
    high = x > np.median(x)
    a, b = int(high.sum()), int((~high).sum())
    if a and b:
        mean = 1 + 2 * a * b / n
        var = max(1e-9, (mean - 1) * (mean - 2) / (n - 1))
        p_runs = _normal_tail((1 + int((high[1:] != high[:-1]).sum()) - mean) / math.sqrt(var))
    else:
        p_runs = 1.0
    c = x - x.mean()
    p_serial = _normal_tail(float((c[1:] * c[:-1]).sum() / (c * c).sum()) * math.sqrt(n))
    half = -sum(math.log(max(p, 1e-300)) for p in (p_chi, p_runs, p_serial))
    return math.exp(-half) * (1 + half + half * half / 2)


def surprise(run: str) -> float:
    """-log10 of the p-value that ordinary text holds such a run."""
    k = len(alphabet_of(run))
    total, last = 0.0, None
    for c in run.rstrip("="):
        now = CLASS[c]
        keep = 0.25 if last is None else STAY if now == last else (1 - STAY) / 3
        total += -math.log10(k) - math.log10(keep / CLASS_SIZE[now])
        last = now
    return max(0.0, total)


def band_of(n: int) -> int:
    return sum(n >= b for b in BANDS) - 1


def _bin(p10: float) -> int:
    return 0 if p10 < BIN else min(BINS - 1, int(p10 / BIN))


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """(start, end, band, bin, fit) of runs outside base spans: bins of the p-values against ordinary text and against uniformity."""
    out = []
    for m in RUN.finditer(text):
        if any(s < m.end() and m.start() < e for s, _, e in base):
            continue
        out.append((m.start(), m.end(), band_of(m.end() - m.start()), _bin(surprise(m[0])), _bin(-math.log10(max(battery(m[0]), 1e-300)))))
    return out


TOKEN = np.isin(np.arange(256), [*range(48, 58), *range(65, 91), *range(97, 123), *b"+/_=-"])


def _with_runs(column) -> np.ndarray:
    """For each text, whether it has a run of 20 token characters."""
    raw, offsets = strings(column)
    edge = np.flatnonzero(np.diff(np.concatenate([[False], TOKEN[raw], [False]]).astype(np.int8)))
    long = edge[1::2] - edge[::2] >= SHORTEST  # runs may reach over the border of two texts; then both are searched
    out = np.zeros(len(offsets) - 1, bool)
    for a, b in zip(edge[::2][long], edge[1::2][long]):
        out[max(0, np.searchsorted(offsets, a, side="right") - 1) : np.searchsorted(offsets, b, side="left")] = True
    return out


def _scan(batches):
    for batch in batches:
        for part in pieces(batch, "text"):
            bases, tries = [], []
            for text, runs in zip(part.column(1).to_pylist(), _with_runs(part.column(1))):
                base = base_spans(text or "", bool(runs))
                bases.append([{"start": s, "kind": k, "end": e} for s, k, e in base])
                tries.append([{"start": s, "end": e, "band": b, "bin": p, "fit": f} for s, e, b, p, f in (candidates(text or "", base) if runs else [])])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
            other = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("band", pa.int32()), ("bin", pa.int32()), ("fit", pa.int32())]))
            yield pa.record_batch([part.column(0), part.column(2), pa.array(bases, kind), pa.array(tries, other)], ["id", "text_hash", "base", "tries"])


def thresholds(counts: dict[tuple[int, int], int], rate: float = 0.01) -> list[int]:
    """For each band the least bin that Benjamini and Hochberg's rule accepts; BINS where none is."""
    out = []
    for band in range(len(BANDS)):
        m, least, more = sum(n for (b, _), n in counts.items() if b == band), BINS, 0
        for p in range(BINS - 1, 0, -1):
            more += counts.get((band, p), 0)
            if more and 10 ** (-p * BIN) <= rate * more / m:
                least = p
        out.append(least)
    return out


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = 0.01) -> DataFrame:
    """One row per row of docs: the id, text_hash (xxhash64), base and spans: arrays of (start, kind, end), kind an index
    into KINDS, sorted; base has the base kinds only."""
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("text_hash"))
    shape = f"id {kind}, text_hash long, base array<struct<start:int,kind:int,end:int>>, tries array<struct<start:int,end:int,band:int,bin:int,fit:int>>"
    seen = written(slim.mapInArrow(lean(_scan), shape), "secrets")
    counted = seen.select(F.explode("tries").alias("t")).groupBy("t.band", "t.bin", "t.fit").count().collect()  # at most bands x bins x bins rows
    fit: Counter = Counter()
    for r in counted:
        fit[r["band"], r["fit"]] += r["count"]
    most = thresholds(fit, LOST)
    plain: Counter = Counter()  # what isn't uniform counts as ordinary text
    for r in counted:
        plain[r["band"], r["bin"] if r["fit"] < most[r["band"]] else 0] += r["count"]
    least = thresholds(plain, rate)
    of_band = lambda t, values: F.element_at(F.array(*map(F.lit, values)), t["band"] + 1)
    taken = F.filter("tries", lambda t: (t["bin"] >= of_band(t, least)) & (t["fit"] < of_band(t, most)))
    added = F.transform(taken, lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("kind"), t["end"].alias("end")))
    return seen.select(F.col("id").alias(id_col), "text_hash", "base", F.array_sort(F.concat("base", added)).alias("spans"))


def joined(spans):
    """kind:start:end of each span, comma-joined."""
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
