"""Operator 4: document fingerprints from prefix polynomial hashes.

prefix(text) keeps sums of code point times power of a base, modulo 2**31 - 1, for two bases. Their differences answer
whether any two spans are equal, and binary search over them finds longest common extensions. The hash of every span of
GRAM code points comes from the same arrays, in every text alike: a text counts as having GRAM - 1 points beyond Unicode before and after it,
so a short text has spans too and no length is a border. The KEEP smallest distinct ones, with the hash and length of the whole
text, are the fingerprint. The likeness of two fingerprints is the Dice coefficient of the spans, estimated from the
KEEP smallest of both; equal fingerprints have likeness 1.

compare_with_next() deals documents in ranges of their order and goes through each range once, holding two texts at a time;
where ranges meet, their first and last texts are joined by a table of two rows a range.

Cases: a null text is empty; an empty text has a fingerprint without spans, and its likeness to any other text is 0; a
very long text is one row; rows are ordered by id (null first), then by a hash of the text, then the text, so repeated
rows have a defined next; a single row is its own next; an empty table gives an empty result; only the id and text
columns are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship, task_count, written
from .common import mixed, pieces

P = np.uint64(2**31 - 1)
BASES = (1_000_003, 1_987_654_321 % (2**31 - 1))
GRAM, KEEP = 12, 40
_POWER: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo P for i < n, by doubling."""
    have = _POWER.get(base)
    if have is None or len(have[0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        out = []
        for b in (base, pow(base, -1, int(P))):
            table = np.ones(size, np.uint64)
            done = 1
            while done < size:
                table[done : 2 * done] = table[:done] * np.uint64(pow(b, done, int(P))) % P
                done *= 2
            out.append(table)
        have = _POWER[base] = tuple(out)
    return have


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64)


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo P, for x below 2**62 or so: the modulus is one less than a power of two, so digits add up."""
    x = (x & P) + (x >> np.uint64(31))
    x = (x & P) + (x >> np.uint64(31))
    return np.where(x >= P, x - P, x)


def prefix(points: np.ndarray) -> list[np.ndarray]:
    """For each base the sums over points[:i], i from 0 to the length."""
    out = []
    for base in BASES:
        up = _powers(base, len(points) + 1)[0]
        s = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(_reduced((points + np.uint64(1)) * up[: len(points)]), out=s[1:])
        out.append(_reduced(s))
    return out


def spliced(left: list[np.ndarray], m: int, right: list[np.ndarray], k: int) -> list[np.ndarray]:
    """The arrays of the first m points of left followed by the first k of right."""
    return [np.concatenate([a[: m + 1], _reduced(a[m] + _powers(base, m + 1)[0][m] * b[1 : k + 1])]) for base, a, b in zip(BASES, left, right)]


def span_hashes(arrays: list[np.ndarray], starts: np.ndarray, size: int) -> np.ndarray:
    """The first base's hashes of the spans of a size that begin at starts."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    s, lo, n = arrays[0], int(starts[0]), len(starts)
    down = _powers(BASES[0], lo + n)[1][lo : lo + n]
    return _reduced(_reduced(s[lo + size : lo + size + n] + P - s[lo : lo + n]) * down)


def span_equal(a: list[np.ndarray], i: int, b: list[np.ndarray], j: int, size: int) -> bool:
    """Whether a[i:i+size] equals b[j:j+size], by both bases."""
    p = int(P)
    for base, x, y in zip(BASES, a, b):
        up = _powers(base, max(i, j) + 1)[0]
        left, right = int(x[i + size]) - int(x[i]), int(y[j + size]) - int(y[j])
        if (left * int(up[j]) - right * int(up[i])) % p:
            return False
    return True


def common_extension(a: list[np.ndarray], i: int, b: list[np.ndarray], j: int) -> int:
    """The length of the longest common span that begins at i in a and at j in b, by binary search."""
    low, high = 0, min(len(a[0]) - 1 - i, len(b[0]) - 1 - j)
    while low < high:
        mid = (low + high + 1) // 2
        if span_equal(a, i, b, j, mid):
            low = mid
        else:
            high = mid - 1
    return low


EDGE = np.full(GRAM - 1, 0x110000, np.uint64)


def padded(sums: np.ndarray) -> np.ndarray:
    """The first base's array of the text between two EDGEs, from the text's own."""
    n, m, up = len(sums) - 1, len(EDGE), _powers(BASES[0], len(sums) + 2 * len(EDGE))[0]
    edge = np.zeros(m + 1, np.uint64)
    np.cumsum((EDGE + np.uint64(1)) * up[:m] % P, out=edge[1:])
    edge = _reduced(edge)
    inner = _reduced(edge[m] + up[m] * sums)
    return np.concatenate([edge[:m], inner, _reduced(inner[n] + up[m + n] * edge[1:])])


def grams(arrays: list[np.ndarray], begin: int = 0) -> np.ndarray:
    """32-bit hashes of the text's spans from the begin-th on; an empty text has none."""
    n = len(arrays[0]) - 1
    starts = np.arange(begin, n + len(EDGE)) if n else np.zeros(0, np.int64)
    return (mixed(span_hashes([padded(arrays[0])], starts, GRAM) * np.uint64(64) + np.uint64(GRAM)) >> np.uint64(32)).astype(np.uint32)


def least(h: np.ndarray) -> np.ndarray:
    """The KEEP smallest distinct values, sorted."""
    some = np.unique(np.partition(h, 4 * KEEP)[: 4 * KEEP]) if len(h) > 8 * KEEP else np.unique(h)
    return some[:KEEP] if len(some) >= KEEP or len(h) <= 8 * KEEP else np.unique(h)[:KEEP]


def written_out(arrays: list[np.ndarray], sketch: np.ndarray) -> str:
    n = len(arrays[0]) - 1
    return f"{n:x}-{int(arrays[0][-1]):08x}{int(arrays[1][-1]):08x}-" + sketch.astype(">u4").tobytes().hex()


def fingerprint(text: str) -> str:
    arrays = prefix(codes(text))
    return written_out(arrays, least(grams(arrays)))


def likeness(a: str, b: str) -> float:
    """Of two fingerprints, 0 to 1."""
    if a == b:
        return 1.0
    x, y = (np.frombuffer(bytes.fromhex(s.rpartition("-")[2]), ">u4") for s in (a, b))
    return _alike(x, y)


def _alike(x: np.ndarray, y: np.ndarray) -> float:
    if not len(x) or not len(y):
        return 0.0
    one, other = set(x.tolist()), set(y.tolist())
    both = sorted(one | other)[:KEEP]
    j = sum(h in one and h in other for h in both) / len(both)
    return 2 * j / (1 + j)


class Text:
    def __init__(self, key, text: str):
        self.key, self.text = key, text
        self.arrays = prefix(codes(text))
        self.grams = grams(self.arrays)
        self.sketch = least(self.grams)
        self.print = written_out(self.arrays, self.sketch)


def compared(a: Text, b: Text) -> tuple:
    """What the edited text of a, with b next, gives."""
    n = len(a.text)
    k = n // 4
    head = b.text[:k]
    edited = a.text[: n - k] + head
    if edited == a.text:
        return edited_row(a, edited, a.print, 1.0, n, b)
    arrays = spliced(a.arrays, n - k, b.arrays, len(head))
    whole = n - k if edited else 0  # so many spans don't reach beyond what both have
    sketch = least(np.concatenate([a.grams[:whole], grams(arrays, whole)]))
    return edited_row(a, edited, written_out(arrays, sketch), _alike(a.sketch, sketch), common_extension(a.arrays, 0, arrays, 0), b)


def edited_row(a: Text, edited: str, mark: str, near: float, common: int, b: Text) -> tuple:
    return (a.key, len(a.text), hashlib.sha256(edited.encode()).hexdigest(), a.print, mark, near, 1.0 if a.print == b.print else _alike(a.sketch, b.sketch), common)


COLUMNS = ("id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "common_prefix")
TYPES = (None, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64())


def _batch(rows: list[tuple], key_type: pa.DataType) -> pa.RecordBatch:
    """rows: the columns, then part, role and text."""
    kinds = (key_type, *TYPES[1:], pa.int32(), pa.int32(), pa.string())
    columns = list(zip(*rows)) if rows else [()] * len(kinds)
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], [*COLUMNS, "part", "role", "text"])


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: COLUMNS, the id under its own name."""
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    shape = f"id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_prefix long"
    slim = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    ranged = slim.repartitionByRange(max(1, task_count(spark)), "id", "tie").sortWithinPartitions("id", "tie", "text").select("id", "text")
    blank = (None,) * 7

    def walk(batches):
        from pyspark import TaskContext

        part, last, key_type, rows = TaskContext.get().partitionId(), None, None, []
        for batch in batches:
            key_type = batch.schema.field(0).type
            for piece in pieces(batch, "text"):
                for key, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
                    now = Text(key, text)
                    rows.append((key, *blank, part, 2, text) if last is None else (*compared(last, now), part, 0, None))
                    last = now
                yield _batch(rows, key_type)
                rows = []
        if last is not None:
            yield _batch([(last.key, *blank, part, 1, last.text)], key_type)

    seen = written(ranged.mapInArrow(walk, shape + ", part int, role int, text string"), "prints")
    parts = sorted(r["part"] for r in seen.where("role = 2").select("part").collect())  # the ranges that have rows
    after = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "part int, next_part int")
    first = seen.where("role = 2").select(F.col("part").alias("next_part"), F.col("text").alias("next_text"))
    ends = seen.where("role = 1").select("id", "text", "part").join(after, "part").join(first, "next_part").select("id", "text", "next_text")

    def finish(batches):
        for batch in batches:
            rows = [(*compared(Text(k, a), Text(None, b)), 0, 0, None) for k, a, b in zip(*(c.to_pylist() for c in batch.columns))]
            yield _batch(rows, batch.schema.field(0).type).select(list(COLUMNS))

    whole = seen.where("role = 0").select(*COLUMNS).union(ends.mapInArrow(finish, shape))
    return whole.withColumnRenamed("id", id_col)
