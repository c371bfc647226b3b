"""Operator 5: n-gram Jaccard join by prefix filters under several global orders.

A document's set holds the hashes (64 bits) of its distinct word shingles. Equal sets are one class, known by 128 bits of the
set, so copies cost one row each. Two classes link when share * union <= 100 * intersection. For any global order of shingles,
linked sets of size n share a shingle among the first n - ceil(share * n / 100) + 1; so linked sets do so under every order.

1. One pass finds sizes and keys of sets.
2. First order: shingles of a hashed region (REGIONS) come first, the rarer the earlier, then the others by hash. The region's shingles
   are dealt by shingle to be counted; those that two classes share go back to their classes, which keep what falls into their
   prefixes. Classes of one prefix shingle whose sizes can link, directly or through sizes between them, are neighbours; components of that are neighbourhoods.
3. Second order: the same with another hash and a larger region, among the classes of each neighbourhood, whose texts are read once more. Only
   the intersection of both is compared.
4. Third order: inside a cell (a neighbourhood, or two blocks of a large one) pairs of different components must share prefix
   shingles under an order by the cell's own counts, then are compared exactly. Links make components.

A large neighbourhood is cut into blocks. First each block is compared with itself; then what is not in the neighbourhood's
largest component yet is compared with all blocks, so no cell grows with its group, and what is connected already is not compared again.
Links are followed only as far as components need them, so components are exact and links aren't counted.

Cases: a null or empty text, or one of blanks only, has the empty set, links with nothing and is its own component; with fewer
words than a shingle, the whole sequence is one shingle; equal rows have equal results; rows of one id with different texts
are judged each by its text; a null id has a component like others, the least id that isn't null, else null; very long
texts are whole; an empty table gives an empty result; only the id and text columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import discard, ship, task_count, written
from .common import BLANKS, hashed_words, lean, mixed, pieces, strings
from .components import components

#: Of the first two orders: the region's part of all shingles, as a multiple of 1 - share. A multiple of 1 would just hold a prefix.
REGIONS = (5 / 3, 10 / 3)
#: Shingles and classes of a block at most; a cell has two. Counts of a shingle's classes are told apart up to COUNTED.
CELL_SHINGLES, CELL_CLASSES, COUNTED = 1_000_000, 4096, 65_536
#: Rows of two 64-bit numbers that are broadcast at most.
BROADCAST_ROWS = 1_000_000
_SALTS = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3))


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles."""
    words, at = hashed_words(raw, offsets, BLANKS)
    h = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for k in range(size):
        h += words[k : k + len(h)] * _SALTS[k % 8] if k < 8 else mixed(words[k : k + len(h)] + np.uint64(k))
    h = mixed(h)
    out = []
    for lo, hi in zip(at[:-1], at[1:]):
        if hi - lo >= size:
            out.append(np.unique(h[lo : hi - size + 1]))
        elif hi > lo:
            out.append(mixed((words[lo:hi] * _SALTS[: hi - lo] if hi - lo <= 8 else mixed(words[lo:hi] + np.arange(hi - lo, dtype=np.uint64))).sum(keepdims=True) + np.uint64(hi - lo)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_keys(sets: list[np.ndarray]) -> np.ndarray:
    """128 bits of each set, as two numbers; zeros for the empty set alone."""
    n = np.array([len(s) for s in sets], np.int64)
    out, full = np.zeros((len(sets), 2), np.uint64), n > 0
    if full.any():
        flat, starts = np.concatenate(sets), np.concatenate([[0], np.cumsum(n[full])[:-1]])
        a, b = (np.add.reduceat(mixed(flat ^ s), starts) for s in _SALTS[:2])
        b += n[full].astype(np.uint64)
        out[full, 0] = np.maximum(mixed(a * _SALTS[2] + mixed(b)), 1)
        out[full, 1] = mixed(b * _SALTS[4] + mixed(a ^ _SALTS[5]))
    return out


def _binary(keys: np.ndarray) -> pa.Array:
    """Rows of two numbers as 16 bytes each."""
    offsets = np.arange(len(keys) + 1, dtype=np.int32) * 16
    return pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(keys))])


def prefix_size(n, share: int):
    return n - (share * n + 99) // 100 + 1


def first_tokens(sets: list[np.ndarray], order: int, share: int, cells: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes under an order of each (not empty) set's shingles in the region, or of its prefix where that is more; and how many. With cells,
    equal shingles of different cells differ."""
    n = np.array([len(s) for s in sets], np.int64)
    starts = np.concatenate([[0], np.cumsum(n)[:-1]])
    x = mixed(np.concatenate(sets) ^ _SALTS[3 + order])
    if cells is not None:
        x = mixed(x ^ np.repeat(mixed(cells.astype(np.uint64)), n))
    part = REGIONS[order] * (100 - share) / 100
    inside = x < np.uint64(int(part * 2**64)) if part < 1 else np.ones(len(x), bool)
    got, need = np.add.reduceat(inside, starts, dtype=np.int64), prefix_size(n, share)
    for k in np.flatnonzero(got < need):
        mine = x[starts[k] : starts[k] + n[k]]
        inside[starts[k] : starts[k] + n[k]] = mine <= np.partition(mine, need[k] - 1)[need[k] - 1]
    return x[inside], np.maximum(got, need)


def _tokens(sets: list[np.ndarray], h: np.ndarray, order: int, share: int, cells: np.ndarray | None = None) -> pa.RecordBatch:
    tokens, count = first_tokens(sets, order, share, cells)
    n = np.array([len(s) for s in sets], np.int32)
    return pa.record_batch([pa.array(tokens.view(np.int64)), pa.array(np.repeat(h, count)), pa.array(np.repeat(n, count)), pa.array(np.repeat(count.astype(np.int32), count))], ["token", "h", "n", "s"])


TOKENS = "token long, h long, n int, s int"


def _classes(size: int):
    def run(batches):
        for batch in batches:
            for part in pieces(batch, "text"):
                sets = shingle_sets(*strings(part.column(2)), size)
                keys = set_keys(sets)
                yield pa.record_batch([part.column(0), part.column(1), pa.array(keys[:, 0].astype(np.int64)), _binary(keys), pa.array([len(s) for s in sets], pa.int64())], ["id", "r", "h", "key", "n"])

    return lean(run)


def _new(sets: list[np.ndarray], seen: set[int]) -> tuple[list[int], np.ndarray]:
    """Which sets are neither empty nor seen by this task (a bounded memory, so copies are dealt about once a task)."""
    keys = set_keys(sets)
    if len(seen) > 200_000:
        seen.clear()
    out = []
    for k, h in enumerate(keys[:, 0].tolist()):
        if h and h not in seen:
            seen.add(h)
            out.append(k)
    return out, keys


def _dealt(size: int, share: int):
    def run(batches):
        seen: set[int] = set()
        for batch in batches:
            for part in pieces(batch, "text"):
                sets = shingle_sets(*strings(part.column(0)), size)
                new, keys = _new(sets, seen)
                if new:
                    yield _tokens([sets[k] for k in new], keys[new, 0].astype(np.int64), 0, share)

    return lean(run)


def _texts(size: int):
    """Class and compressed text. Text is smaller than its set of hashes, so this is what travels."""

    def run(batches):
        seen: set[int] = set()
        z = zstandard.ZstdCompressor(3)
        for batch in batches:
            for part in pieces(batch, "text"):
                sets = shingle_sets(*strings(part.column(0)), size)
                new, keys = _new(sets, seen)
                if new:
                    texts = [z.compress(part.column(0)[k].as_buffer()) for k in new]
                    yield pa.record_batch([pa.array(keys[new, 0].astype(np.int64)), _binary(keys[new]), pa.array([len(sets[k]) for k in new], pa.int64()), pa.array(texts, pa.binary())], ["h", "key", "n", "z"])

    return lean(run)


def _unpacked(z: pa.Array, size: int) -> list[np.ndarray]:
    unpack = zstandard.ZstdDecompressor()
    return shingle_sets(*strings(pa.array([unpack.decompress(x.as_buffer()) for x in z], pa.large_binary()).cast(pa.large_string())), size)


def _dealt_again(size: int, share: int):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                yield _tokens(_unpacked(rows.column(2), size), rows.column(1).to_numpy(), 1, share, rows.column(0).to_numpy())

    return lean(run)


def _counted(batches):
    """Of rows sorted by token and class: the distinct ones of tokens that several classes have, with their number. A token's rows are held
    until its end, or until COUNTED; from then on they pass with that number."""
    names = ["token", "h", "n", "s"]
    held, passing = [np.zeros(0, t) for t in (np.int64, np.int64, np.int32, np.int32)], None
    out = lambda cols, df: pa.record_batch([pa.array(c) for c in cols] + [pa.array(df.astype(np.int32))], [*names, "df"])
    for batch in batches:
        cols = [np.concatenate([a, batch.column(batch.schema.get_field_index(n)).to_numpy()]) for a, n in zip(held, names)]
        token, h = cols[:2]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (h[1:] != h[:-1])
        if passing is not None and len(token):
            new[0] &= (token[0], h[0]) != passing
        cols = [c[new] for c in cols]
        if passing is not None:
            more = int(np.searchsorted(cols[0], passing[0], side="right"))
            if more:
                yield out([c[:more] for c in cols], np.full(more, COUNTED))
                passing, cols = (cols[0][more - 1], cols[1][more - 1]), [c[more:] for c in cols]
        held = cols
        if not len(cols[0]):
            continue
        passing = None
        edge = np.flatnonzero(np.concatenate([[True], cols[0][1:] != cols[0][:-1]]))
        last = int(edge[-1])
        df = np.repeat(np.diff(edge), np.diff(edge))
        if (df > 1).any():
            yield out([c[:last][df > 1] for c in cols], np.minimum(df[df > 1], COUNTED))
        held = [c[last:] for c in cols]
        if len(held[0]) >= COUNTED:
            yield out(held, np.full(len(held[0]), COUNTED))
            passing, held = (held[0][-1], held[1][-1]), [c[:0] for c in held]
    if len(held[0]) > 1:
        yield out(held, np.full(len(held[0]), len(held[0])))


def neighbourhoods(rows: DataFrame, twins: DataFrame, share: int) -> DataFrame:
    """(h, c) of classes that share a prefix token of rows (token, h, n, s) with another whose size can link, directly or through others.

    A class's tokens that no other class has come first in its prefix: s less the shared ones. Where s is no more than the prefix, all
    of its rows are in it. In a token's group sorted by size, neighbours whose sizes can't link part the group."""
    tasks = max(1, task_count(rows.sparkSession))
    shared = rows.repartition(tasks, "token").sortWithinPartitions("token", "h").mapInArrow(lean(_counted), TOKENS + ", df int")
    mine = Window.partitionBy("h")
    need = F.expr(f"n - (cast({share} as long) * n + 99) div 100 + 1")
    ranked = shared.repartition(tasks, "h").select("token", "h", "n", "s", F.row_number().over(mine.orderBy("df", "token")).alias("k"), F.count(F.lit(1)).over(mine).alias("m"))
    first = ranked.where((F.col("s") <= need) | (F.col("s") - F.col("m") + F.col("k") <= need)).select("token", "h", "n")
    group = Window.partitionBy("token").orderBy("n", "h")
    pairs = first.repartition(tasks, "token").select("h", "n", F.lag("h").over(group).alias("v"), F.lag("n").over(group).alias("w"))
    edges = written(pairs.where(F.col("v").isNotNull() & (100 * F.col("w").cast("long") >= share * F.col("n").cast("long"))).select(F.col("h").alias("u"), "v").distinct(), "near")
    near = components(edges).select(F.col("node").alias("h"), F.col("root").alias("c"))
    out = written(near.union(twins.join(near, "h", "left_anti").select("h", F.col("h").alias("c"))), "near")
    discard(edges)
    return out


def _compact(rows: DataFrame) -> DataFrame:
    """Hinted for a broadcast if its counted rows (of two numbers at most) allow that."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def cell_links(sets: list[np.ndarray], label: np.ndarray, left: np.ndarray, right: np.ndarray, share: int) -> list[tuple[int, int]]:
    """Links between sets of a left and a right mask, enough to connect all that links connect. label: equal for what is connected already.

    Orders a cell's shingles by their counts in it, rarest first, then by hash: a pair must share one of both prefixes."""
    n = np.array([len(s) for s in sets], np.int64)
    label = np.unique(label, return_inverse=True)[1]
    values, ids, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), n)
    rank = np.empty(len(values), np.int64)
    rank[np.lexsort((mixed(values ^ _SALTS[5]), df))] = np.arange(len(values))
    at = np.lexsort((rank[ids], owner))
    ids, place = ids[at], np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
    common = df[ids] > 1  # what one set alone has is in no intersection
    ids, owner, first = ids[common], owner[common], (place < np.repeat(prefix_size(n, share), n))[common]
    bounds = np.searchsorted(owner, np.arange(len(sets) + 1))
    fids, fowner = ids[first], owner[first]
    fbounds = np.searchsorted(fowner, np.arange(len(sets) + 1))
    by_token = np.argsort(fids, kind="stable")
    holders, tbounds = fowner[by_token], np.searchsorted(fids[by_token], np.arange(len(values) + 1))
    both, found, flag = left & right, [], np.zeros(len(values), bool)
    for i in np.flatnonzero(left):
        mine = fids[fbounds[i] : fbounds[i + 1]]
        if not len(mine):
            continue
        hits = np.bincount(np.concatenate([holders[tbounds[t] : tbounds[t + 1]] for t in mine]), minlength=len(sets))
        to = np.flatnonzero((hits > 0) & right & (label != label[i]) & (100 * np.minimum(n, n[i]) >= share * np.maximum(n, n[i])))
        to = to[(to < i) | ~both[to] | ~both[i]]
        to = to[np.argsort(-hits[to], kind="stable")]
        flag[ids[bounds[i] : bounds[i + 1]]] = True
        step = 4
        while len(to):
            now, to = to[:step], to[step:]
            parts = [ids[bounds[j] : bounds[j + 1]] for j in now]
            same = np.add.reduceat(flag[np.concatenate(parts)], np.cumsum([0, *map(len, parts[:-1])]), dtype=np.int64)
            for j in now[100 * same >= share * (n[i] + n[now] - same)]:
                if label[j] != label[i]:
                    label[label == label[j]] = label[i]
                    found.append((int(i), int(j)))
            to, step = to[label[to] != label[i]], 128
        flag[ids[bounds[i] : bounds[i + 1]]] = False
    return found


def _cells(size: int, share: int):
    """Cells (c, i, j) come one after another, each whole in its partition and sorted; one is held at a time. Side 0 is left, 1 right, 2 both."""

    def links(rows: pa.Table) -> pa.RecordBatch:
        key, root, side = rows.column("key").to_pylist(), rows.column("root").to_pylist(), rows.column("side").to_numpy()
        number = {r: k for k, r in enumerate(dict.fromkeys(root))}
        found = cell_links(_unpacked(rows.column("z"), size), np.array([number[r] for r in root]), side != 1, side != 0, share) if len(number) > 1 else []
        return pa.record_batch([pa.array([key[a] for a, _ in found], pa.binary()), pa.array([key[b] for _, b in found], pa.binary())], ["u", "v"])

    def run(batches):
        held, now = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("c", "i", "j")], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1), len(keys)]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if now is not None and (keys[lo] != now).any():
                    yield links(pa.Table.from_batches(held))
                    held = []
                now = keys[lo]
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield links(pa.Table.from_batches(held))

    return lean(run)


def _compared(rows: DataFrame, size: int, share: int) -> DataFrame:
    cells = rows.select("c", "i", "j", "side", "root", "key", "z").repartition(max(1, task_count(rows.sparkSession)), "c", "i", "j").sortWithinPartitions("c", "i", "j")
    return written(cells.mapInArrow(_cells(size, share), "u binary, v binary"), "links")


def _blocks(shingles, classes):
    return F.greatest(F.lit(1), F.ceil(shingles / CELL_SHINGLES), F.ceil(classes / CELL_CLASSES)).cast("int")


def _links(texts: DataFrame, size: int, share: int) -> DataFrame:
    """Links (u, v) of texts (h, key, n, z, c) inside each c, enough for components."""
    large = texts.groupBy("c").agg(_blocks(F.sum("n"), F.count(F.lit(1))).alias("blocks")).where("blocks > 1")
    large = written(large, "large")
    blk = F.coalesce(F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"), F.lit(0))
    rows = texts.join(_compact(large), "c", "left").withColumn("i", blk)
    links = _compared(rows.withColumns({"j": F.col("i"), "side": F.lit(2), "root": F.col("key")}), size, share)
    if large.isEmpty():
        return links
    roots = components(links).select(F.col("node").alias("key"), "root")
    rows = texts.join(_compact(large), "c").withColumn("j", blk).join(roots, "key", "left").withColumn("root", F.coalesce("root", "key"))
    most = rows.groupBy("c", "root").agg(F.count(F.lit(1)).alias("m")).groupBy("c").agg(F.max_by("root", F.struct("m", "root")).alias("most"))
    rows = written(rows.join(most, "c").withColumn("minor", F.col("root") != F.col("most")).drop("most"), "open")
    minors = written(rows.where("minor").groupBy("c").agg(_blocks(F.sum("n"), F.count(F.lit(1))).alias("parts")), "minors")
    rows = rows.join(_compact(minors), "c")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    lefts = rows.where("minor").withColumn("i", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")).drop("j").select("*", every("blocks").alias("j"), F.lit(0).alias("side"))
    rights = rows.select("*", every("parts").alias("i"), F.lit(1).alias("side"))
    return links.union(_compared(lefts.unionByName(rights), size, share))


def jaccard_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, share: int = 85) -> DataFrame:
    """One row per row of docs: the id, n_shingles and component_id (least id reachable by links)."""
    spark = docs.sparkSession
    ship(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(F.col(id_col).alias("id"), F.xxhash64(id_col, text_col).alias("r"), F.col(text_col).alias("text"))
    nodes = written(slim.mapInArrow(_classes(size), f"id {kind}, r long, h long, key binary, n long"), "classes")
    # Different sets whose first 64 bits agree are neighbours without a shared token.
    twins = written(nodes.groupBy("h").agg(F.min("key").alias("x"), F.max("key").alias("y")).where("x != y").select("h"), "twins")

    near = neighbourhoods(slim.select("text").mapInArrow(_dealt(size, share), TOKENS), twins, share)
    readers = written(nodes.join(_compact(near), "h", "left_semi").groupBy("key").agg(F.min("r").alias("r")).select("r").distinct(), "readers")
    few = slim.select("r", "text").join(_compact(readers), "r", "left_semi").select("text")
    texts = written(few.mapInArrow(_texts(size), "h long, key binary, n long, z binary").join(_compact(near), "h"), "texts")
    again = neighbourhoods(texts.select("c", "h", "z").mapInArrow(_dealt_again(size, share), TOKENS), twins, share)
    links = _links(texts.drop("c").join(_compact(again), "h"), size, share)
    roots = components(links).select(F.col("node").alias("key"), "root")

    classes = nodes.where("h != 0").groupBy("key").agg(F.min("id").alias("id")).join(roots, "key", "left")
    classes = written(classes.select("key", "id", F.coalesce("root", "key").alias("root")), "sets")
    least = classes.groupBy("root").agg(F.min("id").alias("component_id"))
    out = nodes.join(classes.join(least, "root").select("key", "component_id"), "key", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("h") == 0, F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
