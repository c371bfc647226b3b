"""Pairs of word sets by their Jaccard similarity, over whole tables.

Words are known by 64 bits, sets by 128. Equal sets are one class, compared once; classes have numbers of up to 32 bits.

1. Words are counted in BUCKETS buckets. The rarer its bucket, the earlier a word stands in the one order of all sets; any order is right, this
   one makes short lists. Only this table (a byte a bucket) goes to every task.
2. Sets of sizes m and n with a Jaccard of least share at least t = least (m + n) / (1 + least) words. So the first K of the words that
   they share have at least t - K + 1 words from there on in both. Words that can be so are dealt into g groups by their hash. K words in g
   groups make K - g pairs inside groups at least, so two sets have that many such pairs in common; with K = g + SHARED, sets that have
   SHARED in common (t - g, if that is fewer) are candidates. g is a quarter of the least size of the larger set's octave, so a set goes to the octaves of
   all sets that it fits. Pairs of words are in few sets, where one word is in many: the rows of pairs grow with the input, hits are few.
   Near sets share most of their pairs; so MinHash bands (links that join near sets) come first, and only sets of different components are counted.
3. Components of candidates are compared inside, all pairs exactly, a large one in cells of two blocks.

Nothing is capped: pairs of words of many sets make many hits, compared in arrays.

For MinHash pairs the bands take the place of steps 1 and 2.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import discard, ship, task_count, written

#: Buckets of the words' counts; hits that make a candidate.
BUCKETS, SHARED = 1 << 22, 6
#: Bands that join near sets before pairs of words are counted: what they miss makes hits, nothing is lost.
LINK_BANDS = 8
#: A hit's weight is WHOLE over the hits that the pair needs; so WHOLE is a multiple of 1 to SHARED.
WHOLE = 840
#: Words and classes of a block at most; a cell has two.
CELL_WORDS, CELL_CLASSES = 1_000_000, 2048
#: Rows of four numbers that are broadcast at most.
BROADCAST_ROWS = 1_000_000
#: Parts over which the numbers of classes are dealt, and a class's members.
PARTS, SALTS = 1024, 16
#: Rows of words that are compared at a time.
STEP = 200_000


def hashed(sets: DataFrame, every: bool = False) -> DataFrame:
    """(id, n, k1, k2, words) of sets(id, tokens) that have tokens and an id (of all with every): sorted hashes of the tokens, and of all of
    them. Written, since cutting texts into words costs more than all that follows."""
    rows = sets if every else sets.where(F.col("id").isNotNull() & (F.size("tokens") > 0))
    rows = rows.select("id", F.size("tokens").alias("n"), F.sort_array(F.transform("tokens", lambda w: F.xxhash64(w))).alias("words"))
    return written(rows.select("id", "n", F.xxhash64("words").alias("k1"), F.xxhash64(F.lit(1), "words").alias("k2"), "words"), "sets")


def classes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, no, class_id) of every row of `hashed` that has words, no being its class and class_id the least id there; and (id, k1, no, n) of
    the row with that id. A class of rows without ids has a number only."""
    keys = rows.where("n > 0").select("id", "n", "k1", "k2")
    own = Window.partitionBy("part").orderBy("k1", "k2")
    one = keys.groupBy("k1", "k2").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.count(F.lit(1)).alias("members")).withColumn("part", F.pmod("k1", F.lit(PARTS)))
    one = written(one.select("id", "n", "k1", "k2", "members", ((F.row_number().over(own) - 1) * PARTS + F.col("part")).alias("no")), "classes")
    salted = keys.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))  # a class may hold most rows
    alone = one.where("members = 1").select("id", "no", F.col("id").alias("class_id"))
    several = one.where("members > 1").select("k1", "k2", "no", F.col("id").alias("class_id"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt"))
    return written(salted.join(several, ["k1", "k2", "salt"]).select("id", "no", "class_id").unionByName(alone), "members"), one.where("id IS NOT NULL").select("id", "k1", "no", "n")


def compact(rows: DataFrame) -> DataFrame:
    """Hinted for a broadcast if its counted rows allow that."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def counts(rows: DataFrame) -> np.ndarray:
    """For each bucket of words the number of rows that hold one, in steps of a quarter of a power of two; 0 for one row at most."""
    bucket = F.explode(F.transform("words", lambda w: w.bitwiseAND(F.lit(BUCKETS - 1)).cast("int"))).alias("bucket")
    found = rows.select(bucket).groupBy("bucket").count().where("count > 1").select("bucket", F.least(F.lit(255), F.ceil(4 * F.log2("count"))).cast("short").alias("size")).toArrow()
    out = np.zeros(BUCKETS, np.uint8)
    out[found.column("bucket").to_numpy()] = found.column("size").to_numpy()
    return out


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list array."""
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy()[offsets[0] : offsets[-1]], offsets - offsets[0]


def _pieces(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _octave(n: np.ndarray) -> np.ndarray:
    """The exponent of the greatest power of two up to n."""
    return np.frexp(n.astype(float))[1].astype(np.int64) - 1


def _groups(octave: np.ndarray, least: float) -> np.ndarray:
    """Groups of an octave's words, fewer than the words that its sets must share; 0: words are taken one by one."""
    return np.floor(min(0.25, least / 2) * np.exp2(octave)).astype(np.int64)


def _mixed(a: np.ndarray, b: np.ndarray, octave: np.ndarray) -> np.ndarray:
    x = a.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ octave.astype(np.uint64)
    x = (x ^ x >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9) + b.view(np.uint64)
    x = (x ^ x >> np.uint64(29)) * np.uint64(0x94D049BB133111EB)
    return (x ^ x >> np.uint64(32)).view(np.int64)


def _prefixes(size, least: float) -> Callable:
    """Of batches (no, words, c): (key, size, no, c) of pairs of words of a group that can be among the first shared ones; size holds the set's size and
    below it the words from the later one on, no has a low bit for the set's own octave."""

    def pairs(word, owner, group):
        """Both places of each two words of an owner's group."""
        left = np.arange(len(word))
        for lag in range(1, len(word)):
            left = left[: np.searchsorted(left, len(word) - lag)]
            left = left[(owner[left] == owner[left + lag]) & (group[left] == group[left + lag])]
            if not len(left):
                return
            yield left, left + lag

    def run(batches):
        for batch in _pieces(batches, 256):
            words, offsets = _lists(batch.column(1))
            no, n = batch.column(0).to_numpy(), np.diff(offsets)
            owner = np.repeat(np.arange(len(n)), n)
            df = size.value[words & (BUCKETS - 1)]
            order = np.lexsort((words, df, owner))
            words, df, at = words[order], df[order], np.arange(len(words)) - offsets[owner]
            spread = (words.view(np.uint64) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(33)).astype(np.int64)
            own, last = _octave(n), _octave(np.floor(n / least + 1e-6))
            for up in range(int((last - own).max()) + 1 if len(n) else 0):
                octave = own + up
                groups = _groups(octave, least)
                to = n - np.ceil(least * np.maximum(n, np.exp2(octave)) - 1e-9).astype(np.int64) + groups + SHARED
                kept = np.flatnonzero((at < np.where(octave <= last, to, 0)[owner]) & (df > 0))  # a word of one row alone makes no hit
                group = spread[kept] % np.maximum(groups, 1)[owner[kept]]
                kept = kept[np.lexsort((words[kept], group, owner[kept]))]
                single = groups[owner[kept]] == 0
                one, kept = kept[single], kept[~single]
                group = spread[kept] % np.maximum(groups, 1)[owner[kept]]
                found = [(one, one), *((kept[x], kept[y]) for x, y in pairs(words[kept], owner[kept], group))]
                x, y = (np.concatenate(k) for k in zip(*found))
                which = owner[x]
                rest = n[which] - np.maximum(at[x], at[y])
                columns = [_mixed(words[x], words[y], octave[which]), n[which].astype(np.int64) << 32 | rest, no[which] << 1 | int(not up), batch.column(2).to_numpy()[which]]
                columns = [c[np.argsort(which, kind="stable")] for c in columns]  # a set's rows together, as they compress better
                yield pa.record_batch([pa.array(c) for c in columns], ["key", "size", "no", "c"])

    return run


def _by_word(find: Callable, columns: Callable) -> Callable:
    """Gives find the columns of sorted batches, about STEP rows at a time, all rows of a first column's value together."""

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(columns(batch))
            rows += batch.num_rows
            if rows < STEP:
                continue
            cols = [np.concatenate(c) for c in zip(*held)]
            cut = int(np.searchsorted(cols[0], cols[0][-1]))  # the last word may go on
            yield from find(*(c[:cut] for c in cols))
            held, rows = [[c[cut:] for c in cols]], len(cols[0]) - cut
        if held:
            yield from find(*(np.concatenate(c) for c in zip(*held)))

    return run


def _hits(least: float) -> Callable:
    """Of rows (key, size, no, c) sorted by key and size: (pair, weight) of those of different c, pair being both numbers, the less one in the
    high half."""

    def compared(key, size, no, c):
        n, rest, no, own = size >> 32, size & ((1 << 32) - 1), no >> 1, (no & 1) == 1
        groups = _groups(_octave(n), least)
        left = np.arange(len(key))
        for lag in range(1, len(key)):
            left = left[: np.searchsorted(left, len(key) - lag)]
            left = left[(key[left] == key[left + lag]) & (least * n[left + lag] <= n[left] + 1e-9)]
            if not len(left):
                return
            right = left + lag
            need = np.ceil(least / (1 + least) * (n[left] + n[right]) - 1e-9).astype(np.int64) - groups[right]
            good = own[right] & (np.minimum(rest[left], rest[right]) >= need - SHARED + 1) & (c[left] != c[right])
            if good.any():
                a, b = no[left[good]], no[right[good]]
                yield pa.record_batch([pa.array(np.minimum(a, b) << 32 | np.maximum(a, b)), pa.array((WHOLE // np.clip(need[good], 1, SHARED)).astype(np.int32))], ["pair", "weight"])

    return _by_word(compared, lambda batch: [c.to_numpy() for c in batch.columns])


def candidates(rows: DataFrame, least: float) -> DataFrame:
    """(u, v) that join all classes of rows (no, words) that may have a Jaccard of least."""
    spark = rows.sparkSession
    size = spark.sparkContext.broadcast(counts(rows))
    links = written(minhash_links(rows.select("no", F.size("words").alias("n"), "words"), least, 128, 4, LINK_BANDS), "links")
    known = rows.select("no", "words").join(compact(components(links)), "no", "left").select("no", "words", F.coalesce("c", "no").alias("c"))
    words = known.mapInArrow(_prefixes(size, least), "key long, size long, no long, c long")
    dealt = words.repartition(task_count(spark), "key").sortWithinPartitions("key", "size")
    pairs = dealt.mapInArrow(_hits(least), "pair long, weight int").groupBy("pair").agg(F.sum("weight").alias("weight")).where(F.col("weight") >= WHOLE)
    return pairs.select(F.shiftright("pair", 32).alias("u"), F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).alias("v")).union(links)


def _bands(permutations: int, rows: int, count: int) -> Callable:
    """Of batches (no, n, words): a row (band, no, n, sketch) for each of the first count bands of the MinHash signature; sketch holds two bits of each minimum."""
    state = np.random.default_rng(permutations)
    odd, plus = (state.integers(0, 1 << 63, permutations, dtype=np.uint64) << np.uint64(1) | np.uint64(1)), state.integers(0, 1 << 63, permutations, dtype=np.uint64)

    def run(batches):
        for batch in _pieces(batches):
            words, offsets = _lists(batch.column(2))
            words = words.view(np.uint64)
            least = np.stack([np.minimum.reduceat((words * odd[p] + plus[p]) >> np.uint64(32), offsets[:-1]) for p in range(permutations)], 1)
            bits = np.pad((least & np.uint64(3)).astype(np.uint8), ((0, 0), (0, -permutations % 4)))
            sketch = bits[:, 0::4] | bits[:, 1::4] << 2 | bits[:, 2::4] << 4 | bits[:, 3::4] << 6
            key = np.broadcast_to(np.arange(count, dtype=np.uint64), (len(least), count))
            for r in range(rows):
                key = (key ^ least[:, r : count * rows : rows]) * np.uint64(0x9E3779B97F4A7C15)
                key = key ^ key >> np.uint64(29)
            which = np.repeat(np.arange(len(least)), count)
            sketches = pa.FixedSizeBinaryArray.from_buffers(pa.binary(sketch.shape[1]), len(which), [None, pa.py_buffer(np.ascontiguousarray(sketch[which]))])
            columns = [pa.array(key.ravel().view(np.int64)), pa.array(batch.column(0).to_numpy()[which]), pa.array(batch.column(1).to_numpy()[which]), sketches.cast(pa.binary())]
            yield pa.record_batch(columns, ["band", "no", "n", "sketch"])

    return run


def _united(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """label, each row's least row of its group, after the groups of a and b became one."""
    while len(a):
        np.minimum.at(label, np.maximum(label[a], label[b]), np.minimum(label[a], label[b]))
        while (label[label] != label).any():
            label = label[label]
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return label


def _band_links(least: float, permutations: int) -> Callable:
    """Of rows (band, no, n, sketch) sorted by band and n: links (u, v) that join what the pairs of a band join that fit in size and agree in as
    many minima as sets of a Jaccard of least do, less five deviations (of which one pair in three million falls short)."""
    chance = least + (1 - least) / 4
    most = permutations * (1 - chance) + 5 * (permutations * chance * (1 - chance)) ** 0.5

    def linked(band, no, n, sketch):
        label, left = np.arange(len(band)), np.arange(len(band))
        for lag in range(1, len(band)):
            left = left[: np.searchsorted(left, len(band) - lag)]
            left = left[(band[left] == band[left + lag]) & (least * n[left + lag] <= n[left] + 1e-9)]
            if not len(left):
                break
            a = left[label[left] != label[left + lag]]  # what is joined needs no other link
            differ = sketch[a] ^ sketch[a + lag]
            a = a[np.bitwise_count((differ | differ >> 1) & 0x55).sum(1) <= most]
            label = _united(label, a, a + lag)
        far = np.flatnonzero(no[label] != no)
        if len(far):
            yield pa.record_batch([pa.array(np.minimum(no[far], no[label[far]])), pa.array(np.maximum(no[far], no[label[far]]))], ["u", "v"])

    def columns(batch):
        offsets = np.frombuffer(batch.column(3).buffers()[1], np.int32)[batch.column(3).offset :][: batch.num_rows + 1]
        flat = np.frombuffer(batch.column(3).buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        return [*(batch.column(k).to_numpy() for k in range(3)), flat.reshape(batch.num_rows, -1)]

    return _by_word(linked, columns)


def minhash_links(rows: DataFrame, least: float, permutations: int = 128, width: int = 4, bands: int | None = None) -> DataFrame:
    """(u, v) that join the classes of rows (no, n, words) that may have a Jaccard of least and share one of the first bands (all by default) of `width` minima."""
    dealt = rows.select("no", "n", "words").mapInArrow(_bands(permutations, width, bands or permutations // width), "band long, no long, n int, sketch binary")
    dealt = dealt.repartition(task_count(rows.sparkSession), "band").sortWithinPartitions("band", "n")
    return dealt.mapInArrow(_band_links(least, permutations), "u long, v long").distinct()


def _cell_pairs(least: float) -> Callable:
    """Cells (c, i, j) come one after another, each whole in its partition and sorted; one is held at a time. Side 0 is left, 1 right, 2 both."""

    def pairs(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(rows).combine_chunks()
        no, first = np.unique(table.column("no").to_numpy(), return_index=True)  # rows may be repeated
        side = table.column("side").to_numpy()[first]
        values, offsets = _lists(table.column("words").combine_chunks())
        n = np.diff(offsets)[first]
        by_size = np.argsort(n, kind="stable")
        first, no, side, n = first[by_size], no[by_size], side[by_size], n[by_size]
        ids = np.unique(values, return_inverse=True)[1]
        parts = [ids[offsets[k] : offsets[k + 1]] for k in first]
        flat, starts = np.concatenate(parts), np.concatenate([[0], np.cumsum(n)])
        flag = np.zeros(int(ids.max()) + 1, bool)
        for x in range(len(no) - 1):
            end = int(np.searchsorted(n, n[x] / least + 1e-6, side="right"))
            if end <= x + 1:
                continue
            flag[parts[x]] = True
            same = np.add.reduceat(flag[flat[starts[x + 1] : starts[end]]], starts[x + 1 : end] - starts[x + 1], dtype=np.int64)
            flag[parts[x]] = False
            union = n[x] + n[x + 1 : end] - same
            near = np.flatnonzero((same / union >= least) & ((side[x] == 2) | (side[x + 1 : end] != side[x])))
            if len(near):
                other = no[x + 1 + near]
                yield pa.record_batch([pa.array(np.minimum(other, no[x])), pa.array(np.maximum(other, no[x])), pa.array(same[near] / union[near])], ["u", "v", "jaccard"])

    def run(batches):
        held, now = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(k).to_numpy() for k in range(3)], 1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1), len(keys)]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if now is not None and (keys[lo] != now).any():
                    yield from pairs(held)
                    held = []
                now = keys[lo]
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from pairs(held)

    return run


def compared(rows: DataFrame, near: DataFrame, least: float) -> DataFrame:
    """(u, v, jaccard), u < v, of all pairs with at least that of rows (id, k1, words) that near (id, k1, no, n, c) gives the same c."""
    spark = rows.sparkSession
    sizes = near.groupBy("c").agg(F.greatest(F.ceil(F.sum("n") / CELL_WORDS), F.ceil(F.count(F.lit(1)) / CELL_CLASSES)).cast("int").alias("blocks"))
    large = written(sizes.where("blocks > 1"), "large")
    dealt = rows.select("id", "k1", "words").join(compact(near.join(compact(large), "c", "left").drop("n")), ["id", "k1"]).withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("i", F.pmod(F.xxhash64("no"), F.col("blocks")).cast("int"))
    cells = dealt.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    side = F.when(F.col("i") == F.col("o"), 2).when(F.col("i") < F.col("o"), 0).otherwise(1)
    cells = cells.select("c", F.least("i", "o").alias("i"), F.greatest("i", "o").alias("j"), side.alias("side"), "no", "words")
    cells = cells.repartition(task_count(spark), "c", "i", "j").sortWithinPartitions("c", "i", "j")
    return cells.mapInArrow(_cell_pairs(least), "u long, v long, jaccard double")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges(u, v) -> (no, c): the least number of its component, for each that has an edge, by alternating large and small stars."""

    def star(now: DataFrame, large: bool) -> DataFrame:
        back = now.select(F.col("v").alias("u"), F.col("u").alias("v"))
        near = now.union(back) if large else now
        least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        found = near.join(least, "u")
        if large:
            return found.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        return found.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()

    def digest(now: DataFrame) -> tuple:
        return tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), "edges")
    seen = digest(now)
    for _ in range(most_rounds if seen[0] else 0):
        last, now = now, written(star(star(now, True), False), "edges")
        discard(last)
        before, seen = seen, digest(now)
        if before == seen:
            break
    else:
        if seen[0]:
            raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("no"), F.col("v").alias("c")).union(now.select("v", "v").distinct())


def class_pairs(rows: DataFrame, chosen: DataFrame, least: float, find: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(u, v, jaccard) of numbers of classes, u < v. find gives candidates (u, v) of rows (no, words); by default all there are."""
    ship(rows.sparkSession)
    chosen = compact(chosen)
    one = rows.select("id", "k1", "words").join(chosen, ["id", "k1"])
    near = components(find(one) if find else candidates(one, least))
    near = written(near.join(chosen, "no"), "near")
    return written(compared(rows, near, least), "pairs")


def member_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b, jaccard), a < b, of members (id, no) of the classes of pairs (u, v, jaccard), and of equal sets. A class's members are dealt over salts."""
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("salt")
    several = members.join(members.groupBy("no").count().where("count > 1").select("no"), "no", "left_semi")
    left = several.select("no", F.col("id").alias("a"), F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt"))
    right = several.select("no", F.col("id").alias("b"), salts)
    same = left.join(right, ["no", "salt"]).where("a < b").select("a", "b", F.lit(1.0).alias("jaccard"))
    x, y = members.select(F.col("id").alias("x"), F.col("no").alias("u")), members.select(F.col("id").alias("y"), F.col("no").alias("v"))
    apart = pairs.join(x, "u").join(y, "v").where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "jaccard")
    return apart.unionByName(same)
