import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.llm import decontaminate as D
from codeloom.llm import fingerprints as P
from codeloom.llm import ngram_join as J
from codeloom.llm import quality, toxicity
from codeloom.llm.common import BLANKS, hashed_words
from codeloom.llm.components import components
from codeloom.llm.queries import op2_decontamination, op3_quality, op4_fingerprints, op5_ngram_join, op6_toxicity

SF01 = "/root/testdata/sf0.01"


# --- components and word hashes


def least_reachable(nodes, pairs):
    up = {n: n for n in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = top(a), top(b)
        up[max(x, y)] = min(x, y)
    return {n: top(n) for n in nodes}


def test_components_equal_union_find(spark):
    r = random.Random(5)
    pairs = [(r.randrange(200), r.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 340)] + [(500, x) for x in range(501, 560)] + [(7, 7)]
    got = {x["node"]: x["root"] for x in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    want = least_reachable({x for p in pairs if p[0] != p[1] for x in p}, pairs)
    assert got == want
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_word_hashes_follow_words():
    import pyarrow as pa

    from codeloom.llm.common import strings

    texts = ["a Bc  a\n", "", None, "BC", "été a", "x" * 3_000_000 + " a", " \x0b", "c\x1cd e"]
    words, at = hashed_words(*strings(pa.array(texts)), BLANKS)
    plain = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for t in texts]
    assert np.diff(at).tolist() == [len(p) for p in plain]
    flat = [w for p in plain for w in p]
    table = {}
    assert all(table.setdefault(w, h) == h for w, h in zip(flat, words.tolist()))
    assert len(set(table.values())) == len(table)


# --- n-gram join


def brute_join(rows, size=4, share=85):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append(frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)]) if w else frozenset())
    where = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            where[x].append(i)
    shared = Counter()
    for xs in where.values():
        for a in range(len(xs)):
            for b in range(a):
                shared[xs[b], xs[a]] += 1
    links = [(a, b) for (a, b), n in shared.items() if 100 * n >= share * (len(sets[a]) + len(sets[b]) - n)]
    root = least_reachable(range(len(rows)), links)
    group = defaultdict(list)
    for i, r in root.items():
        group[r].append(rows[i][0])
    out = []
    for i, (k, _) in enumerate(rows):
        known = [x for x in group[root[i]] if x is not None]
        out.append((k, len(sets[i]), min(known, default=None) if sets[i] else k))
    return sorted(out, key=repr)


def drifting(r, n, size, edits):
    """Near copies that wander off, so links make chains."""
    words, out = [f"w{r.randrange(10**6)}" for _ in range(size)], []
    for _ in range(n):
        words = list(words)
        for _ in range(edits):
            words[r.randrange(size)] = f"w{r.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def test_join_equals_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()]
    got = op5_ngram_join(spark, SF01).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == brute_join(rows)


def test_join_in_large_groups(spark):
    r = random.Random(6)
    star = [f"w{k}" for k in range(120)]
    texts = drifting(r, 70, 80, 1) + [" ".join(star[:k] + [f"z{k}{j}" for j in range(3)] + star[k:]) for k in range(60)] + ["same words in this text again"] * 40
    common = " ".join(f"c{k}" for k in range(30))
    texts += [f"{common} " + " ".join(f"u{r.randrange(10**6)}" for _ in range(5)) for _ in range(60)]
    r.shuffle(texts)
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for size, share in ((4, 85), (5, 80)):
        got = J.jaccard_classes(df, size=size, share=share).select("doc_id", "n_shingles", "component_id").collect()
        assert sorted(map(tuple, got), key=repr) == brute_join(rows, size, share)


def test_join_of_odd_rows(spark, odd):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()] + [(20, "one two"), (21, "ONE\ttwo"), (22, "one two three"), (None, "one two")]
    df = odd.select("doc_id", "text", "lang", "id").union(spark.createDataFrame([(k, t, "x", 1) for k, t in rows[-4:]], "doc_id long, text string, lang string, id long"))
    got = J.jaccard_classes(df).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == brute_join(rows)
    assert J.jaccard_classes(df.where("false")).collect() == []


def random_sets(r, n):
    """Sets around a few cores, so that pairs of every likeness occur."""
    cores = [np.unique(r.integers(0, 2**63, int(r.integers(1, 200))).astype(np.uint64)) for _ in range(4)]
    out = []
    for _ in range(n):
        core = cores[r.integers(4)]
        kept = core[r.random(len(core)) >= r.random() * 0.25]
        out.append(np.unique(np.concatenate([kept, r.integers(0, 2**63, int(r.integers(0, 1 + len(core) // 6))).astype(np.uint64)])))
    return [s for s in out if len(s)]


def linked(a, b, share):
    same = len(np.intersect1d(a, b))
    return 100 * same >= share * (len(a) + len(b) - same)


def test_orders_lose_no_link():
    r = np.random.default_rng(1)
    for share in (60, 80, 85, 100):
        sets = random_sets(r, 80)
        for order in (0, 1):
            tokens, count = J.first_tokens(sets, order, share)
            assert (count >= [J.prefix_size(len(s), share) for s in sets]).all()
            mine = np.split(tokens, np.cumsum(count)[:-1])
            df = Counter(tokens.tolist())
            part = min(1, J.REGIONS[order] * (100 - share) / 100) * 2**64
            first = [set(sorted(t.tolist(), key=lambda x: (x >= part, df[x] if x < part else 0, x))[: J.prefix_size(len(s), share)]) for s, t in zip(sets, mine)]
            assert all(first[a] & first[b] for a in range(len(sets)) for b in range(a) if linked(sets[a], sets[b], share))


def test_cells_connect_what_links_connect():
    r = np.random.default_rng(3)
    for trial in range(12):
        sets, share = random_sets(r, 50), (70, 80, 85)[trial % 3]
        links = [(a, b) for a in range(len(sets)) for b in range(a) if linked(sets[a], sets[b], share)]
        whole = np.ones(len(sets), bool)
        found = J.cell_links(sets, np.arange(len(sets)), whole, whole, share)
        assert all(linked(sets[a], sets[b], share) for a, b in found)
        assert least_reachable(range(len(sets)), found) == least_reachable(range(len(sets)), links)
        left = r.random(len(sets)) < 0.4
        found = J.cell_links(sets, np.arange(len(sets)), left, ~left, share)
        assert least_reachable(range(len(sets)), found) == least_reachable(range(len(sets)), [(a, b) for a, b in links if left[a] != left[b]])


def test_counts_of_tokens_over_batches(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(J, "COUNTED", 7)
    r = random.Random(4)
    for step in (1, 2, 5, 1000):
        rows = sorted((t, r.randrange(40), 10, 3) for t in [1] * 30 + [2] * 2 + [3] + [4] * 9 + [5] * 50 + [6] for _ in range(2))
        batches = [pa.RecordBatch.from_arrays([pa.array([x[c] for x in rows[k : k + step]], kind) for c, kind in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["token", "h", "n", "s"]) for k in range(0, len(rows), step)]
        got = [tuple(x.values()) for b in J._counted(iter(batches)) for x in b.to_pylist()]
        df = Counter(t for t, _ in {x[:2] for x in rows})
        assert sorted(got) == sorted((*x, min(7, df[x[0]])) for x in set(rows) if df[x[0]] > 1)


def test_join_in_blocks(spark, monkeypatch):
    """Large groups are cut into blocks, and what the first comparison left apart is compared with all blocks."""
    monkeypatch.setattr(J, "CELL_CLASSES", 7)
    r = random.Random(11)
    core = [f"w{k}" for k in range(100)]
    texts = drifting(r, 40, 80, 1) + [" ".join(w if r.random() > 0.02 else f"z{r.randrange(10**6)}" for w in core) for _ in range(50)] + ["few words only"] * 3
    r.shuffle(texts)
    rows = list(enumerate(texts))
    got = J.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(map(tuple, got), key=repr) == brute_join(rows)


def test_classes_with_equal_halves_of_keys_are_neighbours(spark):
    rows = spark.createDataFrame([(1, 10, 5, 1), (1, 11, 5, 1), (2, 12, 5, 1), (1, 13, 500, 1)], J.TOKENS)
    near = {x["h"]: x["c"] for x in J.neighbourhoods(rows, spark.createDataFrame([(11,), (12,)], "h long"), 85).collect()}
    assert near[10] == near[11] and near[12] == 12 and 13 not in near


def test_keys_of_sets():
    r = np.random.default_rng(5)
    sets = random_sets(r, 60) + [np.zeros(0, np.uint64)]
    keys = J.set_keys(sets)
    assert (keys[-1] == 0).all() and (keys[:-1, 0] > 0).all()
    assert (J.set_keys(sets[::-1])[::-1] == keys).all() and (J.set_keys([sets[3]])[0] == keys[3]).all()
    assert len({tuple(k) for k in keys.tolist()}) == len({s.tobytes() for s in sets})


# --- decontamination


def brute_overlaps(docs, items):
    plain = lambda t: re.findall(r"(?:[a-z0-9]|[^\x00-\x7f])+", (t or "").lower())
    by_text = {}
    for k, t in items:
        if t is not None:
            by_text[t] = min(k, by_text.get(t, k))
    out = set()
    for d, t in docs:
        w = plain(t)
        for text, k in by_text.items():
            q = plain(text)
            size = min(13, len(q))
            if size < 6:
                continue
            for shift in range(-len(q), len(w)):
                lo, hi = max(0, -shift), min(len(q), len(w) - shift)
                same = [w[i + shift] == q[i] for i in range(lo, hi)]
                if any(sum(same[i : i + size]) * 13 >= 10 * size for i in range(len(same) - size + 1)):
                    out.add((d, k))
                    break
    return out


def test_masks_hit_every_window():
    from itertools import combinations

    for gone in combinations(range(D.WINDOW), D.WINDOW - D.LEAST):
        assert any(not set(gone) & {p + o for o in m} for m in D.MASKS for p in range(D.WINDOW - m[-1]))


def test_overlaps_equal_brute_force(spark, odd):
    r = random.Random(8)
    items = [(k, " ".join(f"q{r.randrange(10**6)}" for _ in range(n))) for k, n in enumerate([40, 13, 20, 5, 14, 60])] + [(90, None), (91, ""), (7, "tie tie tie tie tie tie tie tie tie tie tie tie tie")]
    items.append((50, items[0][1]))
    docs = []
    for d in range(60):
        w = [f"x{r.randrange(10**6)}" for _ in range(r.randrange(0, 120))]
        k, t = r.choice(items[:6])
        q = t.split()
        lo = r.randrange(0, max(1, len(q) - 12))
        part = q[lo : lo + r.randrange(5, 30)]
        part = [("S" if r.random() < r.choice([0, 0.15, 0.3]) else "") + x.upper() + r.choice(["", ",", "!"]) for x in part]
        at = r.randrange(0, len(w) + 1)
        docs.append((d, " ".join(w[:at] + part + w[at:])))
    docs.append((100, "tie " * 40))
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]) for x in D.overlaps(df, bench).collect()}
    assert got == brute_overlaps(docs, items) and len(got) > 15
    assert D.overlaps(odd, bench).collect() == [] and D.overlaps(df.where("false"), bench).collect() == [] and D.overlaps(df, bench.where("false")).collect() == []
    old = D.MOST_FILTERED
    try:
        D.MOST_FILTERED = 0  # the way without a filter
        assert {(x["doc_id"], x["item_id"]) for x in D.overlaps(df, bench).collect()} == got
    finally:
        D.MOST_FILTERED = old


def test_op2_finds_whole_items_only_where_they_are(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF01}/documents.parquet").collect()}
    items = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{SF01}/benchmark.parquet").collect()}
    got = {(r["doc_id"], r["item_id"]) for r in op2_decontamination(spark, SF01).collect()}
    assert {(d, k) for d, t in docs.items() for k, q in items.items() if q in t} <= got
    assert all(len(set(docs[d].split()) & set(items[k].split())) >= 8 for d, k in got)


# --- fingerprints


def test_op4_equals_recomputation(spark, sf001):
    docs = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf001}/documents.parquet").collect())
    got = {r["doc_id"]: r for r in op4_fingerprints(spark, sf001).collect()}
    assert len(got) == len(docs)
    for (k, t), (_, after) in zip(docs, docs[1:] + docs[:1]):
        n = len(t) // 4
        edited = t[: len(t) - n] + after[:n]
        r = got[k]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (P.fingerprint(t), P.fingerprint(edited))
        assert r["near_edited"] == P.likeness(r["fingerprint"], r["edited_fingerprint"]) and r["near_next"] == P.likeness(r["fingerprint"], P.fingerprint(after))
        assert r["common_prefix"] == next((i for i, (a, b) in enumerate(zip(t, edited)) if a != b), min(len(t), len(edited)))


def test_spans_and_extensions():
    r = random.Random(9)
    a, b = ("".join(r.choice("abé\U0001f600") for _ in range(200)) for _ in range(2))
    b = b[:50] + a[20:120] + b[50:]
    x, y = P.prefix(P.codes(a)), P.prefix(P.codes(b))
    for _ in range(500):
        i, j, n = r.randrange(200), r.randrange(300), r.randrange(0, 40)
        if i + n <= len(a) and j + n <= len(b):
            assert P.span_equal(x, i, y, j, n) == (a[i : i + n] == b[j : j + n])
        k = 0
        while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
            k += 1
        assert P.common_extension(x, i, y, j) == k
    assert P.likeness(P.fingerprint(a), P.fingerprint(a)) == 1 and P.likeness(P.fingerprint(a * 3), P.fingerprint("other " * 100)) == 0
    assert P.fingerprint("") == P.fingerprint("") and P.likeness(P.fingerprint(""), P.fingerprint("a")) == 0


def test_likeness_has_no_border_in_length():
    r = random.Random(12)
    text = "".join(r.choice("abcdefghij ") for _ in range(200))
    before = 0.0
    for n in range(2, 200):
        near = P.likeness(P.fingerprint(text[:n]), P.fingerprint(text[: n - 1]))
        assert near > 0 and near >= before - 0.2 and (n < 30 or near > 0.6)
        before = near
    plain = lambda t: {(chr(0x10FFFF) * 11 + t + chr(0x10FFFF) * 11)[k : k + 12] for k in range(len(t) + 11)}
    for n in (1, 2, 5, 12, 18):  # so few spans are all in the sketch
        a, b = text[:n], text[n // 2 : n // 2 + n]
        both = plain(a) & plain(b)
        assert np.isclose(P.likeness(P.fingerprint(a), P.fingerprint(b)), 2 * len(both) / (len(plain(a)) + len(plain(b))), atol=0.1 if n > 14 else 1e-9)
        assert len(np.unique(P.grams(P.prefix(P.codes(a))))) == len(plain(a))


def test_fingerprints_of_odd_rows(spark, odd):
    rows = P.compare_with_next(odd).collect()
    assert len(rows) == odd.count() and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    assert P.compare_with_next(odd.where("false")).collect() == []
    one = P.compare_with_next(spark.createDataFrame([(1, "abcdefgh")], "doc_id long, text string")).first()
    assert one["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest() and one["near_next"] == 1


# --- classifiers


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


@pytest.mark.parametrize("query, target, cut, least", [(op3_quality, "quality", 0.5, 0.97), (op6_toxicity, "toxic", 0.7, 0.93)])
def test_classifiers_on_held_out_rows(spark, query, target, cut, least):
    d = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r[target] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    rows = query(spark, d).collect()
    assert all(r["held_out"] == held(r["doc_id"]) and r["predicted"] == int(r["score"] >= cut) and 0 <= r["score"] <= 1 for r in rows)
    mine = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert sum(a == b for a, b in mine) / len(mine) >= least
    assert sum(a and b for a, b in mine) / sum(b for _, b in mine) >= 0.7


def test_classifiers_with_odd_rows_and_without_labels(spark, odd, sf001):
    docs, labels = (spark.read.parquet(f"{sf001}/{n}.parquet") for n in ("documents", "labels"))
    machine, network = quality.fit_quality(docs, labels), toxicity.fit_toxicity(docs, labels)
    for rows in (quality.score_quality(odd, machine).collect(), toxicity.score_toxicity(odd, network).collect()):
        assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
        assert len({r["score"] for r in rows if r["doc_id"] == 1}) == 1
        assert not any(r["held_out"] for r in rows if r["doc_id"] is None)
    none = labels.where("false")
    assert quality.fit_quality(docs, none) is None and toxicity.fit_toxicity(docs, none) is None
    assert {r["score"] for r in quality.score_quality(odd, None).collect()} == {0.5} and {r["score"] for r in toxicity.score_toxicity(odd, None).collect()} == {0.0}
    assert quality.score_quality(odd.where("false"), machine).collect() == [] and toxicity.score_toxicity(odd.where("false"), network).collect() == []


def test_training_takes_no_held_out_row(spark, sf001):
    from codeloom.llm.labelled import sample

    docs, labels = (spark.read.parquet(f"{sf001}/{n}.parquet") for n in ("documents", "labels"))
    twice = labels.union(labels.limit(3).withColumn("quality", 1 - F.col("quality"))).union(spark.createDataFrame([(None, 1, 1)], labels.schema))
    got = sample(docs, twice, "quality", "doc_id", "text", 20).collect()
    assert 0 < len(got) <= 20 and not any(held(r["id"]) for r in got)


def test_ids_that_stand_many_times_count_once(spark):
    from codeloom.llm.labelled import sample

    docs = spark.createDataFrame([(k % 4, f"text {k % 4} {k % 3}") for k in range(10_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(4)], "doc_id long, quality int")
    got = sample(docs, labels, "quality", "doc_id", "text", 23).collect()
    assert sorted(r["id"] for r in got) == [k for k in range(4) if not held(k)] and all(r["text"].startswith(f"text {r['id']} ") for r in got)


def test_network_equals_a_plain_forward_pass(spark, sf001):
    """Embeddings, convolutions, k-max pooling and the score, word by word."""
    import pyarrow as pa

    docs, labels = (spark.read.parquet(f"{sf001}/{n}.parquet") for n in ("documents", "labels"))
    net = toxicity.fit_toxicity(docs, labels)
    texts = [r["text"] for r in docs.limit(25).collect()] + ["", "one"]
    raw, offsets = toxicity.lowered(pa.array(texts))
    fields, at = toxicity.word_fields(raw, offsets)
    lang, p = toxicity.languages(fields[:, 0], at), net.p
    row_of = {int(k): i for i, k in enumerate(net.keys.tolist()) if i}
    got = net.score(raw, offsets)
    for k in range(len(texts)):
        none = [0] * toxicity.FIELDS
        rows = [[row_of.get(int(f), 0) for f in word] for word in fields[at[k] : at[k + 1]]]
        total = p["bias"][0]
        for c, w in enumerate(toxicity.WIDTHS):
            line = [none] * w + rows + [none] * w
            windows = [line[i : i + w] for i in range(len(line) - w + 1)]
            windows = [x for x in windows if any(map(any, x))] + [[none] * w]
            response = [np.maximum(0, sum(sum(p["E"][r] for r in x[j]) @ p[f"W{w}"][j] for j in range(w)) + p[f"b{w}"]) for x in windows]
            response += [response[-1]] * max(0, toxicity.TOP - len(response))
            best = [sorted((r[f] for r in response), reverse=True)[: toxicity.TOP] for f in range(toxicity.FILTERS)]
            weights = p["out"].reshape(len(toxicity.WIDTHS), toxicity.TOP, toxicity.FILTERS)[c]
            total += sum(best[f][t] * weights[t, f] for f in range(toxicity.FILTERS) for t in range(toxicity.TOP))
        assert np.isclose(got[k], 1 / (1 + np.exp(-np.clip(total - net.cut[lang[k]] + np.log(0.7 / 0.3), -30, 30))))
    # Keys that share a slot are all found.
    keys = np.array([5, 5 + toxicity.SLOTS, 5 + 2 * toxicity.SLOTS, 9], np.uint64)
    small = toxicity.Network(keys)
    assert small.rows(np.array([*keys.tolist(), 5 + 3 * toxicity.SLOTS, 7], np.uint64)).tolist() == [1, 2, 3, 4, 0, 0]


def test_factorisation_identity():
    r = np.random.default_rng(2)
    m = quality.Machine(0.3, r.normal(size=quality.BUCKETS + quality.STATS), r.normal(size=(quality.BUCKETS + quality.STATS, quality.RANK)), np.zeros(quality.STATS), np.ones(quality.STATS))
    index, x = np.array([5, 9, 40, 7, 8]), r.normal(size=5)
    got = m.margin(index, x, np.array([0, 3]))[0]
    for part, want in ((slice(0, 3), got[0]), (slice(3, 5), got[1])):
        i, v = index[part], x[part]
        pairs = sum(m.factors[i[a]] @ m.factors[i[b]] * v[a] * v[b] for a in range(len(i)) for b in range(a))
        assert np.isclose(0.3 + (m.weights[i] * v).sum() + pairs, want)
