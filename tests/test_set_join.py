"""Pairs of word sets against brute force, with hits counted and large components in cells."""

import random

from codeloom.operators import search as S
from codeloom.operators import set_join as J
from codeloom.queries import catalogue

QUERIES = catalogue()[0]


def _texts(r):
    base = [[f"w{r.randrange(3000)}" for _ in range(n)] for n in (3, 6, 9, 40, 200) for _ in range(6)]
    out = [b[:] for b in base]
    for b in base * 4:
        out.append([w if r.random() > 0.12 else f"w{r.randrange(3000)}" for w in b] + [f"w{r.randrange(3000)}" for _ in range(r.randrange(1 + len(b) // 4))])
    return [" ".join(x) for x in out + out[:20]]


def _want(texts):
    sets = [frozenset(w for w in t.split() if len(w) >= 3) for t in texts]
    return {(a, b, len(x & y) / len(x | y)) for a, x in enumerate(sets) for b, y in enumerate(sets) if a < b and x and y and 10 * len(x & y) >= 7 * len(x | y)}


def test_pairs_are_those_of_brute_force_also_in_cells(spark, monkeypatch):
    texts = _texts(random.Random(7))
    df = spark.createDataFrame([*enumerate(texts), (900, ""), (None, texts[0])], "id long, body string")
    want = _want(texts)
    assert {tuple(x) for x in S.jaccard_pairs(df).collect()} == want and len(want) > 100
    monkeypatch.setattr(J, "CELL_CLASSES", 3)
    rows = [tuple(x) for x in S.jaccard_pairs(df).collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_few_pairs_of_sets_are_candidates(spark):
    """Sets of common words share words of their prefixes, but only near ones are compared; before, every such pair was."""
    r = random.Random(3)
    texts = [" ".join(r.sample([f"word{k}" for k in range(400)], 60)) for _ in range(300)]
    texts.append(texts[0] + " other")
    sets = J.hashed(S.token_sets(spark.createDataFrame(list(enumerate(texts)), "id long, body string")))
    rows = sets.join(J.classes(sets)[1].drop("n"), ["id", "k1"]).select("no", "words")
    assert 1 <= J.candidates(rows, 0.7).count() < 300


def test_similarity_edges_are_both_directions_without_joins_of_words(spark, sf001):
    """Before, the plan exploded all words into rows and joined them with themselves."""
    df = QUERIES["similarity_edges"](spark, sf001)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(tokens" not in plan and "array_intersect" not in plan
    rows = [tuple(x) for x in df.collect()]
    assert rows and len(set(rows)) == len(rows) and {(b, a, j) for a, b, j in rows} == set(rows)


def test_minhash_pairs_ship_no_words_by_pair(spark, sf001):
    """Before, words of both sets went to every candidate pair, and copies of a text to every salt."""
    df = QUERIES["minhash_pairs"](spark, sf001)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "array_intersect" not in plan and "explode" not in plan.lower()


def test_minhash_finds_pairs_of_brute_force_and_a_class_for_each_row(spark, monkeypatch):
    texts = _texts(random.Random(8))
    df = spark.createDataFrame([*enumerate(texts), (900, ""), (None, texts[0]), (901, None)], "id long, body string")
    monkeypatch.setattr(J, "STEP", 50)
    pairs, members = S.minhash_classes(df)
    of = [tuple(x) for x in members.collect()]
    first = {}
    for i, t in enumerate(texts):
        first.setdefault(frozenset(t.split()), i)
    assert sorted(of, key=str) == sorted([*((i, first[frozenset(t.split())]) for i, t in enumerate(texts)), (900, 900), (None, 0), (901, 901)], key=str)
    want = {x for x in _want(texts) if first[frozenset(texts[x[0]].split())] == x[0] and first[frozenset(texts[x[1]].split())] == x[1]}
    got = [tuple(x) for x in pairs.collect()]
    assert len(set(got)) == len(got) and set(got) <= want and len(got) >= 0.99 * len(want) > 50


def test_links_of_a_band_join_what_its_pairs_join(spark):
    """A group of near sets gives a link a set, not its pairs."""
    r = random.Random(6)
    base = r.sample(range(10**6), 100)
    sets = [(k, 100, sorted({*base[: 100 - k % 7], *(10**7 + 100 * k + j for j in range(k % 7))})) for k in range(120)]
    rows = spark.createDataFrame(sets, "no long, n int, words array<long>")
    links = [tuple(x) for x in J.minhash_links(rows, 0.7, 128, 4).collect()]
    joined = J.components(spark.createDataFrame(links, "u long, v long")).collect()
    assert len(links) < 120 * 32 and {x["no"] for x in joined} == set(range(120)) and {x["c"] for x in joined} == {0}


def test_pairs_of_words_find_what_bands_miss(spark, monkeypatch):
    """Exact also without any link of a band, for sets of all sizes and for other bounds; before, single words were counted."""
    none = lambda rows, *_: rows.sparkSession.createDataFrame([], "u long, v long")
    monkeypatch.setattr(J, "minhash_links", none)
    texts = _texts(random.Random(9))
    df = spark.createDataFrame([*enumerate(texts)], "id long, body string")
    assert {tuple(x) for x in S.jaccard_pairs(df).collect()} == _want(texts)
    sets = [frozenset(w for w in t.split() if len(w) >= 3) for t in texts]
    for least in (4, 9):
        want = {(a, b) for a, x in enumerate(sets) for b, y in enumerate(sets) if a < b and 10 * len(x & y) >= least * len(x | y)}
        assert {(x["a"], x["b"]) for x in S.jaccard_pairs(df, least / 10).collect()} == want


def test_near_sets_and_sets_of_common_words_make_few_hits(spark):
    """Before, each word of their prefixes that near sets share, and that unrelated sets share, made a hit: 32 of each of the 900 near pairs alone."""
    r = random.Random(11)
    base = [r.sample(range(3000), 80) for _ in range(150)]
    sets = [(10 * k + c, sorted({w * 7919 for w in b[c:]}), k) for k, b in enumerate(base) for c in range(4)]
    rows = spark.createDataFrame(sets, "no long, words array<long>, c long")
    found = J.components(J.candidates(rows, 0.7)).collect()
    assert {x["no"]: x["c"] for x in found} == {no: no // 10 * 10 for no, _, _ in sets}
    size = spark.sparkContext.broadcast(J.counts(rows))
    keyed = rows.mapInArrow(J._prefixes(size, 0.7), "key long, size long, no long, c long").repartition(4, "key").sortWithinPartitions("key", "size")
    assert keyed.mapInArrow(J._hits(0.7), "pair long, weight int").count() < 4 * len(sets)
