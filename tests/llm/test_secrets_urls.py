import hashlib
import random
import re
import string

import duckdb

from codeloom.llm import secret_scans as S
from codeloom.llm.queries import OP10_SQL, RULES, op9_secret_scans, op10_url_filters
from codeloom.llm.url_filters import judge_urls


def brute(text):
    """The base kinds straight from their statement."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.A | re.I) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def test_base_spans_equal_brute_force(spark):
    sf001 = "/root/testdata/sf0.01"
    want = {r["doc_id"]: brute(r["text"] or "") for r in spark.read.parquet(f"{sf001}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in op9_secret_scans(spark, sf001).collect()}
    assert got.keys() == want.keys() and any(want.values())
    for k, spans in want.items():
        named = ",".join(f"{S.KINDS[k]}:{s}:{e}" for s, k, e in spans)
        assert got[k]["base_sha256"] == hashlib.sha256(named.encode()).hexdigest()
        assert set(filter(None, named.split(","))) <= set(got[k]["spans"].split(","))
        assert [got[k][n] for n in ("n_assign", "n_access", "n_hex")] == [sum(x[1] == i for x in spans) for i in range(3)]


def test_odd_rows_and_failing_matches(spark, odd):
    got = S.scan_secrets(odd).collect()
    assert len(got) == odd.count()
    assert S.scan_secrets(odd.where("false")).collect() == []
    text = 'secret=token = abcdef123 API_KEY: "zzzzzz" PASSWORD=abc \u017fecret=abcdefgh \u00e9 token="' + "a1" * 12 + '" AKIA' + "A" * 15 + " AKIA" + "B" * 16
    rows = spark.createDataFrame([(1, text), (2, "ab" * 11), (3, "ab" * 12)], "doc_id long, text string")
    for r in S.scan_secrets(rows).collect():
        want = brute({1: text, 2: "ab" * 11, 3: "ab" * 12}[r["doc_id"]])
        assert [(s["start"], s["kind"], s["end"]) for s in r["base"]] == want


def test_the_battery_adds_random_runs_and_leaves_words(spark):
    rng = random.Random(3)
    key = "".join(rng.choice(string.ascii_letters + string.digits) for _ in range(40))
    rows = [(0, f"see {key} there"), (1, "z" * 40), (2, "abcdefghijklmnopqrstuvwxyz" * 2), (3, "internationalization_of_everything_and_more")]
    got = {r["doc_id"]: [(s["start"], s["kind"], s["end"]) for s in r["spans"]] for r in S.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: [(4, 3, 44)], 1: [], 2: [], 3: []}


def test_recall_and_precision_on_planted_keys(spark, sf001):
    """Random keys of several encodings and lengths among whole documents, and runs that aren't random."""
    rng, hexes = random.Random(21), "0123456789ABCDEF"
    kinds = [string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits + "-_", hexes, string.ascii_uppercase + "234567"]
    words = "configuration transformation international responsibility Documentation Understanding characteristics".split()
    rows, keys, other = [], set(), set()
    for k in range(400):
        key = "".join(rng.choice(kinds[k % 5]) for _ in range(rng.choice([24, 32, 40, 48, 64])))
        keys.add(key)
        rows.append((10**6 + k, f"the value {key} stands here"))
        run = rng.choice(["_".join(rng.choices(words, k=3)), "".join(rng.choices(words, k=3)), rng.choice("=-_") * rng.randrange(20, 80), "ab1" * rng.randrange(8, 20), "/usr/share/documentation/" + rng.choice(words)])
        other.add(run)
        rows.append((2 * 10**6 + k, f"the name {run} stands here"))
    docs = spark.read.parquet(f"{sf001}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    found = {r["doc_id"]: {text[r["doc_id"]][s["start"] : s["end"]] for s in r["spans"] if s["kind"] == 3} for r in S.scan_secrets(docs).collect()}
    planted = [key for k, t in rows if k < 2 * 10**6 for key in keys if f" {key} " in t and not brute(t)]
    caught = sum(key in found[k] for k, t in rows if k < 2 * 10**6 for key in [t.split()[2]] if not brute(t))
    wrong = sum(bool(found[k]) for k, _ in rows if k >= 2 * 10**6)
    assert caught >= 0.9 * len(planted) and wrong <= 0.03 * 400, (caught, len(planted), wrong)


def test_thresholds_are_benjamini_hochberg():
    counts = {(0, 0): 90, (0, 10): 5, (0, 20): 5}
    # 10 of 100 have p <= 10**-2.5: rejected at rate 0.05 (0.0032 <= 0.005), only the other 5 (p = 10**-5) at 0.01
    assert S.thresholds(counts, 0.05)[0] == 10 and S.thresholds(counts, 0.01)[0] == 14
    assert S.thresholds({}, 0.01) == [S.BINS] * len(S.BANDS)


PAGES = [
    (1, "http://a.example.com/x", '<link rel="canonical" href="http://b.example.net/y">'),
    (2, "http://b.example.net/y", ""),
    (3, "http://c.example.com/z", '<meta http-equiv="refresh" content="0; url=http://a.example.com/x">'),
    (4, "http://d.example.com/1", "<LINK HREF='http://www.example.net/en/ok' REL=canonical>"),
    (5, "http://e.example.com/2", '<link rel=canonical href="http://d.example.com/1"><link rel=canonical href="http://q.net/">'),
    (6, "https://SUB.Example.NET/en/p?q#f", None),
    (7, "https://org/fr/a", ""),
    (8, "nothing", ""),
    (9, None, None),
    (10, "", "<p>"),
    (11, "x://", ""),
    (11, "x://", ""),
    (12, "http://example.com/de/1?a://b", ""),
    (13, "http://notexample.com/de/1", ""),
    (14, "http://İ.org/fr/", ""),
    (15, "http://example.com/a/b/page?q#f", "<link rel='alternate canonical' href='../../de/x'>"),
    (16, "http://r.example.org/s/t", '<link rel=canonical href="//m.example.com/de/y?a=1&#38;b=2&amp;lt;">'),
    (17, "http://m.example.com/de/y?a=1&b=2&lt;", ""),
    (18, "http://n.example.com", '<meta http-equiv="refresh" content="0; url=./de/z">'),
    (19, "http://example.com/de/", '<link rel="canonical" href="?page=2"><link rel="non-canonical" href="/fr">'),
    (20, "http://example.com/fr", "<link rel=canonical href=/de/w><link rel=canonical href=mailto:x><link rel=canonical href=#top>"),
    (21, "http://example.com/u/v", "<link rel='canonical' href='w'>"),
    (22, "http://example.com/u/w", "<link rel='canonical' href='http://a.example.net/q'>"),
]


def test_url_filters_equal_sql_and_expectation(spark):
    pages = spark.createDataFrame([(*p, "extra", "h", "block") for p in PAGES], "page_id long, url string, html string, rule string, host string, verdict string")
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    got = judge_urls(pages, rules).toPandas()
    con = duckdb.connect()
    con.register("pages", pages.toPandas())
    want = con.execute(OP10_SQL).df()
    key = ["page_id", "host", "path", "rule", "verdict"]
    order = lambda d: sorted(map(repr, d[key].astype(object).where(d[key].notna(), None).values.tolist()))
    assert order(got) == order(want)
    verdict = dict(zip(got.page_id, got.verdict))
    assert [verdict[i] for i in (15, 16, 17, 18, 19, 20, 21, 22)] == ["block"] * 8
    assert [verdict[i] for i in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14)] == ["block", "block", "block", "allow", "allow", "allow", "allow", "allow", "allow", "allow", "allow", "block", "allow", "allow"]
    assert judge_urls(pages.where("false"), rules).collect() == []


def test_op10_whole_table(spark, sf001):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{sf001}/pages.parquet'")
    assert sorted(map(tuple, op10_url_filters(spark, sf001).collect()), key=repr) == sorted(con.execute(OP10_SQL).fetchall(), key=repr)
