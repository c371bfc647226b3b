import time
from collections import defaultdict

from pyspark.sql import functions as F

from codeloom.llm import html_text as T


def test_copies_nested_blocks_and_large_hosts(spark):
    copies = [(k, "http://a.org/", "<html><body><div>All the text</div></body></html>") for k in range(20)]
    nested = [(100 + k, f"http://b.org/{k}", f"<article><div><div><p>Shared</p></div></div><table><tr><td><div>Cell</div></td></tr></table><p>{k}</p></article>") for k in range(12)]
    box = "<div class='box'><span>Section menu</span></div>"
    large = [(1000 + k, f"http://c.org/{k}", f"<body>{box if k < 200 else ''}<div>Only {k}</div></body>") for k in range(1000)]
    df = spark.createDataFrame(copies + nested + large, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in T.extract_text(df).collect()}
    assert {got[k] for k, *_ in copies} == {"All the text"}
    assert [got[100 + k] for k in range(12)] == [f"Shared\n\nCell\n\n{k}" for k in range(12)]
    assert [got[1000 + k] for k in range(1000)] == [f"Only {k}" for k in range(1000)]


def test_templates_decide_and_only_they_take_unnamed_boxes(spark):
    boxes = [f"<div class='box'>Offer {k}</div>" for k in range(4)]
    pages = [(k, f"http://a.org/{k}", f"<article><h2>Title {k}</h2>{boxes[k % 4]}<div class='lead'>Lead {k}</div><div class='lead'><p>More {k}</p></div><p>Shared words</p></article>") for k in range(60)]
    pages += [(100 + k, f"http://b.org/{k}", f"<article><div class='frame'><p>Join us today</p></div><p>Only {k}</p></article>") for k in range(12)]
    pages += [(200 + k, f"http://few.org/{k}", f"<article>{boxes[0]}<p>{k}</p></article>") for k in range(9)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    got = {r["page_id"]: r["text"] for r in T.extract_text(df).collect()}
    assert all(got[k] == f"Title {k}\n\nLead {k}\n\nMore {k}\n\nShared words" for k in range(60))
    assert all(got[100 + k] == f"Only {k}" for k in range(12)) and all(got[200 + k] == f"Offer 0\n\n{k}" for k in range(9))
    off = {r["page_id"]: r["text"] for r in T.extract_text(df, templates=spark.createDataFrame([], "host long, template long")).collect()}
    assert off[0].startswith("Title 0\n\nOffer 0\n\nLead 0") and off[100] == "Join us today\n\nOnly 0"


def test_template_counts_equal_brute_force(spark, sf001, monkeypatch):
    pages = spark.read.parquet(f"{sf001}/pages.parquet").withColumn("url", F.concat(F.lit("http://one.org/"), F.col("page_id")))
    found = {r["template"] for r in T.site_templates(pages).collect()}
    on, texts, distinct = defaultdict(set), defaultdict(set), set()
    for r in pages.collect():
        distinct.add(r["html"])
        for h, shape in T.subtree_hashes(r["html"]):
            on[h].add(r["html"])
            if shape is not None:
                on[shape].add(r["html"])
                texts[shape].add(h)
    many = lambda n: n >= 10 and (n >= 0.3 * len(distinct) or n >= 200)
    assert found == {h for h, ps in on.items() if many(len(ps)) and (h not in texts or len(texts[h]) <= 0.1 * len(ps))}
    monkeypatch.setattr(T, "SENT", 0)  # the join instead
    box = "<div class='box'><span>Menu</span></div>"
    df = spark.createDataFrame([(k, f"http://{'ab'[k % 2]}.org/{k}", f"<body>{box if k % 2 else ''}<div>Only {k}</div></body>") for k in range(30)], "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in T.extract_text(df).collect()} == {k: f"Only {k}" for k in range(30)}


def test_deep_nesting_takes_linear_time():
    for inner in ("<div>", "<object><p>", "<li>", "<table><td>", "<p><object><div>"):
        began = time.perf_counter()
        T.main_text("<article>" + inner * 20_000 + "deep")
        assert time.perf_counter() - began < 6
