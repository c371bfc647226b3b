import re
from html import unescape

from codeloom.llm import html_text as T
from codeloom.llm.queries import op7_html_text

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style></head><body class="home">
<header><h1>Site</h1></header><nav><ul><li>Home<li>About</ul></nav><div class="cookie-notice">We use cookies</div>
<div id="main-column"><article class="post"><h1>Title &amp; more</h1><p>One<br>two &nbsp; three<p>Four &lt;b&gt; <b>bold</b> tail
<ul><li>first<li>second</ul><aside>side</aside><div class="ad">buy</div><script>var t="</p>";</script><!-- c -- > -->
<form><input value="x>y"><button>Go</button></form><pre>a
 b</pre><footer>by me</footer><section class="comments"><p>nice</p></section></article></div>
<div class="sidebar"><p>links</p></div><footer>&copy; x</footer></body></html>"""


def test_article_text():
    assert T.main_text(PAGE) == "Title & more\n\nOne two three\n\nFour <b> bold tail\n\nfirst\n\nsecond\n\na b"


def test_odd_markup():
    assert T.main_text("") == "" and T.main_text("just text") == "just text" and T.main_text("<p>a<p>b</div>c") == "a\n\nbc"
    assert T.main_text("<article>x &am y &amp z < 3 <b a='1>2'>q</article>") == "x &am y & z < 3 q"
    assert T.main_text("<article><p>" * 3000 + "deep") == "deep"
    assert T.main_text("<article><p>open <a href=\"x>text</p><p>next</p></article>").startswith("open")
    assert T.main_text("<script>never ends <p>x</p>") == "" and T.main_text("<main><p>m</p></main><p>out</p>") == "m"
    assert T.main_text("<article><p>" + "long " * 200_000) == ("long " * 200_000).strip()


def test_templates_go_and_articles_stay(spark):
    box = "<div class='box'><div><span>Follow us everywhere</span></div></div>"
    pages = [(k, f"http://a.org/{k}", f"<body>{box}<div>Only {k}</div></body>", "x") for k in range(12)]
    pages += [(k, f"http://b.org/{k}", f"<body><div>Read more</div><article><p>The same passage</p><p>{k}</p></article></body>", "x") for k in range(12, 24)]
    pages += [(30, None, None, "x"), (31, "", "", "x"), (31, "", "", "x"), (32, "http://c.org/", box, "x")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in T.extract_text(df).collect()}
    assert [got[k]["text"] for k in range(12)] == [f"Only {k}" for k in range(12)]
    assert [got[k]["text"] for k in range(12, 24)] == [f"The same passage\n\n{k}" for k in range(12, 24)]
    assert got[30]["text"] == got[31]["text"] == "" and got[32]["text"] == "Follow us everywhere"
    assert all(r["n_chars"] == len(r["text"]) for r in got.values()) and T.extract_text(df).count() == len(pages)
    assert T.extract_text(df.where("false")).collect() == []


def test_op7_equals_the_articles(spark, sf001):
    want = {}
    for r in spark.read.parquet(f"{sf001}/pages.parquet").collect():
        body = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        blocks = [" ".join(unescape(re.sub(r"<[^<>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        want[r["page_id"]] = "\n\n".join(b for b in blocks if b)
    assert {r["page_id"]: r["text"] for r in op7_html_text(spark, sf001).collect()} == want


def test_lookups_by_broadcast_and_by_salts_agree(spark):
    from codeloom.llm.common import looked_up

    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"h{i}", f"u{i}") for i in range(90)] + [(99, None, None)], "id long, host string, url string")
    lookup = spark.createDataFrame([("hot", 1), ("h3", 2), ("h9", 3)], "host string, x long")
    a, b = (looked_up(rows, lookup, "host", "url", most).select("id", "host", "x") for most in (10, 0))
    assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr) and a.count() == 91
