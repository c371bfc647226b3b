"""Operator 7: main text of web pages, with site templates removed.

A page becomes a tree of elements. What HTML or its marks name as no main text (menus, page headers, footers, forms, scripts, ...) goes
by tag, role, or class and id words. Unnamed boxes are found by recurrence: block subtrees get two hashes, one of
tags, class, id and text, one of the same without text. Spark counts, for each host, the distinct pages of each (copies of a page
count once). A subtree whose text recurs on many pages of its host is deleted. So is one whose structure
recurs while its texts come from a small set (rotating adverts, a menu for each section); that rule only takes elements with a class or id that hold
no prose. In an article, elements without class and id that hold a text block stay, as does what is inside a text
block, for articles may share passages. Html, body, and what holds a root are never deleted.

The main text is that of the page's articles, else of its main element, else of its body.

Cases: null and empty html give the empty string; unclosed tags close as in browsers; a url without host belongs to the
host ''; very long and deeply nested pages are read whole, in time linear in their length; equal rows each give a row; an empty table gives an
empty result; only the id, url and html columns are read.
"""

from __future__ import annotations

import hashlib
import html as H
import re
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship, written
from .common import looked_up, pieces
from .url_filters import host_of

#: A comment, declaration, or tag with quoted attribute values; last a tag with an unpaired quote.
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)([^>"']*(?:(?:"[^"]*"|'[^']*')[^>"']*)*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""")
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:[\s/=]|$)""", re.I)
#: Fixed values of HTML: elements without content, with raw content, that end a paragraph, and that end their like.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body center details dialog dd dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption legend head title".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Elements and marks that never hold main text.
DROPPED = frozenset("script style noscript template nav footer aside form iframe svg math button select textarea input head title object embed canvas audio video dialog menu noembed noframes datalist".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar alertdialog toolbar".split())
MARKS = frozenset("ad ads advert adverts advertisement sponsor sponsored banner cookie cookies consent notice notices sidebar comment comments reply share related newsletter breadcrumbs menu nav navbar footer popup".split())
#: Text blocks, which templates don't take from an article; prose, which keeps an element from the rule about structure.
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote li dt dd td th figcaption".split())
PROSE = TEXT - frozenset("li dt dd td th".split())
#: What ends the search for an open paragraph.
SCOPE = ("td", "th", "table", "button", "object", "caption")


class Node:
    __slots__ = ("tag", "attributes", "children", "hash", "shape", "dropped")

    def __init__(self, tag: str, attributes: str):
        self.tag, self.attributes, self.children, self.hash, self.shape = tag, attributes, [], None, None
        self.dropped = tag in DROPPED
        if attributes and not self.dropped:
            found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
            words = set(re.split(r"[\s_-]+", f"{found.get('class', '')} {found.get('id', '')}".lower()))
            self.dropped = bool(tag not in ("html", "body", "article", "main") and words & MARKS or "article" in (tag,) and words & {"comment", "comments", "reply"} or found.get("role", "").lower() in ROLES or found.get("aria-hidden") == "true" or HIDDEN.search(ATTRIBUTE.sub(" ", attributes)))
            self.attributes = f"{found.get('class', '')}|{found.get('id', '')}"


def parsed(page: str) -> Node:
    root = Node("#root", "")
    stack, at, n = [root], 0, len(page)
    where: dict[str, list[int]] = {}  # the places of open tags in the stack

    def last(tags) -> int:
        return max((where[t][-1] for t in tags if where.get(t)), default=0)

    def close(to: int):
        for node in stack[to:]:
            where[node.tag].pop()
        del stack[to:]

    while at < n:
        m = TOKEN.search(page, at)
        if not m:
            stack[-1].children.append(page[at:])
            break
        if m.start() > at:
            stack[-1].children.append(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            if where.get(tag):
                close(where[tag][-1])
            continue
        if tag in ENDS_P and where.get("p") and where["p"][-1] > last(SCOPE):
            close(where["p"][-1])
        if tag in ENDS:
            own, scope = ENDS[tag]
            border = last(scope)
            first = min((where[t][k] for t in own if (k := bisect_right(where.get(t, ()), border)) < len(where.get(t, ()))), default=0)
            if first:
                close(first)
        attributes = m[3] if m[2] else m[6]
        node = Node(tag, attributes)
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            node.children.append(page[at : end.start() if end else n])
            at = end.end() if end else n
        elif tag not in VOID and not (attributes.endswith("/") and tag in ("path", "circle", "rect", "use")):  # else HTML ignores the slash
            where.setdefault(tag, []).append(len(stack))
            stack.append(node)
    return root


def postorder(root: Node) -> list[Node]:
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(c for c in node.children if isinstance(c, Node))
    return out[::-1]


def hashed(root: Node) -> None:
    """Give every node the hash of its subtree, and that of its structure, in which equal neighbours are one."""
    for node in postorder(root):
        own = f"{node.tag}|{node.attributes if '=' not in node.attributes else ''}".encode("utf-8", "replace")
        h, shape, before = hashlib.blake2b(own, digest_size=8), hashlib.blake2b(own, digest_size=8, person=b"shape"), None
        for c in node.children:
            h.update(c.hash if isinstance(c, Node) else b"t" + " ".join(c.split()).encode("utf-8", "replace"))
            if isinstance(c, Node) and c.shape != before:
                shape.update(c.shape)
                before = c.shape
        node.hash, node.shape = h.digest(), shape.digest()


def roots(tree: Node) -> list[Node]:
    """The outermost articles that aren't dropped, else the main elements, else the whole."""
    for wanted in ("article", "main"):
        found, stack = [], [tree]
        while stack:
            node = stack.pop()
            if node.dropped and node.tag != "header":
                continue
            if node.tag == wanted:
                found.append(node)
                continue
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))
        if found:
            return found
    return [tree]


def removable(tree: Node) -> list[tuple[Node, bool]]:
    """Block elements that templates may take, and whether by their structure too."""
    tops = roots(tree)
    plain = tops == [tree]
    out, stack = [], [(tree, False, False)]
    kept = set(map(id, tops))
    holds, texts, prose = set(kept), set(), set()
    for node in postorder(tree):
        inner = [id(c) for c in node.children if isinstance(c, Node)]
        for marks, tags in ((holds, ()), (texts, TEXT), (prose, PROSE)):
            if node.tag in tags or any(c in marks for c in inner):
                marks.add(id(node))
    while stack:
        node, inside, within = stack.pop()
        inside = inside or (id(node) in kept and not plain)
        within = within or (inside and node.tag in TEXT)
        named = any(c not in "| " for c in node.attributes) and not within
        if id(node) not in holds and node.tag in BLOCK and node.tag not in ("html", "body") and not within and (named or not (inside and id(node) in texts)):
            out.append((node, named and id(node) not in prose))
        stack.extend((c, inside, within) for c in node.children if isinstance(c, Node))
    return out


def _number(h: bytes) -> int:
    return int.from_bytes(h, "big", signed=True)


def subtree_hashes(page: str) -> set[tuple[int, int | None]]:
    """(hash, that of the structure where that may decide) of what templates may take."""
    tree = parsed(page)
    hashed(tree)
    return {(_number(n.hash), _number(n.shape) if by_shape else None) for n, by_shape in removable(tree) if n.children}


def main_text(page: str, templates: frozenset[int] = frozenset()) -> str:
    tree = parsed(page)
    gone: set[int] = set()
    if templates:
        hashed(tree)
        gone = {id(n) for n, by_shape in removable(tree) if _number(n.hash) in templates or by_shape and _number(n.shape) in templates}
    blocks, now = [], []

    def flush():
        text = " ".join("".join(now).split())
        if text:
            blocks.append(text)
        now.clear()

    for top in roots(tree):
        article = top.tag in ("article", "main")
        stack: list = [top]
        while stack:
            item = stack.pop()
            if item is None:
                flush()
            elif isinstance(item, str):
                now.append(H.unescape(item) if "&" in item else item)
            elif item.dropped or id(item) in gone or (item.tag == "header" and not article):
                if item.tag in BLOCK:
                    flush()
            elif item.tag == "br":
                now.append(" ")
            else:
                block = item.tag in BLOCK
                if block:
                    flush()
                    stack.append(None)
                stack.extend(reversed(item.children))
        flush()
    return "\n\n".join(blocks)


def _hashes(batches):
    for batch in batches:
        for part in pieces(batch, "html"):
            hosts, keys, hashes, shapes = [], [], [], []
            for host, page, key in zip(*(part.column(i).to_pylist() for i in range(3))):
                mine = subtree_hashes(page or "")
                hosts += [host] * len(mine)
                keys += [key] * len(mine)
                hashes += [h for h, _ in mine]
                shapes += [s for _, s in mine]
            yield pa.record_batch([pa.array(x, pa.int64()) for x in (hosts, keys, hashes, shapes)], ["host", "key", "hash", "shape"])


def site_templates(pages: DataFrame, url_col: str = "url", html_col: str = "html", least_pages: int = 10, share: float = 0.3, enough_pages: int = 200, variety: float = 0.1) -> DataFrame:
    """(host, template): a host's hash (xxhash64) and a hash of subtrees on `share` of its distinct pages and `least_pages` at least, or on
    `enough_pages`; or of structures on so many pages, with at most `variety` different subtrees a page."""
    ship(pages.sparkSession)
    slim = pages.select(F.xxhash64(host_of(F.col(url_col))).alias("host"), F.col(html_col).alias("html"), F.xxhash64(html_col).alias("key"))
    seen = written(slim.mapInArrow(_hashes, "host long, key long, hash long, shape long").distinct(), "subtrees")
    n = F.count(F.lit(1))
    exact = seen.groupBy("host", "hash", "shape").agg(n.alias("n"))
    texts = exact.where("shape is not null").groupBy("host", "shape").agg(n.alias("texts"))
    shapes = seen.where("shape is not null").groupBy("host", "shape", "key").agg(n.alias("_")).groupBy("host", "shape").agg(n.alias("n"))
    shapes = shapes.join(texts, ["host", "shape"]).where(F.col("texts") <= variety * F.col("n"))
    found = exact.select("host", F.col("hash").alias("template"), "n").union(shapes.select("host", F.col("shape").alias("template"), "n")).where(F.col("n") >= least_pages)
    sizes = slim.select("host", "key").distinct().groupBy("host").agg(n.alias("pages"))
    return found.join(sizes, "host").where((F.col("n") >= share * F.col("pages")) | (F.col("n") >= enough_pages)).select("host", "template").distinct()


#: Templates, two numbers each, that are sent to the workers at most; more are joined.
SENT = 500_000


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", templates: DataFrame | None = None) -> DataFrame:
    """One row per page: the id, url, text and n_chars."""
    spark = pages.sparkSession
    ship(spark)
    kind = pages.schema[id_col].dataType.simpleString()
    templates = site_templates(pages, url_col, html_col) if templates is None else templates
    slim = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.xxhash64(host_of(F.col(url_col))).alias("host"), F.col(html_col).alias("html"))
    known, sent = written(templates.select("host", "template"), "templates"), None
    if known.count() <= SENT:
        rows = known.toPandas().sort_values("host")
        sent = spark.sparkContext.broadcast((rows["host"].to_numpy(np.int64), rows["template"].to_numpy(np.int64)))
        slim = slim.withColumn("templates", F.lit(None).cast("array<long>"))
    else:
        slim = looked_up(slim, known.groupBy("host").agg(F.collect_list("template").alias("templates")), "host", "url", 0)

    def run(batches):
        own: dict[int, frozenset[int]] = {}

        def of(host: int, joined) -> frozenset[int]:
            if sent is None:
                return frozenset(joined or ())
            if host not in own:
                if len(own) > 1000:
                    own.clear()
                hosts, values = sent.value
                own[host] = frozenset(values[np.searchsorted(hosts, host) : np.searchsorted(hosts, host, side="right")].tolist())
            return own[host]

        for batch in batches:
            for part in pieces(batch, "html"):
                texts = [main_text(page or "", of(host, joined)) for host, page, joined in zip(*(part.column(i).to_pylist() for i in (2, 3, 4)))]
                yield pa.record_batch([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["id", "url", "text", "n_chars"])

    out = slim.select("id", "url", "host", "html", "templates").mapInArrow(run, f"id {kind}, url string, text string, n_chars long")
    return out.withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)
