"""HTML extraction: the article of a page, without the site's template.

1. Each page is read into a tree of its block elements; a subtree's hash covers its tag, text and subtrees.
2. Spark counts, per host, on how many distinct pages each subtree occurs; pages with the same articles count once. Subtrees
   on more than ``share`` of a host's distinct pages, and on at least ``min_pages``, are the site's template. A page has few
   elements, so a host has few templates.
3. Template subtrees are deleted from each page, with elements that are no content by their tag, role, class or id
   (menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, comments) or are hidden. The rest of
   the article elements (of the body, if there are none) is the text: inline markup vanishes, references are decoded,
   white space inside a block becomes one space, and blocks are joined in page order by a newline.

Templates are broadcast while their measured size is within ``TEMPLATE_BYTES``; beyond that pages are joined to their
host's templates by a shuffle, in which Spark splits a host with very many pages. Both give the same rows.

Defined cases: a null or empty page gives an empty text; a null or relative url has no host, so no template is counted
for it; broken markup is closed as browsers do for paragraphs, list items and table cells; the article element itself
is never a template; repeated rows are pages of their own; empty tables give empty results; other columns are kept,
but for those named like a result column.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestat.llm.common import fresh, q, stored

TEMPLATE_BYTES = 32 << 20
# HTML elements by their role here.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NO_CONTENT = frozenset(
    "head script style noscript template nav footer aside form button select textarea title iframe object svg canvas "
    "video audio dialog noembed noframes".split()
)
BLOCK = frozenset(
    "html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "blockquote pre address figure figcaption header hgroup details summary center fieldset legend menu xmp".split()
)
CLOSES_P = BLOCK - {"html", "body", "li", "dt", "dd", "thead", "tbody", "tfoot", "tr", "td", "th", "caption"} | {"nav", "footer", "aside", "form", "hr"}
# An opening tag closes an open element of these tags, up to the limits.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu "
    "breadcrumb breadcrumbs sidebar aside footer header masthead notice notices cookie cookies consent gdpr popup modal "
    "newsletter subscribe signup login comment comments disqus reply replies share sharing social related recommended "
    "widget pagination pager".split()
)
PROTECTED = frozenset("html body article main".split())
#: Words that may stand beside one of ``NAMES`` in a compound class name.
PLAIN = frozenset(
    "box bar block list wrap wrapper container area section panel link links item items slot unit inner outer content main site page "
    "global top bottom left right header footer nav menu button buttons form text title overlay message".split()
)
#: Inside an article these name its own parts.
OWN_PARTS = frozenset("header masthead footer aside".split())
# A quote opens a value only after an equals sign.
TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>")
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*)))?")


class Node:
    __slots__ = ("tag", "drop", "children", "hash")

    def __init__(self, tag: str, drop: bool) -> None:
        self.tag, self.drop, self.children, self.hash = tag, drop, [], 0

    def close(self) -> None:
        """Hash of the finished subtree."""
        h = xxhash.xxh64(self.tag)
        for c in self.children:
            h.update(f"\x01{c.hash:x}" if isinstance(c, Node) else "\x03" if c is None else "\x02" + " ".join(c.split()))
        self.hash = h.intdigest()


def telling(names: str, in_article: bool) -> bool:
    """Whether a class or id is one of ``NAMES``, or a compound of them and plain words only."""
    for name in names.split():
        parts = [p for p in re.split(r"[_-]+", name) if p]
        known = NAMES - OWN_PARTS if in_article else NAMES
        if any(p in known for p in parts) and all(p in known or p in PLAIN for p in parts):
            return True
    return False


def no_content(tag: str, attributes: str, in_article: bool) -> bool:
    if tag in NO_CONTENT or tag == "header" and not in_article:
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next((v for v in values if v), "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in ROLES:
            return True
        if name in ("class", "id") and telling(value, in_article):
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def parse(page: str) -> tuple[Node, list[Node]]:
    """The root of a page's tree of blocks, and all its closed nodes."""
    root = Node("", False)
    stack, is_open, done, at = [root], Counter(), [], 0

    def pop() -> None:
        node = stack.pop()
        is_open[node.tag] -= 1
        node.close()
        done.append(node)

    def close_to(tags, limits=frozenset()) -> None:
        if any(is_open[t] for t in tags):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in tags:
                    while len(stack) > k:
                        pop()
                    return
                if stack[k].tag in limits:
                    return

    while at < len(page):
        left = page.find("<", at)
        if left < 0:
            left = len(page)
        if left > at:
            stack[-1].children.append(unescape(page[at:left]))
        if left == len(page):
            break
        if page.startswith("<!--", left):
            end = page.find("-->", left + 4)
            at = len(page) if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), left):
            end = page.find(">", left)
            at = len(page) if end < 0 else end + 1
            continue
        m = TAG.match(page, left)
        if not m:
            if page[left + 1 : left + 2].isalpha() or page[left + 1 : left + 2] == "/":
                break  # a tag that the page's end cuts off
            stack[-1].children.append("<")
            at = left + 1
            continue
        at, tag = m.end(), m[2].lower()
        if m[1]:
            close_to({tag})
            if tag in BLOCK or tag == "br":
                stack[-1].children.append(None)
            continue
        drop = no_content(tag, m[3], bool(is_open["article"] or is_open["main"]))
        if tag in CLOSES_P:
            close_to({"p"})
        if tag in SIBLINGS:
            close_to(*SIBLINGS[tag])
        if tag in VOID:
            if tag in ("br", "hr"):
                stack[-1].children.append(None)
            continue
        if tag in RAW:
            end = re.compile(f"</{tag}", re.IGNORECASE).search(page, at)
            at = end.start() if end else len(page)
        if drop or tag in BLOCK:
            node = Node(tag, drop)
            stack[-1].children.append(node)
            stack.append(node)
            is_open[tag] += 1
    while len(stack) > 1:
        pop()
    return root, done


def main_text(page: str | None, templates: set[int]) -> str:
    root, _ = parse(page or "")
    gone = lambda n: n.drop or n.tag not in PROTECTED and n.hash in templates
    # The outermost article elements that are not dropped, or all of the page.
    articles, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.tag in ("article", "main"):
            articles.append(node)
        else:
            todo += [c for c in reversed(node.children) if isinstance(c, Node) and not gone(c)]
    blocks, current = [], []

    def flush() -> None:
        text = " ".join("".join(current).split())
        if text:
            blocks.append(text)
        current.clear()

    for top in articles or [root]:
        walk = [iter(top.children)]
        while walk:
            c = next(walk[-1], flush)
            if c is flush:
                walk.pop()
                flush()
            elif isinstance(c, str):
                current.append(c)
            elif c is None:
                flush()
            elif not gone(c):
                if c.tag in BLOCK:
                    flush()
                    walk.append(iter(c.children))
            elif c.tag in BLOCK or c.tag in NO_CONTENT:
                flush()
    return "\n".join(blocks)


def host_of(url):
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit(""))


def content_of(root: Node) -> int:
    """Hash of a page's articles, or of all of it."""
    found, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.tag in ("article", "main"):
            found.append(node)
        else:
            todo += [c for c in reversed(node.children) if isinstance(c, Node)]
    if not found:
        root.close()
        found = [root]
    return xxhash.xxh64("".join(f"\x01{n.hash:x}" for n in found)).intdigest()


def templates(pages: DataFrame, share: float = 0.5, min_pages: int = 5) -> DataFrame:
    """(host, hashes) of the subtrees that recur across a host's pages; ``pages`` has host and html.

    Pages of a host with the same articles (or, without articles, the same tree) are one page here, however many copies there are.
    """

    def rows(batches):
        for batch in batches:
            contents, hashes, sizes = [], [], [0]
            for page in batch.column(1).to_pylist():
                root, nodes = parse(page or "")
                own = {n.hash for n in nodes if n.tag not in PROTECTED and n.tag != "head"}
                contents.append(content_of(root))
                hashes += own
                sizes.append(len(hashes))
            held = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(hashes, pa.uint64()).view(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(contents, pa.uint64()).view(pa.int64()), held], ["host", "content", "hashes"])

    known = pages.filter("host <> ''").select("host", "html").mapInArrow(rows, "host string, content long, hashes array<long>")
    distinct = stored(known.groupBy("host", "content").agg(F.min("hashes").alias("hashes")), "html-contents")
    counts = distinct.select("host", F.explode("hashes").alias("hash")).groupBy("host", "hash").agg(F.count("*").alias("n"))
    totals = distinct.groupBy("host").agg(F.count("*").alias("pages"))
    found = counts.filter(F.col("n") >= min_pages).join(totals, "host")
    return found.filter(F.col("n") > share * F.col("pages")).groupBy("host").agg(F.collect_list("hash").alias("hashes"))


def extract(pages: DataFrame, html_col: str = "html", url_col: str = "url", share: float = 0.5, min_pages: int = 5) -> DataFrame:
    """The other columns of ``pages`` with ``text`` and ``n_chars`` (code points)."""
    keep = [c for c in pages.columns if c != html_col and c.lower() not in ("text", "n_chars")]
    host = fresh(pages, "__host")
    rows = pages.select(*[q(c) for c in keep], q(html_col).alias(fresh(pages, "__html")), host_of(q(url_col)).alias(host))
    html = fresh(pages, "__html")
    found = stored(templates(rows.select(q(host).alias("host"), q(html).alias("html")), share, min_pages), "html-templates")
    size = found.agg(F.sum(F.size("hashes") * 8 + F.length("host") + 64)).first()[0] or 0
    found = found.select(F.col("host").alias(host), F.col("hashes").alias(fresh(pages, "__hashes")))
    joined = rows.join(F.broadcast(found) if size <= TEMPLATE_BYTES else found, host, "left")
    joined = joined.select(*[q(c) for c in keep], q(html), q(fresh(pages, "__hashes")))

    def texts(batches):
        for batch in batches:
            made, held = [], {}
            hashes = batch.column(batch.num_columns - 1).to_pylist()
            for page, own in zip(batch.column(batch.num_columns - 2).to_pylist(), hashes):
                key = tuple(own or ())
                if key not in held:
                    held[key] = {h & 0xFFFFFFFFFFFFFFFF for h in key}
                made.append(main_text(page, held[key]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-2], pa.array(made, pa.string()), pa.array([len(t) for t in made], pa.int64())], [*keep, "text", "n_chars"]
            )

    schema = [f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in joined.schema.fields[:-2]]
    return joined.mapInArrow(texts, ", ".join([*schema, "text string", "n_chars long"]))
