"""Main text of web pages, with site templates removed.

Every page is parsed to a tree, and each container element gets a hash of its whole subtree (tags and text), before anything is left out. Spark
counts, per host, on how many different pages each hash occurs; pages that are equal but for what HTML marks as no article count once.
Subtrees that recur on many pages of the host are its template: on MANY_PAGES pages of however large a host, or on MIN_PAGES and MIN_SHARE of
its pages, or on FEW_PAGES and MOST_SHARE of a small one's. They are deleted, wherever they stand outside the article; inside it only containers that
hold less than MOST_OF_ROOT of its text are, never single paragraphs, headings or list items, which articles may share.

What a site says on one page only can't be found by counting. For that, HTML's own marks are the fallback: scripts, navigation, forms and such by
tag, role or being hidden, and by a word that is a class or the id as a whole, of what holds less than half of the text.

Template hashes go to every task if they are few, else they meet their pages in a join; pages are never dealt out by host.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._io import written
from ._text import mix, slices, tidy

FEW_PAGES, MOST_SHARE = 3, 0.5
MIN_PAGES, MIN_SHARE = 5, 0.1
MANY_PAGES = 50
MOST_OF_ROOT = 0.25
MOST_LINKS = 0.5
LEAST_LEFT = 0.1
#: Template hashes that go to every task, of 8 bytes each; more are joined.
SENT = 1 << 21
#: Stands for a page itself among its hashes.
_PAGE = -1

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
# Elements of HTML by what they do to the tree or the text.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript iframe textarea title xmp noembed noframes".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
_CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
_SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}
_NO_TEXT = frozenset("head script style noscript template iframe object svg canvas math nav footer aside form button select textarea title dialog menu audio video map datalist".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
# Classes and ids that name, as a whole, what is no article.
_NAMES = frozenset((
    "ad ads advert adverts advertisement sponsored banner cookie-notice cookie-banner cookies consent notice notices popup modal sidebar sidebar-left sidebar-right widget widgets related recommended "
    "comment comments comment-list commentlist comments-area reader-comments reply replies respond disqus_thread nav navbar navigation menu breadcrumb breadcrumbs pagination pager footer site-footer "
    "site-header masthead newsletter newsletter-signup subscribe login toolbar skip-link social-links share-buttons paywall").split())
#: ... and those that do so as a part of a class or id, between hyphens, underscores or capital letters.
_PARTS = frozenset("ad ads advert adverts advertisement advertising comment comments commentlist cookie cookies sponsor sponsored sidebar newsletter breadcrumb breadcrumbs pagination popup modal nav navbar navigation masthead".split())
_WITHOUT = frozenset("no not non without has with hide toggle free".split())
_QUOTED = frozenset("blockquote q pre code table figure math".split())
_PART = re.compile(r"[A-Z]?[a-z0-9]+|[A-Z]+(?![a-z])")
_FORM = frozenset("form button input select textarea option label fieldset".split())
_LEAVES = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dt dd figcaption caption tr tbody thead".split())
_ROOTS = frozenset("html body article main".split())


class Node:
    __slots__ = ("tag", "attrs", "kids", "hash", "size")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.kids = tag, attrs, []


def parse(page: str) -> Node:
    """A tree of Nodes and strings, with implied end tags; never fails."""
    root = Node("#")
    stack = [root]
    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            stack[-1].kids.append(page[at:])
            break
        if m.start() > at:
            stack[-1].kids.append(page[at : m.start()])
        at = m.end()
        name = m.group(2) or m.group(5)
        if name is None:
            continue
        name = name.lower()
        if m.group(1) or m.group(4):
            _close(stack, name)
            continue
        if name in _CLOSES_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag not in _INLINE:
                    break
        if name in _SAME:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in _SAME[name]:
                    del stack[k:]
                    if name in ("li", "dt", "dd", "option"):
                        break
                    if len(stack) > 1 and stack[-1].tag in _SAME[name]:
                        continue
                    break
                if stack[k].tag in _SCOPE[name]:
                    break
        node = Node(name, m.group(3) or m.group(6) or "")
        stack[-1].kids.append(node)
        if name in _VOID or node.attrs.endswith("/") and name not in _RAW and name in ("svg", "path", "use"):
            continue
        if name in _RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else n
            continue
        stack.append(node)
    return root


def _close(stack: list[Node], name: str) -> None:
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag == name:
            del stack[k:]
            return
        if name in _INLINE and stack[k].tag not in _INLINE:
            return


def _attributes(attrs: str) -> dict[str, str]:
    return {k.lower(): html.unescape(a or b or c or "") for k, a, b, c in _ATTRIBUTE.findall(attrs)}


def _named(found: dict[str, str]) -> bool:
    """Whether a class or the id names what is no article."""
    names = [*found.get("class", "").split(), found.get("id", "").strip()]
    return any(n.lower() in _NAMES or any(p in _PARTS for p in parts) and not parts & _WITHOUT for n in names for parts in [{p.lower() for p in _PART.findall(n)}])


def _no_article(node: Node, inside: bool, most: float) -> bool:
    """Whether HTML marks the element as no part of the article; inside: whether it stands in article or main; most: letters that a name can speak for."""
    if node.tag in _NO_TEXT or (node.tag == "header" and not inside):
        return True
    if not node.attrs or node.tag in _ROOTS and node.tag != "article":
        return False
    attrs = _attributes(node.attrs)
    if node.tag != "article" and (attrs.get("role", "").lower() in _ROLES or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower()):
        return True
    return node.size < most and _named(attrs)


def prune(root: Node, whole: int) -> None:
    """Deletes what isn't article by HTML's own marks; whole: letters of the article, or of the page without one."""
    stack = [(root, False)]
    while stack:
        node, inside = stack.pop()
        inside = inside or node.tag in ("article", "main")
        node.kids = [k for k in node.kids if isinstance(k, str) or not _no_article(k, inside, whole / 2)]
        stack += [(k, inside) for k in node.kids if not isinstance(k, str)]


def _each(node: Node) -> list[Node]:
    """All nodes, parents first."""
    found, stack = [], [node]
    while stack:
        node = stack.pop()
        found.append(node)
        stack += [k for k in reversed(node.kids) if not isinstance(k, str)]
    return found


def hash_subtrees(root: Node) -> list[Node]:
    """Sets hash and size (letters of text) of every node; returns all, parents first."""
    found = _each(root)
    for node in reversed(found):
        parts, size = [node.tag], 0
        for k in node.kids:
            if isinstance(k, str):
                text = " ".join(k.split())
                parts.append(text)
                size += len(text)
            else:
                parts.append(k.hash)
                size += k.size
        node.hash, node.size = _hash(parts), size
    return found


def _hash(parts: list) -> int:
    return xxhash.xxh3_64_intdigest("\0".join(map(str, parts)).encode("utf-8", "surrogatepass")) - (1 << 63)


def _outermost(root: Node, tag: str) -> list[Node]:
    found, stack = [], [root]
    while stack:
        node = stack.pop()
        if node.tag == tag:
            found.append(node)
        else:
            stack += [k for k in reversed(node.kids) if not isinstance(k, str)]
    return found


def roots(root: Node, least: float = 0.0) -> list[Node]:
    """The outermost articles, or else main, if they hold text and at least ``least`` of all there is; or else the whole page."""
    for tag in ("article", "main"):
        found = _outermost(root, tag)
        if (own := sum(n.size for n in found)) and own >= least * root.size:
            return found
    return [root]


def _at_the_end(article: Node, common: set[int]) -> list[Node]:
    """Elements among common that no text of the article comes after, but that of others of them; those that hold quotations and such end the search."""
    found, stack = [], [article]
    while stack:
        node = stack.pop()
        if isinstance(node, str):
            if node.strip():
                break
        elif id(node) in common and not any(x.tag in _QUOTED for x in _each(node)):
            found.append(node)
        elif node.size and (node.tag in _LEAVES or id(node) in common):
            break
        else:
            stack += node.kids
    return found


def _no_content(node: Node) -> bool:
    """Whether an element of an article shows by more than recurring that it isn't the article's."""
    links = 0
    for x in _each(node):
        if x.tag in _FORM:
            return True
        if x.tag == "a":
            links += x.size
    return links >= MOST_LINKS * node.size or node.tag in _NO_TEXT or bool(node.attrs) and _named(_attributes(node.attrs))


def blocks(node: Node) -> list[str]:
    """Texts of the blocks below node, in page order."""
    found: list[str] = []
    run: list[str] = []

    def end() -> None:
        text = " ".join(html.unescape("".join(run)).split())
        run.clear()
        if text:
            found.append(text)

    stack: list = [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            run.append(x)
        elif x is None:
            end()
        elif x.tag in _INLINE:
            stack += reversed(x.kids)
        elif x.tag in ("br", "wbr", "img", "input"):
            run.append(" " if x.tag == "br" else "")
        else:
            end()
            stack += [None, *reversed(x.kids)]
    end()
    return found


def _countable(node: Node) -> bool:
    return node.size > 0 and node.tag not in _ROOTS and node.tag != "#" and node.tag not in _INLINE


def extract(page: str, template: Callable[[list[int]], Iterable[bool]] | None = None) -> str:
    """The main text; template tells of a list of subtree hashes which are the site's."""
    root = parse(page)
    found = hash_subtrees(root)
    main = roots(root)
    whole = sum(r.size for r in main)
    if template is not None:
        inner = {id(n): r.size for r in main for n in _each(r)} if main != [root] else {}
        own = [n for n in found if _countable(n)]
        common = [n for n, told in zip(own, template([n.hash for n in own])) if told and (id(n) not in inner or n.tag not in _LEAVES and n.size < MOST_OF_ROOT * inner[id(n)])]
        last = {id(n) for r in main for n in _at_the_end(r, {id(n) for n in common})} if common else set()
        gone = {id(n) for n in common if id(n) not in inner or id(n) in last or _no_content(n)}
        if gone:
            for node in found:
                node.kids = [k for k in node.kids if isinstance(k, str) or id(k) not in gone]
            hash_subtrees(root)
    prune(root, whole)
    hash_subtrees(root)
    return "\n".join(b for r in roots(root, LEAST_LEFT) for b in blocks(r))


def subtrees(page: str) -> tuple[int, list[int]]:
    """(hash of the page without what HTML marks as no article, distinct hashes of the elements that may be a template)."""
    root = parse(page)
    hashes = list({n.hash for n in hash_subtrees(root) if _countable(n)})
    prune(root, sum(r.size for r in roots(root)))
    hash_subtrees(root)
    return root.hash, sorted(hashes)


def _host(url: Column) -> Column:
    found = F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)), F.lit(""))
    return F.regexp_replace(found, r"[\[\]]", "")


def _subtrees(pages: DataFrame) -> DataFrame:
    """host, doc, page, hashes of pages (host, doc, html), written; pages of no host have no template and are left out."""

    def count(batches):
        for batch in batches:
            for at, texts in slices(batch, name="html"):
                rows = [subtrees(t) for t in texts]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(at, len(texts)) for k in ("host", "doc")), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.int64()))], names=["host", "doc", "page", "hashes"])

    return written(pages.where("host <> ''").select("host", "doc", "html").mapInArrow(tidy(count), "host string, doc bigint, page bigint, hashes array<bigint>"), "subtrees")


def templates(rows: DataFrame) -> DataFrame:
    """host, hash: the subtrees that recur on many pages of their host. rows: as _subtrees gives them."""
    different = rows.groupBy("host", "page").agg(F.min("hashes").alias("hashes"))
    each = different.select("host", F.explode(F.concat("hashes", F.array(F.lit(_PAGE).cast("long")))).alias("hash"))
    # Written, so that a host's share of these rows can be divided in the join.
    counts = written(each.groupBy("host", "hash").agg(F.count("*").alias("pages")).where((F.col("pages") >= FEW_PAGES) | (F.col("hash") == _PAGE)), "counts")
    of = counts.where(F.col("hash") == _PAGE).select("host", F.col("pages").alias("of"))
    n, share = F.col("pages"), F.col("pages") / F.col("of")
    common = (n >= MANY_PAGES) | (n >= MIN_PAGES) & (share >= MIN_SHARE) | (n >= FEW_PAGES) & (share >= MOST_SHARE)
    return counts.where(F.col("hash") != _PAGE).join(of, "host").where(common).select("host", "hash")


def _keys(host: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    return mix(mix(hashes.view(np.uint64)) ^ host.view(np.uint64))


def main_text(pages: DataFrame, sent: int = SENT) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every row of pages (page_id, url, html; other columns are ignored).

    A null html counts as empty and gives an empty text. Pages of a null or broken url belong to no host, and no template is looked for on them.
    Repeated rows get a row each and count as one page of their host. An empty table gives no rows. sent: see SENT.
    """
    spark = pages.sparkSession
    named = pages.select("page_id", "url", "html", _host(F.col("url")).alias("host"), F.xxhash64("html").alias("doc"))
    rows = _subtrees(named)
    common = written(templates(rows), "templates")
    kind = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars bigint"
    few = common.count() <= sent
    found = common.select(F.xxhash64("host").alias("host"), "hash").toArrow() if few else None
    table = spark.sparkContext.broadcast(np.sort(_keys(found.column("host").to_numpy(), found.column("hash").to_numpy())) if few else None)

    def of_host(host: int):
        keys = table.value

        def told(hashes: list[int]) -> np.ndarray:
            own = _keys(np.array([host], np.int64), np.array(hashes, np.int64))
            at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            return keys[at] == own

        return told if len(keys) else None

    def of_page(hashes: list[int] | None):
        own = frozenset(hashes or ())
        return (lambda some: [h in own for h in some]) if own else None

    def read(batches):
        for batch in batches:
            known = batch.column("known")
            for at, texts in slices(batch, name="html"):
                marks = known.slice(at, len(texts)).to_pylist()
                out = [extract(t, of_host(m) if few else of_page(m)) for t, m in zip(texts, marks)]
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(at, len(out)) for k in ("page_id", "url")), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    if few:
        joined = named.select("page_id", "url", "html", F.xxhash64("host").alias("known"))
    else:
        mine = rows.select("host", "doc", F.explode("hashes").alias("hash")).join(common, ["host", "hash"]).groupBy("host", "doc").agg(F.collect_set("hash").alias("known"))
        joined = named.join(written(mine, "known"), ["host", "doc"], "left").select("page_id", "url", "html", "known")
    return joined.mapInArrow(tidy(read), kind)
