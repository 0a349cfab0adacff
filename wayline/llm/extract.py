"""Main text of web pages by composite text density.

Every element of a page gets a density: its characters per tag, lowered by the
share of characters and tags that belong to links.  The element whose children
have the largest sum of densities holds the article.  The smallest density on
the way from it up to the body is the threshold: whatever stands beside that
way and is at least as dense belongs to the article too.  So does the innermost
article or main element on that way, whole.

What never is article text (menus, scripts, notices, comments and the like) is
left out before densities are worked out.  Names and forms may also belong to
wrappers of the whole page.  So what is left out for its class, its id or as a
form has to hold no more than half of the text in article and main elements;
where the page has none, or inside of these, no more than half of the page's
text.  Links don't count, nor do articles that bear such a name themselves,
like comments do.  Inside an article a name has to consist of such words as a
whole; otherwise it counts only for what is mostly links.

Work is linear in the length of a page, however deep its elements are.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements of HTML by what they do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp "
    "small span strike strong sub sup time tt u var wbr".split())
NEVER_TEXT = frozenset(
    "script style noscript template iframe svg canvas math object audio video head title nav footer "
    "aside button select textarea dialog menu map".split())
HEADINGS = frozenset("h1 h2 h3".split())
#: Start tags that end an open element of the same list.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"),
        "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Elements that an implied end never reaches beyond.
SCOPES = frozenset("html body article main section div table td th ul ol dl blockquote".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())
#: Parts of class names and ids that mark what isn't the article.
MARKS = frozenset(
    "nav navbar navigation menu submenu footer sidebar ad ads adv advert adverts advertisement adsense banner "
    "cookie cookies consent gdpr notice notification popup overlay modal promo promotion sponsor sponsored "
    "comment comments commentlist disqus respond replies share sharing social related recommended breadcrumb "
    "breadcrumbs newsletter subscribe subscription login signup search pagination pager toolbar widget".split())
#: What names of containers add to such marks, as in comment-list or ad-slot.
FILLERS = frozenset(
    "area body bottom box block button buttons container content form holder inner item items left links list outer "
    "panel right section slot title top unit wrap wrapper".split())
#: Marks that inside an article only count for what consists of links mostly.
WEAK = frozenset("related recommended search share sharing social toolbar widget".split())
#: A tag that the end of the page cuts short.
CUT_TAG = re.compile(r"<[A-Za-z/!?][^<>]*\Z")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class _Tree(HTMLParser):
    """Elements in page order with their parents, and texts and block borders between them."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tags, self.parents, self.left_out = ["#root"], [-1], [False]
        #: Whether an element is left out only if it is no wrapper, and if it is mostly links.
        self.marked, self.weak = [False], [False]
        self.events: list[tuple[int, str | None]] = []  # (element, text), or text None for a border
        self.open = [0]
        self.places = {}  # tag -> places of its open elements in ``open``

    def handle_starttag(self, tag, attrs):
        if tag not in INLINE:
            self._close_first(("p",), SCOPES)
            self.events.append((self.open[-1], None))
        if tag in ENDS:
            self._close_first(ENDS[tag], SCOPES - set(ENDS[tag]) - ({"td", "th"} if tag == "tr" else set()))
        node = len(self.tags)
        self.tags.append(tag)
        self.parents.append(self.open[-1])
        attrs = dict(attrs)
        self.left_out.append(self._unwanted(tag, attrs))
        marked, weak = self._marked(tag, attrs)
        self.marked.append(marked)
        self.weak.append(weak)
        if tag not in VOID:
            self.places.setdefault(tag, []).append(len(self.open))
            self.open.append(node)
        elif tag == "br":  # white space inside its block
            self.events.append((self.open[-1], " "))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)  # a slash means nothing in HTML

    def handle_endtag(self, tag):
        self._close_from(self._last(tag))
        if tag not in INLINE:
            self.events.append((self.open[-1], None))

    def handle_data(self, data):
        self.events.append((self.open[-1], data))

    def _last(self, *tags):
        """Place of the innermost open element of these tags, -1 if there is none."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def _close_from(self, at):
        """Close the element at a place and all inside it; every element is closed once at most."""
        while 0 < at < len(self.open):
            self.places[self.tags[self.open.pop()]].pop()

    def _close_first(self, tags, scopes):
        at = self._last(*tags)
        if at > self._last(*scopes):
            self._close_from(at)

    def _unwanted(self, tag: str, attrs: dict) -> bool:
        if tag in ("html", "body", "article", "main"):
            return False
        if tag in NEVER_TEXT or "hidden" in attrs or attrs.get("aria-hidden") == "true":
            return True
        if (attrs.get("role") or "").lower() in ROLES:
            return True
        if "display:none" in (attrs.get("style") or "").replace(" ", "").lower():
            return True
        return tag == "header" and not self._in_article()  # of the page, not of the article

    def _in_article(self) -> bool:
        return self._last("article", "main") > 0

    def _marked(self, tag: str, attrs: dict) -> tuple[bool, bool]:
        if tag in ("html", "body"):
            return False, False
        if tag == "form" or (attrs.get("role") or "").lower() == "form":
            return True, False
        names, name = attrs.get("class") or "", attrs.get("id") or ""
        if not names and not name:
            return False, False
        whole = [{x.lower() for x in NAME_PART.findall(n)} for n in (*names.split(), *name.split())]
        parts = set().union(*whole)
        if not self._in_article():
            return bool(parts & MARKS or "header" in parts or "masthead" in parts), False
        # In an article a name counts as a whole (comment-list, not notice-period); what only
        # has a mark in it, or is of the weak ones, has to be links mostly.
        strong = any(x <= MARKS | FILLERS and x & MARKS - WEAK for x in whole)
        return bool(parts & MARKS), not strong


def _left_out(tree: _Tree) -> list[bool]:
    """Whether an element or one above it is left out."""
    tags, parents, out = tree.tags, tree.parents, tree.left_out
    n = len(tags)
    in_link, in_article = [False] * n, [False] * n
    articles = [tags[i] in ("article", "main") and not tree.marked[i] for i in range(n)]
    for i in range(1, n):
        parent = parents[i]
        out[i] = out[i] or out[parent]
        in_link[i] = tags[i] == "a" or in_link[parent]
        in_article[i] = in_article[parent] or tags[parent] in ("article", "main")
    # Text outside links, all text, and text of the articles below.
    plain, full, held = [0] * n, [0] * n, [0] * n
    for node, text in tree.events:
        if text and not out[node]:
            size = len(text.strip())
            full[node] += size
            plain[node] += size * (not in_link[node])
    for i in range(n - 1, 0, -1):
        plain[parents[i]] += plain[i]
        full[parents[i]] += full[i]
        held[parents[i]] += plain[i] if articles[i] else held[i]
    for i in range(1, n):
        if tree.marked[i] and tags[i] not in ("article", "main") and not (tree.weak[i] and 2 * plain[i] > full[i]):
            wraps = held[i] * 2 > held[0] or ((in_article[i] or not held[0]) and plain[i] * 2 > plain[0])
            out[i] = out[i] or not wraps
        out[i] = out[i] or out[parents[i]]
    return out


def densities(tags, parents, chars, links) -> list[float]:
    """Composite density of every element, from totals over its subtree.

    ``chars`` and ``links`` hold each element's own characters and the part of
    them inside links; both become totals here.
    """
    n = len(tags)
    counts, link_tags = [0] * n, [0] * n
    for i in range(n - 1, 0, -1):
        parent = parents[i]
        chars[parent] += chars[i]
        links[parent] += links[i]
        counts[parent] += counts[i] + 1
        link_tags[parent] += link_tags[i] + (tags[i] == "a")
    body_share = links[0] / max(chars[0], 1)
    out = []
    for c, lc, t, lt in zip(chars, links, counts, link_tags, strict=True):
        if not c:
            out.append(0.0)
            continue
        t, lc1, lt = max(t, 1), max(lc, 1), max(lt, 1)
        base = math.log(c / max(c - lc, 1) * lc + body_share * c + math.e)  # at least 1
        out.append(c / t * math.log(max(c / lc1 * t / lt, 1.0) + math.e - 1) / math.log(base + math.e - 1))
    return out


def main_text(html: str) -> str:
    """The article's blocks, one per line; empty if the page has no text."""
    tree = _Tree()
    tree.feed(CUT_TAG.sub("", html))
    tree.close()
    tags, parents = tree.tags, tree.parents
    n = len(tags)
    out, in_link = _left_out(tree), [False] * n
    for i in range(1, n):
        in_link[i] = tags[i] == "a" or in_link[parents[i]]
    chars, links = [0] * n, [0] * n
    for node, text in tree.events:
        if text and not out[node]:
            size = len(text.strip())
            chars[node] += size
            links[node] += size * in_link[node]
    dense = densities(tags, parents, chars, links)
    if not chars[0]:
        return ""

    sums = [0.0] * n
    for i in range(1, n):
        sums[parents[i]] += dense[i]
    best = max(range(n), key=lambda i: (sums[i], -i))
    way = [best]
    while way[-1] and tags[way[-1]] != "body":
        way.append(parents[way[-1]])
    threshold = min(dense[i] for i in way)
    beside = set(way)
    roots = {best} | {
        i for i in range(1, n) if parents[i] in beside and i not in beside and not out[i] and chars[i]
        and (dense[i] >= threshold or tags[i] in HEADINGS) and links[i] * 2 < chars[i]}
    roots |= set([i for i in way if tags[i] in ("article", "main")][:1])
    inside = [False] * n
    for i in range(n):
        inside[i] = not out[i] and (i in roots or (i > 0 and inside[parents[i]]))

    blocks, current = [], []
    for node, text in [*tree.events, (0, None)]:
        if text is None:
            block = " ".join("".join(current).split())
            if block:
                blocks.append(block)
            current = []
        elif inside[node]:
            current.append(text)
    return "\n".join(blocks)


def extracted(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, main ``text`` and its length; a null html gives an empty text.

    Pages are taken one by one, so repeated rows and pages without an id are
    no matter.  An empty table gives an empty one.  A tag that the end of the page
    cuts short is no text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py() or "") for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                 pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html").mapInArrow(
        run, "page_id long, url string, text string, n_chars long")
