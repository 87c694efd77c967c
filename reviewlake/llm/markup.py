"""Main text of web pages by composite text density."""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements without content; those that stand in a line of text; those that never hold main text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
NEVER = frozenset("head script style noscript template nav footer aside form button select textarea iframe svg canvas object dialog menu datalist audio video math".split())
#: Roles, and words of class or id, that mark what is not the article; the last words may also name parts of one, and count on blocks of links or controls.
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
MARKS = frozenset("ad ads adv advert advertisement adverts advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe sidebar sidebars aside menu menus nav navbar navigation breadcrumb breadcrumbs masthead topbar footer comment comments commentlist disqus login signup".split())
HINTS = frozenset("header rail subscription discussion replies respond share sharing social related recommended recommendations widget widgets toolbar pagination pager search skip copyright".split())
#: Words that beside a mark only say which block, where, or of what kind.
PLACES = frozenset("a area b bar block body bottom box button buttons c card cell col column container content count div entry fixed float group head header heading holder id inline inner item items label large left line link links list lists main middle module outer page panel part post region right row section site small slot space sticky strip text thread tile title top unit view wide wrap wrapper".split())
CONTROLS = frozenset("input select textarea button form".split())
#: Elements whose open sibling ends when another begins.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
WITHIN = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}
#: Block elements that end an open paragraph.
BLOCKS = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
TEXTS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table".split())
_TAG = re.compile(r"<[A-Za-z/!?]")


class _Tree(HTMLParser):
    """Elements in page order: parent, tag, attributes; and the pieces of text with their element.

    The depths at which each tag is open, and those of blocks, are at hand, so
    that deep and unclosed markup takes no longer than other markup.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parent, self.tag, self.attrs = [-1], ["#root"], [{}]
        self.text: list[tuple[int, str]] = []
        self.open = [0]
        self.depths: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.endless = self.boundless = False

    def parse_comment(self, i, report=1):
        """Looks for an end that is not there once only."""
        if self.endless:
            return -1
        k = super().parse_comment(i, report)
        self.endless = k < 0
        return k

    def parse_html_declaration(self, i):
        if self.rawdata.startswith("<![", i):
            if self.boundless:
                return -1
            k = super().parse_html_declaration(i)
            self.boundless = k < 0
            return k
        return super().parse_html_declaration(i)

    def _deepest(self, tags: Iterable[str]) -> int:
        return max((self.depths[t][-1] for t in tags if self.depths.get(t)), default=0)

    def _cut(self, depth: int) -> None:
        while len(self.open) > depth:
            self.depths[self.tag[self.open.pop()]].pop()
            if self.blocks and self.blocks[-1] == len(self.open):
                self.blocks.pop()

    def handle_starttag(self, tag, attrs) -> None:
        closes = CLOSES.get(tag, set()) | ({"p"} if tag in BLOCKS else set())
        if closes & {"td", "th", "tr", "dt", "dd"}:
            if (last := self._deepest(closes)) > self._deepest(WITHIN.get(tag, ())):
                self._cut(last)
        elif closes and self.blocks and self.tag[self.open[self.blocks[-1]]] in closes:
            self._cut(self.blocks[-1])
        self.parent.append(self.open[-1])
        self.tag.append(tag)
        self.attrs.append({k: v or "" for k, v in attrs})
        if tag not in INLINE:
            self.text.append((len(self.tag) - 1, " "))
        if tag not in VOID:
            self.depths.setdefault(tag, []).append(len(self.open))
            if tag not in INLINE:
                self.blocks.append(len(self.open))
            self.open.append(len(self.tag) - 1)

    def handle_startendtag(self, tag, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "path", "g", "use"):
            self._cut(len(self.open) - 1)

    def handle_endtag(self, tag) -> None:
        if depth := self._deepest((tag,)):
            if tag not in INLINE:
                self.text.append((self.open[depth], " "))
            self._cut(depth)

    def handle_data(self, data) -> None:
        self.text.append((self.open[-1], data))


def _marked(tag: str, attrs: dict, active: bool) -> bool:
    """Whether an element is marked as no part of the article; ``active``: it is mostly links, or has controls."""
    if tag in NEVER or attrs.get("role", "").lower() in ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "").lower():
        return True
    names = re.sub(r"(?<=[a-z])(?=[A-Z])", "-", attrs.get("class", "") + " " + attrs.get("id", "")).lower().split()
    words = [set(re.findall("[a-z]+", name)) for name in names]
    # Beside a word of its own ("comment-free") a mark is a hint only.
    return any(w & MARKS and w <= MARKS | HINTS | PLACES for w in words) or active and any(w & (MARKS | HINTS) for w in words)


def _density(chars: int, tags: int, linked: int, links: int, ratio: float) -> float:
    """Characters a tag, weighed down by the share of link text; ratio is the page's share."""
    if not chars:
        return 0.0
    tags, plain = max(tags, 1), max(chars - linked, 1)
    base = math.log(chars / plain * linked + ratio * chars + math.e)
    return chars / tags * math.log(max(chars / max(linked, 1) * tags / max(links, 1), 1.0000001)) / math.log(base) if base > 1 else chars / tags


def main_text(html: str | None) -> str:
    """The page's article: blocks in order, white space as one space; empty if there is none."""
    if not html:
        return ""
    tree = _Tree()
    # After the last ">" no tag ends: what begins as one is cut off.
    cut = _TAG.search(html, html.rfind(">") + 1)
    tree.feed(html[: cut.start()] if cut else html)
    tree.close()
    n, parent, tag = len(tree.tag), tree.parent, tree.tag
    size = [0] * n
    for k, data in tree.text:
        size[k] += len("".join(data.split()))
    whole, article, controls = size[:], [t in ("article", "main", "h1") for t in tag], [t in CONTROLS for t in tag]
    in_link, links_whole = [False] * n, [0] * n
    for k in range(1, n):
        in_link[k] = in_link[parent[k]] or tag[k] == "a"
    for k in range(n - 1, 0, -1):
        whole[parent[k]] += whole[k]
        links_whole[k] = whole[k] if in_link[k] else links_whole[k]
        links_whole[parent[k]] += links_whole[k]
        article[parent[k]] |= article[k]
        controls[parent[k]] |= controls[k]
    # What is not the article goes, unless it holds the title or, on a page without one, most of the text; a header within an article stays.
    gone, inside = [False] * n, [False] * n
    body_chars = max(whole[0] - sum(whole[k] for k in range(n) if tag[k] in ("head", "script", "style")), 1)
    for k in range(1, n):
        p = parent[k]
        inside[k] = inside[p] or tag[k] in ("article", "main")
        marked = _marked(tag[k], tree.attrs[k], controls[k] or 2 * links_whole[k] >= whole[k]) or tag[k] == "header" and not inside[k]
        kept = tag[k] in ("html", "body", "article", "main", "h1") or tag[k] not in NEVER and (article[k] or not article[0] and 2 * whole[k] > body_chars)
        gone[k] = gone[p] or marked and not kept
    chars, tags, linked, links = [0] * n, [0] * n, [0] * n, [0] * n
    for k in range(n - 1, 0, -1):
        if gone[k]:
            continue
        chars[k] += size[k]
        if in_link[k]:
            linked[k] = chars[k]
        p = parent[k]
        for column, own in ((chars, 0), (tags, 1), (linked, 0), (links, tag[k] == "a")):
            column[p] += column[k] + own
    chars[0] += size[0]
    body = next((k for k in range(n) if tag[k] == "body"), 0)
    ratio = linked[body] / max(chars[body], 1)
    density = [_density(chars[k], tags[k], linked[k], links[k], ratio) for k in range(n)]
    total = [0.0] * n
    for k in range(1, n):
        if not gone[k]:
            total[parent[k]] += density[k]
    for k in range(n):  # bare text counts as a child of its own
        if size[k] and not gone[k] and tag[k] not in INLINE:
            total[k] += _density(size[k], 0, 0, 0, ratio)
    live = [k for k in range(n) if not gone[k] and chars[k] and tag[k] not in INLINE and (tag[k] not in ("#root", "html") or k == body)]
    if not live:
        return ""
    best = max(live, key=lambda k: (total[k], -k))
    path = [best]
    while parent[path[-1]] >= 0 and path[-1] != body:
        path.append(parent[path[-1]])
    threshold = min(density[k] for k in path)
    plain = lambda c: tag[c] in ("h1", "h2", "h3") or density[c] >= threshold and 2 * linked[c] <= chars[c]
    on_path, children = set(path), {k: [] for k in path}
    for c in range(1, n):
        if parent[c] in on_path and c not in on_path and not gone[c] and chars[c]:
            children[parent[c]].append(c)
    # Whether an element of the path, or one above it, is an article or main; and whether one above it is an article.
    within_article, below_article = {}, {}
    held = above = False
    for k in reversed(path):
        below_article[k] = above
        held, above = held or tag[k] in ("article", "main"), above or tag[k] == "article"
        within_article[k] = held
    top = best
    for k in path[1:]:
        others = children[k]
        if tag[k] in ("body", "html", "#root"):
            # Beside the found subtree, the body itself holds the article where its children are plain blocks of text or titles.
            # A piece of a page without a body has no other frame than its blocks of text.
            piece = not body and all(tag[c] in INLINE or tag[c] in TEXTS and 2 * linked[c] <= chars[c] for c in (*others, top))
            if not piece and (tag[top] in ("article", "main") or not others or not all(tag[c] in ("p", "h1", "h2", "h3", "blockquote", "pre", "ul", "ol", "table", "div", "section") and plain(c) for c in others)):
                break
        elif not within_article[k] and not all(map(plain, others)):
            break
        top = k
        if tag[k] in ("article", "main") and not below_article[k]:
            break
    within = [False] * n
    within[top] = True
    for k in range(top + 1, n):
        within[k] = within[parent[k]]
    return " ".join("".join(data for k, data in tree.text if within[k] and not gone[k]).split())


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) per row of pages.

    A null or empty page, or one without text, has an empty text. Pages are
    parsed one at a time, whole; broken and cut-off markup is read as a browser
    would. Repeated rows give the same text; other columns are ignored; an
    empty table gives no rows.
    """

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = [main_text(h) for h in b["html"]]
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    found = pages.select(F.col(page_id).cast("string").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html")).mapInPandas(run, "page_id string, url string, text string, n_chars long")
    return found.withColumn("page_id", F.col("page_id").cast(pages.schema[page_id].dataType))
