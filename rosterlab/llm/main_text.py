"""Main text of HTML pages: gradient-boosted trees over DOM nodes, decoded from the root down.

A page becomes a tree of elements. Every element has features of its own and of its surroundings: shares of text, links and
punctuation in its subtree, tokens of tag, class and id, depth, and what its siblings are like. Boosted trees give each the log-odds that
it belongs to the article. Decoding picks the best choice in which an element is kept only if its parent is: kept
subtrees never hang on dropped ancestors, and a dropped element takes all below it along.

No page comes with labels, so the trees learn from pages whose landmark elements tell (article, main, nav, footer, ...), and from
rewritten copies of these in which the landmarks became plain elements with telling or neutral names, with the notices, forms, comments
and side bars that other sites have.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import table

SAMPLE = 150  # pages the trees are fitted on
SAMPLE_CHARS = 100_000  # and pages longer than this are not drawn for it
TREES, DEPTH, BINS, RATE = 40, 4, 24, 0.3

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = {"script", "style", "noscript", "template", "iframe", "object", "svg", "head", "title", "textarea", "select", "option", "button", "canvas", "audio", "video"}
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
IN_HEAD = set("base basefont bgsound head link meta noframes noscript script style template title".split())  # all else ends an open head
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
GOOD_TAGS, BAD_TAGS = {"article", "main"}, {"nav", "footer", "aside", "form", "menu", "dialog", "search"}
# What class, id and role tokens say on most sites.
GOOD = set("article articlebody articlecontent body bodytext content contents entry entrycontent main maincontent page post postbody postcontent prose richtext story storybody text".split())
BAD = set("""ad ads adsense advert advertisement advertising advertorial alert alternate author avatar banner bar breadcrumb breadcrumbs byline
comment commentary commentlist comments complementary consent contentinfo cookie cookies copyright disqus disclaimer footer footnav form gdpr global header
hidden legal login masthead menu meta modal nav navbar navigation newsletter notice notification outbrain overlay pager pagination
paywall popup print promo promoted promotion rail recommended register related replies reply respond reviews search share sharing sidebar signup site skip social sponsor sponsored
subscribe subscription taboola tags teaser toolbar topbar tweet utility warning widget""".split())
COMMENT = set("comment comments commentlist disqus replies reply respond reviews discussion".split())
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")
_STOP = re.compile(r"[.!?,;:…。、，؛।]")

# An open element of the first kind ends where one of the second begins, unless an element of the third is between.
ENDS = {
    "p": (BLOCK - {"body", "html", "li", "dd", "dt", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "summary", "figcaption"}, {"table", "td", "th", "object", "button"}),
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "tbody", "thead", "tfoot"}, {"table"}),
    "td": ({"td", "th", "tr", "tbody", "tfoot"}, {"table"}), "th": ({"td", "th", "tr", "tbody", "tfoot"}, {"table"}),
    "option": ({"option", "optgroup"}, {"select"}),
}


class Node:
    __slots__ = ("tag", "names", "parent", "children", "hidden")

    def __init__(self, tag: str, names: str, parent: Node | None, hidden: bool = False):
        self.tag, self.names, self.parent, self.hidden = tag, names, parent, hidden
        self.children: list[Node | str] = []


class Tree(HTMLParser):
    """The elements of a page; unclosed and wrongly nested ones end as browsers end them, nearly."""

    def __init__(self, page: str):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#page", "", None)
        self.feed(page)
        if re.match(r"<[a-zA-Z/!?]", self.rawdata):  # a comment or tag that the page's end cuts off is no text
            self.rawdata = ""
        self.close()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "body":
            self.end_head()
        if tag in ("html", "body"):
            return
        if self.at.tag == "head" and tag not in IN_HEAD:
            self.end_head()
        node = self.at
        while node.parent is not None:
            ends, walls = ENDS.get(node.tag, ((), ()))
            if tag in ends:
                self.at = node.parent
            if node.tag in walls or node.tag in ("table", "ul", "ol", "dl", "select", "article", "section", "div", "body"):
                break
            node = node.parent
        own = {k: v or "" for k, v in attrs}
        hidden = "hidden" in own or own.get("aria-hidden") == "true" or "display:none" in own.get("style", "").replace(" ", "").lower()
        names = " ".join(own.get(k, "") for k in ("class", "id", "role", "itemprop"))
        new = Node(tag, names, self.at, hidden)
        self.at.children.append(new)
        if tag not in VOID:
            self.at = new

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node.parent is not None and node.tag != tag:
            if node.tag in ("article", "main", "table") and tag not in ("article", "main", "table", "body", "html", "div", "section"):
                return  # an inline end tag inside does not close these
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        if self.at.tag == "head" and data.strip():
            self.end_head()
        self.at.children.append(data)

    def end_head(self) -> None:
        """Leaves the head that is open, if one is: its end tag may be left out."""
        node = self.at
        while node.parent is not None and node.tag != "head":
            node = node.parent
        if node.parent is not None:
            self.at = node.parent


def parse(page: str) -> list[Node]:
    """All elements, parents first; the first one stands for the page."""
    root = Tree(page).root
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo.extend(c for c in reversed(node.children) if not isinstance(c, str))
    return out


def tokens(names: str) -> set[str]:
    parts = [t.lower() for t in _TOKEN.findall(names)]
    return set(parts) | {a + b for a, b in zip(parts, parts[1:])}


FEATURES = ("depth", "height", "children", "position", "siblings", "chars", "share_of_page", "share_of_parent", "link_share", "stops", "words_per_block", "blocks", "paragraphs", "paragraph_share", "list_items", "controls",
            "good_names", "bad_names", "comment_names", "good_above", "bad_above", "good_below", "bad_below", "good_tag", "bad_tag", "good_tag_above", "bad_tag_above", "header_tag", "heading", "paragraph", "list", "container", "inline", "link",
            "prev_chars", "next_chars", "sibling_chars", "sibling_links", "same_tag_siblings", "before", "good_sibling")


_NAMED: dict[str, tuple[int, int, int]] = {}


def _named(names: str) -> tuple[int, int, int]:
    """How many name tokens are good, bad, and of comments; remembered, for names come again and again."""
    if names not in _NAMED:
        if len(_NAMED) > 50_000:
            _NAMED.clear()
        t = tokens(names)
        _NAMED[names] = (len(t & GOOD), len(t & BAD), len(t & COMMENT))
    return _NAMED[names]


def _tag_flags(t: str) -> tuple[int, ...]:
    return tuple(map(int, (t in GOOD_TAGS, t in BAD_TAGS, t == "header", t in HEADINGS, t in ("p", "pre", "blockquote"), t in ("ul", "ol", "li", "dl", "table", "menu"), t in ("div", "section", "td", "center"), t not in BLOCK, t == "a")))


def features(nodes: list[Node]) -> np.ndarray:
    """One row of FEATURES per element, from one pass down and one up the tree."""
    k = len(nodes)
    place = {id(n): i for i, n in enumerate(nodes)}
    up = [0] * k
    kids: list[list[int]] = [[] for _ in range(k)]
    # sums over the subtree: chars, link chars, stops, blocks, paragraphs, list items, controls, good and bad below, paragraph chars
    total: list[list[int]] = [[]] * k
    flags: list[tuple[int, ...]] = [()] * k
    above: list[tuple[int, ...]] = [(0, 0, 0, 0)] * k
    link, raw, para, depth, before = [False] * k, [False] * k, [False] * k, [0] * k, [0] * k
    by_tag: dict[str, tuple[int, ...]] = {}
    seen = 0
    for i, n in enumerate(nodes):
        t = n.tag
        in_link, in_raw, in_para = t == "a", t in RAW, t in ("p", "pre", "blockquote")
        if i:
            p = up[i] = place[id(n.parent)]
            kids[p].append(i)
            in_link, in_raw, in_para, depth[i] = in_link or link[p], in_raw or raw[p], in_para or para[p], depth[p] + 1
            f, q = flags[p], above[p]
            above[i] = (q[0] + (f[0] > 0), q[1] + (f[1] > 0), q[2] + f[3], q[3] + f[4])
        link[i], raw[i], para[i], before[i] = in_link, in_raw, in_para, seen
        chars = stops = 0
        if not in_raw:
            for c in n.children:
                if isinstance(c, str):
                    chars += len(c.strip())
                    stops += len(_STOP.findall(c))
        seen += chars
        tag_flags = by_tag.get(t)
        if tag_flags is None:
            tag_flags = by_tag[t] = _tag_flags(t)
        f = flags[i] = (*(_named(n.names) if n.names else (0, 0, 0)), *tag_flags)
        total[i] = [chars, chars * in_link, stops, t in BLOCK, t == "p", t == "li", t in ("input", "button", "select", "textarea", "label"), f[0] > 0 or f[3] > 0, f[1] > 0 or f[4] > 0, chars * in_para]
    own_names = [(x[7], x[8]) for x in total]
    height = [0] * k
    for i in range(k - 1, 0, -1):  # children come after parents
        p = up[i]
        a, b = total[p], total[i]
        for j in range(10):
            a[j] += b[j]
        if height[i] >= height[p]:
            height[p] = height[i] + 1
    near: list[tuple[float, ...]] = [(0,) * 8] * k
    for c in kids:
        if not c:
            continue
        m = len(c)
        chars, links = sum(total[i][0] for i in c), sum(total[i][1] for i in c)
        same: dict[str, int] = {}
        for i in c:
            same[nodes[i].tag] = same.get(nodes[i].tag, 0) + 1
        good = sum(own_names[i][0] for i in c)
        last = 0
        for j, i in enumerate(c):
            own = total[i][0]
            rest = chars - own
            near[i] = (j / m, m, last, total[c[j + 1]][0] if j + 1 < m else 0, rest / max(1, m - 1), (links - total[i][1]) / max(1, rest), same[nodes[i].tag], good - own_names[i][0])
            last = own
    s, f, ab, nr, own = np.array(total, float), np.array(flags, float), np.array(above, float), np.array(near, float), np.array(own_names, float)
    page, chars = max(1.0, s[0, 0]), np.maximum(1.0, s[:, 0])
    log = np.log1p
    return np.column_stack((
        depth, height, [len(x) for x in kids], nr[:, 0], nr[:, 1], log(s[:, 0]), s[:, 0] / page, s[:, 0] / np.maximum(1.0, s[up, 0]), s[:, 1] / chars, s[:, 2] / chars, s[:, 0] / np.maximum(1, s[:, 3]), log(s[:, 3:5]), s[:, 9] / chars, log(s[:, 5:7]),
        f[:, :3], ab[:, :2], s[:, 7:9] - own, f[:, 3:5], ab[:, 2:], f[:, 5:],
        log(nr[:, 2:5]), nr[:, 5], nr[:, 6], np.array(before) / page, nr[:, 7],
    )).astype(np.float32)


class Boosted:
    """Boosted regression trees for two classes, on histograms."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray):
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = np.column_stack([np.searchsorted(c, v, "left") for c, v in zip(self.cuts, x.T)])
        score = np.zeros(len(y))
        self.trees = []
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            tree, leaf = self.grow(binned, weight * (y - p), weight * p * (1 - p))
            self.trees.append(tree)
            score += tree["value"][leaf]

    def grow(self, binned: np.ndarray, gradient: np.ndarray, hessian: np.ndarray) -> tuple[dict, np.ndarray]:
        """A complete tree as arrays: node n has children 2n+1, 2n+2."""
        size = 2 ** (DEPTH + 1) - 1
        feature, cut, value = np.full(size, -1), np.zeros(size), np.zeros(size)
        node = np.zeros(len(binned), int)
        for n in range(size):
            own = np.flatnonzero(node == n)
            if not len(own):
                continue
            g, h = gradient[own].sum(), hessian[own].sum()
            value[n] = RATE * g / (h + 1)
            if n >= 2**DEPTH - 1 or len(own) < 10:
                continue
            best, least = None, 1e-3
            for f in range(binned.shape[1]):
                b = binned[own, f]
                gl = np.bincount(b, gradient[own], BINS + 1).cumsum()[:-1]
                hl = np.bincount(b, hessian[own], BINS + 1).cumsum()[:-1]
                gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
                gain[(hl < 0.5) | (h - hl < 0.5)] = -1
                i = int(gain.argmax())
                if gain[i] > least and i < len(self.cuts[f]):
                    best, least = (f, i), gain[i]
            if best:
                feature[n], cut[n] = best[0], self.cuts[best[0]][best[1]]
                node[own] = 2 * n + 1 + (binned[own, best[0]] > best[1])
        return {"feature": feature, "cut": cut, "value": value}, node

    def __call__(self, x: np.ndarray) -> np.ndarray:
        score = np.zeros(len(x))
        rows = np.arange(len(x))
        for t in self.trees:
            node = np.zeros(len(x), int)
            for _ in range(DEPTH):
                f = t["feature"][node]
                node = np.where(f < 0, node, 2 * node + 1 + (x[rows, f] > t["cut"][node]))
            score += t["value"][node]
        return score


def decode(nodes: list[Node], odds: np.ndarray) -> np.ndarray:
    """The most likely choice in which every kept element has a kept parent; the page itself is kept.

    Below a node the best choice is worth its odds plus that of each child worth keeping; dropping it, with all below, is worth 0.
    """
    place = {id(n): i for i, n in enumerate(nodes)}
    up = [place[id(n.parent)] if n.parent is not None else -1 for n in nodes]
    worth = odds.astype(float).copy()
    for i in range(len(nodes) - 1, 0, -1):
        if worth[i] > 0:
            worth[up[i]] += worth[i]
    keep = np.zeros(len(nodes), bool)
    keep[0] = True
    for i in range(1, len(nodes)):
        keep[i] = keep[up[i]] and worth[i] > 0
    return keep


def blocks(nodes: list[Node], keep: np.ndarray) -> str:
    """The text of the kept elements, a line per block, white space as one space."""
    place = {id(n): i for i, n in enumerate(nodes)}
    out: list[str] = []
    run: list[str] = []

    def end() -> None:
        text = _SPACE.sub(" ", "".join(run)).strip()
        if text:
            out.append(text)
        run.clear()

    todo: list[tuple[Node | str, bool]] = [(nodes[0], False)]
    while todo:
        item, leaving = todo.pop()
        if isinstance(item, str):
            run.append(item)
            continue
        if leaving:
            end()
            continue
        if not keep[place[id(item)]] or item.tag in RAW:
            continue
        if item.tag == "br":
            run.append(" ")
        elif item.tag in BLOCK or item.tag == "#page":
            end()
            todo.append((item, True))
        todo.extend((c, False) for c in reversed(item.children))
    end()
    return "\n".join(out)


def labels(nodes: list[Node]) -> np.ndarray | None:
    """1 article, 0 not, -1 unknown per element, where landmarks tell; None for a page without an article."""
    if not any(n.tag in GOOD_TAGS for n in nodes):
        return None
    place = {id(n): i for i, n in enumerate(nodes)}
    y = np.zeros(len(nodes))
    holds = np.zeros(len(nodes), bool)
    for i in range(len(nodes) - 1, -1, -1):
        holds[i] |= nodes[i].tag in GOOD_TAGS
        if i and holds[i]:
            holds[place[id(nodes[i].parent)]] = True
    for i, n in enumerate(nodes):
        p = place[id(n.parent)] if n.parent is not None else -1
        names = tokens(n.names)
        bad = n.tag in BAD_TAGS or n.tag in RAW or n.hidden or bool(names & BAD) and not names & GOOD
        y[i] = float(not bad and (n.tag in GOOD_TAGS or holds[i] or (p >= 0 and y[p] == 1 and not (holds[p] and nodes[p].tag not in GOOD_TAGS))))
    return y


def _bare(page: str) -> str:
    """A copy whose article has no element of its own."""
    def open_up(m: re.Match) -> str:
        return re.sub(r"<(p|h\d|ul|ol|blockquote|table|pre|figure)\b", r'<\1 data-y="1"', m[1])

    return re.sub(r"<article\b[^>]*>(.*)</article>", open_up, page, flags=re.DOTALL)


def _disguised(page: str, other: list[str], rng: random.Random) -> str:
    """A copy of a page with landmarks turned into other elements, and with the parts around an article that other sites have."""
    good = rng.choice(["content", "post-content", "entry-content", "article-body", "story", "main-content", "post", "text", "c1", "wrap", "x-17"])
    tag = rng.choice(["div", "div", "section", "main", "article"])
    page = re.sub(r"<article\b", f'<{tag} data-y="1" class="{good}"', page)
    page = page.replace("</article>", f"</{tag}>")
    if rng.random() < 0.6:
        for landmark, names in (("nav", "menu navbar topnav links m2"), ("footer", "footer site-footer bottom f3"), ("aside", "sidebar rail side")):
            name = rng.choice(names.split())
            page = re.sub(rf"<{landmark}\b", f'<div class="{name}"', page).replace(f"</{landmark}>", "</div>")

    def some(n: int, size: int = 200) -> str:
        return "".join(f"<p>{rng.choice(other)[:rng.randint(20, size)]}</p>" for _ in range(n))

    extra = [
        lambda: f'<div class="{rng.choice(["comments", "comment-list", "disqus_thread", "replies"])}"><h3>{rng.choice(other)[:12]}</h3>' + "".join(f'<div class="comment">{some(rng.randint(1, 2))}</div>' for _ in range(rng.randint(1, 5))) + "</div>",
        lambda: f'<section id="comments"><ol>' + "".join(f"<li>{some(1)}</li>" for _ in range(rng.randint(1, 4))) + "</ol></section>",
        lambda: f'<aside class="{rng.choice(["sidebar", "related", "widget"])}"><h3>{rng.choice(other)[:15]}</h3><ul>' + "".join(f'<li><a href="/{i}">{rng.choice(other)[:30]}</a></li>' for i in range(rng.randint(2, 6))) + "</ul></aside>",
        lambda: f'<div class="{rng.choice(["cookie-notice", "notice", "alert", "newsletter", "subscribe", "banner", "promo", "ad", "advert", "sponsored"])}">{some(1, 250)}</div>',
        lambda: f'<form action="/s"><label>{rng.choice(other)[:20]}</label><input name="q"><button>{rng.choice(other)[:8]}</button></form>',
        lambda: f"<header><h2>{rng.choice(other)[:30]}</h2><p>{rng.choice(other)[:60]}</p></header>",
        lambda: f'<div class="{rng.choice(["share", "breadcrumbs", "tags", "byline", "pagination"])}">' + " ".join(f'<a href="/{i}">{rng.choice(other)[:10]}</a>' for i in range(rng.randint(2, 5))) + "</div>",
    ]
    for put in rng.sample(extra, rng.randint(2, 5)):
        if rng.random() < 0.35:
            page = re.sub(rf'(<{tag} data-y="1"[^>]*>)', lambda m: m[1] + put(), page, count=1)
        elif rng.random() < 0.5:
            page = re.sub(rf"(</{tag}>)(?!.*</{tag}>)", lambda m: put() + m[1], page, count=1, flags=re.DOTALL) if tag in ("article", "main") else page.replace("</body>", put() + "</body>")
        else:
            page = re.sub(rf'(<{tag} data-y="1")', lambda m: put() + m[1], page, count=1)
    return page


class _Marked(Tree):
    """A tree that knows which element was the article of a rewritten page."""

    def __init__(self, page: str):
        self.article: list[Node] = []
        super().__init__(page)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        super().handle_starttag(tag, attrs)
        if ("data-y", "1") in attrs:
            self.article.append(self.at)


def _examples(pages: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and weights of the elements of pages with landmarks, each once as it is and four times rewritten."""
    rng = random.Random(6)
    other = [t for p in pages for t in re.findall(r"<p>([^<>]{30,})</p>", p)] or ["Lorem ipsum dolor sit amet, consectetur adipiscing elit."]
    xs, ys, ws = [], [], []
    for page in pages:
        for copy in range(5):
            html = page if copy == 0 else _bare(page) if copy == 4 else _disguised(page, other, rng)
            tree = _Marked(html)
            article = {id(n) for n in tree.article}
            nodes, todo = [], [tree.root]
            while todo:
                n = todo.pop()
                nodes.append(n)
                todo.extend(c for c in reversed(n.children) if not isinstance(c, str))
            if article:
                tags = {id(n): n.tag for n in nodes}
                for n in nodes:
                    if id(n) in article:
                        n.tag = "article"
                y = labels(nodes)
                for n in nodes:
                    n.tag = tags[id(n)]
            else:
                y = labels(nodes)
            if y is None or not y.any():
                continue
            x = features(nodes)
            xs.append(x), ys.append(y), ws.append(np.sqrt(1 + np.expm1(x[:, FEATURES.index("chars")]) / 50))
    if not xs:
        return np.zeros((0, len(FEATURES)), np.float32), np.zeros(0), np.zeros(0)
    return np.vstack(xs), np.concatenate(ys), np.concatenate(ws)


# A page with the usual parts, for inputs whose own pages have no landmarks.
USUAL = """<html><head><title>A title here</title></head><body><header><h2>The site</h2></header><nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>
<div class="ad">Buy this now.</div><article><h1>A title here</h1><p>The first paragraph, which says what happened, to whom, and where.</p><p>A second one of some length follows, with more; it ends here.</p>
<ul><li>One thing to note.</li><li>Another thing.</li></ul><p>And the last words of it are these, after all.</p></article><aside><p>Read also our other stories.</p></aside><footer>&copy; The site. All rights.</footer></body></html>"""


def fit(pages: DataFrame, html: str = "html", sample: int = SAMPLE) -> Boosted:
    """Trees fitted on ``sample`` pages with an article or main element, drawn by hash; bounded by SAMPLE and SAMPLE_CHARS.

    Where none has one, on a page of the usual parts. All else about the operator sees every page.
    """
    told = pages.filter(F.col(html).rlike(r"(?i)<(article|main)\b") & (F.length(html) <= SAMPLE_CHARS)).select(F.col(html).alias("h"))
    told = told.withColumn("k", F.pmod(F.xxhash64("h"), F.lit(1 << 40)))
    n = told.select("k").distinct().count()  # copies share one hash and teach once
    # hashes are spread evenly: a range of them holds a little over ``sample`` pages, whatever the size of the table; if too few, it is doubled
    span, drawn = (1 << 40) * sample * 5 // (4 * max(n, 1)) + 1, []
    while len(drawn) < min(sample, n):
        drawn = told.filter(F.col("k") < span).dropDuplicates(["k"]).collect()
        span *= 2
    drawn = [r["h"] for r in sorted(drawn, key=lambda r: (r["k"], r["h"]))[:sample]]
    return Boosted(*_examples(drawn + [USUAL] * 10))


def extract(pages: list[str], trees: Boosted) -> Iterator[str]:
    """The main text of each page; pages are scored some at a time, so that the trees see many elements at once."""
    held: list[tuple[list[Node], np.ndarray] | None] = []

    def flush() -> Iterator[str]:
        rows = [x for h in held if h for x in [h[1]]]
        odds = trees(np.vstack(rows)) if rows else np.zeros(0)
        at = 0
        for h in held:
            if h is None:
                yield ""
                continue
            nodes, own = h[0], odds[at: at + len(h[0])]
            at += len(nodes)
            formula: set[int] = set()
            for i, n in enumerate(nodes):
                if n.hidden or n.tag in RAW:
                    own[i] = -50
                elif n.tag == "math" or id(n.parent) in formula:
                    formula.add(id(n))
                    own[i] = 1e-6  # a formula goes with the text it stands in
            yield blocks(nodes, decode(nodes, own))
        held.clear()

    size = 0
    for page in pages:
        nodes = parse(page) if page and page.strip() else None
        held.append((nodes, features(nodes)) if nodes else None)
        size += len(nodes) if nodes else 1
        if size >= 20_000:
            yield from flush()
            size = 0
    yield from flush()


def main_text(pages: DataFrame, html: str = "html", trees: Boosted | None = None) -> DataFrame:
    """``pages`` as struct ``r`` with ``text``: the article's blocks, one line each, in page order.

    Null, empty and blank pages, and pages with nothing that looks like an article, give an empty text. Pages are read whole whatever their
    length; repeated rows give equal texts; other columns stay inside ``r``.
    """
    shared = pages.sparkSession.sparkContext.broadcast(trees or fit(pages, html))  # TREES small trees

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(list(extract(texts, shared.value)), dtype=object)

    return pages.select(F.struct("*").alias("r"), run(F.col(html)).alias("text"))


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    done = main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return done.select("r.page_id", "r.url", "text", F.length("text").cast("long").alias("n_chars"))


QUERIES = {"op6_main_text": op6_main_text}
ORACLES: dict[str, str] = {}
