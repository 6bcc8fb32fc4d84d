"""Operator 10, HTML extraction: tree scoring.

Method. A page becomes a tree of elements (unclosed and misnested tags are mended as browsers do in the common cases).
Elements that can't be part of an article go first: by name, role, or words of their class and id. Lists, tables and
paragraphs that are mostly links don't score; outside the container that is kept they go, within it they stay, since a
list of references is part of its article. Each other paragraph scores by its length and commas and passes its points to its ancestors, whole to the
parent, half to the next and less further up; a container's points are discounted by its link density. The best container,
or the article element around it, is kept, with those of its siblings that score well, are headings or read like prose. The text is
that of the kept blocks in page order.

Defined results. Null and empty pages, and pages without text: an empty text. Pages without a paragraph that scores: the
article or main element, else what is left of the body. A page that breaks off is taken as far as it goes. Repeated rows:
a row each. Extra columns aren't read. Time and memory are linear in a page's length: no tag climbs past elements that it
doesn't close.

Scale: one scan without a shuffle.
"""

from __future__ import annotations

import html as entities
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

#: Classes of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template select noembed noframes".split())
GONE = frozenset("nav footer aside form button dialog menu video audio fieldset head input".split()) | RAW
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PROSE = frozenset("p pre blockquote td dd li figcaption".split())
LISTS = frozenset("ul ol dl table div section p".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
FENCE = frozenset("table ul ol dl article section div body html td th main aside nav footer header form blockquote".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
UNLIKELY = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot banner sponsor sponsored promo promoted promotion sidebar sidenav aside"
    " comment comments commentlist disqus respond cookie cookies consent gdpr notice notices notification alert popup modal overlay lightbox nav navbar"
    " navigation menu menus submenu breadcrumb breadcrumbs footer footnav header masthead topbar share sharing social related recommended recommendations"
    " newsletter subscribe subscription signup login widget widgets toolbar pagination pager skip disclaimer paywall tags tagcloud legal copyright".split()
)
#: Words that an article's own parts may carry: within an article they tell of something else only where most is links.
WEAK = frozenset("legal tags tagcloud copyright skip related recommended recommendations share sharing social widget widgets toolbar banner masthead topbar header disclaimer respond alert modal overlay".split())
STRONG = frozenset("comment comments commentlist disqus cookie cookies advert adverts advertisement ad ads sidebar".split())
#: Words that stand beside those of UNLIKELY in the names of classes without changing what they name.
BESIDE = frozenset(
    "area areas list lists section sections wrapper wrap container holder box boxes block blocks bar bars slot slots site page main left right top bottom upper lower primary secondary inner outer item items unit units"
    " link links form thread row rows column columns col panel pane group inline sticky fixed global local mobile desktop small large full js id mod module component region zone spot text body content title icon icons button buttons btn message view layer strip rail".split()
)
LIKELY = frozenset("article body content main column entry post story text page container wrapper prose".split())
HEAVY = {"article": 25, "main": 15, "section": 3, "div": 5, "blockquote": 3, "td": 3, "pre": 3, "ul": -3, "ol": -3, "dl": -3, "address": -3, "form": -3, "th": -5}

LISTED = frozenset("ul ol dl table select".split())
#: A bit for each tag that a start tag may close.
BIT = {tag: 1 << k for k, tag in enumerate(sorted(set().union(*CLOSES.values())))}
ENDS = {tag: sum(BIT[x] for x in own) for tag, own in CLOSES.items()}
MOST_LOOSE = 100
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTR = re.compile(r"""([^\s=/"'>]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s>]*+))?+""")
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_WANTED = ("class", "id", "role", "hidden", "aria-hidden", "style")


class Node:
    """in_p: whether a paragraph is open here that a block would close; items: bits of the open tags that a start tag may close;
    open_: how many of each tag are open in this table cell, which end tags of most other elements don't leave."""

    __slots__ = ("tag", "attrs", "kids", "up", "score", "size", "linked", "commas", "menu", "in_p", "items", "open_")

    def __init__(self, tag: str, attrs: dict[str, str], up: Node | None):
        self.tag, self.attrs, self.up = tag, attrs, up
        self.kids: list = []
        self.score, self.size, self.linked, self.commas = 0.0, 0, 0, 0
        self.menu = False
        self.in_p = tag == "p" or up is not None and up.in_p and tag not in FENCE
        self.items = BIT.get(tag, 0) | (0 if up is None or tag in LISTED else up.items)
        self.open_ = {} if up is None or tag in ("td", "th") else up.open_


def _attributes(text: str) -> dict[str, str]:
    if not text or text.isspace():
        return {}
    low = text.lower()
    if not any(k in low for k in _WANTED):
        return {}
    return {m[1].lower(): entities.unescape((m[2] or "").strip("\"'")) for m in _ATTR.finditer(text) if m[1].lower() in _WANTED}


def parse(page: str) -> Node:
    """The page's tree; text is decoded.

    A start or end tag climbs only to an element that it closes, which is known beforehand, so that the climb's steps are
    those of the elements closed.
    """
    root = node = Node("html", {}, None)
    total: dict[str, int] = {}  # open elements by tag
    at, end, loose = 0, len(page), 0
    no_comment = False

    def leave(to: Node) -> Node:
        """Closes the elements from the current one up to the one given, which is closed too."""
        here = node
        while True:
            total[here.tag] -= 1
            here.open_[here.tag] -= 1
            if here is to:
                return here.up
            here = here.up

    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            lt = end
        if lt > at:
            node.kids.append(entities.unescape(page[at:lt]))
        if lt == end:
            break
        if page.startswith("<!--", lt):
            stop = -1 if no_comment else page.find("-->", lt + 4)
            no_comment |= stop < 0
            at = stop + 3 if stop >= 0 else end
            continue
        c = page[lt + 1 : lt + 2]
        if c in ("!", "?"):
            stop = page.find(">", lt)
            at = stop + 1 if stop >= 0 else end
            continue
        m = None
        if c == "/" or c.isalpha():
            m = _TAG.match(page, lt) if loose < MOST_LOOSE else None
            if m is None:  # an open quotation mark, after which the whole rest was read: not more than some times
                loose += 1
                m = _LOOSE.match(page, lt)
            if m is None and page.find(">", lt) < 0:  # broken off within a tag
                break
        if m is None:
            node.kids.append("<")
            at = lt + 1
            continue
        at, tag = m.end(), m[2].lower()
        if m[1]:
            # Most end tags don't leave the table cell that they stand in.
            known = total if tag in ("table", "tr", "tbody", "body", "html", "td", "th") else node.open_
            if known.get(tag, 0) > 0:
                open_ = node
                while open_.tag != tag:
                    open_ = open_.up
                node = leave(open_)
            continue
        if tag in ("html", "body") and node.up is None or tag == "html":
            continue
        if tag in RAW:
            if not m[3].rstrip().endswith("/") or tag in ("script", "style", "title", "textarea"):
                stop = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
                if stop is None:
                    at = end
                else:
                    close = page.find(">", stop.start())
                    at = close + 1 if close >= 0 else end
            continue
        if tag in BLOCK and node.in_p:
            open_ = node
            while open_.tag != "p":
                open_ = open_.up
            node = leave(open_)
        while tag in CLOSES and node.items & ENDS[tag]:
            open_ = node
            while open_.tag not in CLOSES[tag]:
                open_ = open_.up
            node = leave(open_)
        made = Node(tag, _attributes(m[3]), node)
        node.kids.append(made)
        if tag not in VOID and not m[3].endswith("/"):
            node = made
            total[tag] = total.get(tag, 0) + 1
            node.open_[tag] = node.open_.get(tag, 0) + 1
    return root


def _tokens(attrs: dict[str, str]) -> set[str]:
    text = attrs.get("class", "") + " " + attrs.get("id", "")
    return {x for x in _SPLIT.split(_CAMEL.sub(" ", text).lower()) if x} if text != " " else set()


def _names(attrs: dict[str, str]) -> list[list[str]]:
    """The names of an element's classes and its id, each as the list of its words."""
    names = (attrs.get("class", "") + " " + attrs.get("id", "")).split()
    return [[x for x in _SPLIT.split(_CAMEL.sub(" ", n).lower()) if x] for n in names]


def _unlikely(name: list[str], words: frozenset[str]) -> bool:
    """Whether a name says that the element is one of these: all of its words do, or stand beside. `comments-area` says so, and
    `post-comments`, whose last word counts; `comments-open`, `ad-hoc` and `newsletter-history` don't."""
    said = [w for w in name if w not in BESIDE and not w.isdigit()] or name
    if not any(w in words for w in said):
        return False
    return all(w in UNLIKELY for w in said) or said[-1] in words & STRONG and all(w in UNLIKELY or w in LIKELY for w in said)


def _hidden(node: Node, in_article: bool) -> bool:
    """Whether an element can't be part of the article."""
    if node.tag in GONE or node.tag == "header" and not in_article:
        return True
    a = node.attrs
    if not a or node.tag in ("html", "body", "main"):
        return False
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", ""), re.I):
        return True
    if a.get("role", "").lower() in ROLES:
        return True
    if node.tag in HEADINGS:
        return False
    names = _names(a)
    if any(_unlikely(n, STRONG) for n in names):
        return True
    return any(_unlikely(n, UNLIKELY - WEAK if in_article else UNLIKELY) for n in names) and not _tokens(a) & LIKELY


def _prose_below(order: list[Node]) -> dict[int, tuple[int, bool]]:
    """For each element, letters of the paragraphs in it that are no links, and whether it holds an article or a first heading."""
    out: dict[int, tuple[int, bool]] = {}
    for node in reversed(order):
        letters, holds = 0, node.tag in ("article", "main", "h1")
        for k in node.kids:
            if isinstance(k, str):
                letters += len(k.strip()) if node.tag != "a" else 0
            else:
                below = out[id(k)]
                letters, holds = letters + (below[0] if k.tag != "a" and k.tag not in RAW else 0), holds or below[1]
        out[id(node)] = (letters, holds)
    return out


def _measure(root: Node) -> None:
    """Takes out what can't be part of the article, then sets each element's text length, length within links, and commas.

    Elements that are mostly links are marked as menus and count for nothing in those around them.
    """
    every, stack = [], [root]
    while stack:
        every.append(stack.pop())
        stack.extend(k for k in every[-1].kids if not isinstance(k, str))
    prose = _prose_below(every)
    most = 0.5 * prose[id(root)][0]

    def spared(k: Node) -> bool:
        """What holds most of the page's text with its article or first heading isn't beside the article; nor is a form around it all."""
        letters, holds = prose[id(k)]
        return letters > most and (holds or k.tag == "form") and k.tag not in ("nav", "footer", "dialog", "menu", "head")

    order, stack = [], [(root, False)]
    while stack:
        node, inside = stack.pop()
        inside |= node.tag in ("article", "main")
        node.kids = [k for k in node.kids if isinstance(k, str) or not _hidden(k, inside) or spared(k)]
        order.append(node)
        stack.extend((k, inside) for k in node.kids if not isinstance(k, str))
    weak: list[Node] = []
    for node in reversed(order):
        links = 0
        for k in node.kids:
            if isinstance(k, str):
                node.size += len(k.strip())
                node.commas += k.count(",") + k.count("，") + k.count("、")
                continue
            anchors = k.score  # number of links below, until scores are given
            if k.tag in LISTS and anchors >= 3 and k.size and k.linked > 0.7 * k.size:
                k.menu = True
                continue
            if k.linked > 0.5 * k.size and k.tag not in HEADINGS and _tokens(k.attrs) & WEAK and not _tokens(k.attrs) & LIKELY:
                weak.append(k)
                continue
            node.size += k.size
            node.linked += k.linked
            node.commas += k.commas
            links += anchors
        if node.tag == "a":
            node.linked, links = node.size, links + 1
        node.score = links
    for node in order:
        node.score = 0.0
    for node in weak:
        node.kids, node.size, node.linked = [], 0, 0


def _class_points(node: Node) -> int:
    words = _tokens(node.attrs)
    return 25 * bool(words & LIKELY) - 25 * bool(words & UNLIKELY)


def _density(node: Node) -> float:
    return node.linked / node.size if node.size else 0.0


def _walk(root: Node):
    """The elements but for menus and what is in them."""
    stack = [root]
    while stack:
        node = stack.pop()
        yield node
        stack.extend(k for k in reversed(node.kids) if not isinstance(k, str) and not k.menu)


def _is_prose(node: Node) -> bool:
    if node.tag in PROSE:
        return True
    return node.tag in ("div", "section", "article", "main", "body") and any(isinstance(k, str) and len(k.strip()) > 20 for k in node.kids)


def _alike(k: Node, best: Node) -> bool:
    """Whether a sibling is another part of the same article: of one kind and name, and prose."""
    return k.tag == best.tag and k.tag not in PROSE and _tokens(k.attrs) == _tokens(best.attrs) and k.size >= 25 and _density(k) < 0.25 and any(n.tag in ("p", "pre", "blockquote") and n.size for n in _walk(k))


def _level(best: Node) -> Node:
    """The best container, or the one around it, up to three levels, that has parts like it beside it."""
    node = best
    for _ in range(4):
        if node.up is None or node.tag in ("body", "html"):
            return best
        if any(k is not node and not isinstance(k, str) and not k.menu and _alike(k, node) for k in node.up.kids):
            return node
        node = node.up
    return best


def best_parts(root: Node) -> list[Node]:
    """The elements that make up the article, in page order."""
    candidates: dict[int, Node] = {}
    for node in _walk(root):
        if not _is_prose(node) or node.size < 25:
            continue
        points = 1 + node.commas + min(node.size / 100, 3)
        up, level = (node.up if node.tag in PROSE else node), 0
        while up is not None and level < 5:
            if id(up) not in candidates:
                candidates[id(up)] = up
                up.score = HEAVY.get(up.tag, 0) + _class_points(up)
            up.score += points / (1 if level == 0 else 2 if level == 1 else 3 * level)
            up, level = up.up, level + 1
    articles = [n for n in _walk(root) if n.tag in ("article", "main") and n.size]
    if not candidates:
        return [max(articles, key=lambda n: n.size)] if articles else [root]
    for node in candidates.values():
        node.score *= 1 - _density(node)
    best = max(candidates.values(), key=lambda n: n.score)
    around = best
    while around is not None and around.tag not in ("article", "main"):
        around = around.up
    if around is not None:
        best = around
    elif articles and best.tag in ("html", "body"):
        best = max(articles, key=lambda n: n.size)
    if around is None:
        best = _level(best)
    if best.up is None:
        return [best]
    least = max(10.0, 0.2 * best.score)
    out = []
    for k in best.up.kids:
        if isinstance(k, str) or k.menu:
            continue
        same = bool(_tokens(k.attrs) & _tokens(best.attrs))
        prose = k.tag == "p" and (k.size > 80 and _density(k) < 0.25 or 0 < k.size <= 80 and _density(k) == 0)
        if k is best or around is None and _alike(k, best) or k.tag in HEADINGS and k.size and _density(k) < 0.5 or id(k) in candidates and k.score + 0.2 * best.score * same >= least or prose:
            out.append(k)
    return out


def blocks(parts: list[Node]) -> list[str]:
    """The texts of the blocks, white space made single."""
    out: list[str] = []
    held: list[str] = []

    def close() -> None:
        if text := " ".join("".join(held).split()):
            out.append(text)
        held.clear()

    for part in parts:
        stack: list = [part]
        while stack:
            x = stack.pop()
            if x is None:
                close()
            elif isinstance(x, str):
                held.append(x)
            elif x.tag == "br":
                held.append(" ")
            else:
                block = x.tag in BLOCK
                if block:
                    close()
                    stack.append(None)
                stack.extend(reversed(x.kids))
        close()
    return out


def extract(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    _measure(root)
    return "\n".join(blocks(best_parts(root)))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every row."""
    src = pages.select(F.col(id_col), F.col(url_col), F.col(html_col).cast("string").alias("__html"))
    kind, url = (src.schema[i].dataType.simpleString() for i in (0, 1))

    def run(batches):
        for batch in batches:
            texts = [extract(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    return src.mapInArrow(run, f"`{id_col}` {kind}, `{url_col}` {url}, text string, n_chars bigint")


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(shared.table(spark, sf_dir, "pages"))
