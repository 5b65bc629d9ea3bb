"""Main text of web pages by tree scoring.

The page becomes a tree of elements. Every paragraph passes points for its length and its
commas to its ancestors, less the further up, and each candidate's points are discounted by
the share of its text that stands in links. The best container and those of its siblings
that read like text are kept; menus, headers, footers, sidebars, notices, adverts, forms,
scripts, styles and reader comments inside them are left out. So are blocks that consist of links. Within
an article a word such as "related" or "social" in a longer name (``related-work``) doesn't make an element noise
if it is a paragraph or reads like prose.

A page is one row, handled by an Arrow-batched function without any shuffle, in time proportional
to its length: a quoted attribute that never ends is looked for once, and elements nested deeper than ``MAX_DEPTH``
become siblings, with all their text.

Defined results: a null page, an empty page and a page without text give an empty text; an empty
table gives no rows; pages of any length are read whole; of containers with equal points the first counts;
repeated rows are handled one by one; unclosed or stray tags are repaired, never an error; the text of a tag
that the page ends in stays; extra columns pass through, one named ``text`` is replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from themeweave.llm.columns import without

# Element names by their role in HTML.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary "
    "table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = frozenset(
    "head nav aside footer form button select option datalist dialog menu object applet audio video canvas map".split()
)
PARAGRAPHS = frozenset("p pre td blockquote li dd h1 h2 h3 h4 h5 h6".split())
LISTS = frozenset("ul ol dl table figure".split())
CONTAINERS = LISTS | {"div", "section"}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: What a new element closes, and where the search for it stops.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
#: Base points of a container by its element.
BASE = {"article": 25, "main": 25, "section": 5, "div": 5, "body": 0, "td": 3, "blockquote": 3, "pre": 3, "ul": -3, "ol": -3, "dl": -3}

#: Elements nested deeper become siblings.
MAX_DEPTH = 512

# Comments, declarations, and tags with or without regard to quoted attributes.
MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>", re.S)
TAG = re.compile(r"<(/?)([a-z][^\s/>]*+)((?>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+))>", re.S | re.I)
SIMPLE_TAG = re.compile(r"<(/?)([a-z][^\s/>]*+)([^>]*+)>", re.S | re.I)
RAW = frozenset("script style noscript template textarea iframe title svg math".split())
RAW_END = {name: re.compile(rf"</{name}\s*+>", re.I) for name in RAW}
NAMES = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"(?<![\w-])(?:hidden(?![\w-])|aria-hidden\s*=\s*[\"']?true|style\s*=\s*[\"'][^\"']*display\s*:\s*none)", re.I)
WEAK_WORDS = (
    r"header|masthead|banner|side|rail|foot|social|related|recommend\w*|share|sharing|widget|search|skip|overlay|toolbar"
)
NOISE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|sidebar|menu|nav\w*|breadcrumbs?|"
    r"footer|comments?|respond|replies|disqus\w*|cookies?|consent|gdpr|notices?|alert|popup|modal|"
    r"newsletter|subscribe|signup|login|pagination|pager|complementary|contentinfo|navigation|dialog)(?:$|[\s_-])"
    rf"|(?:^|\s)(?:{WEAK_WORDS})"
    r"(?:[_-](?:posts?|articles?|links?|stories|content|buttons?|media|bar|icons?|box|list|items?|news))?(?:$|\s)",
    re.I,
)
#: Words that in a longer name may just as well belong to the article.
WEAK = re.compile(rf"(?:^|[\s_-])(?:{WEAK_WORDS})(?:$|[\s_-])", re.I)
#: What an element with such a name must have to stay: code points outside of links, and share of text in links.
PROSE_CHARS, PROSE_LINKS = 80, 0.3
#: From this share on, and with several links, a block inside of the article is a menu.
MENU_LINKS = 0.8


class _Node:
    __slots__ = ("tag", "parent", "children", "noise", "points", "chars", "linked", "links", "inside", "suspect", "depth")

    def __init__(self, tag: str, parent: _Node | None, noise: bool, suspect: bool = False):
        self.tag, self.parent, self.noise, self.suspect = tag, parent, noise, suspect
        self.depth = parent.depth + 1 if parent is not None else 0
        self.links = 0
        self.children: list[_Node | str] = []
        self.points, self.chars, self.linked = float(BASE.get(tag, 0)), 0, 0
        self.inside = parent is not None and (parent.inside or parent.tag in ("article", "main"))


def _is_noise(tag: str, attributes: str, parent: _Node) -> tuple[bool, bool]:
    """Whether an element is noise, and whether its name only makes it suspect."""
    inside = parent.inside or parent.tag in ("article", "main")
    if tag in DROPPED or (tag == "header" and not inside):
        return True, False
    if not attributes or tag in ("html", "body", "main"):
        return False, False
    names = " ".join(a or b or c for a, b, c in NAMES.findall(attributes))
    if names and NOISE.search(names):
        return not (tag == "article" and not NOISE.search(names.replace("header", ""))), False
    if HIDDEN.search(attributes):
        return True, False
    weak = bool(names and tag != "article" and WEAK.search(names))
    if weak and inside:
        return False, tag not in PARAGRAPHS
    return weak, False


def parse(html: str) -> tuple[_Node, list[_Node]]:
    """The root and all elements, parents before children."""
    root = _Node("#root", None, False)
    nodes, here, done = [root], root, 0
    path: Counter[str] = Counter()
    last, quoted = html.rfind(">"), True
    at = html.find("<")
    while 0 <= at < last or (at >= 0 and html.startswith("<!--", at)):
        token = MARKUP.match(html, at)
        tag = None
        if token is None:
            tag = token = TAG.match(html, at) if quoted else SIMPLE_TAG.match(html, at)
            if token is None and quoted:
                tag = token = SIMPLE_TAG.match(html, at)
                quoted = token is None  # a quote never ends: don't look for its end again
        if token is None:
            at = html.find("<", at + 1)
            continue
        if at > done:
            here.children.append(unescape(html[done:at]))
        done = token.end()
        if tag is not None:
            name = tag[2].lower()
            if name in RAW and not tag[1]:
                end = RAW_END[name].search(html, done)
                done = end.end() if end else len(html)
            else:
                before, here = here, _place(name, bool(tag[1]), tag[3], here, root, nodes, path)
                while before is not here and before is not here.parent:
                    path[before.tag] -= 1
                    before = before.parent
                path[here.tag] += before is not here
        at = html.find("<", done)
    if done < len(html):
        here.children.append(unescape(html[done:]))
    return root, nodes


def _place(name: str, closes: bool, attributes: str, here: _Node, root: _Node, nodes: list[_Node], path: Counter[str]) -> _Node:
    """Put a tag into the tree; the element that goes on after it. ``path`` counts the open elements by name."""
    if closes:
        if not path[name]:
            return here
        up = here
        while up is not root and up.tag != name:
            up = root if name not in BLOCKS and up.tag in BLOCKS else up.parent
        return here if up is root else up.parent
    if name in BLOCKS:
        here = _closed(here, name, root, path)
    node = _Node(name, here, *_is_noise(name, attributes, here))
    here.children.append(node)
    nodes.append(node)
    if name in VOID or attributes.endswith("/"):
        return here
    if node.depth >= MAX_DEPTH and not node.noise:
        return here
    return node if node.depth < 2 * MAX_DEPTH else here


def _closed(here: _Node, name: str, root: _Node, path: Counter[str]) -> _Node:
    """Where a block element called ``name`` goes once what it ends is closed."""
    ends, stops = CLOSES.get(name, (frozenset(("p",)), frozenset()))
    up, found = here, here
    left = sum(path[tag] for tag in ends | {"p"})
    while left and up is not root and up.tag not in stops:
        if up.tag in ends or up.tag == "p":
            found, left = up.parent, left - 1
        elif up.tag in BLOCKS and name not in CLOSES:
            break
        up = up.parent
    return found


def _measure(nodes: list[_Node]) -> None:
    """Text and link sizes of every element, then the points that paragraphs pass on."""
    commas: dict[int, int] = {}
    for node in reversed(nodes):
        own = "".join(x for x in node.children if isinstance(x, str))
        node.chars += len(" ".join(own.split()))
        if node.tag == "a":
            node.linked, node.links = node.chars, 1
        if node.suspect and (node.chars - node.linked < PROSE_CHARS or _density(node) > PROSE_LINKS):
            node.noise = True
        mine = commas.get(id(node), 0) + own.count(",") + own.count("、") + own.count("，")
        if node.noise:
            node.chars = node.linked = 0
        elif node.parent is not None:
            node.parent.chars += node.chars
            node.parent.linked += node.linked
            node.parent.links += node.links
            if node.tag not in BLOCKS:
                commas[id(node.parent)] = commas.get(id(node.parent), 0) + mine
        commas[id(node)] = mine
    hidden = set()
    for node in nodes:
        if node.noise or (node.parent is not None and id(node.parent) in hidden):
            hidden.add(id(node))
        elif node.tag in PARAGRAPHS or (node.tag in ("div", "section") and any(isinstance(x, str) and x.strip() for x in node.children)):
            if node.chars:
                points = (1 + commas[id(node)] + min(node.chars / 100, 3.0)) * (1 - node.linked / node.chars)
                up, share = node.parent, 1.0
                while up is not None and share > 0.01:
                    up.points += points * share
                    up, share = up.parent, share / 2


def _density(node: _Node) -> float:
    return node.linked / node.chars if node.chars else 0.0


def _is_menu(node: _Node) -> bool:
    return node.tag in CONTAINERS and node.links > 1 and _density(node) >= MENU_LINKS


def _kept(nodes: list[_Node]) -> list[_Node]:
    """The best container with the siblings that belong to it, in page order."""
    hidden, best, top = set(), None, float("-inf")
    for node in nodes:
        if node.noise or (node.parent is not None and id(node.parent) in hidden):
            hidden.add(id(node))
        elif node.tag in ("article", "main", "section", "div", "body", "td", "blockquote", "pre", "ul", "ol", "dl", "#root") and node.chars:
            score = node.points * (1 - _density(node))
            if score > top:
                best, top = node, score
    if best is None:
        return []
    up = best
    while up is not None:
        if up.tag in ("article", "main"):
            best = up
        up = up.parent
    if best.parent is None or best.tag in ("body", "main"):
        return [best]
    kept = []
    for node in best.parent.children:
        if isinstance(node, str) or id(node) in hidden:
            continue
        if node is best:
            kept.append(node)
        elif best.tag == "article":
            if node.tag == "article":
                kept.append(node)
        elif node.tag in HEADINGS or (node.tag in LISTS | PARAGRAPHS and _density(node) < 0.5):
            kept.append(node)
        elif node.tag in BLOCKS and node.points * (1 - _density(node)) >= max(6.0, 0.1 * top):
            kept.append(node)
    return kept


def _blocks(kept: list[_Node]) -> list[str]:
    blocks: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = " ".join("".join(line).split())
        line.clear()
        if text:
            blocks.append(text)

    for top in kept:
        flush()
        todo: list[tuple[_Node, int]] = [(top, 0)]
        while todo:
            node, i = todo.pop()
            if i == 0 and node.tag in BLOCKS:
                flush()
            if i == len(node.children):
                if node.tag in BLOCKS:
                    flush()
                continue
            todo.append((node, i + 1))
            child = node.children[i]
            if isinstance(child, str):
                line.append(child)
            elif child.tag == "br":
                line.append(" ")
            elif not child.noise and not (child.inside and _is_menu(child)):
                todo.append((child, 0))
    flush()
    return blocks


def main_text(html: str | None) -> str:
    """The article of one page: a line per block."""
    if not html:
        return ""
    _, nodes = parse(html)
    _measure(nodes)
    return "\n".join(_blocks(_kept(nodes)))


def _main_texts(html: pd.Series) -> pd.Series:
    return html.map(main_text)


def extract_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """Add ``text``, the article of each page."""
    source = F.coalesce(F.col(html).cast("string"), F.lit(""))
    return without(pages, "text").withColumn("text", F.pandas_udf(_main_texts, "string")(source))
