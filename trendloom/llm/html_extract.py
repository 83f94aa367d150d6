"""Main-text extraction by scoring the tree of containers.

Each paragraph gives points for its length and commas to its parent, half of
them to the grandparent, a quarter and so on further up, in one pass from the
leaves; a container's sum is discounted by its link density, and raised if its
tag or name says that it is the article.  The best container wins, with those
siblings that look like content, and as far up as all of a parent is such.

Elements that by definition are not running text (scripts, menus, buttons, ...)
give no points and no text.  Forms, and containers whose class or id has a word
that adverts, menus, notices or reader comments go by, are left out whatever
their size; two kinds are not: one that holds the page's main heading or its
main element (a wrapper with an unlucky name), and, on a page that has no other
text at all, the one with the most points.

Every open element is found by its tag at once, and scores are carried up once,
so that a page costs time in proportion to its length, however deep it is.
"""

from __future__ import annotations

import html as _html
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.llm.shared import small_batches

# The elements of HTML by what they do to text.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript", "template"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
CLOSES_P = BLOCK - {"html", "body"}
NEVER = RAW | set("head nav aside footer button select option datalist svg math canvas audio video object menu dialog input label legend search".split())
ROLES = set("comment navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
# Words in class or id, of what is beside an article and of the article itself.
NAMES = set(
    "ad ads adv advert adverts advertisement advertising adsense banner banners sponsor sponsored promo promoted promotion nav navbar navigation menu menus breadcrumb breadcrumbs "
    "sidebar sidebars footer masthead topbar toolbar pagination pager comment comments commentlist disqus respond reply replies discussion notice notices cookie cookies consent gdpr "
    "alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations widget widgets form search toc skip tags".split()
)
COMMENTS = set("comment comments commentlist disqus respond reply replies discussion".split())
ARTICLE = set("article articlebody body content entry main maincontent post story text".split())
RAISED = 4.0  # of article and main
_TAG = re.compile(r"""<(?:!--.*?(?:--!?>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*'|["'])*?)(?:>|\Z)|[!?/][^>]*(?:>|\Z))""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_WORD = re.compile(r"[a-z0-9]+")


@dataclass
class Node:
    tag: str
    parent: Node | None
    never: bool = False
    doubt: bool = False
    thread: bool = False  # doubted as reader comments
    inside: bool = False  # within an article or main element
    wraps: bool = False  # holds the main heading or the main element
    raised: float = 1.0
    total: float = 0.0  # points of all its text
    points: float = 0.0  # those that it got as an ancestor
    chars: int = 0
    link_chars: int = 0
    children: list = field(default_factory=list)  # Nodes, and Blocks of text in page order


@dataclass
class Block:
    text: str
    links: int


def _named(value: str) -> tuple[bool, bool]:
    """Whether a class or id goes by what is beside an article, and by reader comments.

    A name counts as one of the words that it is made of: side-bar-ad has "ad".  Of
    a name with words of both kinds ("post-widget") neither counts, unless it
    speaks of comments ("comment-body"); one name of the article's alone clears all.
    """
    beside = thread = False
    for name in value.split():
        words = set(_WORD.findall(name))
        if words & COMMENTS:
            beside = thread = True
        elif words & ARTICLE:
            if not words & NAMES:
                return False, False
        else:
            beside |= bool(words & NAMES)
    return beside, thread


def _judge(node: Node, attributes: str) -> None:
    """Says of a new element whether it never is content, is doubted, or raised."""
    tag, parent = node.tag, node.parent
    node.inside = parent.inside or parent.tag in ("article", "main")
    node.never = parent.never or tag in NEVER or (tag == "header" and not node.inside)
    node.doubt = tag == "form"
    node.raised = RAISED if tag in ("article", "main") else 1.0
    if node.never or not attributes:
        return
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (a or b or c).lower()
        if name == "role":
            node.never |= value.strip() in ROLES
            node.raised = RAISED if value.strip() in ("main", "article") else node.raised
        elif name == "aria-hidden":
            node.never |= value.strip() == "true"
        elif name == "style":
            node.never |= "display:none" in value.replace(" ", "")
        elif name in ("class", "id") and tag != "main":
            beside, thread = _named(value)
            if tag == "article" and not node.inside:
                # The page's own article may be named by its parts; a comment's is not.
                beside &= thread
            elif "header" in _WORD.findall(value) and not node.inside:
                beside |= not set(_WORD.findall(value)) & ARTICLE
            node.doubt |= beside
            node.thread |= thread
    node.never |= bool(re.search(r"(?:^|\s)hidden(?:\s|=|/|$)", _ATTRIBUTE.sub(lambda m: f" {m[1]}= ", attributes)))


class Open:
    """The open elements, from the root down, each to be found by its tag at once."""

    def __init__(self, root: Node) -> None:
        self.path, self.by_tag, self.borders = [root], {}, []

    @property
    def here(self) -> Node:
        return self.path[-1]

    def enter(self, node: Node) -> None:
        self.by_tag.setdefault(node.tag, []).append(len(self.path))
        if node.tag in _BORDERS:
            self.borders.append(len(self.path))
        self.path.append(node)

    def find(self, tag: str) -> int:
        """Depth of the innermost open element of the tag, 0 if there is none; a paragraph is not seen through a border."""
        at = (self.by_tag.get(tag) or [0])[-1]
        return 0 if tag == "p" and self.borders and self.borders[-1] > at else at

    def leave(self, depth: int) -> None:
        """Closes the element at that depth and all within it."""
        while len(self.path) > depth > 0:
            tag = self.path.pop().tag
            self.by_tag[tag].pop()
            if tag in _BORDERS:
                self.borders.pop()

    def next_item(self, tag: str) -> None:
        """An open item of the same list or row ends where the next begins."""
        stop = max(((self.by_tag.get(t) or [0])[-1] for t in _LISTS), default=0)
        outer = []
        for t in _ITEMS[tag]:
            depths = self.by_tag.get(t) or []
            k = bisect_right(depths, stop)
            outer += depths[k : k + 1]
        if outer:
            self.leave(min(outer))


# What a paragraph's end tag does not reach through, and which items end where another begins.
_BORDERS = {"table", "td", "th", "ul", "ol", "dl", "article", "section", "main", "div", "blockquote", "body", "html", "nav", "aside", "footer", "form"}
_LISTS = ("ul", "ol", "menu", "dl", "table", "select")
_ITEMS = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th"), "option": ("option",)}


def parse(page: str) -> Node:
    """The tree of block elements; text that lies between block borders is one Block of its container."""
    root = Node("html", None)
    path, pieces, links, in_link, at = Open(root), [], 0, 0, 0

    def flush() -> None:
        nonlocal pieces, links
        text = " ".join("".join(pieces).split())
        if text:
            path.here.children.append(Block(text, min(links, len(text))))
        pieces, links = [], 0

    def say(text: str) -> None:
        nonlocal links
        if path.here.never or not text:
            return
        text = _html.unescape(text)
        pieces.append(text)
        if in_link:
            links += len(" ".join(text.split()))

    while at < len(page):
        m = _TAG.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        closing, attributes = bool(m[1]), m[3]
        if tag in RAW and not closing:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            stop = end.start() if end else (page.find("<", at) if tag in ("title", "noscript", "iframe") else len(page))
            at = stop if stop >= 0 else len(page)
            continue
        if tag == "a":
            in_link = 0 if closing else 1
        elif tag in ("br", "wbr"):
            pieces.append(" " if tag == "br" else "")
        elif tag in VOID and tag != "hr":
            pieces.append(" " if tag == "img" else "")
        elif tag == "hr":
            flush()
        elif tag in BLOCK or tag in NEVER:
            flush()
            if not closing:
                if tag in CLOSES_P:
                    path.leave(path.find("p"))
                if tag in _ITEMS:
                    path.next_item(tag)
                if tag not in ("html", "body"):
                    node = Node(tag, path.here)
                    _judge(node, attributes)
                    path.here.children.append(node)
                    if not attributes.rstrip().endswith("/") or tag in BLOCK:
                        path.enter(node)
            elif tag not in ("html", "body") and path.find(tag):
                path.leave(path.find(tag))
                in_link = 0
    flush()
    return root


def _postorder(root: Node) -> Iterator[Node]:
    """Containers after all that they hold; what never is content is left out."""
    stack = [(root, False)]
    while stack:
        node, back = stack.pop()
        if back:
            yield node
        elif not node.never:
            stack.append((node, True))
            stack += [(c, False) for c in node.children if isinstance(c, Node)]


def _block_points(block: Block, node: Node) -> float:
    if node.tag in HEADINGS:
        return 0.0
    return (1 + block.text.count(",") + min(len(block.text) / 100, 3)) * (1 - block.links / len(block.text))


def _settle(root: Node) -> None:
    """Doubted containers go, but for wrappers of the whole; if then no text is left, the one with the most points comes back, threads of comments last."""
    for node in _postorder(root):
        own = [c for c in node.children if isinstance(c, Node) and not c.never]
        node.wraps = node.tag in ("h1", "main") or any(c.wraps for c in own if not c.thread)
        node.doubt &= not (node.wraps and not node.thread)
        node.total = sum(_block_points(c, node) for c in node.children if isinstance(c, Block)) + sum(c.total for c in own)

    def outermost(node: Node) -> Iterator[Node]:
        stack = [c for c in node.children if isinstance(c, Node)]
        while stack:
            n = stack.pop()
            if n.doubt and not n.never:
                yield n
            elif not n.never:
                stack += [c for c in n.children if isinstance(c, Node)]

    doubted = list(outermost(root))
    rest = root.total - sum(n.total for n in doubted)
    while doubted and rest <= 1e-9:
        best = max(doubted, key=lambda n: (n.total > 0, not n.thread, n.total))
        if best.total <= 0:
            break
        within = list(outermost(best))
        doubted = [n for n in doubted if n is not best] + within
        rest += best.total - sum(n.total for n in within)
    for n in doubted:
        n.never = True


def _score(root: Node) -> None:
    """Points of every container: its own text's, and of each child half of what that has."""
    own = {"p", "pre", "td", "li", "dd", "blockquote"}  # their text counts for what they stand in
    for node in _postorder(root):
        lifted = 0.0
        for c in node.children:
            if isinstance(c, Block):
                node.chars += len(c.text)
                node.link_chars += c.links
                if node.tag in own and node.parent is not None:
                    lifted += _block_points(c, node)
                else:
                    node.points += _block_points(c, node)
            elif not c.never:
                node.chars += c.chars
                node.link_chars += c.link_chars
        if node.parent is not None:
            # What the node got as the container of its children's text goes up by half, its own paragraph whole.
            node.parent.points += lifted + node.points / 2


def _worth(node: Node) -> float:
    return node.raised * node.points * (1 - node.link_chars / node.chars) if node.chars else 0.0


def _nodes(root: Node) -> Iterator[Node]:
    stack = [root]
    while stack:
        node = stack.pop()
        if node.never:
            continue
        yield node
        stack += [c for c in reversed(node.children) if isinstance(c, Node)]


def _blocks(node: Node) -> Iterator[str]:
    stack: list = [node]
    while stack:
        x = stack.pop()
        if isinstance(x, Block):
            yield x.text
        elif not x.never:
            stack += reversed(x.children)


def _alike(best: Node, c: Node | Block, least: float) -> bool:
    """Whether a child of best's parent belongs to best's text."""
    if isinstance(c, Block):
        return best.tag not in ("article", "main") and len(c.text) > 80 and c.links < 0.25 * len(c.text)
    density = c.link_chars / c.chars if c.chars else 1.0
    if c.tag in HEADINGS:
        return density < 0.5 and (best.tag != "main" and (best.tag != "article" or c.inside))
    if best.tag in ("article", "main"):
        return c.tag == best.tag and _worth(c) >= least
    return (_worth(c) >= least and density < 0.33) or (c.tag == "p" and c.chars > 80 and density < 0.25)


def main_text(page: str | None) -> str:
    """Blocks of the main text, joined by an empty line; empty if the page has none."""
    root = parse(page or "")
    _settle(root)
    _score(root)
    best = max(_nodes(root), key=_worth, default=root)
    if _worth(best) <= 0:
        # Only headings and links: no container stands out, so all that may be content is.
        return "\n\n".join(_blocks(root))
    while best.tag in ("p", "li", "td", "th", "tr", "tbody", "dd", "pre", "blockquote", "ul", "ol", "table") and best.parent is not None:
        best = best.parent
    kept = [best]
    while best.parent is not None:
        least = max(2.0, 0.2 * _worth(best))
        texts = [c for c in best.parent.children if isinstance(c, Block) or (not c.never and c.chars)]
        kept = [c for c in texts if c is best or _alike(best, c, least)]
        if len(kept) < len(texts):
            break
        # All of the parent is the article's: what lies beside the parent may be, too.
        best = best.parent
        kept = [best]
    return "\n\n".join(t for c in kept for t in ([c.text] if isinstance(c, Block) else _blocks(c)))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars (code points) of every row of pages.

    Null, empty or unreadable html gives an empty text; nulls in the other
    columns stay; repeated rows give a row each; further columns are not read.
    Nothing is capped.  An empty table gives an empty one.
    """
    small_batches(pages.sparkSession)

    @F.pandas_udf("string")
    def text(html: pd.Series) -> pd.Series:
        return html.map(main_text)

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), text(F.coalesce(F.col(html_col).cast("string"), F.lit(""))).alias("text"))
    return rows.withColumn("n_chars", F.length("text").cast("long"))
