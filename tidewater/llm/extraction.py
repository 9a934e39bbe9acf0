"""Main text of web pages by tree scoring: paragraphs pass points for length and commas to their ancestors, discounted by the
share of linked text; the best container and its like siblings are kept."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.text import table
from tidewater.spark import ship

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_COMMAS = re.compile(r"[,،、，]")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is text up to their own end tag.
RAW = frozenset("iframe noembed noframes noscript script style template textarea title xmp".split())
#: Elements that are never article text.
DROPPED = RAW | frozenset("aside audio button canvas datalist dialog fieldset footer form head map math menu meter nav object optgroup option progress select svg video".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose start and end split blocks of text.
BLOCK = HEADINGS | frozenset("address article blockquote body caption center dd details div dl dt figcaption figure header hgroup hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that are paragraphs themselves: what they earn goes to the element around them.
LEAVES = HEADINGS | frozenset("blockquote caption dd dt figcaption li ol p pre td th tr ul".split())
#: What can't be the best container: parts of one, and what is around the whole page.
PARTS = HEADINGS | frozenset("html p #page".split())
CLOSES_P = BLOCK - frozenset("body caption html tbody td tfoot th thead tr".split()) | frozenset("aside fieldset footer form menu nav".split())
#: What a start tag ends, and the elements that its search upwards stops at.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Words of a class or id that mark what surrounds an article; reader comments among them.
MARKS = frozenset(
    "ad ads adsense advert advertisement advertising adverts banner breadcrumb breadcrumbs byline captcha comment commentlist comments consent cookie cookies copyright disclaimer disqus dropdown footer footnav gdpr header login masthead menu menus metadata modal nav navbar navigation newsletter notice notification pager pagination paywall popup promo promoted promotion recommended related remark replies reply respond sharing share shoutbox sidebar signup skip social sponsor sponsored subscribe subscription syndication tags toolbar tooltip topbar widget widgets".split()
)
COMMENTS = frozenset("comment commentlist comments disqus replies reply respond remark shoutbox".split())
#: Words that say that an element has or lacks a part ("has-sidebar"), so that it isn't that part itself.
ABOUT = frozenset("has no with without".split())
#: A paragraph earns a point for each comma, one for each 100 characters up to three, and this for being there.
BASE = 0.25
#: Of the points that an element's children have together, its own share: one child weighs half, more than two weigh more than each.
DECAY = 0.5
#: A sibling of the best container is kept when it has this share of its score.
LIKE = 0.2


class Node:
    __slots__ = ("tag", "parent", "children", "drop", "mark", "points", "chars", "linked", "kept", "block")

    def __init__(self, tag: str, parent: Node | None, drop: bool = False, mark: str = ""):
        self.tag, self.parent, self.drop, self.mark = tag, parent, drop, mark
        self.children: list[Node | str] = []
        self.points = 0.0
        self.chars = self.linked = 0
        self.kept = False
        self.block = self if tag in BLOCK or parent is None else parent.block  # the block element its text belongs to


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)} if text and not text.isspace() else {}


def _surrounds(tag: str, attributes: dict[str, str]) -> tuple[bool, str]:
    """Whether an element's own attributes say that it is no article text; "article" or "main" if they say that it is."""
    role = attributes.get("role", "").strip().lower()
    words = {w.lower() for w in _WORDS.findall(attributes.get("class", "") + " " + attributes.get("id", ""))}
    body = "articlebody" in attributes.get("itemprop", "").lower().split()
    mark = "article" if tag == "article" or body or role == "article" else "main" if tag == "main" or role == "main" else ""
    if tag in ("html", "body"):
        return False, ""
    if tag in DROPPED or role in ROLES or "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower():
        return True, ""
    if words & COMMENTS and not words & ABOUT:
        return True, ""
    return bool(words & MARKS and not words & ABOUT and not mark), mark


def parse(page: str) -> Node:
    """The page as a tree, forgiving as browsers are: unclosed paragraphs, items and cells end where the next begins, an end tag
    without its start is passed over, what is open at the end is closed. Iterative, so depth is no limit."""
    root = now = Node("#page", None)
    open_: dict[str, int] = {}
    at = 0

    def leave(to: Node) -> None:
        nonlocal now
        while now is not to:
            open_[now.tag] -= 1
            now = now.parent
        open_[now.tag] -= 1
        now = now.parent

    while at < len(page):
        m = _TOKEN.search(page, at)
        if m is None:
            now.children.append(html.unescape(page[at:]))
            break
        if m.start() > at:
            now.children.append(html.unescape(page[at : m.start()]))
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            if tag == "br":
                now.children.append(" ")
            elif open_.get(tag):
                to = now
                while to.tag != tag:
                    to = to.parent
                leave(to)
        elif m[2]:
            tag = m[2].lower()
            if tag == "br":
                now.children.append(" ")
                continue
            if tag in CLOSES_P and open_.get("p"):
                to = now
                while to.tag != "p" and to.tag not in ("td", "th", "button", "#page"):
                    to = to.parent
                if to.tag == "p":
                    leave(to)
            elif tag in ENDS and any(open_.get(t) for t in ENDS[tag][0]):
                ends, stops = ENDS[tag]
                to, last = now, None
                while to.tag != "#page" and to.tag not in stops:
                    last = to if to.tag in ends else last
                    to = to.parent
                if last is not None:
                    leave(last)
            drop, mark = _surrounds(tag, _attributes(m[3]))
            node = Node(tag, now, drop, mark)
            now.children.append(node)
            if tag in RAW and not m[3].rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else len(page)
            elif tag not in VOID and not (m[3].rstrip().endswith("/") and tag not in BLOCK and tag not in ("a", "b", "i", "span")):
                now = node
                open_[tag] = open_.get(tag, 0) + 1
    return root


def _in_order(root: Node) -> list[Node]:
    """Every element of the tree that isn't dropped, parents first. In an article, a header keeps its headings only."""
    out, stack = [], [(root, False)]
    while stack:
        node, inside = stack.pop()
        inside = inside or bool(node.mark)
        out.append(node)
        if node.tag == "header":
            node.children = _headings(node) if inside else []
        stack += [(c, inside) for c in reversed(node.children) if isinstance(c, Node) and not c.drop]
    return out


def _headings(header: Node) -> list[Node]:
    found, stack = [], [c for c in reversed(header.children) if isinstance(c, Node)]
    while stack:
        node = stack.pop()
        if node.tag in HEADINGS:
            node.parent = header
            found.append(node)
        elif not node.drop:
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]
    return found


def _squeeze(parts: list[str]) -> str:
    return " ".join("".join(parts).split())


def _blocks(node: Node, whole: bool = True) -> Iterator[tuple[Node, str, int]]:
    """Blocks of text below ``node`` in page order, each with the block element it stands in and its linked characters. With
    ``whole`` unset, of the elements that are kept only."""
    owner, text, linked, in_link = node, [], [], 0
    stack: list[tuple[object, bool, bool]] = [(node, False, whole)]

    def close() -> Iterator[tuple[Node, str, int]]:
        said = _squeeze(text)
        if said:
            yield owner, said, len(_squeeze(linked))
        text.clear()
        linked.clear()

    while stack:
        what, left, all_ = stack.pop()
        if isinstance(what, str):
            if all_:
                text.append(what)
                if in_link:
                    linked.append(what)
        elif left:
            if what.tag == "a":
                in_link -= 1
            if what.tag in BLOCK:
                yield from close()
                owner = what.parent.block if what.parent is not None else what
        elif not what.drop:
            all_ = all_ or what.kept
            if what.tag in BLOCK:
                yield from close()
                owner = what
            in_link += what.tag == "a"
            stack.append((what, True, all_))
            stack += [(c, False, all_) for c in reversed(what.children)]
    yield from close()


def _score(root: Node) -> list[Node]:
    """Points and link density of every element, from the blocks upwards."""
    nodes = _in_order(root)
    for owner, said, linked in _blocks(root):
        share = 1 - min(1.0, linked / len(said))
        points = (BASE + len(_COMMAS.findall(said)) + min(len(said) / 100, 3)) * share if owner.tag not in HEADINGS else BASE * share
        to = owner.parent if owner.tag in LEAVES and owner.parent is not None else owner
        to.points += points
        owner.chars += len(said)
        owner.linked += linked
    for node in reversed(nodes):
        if node.parent is not None:
            node.parent.points += DECAY * node.points
            node.parent.chars += node.chars
            node.parent.linked += node.linked
    return nodes


def _worth(node: Node) -> float:
    return node.points * (1 - node.linked / node.chars) if node.chars else 0.0


def _like(node: Node, least: float) -> bool:
    """Whether a sibling of the best container belongs to the article: by its score, or as a paragraph of prose or a heading."""
    if node.drop or not node.chars:
        return False
    share = node.linked / node.chars
    if node.tag in HEADINGS:
        return share < 0.5
    if node.tag in ("p", "pre", "blockquote", "ul", "ol", "table", "figure"):
        return share < (0.25 if node.chars > 80 else 0.05)
    return _worth(node) >= least


def main_text(page: str) -> str:
    """The article of a page, its blocks joined by two line breaks; empty if there is none."""
    root = parse(page)
    nodes = _score(root)
    best, most = None, 0.0
    for node in nodes:
        if node.tag not in PARTS and _worth(node) > most:
            best, most = node, _worth(node)
    if best is None:
        best, most = root, _worth(root)
    for mark in ("article", "main"):
        up = best
        while up is not None and up.mark != mark:
            up = up.parent
        if up is not None:
            best = up
            break
    best.kept = True
    if best.mark:  # what the page itself calls its article goes with other articles beside it, and with headings in its main part
        for c in best.parent.children:
            if isinstance(c, Node) and (c.mark == best.mark or best.parent.mark and c.tag in HEADINGS):
                c.kept = c.kept or _like(c, LIKE * most)
    else:
        now = best
        while now.parent is not None and now.tag != "body":
            for c in now.parent.children:
                if isinstance(c, Node) and c is not now:
                    c.kept = _like(c, LIKE * most)
            now = now.parent
    for node in nodes:  # lists and bars of links inside the article are menus
        if node is not best and node.tag in ("ul", "ol", "div", "section", "dl") and node.chars and node.linked >= 0.8 * node.chars and sum(isinstance(c, Node) for c in node.children) >= 3:
            node.drop = True
    return "\n\n".join(said for _, said, _ in _blocks(root, False))


def extract(pages: DataFrame) -> DataFrame:
    """The main text of every row of ``pages`` (page_id, url, html): page_id, url, text, n_chars (code points).

    Elements that surround articles go first: by tag (navigation, footers, asides, forms, scripts ...), role, hiding, or words of
    class and id (adverts, notices, sidebars, reader comments ...). Each remaining block of text passes points (commas, length)
    up, halved at every level, discounted by its linked share. The best container, lifted to the article or main element around
    it, is kept whole with siblings that have a fifth of its score, prose paragraphs and headings beside it, at each level up to
    the body. Inside, lists of links are left out, and a header keeps its headings. Any white space, line break elements included,
    becomes one space; references are decoded once.

    One pass of Arrow batches without a shuffle, one page at a time; a row is never cut or dropped. Null or empty html, and pages of
    markup alone, give an empty text; text without any markup is its own article. Repeated rows and null ids give a row each;
    other columns, whatever their names, are ignored; an empty table gives no rows.
    """
    ship(pages.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at : at + 500]
                text = [main_text(h) if isinstance(h, str) else "" for h in part.html]
                yield pd.DataFrame({"page_id": part.page_id.astype("Int64"), "url": part.url, "text": text, "n_chars": [len(t) for t in text]})

    lean = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return lean.mapInPandas(run, "page_id long, url string, text string, n_chars long")


def op12_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all ``pages``."""
    return extract(table(spark, sf_dir, "pages"))
