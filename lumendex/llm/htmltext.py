"""Main-text extraction from HTML by scoring the element tree.

Elements that never hold an article's text (navigation, forms, scripts, adverts,
comments of readers and the like, by tag, role or class) are dropped first.  Every
paragraph of the rest passes points for its length and commas to its ancestors,
less to more distant ones; a container's points are discounted by the share of its
text that lies in links.  The best container is kept.  If it lies inside an article
or main element, so does all the rest of that element but siblings that are mostly
links; otherwise those siblings stay that score well against it or are long
paragraphs or loose text with few links, and what lies between them.  The blocks, in
page order, are the text.

A class or id that names, say, a sidebar does not drop an element that holds the
page's article, most of its paragraphs, or is named as content too (`_spare`).
Where there is no article or main, the nearest element around the best container
that is named as content takes its part.

The parser is a forgiving tokeniser of its own for unclosed and stray tags, raw-text
elements, attributes and character references.  Nesting may be as deep as it is:
sums go up the tree once, after the children, and not from each text to all above.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..runtime import lean, ship, widened

# Element and attribute names of the HTML standard and names in common use.
DROPPED = frozenset(
    "script style noscript template head title nav header footer aside form iframe svg math canvas object embed audio video map menu "
    "button select option textarea input dialog datalist frameset applet".split()
)
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup "
    "time tt u var".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An opening tag on the left closes an open element on the right, up to one of the named barriers.
CLOSES_P = frozenset(
    "address article aside blockquote center details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu "
    "nav ol p pre section table ul".split()
)
SIBLINGS = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
UNLIKELY = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|sidebar|side-bar|nav\w*|menu\w*|breadcrumbs?|footer|header|masthead|comments?|"
    r"commentlist|respond|replies|disqus|cookies?|consent|gdpr|notice|notices|notification|alert|popup|modal|overlay|newsletter|subscribe|"
    r"share|sharing|social|related|recommended|widget|toolbar|pagination|pager|login|signup|skip|hidden|toc)(?:$|[\s_-])",
    re.I,
)
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())
#: Names of what is no part of an article whatever word is joined to them.
FIRM = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|comments?|commentlist|respond|replies|disqus|cookies?|consent|gdpr)(?:$|[\s_-])", re.I
)
GOOD = re.compile(r"(?:^|[\s_-])(?:article|content|main|body|entry|post|story|text|hentry)(?:$|[\s_-])", re.I)
BASE = {"article": 25.0, "main": 15.0, "section": 3.0, "div": 3.0, "td": 2.0, "blockquote": 2.0, "pre": 2.0, "ul": -3.0, "ol": -3.0, "dl": -3.0}

#: What starts markup: a comment, a tag, or a declaration; any other "<" is text.
_START = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][^\s/>]*)|[!?/])")
_ENDS = re.compile(r"--!?>")
#: One step through a tag behind its name: its end, or an attribute with its value. Quotes count only behind "=".
_STEP = re.compile(r"[\s/]*(?:(>)|([^\s/>=][^\s/>=]*|=[^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)(\"?)|'([^']*)('?)|([^\s>\"'][^\s>]*)?))?)")
_NAMES = frozenset("class id role hidden aria-hidden".split())
_PARAGRAPHS = frozenset("p pre td blockquote li dd div section article main body root figcaption".split())
#: Share of a paragraph's points that its 1st, 2nd, ... ancestor gets.
_SHARES = (1.0, 0.5, 1 / 3, 0.25, 0.2)
#: Elements that are no container of an article.
_NO_CONTAINER = INLINE | frozenset("root html p li dt dd pre hr tr h1 h2 h3 h4 h5 h6 figcaption caption".split())


class Node:
    """An element: `parts` holds its texts and child elements in order; `soft` is why its name alone drops it, if so."""

    __slots__ = ("tag", "parts", "parent", "drop", "score", "soft", "good", "text", "link")

    def __init__(self, tag: str, parent: "Node | None", drop: bool = False, score: float = 0.0, soft: str = "", good: bool = False):
        self.tag, self.parent, self.drop, self.score, self.soft, self.good = tag, parent, drop, score, soft, good
        self.parts: list = []
        self.text = self.link = 0


def _tag_end(page: str, at: int, marks: bool) -> tuple[int, list[tuple[str, str]], bool]:
    """Where a tag ends whose name ends at `at`, its attributes that matter (if `marks`), and whether it closes itself.

    A tag with a quoted value that is never closed ends at the next ">", and one without any at the page's end.
    """
    found: list[tuple[str, str]] = []
    while (m := _STEP.match(page, at)) is not None:
        if m[1]:
            return m.end(), found, page[m.end() - 2] == "/"
        if m[4] == "" or m[6] == "":  # once a page for each kind of quote, as none follows
            end = page.find(">", m.start())
            return (len(page) if end < 0 else end + 1), found, False
        name = m[2].lower()
        if marks and name in _NAMES:
            found.append((name, m[3] or m[5] or m[7] or ""))
        at = m.end()
    return len(page), found, False


def _unlikely(tag: str, attrs: list[tuple[str, str]]) -> tuple[bool, float, str, bool]:
    """Whether an element is dropped for its tag or attributes, its first points, and, if only class or id drop it, "firm", "good" (named as content too) or "soft"; and whether it is named as content."""
    drop, score, soft, good = tag in DROPPED, BASE.get(tag, 0.0), "", False
    if not drop and attrs and tag not in ("article", "main", "body", "html"):
        hard = named = firm = False
        for name, value in attrs:
            if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "role" and value.lower() in ROLES:
                hard = True
            elif name in ("class", "id"):
                named |= bool(UNLIKELY.search(value))
                firm |= bool(FIRM.search(value))
                if any(GOOD.search(x) and not FIRM.search(x) for x in value.split()):
                    good = True
                    score += 5.0
        drop = hard or named
        if named and not hard:
            soft = "good" if good else "firm" if firm else "soft"
    return drop, score, soft, good


#: Open elements are also counted since the last of these, which stray end tags do not pass.
_SCOPES = frozenset("table article main body".split())


def _leave(node: Node, outer: Node, open_: Counter, scopes: list[tuple[Node, Counter]]) -> Node:
    """`outer`, after all elements from `node` up to below it are closed."""
    while node is not outer:
        if scopes[-1][0] is node:
            scopes.pop()
        scopes[-1][1][node.tag] -= 1
        open_[node.tag] -= 1
        node = node.parent
    return outer


def parse(page: str) -> Node:
    """The element tree of a page."""
    root = node = Node("root", None)
    at, n, open_, scopes = 0, len(page), Counter(), [(root, Counter())]
    while at < n:
        m = _START.search(page, at)
        if m is None:
            node.parts.append(html.unescape(page[at:]))
            break
        if m.start() > at:
            node.parts.append(html.unescape(page[at : m.start()]))
        if m[1]:
            end = _ENDS.search(page, m.end())
            at = n if end is None else end.end()
            continue
        if not m[3]:
            end = page.find(">", m.end())
            at = n if end < 0 else end + 1
            continue
        at, attrs, closed = _tag_end(page, m.end(), not m[2])
        tag = m[3].lower()
        if m[2]:
            wall = scopes[-1][0].tag
            shut = wall == "table" and tag not in ("table", "body", "html") or wall in ("article", "main", "body") and tag in INLINE
            up = node if (scopes[-1][1] if shut else open_)[tag] else None  # else a stray end tag, without a look at all that is open
            while up is not None and up.tag != tag:
                if up.tag == "table" and tag not in ("body", "html") or up.tag in ("article", "main", "body") and tag in INLINE:
                    up = None  # a stray end tag does not close what lies outside
                    break
                up = up.parent
            if up is not None and up.parent is not None:
                node = _leave(node, up.parent, open_, scopes)
            continue
        if tag == "br":
            node.parts.append(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                node.parts.append(Node("hr", node))
            continue
        closes, stops = SIBLINGS.get(tag, ("p", "table td th button li") if tag in CLOSES_P else ("", ""))
        if closes and any(open_[x] for x in closes.split()):
            closes, stops, up = closes.split(), stops.split(), node
            while up is not None and up.tag not in stops:
                if up.tag in closes:
                    node = _leave(node, up.parent, open_, scopes)
                    if tag not in ("tr", "td", "th"):
                        break
                elif tag in CLOSES_P and up.tag not in INLINE:
                    break
                up = up.parent
        child = Node(tag, node, *_unlikely(tag, attrs))
        node.parts.append(child)
        if closed and tag in ("svg", "math"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            at = n if end is None else end.start()
            continue
        node = child
        open_[tag] += 1
        scopes[-1][1][tag] += 1
        if tag in _SCOPES:
            scopes.append((child, Counter()))
    return root


def blocks(node: Node, links: bool = False) -> Iterator[tuple[Node, str, int]]:
    """(block element, text, code points inside links) of every run of text that no block boundary cuts, without dropped elements."""
    run: list[str] = []
    linked = 0

    def flush(owner: Node) -> Iterator[tuple[Node, str, int]]:
        nonlocal linked
        text = " ".join("".join(run).split())
        if text:
            yield owner, text, min(linked, len(text))
        run.clear()
        linked = 0

    stack: list[tuple[Node, Node, bool, Iterator]] = [(node, node, links, iter(node.parts))]
    while stack:
        here, owner, inside, parts = stack[-1]
        for part in parts:
            if isinstance(part, str):
                run.append(part)
                linked += len(part) if inside else 0
            elif not part.drop:
                inline = part.tag in INLINE
                if not inline:
                    yield from flush(owner)
                stack.append((part, owner if inline else part, inside or part.tag == "a", iter(part.parts)))
                break
        else:
            if here.tag not in INLINE or len(stack) == 1:
                yield from flush(owner)
            stack.pop()


def _after_children(root: Node) -> list[Node]:
    """All elements, each after those inside it; those of dropped elements too."""
    found, stack = [], [root]
    while stack:
        x = stack.pop()
        found.append(x)
        stack.extend(part for part in x.parts if not isinstance(part, str))
    found.reverse()
    return found


def _spare(root: Node) -> None:
    """Take back the drop, by name only, of elements that hold the page's article.

    These are those that hold every article and main of the page, those with more than
    half of the text of its paragraphs (unless the name is firm), and those that are
    named as content too and are not mostly links.
    """
    soft, hosts, stack = [], 0, [(root, False, 0)]
    while stack:
        x, in_article, mains = stack.pop()
        if x.soft:
            x.drop = False
            soft.append((x, in_article, mains))
        elif x.drop:
            continue
        hosts += x.tag in ("article", "main")
        in_article, mains = in_article or x.tag == "article", mains + (x.tag == "main")
        stack.extend((part, in_article, mains) for part in x.parts if not isinstance(part, str))
    if not soft:
        return
    sums: dict[int, list[int]] = {}  # of each element: text in paragraphs outside links, text, text in links, articles and mains inside
    for owner, text, linked in blocks(root):
        got = sums.setdefault(id(owner), [0, 0, 0, 0])
        got[0] += len(text) - linked if owner.tag in _PARAGRAPHS and len(text) >= 25 else 0
        got[1], got[2] = got[1] + len(text), got[2] + linked
    for x in _after_children(root):
        if x.parent is not None and not x.drop:
            own, up = sums.get(id(x), [0, 0, 0, 0]), sums.setdefault(id(x.parent), [0, 0, 0, 0])
            for i in range(4):
                up[i] += own[i]
            up[3] += x.tag in ("article", "main")
    whole = sums.get(id(root), [0])[0]
    for x, in_article, mains in soft:
        plain, chars, linked, held = sums.get(id(x), (0, 0, 0, 0))
        holds = held > 0 and not in_article and held + mains == hosts
        most = x.soft != "firm" and 2 * plain > whole
        x.drop = not (holds or most or x.soft == "good" and 2 * linked <= chars)


def _rate(root: Node) -> Node:
    """Pass points up the tree; the best container, or the root where no paragraph gives points."""
    given = False
    for owner, text, linked in blocks(root):
        owner.text += len(text)
        owner.link += linked
        if owner.tag in _PARAGRAPHS and len(text) >= 25:
            points = (1.0 + text.count(",") + min(len(text) / 100, 3.0)) * (1 - linked / len(text))
            given |= points > 0
            up = owner if owner.tag not in ("p", "pre", "li", "dd") else owner.parent
            for share in _SHARES:
                if up is None:
                    break
                up.score += points * share
                up = up.parent
    best, most = root, float("-inf")
    for x in _after_children(root):
        if not x.text:
            continue
        if x.parent is not None:
            x.parent.text += x.text
            x.parent.link += x.link
        if x.tag in _NO_CONTAINER or not given and x.tag not in ("article", "main"):
            continue
        rated = x.score * (1 - x.link / x.text) - (5.0 if x.tag == "body" else 0.0)
        if rated > most:
            best, most = x, rated
    best.score = max(best.score, most)
    return best


def _runs(parts: list) -> list[list]:
    """Neighbouring texts and inline elements together; every other element alone."""
    found: list[list] = []
    loose = False
    for part in parts:
        inline = isinstance(part, str) or part.tag in INLINE
        if inline and loose:
            found[-1].append(part)
        else:
            found.append([part])
        loose = inline
    return found


def _beside(best: Node) -> list:
    """The best container and what of its parent belongs to it: siblings that score well, long paragraphs and loose text with few links, and all between them that is not mostly links."""
    up, limit = best.parent, max(10.0, best.score * 0.2)
    runs = _runs(up.parts)
    kept, dense = [], []
    for run in runs:
        first = run[0]
        if isinstance(first, str) or first.tag in INLINE:
            shown = [x for x in run if isinstance(x, str) or not x.drop]
            text = sum(len(" ".join(x.split())) if isinstance(x, str) else x.text for x in shown)
            link = sum(0 if isinstance(x, str) else x.text if x.tag == "a" else x.link for x in shown)
            dense.append(link / text if text else 0.0)
            kept.append(text >= 25 and dense[-1] < 0.25 or best in run)
            continue
        dense.append(first.link / first.text if first.text else 0.0)
        if first is best:
            kept.append(True)
        elif first.drop or not first.text:
            kept.append(False)
        elif first.tag in HEADINGS:
            kept.append(dense[-1] < 0.25 and up.tag == "main")
        elif first.tag == "p":
            kept.append(first.text > 80 and dense[-1] < 0.25)
        else:
            kept.append(first.score * (1 - dense[-1]) >= limit)
    low, high = kept.index(True), len(kept) - 1 - kept[::-1].index(True)
    return [part for i, run in enumerate(runs) if kept[i] or low < i < high and dense[i] <= 0.5 for part in run]


def extract(page: str | None) -> str:
    """Main text of a page; empty for a null, empty or textless page."""
    if not page:
        return ""
    root = parse(page)
    _spare(root)
    best = _rate(root)
    host = best
    while host is not None and host.tag not in ("article", "main"):
        host = host.parent
    if host is None and not best.good:  # else the nearest element that is named as content
        host = best.parent
        while host is not None and not (host.good and host.tag != "body"):
            host = host.parent
    if host is not None and host is not best:
        x = best
        while x is not host:
            for part in x.parent.parts:
                if isinstance(part, Node) and part is not x and part.tag not in INLINE and part.tag not in HEADINGS:
                    part.drop |= 2 * part.link > part.text
            x = x.parent
        return " ".join(text for _, text, _ in blocks(host))
    if best.parent is None or best.tag == "body":
        return " ".join(text for _, text, _ in blocks(best))
    best.parent.parts = _beside(best)
    return " ".join(text for _, text, _ in blocks(best.parent))


def extract_pages(pages: DataFrame) -> DataFrame:
    """`pages` with text and n_chars (code points).

    Only `html` is read; other columns pass through whatever their names, but
    columns with the added names are replaced.  A null, empty or textless page has
    an empty text; a very long or deep page is read whole; repeated rows are worked
    on one by one, and of equally good containers the inner and first one counts.
    An empty table gives no rows.
    """
    ship(pages.sparkSession)
    pages = pages.drop("text", "n_chars")
    at = pages.columns.index("html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, max(1, whole.num_rows), 512):
                b = whole.slice(a, 512)
                texts = [extract(x) for x in b.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*b.columns, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*b.schema.names, "text", "n_chars"]
                )

    return pages.mapInArrow(lean(run), widened(pages, "text string, n_chars long"))
