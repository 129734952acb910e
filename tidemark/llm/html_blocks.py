"""Main text of web pages: flat text blocks, features of a block and its neighbours, and a small decision tree.

A page is read once into blocks, stretches of text between block-level tags. A block's features are its own words and
link density, those of the blocks before and after, the kind of element it stands in and what class and id names say.
The tree is grown from TABLE, a labelled table of typical blocks, when the operator starts; it is a few dozen nodes.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import require

FEATURES = ("words", "links", "before_words", "before_links", "after_words", "after_links", "place", "named", "heading", "paragraph")
#: place: -1 in nav, header, footer, aside, form and the like, 1 in article or main, 0 elsewhere. named: class or id
#: speaks of a menu, advert, notice, comment and the like. links: share of words inside links.
#: words links before_words before_links after_words after_links place named heading paragraph -> 1 for main text
TABLE = """
1 1.0 0 0.0 1 1.0 -1 0 0 0 0
2 1.0 1 1.0 3 1.0 -1 0 0 0 0
1 1.0 1 1.0 20 0.0 -1 0 0 0 0
12 0.1 40 0.0 0 0.0 -1 0 0 0 0
60 0.0 60 0.0 0 0.0 -1 0 0 1 0
25 0.0 8 0.0 80 0.0 -1 0 0 1 0
8 0.0 0 0.0 3 1.0 -1 0 1 0 0
300 0.0 50 0.0 60 0.0 -1 0 0 1 0
5 0.0 90 0.0 40 0.0 -1 1 1 0 0
20 0.0 1 1.0 10 0.0 0 1 0 0 0
9 0.0 1 1.0 70 0.0 0 1 0 0 0
45 0.0 20 0.0 90 0.0 0 1 0 1 0
150 0.0 100 0.0 100 0.0 0 1 0 1 0
6 0.0 60 0.0 60 0.0 0 1 1 0 0
30 0.0 120 0.0 120 0.0 1 1 0 1 0
80 0.1 200 0.0 10 0.0 1 1 0 1 0
4 0.5 90 0.0 30 0.0 1 1 0 0 0
7 0.0 80 0.0 40 0.0 1 1 1 0 0
200 0.0 80 0.0 40 0.0 1 1 0 1 0
2 0.0 5 0.0 0 0.0 1 1 0 0 0
2 0.0 4 0.0 40 0.0 1 1 0 0 0
3 0.0 60 0.0 60 0.0 1 1 0 1 0
10 0.0 60 0.0 4 1.0 1 1 0 1 0
5 0.8 40 0.0 40 0.0 1 1 0 1 0
4 1.0 60 0.0 60 0.0 1 1 0 1 0
8 0.0 20 0.0 60 0.0 1 0 1 0 1
3 0.0 2 1.0 5 0.0 1 0 1 0 1
12 0.0 90 0.0 2 0.0 1 0 1 0 1
60 0.0 8 0.0 70 0.0 1 0 0 1 1
1 0.0 70 0.0 10 0.0 1 0 0 1 1
2 0.0 5 0.0 3 0.0 1 0 0 1 1
15 0.0 0 0.0 0 0.0 1 0 0 1 1
200 0.1 60 0.0 20 0.0 1 0 0 1 1
35 0.3 60 0.0 40 0.0 1 0 0 1 1
20 0.0 30 0.0 30 0.0 1 0 0 0 1
4 0.0 40 0.0 4 0.0 1 0 0 0 1
900 0.0 30 0.0 30 0.0 1 0 0 1 1
6 0.4 50 0.0 50 0.0 1 0 0 1 1
5 0.8 40 0.0 40 0.0 1 0 0 1 1
4 1.0 60 0.0 60 0.0 1 0 0 1 1
3 0.7 30 0.0 50 0.0 1 0 0 1 1
12 0.8 15 0.0 20 0.0 1 0 0 1 1
12 0.0 40 0.0 4 1.0 1 0 0 1 1
4 0.0 60 0.0 3 1.0 1 0 0 1 1
6 0.0 60 0.0 5 1.0 0 0 0 1 1
1 1.0 1 1.0 1 1.0 1 0 0 0 0
4 1.0 60 0.0 5 1.0 1 0 0 0 0
5 1.0 5 1.0 12 0.0 1 0 0 0 0
7 0.9 40 0.0 6 0.9 1 0 0 0 0
3 1.0 80 0.0 0 0.0 1 0 0 1 0
80 0.0 10 0.0 90 0.0 0 0 0 1 1
40 0.0 60 0.0 40 0.0 0 0 0 1 1
25 0.1 60 0.0 40 0.0 0 0 0 1 1
120 0.0 2 1.0 100 0.0 0 0 0 0 1
18 0.0 40 0.0 90 0.0 0 0 0 1 1
4 0.0 80 0.0 60 0.0 0 0 0 1 1
7 0.0 3 1.0 70 0.0 0 0 1 0 1
5 0.0 90 0.0 60 0.0 0 0 1 0 1
3 0.0 90 0.0 60 0.1 0 0 1 0 1
12 0.0 2 0.0 40 0.0 0 0 0 1 1
20 0.0 2 0.0 2 0.0 0 0 0 1 1
14 0.0 4 0.0 9 0.0 0 0 0 1 1
40 0.0 3 1.0 2 1.0 0 0 0 1 1
2 0.0 20 0.0 20 0.0 0 0 0 1 1
3 0.0 2 1.0 2 1.0 0 0 1 0 0
4 0.0 60 0.0 3 1.0 0 0 1 0 0
5 0.0 3 1.0 4 1.0 0 0 0 0 0
2 1.0 2 1.0 2 1.0 0 0 0 0 0
1 1.0 0 0.0 1 1.0 0 0 0 0 0
6 1.0 80 0.0 6 1.0 0 0 0 0 0
10 0.8 50 0.0 50 0.0 0 0 0 0 0
30 0.9 4 1.0 4 1.0 0 0 0 0 0
4 0.0 2 0.5 3 0.3 0 0 0 0 0
8 0.3 5 1.0 1 0.0 0 0 0 0 0
6 0.0 60 0.0 0 0.0 0 0 0 0 0
15 0.7 80 0.0 3 1.0 0 0 0 1 0
"""

_PARTS = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|title|textarea|iframe)\b[^>]*>(?:.*?</\1\s*>|.*\Z)|<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|<[/a-zA-Z!?][^<>]*\Z", re.S | re.I)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_TOLD = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adbox|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notice\w*|alert|comments?|commentlist|replies|reply|respond|disqus|sidebar|side|widget\w*|menu\w*|nav\w*|breadcrumbs?|pagination|pager|"
    r"footer|header|masthead|share|sharing|social|related|recommend\w*|newsletter|subscribe|signup|login|popup|modal|overlay|toolbar|skip|copyright|complementary|contentinfo|navigation|search)(?:$|[\s_-])",
    re.I,
)
#: Share of a page's unlinked words that what holds the article has at least.
MOST_WORDS = 0.5
_OUTSIDE = frozenset("nav header footer aside form menu dialog fieldset".split())
_INSIDE = frozenset("article main".split())
#: Elements that stand beside an article unless they hold it.
_FORMS = frozenset("form fieldset".split())
_WHOLE = _INSIDE | frozenset("html body".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that end by themselves at the next block; they aren't kept on the stack.
_SHORT = frozenset("p li dt dd tr td th thead tbody tfoot caption figcaption h1 h2 h3 h4 h5 h6 summary pre hr legend label".split())
#: Elements whose text isn't shown as text; those of _BRIEF hold no blocks, so they end where one starts.
_BRIEF = frozenset("head select option button".split())
_HIDDEN = _BRIEF | frozenset("noscript template svg".split())
_HOLD = _OUTSIDE | _INSIDE | frozenset("div section ul ol dl table blockquote figure address details body html center".split())


class Node:
    """An element that holds blocks: whether it or one around it stands beside the article, and whether it holds the article or its title."""

    __slots__ = ("name", "parent", "place", "named", "hidden", "article", "title", "words")

    def __init__(self, name: str, parent: Node | None, place: int, named: bool, hidden: bool = False):
        self.name, self.parent, self.place, self.named, self.hidden = name, parent, place, named, hidden or (parent is not None and parent.hidden)
        self.article = self.title = False
        self.words = 0.0

    def up(self) -> Iterator[Node]:
        """The element and those around it."""
        node: Node | None = self
        while node is not None:
            yield node
            node = node.parent

    def says(self) -> tuple[int, bool]:
        """place and named of the blocks in it.

        Names of what holds the article (marked, or told by ``weigh``) say what stands beside it, not what it is, and a form can hold a whole page;
        inside the article, neither do names of what holds its title.
        """
        place, named = 0, False
        for node in reversed([*self.up()]):
            if node.place == -1 and not (node.article and node.name in _FORMS):
                return -1, named
            if node.place == 1:
                place = 1
            if node.article:
                named = False
            elif node.named and node.name not in _WHOLE and not (node.title and place == 1):
                named = True
        return place, named


def blocks(page: str) -> tuple[list[str], np.ndarray]:
    """Texts of the page's blocks in order, and a row of FEATURES for each."""
    texts: list[str] = []
    rows: list[tuple] = []
    homes: list[Node | None] = []
    stack: list[Node] = []
    pieces: list[str] = []
    linked = link = 0
    short, told, inside, wraps = "", False, False, False

    def close() -> None:
        nonlocal linked
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                n = max(1, len(text.split()))
                texts.append(text)
                rows.append([n, min(1.0, linked / n), 0.0, float(told), float(short in _HEADINGS), float(short == "p")])
                homes.append(stack[-1] if stack else None)
            pieces.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if stack and stack[-1].hidden:
            return
        pieces.append(text)
        if link:
            linked += len(text.split())

    def pop(name: str) -> None:
        if any(x.name == name for x in stack):
            while stack.pop().name != name:
                pass

    at = 0
    for m in _PARTS.finditer(page):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            continue
        if name in _BRIEF:
            close()
        if name in _HIDDEN:
            if stack and stack[-1].name == "option" and name == "option" and not m[2]:
                stack.pop()
            if m[2]:
                pop(name)
            elif not m[4].endswith("/"):
                stack.append(Node(name, stack[-1] if stack else None, 0, False, hidden=True))
            continue
        if not m[2] and (name in _SHORT or name in _HOLD):
            while stack and stack[-1].name in _BRIEF:
                stack.pop()
        if name == "a":
            link, wraps = (0, False) if m[2] else (1, not short)  # one link ends where the next begins
        elif name == "br":
            pieces.append(" ")
        elif name in _SHORT:
            close()
            if not wraps:  # a link that began in a block ends with it
                link = 0
            short, told = ("", False) if m[2] else (name, speaks(m[4]))
            if name == "h1" and not m[2] and stack:
                for node in stack[-1].up():
                    node.title = True
        elif name in _HOLD:
            close()
            short, told, link, wraps = "", False, 0, False
            if m[2]:
                pop(name)
                continue
            within = next((x.place for x in reversed(stack) if x.place), 0) if stack else 0
            place = -1 if name in _OUTSIDE and not (name == "header" and within == 1) else int(name in _INSIDE)
            node = Node(name, stack[-1] if stack else None, place, speaks(m[4]))
            if name == "main" or name == "article" and not inside:  # later articles can be comments
                for x in node.up():
                    x.article = True
            inside = inside or name in _INSIDE
            stack.append(node)
    if at < len(page):
        add(page[at:])
    close()
    x = np.zeros((len(rows), len(FEATURES)))
    if rows:
        if not inside:
            weigh(rows, homes)
        known: dict[int, tuple[int, bool]] = {}
        for row, home in zip(rows, homes, strict=True):
            if home is not None:
                if id(home) not in known:
                    known[id(home)] = home.says()
                row[2], row[3] = known[id(home)][0], max(row[3], float(known[id(home)][1]))
        own = np.array(rows)
        x[:, 0:2], x[:, 6:] = own[:, :2], own[:, 2:]
        x[1:, 2:4], x[:-1, 4:6] = own[:-1, :2], own[1:, :2]
    return texts, x


def weigh(rows: list, homes: list[Node | None]) -> None:
    """On a page that marks no article: what holds its title and most of its unlinked words holds the article, whatever its name.

    A sidebar, a thread of comments or a footer doesn't hold the title. A page without one is left as its names say.
    """
    for (n, linked, *_), home in zip(rows, homes, strict=True):
        for node in home.up() if home is not None else ():
            node.words += n * (1 - linked)
    total = sum(n * (1 - linked) for n, linked, *_ in rows)
    nodes = {id(x): x for home in homes if home is not None for x in home.up()}.values()
    for x in nodes:
        x.article = x.title and x.words >= MOST_WORDS * total > 0 and x.name not in _OUTSIDE - _FORMS
    holders = [x for x in nodes if x.article and x.name not in _WHOLE]
    if holders:  # the innermost is the article's element
        max(holders, key=lambda x: len([*x.up()])).place = 1


def speaks(attributes: str) -> bool:
    """Whether a class, id or role names something that isn't main text."""
    return "=" in attributes and any(_TOLD.search(m[1] or m[2] or m[3] or "") for m in _NAMES.finditer(attributes))


def grow(x: np.ndarray, y: np.ndarray) -> tuple:
    """A decision tree by Gini impurity until leaves are pure: (feature, cut, left, right), or a label."""
    if len(set(y.tolist())) == 1:
        return (int(y[0]),)
    best: tuple[float, int, float] | None = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for cut in (values[1:] + values[:-1]) / 2:
            low = x[:, f] < cut
            gini = sum(part.size * 2 * part.mean() * (1 - part.mean()) for part in (y[low], y[~low]))
            if best is None or gini < best[0] - 1e-12:
                best = (gini, f, float(cut))
    if best is None:
        return (int(round(y.mean())),)
    low = x[:, best[1]] < best[2]
    return best[1], best[2], grow(x[low], y[low]), grow(x[~low], y[~low])


def decide(tree: tuple, x: np.ndarray) -> np.ndarray:
    """Label of every row."""
    if len(tree) == 1:
        return np.full(len(x), tree[0], dtype=np.int8)
    f, cut, left, right = tree
    low = x[:, f] < cut
    out = np.zeros(len(x), dtype=np.int8)
    out[low], out[~low] = decide(left, x[low]), decide(right, x[~low])
    return out


def trained(table: str = TABLE) -> tuple:
    """The tree of a labelled table."""
    rows = np.array([[float(v) for v in line.split()] for line in table.strip().splitlines()])
    return grow(rows[:, :-1], rows[:, -1])


def extract(pages: DataFrame, table: str = TABLE) -> DataFrame:
    """Every page's columns but html, with ``text`` (main blocks joined by a blank line) and ``n_chars``.

    The whole html is read. Null, empty and textless pages have an empty text. Repeated rows come out as often as they
    are there; columns named text or n_chars in the input are replaced.
    """
    require(pages, "html")
    tree = trained(table)
    names = [c for c in pages.columns if c not in ("html", "text", "n_chars")]
    schema = pages.select(*names).schema.add("text", "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                found = [blocks(h or "") for h in part.column("html").to_pylist()]
                keep = decide(tree, np.concatenate([x for _, x in found])) if found else np.zeros(0)
                at, texts = 0, []
                for own, _ in found:
                    texts.append("\n\n".join(t for t, k in zip(own, keep[at : at + len(own)], strict=True) if k))
                    at += len(own)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*names, "text", "n_chars"])

    return pages.select(*names, "html").mapInArrow(run, schema)


def op8(spark, sf_dir: str) -> DataFrame:
    """The contract's main text of every page."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
